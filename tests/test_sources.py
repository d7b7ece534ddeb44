"""Loaders of delimited files, the columnar cache, expected results, derived keys."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.sources import Star, Tables, cache_columnar, load_ssb, load_tpch, read_golden, read_tbl
from tessera.sources.derive import partsupp
from tessera.sources.tables import SSB, TPCH

SF = "/root/testdata/sf0.01"
VALUES = {"i": "7", "n": "12.34", "m": "-0.5", "d": "1995-03-15", "c": "  fixed ", "v": " any, \"text\" "}
READ = {"i": 7, "n": Decimal("12.34"), "m": Decimal("-0.50"), "d": datetime.date(1995, 3, 15), "c": "fixed ", "v": " any, \"text\" "}


def written(folder, specs):
    for name, spec in specs.items():
        kinds = [f.split(":")[1] for f in spec.split()]
        (folder / f"{name}.tbl").write_text("".join("|".join(VALUES[k] for k in kinds) + "|\n" for _ in range(3)))
    return {name: [f.split(":")[1] for f in spec.split()] for name, spec in specs.items()}


@pytest.mark.parametrize(("load", "specs"), [(load_tpch, TPCH), (load_ssb, SSB)])
def test_imports(spark, tmp_path, load, specs):
    kinds = written(tmp_path, specs)
    for cache in (None, f"{tmp_path}/cache", f"{tmp_path}/cache"):  # written, then read back
        tables = load(spark, str(tmp_path), cache)
        assert tables.keys() == specs.keys()
        for name, df in tables.items():
            assert df.columns == [f.split(":")[0] for f in specs[name].split()]
            assert [tuple(r) for r in df.collect()] == [tuple(READ[k] for k in kinds[name])] * 3


def test_tbl_values_that_do_not_parse(spark, tmp_path):
    for text, spec in (("x|", "a:i"), ("1.234|", "a:n"), ("1995-13-01|", "a:d")):
        (tmp_path / "bad.tbl").write_text(text + "\n")
        with pytest.raises(Exception, match=r"CAST_INVALID_INPUT|too many fraction digits"):
            read_tbl(spark, f"{tmp_path}/bad.tbl", spec).collect()
    (tmp_path / "empty.tbl").write_text("")
    assert read_tbl(spark, f"{tmp_path}/empty.tbl", "a:i").count() == 0


def test_cache_is_read_once_written(spark, tmp_path):
    first = cache_columnar(spark.range(5), f"{tmp_path}/x")
    again = cache_columnar(spark.range(9), f"{tmp_path}/x")
    assert first.count() == again.count() == 5


def test_expected_results(spark, tmp_path):
    (tmp_path / "golden.csv").write_text("1994,NAME A,443107189.00\n1992,B,-1.5\n")
    rows = read_golden(spark, f"{tmp_path}/golden.csv", "year:int name:c sum:m").collect()
    assert [tuple(r) for r in rows] == [(1994, "NAME A", Decimal("443107189.00")), (1992, "B", Decimal("-1.50"))]


def test_derived_keys_are_unique(spark):
    t = Tables(spark, SF)
    star = Star(t)
    for df, keys in ((partsupp(t), ["ps_partkey", "ps_suppkey"]), (star.ddate, ["d_datekey"]), (star.part, ["p_partkey"]), (star.supplier, ["s_suppkey"]), (star.customer, ["c_custkey"])):
        assert df.groupBy(*keys).count().where("count > 1").isEmpty()


def test_stored_star(spark, tmp_path):
    from tessera.plans import ssb

    star = Star(Tables(spark, "/root/testdata/sf0.001"))
    stored = star.materialise(str(tmp_path))
    for name in ("ssb_q11", "ssb_q31"):
        assert sorted(map(tuple, ssb.QUERIES[name](stored).collect())) == sorted(map(tuple, ssb.QUERIES[name](star).collect()))


def test_views(spark):
    Tables(spark, SF).views("v_")
    assert spark.sql("select count(*) as n from v_nation").first()["n"] == spark.table("v_nation").agg(F.count("*")).first()[0]
