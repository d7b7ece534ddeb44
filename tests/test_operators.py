"""Operators on small literal tables, with their expected rows."""

import zlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.harness import selectivity_sweep, timed
from tessera.operators import fixed_aggregation, hash_group, hash_join, index_lookup, partition_by_key, plan_text, select, tap
from tessera.plans import ops, ssb, tpch
from tessera.sources import Star, Tables
from tessera.streaming import stream_group
from tests.oracle import compare, tables

SF = "/root/testdata/sf0.01"


def table(spark, columns, *values):
    return spark.createDataFrame(list(zip(*values)), columns)


def test_joins(spark):
    build = table(spark, "k int, v int", [1, 3, 4, 8], [101, 103, 104, 108])
    probe = table(spark, "b int", [88, 1, 1, 17, 4] + [1, 2, 3, 4] * 5)
    out = hash_join(build, probe, [("k", "b")], ["v"])
    assert sorted(r["v"] for r in out.collect()) == sorted([101, 101, 104] + [101, 103, 104] * 5)
    repeated = table(spark, "k int, v int", [1, 1, 1, 1, 1, 3, 4, 8], [101] * 5 + [103, 104, 108])
    out = hash_join(repeated, table(spark, "b int", [88, 1, 26, 4, 9]), [("k", "b")], ["v"])
    assert sorted((r["b"], r["v"]) for r in out.collect()) == [(1, 101)] * 5 + [(4, 104)]
    wide = table(spark, "k int, v bigint", [1, 3, 4, 8, 22, 33, 44, 55, 34], [101, 103, 104, 108, 122, 133, 144, 155, 134])
    out = hash_join(select(wide, F.col("v") > 103), table(spark, "b int", [88, 1, 1, 17, 4, 3, 44, 44]), [("k", "b")], ["v"])
    assert sorted(r["v"] for r in out.collect()) == [104, 144, 144]
    out = hash_join(build, select(table(spark, "b int", [88, 8, 1, 1, 17, 4] + [3] * 12), F.col("b") < 4), [("k", "b")])
    assert sorted(r["b"] for r in out.collect()) == [1, 1] + [3] * 12
    out = hash_join(repeated, select(table(spark, "b int", [88, 8, 16, 1, 17, 4]), F.col("b") < 4), [("k", "b")])
    assert [r["b"] for r in out.collect()] == [1] * 5


def test_groups(spark):
    want = [(1, 1, 21), (1, 2, 10), (3, 9, 3), (4, 17, 17), (8, 4, 4)]
    t = table(spark, "k1 bigint, k2 int, v bigint", [1, 1, 1, 1, 1, 3, 4, 8], [1, 2, 1, 1, 2, 9, 17, 4], [4, 8, 16, 1, 2, 3, 17, 4])
    assert sorted(map(tuple, hash_group(t, ["k1", "k2"], s=F.sum("v")).collect())) == want
    t = table(spark, "k1 bigint, k2 int, v bigint", [1, 44, 1, 1, 44, 1, 44, 44, 44, 1, 3, 4, 8], [1, 33, 2, 1, 22, 1, 99, 11, 11, 2, 9, 17, 4], [4, 99, 8, 16, 88, 1, 33, 33, 22, 2, 3, 17, 4])
    assert sorted(map(tuple, hash_group(select(t, F.col("v") < 20), ["k1", "k2"], s=F.sum("v")).collect())) == want


def test_dates_partitions_and_lookups(spark):
    days = table(spark, "i int, d string", range(5), ["2017-01-01", "2017-01-04", "2017-01-02", "2017-01-03", " 2017-1-4 "])
    assert [r["i"] for r in select(days, X.parse_date(F.col("d")) >= F.lit("2017-01-03").cast("date")).orderBy("i").collect()] == [1, 3, 4]
    keys = [1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 6, 9]
    placed = partition_by_key(table(spark, "k int", keys), 4, "k").withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("p").alias("parts"))
    assert sorted(tuple(r) for r in placed.collect()) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1), (5, 2, 1), (6, 1, 1), (9, 1, 1)]
    index = table(spark, "k bigint, v bigint", range(1000), range(1000))
    hits = index_lookup(index, "k", "v", spark.range(2000).withColumnRenamed("id", "q"), "q")
    assert all(r["hits"] == ([r["q"]] if r["q"] < 1000 else []) for r in hits.collect()) and hits.count() == 2000


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_lookup_of_customers_without_orders(spark, tmp_path, threshold):
    table(spark, "c_custkey long", range(40)).write.parquet(f"{tmp_path}/customer.parquet")
    table(spark, "o_orderkey long, o_custkey long", [5, 3, 4, 7, None], [1, 1, 2, None, 3]).write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert compare(ops.QUERIES["op_index_lookup"](Tables(spark, str(tmp_path))), tables(str(tmp_path)), ops.ORACLE["op_index_lookup"]) == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_relation_written_and_read(spark, tmp_path):
    t = table(spark, "a bigint, b int", [7 * i for i in range(80)], range(80))
    t.write.parquet(f"{tmp_path}/t")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").collect())) == [(7 * i, i) for i in range(80)]


def test_text_of_dates_and_hashes(spark):
    one = spark.createDataFrame([("1995-3-7", "1995-12-31 23:59:58.5", "héllo"), (None, None, None)], "d string, t string, s string")
    got = one.select(X.parse_date(F.col("d")), X.parse_timestamp(F.col("t")), X.print_date(X.parse_date(F.col("d"))), X.checksum(F.col("s")), X.murmur(F.col("s")).isNotNull()).collect()
    assert tuple(got[0]) == (date(1995, 3, 7), datetime(1995, 12, 31, 23, 59, 58, 5000), "1995-03-07", zlib.crc32("héllo".encode()), True)
    assert tuple(got[1])[:4] == (None, None, None, None)
    for bad, parse in (("1995-13-01", X.parse_date), ("1995/01/01", X.parse_date), ("1995-01-01", X.parse_timestamp), ("1995-01-01 24:00:00", X.parse_timestamp)):
        with pytest.raises(Exception, match=r"(?i)invalid|range"):
            spark.createDataFrame([(bad,)], "x string").select(parse(F.col("x"))).collect()


def test_tap_counts(spark):
    df, seen = tap(spark.range(100).filter("id < 30"), "taps", total=F.sum("id"))
    assert df.count() == 30 and seen.get == {"rows": 30, "total": sum(range(30))}


def test_stream_group(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2020, 1, 1, 0, m), k, 1) for m in range(10) for k in "ab"], "ts timestamp_ntz, k string, n int").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = stream_group(stream, "ts", ["k"], "5 minutes", "1 minute", n=F.sum("n")).writeStream.format("memory").queryName("grouped").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(60)
    assert sorted((r["k"], r["n"]) for r in spark.table("grouped").collect()) == [("a", 5), ("a", 5), ("b", 5), ("b", 5)]


def test_harness(spark):
    took = timed(lambda: spark.range(1000), 1, 1, 1000)
    assert took["sec"] > 0 and took["ns_per_tuple"] > 0
    assert [x["percent"] for x in selectivity_sweep(spark, 1000, 2, 1)] == [0, 50, 100]
    assert "WholeStageCodegen" in plan_text(fixed_aggregation(spark.range(9).filter("id > 2"), n=F.count("*")), "codegen") and "Range" in plan_text(spark.range(3))


def pushed(df):
    return " ".join(x for x in plan_text(df).split("\n") if "PushedFilters" in x)


def test_filters_reach_the_files(spark):
    t = Tables(spark, SF)
    for name in ("filter_eq", "filter_ge", "filter_gt", "filter_le", "filter_lt", "filter_or2"):
        assert any(f"{x}(l_quantity" in pushed(ops.QUERIES[f"op_{name}"](t)) for x in ("EqualTo", "GreaterThan", "LessThan", "GreaterThanOrEqual", "LessThanOrEqual"))
    for name in ("ssb_q11", "ssb_q12", "ssb_q13"):
        text = pushed(ssb.QUERIES[name](Star(t)))
        assert "GreaterThanOrEqual(l_discount" in text and "LessThan(l_quantity" in text and "LessThan(o_orderdate" in text
    assert "LessThan(l_quantity" in pushed(tpch.q6(t)) and "GreaterThanOrEqual(o_orderdate" in pushed(tpch.q5(t))
