"""One small query per operator and expression family, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import fixed_aggregation, hash_group, hash_join, index_lookup, ordered_fold, partition_by_key, product, project, result, scan, select, semi_join, tap
from tessera.plans.tpch import LI
from tessera.sources.tables import Tables

c = F.col
QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, run: Callable[[Tables], DataFrame], sql: str = "") -> None:
    QUERIES[f"op_{name}"] = run
    if sql:
        ORACLE[f"op_{name}"] = f"with {LI} {sql}" if " li" in sql else sql


def _filtered(name: str, predicate, where: str, table: str = "lineitem", keys: str = "l_orderkey, l_linenumber, l_quantity", coarse=None) -> None:
    """``coarse``: a wider predicate on the stored doubles, which Parquet sees; the exact one is on decimals."""
    columns = [k.strip() for k in keys.split(",")]
    source = "li" if table == "lineitem" else table
    rows = lambda t: t.filtered(table, coarse()) if coarse else getattr(t, table)
    _add(name, lambda t: select(rows(t), predicate()).select(*columns), f"select {keys} from {source} where {where}")


_add("scan_count", lambda t: fixed_aggregation(scan(t.spark, f"{t.directory}/lineitem.parquet"), n=F.count(F.lit(1))), "select count(*) as n from lineitem")
#: More than a stored double can be off, less than half a cent.
_OFF = 0.004
for _name, _op, _p, _coarse in (
    ("eq", "=", lambda: c("l_quantity") == 24, lambda: c("l_quantity").between(24 - _OFF, 24 + _OFF)),
    ("ge", ">=", lambda: c("l_quantity") >= 45, lambda: c("l_quantity") >= 45 - _OFF),
    ("gt", ">", lambda: c("l_quantity") > 45, lambda: c("l_quantity") > 45 - _OFF),
    ("le", "<=", lambda: c("l_quantity") <= 5, lambda: c("l_quantity") <= 5 + _OFF),
    ("lt", "<", lambda: c("l_quantity") < 5, lambda: c("l_quantity") < 5 + _OFF),
):
    _filtered(f"filter_{_name}", _p, f"l_quantity {_op} {24 if _name == 'eq' else 45 if _name[0] == 'g' else 5}", coarse=_coarse)
for _name, _op, _p in (
    ("col_col", "<", lambda: c("l_tax") < c("l_discount")),
    ("col_col_le", "<=", lambda: c("l_tax") <= c("l_discount")),
    ("col_col_gt", ">", lambda: c("l_tax") > c("l_discount")),
    ("col_col_ge", ">=", lambda: c("l_tax") >= c("l_discount")),
    ("col_col_eq", "=", lambda: c("l_tax") == c("l_discount")),
):
    _filtered(f"filter_{_name}", _p, f"l_tax {_op} l_discount")
_filtered("filter_col_col_and", lambda: (c("l_tax") < c("l_discount")) & (c("l_suppkey") <= c("l_partkey")), "l_tax < l_discount and l_suppkey <= l_partkey", coarse=lambda: c("l_suppkey") <= c("l_partkey"))
_filtered("filter_or2", lambda: (c("l_quantity") == 1) | (c("l_quantity") == 50), "l_quantity = 1 or l_quantity = 50", coarse=lambda: (c("l_quantity") <= 1 + _OFF) | (c("l_quantity") >= 50 - _OFF))
_filtered(
    "filter_conj", lambda: (c("l_quantity") < 10) & (c("l_discount") >= X.dec(F.lit("0.05"))) & (c("l_returnflag") == "R"), "l_quantity < 10 and l_discount >= 0.05 and l_returnflag = 'R'",
    coarse=lambda: (c("l_quantity") < 10 + _OFF) & (c("l_discount") >= 0.05 - _OFF) & (c("l_returnflag") == "R"),
)
_filtered("filter_string_range", lambda: c("p_name").between("c", "m"), "p_name between 'c' and 'm'", "part", "p_partkey, p_name")
_filtered("filter_contains", lambda: X.contains(c("p_name"), "blue"), "contains(p_name, 'blue')", "part", "p_partkey, p_name")
_filtered("filter_contains2", lambda: X.contains2(c("p_name"), "b", "r"), "p_name like '%b%r%'", "part", "p_partkey, p_name")
_filtered("filter_startswith", lambda: X.starts_with(c("p_name"), "b"), "starts_with(p_name, 'b')", "part", "p_partkey, p_name")
_filtered("filter_endswith", lambda: X.ends_with(c("p_name"), "t"), "ends_with(p_name, 't')", "part", "p_partkey, p_name")
_filtered("filter_date", lambda: c("o_orderdate") >= F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), "o_orderdate >= timestamp '2000-01-01'", "orders", "o_orderkey, o_orderdate")

def _projected(name: str, value, sql: str) -> None:
    _add(f"proj_{name}", lambda t: project(t.lineitem, l_orderkey=c("l_orderkey"), l_linenumber=c("l_linenumber"), x=value()), f"select l_orderkey, l_linenumber, {sql} as x from li")


_projected("plus", lambda: (c("l_quantity") + c("l_tax")).cast("decimal(14,2)"), "cast(l_quantity + l_tax as decimal(14,2))")
_projected("minus", lambda: (c("l_extendedprice") - c("l_quantity")).cast("decimal(14,2)"), "cast(l_extendedprice - l_quantity as decimal(14,2))")
_projected("mul", lambda: (c("l_extendedprice") * c("l_discount")).cast("decimal(24,4)"), "cast(l_extendedprice * l_discount as decimal(24,4))")
_projected("div", lambda: X.int_div(c("l_partkey") - 100, 7), "(l_partkey - 100) // 7")
_projected("mod", lambda: X.int_mod(c("l_partkey") - 100, 7), "(l_partkey - 100) % 7")
_projected("plus_const", lambda: (c("l_quantity") + F.lit("1.50").cast(X.MONEY)).cast("decimal(14,2)"), "cast(l_quantity + 1.50 as decimal(14,2))")
_projected("mul_const", lambda: (c("l_extendedprice") * F.lit(3).cast(X.MONEY)).cast("decimal(24,2)"), "cast(l_extendedprice * 3 as decimal(24,2))")
_projected("const_div", lambda: X.int_div(F.lit(1000000).cast("long"), c("l_partkey") + 1), "1000000 // (l_partkey + 1)")
_projected("const_mod", lambda: X.int_mod(F.lit(1000000).cast("long"), c("l_partkey") + 1), "1000000 % (l_partkey + 1)")
_projected("col_div", lambda: X.int_div(c("l_orderkey"), c("l_suppkey") + 1), "l_orderkey // (l_suppkey + 1)")
_projected("col_mod", lambda: X.int_mod(c("l_orderkey"), c("l_suppkey") + 1), "l_orderkey % (l_suppkey + 1)")
_projected("date_text", lambda: X.print_date(X.parse_date(X.print_date(c("l_shipdate")))), "strftime(cast(l_shipdate as date), '%Y-%m-%d')")
_projected("timestamp_text", lambda: X.print_timestamp(X.parse_timestamp(X.print_timestamp(c("l_shipdate")))), "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%g')")
_projected("val_minus_col", lambda: (F.lit(1).cast(X.MONEY) - c("l_discount")).cast("decimal(13,2)"), "cast(1 - l_discount as decimal(13,2))")
_projected("year", lambda: X.extract_year(c("l_shipdate")), "cast(year(l_shipdate) as int)")
_add("proj_prefix", lambda t: t.raw("part").groupBy(X.prefix(c("p_name"), 1).alias("head")).agg(F.count(F.lit(1)).alias("n")), "select substr(p_name, 1, 1) as head, count(*) as n from part group by 1")
_add("proj_length", lambda t: project(t.raw("part"), p_partkey=c("p_partkey"), x=F.length("p_name").cast("long")), "select p_partkey, length(p_name) as x from part")
_add("numeric_rescale", lambda t: project(t.customer, c_custkey=c("c_custkey"), up=X.rescale(c("c_acctbal"), 2), down=X.rescale(c("c_acctbal"), -2)), "select c_custkey, cast(cast(c_acctbal as decimal(12,2)) as decimal(18,4)) as up, cast(trunc(cast(c_acctbal as decimal(12,2))) as decimal(18,0)) as down from customer")
_add("numeric_scale", lambda t: project(t.customer, c_custkey=c("c_custkey"), x=X.trunc_scale(c("c_acctbal"), 1)), "select c_custkey, cast(trunc(cast(c_acctbal as decimal(12,2)) * 10) / 10 as decimal(18,1)) as x from customer")

_add("agg_sum", lambda t: fixed_aggregation(t.lineitem, x=X.total(c("l_extendedprice"), 2)), "select cast(sum(l_extendedprice) as decimal(38,2)) as x from li")
_add("agg_sum_empty", lambda t: fixed_aggregation(t.lineitem.filter(c("l_quantity") > 1000), x=X.total(c("l_tax"), 2)), "select cast(sum(l_tax) as decimal(38,2)) as x from li where l_quantity > 1000")
_add("agg_count", lambda t: fixed_aggregation(t.lineitem.filter(c("l_returnflag") == "N"), n=F.count(F.lit(1))), "select count(*) as n from lineitem where l_returnflag = 'N'")
_add("agg_product", lambda t: hash_group(t.raw("nation"), ["n_regionkey"], x=product(1 + c("n_nationkey") % 7).cast("long")), "select n_regionkey, cast(product(1 + n_nationkey % 7) as bigint) as x from nation group by 1")
#: Folds in the order of a unique key; these starts and values never leave a zero to divide by.
for _op, _expr, _table, _group, _key, _value, _start in (
    ("minus", "x - acc", "customer", "c_nationkey", "c_custkey", "c_custkey * 7919 % 1000", 1_000_003),
    ("divides", "x // acc", "customer", "c_nationkey", "c_custkey", "c_custkey * 1000 + 1", 1),
    ("modulus", "x % acc", "nation", "n_regionkey", "n_nationkey", "104729 + n_nationkey * 7919", 1_000_003),
):
    _add(
        f"fold_{_op}", lambda t, op=_op, table=_table, group=_group, key=_key, value=_value, start=_start: ordered_fold(t.raw(table).withColumn("v", F.expr(value)), [group], key, "v", op, start),
        f"select {_group}, list_reduce(list_prepend(cast({_start} as bigint), list(cast({_value} as bigint) order by {_key})), lambda acc, x: {_expr}) as acc from {_table} group by 1",
    )
_add("group_1key", lambda t: hash_group(t.lineitem, ["l_suppkey"], qty=X.total(c("l_quantity"), 2), n=F.count(F.lit(1))), "select l_suppkey, cast(sum(l_quantity) as decimal(38,2)) as qty, count(*) as n from li group by 1")
_add("group_2key", lambda t: hash_group(t.lineitem, ["l_returnflag", "l_linestatus"], qty=X.total(c("l_quantity"), 2)), "select l_returnflag, l_linestatus, cast(sum(l_quantity) as decimal(38,2)) as qty from li group by 1, 2")
_K5 = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
_add("group_5key", lambda t: hash_group(t.lineitem, _K5, qty=X.total(c("l_quantity"), 2)), f"select {', '.join(_K5)}, cast(sum(l_quantity) as decimal(38,2)) as qty from li group by all")
_add("group_having", lambda t: select(hash_group(t.raw("orders"), ["o_custkey"], n=F.count(F.lit(1))), c("n") > 12), "select o_custkey, count(*) as n from orders group by 1 having count(*) > 12")
_add("group_filtered", lambda t: hash_group(select(t.lineitem, c("l_quantity") < 20), ["l_partkey"], qty=X.total(c("l_quantity"), 2)), "select l_partkey, cast(sum(l_quantity) as decimal(38,2)) as qty from li where l_quantity < 20 group by 1")

_add(
    "join_inner", lambda t: hash_join(t.raw("supplier"), t.raw("lineitem").select("l_orderkey", "l_suppkey"), [("s_suppkey", "l_suppkey")], ["s_name"]),
    "select l_orderkey, l_suppkey, s_name from lineitem join supplier on l_suppkey = s_suppkey",
)


def _two_keys(t: Tables) -> DataFrame:
    pairs = t.raw("lineitem").select(c("l_partkey").alias("pk"), c("l_suppkey").alias("sk")).distinct()
    return hash_join(pairs, t.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), [("pk", "l_partkey"), ("sk", "l_suppkey")])


_add("join_2key", _two_keys, "select l_orderkey, l_partkey, l_suppkey from lineitem join (select distinct l_partkey as pk, l_suppkey as sk from lineitem) on pk = l_partkey and sk = l_suppkey")


def _many(t: Tables) -> DataFrame:
    left = t.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    right = left.select(c("l_orderkey").alias("ok"), c("l_partkey").alias("pk"), c("l_linenumber").alias("other_line"))
    return hash_join(right, left, [("ok", "l_orderkey"), ("pk", "l_partkey")], ["other_line"])


_add("join_nm", _many, "select a.l_orderkey, a.l_partkey, a.l_linenumber, b.l_linenumber as other_line from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey")
_add("join_build_sel", lambda t: hash_join(select(t.raw("supplier"), c("s_nationkey") == 3), t.raw("lineitem").select("l_orderkey", "l_suppkey"), [("s_suppkey", "l_suppkey")], ["s_name"]), "select l_orderkey, l_suppkey, s_name from lineitem join supplier on l_suppkey = s_suppkey where s_nationkey = 3")
_add("join_probe_sel", lambda t: hash_join(t.raw("orders"), select(t.raw("lineitem"), c("l_quantity") < 3.0).select("l_orderkey", "l_linenumber"), [("o_orderkey", "l_orderkey")], ["o_custkey"]), "select l_orderkey, l_linenumber, o_custkey from lineitem join orders on l_orderkey = o_orderkey where l_quantity < 3")
_add("join_semi", lambda t: semi_join(select(t.raw("customer"), c("c_mktsegment") == "BUILDING"), t.raw("orders").select("o_orderkey", "o_custkey"), [("c_custkey", "o_custkey")]), "select o_orderkey, o_custkey from orders semi join (select * from customer where c_mktsegment = 'BUILDING') on c_custkey = o_custkey")


def _bushy(t: Tables) -> DataFrame:
    placed = hash_join(t.raw("nation"), t.raw("supplier"), [("n_nationkey", "s_nationkey")], ["n_name"])
    bought = hash_join(t.raw("orders"), t.lineitem, [("o_orderkey", "l_orderkey")], ["o_custkey"])
    return hash_group(hash_join(placed, bought, [("s_suppkey", "l_suppkey")], ["n_name"]), ["n_name"], qty=X.total(c("l_quantity"), 2), n=F.count(F.lit(1)))


_add("join_bushy", _bushy, "select n_name, cast(sum(l_quantity) as decimal(38,2)) as qty, count(*) as n from li join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1")


def _index(t: Tables) -> DataFrame:
    wanted = t.raw("customer").select(c("c_custkey").alias("k"))
    return index_lookup(t.raw("orders"), "o_custkey", "o_orderkey", wanted, "k").select("k", F.size("hits").cast("long").alias("n"), F.get("hits", F.lit(0)).alias("first"))


_add("index_lookup", _index, 'select c_custkey as k, count(o_orderkey) as n, min(o_orderkey) as "first" from customer left join orders on c_custkey = o_custkey group by 1')


def _partitions(t: Tables) -> DataFrame:
    """Rows and keys kept by a partitioning, and keys that stand in more than one partition."""
    placed = partition_by_key(t.raw("orders").select("o_custkey"), 8, "o_custkey").withColumn("part", F.spark_partition_id())
    keys = placed.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("parts"))
    return keys.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count(F.when(c("parts") > 1, 1)).alias("split_keys"))


_add("hash_partition", _partitions, "select count(*) as n_rows, count(distinct o_custkey) as n_keys, 0 as split_keys from orders")
_add(
    "hash_key", lambda t: t.raw("orders").agg(F.countDistinct(X.hash_key(c("o_custkey"), c("o_orderkey"))).alias("hashes"), F.countDistinct(X.checksum(c("o_orderstatus"))).alias("checksums"), F.countDistinct(X.murmur(c("o_orderstatus"))).alias("murmurs")),
    "select count(distinct (o_custkey, o_orderkey)) as hashes, count(distinct o_orderstatus) as checksums, count(distinct o_orderstatus) as murmurs from orders",
)
_add("result", lambda t: result(t.raw("region"), {"key": "r_regionkey", "name": "r_name"}), "select r_regionkey as key, r_name as name from region")
_add("tap", lambda t: tap(t.raw("nation"), "seen")[0], "select * from nation")
