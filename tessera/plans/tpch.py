"""The order/line-item queries. Parameters default to the constants that suit the stored data."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import charge, dec, disc_price, extract_year, total
from tessera.sources.derive import partsupp
from tessera.sources.tables import Tables

LI = "li as (select * replace (cast(l_quantity as decimal(12,2)) as l_quantity, cast(l_extendedprice as decimal(12,2)) as l_extendedprice, cast(l_discount as decimal(12,2)) as l_discount, cast(l_tax as decimal(12,2)) as l_tax) from lineitem)"


@dataclass(frozen=True)
class Params:
    q1_shipdate: date = date(1998, 9, 2)
    q3_segment: str = "BUILDING"
    q3_date: date = date(1995, 3, 15)
    q5_region: str = "ASIA"
    q5_year: int = 1997
    q6_year: int = 1997
    q6_discount: tuple[float, float] = (0.05, 0.07)
    q6_quantity: int = 24
    q9_colour: str = "blue"
    q18_quantity: int = 300


def _day(d: date) -> Column:
    return F.lit(f"{d} 00:00:00").cast("timestamp_ntz")


def _year(column: str, year: int) -> Column:
    return (F.col(column) >= _day(date(year, 1, 1))) & (F.col(column) < _day(date(year + 1, 1, 1)))


def _q1(t: Tables, p: Params, copies: int = 1, averages: bool = False) -> DataFrame:
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    aggs = []
    for k in range(copies):
        end = f"_{k}" if k else ""
        aggs += [
            total(F.col("l_quantity"), 2).alias(f"sum_qty{end}"), total(price, 2).alias(f"sum_base_price{end}"), total(disc_price(price, disc), 4).alias(f"sum_disc_price{end}"),
            total(charge(price, disc, tax), 6).alias(f"sum_charge{end}"), F.count(F.lit(1)).alias(f"count_order{end}"),
        ]
    if averages:
        mean = lambda c: F.sum(c).cast("double") / F.count(c)
        aggs += [mean(F.col("l_quantity")).alias("avg_qty"), mean(price).alias("avg_price"), mean(disc).alias("avg_disc")]
    return t.lineitem.filter(F.col("l_shipdate") <= _day(p.q1_shipdate)).groupBy("l_returnflag", "l_linestatus").agg(*aggs)


def q1(t: Tables, p: Params = Params()) -> DataFrame:
    return _q1(t, p)


def q1_full(t: Tables, p: Params = Params()) -> DataFrame:
    return _q1(t, p, averages=True)


def q1_stress(t: Tables, p: Params = Params()) -> DataFrame:
    """Q1 with three more copies of its aggregates; the optimizer computes each once."""
    return _q1(t, p, copies=4)


def q3(t: Tables, p: Params = Params()) -> DataFrame:
    buyers = t.raw("customer").filter(F.col("c_mktsegment") == p.q3_segment)
    o = t.raw("orders").filter(F.col("o_orderdate") < _day(p.q3_date))
    o = o.join(buyers, o.o_custkey == buyers.c_custkey, "left_semi").select("o_orderkey", "o_orderdate")
    li = t.lineitem.filter(F.col("l_shipdate") > _day(p.q3_date))
    out = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_orderkey", "o_orderdate")
    return out.agg(total(disc_price(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("revenue")).withColumn("o_shippriority", F.lit(0))


def _q5_joined(t: Tables, p: Params, selective: bool) -> DataFrame:
    n, s, c, o, li = t.raw("nation"), t.raw("supplier"), t.raw("customer"), t.raw("orders"), t.lineitem
    if selective:
        region = t.raw("region").filter(F.col("r_name") == p.q5_region)
        n = n.join(region, n.n_regionkey == region.r_regionkey, "left_semi")
        o = o.filter(_year("o_orderdate", p.q5_year))
        # Customers and suppliers share a nation, so those of other regions need not reach the orders.
        c = c.join(n, c.c_nationkey == n.n_nationkey, "left_semi")
    sn = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "s_nationkey", "n_name")
    co = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey")
    return li.join(co, li.l_orderkey == co.o_orderkey).join(sn, (F.col("l_suppkey") == sn.s_suppkey) & (F.col("c_nationkey") == sn.s_nationkey))


def q5(t: Tables, p: Params = Params()) -> DataFrame:
    return _q5_joined(t, p, True).groupBy("n_name").agg(total(disc_price(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("revenue"))


def q5_no_sel_global(t: Tables, p: Params = Params()) -> DataFrame:
    return _q5_joined(t, p, False).agg(total(F.col("l_extendedprice") * F.col("l_discount"), 4).alias("revenue"), F.count(F.lit(1)).alias("count"))


def q5_no_sel_by_nation(t: Tables, p: Params = Params()) -> DataFrame:
    return _q5_joined(t, p, False).groupBy("n_name").agg(total(disc_price(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("revenue"))


def q6(t: Tables, p: Params = Params()) -> DataFrame:
    low, high = p.q6_discount
    # The stored doubles are filtered too, a little wider, so that Parquet can skip row groups.
    coarse = F.col("l_discount").between(low - 0.004, high + 0.004) & (F.col("l_quantity") < float(p.q6_quantity)) & _year("l_shipdate", p.q6_year)
    li = Tables.money(t.raw("lineitem").filter(coarse), "lineitem")
    li = li.filter(F.col("l_discount").between(dec(F.lit(str(low))), dec(F.lit(str(high)))))
    return li.agg(total(F.col("l_extendedprice") * F.col("l_discount"), 4).alias("revenue"))


def q9(t: Tables, p: Params = Params()) -> DataFrame:
    parts = t.raw("part").filter(F.col("p_name").contains(p.q9_colour)).select("p_partkey")
    n, s, o, ps, li = t.raw("nation"), t.raw("supplier"), t.raw("orders"), partsupp(t), t.lineitem
    sn = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_name").alias("nation"))
    # Parts are unique on their key, so membership is enough, and it cuts both sides before they shuffle.
    li = li.join(parts, li.l_partkey == parts.p_partkey, "left_semi")
    ps = ps.join(parts, ps.ps_partkey == parts.p_partkey, "left_semi")
    lps = li.join(ps, (li.l_partkey == ps.ps_partkey) & (li.l_suppkey == ps.ps_suppkey))
    rows = lps.join(sn, F.col("l_suppkey") == sn.s_suppkey).join(o, F.col("l_orderkey") == o.o_orderkey)
    profit = disc_price(F.col("l_extendedprice"), F.col("l_discount")) - F.col("ps_supplycost") * F.col("l_quantity")
    return rows.groupBy("nation", extract_year(F.col("o_orderdate")).alias("o_year")).agg(total(profit, 4).alias("sum_profit"))


def q18_group(t: Tables, p: Params = Params()) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(total(F.col("l_quantity"), 2).alias("sum")).filter(F.col("sum") > p.q18_quantity)


def q18(t: Tables, p: Params = Params()) -> DataFrame:
    """The sum of an order's lines is the HAVING group's own sum, so lineitem is read and shuffled once."""
    big, o, c = q18_group(t, p), t.orders, t.raw("customer")
    rows = o.join(big, o.o_orderkey == big.l_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
    return rows.groupBy("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice").agg(total(F.col("sum"), 2).alias("sum"))


_Q1_AGGS = "cast(sum(l_quantity) as decimal(38,2)) as sum_qty{0}, cast(sum(l_extendedprice) as decimal(38,2)) as sum_base_price{0}, cast(sum(l_extendedprice*(1-l_discount)) as decimal(38,4)) as sum_disc_price{0}, cast(sum(l_extendedprice*(1-l_discount)*(1+l_tax)) as decimal(38,6)) as sum_charge{0}, count(*) as count_order{0}"
_Q1 = f"with {LI} select l_returnflag, l_linestatus, {{}} from li where l_shipdate <= timestamp '1998-09-02' group by all"
_AVG = "cast(sum({0}) as double)/count({0}) as {1}"
_Q5_JOIN = "li join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey join supplier on l_suppkey=s_suppkey and c_nationkey=s_nationkey join nation on s_nationkey=n_nationkey"
_REV = "cast(sum(l_extendedprice*(1-l_discount)) as decimal(38,4)) as revenue"

ORACLE = {
    "tpch_q1": _Q1.format(_Q1_AGGS.format("")),
    "tpch_q1_full": _Q1.format(_Q1_AGGS.format("") + ", " + ", ".join(_AVG.format(*x) for x in (("l_quantity", "avg_qty"), ("l_extendedprice", "avg_price"), ("l_discount", "avg_disc")))),
    "tpch_q1_stress": _Q1.format(", ".join(_Q1_AGGS.format(x) for x in ("", "_1", "_2", "_3"))),
    "tpch_q3": f"with {LI} select l_orderkey, o_orderdate, {_REV}, 0 as o_shippriority from li join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey where c_mktsegment='BUILDING' and o_orderdate < timestamp '1995-03-15' and l_shipdate > timestamp '1995-03-15' group by l_orderkey, o_orderdate",
    "tpch_q5": f"with {LI} select n_name, {_REV} from {_Q5_JOIN} join region on n_regionkey=r_regionkey where r_name='ASIA' and o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01' group by n_name",
    "tpch_q5_no_sel_global": f'with {LI} select cast(sum(l_extendedprice*l_discount) as decimal(38,4)) as revenue, count(*) as "count" from {_Q5_JOIN}',
    "tpch_q5_no_sel_by_nation": f"with {LI} select n_name, {_REV} from {_Q5_JOIN} group by n_name",
    "tpch_q6": f"with {LI} select cast(sum(l_extendedprice*l_discount) as decimal(38,4)) as revenue from li where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24",
    "tpch_q9": f"with {LI}, partsupp as (select l_partkey as ps_partkey, l_suppkey as ps_suppkey, cast(1+(l_partkey*17+l_suppkey*31)%1000 as decimal(12,2)) as ps_supplycost from lineitem group by l_partkey, l_suppkey) select n_name as nation, cast(year(o_orderdate) as int) as o_year, cast(sum(l_extendedprice*(1-l_discount)-ps_supplycost*l_quantity) as decimal(38,4)) as sum_profit from li join part on l_partkey=p_partkey join partsupp on l_partkey=ps_partkey and l_suppkey=ps_suppkey join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey join orders on l_orderkey=o_orderkey where contains(p_name,'blue') group by 1, 2",
    "tpch_q18": f'with {LI} select c_name, c_custkey, o_orderkey, o_orderdate, cast(o_totalprice as decimal(12,2)) as o_totalprice, cast(sum(l_quantity) as decimal(38,2)) as "sum" from li join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey where o_orderkey in (select l_orderkey from li group by l_orderkey having sum(l_quantity) > 300) group by all',
    "tpch_q18_group": f'with {LI} select l_orderkey, cast(sum(l_quantity) as decimal(38,2)) as "sum" from li group by l_orderkey having sum(l_quantity) > 300',
}
QUERIES = {f"tpch_{f.__name__}": f for f in (q1, q1_full, q1_stress, q3, q5, q5_no_sel_global, q5_no_sel_by_nation, q6, q9, q18, q18_group)}
