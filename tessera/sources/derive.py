"""Tables that the stored set lacks: partsupp and the star schema, derived declaratively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import MONEY, int_div
from tessera.sources.tables import Tables

MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def date_key(ts: str) -> Column:
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def partsupp(t: Tables) -> DataFrame:
    cost = (1 + (F.col("ps_partkey") * 17 + F.col("ps_suppkey") * 31) % 1000).cast(MONEY)
    pairs = t.raw("lineitem").select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()
    return pairs.withColumn("ps_supplycost", cost)


class Star:
    """The star schema over ``Tables``. Lazy: each query reads and computes only what it uses.

    ``materialise`` writes it once, bucketing left to the caller's table format.
    """

    def __init__(self, t: Tables, stored: str | None = None):
        self.t, self.stored = t, stored

    def _or(self, name: str, make) -> DataFrame:
        return self.t.spark.read.parquet(f"{self.stored}/{name}") if self.stored else make()

    def materialise(self, path: str) -> Star:
        for name in ("lineorder", "ddate", "part", "supplier", "customer"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        return Star(self.t, path)

    @property
    def lineorder(self) -> DataFrame:
        return self._or("lineorder", self._lineorder)

    def some_lineorder(self, coarse: Column, dates: Column) -> DataFrame:
        """Line orders for which predicates on the stored lineitem and on o_orderdate hold: both are filtered before they join. A stored star has its own columns to filter."""
        return self._or("lineorder", lambda: self._lineorder(coarse, dates))

    def _lineorder(self, coarse: Column | None = None, dates: Column | None = None) -> DataFrame:
        li = self.t.lineitem if coarse is None else self.t.filtered("lineitem", coarse)
        o = self.t.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        o = o if dates is None else o.filter(dates)
        price, disc = F.col("l_extendedprice"), F.col("l_discount")
        wide = lambda c: c.cast("decimal(18,2)")
        return li.join(o, li.l_orderkey == o.o_orderkey).select(
            date_key("o_orderdate").alias("lo_orderdate"), F.col("o_custkey").alias("lo_custkey"), F.col("l_partkey").alias("lo_partkey"), F.col("l_suppkey").alias("lo_suppkey"),
            F.col("l_quantity").cast("int").alias("lo_quantity"), wide(price).alias("lo_extendedprice"), wide(disc * 100).alias("lo_discount"),
            wide(price * (1 - disc)).alias("lo_revenue"), wide(price * F.lit("0.6").cast(MONEY)).alias("lo_supplycost"),
        )

    @property
    def ddate(self) -> DataFrame:
        return self._or("ddate", self._ddate)

    def _ddate(self) -> DataFrame:
        d = "o_orderdate"
        return self.t.raw("orders").select(d).distinct().select(
            date_key(d).alias("d_datekey"), F.year(d).cast("int").alias("d_year"), (F.year(d) * 100 + F.month(d)).cast("int").alias("d_yearmonthnum"),
            F.concat(F.substring(F.lit(MONTHS), 3 * F.month(d) - 2, F.lit(3)), F.year(d).cast("string")).alias("d_yearmonth"),
            (int_div(F.dayofyear(d) - 1, 7) + 1).cast("int").alias("d_weeknuminyear"),
        ).distinct()

    @property
    def part(self) -> DataFrame:
        return self._or("part", self._part)

    def _part(self) -> DataFrame:
        k = F.col("p_partkey")
        mfgr = F.concat(F.lit("MFGR#"), (1 + k % 5).cast("string"))
        category = F.concat(mfgr, (1 + int_div(k, 5) % 5).cast("string"))
        brand = F.concat(category, (1 + int_div(k, 25) % 40).cast("string"))
        return self.t.raw("part").select(k, mfgr.alias("p_mfgr"), category.alias("p_category"), brand.alias("p_brand1"))

    def _placed(self, table: str, x: str, key: str) -> DataFrame:
        base, n, r = self.t.raw(table), self.t.raw("nation"), self.t.raw("region")
        joined = base.join(n, base[f"{x}_nationkey"] == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return joined.select(
            base[key], F.concat(n.n_name, F.lit("#"), (base[key] % 3).cast("string")).alias(f"{x}_city"), n.n_name.alias(f"{x}_nation"), r.r_name.alias(f"{x}_region")
        )

    @property
    def supplier(self) -> DataFrame:
        return self._or("supplier", lambda: self._placed("supplier", "s", "s_suppkey"))

    @property
    def customer(self) -> DataFrame:
        return self._or("customer", lambda: self._placed("customer", "c", "c_custkey"))
