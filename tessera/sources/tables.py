"""Tables: the driver's Parquet set, and dbgen-style ``.tbl`` files with a columnar cache."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import MONEY

# Schemas of the two data sets: name:kind, kinds i int, n decimal(12,2), m decimal(18,2),
# d date, c fixed-width text (leading spaces dropped on load), v variable-width text. Fixed values.
TPCH = {
    "part": "p_partkey:i p_name:v p_mfgr:c p_brand:c p_type:v p_size:i p_container:c p_retailprice:n p_comment:v",
    "supplier": "s_suppkey:i s_name:c s_address:v s_nationkey:i s_phone:c s_acctbal:n s_comment:v",
    "partsupp": "ps_partkey:i ps_suppkey:i ps_availqty:i ps_supplycost:n ps_comment:v",
    "customer": "c_custkey:i c_name:c c_address:v c_nationkey:i c_phone:c c_acctbal:n c_mktsegment:c c_comment:v",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:c o_totalprice:n o_orderdate:d o_orderpriority:c o_clerk:c o_shippriority:i o_comment:v",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:n l_extendedprice:n l_discount:n l_tax:n l_returnflag:c l_linestatus:c l_shipdate:d l_commitdate:d l_receiptdate:d l_shipinstruct:c l_shipmode:c l_comment:v",
    "nation": "n_nationkey:i n_name:c n_regionkey:i n_comment:v",
    "region": "r_regionkey:i r_name:c r_comment:v",
}
SSB = {
    "lineorder": "lo_orderkey:i lo_linenumber:i lo_custkey:i lo_partkey:i lo_suppkey:i lo_orderdate:i lo_orderpriority:c lo_shippriority:c lo_quantity:i lo_extendedprice:m lo_ordtotalprice:m lo_discount:m lo_revenue:m lo_supplycost:m lo_tax:i lo_commitdate:i lo_shopmode:c",
    "part": "p_partkey:i p_name:v p_mfgr:c p_category:c p_brand1:c p_color:v p_type:v p_size:i p_container:c",
    "supplier": "s_suppkey:i s_name:c s_address:v s_city:c s_nation:c s_region:c s_phone:c",
    "customer": "c_custkey:i c_name:v c_address:v c_city:c c_nation:c c_region:c c_phone:c c_mktsegment:c",
    "date": "d_datekey:i d_date:c d_dayofweek:c d_month:c d_year:i d_yearmonthnum:i d_yearmonth:c d_daynuminweek:i d_daynuminmonth:i d_daynuminyear:i d_monthnuminyear:i d_weeknuminyear:i d_sellingseasin:v d_lastdayinweekfl:i d_lastdayinmonthfl:i d_holidayfl:i d_weekdayfl:i",
}
KINDS = {"i": "int", "n": MONEY, "m": "decimal(18,2)", "d": "date", "c": "string", "v": "string"}

#: Columns stored as double that hold money or quantities of two decimals.
AS_MONEY = {
    "lineitem": ("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    "orders": ("o_totalprice",),
    "customer": ("c_acctbal",),
    "supplier": ("s_acctbal",),
    "part": ("p_retailprice",),
}


class Tables:
    """Parquet tables of one directory as attributes, money columns as decimals.

    ``raw(name)`` leaves the stored types, for predicates that Parquet should
    see: a filter on a cast column is not pushed down.
    """

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.money(self.raw(name), name)

    def filtered(self, name: str, *coarse: Column) -> DataFrame:
        """A table of which only rows are read for which the coarse predicates on stored types hold; Parquet skips row groups by them."""
        return self.money(self.raw(name).filter(reduce(lambda a, b: a & b, coarse)), name)

    @staticmethod
    def money(df: DataFrame, name: str) -> DataFrame:
        return df.withColumns({c: F.col(c).cast(MONEY) for c in AS_MONEY.get(name, ()) if c in df.columns})

    def views(self, prefix: str = "") -> None:
        for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
            self.raw(name).createOrReplaceTempView(f"{prefix}{name}")


def read_tbl(spark: SparkSession, path: str, spec: str) -> DataFrame:
    """A ``|``-separated file by position, no header or quoting; a trailing ``|`` is dropped.

    Values that do not parse raise (ANSI casts), and money with more than two
    fraction digits raises instead of rounding.
    """
    fields = [f.split(":") for f in spec.split()]
    text = T.StructType([T.StructField(n, T.StringType()) for n, _ in fields] + [T.StructField("_end", T.StringType())])
    df = spark.read.csv(path, sep="|", schema=text, quote="", escape="", enforceSchema=True, ignoreLeadingWhiteSpace=False, mode="PERMISSIVE")

    def value(name: str, kind: str):
        column = F.col(name)
        if kind == "c":
            return F.ltrim(F.coalesce(column, F.lit(""))).alias(name)
        if kind == "v":
            return F.coalesce(column, F.lit("")).alias(name)
        if kind in "nm":
            column = F.when(column.rlike(r"\.\d{3,}"), F.raise_error(F.concat(F.lit("too many fraction digits: "), column))).otherwise(column)
        return column.cast(KINDS[kind]).alias(name)

    return df.select(*(value(n, k) for n, k in fields))


def cache_columnar(df: DataFrame, path: str) -> DataFrame:
    """Write once as Parquet, read that afterwards."""
    spark = df.sparkSession
    try:
        return spark.read.parquet(path)
    except Exception as missing:  # only an absent path falls through to the write
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _load(spark: SparkSession, directory: str, specs: dict[str, str], cache: str | None) -> dict[str, DataFrame]:
    out = {}
    for name, spec in specs.items():
        df = read_tbl(spark, f"{directory}/{name}.tbl", spec)
        out[name] = cache_columnar(df, f"{cache}/{name}") if cache else df
    return out


def load_tpch(spark: SparkSession, directory: str, cache: str | None = None) -> dict[str, DataFrame]:
    return _load(spark, directory, TPCH, cache)


def load_ssb(spark: SparkSession, directory: str, cache: str | None = None) -> dict[str, DataFrame]:
    return _load(spark, directory, SSB, cache)


def read_golden(spark: SparkSession, path: str, spec: str) -> DataFrame:
    """Expected results as comma-separated values by position, without header or quoting; ``spec`` as for ``read_tbl``."""
    fields = [f.split(":") for f in spec.split()]
    schema = T.StructType([T.StructField(n, T.StringType()) for n, _ in fields])
    df = spark.read.csv(path, sep=",", schema=schema, quote="", escape="", enforceSchema=True)
    return df.select(*(F.col(n).cast(KINDS.get(k, k)).alias(n) for n, k in fields))
