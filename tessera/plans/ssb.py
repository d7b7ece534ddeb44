"""The thirteen star-schema queries as rows of one table: filters, keys, measure."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import total
from tessera.sources.derive import MONTHS, Star

DIMS = {"ddate": ("lo_orderdate", "d_datekey"), "part": ("lo_partkey", "p_partkey"), "supplier": ("lo_suppkey", "s_suppkey"), "customer": ("lo_custkey", "c_custkey")}
NAMES = {"ddate": "ddate", "part": "spart", "supplier": "ssupp", "customer": "scust"}


@dataclass(frozen=True)
class StarQuery:
    """dims: dimension -> SQL predicate ('' = none); keys: grouping columns; fact: predicate on the fact table."""

    measure: str
    name: str
    scale: int
    dims: dict[str, str]
    keys: tuple[str, ...] = ()
    fact: str = ""
    order: tuple[str, ...] = field(default=("part", "supplier", "customer", "ddate"))
    #: Wider predicates on the stored lineitem and on o_orderdate, for what Parquet can skip.
    coarse: tuple[str, str] = ()

    def run(self, star: Star) -> DataFrame:
        """Dimensions without output columns are semi-joins; the rest join on their unique keys."""
        rows = star.some_lineorder(*map(F.expr, self.coarse)) if self.coarse else star.lineorder
        if self.fact:
            rows = rows.filter(self.fact)
        for dim in self.order:
            if dim not in self.dims:
                continue
            fk, pk = DIMS[dim]
            side = getattr(star, dim)
            if self.dims[dim]:
                side = side.filter(self.dims[dim])
            outputs = [k for k in self.keys if k in side.columns]
            side = side.select(pk, *outputs)
            rows = rows.join(side, F.col(fk) == side[pk], "inner" if outputs else "left_semi")
        amount = total(F.expr(self.measure), self.scale).alias(self.name)
        return rows.groupBy(*self.keys).agg(amount) if self.keys else rows.agg(amount)

    def sql(self) -> str:
        joins = " ".join(f"join {NAMES[d]} on {DIMS[d][0]} = {DIMS[d][1]}" for d in self.dims)
        where = " and ".join(f"({p})" for p in [self.fact, *self.dims.values()] if p)
        keys = ", ".join(self.keys)
        return f"{_CTE} select {keys + ', ' if keys else ''}cast(sum({self.measure}) as decimal(38,{self.scale})) as {self.name} from lineorder {joins} where {where}" + (f" group by {keys}" if keys else "")


_DK = "cast(year(o_orderdate)*10000+month(o_orderdate)*100+day(o_orderdate) as int)"
_CTE = f"""with li as (select *, cast(l_extendedprice as decimal(12,2)) as ep, cast(l_discount as decimal(12,2)) as di from lineitem),
ddate as (select distinct {_DK} as d_datekey, cast(year(o_orderdate) as int) as d_year, cast(year(o_orderdate)*100+month(o_orderdate) as int) as d_yearmonthnum,
  concat(substr('{MONTHS}', cast(3*month(o_orderdate)-2 as int), 3), cast(year(o_orderdate) as varchar)) as d_yearmonth, cast(floor((dayofyear(o_orderdate)-1)/7) as int)+1 as d_weeknuminyear from orders),
spart as (select p_partkey, concat('MFGR#', 1+p_partkey%5) as p_mfgr, concat('MFGR#', 1+p_partkey%5, 1+(p_partkey//5)%5) as p_category, concat('MFGR#', 1+p_partkey%5, 1+(p_partkey//5)%5, 1+(p_partkey//25)%40) as p_brand1 from part),
ssupp as (select s_suppkey, n_name as s_nation, r_name as s_region, concat(n_name, '#', s_suppkey%3) as s_city from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey),
scust as (select c_custkey, n_name as c_nation, r_name as c_region, concat(n_name, '#', c_custkey%3) as c_city from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey),
lineorder as (select {_DK} as lo_orderdate, o_custkey as lo_custkey, l_partkey as lo_partkey, l_suppkey as lo_suppkey, cast(l_quantity as int) as lo_quantity, cast(ep as decimal(18,2)) as lo_extendedprice,
  cast(di*100 as decimal(18,2)) as lo_discount, cast(ep*(1-di) as decimal(18,2)) as lo_revenue, cast(ep*cast(0.6 as decimal(12,2)) as decimal(18,2)) as lo_supplycost from li join orders on l_orderkey=o_orderkey)"""

_YEARS = "d_year >= 1996 and d_year <= 2000"
_CITIES = "{0}_city in ('NATION_3#0', 'NATION_3#1')"


def _revenue1(dims: str, discount: tuple[int, int], quantity: tuple[int, int], days: tuple[str, str]) -> StarQuery:
    """Bounds of the discount in hundredths and of the quantity, both included; days: first, and first one behind."""
    fact = f"lo_discount between {discount[0]} and {discount[1]} and lo_quantity between {quantity[0]} and {quantity[1]}"
    stored = f"l_discount between {discount[0] / 100 - 0.004}D and {discount[1] / 100 + 0.004}D and l_quantity >= {quantity[0]}D and l_quantity < {quantity[1] + 1}D"
    dates = f"o_orderdate >= timestamp_ntz '{days[0]}' and o_orderdate < timestamp_ntz '{days[1]}'"
    return StarQuery("lo_extendedprice*lo_discount", "revenue", 4, {"ddate": dims}, fact=fact, coarse=(stored, dates))


def _revenue2(part: str, region: str) -> StarQuery:
    return StarQuery("lo_revenue", "revenue", 2, {"part": part, "supplier": f"s_region = '{region}'", "ddate": ""}, ("d_year", "p_brand1"))


def _revenue3(customer: str, supplier: str, dates: str, level: str) -> StarQuery:
    return StarQuery("lo_revenue", "revenue", 2, {"supplier": supplier, "customer": customer, "ddate": dates}, ("d_year", f"c_{level}", f"s_{level}"))


def _profit(dims: dict[str, str], keys: tuple[str, ...]) -> StarQuery:
    return StarQuery("lo_revenue-lo_supplycost", "profit", 2, dims, keys)


_AMERICA = {"part": "p_mfgr in ('MFGR#1', 'MFGR#2')", "supplier": "s_region = 'AMERICA'", "customer": "c_region = 'AMERICA'"}
STAR = {
    "ssb_q11": _revenue1("d_year = 1997", (1, 3), (0, 24), ("1997-01-01", "1998-01-01")),
    "ssb_q12": _revenue1("d_yearmonthnum = 199701", (4, 6), (26, 35), ("1997-01-01", "1997-02-01")),
    "ssb_q13": _revenue1("d_weeknuminyear = 6 and d_year = 1997", (5, 7), (26, 35), ("1997-02-01", "1997-02-15")),
    "ssb_q21": _revenue2("p_category = 'MFGR#12'", "AMERICA"),
    "ssb_q22": _revenue2("p_brand1 between 'MFGR#2221' and 'MFGR#2228'", "ASIA"),
    "ssb_q23": _revenue2("p_brand1 = 'MFGR#2221'", "EUROPE"),
    "ssb_q31": _revenue3("c_region = 'ASIA'", "s_region = 'ASIA'", _YEARS, "nation"),
    "ssb_q32": _revenue3("c_nation = 'NATION_1'", "s_nation = 'NATION_1'", _YEARS, "city"),
    "ssb_q33": _revenue3(_CITIES.format("c"), _CITIES.format("s"), _YEARS, "city"),
    "ssb_q34": _revenue3(_CITIES.format("c"), _CITIES.format("s"), "d_yearmonth = 'Dec1997'", "city"),
    "ssb_q41": _profit(_AMERICA | {"ddate": ""}, ("d_year", "c_nation")),
    "ssb_q42": _profit(_AMERICA | {"ddate": "d_year in (1997, 1998)"}, ("d_year", "s_nation", "p_category")),
    "ssb_q43": _profit({"part": "p_category = 'MFGR#14'", "supplier": "s_nation = 'NATION_1'", "customer": "c_region = 'AMERICA'", "ddate": "d_year in (1997, 1998)"}, ("d_year", "s_city", "p_brand1")),
}
QUERIES: dict[str, Callable[[Star], DataFrame]] = {name: q.run for name, q in STAR.items()}
ORACLE = {name: q.sql() for name, q in STAR.items()}
