"""Thin DataFrame forms of the engine's operators; the physical strategy is Catalyst's."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Table scan; naming columns is optional, since the optimizer prunes unused ones."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def select(df: DataFrame, *predicates: Column) -> DataFrame:
    """Rows for which every predicate holds (a chain of selections is a conjunction)."""
    return df.filter(reduce(lambda a, b: a & b, predicates))


def project(df: DataFrame, **expressions: Column) -> DataFrame:
    return df.select(*(e.alias(name) for name, e in expressions.items()))


def fixed_aggregation(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Aggregation without keys: one row, also over no input."""
    return df.agg(*(a.alias(name) for name, a in aggregates.items()))


def _on(build: DataFrame, probe: DataFrame, keys: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (probe[p] == build[b] for b, p in keys))


def hash_join(build: DataFrame, probe: DataFrame, keys: Sequence[tuple[str, str]], build_values: Sequence[str] = ()) -> DataFrame:
    """Inner equi-join on pairs (build key, probe key), N:M.

    Keeps the probe's columns and the named build columns. No broadcast hint:
    the build side is broadcast only if its statistics are under the session's
    threshold, else adaptive execution shuffles and splits skewed keys.
    """
    return probe.join(build, _on(build, probe, keys)).select(*(probe[c] for c in probe.columns), *(build[c] for c in build_values))


def semi_join(build: DataFrame, probe: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Probe rows with a partner: membership in a set of keys."""
    return probe.join(build, _on(build, probe, keys), "left_semi")


def hash_group(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Two-phase group-by: partial per task, exchange on the keys, final."""
    return df.groupBy(*keys).agg(*(a.alias(name) for name, a in aggregates.items()))


def product(column: Column) -> Column:
    """PRODUCT as a double aggregate; exact while the result is below 2**53."""
    return F.product(column)


def ordered_fold(df: DataFrame, keys: Sequence[str], order: str, value: str, op: str, start: int, name: str = "acc") -> DataFrame:
    """The non-mergeable folds acc = x OP acc, made deterministic by an order column.

    One group's values meet in one task by definition of the fold, so this is
    for small groups; sums and products have mergeable aggregates above.
    """
    ops = {
        "minus": lambda acc, x: x - acc,
        "divides": lambda acc, x: F.call_function("div", x, acc),
        "modulus": lambda acc, x: x % acc,
    }
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("long").alias("x"))))
    return df.groupBy(*keys).agg(F.aggregate(rows, F.lit(start).cast("long"), lambda acc, r: ops[op](acc, r["x"])).alias(name))


def index_lookup(df: DataFrame, key: str, value: str, lookups: DataFrame, lookup_key: str) -> DataFrame:
    """Multimap lookup: each looked-up key with the sorted list of its values (empty if none)."""
    wanted = df.join(lookups, df[key] == lookups[lookup_key], "left_semi")
    index = wanted.groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(value)).alias("hits"))
    empty = F.array().cast(index.schema["hits"].dataType)
    return lookups.join(index, lookups[lookup_key] == index["_k"], "left").select(lookups[lookup_key], F.coalesce("hits", empty).alias("hits"))


def partition_by_key(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)


def tap(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Pass-through that counts rows (and other aggregates) as they flow by."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(k) for k, m in metrics.items())), seen


def result(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Final projection: output name -> column."""
    return df.select(*(F.col(c).alias(name) for name, c in columns.items()))


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as text: 'simple', 'extended', 'formatted', 'cost', or 'codegen' for the generated code of its stages."""
    session = df.sparkSession._jvm.PythonSQLUtils
    return session.explainString(df._jdf.queryExecution(), mode)
