"""Secret scans: an incremental ledger of blobs.

Every version of a file is addressed by the SHA-256 of its content. A ledger
holds the (blob, rule, rule version) pairs already scanned and their findings;
a run scans only the pairs that it lacks, and joins findings back to all paths.
DataFrame functions only.

Cases: a null text is the empty blob, without findings. Paths with one content
share one scan. Repeated rows each get their findings. Null ids are kept. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import staged


@dataclass(frozen=True)
class Rule:
    """``pattern`` is found leftmost and without overlap; matches whose group ``value`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    gate: str
    value: int = 0
    least: int = 1
    version: int = 1


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", _ASSIGN, r"(?i:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]", value=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12}", least=16),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{32}", least=32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{36}", least=40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.", least=40),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob string, kind string, version int, spans array<struct<start:bigint,end:bigint>>"


def blobs_of(rows: DataFrame) -> DataFrame:
    """Content-addressed rows: blob is the hex SHA-256 of the UTF-8 text."""
    return rows.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))


def _pieces(rule: Rule) -> Column:
    """Per match: the gap before it, the match, its value group; null unless the gate finds something.

    ``\\G`` ties each search to the end of the last, so a text is read once.
    """
    text, tied = F.col("text"), F.lit(rf"(?s)\G(.*?)({rule.pattern})")
    get = lambda k: F.regexp_extract_all(text, tied, F.lit(k))
    found = F.transform(
        F.arrays_zip(get(1).alias("gap"), get(2).alias("hit"), get(2 + rule.value).alias("value")),
        lambda z: F.struct(F.length(z["gap"]).cast("long").alias("gap"), F.length(z["hit"]).cast("long").alias("hit"), F.length(z["value"]).cast("long").alias("value")),
    )
    return F.when(text.rlike(rule.gate), F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"), found.alias("found")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (blob, kind, version, start, end) of distinct blobs (blob, text, kinds to scan)."""
    wanted = lambda r: F.when(F.array_contains("todo", r.kind), _pieces(r))
    hits = blobs.select("blob", F.explode(F.array_compact(F.array(*(wanted(r) for r in rules)))).alias("r"))
    hits = hits.select("blob", "r.kind", "r.version", "r.least", F.posexplode("r.found").alias("k", "m"))
    so_far = F.sum(F.col("m.gap") + F.col("m.hit")).over(W.partitionBy("blob", "kind").orderBy("k"))
    hits = hits.withColumn("end", so_far).where("m.value >= least")
    return hits.select("blob", "kind", "version", (F.col("end") - F.col("m.hit")).alias("start"), "end")


def scan(rows: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks. Gives (findings by blob and kind, this run's pairs for the ledger).

    rows: (text, blob), one row per path and version. A ledger row without spans says: scanned, nothing found.
    """
    unseen = rows.select("blob", "text").dropDuplicates(["blob"])
    every = F.array(*(F.lit(r.kind) for r in rules))
    if ledger is None:
        todo = unseen.withColumn("todo", every)
    else:
        current = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
        known = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("known"))
        left = F.transform(F.filter(current, lambda c: ~F.coalesce(F.array_contains("known", c), F.lit(False))), lambda c: c["kind"])
        todo = unseen.join(known, "blob", "left").withColumn("todo", left).where(F.size("todo") > 0).drop("known")
    found = scan_blobs(todo, rules).groupBy("blob", "kind", "version").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    fresh = staged(found, "secrets")
    new = _scanned(todo, rules).join(fresh, ["blob", "kind", "version"], "left").select("blob", "kind", "version", "spans")
    if ledger is None:
        return fresh, new
    valid = ledger.where(" or ".join(f"kind = '{r.kind}' and version = {r.version}" for r in rules))
    return valid.where("spans is not null").unionByName(fresh), new


def _scanned(todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    pairs = F.transform("todo", lambda k: F.struct(k.alias("kind"), F.lit(0).alias("version")))
    version = F.coalesce(*(F.when(F.col("p.kind") == r.kind, r.version) for r in rules))
    return todo.select("blob", F.explode(pairs).alias("p")).select("blob", F.col("p.kind").alias("kind"), version.cast("int").alias("version"))


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, found, rest) for every row, and the grown ledger.

    found: array of (start, order, kind, end), null if nothing; rest: struct of the row's other columns.
    """
    others = [docs[c] for c in docs.columns if c != text_col]
    rows = blobs_of(docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.struct(*others).alias("rest")))
    findings, new = scan(rows, ledger)
    order = F.coalesce(*(F.when(F.col("kind") == r.kind, k) for k, r in enumerate(RULES)))
    span = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("order"), F.col("kind"), s["end"].alias("end")))
    per_blob = findings.withColumn("order", order).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(span))).alias("found"))
    # Written before the join, so that a content with very many paths can be split there.
    per_blob = staged(per_blob, "secrets-by-blob").withColumnRenamed("blob", "_blob")
    out = rows.join(per_blob, F.col("blob") == F.col("_blob"), "left")
    return out.select("doc_id", "text", "found", "rest"), new if ledger is None else ledger.unionByName(new)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger stored at a path of a file system that all executors share; empty if there is none."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_history(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path_col: str = "path", version_col: str = "version", text_col: str = "text") -> DataFrame:
    """(path, version, blob, kind, start, end): findings of every version of every path, one row each.

    ``ledger`` is where the ledger is stored. Contents that it has under the rules' versions are not scanned again, under whatever path or
    version they come back; the run's own pairs are appended. Versions without findings have no row.
    """
    rows = blobs_of(versions.select(versions[path_col].alias("path"), versions[version_col].alias("version"), F.coalesce(versions[text_col], F.lit("")).alias("text")))
    findings, new = scan(rows, load_ledger(versions.sparkSession, ledger), rules)
    new = staged(new, "secrets-new")
    findings = staged(findings.select(F.col("blob").alias("_blob"), "kind", F.explode("spans").alias("s")), "secrets-found")
    new.write.mode("append").parquet(ledger)
    out = rows.select("path", "version", "blob").join(findings, F.col("blob") == F.col("_blob"))
    return out.select("path", "version", "blob", "kind", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    spans = F.coalesce(F.col("found"), F.filter(F.col("found"), lambda s: F.lit(False)), F.expr("cast(array() as array<struct<start:bigint,`order`:int,kind:string,`end`:bigint>>)"))
    df = found.withColumn("f", spans)
    count = lambda k: F.size(F.filter("f", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("f", lambda s: s["kind"].isin(*BASE))
    return df.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("f")).alias("spans")
    )


def redacted(found: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """(doc_id, text, rest) with every found span replaced by ``mark``; spans that overlap get one mark."""
    text, spans = F.col("text"), F.col("found")
    # Text before a span starts where the furthest span before it has ended.
    done = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.array_max(F.transform(F.slice(spans, F.lit(1), F.greatest(i, F.lit(1))), lambda s: s["end"])))
    kept = lambda s, i: F.substring(text, (done(i) + 1).cast("int"), F.greatest(s["start"] - done(i), F.lit(0)).cast("int"))
    parts = F.transform(spans, lambda s, i: F.concat(kept(s, i), F.when(s["start"] >= done(i), mark).otherwise("")))
    tail = F.substring(text, (F.array_max(F.transform(spans, lambda s: s["end"])) + 1).cast("int"), F.length(text))
    return found.select("doc_id", F.when(spans.isNull(), text).otherwise(F.concat(F.array_join(parts, ""), tail)).alias("text"), "rest")
