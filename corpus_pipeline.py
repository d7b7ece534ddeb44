"""From raw documents to encoded training data, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns the columns of ``documents``; the last returns piece ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, pieces, quality, secrets
from tessera.llm.common import small, staged, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject: also null and empty texts, which have no words. Each of repeated rows is judged, alike."""
    packed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct("*").alias("row"))
    ratios = quality.fit(packed, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return quality.judge(packed, ratios).where("kept").select("row.*")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 the one with the smallest id stays.

    Texts without words are in no group and stay. Of rows that repeat an id and its text one stays; rows of one id with other
    texts stay or go together. Rows without an id stay.
    """
    found = staged(jaccard.jaccard_join(docs, words=5, percent=80), "one-of-group")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(small(gone, 16), F.col("doc_id") == F.col("_gone"), "left_anti")
    # Rows that repeat an id and its text are copies too.
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if twice.isEmpty():
        return left
    return left.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(left.where("doc_id is null"))


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark item, with or without an id; null and empty texts hold none. Of an empty benchmark, all stay."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Overwrites secrets in every row; n_chars follows the text. A null text becomes the empty one."""
    found, _ = secrets.secret_scan(docs)
    out = secrets.redacted(found).select("rest.*", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces): piece ids of the best segmentation of every row; null and empty texts have none."""
    return pieces.encode_table(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_group),
    ("decontamination", drop_benchmarks),
    ("secrets", redact_secrets),
    ("pieces", encode),
]

#: SQL cannot express these stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
