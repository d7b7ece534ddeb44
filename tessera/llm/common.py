"""Shared pieces: input columns, staged tables in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, and tab to carriage return.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a table with any further columns; a null text counts as empty."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's own setting.

    Only where none is set, as in tests on one machine, a temporary folder is used.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and it survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def swept(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect garbage, since Spark keeps the shuffles of finished jobs until it does."""
    spark._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read any more: what was made of them must be staged itself."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df.__dict__.get("_staged_at")
        if path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if tables:
        swept(tables[0].sparkSession)


def small(df: DataFrame, row_bytes: int, limit: int = 8 << 20) -> DataFrame:
    """A broadcast hint only if the counted rows fit in ``limit`` bytes; else the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def sampled(df: DataFrame, key: str, bound: int, total: int) -> DataFrame:
    """At most ``bound`` of about ``total`` rows, by hash of a key: for fitting only.

    A threshold on the hash leaves about half as many again before the order and
    limit, so that what tasks send to the driver does not grow with their number.
    """
    h = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    return df.withColumn("_h", h).where(F.col("_h") <= F.lit(int(min(1.0, (1.5 * bound + 50) / max(total, 1)) * (1 << 30)))).orderBy("_h", key).limit(bound).drop("_h")
