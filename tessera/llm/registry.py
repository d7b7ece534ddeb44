"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard, licenses, lm, pages, pieces, quality, secrets, tokens, toxicity
from tessera.llm.common import table


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.piece_digest(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(secrets.secret_scan(table(spark, sf, "documents"))[0])


def op5_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.digest(licenses.license_scan(table(spark, sf, "documents")))


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.main_text(table(spark, sf, "pages"))


def op8_lm(spark: SparkSession, sf: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf, "documents"))


def op9_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op10_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_toxicity, op2_pieces, op3_tokens, op4_secrets, op5_licenses, op6_quality, op7_pages, op8_lm, op9_decontaminate, op10_jaccard)}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
