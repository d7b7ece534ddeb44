"""Quality rules: a hashed n-gram log-likelihood ratio beside rules on repetition and length.

Method: words and word pairs are hashed into ``BUCKETS`` buckets; two
multinomials over the buckets, of trusted documents and of the whole corpus,
give each bucket a log ratio, and a document its mean. Every document is held
against one fixed threshold. DataFrame functions only.

Cases: a null or empty text has no words and fails the rules. Without trusted
documents all ratios are zero, so only the rules decide. Repeated rows are
judged alike, each on its own. Null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NOT_WS, WS, small, texts

BUCKETS = 1 << 14
#: Mean log ratio below which a document is dropped, and the pseudo-count of neutral features of a short one.
THRESHOLD, PRIOR_FEATURES = -0.10, 20
#: Added to each bucket's count in both multinomials.
SMOOTHING = 1.0
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
SYMBOLS = r"[^#*$%&|<>]+"


def _tokenised(docs: DataFrame) -> DataFrame:
    words = F.array_remove(F.split("text", f"{WS}+"), "")
    return docs.withColumn("words", words).withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("h").cast("long"))


def _features(h: str = "h") -> Column:
    """Bucket numbers of the words and of the pairs of neighbours."""
    a = F.col(h)
    pairs = F.when(F.size(a) >= 2, F.transform(F.sequence(F.lit(0), F.size(a) - 2), lambda i: F.pmod(F.xxhash64(a[i], a[i + 1]), F.lit(BUCKETS)).cast("int")))
    return F.concat(F.transform(a, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")), F.coalesce(pairs, F.array().cast("array<int>")))


def fit(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """Log ratio of each bucket. ``trusted`` has the ids (doc_id) of the target documents.

    Counts cover all documents; what reaches the driver are the bucket counts, at most BUCKETS rows.
    """
    ids = trusted.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    rows = _tokenised(docs).select("doc_id", "h")
    rows = rows.join(small(ids, 16), F.col("doc_id") == F.col("_id"), "left")
    rows = rows.select(F.col("_id").isNotNull().cast("long").alias("t"), F.explode(_features()).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).collect()
    raw, target = [SMOOTHING] * BUCKETS, [SMOOTHING] * BUCKETS
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if sum(target) == SMOOTHING * BUCKETS:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw, strict=True)]


def _repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words: words covered by five-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash within one text. Only a text with a
    repeated window pays for the sort that finds where they are.
    """
    h, win, s, pos = F.col("h"), F.col("win"), F.col("s"), F.col("pos")
    df = df.withColumn("win", F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(h[i + k] for k in range(WINDOW))))))
    df = df.withColumn("dup", F.size(F.array_distinct(win)) < F.size(win))
    df = df.withColumn("s", F.when(F.col("dup"), F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("k"), i.alias("p"))))))
    same = lambda i, j: F.coalesce(F.try_element_at(s, j + 1)["k"] == s[i]["k"], F.lit(False))
    marked = F.filter(F.transform(s, lambda e, i: F.when(F.when(i > 0, same(i, i - 1)).otherwise(False) | same(i, i + 1), e["p"])), lambda p: p.isNotNull())
    df = df.withColumn("pos", F.sort_array(marked))
    steps = F.transform(pos, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.try_element_at(pos, i + 2) - p, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    return df.drop("win", "dup", "s", "pos")


def judge(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept to (doc_id, text)."""
    llr = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    text = F.col("text")
    df = _repeats(_tokenised(docs))
    df = df.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_WS)))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    df = df.withColumn("word_chars", (F.length(text) - F.length(F.regexp_replace(text, f"{NOT_WS}+", ""))).cast("long"))
    df = df.withColumn("n_symbols", F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"))
    total = F.aggregate(_features(), F.lit(0.0), lambda a, b: a + llr[b])
    df = df.withColumn("llr", total / (F.greatest(2 * F.col("n_words") - 1, F.lit(0)) + PRIOR_FEATURES))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= THRESHOLD))
    # A generator stands above the expressions: a filter on a verdict pushed through them would hold them many times over.
    results = F.inline_outer(F.array(F.struct(*COLUMNS[1:])))
    return df.select(*(docs[c] for c in docs.columns if c not in COLUMNS[1:]), results)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verdict on every document; the target multinomial is of the documents labelled as good."""
    rows = texts(docs, id_col, text_col)
    return judge(rows, fit(rows, trusted_ids(labels))).select(*COLUMNS)
