"""Toxicity by compression distance.

Two zstandard dictionaries share a base of common words; one goes on with words
of toxic documents, the other with as many bytes of ordinary ones. A window is
one word with its blanks, in two bytes a character, so that a short match shows
in the length. Its two compressed lengths fall into a cell, each cell has a
log-odds from labelled documents not used for the dictionaries, and a document's
cells, through a logistic curve fitted on further documents, give its score.

Cases: a null or empty text has no windows and gets the score of one without
signs. Without labels of both kinds the score is 0. Repeated rows are scored each on their
own. Null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import remainder, sampled, small, texts

#: Labelled documents of each kind that are learned from at most, by hash of the id; bytes of each part of a dictionary.
SAMPLE_TOXIC, SAMPLE_ORDINARY, DICTIONARY_BYTES = 3000, 6000, 16_384
THRESHOLD, REMEMBERED = 0.3, 200_000
EDGES = ".,!?;:*#$%&|<>()[]{}\"'"


def windows(text: str) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()]


def _content(words: list[str], size: int) -> str:
    """Words up to ``size`` bytes, the first ones last: near matches are the cheapest."""
    out, used = [], 0
    for w in words:
        used += len(w.encode()) + 1
        if used > size:
            break
        out.append(w)
    return " " + "".join(w + " " for w in reversed(out))


@dataclass
class Model:
    toxic: str = ""
    ordinary: str = ""
    odds: dict[tuple[int, int], float] = field(default_factory=dict)
    scale: list[tuple[float, float]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def _compressors(self):
        import zstandard as z

        params = z.ZstdCompressionParameters(
            window_log=16, hash_log=15, chain_log=15, search_log=5, min_match=6, target_length=32, strategy=z.STRATEGY_LAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        out = []
        for text in (self.ordinary, self.toxic):
            known = z.ZstdCompressionDict(text.encode("utf-16-le"), dict_type=z.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=params)
            out.append(z.ZstdCompressor(compression_params=params, dict_data=known).compress)
        return out, {}

    def cell(self, word: str) -> tuple[int, int]:
        """Length of the window and what the toxic dictionary saves on it, in bytes."""
        if self._ready is None:
            self._ready = self._compressors()
        (ordinary, toxic), known = self._ready
        found = known.get(word)
        if found is None:
            raw = f" {word} ".encode("utf-16-le", "surrogatepass")
            found = (min(len(word), 24), min(max(len(ordinary(raw)) - len(toxic(raw)), -1), 24))
            if len(known) >= REMEMBERED:
                known.clear()
            known[word] = found
        return found

    def features(self, text: str) -> list[float]:
        odds = sorted((self.odds.get(c, 0.0) for c in set(map(self.cell, windows(text)))), reverse=True) or [0.0]
        return [odds[0], sum(odds[:2]) / 2, sum(odds[:4]) / 4, sum(x for x in odds if x > 0), sum(odds)]

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        x = [(v - m) / s for v, (m, s) in zip(self.features(text), self.scale, strict=True)]
        t = sum(w * v for w, v in zip(self.weights, [*x, 1.0], strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, t))))


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Half of each kind makes the dictionaries, a quarter the cells, a quarter the curve."""
    if min(len(toxic), len(ordinary)) < 8:
        return Model()
    cut = lambda rows: (rows[: len(rows) // 2], rows[len(rows) // 2 : 3 * len(rows) // 4], rows[3 * len(rows) // 4 :])
    (t1, t2, t3), (o1, o2, o3) = cut(toxic), cut(ordinary)
    spread = lambda rows: Counter(w for t in rows for w in set(windows(t)) if len(w) > 2)
    ct, co = spread(t1), spread(o1)
    ratio = lambda w: (ct[w] / len(t1)) / ((co[w] + 0.5) / len(o1))
    # In so many toxic documents that chance alone would not do it.
    least = max(3, round(0.004 * len(t1)))
    marked = {w for w in ct if ct[w] >= least and ratio(w) >= 12}
    by_count = lambda c, keep: [w for w, _ in sorted(((w, n) for w, n in c.items() if keep(w)), key=lambda x: (-x[1], x[0]))]
    common = by_count(co, lambda w: w not in marked)
    base = _content(common, DICTIONARY_BYTES)
    own = _content(by_count(ct, marked.__contains__), DICTIONARY_BYTES)
    other = _content(common[base.count(" ") - 1 :], len(own.encode()))
    model = Model(base + own, base + other)
    cells = lambda rows: Counter(c for t in rows for c in set(map(model.cell, windows(t))))
    bt, bo = cells(t2), cells(o2)
    model.odds = {c: math.log((bt[c] + 0.5 * len(t2) / len(o2)) / len(t2) / ((bo[c] + 0.5) / len(o2))) for c in bt.keys() | bo.keys()}
    x, y = np.array([model.features(t) for t in t3 + o3]), np.r_[np.ones(len(t3)), np.zeros(len(o3))]
    # The curve is to give probabilities at the labels' own rates; both samples may be cut at different shares.
    mean, sd = x.mean(0), x.std(0) + 1e-9
    a, w = np.c_[(x - mean) / sd, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (p - y) + 0.1 * w)
    model.scale, model.weights = [(float(m), float(s)) for m, s in zip(mean, sd, strict=True)], [float(v) for v in w]
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows whose id's crc32 modulo 4 is not 2; the samples' bounds are this module's parameters."""
    known = labels.where(remainder("doc_id", 4) != 2).select(F.col("doc_id").alias("_id"), "toxic").where("toxic is not null").dropDuplicates(["_id"])
    rows = docs.join(small(known, 24), F.col("doc_id") == F.col("_id"))
    rates = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # Both kinds in their own proportion, so that scores are probabilities.
    n_toxic = min(SAMPLE_TOXIC, rates.get(1, 0))
    n_ordinary = min(SAMPLE_ORDINARY, rates.get(0, 0))
    pick = lambda kind, n: [r["text"] for r in sampled(rows.where(f"toxic = {kind}").select("doc_id", "text"), "doc_id", n, rates.get(kind, 0)).collect()]
    model = train(pick(1, n_toxic), pick(0, n_ordinary))
    if model.weights:
        shift = math.log(rates[1] / rates[0]) - math.log(n_toxic / n_ordinary)
        model.weights[-1] += shift
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    rows = texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels))  # two dictionaries of bounded size

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    out = rows.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
