"""Language-model scores by a weighted backoff automaton of trigrams.

The states are the root, the start, and the words and pairs of words of the training documents. A state h has an
arc for each word that follows it in training, with the discounted weight
c(hw) / (c(h) + k), to the state of the last pair, or of the word if the pair is new. All that it has no arc for goes by its failure arc, with
the mass k / (c(h) + k) that the discount leaves, to the state of h without its first word: from a pair to
its last word, from a word or the start to the root, which has an arc for every word, also
unknown ones, with a smoothed unigram weight. So a state's weights sum to one at most; what its own arcs and those
behind its failure arc both offer is not counted twice. A text is scored in one traversal from left to right that carries
the state and adds up log10 weights. Texts go side by side; a long one goes in segments of
``SEGMENT`` tokens, each of which starts in the state that the two tokens before it lead to.

No machine holds the whole automaton. Documents are packed into groups, written once, compressed; each
group sends its n-grams' own counts to the buckets they hash to, a bucket sends
back the totals, and the group builds the part of the automaton
that its texts can reach, with exact counts of the whole corpus.

Cases: a null or empty text is its end token alone. Without training documents
all words are unknown and scores come from the smoothed unigram alone.
Repeated rows count and are scored each. Null ids train. An empty table gives an empty result. A very long text is
in one group, which then holds it whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import remainder, staged, swept, texts
from tessera.llm.hashing import mix, slices, word_hashes

#: Mass of the failure arcs of words and of pairs; tokens of a segment; bytes of text a group; bytes of text whose n-grams fill a bucket.
MASS, SEGMENT, GROUP_BYTES, BUCKET_BYTES = (8.0, 2.0), 256, 8 << 20, 11 << 20
END, START = np.uint64(0x5EED0E4D), np.uint64(0x5EED57A7)
#: Of 10^10 different pairs and triples one in 450,000 shares its key with another; of words none in 10^8 does.
NGRAM_BITS = 52
#: The lowest two bits of an n-gram's key say how many tokens it has.
_LENGTH = np.uint64(3)


def _packed(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed: most planes of differences and counts have few values."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = pa.decompress(raw[8:], 8 * int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _keyed(h: np.ndarray, length: int) -> np.ndarray:
    """Words keep 62 bits of their hash, longer n-grams the upper ``NGRAM_BITS``, so that their sorted keys take fewer bytes."""
    return h & (~_LENGTH if length == 1 else ~np.uint64((1 << (64 - NGRAM_BITS)) - 1)) | np.uint64(length)


def _stream(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the token, of it and the one before, and of it and the two before, for all tokens with one end a text; offsets. Before a text stands the start."""
    h, at = word_hashes(column)
    n = len(at) - 1
    tokens = np.empty(len(h) + n, np.uint64)
    ends = at[1:] + np.arange(n)
    mask = np.ones(len(tokens), bool)
    mask[ends] = False
    tokens[mask], tokens[ends] = h, END
    offsets = np.r_[0, ends + 1]
    prev = np.empty_like(tokens)
    prev[1:] = tokens[:-1]
    prev[offsets[:-1]] = START
    pair = mix(mix(prev) ^ tokens)
    before = np.empty_like(prev)
    before[1:] = prev[:-1]
    before[offsets[:-1]] = START
    return [_keyed(mix(tokens), 1), _keyed(pair, 2), _keyed(mix(mix(mix(mix(before)) ^ prev) ^ tokens), 3)], offsets


def _count(column: pa.Array, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the texts, sorted, and how often those that train have each."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in slices(pa.table({"text": column, "train": train}), "text"):
        each, at = _stream(part["text"].combine_chunks())
        weight = np.repeat(part["train"].to_numpy().astype(np.int64), np.diff(at))
        found = _sum(np.concatenate(each), np.tile(weight, 3))
        keys.append(found[0])
        counts.append(found[1])
    return _sum(np.concatenate(keys), np.concatenate(counts))


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


class Automaton:
    """The part of the model that one group's texts can reach: states, arcs and failure arcs with their log10 weights.

    ``keys``, ``counts``: the group's n-grams, sorted, and how often all training documents have them.
    """

    NONE, START = -1, -2

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tokens: int, vocabulary: int, starts: int):
        length = keys & _LENGTH
        self.keys = [keys[length == k] for k in (1, 2, 3)]
        self.words, self.pairs, self.triples = (counts[length == k] for k in (1, 2, 3))
        self.root = np.log10((self.words + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
        # How often each state occurs, and the weight of its failure arc; the last two are the start and no state, which fails for free.
        self.word_size, self.pair_size = np.r_[self.words, starts, 0].astype(np.float64), np.r_[self.pairs, 0, 0].astype(np.float64)
        self.word_fail, self.pair_fail = (np.log10(m / (size + m)) for m, size in zip(MASS, (self.word_size, self.pair_size), strict=True))

    def score(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, score."""
        each, at = _stream(column)
        word, pair, triple = (np.searchsorted(held, asked) for held, asked in zip(self.keys, each, strict=True))
        lengths = np.diff(at)
        parts = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), parts)
        first = at[:-1][text] + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts))
        stop = np.minimum(first + SEGMENT, at[1:][text])
        # The longest first, so that those still under way stand in front.
        order = np.argsort(first - stop, kind="stable")
        text, first, stop = text[order], first[order], stop[order]
        of_pair, of_word = self._entered(pair[np.maximum(first - 1, 0)], word[np.maximum(first - 1, 0)])
        begins = first == at[:-1][text]
        of_pair[begins], of_word[begins] = self.NONE, self.START
        total = np.zeros(len(first))
        for step in range(int((stop - first).max(initial=0))):
            live = int(np.searchsorted(first - stop, -step))
            now = first[:live] + step
            total[:live] += self._weight(of_pair[:live], of_word[:live], word[now], pair[now], triple[now])
            of_pair[:live], of_word[:live] = self._entered(pair[now], word[now])
        add = lambda x: np.add.reduceat(x, at[:-1])
        return lengths, add((self.words[word] > 0).astype(np.int64)), add(self.root[word]), np.bincount(text, total, len(lengths))

    def _entered(self, pair: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state behind these tokens: their pair if it is one, and the word that it fails to, if that is one; else the root."""
        return np.where(self.pairs[pair] > 0, pair, self.NONE), np.where(self.words[word] > 0, word, self.NONE)

    def _weight(self, of_pair: np.ndarray, of_word: np.ndarray, word: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> np.ndarray:
        """One token on, from the states by the first arc that there is on the way down the failure arcs."""
        out = np.empty(len(word))
        by3 = (of_pair != self.NONE) & (self.triples[triple] > 0)
        out[by3] = np.log10(self.triples[triple[by3]] / (self.pair_size[of_pair[by3]] + MASS[1]))
        by2 = ~by3 & (of_word != self.NONE) & (self.pairs[pair] > 0)
        out[by2] = self.pair_fail[of_pair[by2]] + np.log10(self.pairs[pair[by2]] / (self.word_size[of_word[by2]] + MASS[0]))
        by1 = ~(by3 | by2)
        out[by1] = self.pair_fail[of_pair[by1]] + self.word_fail[of_word[by1]] + self.root[word[by1]]
        return out


def _packs(rows: DataFrame) -> DataFrame:
    """(g, ids, train, texts): groups of documents of about ``GROUP_BYTES`` of text, compressed, written once."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def packed(parts: list[pa.RecordBatch], g: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("text", pa.large_string())]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.table({"text": table["text"].cast(pa.large_string()).combine_chunks()}))
        one = lambda name: pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table[name].combine_chunks())
        return pa.record_batch({"g": pa.array([g], pa.int64()), "ids": one("doc_id"), "train": one("train"), "texts": pa.array([sink.getvalue().to_pybytes()], pa.large_binary()).cast(pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, g = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                grown = int(pc.sum(pc.binary_length(part.column(1))).as_py() or 0) + 8 * part.num_rows
                if parts and size + grown > GROUP_BYTES:
                    yield packed(parts, g)
                    parts, size, g = [], 0, g + 1
                parts.append(part)
                size += grown
        if parts:
            yield packed(parts, g)

    marked = rows.select("doc_id", "text", F.coalesce(remainder("doc_id", 5) != 1, F.lit(True)).alias("train"))
    return staged(marked.mapInArrow(run, f"g long, ids array<{kind}>, train array<boolean>, texts binary"), "lm-groups")


def _texts(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(raw).read_all()["text"].combine_chunks()


SCORED = "train boolean, n_tokens long, n_known long, base_score double, score double"


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    rows = texts(docs, id_col, text_col)
    packs = _packs(rows)
    buckets = -(-packs.count() * GROUP_BYTES // BUCKET_BYTES) or 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, train, raw in zip(*(batch.column(k) for k in range(3)), strict=True):
                keys, counts = _count(_texts(raw.as_py()), train.values)
                to = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # ranges of keys, so order is kept
                cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    yield pa.record_batch({"b": pa.array([int(to[a])], pa.int32()), "g": pa.array([g.as_py()], pa.int64()), "keys": [_packed(np.diff(keys[a:b], prepend=np.uint64(0)))], "counts": [_packed(counts[a:b])]})

    def merged(table: pa.Table) -> pa.Table:
        """Each group gets the totals of its keys, in its keys' order; group -1 gets this bucket's part of the vocabulary and of the tokens."""
        keys = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in table["keys"].to_pylist()]
        counts = [_unpacked(x).astype(np.int64) for x in table["counts"].to_pylist()]
        every, totals = _sum(np.concatenate(keys), np.concatenate(counts))
        single = (every & _LENGTH) == np.uint64(1)
        b = table["b"][0].as_py()
        out = [(-1, b, int(totals[single].sum()), int((totals[single] > 0).sum()), int(totals[every == _keyed(mix(np.array([END])), 1)[0]].sum()), None)]
        out += [(g, b, 0, 0, 0, _packed(totals[np.searchsorted(every, k)])) for g, k in zip(table["g"].to_pylist(), keys, strict=True)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({name: pa.array([x[i] for x in out], kind) for i, (name, kind) in enumerate(zip(("g", "b", "tokens", "vocabulary", "starts", "totals"), kinds, strict=True))})

    sent = packs.select("g", "train", "texts").mapInArrow(counted, "b int, g long, keys binary, counts binary")
    back = sent.groupBy("b").applyInArrow(merged, "g long, b int, tokens long, vocabulary long, starts long, totals binary")
    back = staged(back, "lm")
    del sent
    whole = back.where("g = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "vocabulary", "starts"))).first()
    sizes = (whole["tokens"], whole["vocabulary"], whole["starts"])
    # The n-grams that were sent are not read again, and would lie on disk beside the next shuffle. Not before this job: Spark lets go of the last one late.
    swept(docs.sparkSession)

    def scored(table: pa.Table, news: pa.Table) -> pa.Table:
        out = []
        for ids, train, raw in zip(*(table[x].combine_chunks() for x in ("ids", "train", "texts")), strict=True):
            column = _texts(raw.as_py())
            keys, _ = _count(column, train.values)
            parts = sorted(zip(news["b"].to_pylist(), news["totals"].to_pylist(), strict=True))
            model = Automaton(keys, np.concatenate([_unpacked(t) for _, t in parts]).astype(np.int64), *sizes)
            found = [model.score(p["text"].combine_chunks()) for p in slices(pa.table({"text": column}), "text")]
            n_tokens, n_known, base, score = (np.concatenate(x) for x in zip(*found, strict=True))
            out.append(pa.table({"doc_id": ids.values, "train": train.values, "n_tokens": n_tokens.astype(np.int64), "n_known": n_known.astype(np.int64), "base_score": base, "score": score}))
        return pa.concat_tables(out) if out else pa.schema([("doc_id", table.schema.field("ids").type.value_type), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()

    news = back.where("g >= 0").select("g", "b", "totals")
    out = packs.groupBy("g").cogroup(news.groupBy("g")).applyInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCORED}")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(sizes[0]).cast("long").alias("train_tokens"), "base_score", "score")
