"""Benchmark decontamination by SimHash windows.

A document holds an item if some run of its words has a weighted Jaccard
similarity of five-word shingles with the item of ``SIMILARITY`` or more. An edit
inside such a run costs the two four shingles or more, so there can be few, and between
them at least ``stretch`` words of the item stand unchanged. Windows have a size that follows from the item's, a part of that stretch: the item
has one at every place, a document at every ``step``, so that one window of the document lies within the stretch and has the
fingerprint of a window of the item. Fingerprints are SimHashes of a window's words. They are found in
an index of four blocks of 16 bits each, which guarantees all within a Hamming distance of
``RADIUS``, so windows with a changed word can be found too. Around the places found, the best run is chosen among all that
begin and end with a shared shingle, by its exact similarity; no other run is better than the one left of it when its ends are cut off.

Words are runs of letters, digits and characters beyond ASCII, in lower case.

Cases: null and empty texts match nothing, nor do items without words, nor does an empty benchmark. Items of under five words are one
shingle, which their exact words in order match. Repeated rows are matched each; items of one id with several texts each
are matched, and a document that holds two of them has two rows. Of runs with one similarity the first is taken. Null ids are kept; ids may be of any
type. Very long texts are read whole, one at a time. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import texts
from tessera.llm.hashing import ALNUM, mix, runs, slices, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Items and bytes of items held by a worker at a time, about; a larger benchmark takes several passes over the documents.
ITEMS_A_PASS, BYTES_A_PASS = 5000, 4 << 20
#: Bytes of documents that a worker takes at a time.
CHUNK = 1 << 19
#: Hamming distance of fingerprints up to which windows are found; one more block than that, of which one then is equal.
RADIUS, BLOCK_BITS = 3, 16
#: Sizes of windows, in words.
SIZES = (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 18, 22, 26, 30)


def reach(n: int) -> tuple[int, int]:
    """Least overlap of an item of ``n`` shingles with a copy, and most shingles of the copy."""
    return math.ceil(n * SIMILARITY - 1e-9), math.floor(n / SIMILARITY + 1e-9)


def stretch(words: int) -> int:
    """Words of an item of so many that stand unchanged and together in any run that reaches the similarity.

    Of ``x`` shared shingles, at most x (1 / SIMILARITY - 1) others are in the two. An edit inside makes about 9, and
    4 at least, where it repeats words beside it or takes away such a repetition; e edits leave e + 1 stretches.
    """
    if words <= SHINGLE:
        return words
    total = words - SHINGLE + 1
    shared = np.arange(reach(total)[0], total + 1)
    edits = np.floor(shared * (1 / SIMILARITY - 1) / (SHINGLE - 1) + 1e-9)
    return int(np.ceil(shared / (edits + 1)).min()) + SHINGLE - 1


def window(words: int) -> tuple[int, int]:
    """(size, step) of the windows for an item of so many words: any ``stretch`` of a document holds a whole window."""
    clean = stretch(words)
    size = max(w for w in SIZES if w <= max(1, 0.8 * clean) or w == clean < SHINGLE)
    return size, clean - size + 1


def simhash(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows that start there: bits that more than half of the words have.

    The words that have a bit are counted for all 64 bits of a number at once: planes[k] holds the numbers that count 2**k each.
    """
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), 1 << 14):
        part = starts[at : at + (1 << 14)]
        planes = [[h[part + k] for k in range(size)]]
        for plane in planes:
            carries = []
            while len(plane) > 1:
                a, b = plane.pop(), plane.pop()
                either = a ^ b
                if plane:
                    c = plane.pop()
                    plane.append(either ^ c)
                    carries.append((a & b) | (either & c))
                else:
                    plane.append(either)
                    carries.append(a & b)
            if carries:
                planes.append(carries)
        # Counts of size // 2 + 1 or more, from the lowest bit up.
        enough = np.full(len(part), ~np.uint64(0))
        for k, (count,) in enumerate(planes):
            enough = count & enough if (size // 2 + 1) >> k & 1 else count | enough
        out[at : at + len(part)] = enough
    return out


def spread(starts: np.ndarray, counts: np.ndarray, step: int = 1) -> np.ndarray:
    """starts[k], starts[k] + step, ... (counts[k] numbers), one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts, counts) + step * (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts))


class HammingIndex:
    """Finds all fingerprints within ``RADIUS``: of RADIUS + 1 blocks of bits one is equal, and each block has a table."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for value in self._blocks(codes):
            sizes = np.bincount(value, minlength=1 << BLOCK_BITS)
            self.tables.append((np.argsort(value, kind="stable"), np.r_[0, np.cumsum(sizes)], sizes > 0))

    @staticmethod
    def _blocks(codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes.astype("<u8").view(f"<u{BLOCK_BITS // 8}").reshape(-1, RADIUS + 1).T)

    def near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the codes asked, place among those held) of all pairs; one may come twice."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for value, (order, ends, held_any) in zip(self._blocks(codes), self.tables, strict=True):
            some = np.flatnonzero(held_any[value])
            for a in range(0, len(some), 1 << 16):
                part = some[a : a + (1 << 16)]
                first = ends[value[part]]
                size = ends[value[part].astype(np.int64) + 1] - first
                q, held = np.repeat(part, size), order[spread(first, size)]
                close = np.bitwise_count(codes[q] ^ self.codes[held]) <= RADIUS
                out.append((q[close], held[close]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best_run(part: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> tuple[float, int, int] | None:
    """(similarity, first, shingles) of the run of ``part`` most similar to an item with these shingles: sum of smaller over sum of larger multiplicities."""
    total = int(counts.sum())
    least, most = reach(total)
    kind = np.searchsorted(kinds, part).clip(max=len(kinds) - 1)
    pos = np.flatnonzero(kinds[kind] == part)
    if len(pos) < least:
        return None
    starts = np.flatnonzero(pos[least - 1 :] - pos[: len(pos) - least + 1] < most)
    if not len(starts):
        return None
    kind = kind[pos]
    # A shared shingle counts in a run unless the run has as many of its kind before it as the item has in all.
    order = np.argsort(kind, kind="stable")
    rank = np.arange(len(order)) - np.searchsorted(kind[order], kind[order])
    before = np.full(len(pos), -1)
    full = np.flatnonzero(rank >= counts[kind[order]])
    before[order[full]] = order[full - counts[kind[order[full]]]]
    ends = np.searchsorted(pos, pos[starts] + most)
    best = None
    for i, end in zip(starts.tolist(), ends.tolist(), strict=True):
        both = np.cumsum(before[i:end] < i)
        length = pos[i:end] - pos[i] + 1
        s = both / (total + length - both)
        j = int(s.argmax())
        if s[j] >= SIMILARITY and (best is None or s[j] > best[0]):
            best = float(s[j]), int(pos[i]), int(length[j])
            if best[0] == 1.0:
                break
    return best


class Items:
    """The benchmark's windows, indexed for each size of windows."""

    def __init__(self, rows: list[tuple[object, str]]):
        h, at = word_hashes(pa.array([t or "" for _, t in rows], pa.large_string()), ALNUM)
        h = mix(h)
        self.ids = [i for i, _ in rows]
        sizes = np.diff(at)
        self.width = np.minimum(sizes, SHINGLE)
        self.shingles = [np.unique(runs(h[a:b], min(b - a, SHINGLE)), return_counts=True) if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        chosen: dict[int, list[tuple[int, int]]] = {}
        for k, n in enumerate(sizes.tolist()):
            if n:
                size, step = window(n)
                chosen.setdefault(size, []).append((k, step))
        self.windows = []
        for size, members in sorted(chosen.items()):
            item = np.array([k for k, _ in members])
            counts = sizes[item] - size + 1
            index = HammingIndex(simhash(h, spread(at[:-1][item], counts), size))
            self.windows.append((size, min(step for _, step in members), np.repeat(item, counts), index))

    def matches(self, column: pa.Array) -> list[tuple[int, object, int, int, float]]:
        """(text, item, first word, words, similarity) of copies, the best for each text and item."""
        h, at = word_hashes(column, ALNUM)
        h = mix(h)
        out = []
        for size, step, owner, index in self.windows:
            counts = np.maximum(0, (np.diff(at) - size) // step + 1)
            places = spread(at[:-1], counts, step)
            q, held = index.near(simhash(h, places, size))
            place, item = places[q], owner[held]
            text = np.searchsorted(at, place, "right") - 1
            # Found places by text and item, in order.
            order = np.lexsort((place, item, text))
            text, item, place = text[order], item[order], place[order]
            cuts = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]), True]) if len(text) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                k, doc = int(item[a]), int(text[a])
                kinds, counts_of = self.shingles[k]
                width, most = int(self.width[k]), reach(int(counts_of.sum()))[1]
                # A run that holds a window is no longer than ``most`` shingles.
                first = max(int(at[doc]), int(place[a]) + size - most - width + 1)
                last = min(int(at[doc + 1]) - width, int(place[b - 1]) + most - 1)
                found = best_run(runs(h[first : last + width], width), kinds, counts_of) if first <= last else None
                if found:
                    s, p, length = found
                    out.append((doc, k, first + p - int(at[doc]), length + width - 1, s))
        return [(t, self.ids[k], a, n, s) for t, k, a, n, s in sorted(out)]


def _passes(benchmark: DataFrame, item_col: str, item_text: str) -> list[Broadcast]:
    """The items as (id, text), in broadcasts of bounded size."""
    items = benchmark.select(benchmark[item_col].alias("item_id"), F.coalesce(benchmark[item_text], F.lit("")).alias("text"))
    size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(-(-size[0] // ITEMS_A_PASS), -(-size[1] // BYTES_A_PASS), 1)
    parts = (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().orderBy("item_id", "text").collect() for k in range(n))
    return [benchmark.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part]) for part in parts]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): every document that holds an item, once for each item."""
    rows = texts(docs, id_col, text_col)
    kinds = {"doc_id": rows.schema["doc_id"].dataType, "item_id": benchmark.schema[item_col].dataType}
    arrow = to_arrow_type(kinds["item_id"])
    schema = ", ".join(f"{x} {kind.simpleString()}" for x, kind in kinds.items()) + ", first_word long, n_words long, similarity double"

    def run(shared: Broadcast) -> DataFrame:
        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(shared.value)
            for batch in batches:
                for part in slices(batch, "text", CHUNK):
                    found = known.matches(part.column(1))
                    if found:
                        t, i, a, n, s = zip(*found, strict=True)
                        yield pa.record_batch(
                            {"doc_id": part.column(0).take(pa.array(t)), "item_id": pa.array(i, arrow), "first_word": pa.array(a, pa.int64()), "n_words": pa.array(n, pa.int64()), "similarity": pa.array(s, pa.float64())}
                        )

        return rows.mapInArrow(match, schema)

    return reduce(DataFrame.unionByName, map(run, _passes(benchmark, item_col, item_text)))


def without_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item; rows need no ids."""

    at = docs.columns.index(text_col)

    def run(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(shared.value)
            for batch in batches:
                for part in slices(batch.append_column("_text", pc.fill_null(batch.column(at), "")), "_text", CHUNK):
                    keep = np.ones(part.num_rows, bool)
                    keep[[m[0] for m in known.matches(part.column(part.num_columns - 1))]] = False
                    yield part.select(range(part.num_columns - 1)).filter(pa.array(keep))

        return rows.mapInArrow(clean, rows.schema)

    return reduce(run, _passes(benchmark, item_col, item_text), docs)
