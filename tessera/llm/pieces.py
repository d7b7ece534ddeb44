"""SentencePiece encoding and decoding: the N best segmentations of a text.

Forward Viterbi scores of the piece lattice are exact heuristics for a backward
A* search, which yields segmentations from best to worst. No piece holds a word
boundary mark behind another character, so the lattice falls apart into units
(marks and the word behind them), and the N best of a text are the N smallest
sums of the units' losses. ``Units`` searches the different units of a
megabyte of texts together; nothing is kept from one such slice to the next.

Scores are those of the model file's pieces. A character without a piece is
spelt in byte pieces, each ten below the lowest score. Of equal scores,
the one found first stands first; the search is deterministic.

Cases: null and empty texts have no pieces and one segmentation of score 0.
Repeated rows are encoded each on their own. Null ids are kept. A text that
holds the boundary mark itself decodes to a space there, and says so in
``round_trip``, which compares the decoded ids with the text. A very long text
is searched a chunk of its units at a time; a unit, such as a blob without
spaces, stays whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import texts
from tessera.llm.hashing import slices

MARK = "▁"
NBEST = 3
#: Bytes of texts that a worker takes at a time, and of their units that are searched together.
CHUNK = 1 << 20

_NO = object()


class Trie:
    """Pieces as bytes; steps of many walks at once through an open-addressed table of (node, byte)."""

    def __init__(self, pieces: dict[bytes, int]):
        nodes: dict[bytes, int] = {b"": 0}
        for piece in pieces:
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes))
        self.piece = np.full(len(nodes), -1, np.int32)
        for piece, i in pieces.items():
            self.piece[nodes[piece]] = i
        bits = len(nodes).bit_length() + 2
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.next = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        for head, node in nodes.items():
            if head:
                key = np.array([nodes[head[:-1]] << 8 | head[-1]])
                slot = int(self._slot(key)[0])
                while self.keys[slot] >= 0:
                    slot = (slot + 1) & self.mask
                self.keys[slot], self.next[slot] = key[0], node

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next nodes; -1: no piece goes on so."""
        key = node.astype(np.int64) << 8 | byte
        slot = self._slot(key)
        met = self.keys[slot]
        todo = np.flatnonzero((met != key) & (met >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            met = self.keys[slot[todo]]
            todo = todo[(met != key[todo]) & (met >= 0)]
        return np.where(self.keys[slot] == key, self.next[slot], -1)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... (sizes[k] numbers), one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Units:
    """The lattices of the different units of some texts, side by side in one array of bytes, searched together.

    The same search as ``Pieces.search``: forward Viterbi goes through the
    places of all lattices by their distance from the unit's beginning; backward A* pops, in each
    round, the best hypothesis of every unit and follows its best extension.
    Only the n best edges into a place can matter.
    """

    def __init__(self, model: Pieces, raw: np.ndarray, at: np.ndarray, n: int):
        self.model, self.raw, self.at, self.n = model, raw, at, n
        size = len(raw)
        groups = self._edges(np.repeat(at[1:], np.diff(at)))
        # A place is the byte before it; places of one distance stand together, the longest edge into a place first.
        distance = np.arange(size) - np.repeat(at[:-1], np.diff(at))
        if size and distance.max() < 1 << 16:
            distance = distance.astype(np.uint16)
        by_distance = np.argsort(distance, kind="stable")
        into = np.zeros(size, np.int32)
        for length, p, _ in groups:
            into[p + (length - 1)] += 1
        ends = np.cumsum(into[by_distance])
        self.total, self.p, self.id, self.w = (np.empty(int(ends[-1]) if size else 0, t) for t in (np.float64, np.int32, np.int32, np.float64))
        slot = np.empty(size, np.int32)
        slot[by_distance] = ends - into[by_distance]
        for length, p, ids in groups:  # of one length a place has one edge
            place = p + (length - 1)
            here = slot[place]
            slot[place] += 1
            self.p[here], self.id[here] = p, -1 if ids is None else ids
            self.w[here] = model.byte_score * length if ids is None else model.score[ids]
        reached = by_distance[into[by_distance] > 0]
        heads = np.r_[0, np.cumsum(into[reached])]
        steps = np.r_[np.flatnonzero(np.r_[True, np.diff(distance[reached].astype(np.int64)) != 0]), len(reached)] if size else np.zeros(1, np.int64)
        begins = np.zeros(size, bool)
        begins[at[:-1]] = True
        source = np.where(begins[self.p], size, self.p - 1)
        self.value = np.zeros(size + 1)  # best score up to a place; the last one stands for all beginnings
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            lo, hi = heads[a], heads[b]
            x = self.value[source[lo:hi]] + self.w[lo:hi]
            self.total[lo:hi] = x
            self.value[reached[a:b]] = np.maximum.reduceat(x, heads[a:b] - lo)
        self._ranked(heads, reached)

    def _edges(self, stop: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
        """(length, beginnings, pieces or None for characters without one), longest first."""
        raw, trie = self.raw, self.model.trie
        starts = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32)
        width = np.diff(np.r_[starts, len(raw)])
        wide = np.zeros(len(raw), np.int32)
        wide[starts] = width
        single = np.zeros(len(raw), bool)
        place, node, k = starts, np.zeros(len(starts), np.int32), 0
        groups: list[tuple[int, np.ndarray, np.ndarray | None]] = []
        while len(place):
            node = trie.step(node, raw[place + k])
            k += 1
            on = node >= 0
            place, node = place[on], node[on]
            found = trie.piece[node]
            hit = found >= 0
            here = place[hit]
            groups.append((k, here, found[hit]))
            single[here[wide[here] == k]] = True
            on = place + k < stop[place]
            place, node = place[on], node[on]
        odd = ~single[starts]
        for size in np.unique(width[odd]).tolist():
            groups.append((size, starts[odd & (width == size)], None))
        return sorted(groups, key=lambda x: -x[0])

    def _ranked(self, heads: np.ndarray, places: np.ndarray) -> None:
        """edge[r, place]: the edge of rank r into a place, or -1; of equal ones, the longest first."""
        left = self.total if self.n == 1 else self.total.copy()
        group = np.repeat(np.arange(len(places), dtype=np.int32), np.diff(heads))
        self.edge = np.full((self.n, len(self.raw)), -1, np.int32)
        top = self.value[places]
        for r in range(self.n if len(places) else 0):
            hit = np.flatnonzero((left == top[group]) & (left > -np.inf))
            g = group[hit]
            first = np.r_[True, g[1:] != g[:-1]] if len(hit) else np.zeros(0, bool)
            self.edge[r, places[g[first]]] = hit[first]
            if r + 1 < self.n:
                left[hit[first]] = -np.inf
                top = np.maximum.reduceat(left, heads[:-1])

    def _walk(self, unit: np.ndarray, place: np.ndarray, rank: np.ndarray, g: np.ndarray) -> list:
        """Follows hypotheses (edge of a rank into a place, score g of what stands behind it) to the beginnings; pushes their siblings; their edges."""
        path = []
        while len(unit):
            if self.n > 1:
                after = self.edge[np.minimum(rank + 1, self.n - 1), place]
                able = np.flatnonzero((after >= 0) & (rank + 1 < self.n))
                self._push(unit[able], self.total[after[able]] + g[able], (place[able], rank[able] + 1, g[able]))
            e = self.edge[rank, place]
            path.append((unit, e))
            on = self.p[e] > self.at[unit]
            unit, e, g = unit[on], e[on], g[on]
            place, rank, g = self.p[e] - 1, np.zeros(len(e), np.int64), g + self.w[e]
        return path

    def _push(self, unit: np.ndarray, total: np.ndarray, hypothesis: tuple) -> None:
        """Into the units' heaps, of which each keeps as many as can still be popped; no unit twice in one call."""
        ref = self.pushed + np.arange(len(unit))
        self.pushed += len(unit)
        self.hypotheses.append(hypothesis)
        for r in range(self.n - 1):
            old, old_ref = self.heap[r][unit], self.heap_ref[r][unit]
            better = total > old
            self.heap[r][unit], self.heap_ref[r][unit] = np.where(better, total, old), np.where(better, ref, old_ref)
            total, ref = np.where(better, old, total), np.where(better, old_ref, ref)

    def search(self) -> np.ndarray:
        """scores[unit, r], -inf where there are fewer; ``ids``, ``ids_at``: pieces of the best."""
        count = len(self.at) - 1
        scores = np.full((count, self.n), -np.inf)
        scores[:, 0] = self.value[self.at[1:] - 1]
        self.heap, self.heap_ref, self.pushed, self.hypotheses = [np.full(count, -np.inf) for _ in range(self.n - 1)], [np.zeros(count, np.int64) for _ in range(self.n - 1)], 0, []
        self._best_ids(self._walk(np.arange(count), self.at[1:] - 1, np.zeros(count, np.int64), np.zeros(count)))
        for r in range(1, self.n):
            unit = np.flatnonzero(self.heap[0] > -np.inf)
            scores[unit, r] = self.heap[0][unit]
            if r + 1 == self.n or not len(unit):
                break
            self.hypotheses = [tuple(np.concatenate(x) for x in zip(*self.hypotheses, strict=True))]
            popped = [x[self.heap_ref[0][unit]] for x in self.hypotheses[0]]
            self.heap = [*self.heap[1:], np.full(count, -np.inf)]
            self.heap_ref = [*self.heap_ref[1:], np.zeros(count, np.int64)]
            self._walk(unit, *popped)
        return scores

    def _best_ids(self, path: list) -> None:
        unit, edge = (np.concatenate(x[::-1]) for x in zip(*path, strict=True)) if path else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(unit, kind="stable")
        unit, edge = unit[order], edge[order]
        ids = self.id[edge]
        size = np.where(ids >= 0, 1, np.r_[self.p[edge][1:], 0] - self.p[edge])
        last = np.r_[unit[1:] != unit[:-1], True] if len(unit) else np.zeros(0, bool)
        size[last] = np.where(ids[last] >= 0, 1, self.at[1:][unit[last]] - self.p[edge[last]])
        self.ids = np.repeat(ids, size).astype(np.int32)
        odd = ids < 0
        self.ids[self.ids < 0] = self.model.byte_id[self.raw[spread(self.p[edge[odd]], size[odd])]]
        self.ids_at = np.r_[0, np.cumsum(np.bincount(unit, size, len(self.at) - 1).astype(np.int64))]


def cut(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(units of all texts in order, their marks as spaces; offsets: text k has units offsets[k] to offsets[k + 1])."""
    blank = pa.scalar(" ", pa.large_string())
    marked = pc.replace_substring(column.cast(pa.large_string()), MARK, " ")
    marked = pc.if_else(pc.equal(pc.binary_length(marked), 0), marked, pc.binary_join_element_wise(blank, marked, pa.scalar("", pa.large_string())))
    n = len(marked)
    _, offsets, data = marked.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, marked.offset * 8) if n else np.zeros(1, np.int64)
    size = int(ends[-1] - ends[0])
    raw = np.frombuffer(data, np.uint8, size, int(ends[0])) if size else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    space = raw == 32
    first = space & np.r_[True, ~space[:-1]] if size else space
    first[ends[:-1][ends[:-1] < ends[1:]]] = True
    at = np.r_[np.flatnonzero(first), size]
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
    return units, np.searchsorted(at, ends)


@dataclass
class Found:
    """The different units of some texts: N best scores, pieces of the best; and where the units stand."""

    scores: np.ndarray
    ids: np.ndarray
    ids_at: np.ndarray
    which: np.ndarray
    offsets: np.ndarray

    def encoded(self) -> tuple[np.ndarray, np.ndarray]:
        """(best ids of all texts, their offsets)"""
        size = np.diff(self.ids_at)[self.which]
        return self.ids[spread(self.ids_at[self.which], size)], np.r_[0, np.cumsum(size)][self.offsets]


def searched(model: Pieces, column: pa.Array, n: int) -> Found:
    """Searches the lattices of at most about ``CHUNK`` bytes of units at a time, however long the texts are."""
    units, offsets = cut(column)
    coded = pc.dictionary_encode(units)
    kinds, which = coded.dictionary, coded.indices.to_numpy()
    at = np.frombuffer(kinds.buffers()[1], np.int64, len(kinds) + 1) if len(kinds) else np.zeros(1, np.int64)
    raw = np.frombuffer(kinds.buffers()[2], np.uint8, int(at[-1])) if len(kinds) else np.zeros(0, np.uint8)
    scores, ids, sizes, start = [np.zeros((0, n))], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
    while start < len(kinds):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + CHUNK, "right")) - 1)
        lattices = Units(model, raw[at[start] : at[stop]], at[start : stop + 1] - at[start], n)
        scores.append(lattices.search())
        ids.append(lattices.ids)
        sizes.append(np.diff(lattices.ids_at))
        start = stop
    return Found(np.concatenate(scores), np.concatenate(ids), np.cumsum(np.concatenate(sizes)), which, offsets)


def decoded(model: Pieces, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Texts of the ids between the offsets. Control pieces and ids outside the vocabulary are nothing; bytes that are no UTF-8 become U+FFFD."""
    valid = (ids >= 0) & (ids < len(model.spelt_size))
    ids = np.where(valid, ids, 0)
    size = np.where(valid, model.spelt_size[ids], 0)
    raw = model.spelt[spread(model.spelt_at[ids], size)].tobytes()
    ends = np.r_[0, np.cumsum(size)][at].tolist()
    return pa.array([raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def digests(model: Pieces, column: pa.Array, n: int) -> dict[str, pa.Array]:
    found = searched(model, column, n)
    ids, at = found.encoded()
    which, scores, count = found.which, found.scores, len(column)
    owner = np.repeat(np.arange(count), np.diff(found.offsets))
    best = np.bincount(owner, scores[which, 0], count)
    # Of a text only the n - 1 units whose second best costs least can matter.
    losses = scores[:, :1] - scores
    near = np.flatnonzero(np.isfinite(losses[which, 1])) if n > 1 else np.zeros(0, np.int64)
    near = near[np.lexsort((losses[which[near], 1], owner[near]))] if len(near) else near
    bound = np.searchsorted(owner[near], np.arange(count + 1))
    sums = []
    for k in range(count):
        rows = losses[which[near[bound[k] : min(bound[k] + n - 1, bound[k + 1])]], 1:].tolist()
        sums.append([float(best[k]) - x for x, _ in model._losses([tuple(x for x in r if x < np.inf) for r in rows], n)])
    whole = ids.astype("<u4").tobytes()
    shas = [hashlib.sha256(whole[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    same = pc.equal(decoded(model, ids, at), column.cast(pa.string()))
    return {"n_pieces": pa.array(np.diff(at), pa.int64()), "best_score": pa.array(best, pa.float64()), "nbest_scores": pa.array(sums, pa.list_(pa.float64())), "ids_sha256": pa.array(shas, pa.string()), "round_trip": same}


class Pieces:
    UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __init__(self, path: str, nbest: int = NBEST):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.nbest = nbest
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.value = {i: b for b, i in self.bytes.items()}
        self.scores = [model.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        if any(MARK in p[1:] and p.strip(MARK) for p in self.ids):
            raise ValueError("a piece holds a boundary mark inside; units are not independent")
        self.weight = {p: self.scores[i] for p, i in self.ids.items()}
        self.byte_score = min(self.scores[i] for i in plain if self.scores[i] > -1e8) - 10.0
        self.trie = Trie({p.replace(MARK, " ").encode(): i for p, i in self.ids.items()})
        self.score = np.array(self.scores)
        self.byte_id = np.array([self.bytes.get(b, 0) for b in range(256)])
        shown = set(plain)
        spelt = [bytes([self.value[i]]) if i in self.value else p.replace(MARK, " ").encode() if i in shown else b"" for i, p in enumerate(self.pieces)]
        self.spelt_size = np.array([len(x) for x in spelt])
        self.spelt_at = np.cumsum(self.spelt_size) - self.spelt_size
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)

    @cached_property
    def starts(self):
        """Every beginning of a piece: its score if it is one, else None. Only the plain search needs it."""
        heads: dict[str, float | None] = {p[:k]: None for p in self.ids for k in range(1, len(p))}
        heads.update(self.weight)
        return heads.get

    def search(self, s: str, n: int | None = None) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one unit, best first.

        ``best``: forward scores of all prefixes; ``edges``: per node, minus the exact best score of a path
        by the edge, and its start. A popped hypothesis pushes its next
        sibling and follows its best extension, so the heap stays small.
        """
        n = n or self.nbest
        starts, size = self.starts, len(s)
        best = [-1e30] * (size + 1)
        best[0] = 0.0
        edges: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            b, k = best[i], i + 1
            if s[i] not in self.weight:
                x = b + self._spelt(s[i])
                edges[k].append((-x, i))
                if x > best[k]:
                    best[k] = x
            while k <= size:
                w = starts(s[i:k], _NO)
                if w is not None:
                    if w is _NO:  # no piece starts so
                        break
                    x = b + w
                    edges[k].append((-x, i))
                    if x > best[k]:
                        best[k] = x
                k += 1
        out: list[tuple[float, tuple[int, ...]]] = []
        # (-(exact best of a path by this edge and suffix), newest first, place, rank of the edge there, -(suffix score), linked suffix)
        heap: list[tuple] = [(-best[-1], 0, size, 0, 0.0, None)]
        made = 0
        pop, push = heapq.heappop, heapq.heappush
        ordered = [False] * (size + 1)
        while heap:
            _, _, at, rank, g, suffix = pop(heap)
            while True:
                here = edges[at]
                if not ordered[at]:
                    here.sort()
                    ordered[at] = True
                if rank + 1 < len(here):
                    made -= 1
                    push(heap, (g + here[rank + 1][0], made, at, rank + 1, g, suffix))
                cost, j = here[rank]
                g += cost + best[j]
                suffix = (j, suffix)
                if not j:
                    break
                at, rank = j, 0  # the best extension is the next to be popped, or ties with it
            ids: list[int] = []
            while suffix is not None:
                j, suffix = suffix
                t = s[j : suffix[0] if suffix else len(s)]
                if t in self.ids:
                    ids.append(self.ids[t])
                else:
                    ids += (self.bytes[b] for b in t.encode())
            out.append((-g, tuple(ids)))
            if len(out) == n:
                break
        return out

    def _spelt(self, ch: str) -> float:
        return self.byte_score * len(ch.encode())

    def units(self, text: str) -> list[str]:
        return self.UNIT.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return self.nbest_encode(text, 1)[0][1]

    def nbest_encode(self, text: str, n: int | None = None) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text with their scores, best first."""
        n = n or self.nbest
        parts = [self.search(u, n) for u in self.units(text)]
        out = []
        for loss, chosen in self._losses([tuple(p[0][0] - x for x, _ in p[1:]) for p in parts], n):
            ids = [i for k, p in enumerate(parts) for i in p[chosen.get(k, 0)][1]]
            out.append((sum(p[0][0] for p in parts) - loss, ids))
        return out

    @staticmethod
    def _losses(losses: list[tuple[float, ...]], n: int) -> list[tuple[float, dict[int, int]]]:
        """The n smallest sums of one loss a unit (0: its best): only the n - 1 units whose second best costs least can matter."""
        able = heapq.nsmallest(n - 1, ((x[0], k) for k, x in enumerate(losses) if x))
        sums: list[tuple[float, dict[int, int]]] = [(0.0, {})]
        for _, k in able:
            grown = [(a + d, c | ({k: r} if r else {})) for a, c in sums for r, d in enumerate((0.0, *losses[k]))]
            sums = sorted(grown, key=lambda x: (x[0], sorted(x[1].items())))[:n]
        return sums

    def _join(self, ids) -> str:
        """Pieces back to marked text; runs of byte pieces are UTF-8."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.value:
                raw.append(self.value[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[i])
        return "".join(out) + raw.decode("utf-8", "replace")

    def decode(self, ids) -> str:
        return self._join(ids).replace(MARK, " ").removeprefix(" ")


_models: dict[tuple[str, int], Pieces] = {}


def pieces(path: str, nbest: int = NBEST) -> Pieces:
    """One model for each worker."""
    if (path, nbest) not in _models:
        _models[path, nbest] = Pieces(path, nbest)
    return _models[path, nbest]


DIGEST = "n_pieces long, best_score double, nbest_scores array<double>, ids_sha256 string, round_trip boolean"


def piece_digest(docs: DataFrame, path: str, nbest: int = NBEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of pieces, scores of the N best, SHA-256 of the best ids (32-bit little-endian), whether they decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, nbest)
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                yield pa.record_batch({"doc_id": part.column(0)} | digests(model, part.column(1), nbest))

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {DIGEST}")


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_pieces) per row: the best segmentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                found, ends = searched(model, part.column(1), 1).encoded()
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))
                yield pa.record_batch({"doc_id": part.column(0), "ids": ids, "n_pieces": pa.array(np.diff(ends).astype(np.int64))})

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_pieces long")


def decode_table(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) per row of piece ids: the inverse of ``encode_table``. Null ids give the empty text, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            lists = batch.column(1).cast(pa.list_(pa.int64()))
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]
            yield pa.record_batch({"doc_id": batch.column(0), "text": decoded(model, ids, at)})

    rows = rows.select(rows[id_col].alias("doc_id"), rows[ids_col].alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
