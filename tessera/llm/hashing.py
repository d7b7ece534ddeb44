"""Words of whole batches of texts as 64-bit hashes, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_C1, _C2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def _table(blank) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(blank)] = 32
    return t


#: A-Z to a-z; words end at white space, or at any ASCII character that is no letter or digit.
SPACED = _table((9, 10, 11, 12, 13, 32))
ALNUM = _table(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


def mix(x: np.ndarray) -> np.ndarray:
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, offsets: text k has words offsets[k] to offsets[k + 1]). No nulls."""
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    size = int(at[-1] - at[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    raw = np.zeros(size + 8, np.uint8)
    raw[:size] = table[np.frombuffer(data, np.uint8, size, int(at[0]))]
    at = at - at[0]
    solid = raw[:size] != 32
    edge = np.zeros(size + 1, bool)
    edge[at] = True
    before = np.r_[False, solid[:-1]]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.r_[solid[1:], False]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    lanes = np.ndarray((size + 1,), np.dtype("<u8"), raw.data, 0, (1,))
    length = ends - starts
    h = length.astype(np.uint64)
    todo, first = None, True
    k = 0
    while True:
        left = (length if first else length[todo]) - 8 * k
        if not first:
            todo, left = todo[left > 0], left[left > 0]
            if not len(todo):
                break
        s = starts if first else starts[todo]
        lane = lanes[s + 8 * k] & _MASKS[np.minimum(left, 8)]
        if first:
            h = mix(h ^ lane)
            todo, first = np.flatnonzero(length > 8), False
        else:
            h[todo] = mix(h[todo] ^ lane)
        k += 1
    return h, np.searchsorted(starts, at).astype(np.int64)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n hashes from each position on (the last n - 1 positions are cut off)."""
    size = len(h) - n + 1
    out = h[:size].copy()
    for k in range(1, n):
        out = mix(out) ^ h[k : k + size]
    return mix(out)


def slices(batch: pa.RecordBatch | pa.Table, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Parts of a batch with about ``limit`` bytes of text each; a longer text is a part of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    start, base = 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(sizes[stop - 1])
