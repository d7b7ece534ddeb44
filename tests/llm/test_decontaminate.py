"""Decontamination: recall on edited copies of the stored items, the index by brute force, odd tables."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tessera.llm import decontaminate
from tessera.llm.hashing import ALNUM, mix, runs, word_hashes

SF = "/root/testdata/sf0.1"


def test_recall_on_edited_copies_of_stored_items():
    """Against an exhaustive search of all runs of the document, for copies with up to three edited words."""
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    rng = random.Random(9)
    words = [w for r in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).to_pylist()[:300] for w in (r["text"] or "").split()]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    texts, want = [], set()
    for i, text in items:
        kinds, counts = decontaminate.Items([(i, text)]).shingles[0]
        for edits in (0, 1, 1, 2, 3):
            copy = text.split()
            for _ in range(edits):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([some(1), [], [copy[at], *some(1)]])
            texts.append(" ".join([*some(rng.randint(0, 60)), *copy, *some(rng.randint(0, 60))]))
            h, _ = word_hashes(pa.array(texts[-1:], pa.large_string()), ALNUM)
            if decontaminate.best_run(runs(mix(h), decontaminate.SHINGLE), kinds, counts):
                want.add((len(texts) - 1, i))
    found = {m[:2] for m in decontaminate.Items(items).matches(pa.array(texts, pa.large_string()))}
    assert len(want) > 300 and len(want & found) >= 0.9 * len(want)
    assert want <= found  # in fact none is missed


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    held = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    asked = held.copy()
    for k in range(len(asked)):
        for bit in rng.integers(0, 64, k % 7):
            asked[k] ^= np.uint64(1) << np.uint64(bit)
    found = set(zip(*(x.tolist() for x in decontaminate.HammingIndex(held).near(asked))))
    assert found == {(a, b) for a in range(300) for b in range(300) if int(asked[a] ^ held[b]).bit_count() <= decontaminate.RADIUS}


def test_fingerprints_are_majorities_of_bits():
    h = np.random.default_rng(4).integers(0, 1 << 64, 90, dtype=np.uint64)
    h[20:60] = h[20]
    for size in decontaminate.SIZES:
        starts = np.arange(len(h) - size + 1)
        plain = [sum(1 << bit for bit in range(64) if 2 * sum(int(x) >> bit & 1 for x in h[a : a + size]) > size) for a in starts.tolist()]
        assert decontaminate.simhash(h, starts, size).tolist() == plain


def test_words_are_not_spread_into_counters_of_bits():
    """Bytes that a text takes while it is matched, which 64 counters a word made 600 and more."""
    text = pa.array([" ".join(f"w{k % 5000}" for k in range(100_000))], pa.large_string())
    items = decontaminate.Items([("i", " ".join(f"i{k}" for k in range(60)))])
    tracemalloc.start()
    items.matches(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * 100_000


def test_windows_lie_within_every_stretch():
    for words in [*range(1, 130), 400, 2000]:
        clean, (size, step) = decontaminate.stretch(words), decontaminate.window(words)
        assert 1 <= size <= clean <= words and step >= 1 and size + step - 1 <= clean


def test_odd_tables(spark):
    item = "the seven lamps were lit before the old gate and nobody saw who had done it"
    rows = [("d1", f"x y {item.upper()} z"), ("d1", f"x y {item.upper()} z"), (None, f"{item}. {item}"), ("d2", None), ("d3", ""), ("d4", "w " * 300_000 + item), ("d5", "lit before the old gate")]
    docs = spark.createDataFrame([(*r, "i", 0.5, 3) for r in rows], "doc_id string, text string, item_id string, similarity double, n_words int")
    bench = spark.createDataFrame([("i1", item, "a"), ("i1", "another text of that item, so it is", "a"), ("i2", "", "a"), ("i3", None, "a")], "item_id string, text string, doc_id string")
    out = [tuple(r) for r in decontaminate.decontaminate(docs, bench).collect()]
    n = len(item.split())
    assert sorted(out, key=repr) == sorted([("d1", "i1", 2, n, 1.0), ("d1", "i1", 2, n, 1.0), (None, "i1", 0, n, 1.0), ("d4", "i1", 300_000, n, 1.0)], key=repr)
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
