"""The similarity join against all pairs, its parts by themselves, its links through ids."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import jaccard
from tests.llm import brute

COLUMNS = ("doc_id", "n_shingles", "component_id")


def joined(df, **options):
    return sorted((tuple(r[c] for c in COLUMNS) for r in jaccard.jaccard_join(df, **options).collect()), key=repr)


def by_rows(rows, n=4, percent=85):
    """All pairs of rows, rows of one id linked: {id: smallest id reachable}."""
    sets = [brute.shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0]
            if sets[a] and sets[b] and (same_id or 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if sets[k] and i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Hard texts, near copies of one text and of each other, a passage that all of a group share, stored documents."""
    rng = random.Random(4)
    base = [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).to_pylist()[:50]]
    long = base[2]
    near = [long + f" tail {k}" for k in range(5)] + [" ".join(long.split()[k:]) for k in range(1, 4)] + [long, long]
    passage = " ".join(f"p{k}" for k in range(60))
    share = [f"{passage} " + " ".join(f"own{rng.randrange(9)}" for _ in range(size)) for size in (2, 3, 3, 5, 8, 8, 40, 40, 90)]
    vocabulary = [f"v{k}" for k in range(400)]
    edited = []
    for _ in range(6):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(30, 160))]
        edited.append(" ".join(text))
        for _ in range(4):
            copy = list(text)
            for at in rng.sample(range(len(copy)), rng.randint(1, 4)):
                copy[at] = "new"
            edited.append(" ".join(copy))
    every = brute.HARD_TEXTS + base + near + share + edited + ["z " * 400_000 + "y"]
    return [*enumerate(every), (3, brute.HARD_TEXTS[3]), (None, long), (None, "alone by itself in here"), (None, None), (5, passage), (5, "another text of that id"), (900, "another text of that id")]


@pytest.mark.parametrize(("block", "tile"), [(64, 1000), (2, 3), (5, 1000)])
def test_equals_all_pairs(spark, rows, monkeypatch, block, tile):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "TILE", tile)
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, n int, block string, cid int").repartition(3)
    assert joined(docs) == by_rows(rows)
    if tile == 3:
        assert joined(docs, words=5, percent=80) == by_rows(rows, 5, 80)
    if block == 64:
        assert jaccard.jaccard_join(docs.limit(0)).count() == 0


def test_ids_with_several_texts(spark):
    a, z = " ".join(f"a{k}" for k in range(40)), " ".join(f"z{k}" for k in range(40))
    rows = [("1", a), ("1", z), ("2", a + " x"), ("3", z + " x"), ("4", "")]
    assert joined(spark.createDataFrame(rows, "doc_id string, text string")) == [("1", 37, "1"), ("1", 37, "1"), ("2", 38, "1"), ("3", 38, "1"), ("4", 0, "4")]


def test_all_stored_documents(spark):
    """Every pair of sf0.01, by an inverted index in plain Python."""
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    sets = {r["doc_id"]: brute.shingles(r["text"]) for r in docs}
    held = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        shared = {}
        for x in s:
            for j in held[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, x in shared.items():
            if 100 * x >= 85 * (len(s) + len(sets[j]) - x):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert joined(df) == sorted(((i, len(s), top(i)) for i, s in sets.items()), key=repr)


def test_components_take_few_rounds(spark, monkeypatch):
    tables = []
    real = jaccard.staged
    monkeypatch.setattr(jaccard, "staged", lambda df, name: tables.append(name) or real(df, name))
    shuffled = list(range(1000))
    random.Random(1).shuffle(shuffled)
    for ids in (list(range(1000)), shuffled):
        tables.clear()
        links = spark.createDataFrame([(min(x), max(x)) for x in zip(ids, ids[1:])] + [(2000, 2001)], "a long, b long")
        found = {r["cid"]: r["comp"] for r in jaccard.components(links).collect()}
        assert found == {k: 0 for k in range(1000)} | {2000: 2000, 2001: 2000}
        assert tables.count("components") <= 8 and len(tables) <= 45


def test_prefixes_of_similar_sets_meet():
    rng = random.Random(7)
    for _ in range(2000):
        a = set(rng.sample(range(60), rng.randint(1, 40)))
        b = {x for x in a if rng.random() > 0.1} | set(rng.sample(range(60), rng.randint(0, 4)))
        for percent in (85, 80):
            if b and 100 * len(a & b) >= percent * len(a | b):
                order = list(range(60))
                rng.shuffle(order)
                heads = [set(sorted(s, key=order.index)[: jaccard.prefix(len(s), percent)]) for s in (a, b)]
                assert heads[0] & heads[1]


def test_more_groups_keep_the_bound():
    rng = random.Random(3)
    sets = []
    for n in (1, 100, 128, 129, 300, 1000, 5000, 5000, 30_000):
        a = [rng.randrange(1 << 63) for _ in range(n)]
        sets += [a, a[n // 20 :], a[n // 3 :] + [rng.randrange(1 << 63) for _ in range(n // 3)], [rng.randrange(1 << 63) for _ in range(n)]]
    raws, sizes = [jaccard.counted(np.array(s, np.uint64)) for s in sets], np.array([len(s) for s in sets])
    a, b = (x.ravel() for x in np.indices((len(sets), len(sets))))
    points = jaccard.folded(raws, sizes)
    assert (points.sum(axis=1) == sizes).all() and points.shape[1] == jaccard.DIMS
    for percent in (80, 85):
        coarse = (100 + percent) * np.minimum(points[a], points[b]).sum(axis=1) >= percent * (sizes[a] + sizes[b])
        passed = jaccard.can_link(raws, sizes, a, b, percent, at_once=20_000)
        x = np.array([len(set(sets[i]) & set(sets[j])) for i, j in zip(a, b)])
        linked = 100 * x >= percent * (sizes[a] + sizes[b] - x)
        assert not (linked & ~passed).any() and not (passed & ~coarse).any()
        assert passed.sum() < coarse.sum()


def test_pairs_that_leave_the_trees(spark, monkeypatch):
    """Texts of about 0.7 that share their words in many blocks, of which none link: few pairs go on to be verified, and equal blocks are one."""
    made = {}
    real = jaccard.staged

    def counts(df, name):
        out = real(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "staged", counts)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(400)]
    rows = []
    for i in range(60):
        text = list(base)
        for at in rng.sample(range(400), 7):
            text[at] = f"own{i}x{at}"
        rows.append((i, " ".join(text)))
    passage = " ".join(f"p{k}" for k in range(200))
    rows += [(100 + i, f"{passage} " + " ".join(f"q{i}x{k}" for k in range(300))) for i in range(3)]
    rows += [(200 + i, " ".join(f"z{k}" for k in range(200)) + " end" * i) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs, words=5, percent=80) == by_rows(rows, 5, 80)
    assert sum(made["jaccard-near"]) < 60 * 59 // 2 // 10
    assert made["jaccard-members"][0] < made["jaccard-shared"][0]


def test_rtree_passes_all_that_the_bound_passes():
    rng = np.random.default_rng(1)
    vecs = rng.poisson(3, (300, 16)).astype(np.int32)
    vecs[150:] = vecs[:150] + (rng.random((150, 16)) < 0.1)
    vecs[7] *= 40000  # counts are not cut off
    vecs[8] = vecs[7]
    sizes = vecs.sum(axis=1, dtype=np.int64)
    for at_once in (64, 4096):
        q, at = jaccard.RTree(vecs, sizes).query(vecs, sizes, at_once=at_once)
        plain = {(k, j) for k in range(300) for j in range(300) if np.minimum(vecs[j], vecs[k]).sum() >= jaccard.needed(int(sizes[j]), int(sizes[k]))}
        assert set(zip(q.tolist(), at.tolist())) == plain and (7, 8) in plain
