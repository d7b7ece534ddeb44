"""N-gram Jaccard join by count vectors.

A document's shingles are hashed into ``DIMS`` groups; the group counts are a
point, and the sum of the smaller coordinates of two points bounds the overlap
of their sets. R-trees over such points find the pairs that can reach the
threshold, and the pairs are verified on the sets. In few groups any two long sets are alike, and texts
that are not quite near copies: so sets of over ``FULL`` shingles a group are counted in more groups, of which the
point is the fold, and pairs leave a tree only if they pass the bound by these too.

No task sees all points. Documents with one set are one class, of which only
the first is compared. Classes meet in blocks, one for each shingle of their
prefixes: of two sets at the threshold, those parts of either that stand first in one order of all
shingles, and are one larger than what the other may lack, have a shingle in common. So every
pair meets, whatever the order. The order is by hash, but shingles whose block
would have over ``BLOCK`` classes come last: only classes that have next to nothing else go to these
hot blocks. Of blocks with the same classes one is left: all shingles of a shared passage
make the same pairs.

First each class is held against the first of its blocks, which links the
copies of one text in linear time. Then the blocks that still hold several
components get R-trees, queried for partners in other components only: one for a block of
moderate size; for a hot block one for each tile of at most ``TILE`` points of about one size
and ``TILE`` classes that ask, which are those outside the component of its first.

Cases: texts without words have the empty set and link with nothing; fewer words than a shingle are
one shingle. Repeated rows are one class. Rows that repeat an id with other texts are linked by it. A null id links through its text's
other ids, else its component is null. Ids may be of any type with an order. An empty table gives an empty result. A very long text is one point whose
counts are exact, and its set is held by one task. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import dropped, small, staged, texts
from tessera.llm.hashing import mix, runs, slices, word_hashes

WORDS, PERCENT = 4, 85
DIMS, BLOCK, TILE, LEAF = 128, 64, 1000, 16
#: Shingles a group from which a set has twice as many groups, and most groups.
FULL, MOST_DIMS = 1, 4096


def shingle_sets(column: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's set of shingle hashes, sorted."""
    h, at = word_hashes(column)
    every = runs(h, n) if len(h) >= n else np.zeros(0, np.uint64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        elif b > a:
            yield mix(runs(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def class_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, with their size."""
    if not len(s):
        return 0, 0
    return int(np.bitwise_xor.reduce(mix(s)).view(np.int64)), int(mix(s + np.uint64(7)).sum(dtype=np.uint64).view(np.int64))


def ordered(s: np.ndarray) -> np.ndarray:
    """A set's shingles by a second hash, so that blocks and groups are independent, as signed numbers in order."""
    return np.sort((mix(s ^ np.uint64(0xA5A5)) ^ np.uint64(1 << 63)).view(np.int64))


def prefix(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of ``n`` of which one at least is in any other set's prefix if the two reach the threshold."""
    return n - -(-percent * n // 100) + 1 if n else 0


def dims(n: np.ndarray | int) -> np.ndarray:
    """Groups that sets of ``n`` shingles are counted in."""
    out = np.full(np.shape(n), DIMS)
    while (more := (out * FULL < n) & (out < MOST_DIMS)).any():
        out = np.where(more, 2 * out, out)
    return out


def counted(s: np.ndarray) -> bytes:
    """A set's group counts as one byte a count if all fit, else four."""
    size = int(dims(len(s)))
    counts = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else "<i4").tobytes()


def folded(raws: list[bytes], sizes: np.ndarray, to: int = DIMS) -> np.ndarray:
    """Counts of sets of these sizes, in ``to`` groups, which all have at least."""
    out = np.empty((len(raws), to), np.int32)
    for k, (raw, own) in enumerate(zip(raws, dims(sizes).tolist(), strict=True)):
        out[k] = np.frombuffer(raw, np.uint8 if len(raw) == own else "<i4").reshape(-1, to).sum(axis=0, dtype=np.int64)
    return out


def can_link(raws: list[bytes], sizes: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT, at_once: int = 1 << 20) -> np.ndarray:
    """Which pairs of rows pass the bound by all groups that both are counted in."""
    own = dims(sizes)
    level = np.minimum(own[a], own[b])
    fits = np.zeros(len(a), bool)
    for to in np.unique(level).tolist():
        pairs = np.flatnonzero(level == to)
        rows, at = np.unique(np.r_[a[pairs], b[pairs]], return_inverse=True)
        counts, x, y = folded([raws[k] for k in rows.tolist()], sizes[rows], to), at[: len(pairs)], at[len(pairs) :]
        step = max(1, at_once // to)
        for i in range(0, len(pairs), step):
            part = pairs[i : i + step]
            overlap = np.minimum(counts[x[i : i + step]], counts[y[i : i + step]]).sum(axis=1, dtype=np.int64)
            fits[part] = (100 + percent) * overlap >= percent * (sizes[a[part]] + sizes[b[part]])
    return fits


def features(rows: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document; sketch: its prefix and half as many shingles behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column(1), words))
                sizes = [prefix(len(s), percent) for s in sets]
                keys = [class_key(s) for s in sets]
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0), "rid": part.column(2), "n": pa.array([len(s) for s in sets], pa.int64()), "p": pa.array(sizes, pa.int32()),
                        "key1": pa.array([k[0] for k in keys], pa.int64()), "key2": pa.array([k[1] for k in keys], pa.int64()),
                        "vec": pa.array([counted(s) for s in sets], pa.binary()),
                        "sketch": pa.array([ordered(s)[: p + p // 2 + 8] for s, p in zip(sets, sizes, strict=True)], pa.list_(pa.int64())),
                    }
                )

    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rid long, n long, p int, key1 long, key2 long, vec binary, sketch array<long>")


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """Least overlap of sets of these sizes at the threshold: 100 x >= percent (a + b - x)."""
    return -((-percent * (a + b)) // (100 + percent))


class RTree:
    """Static R-tree over count vectors, packed by sorting; nodes keep coordinate maxima and the range of sizes.

    A node can hold a partner of a query only if the sum of the smaller of the
    query's coordinates and the node's maxima reaches the least overlap.
    """

    def __init__(self, vecs: np.ndarray, sizes: np.ndarray):
        # Order by size, then by the coordinates that vary most, so that nodes are tight.
        spread = np.argsort(-vecs.var(axis=0), kind="stable")[:4]
        self.order = np.lexsort((*(vecs[:, d] for d in spread[::-1]), (np.log2(np.maximum(sizes, 1)) * 8).astype(np.int64)))
        self.vecs, self.sizes = vecs[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high = self.vecs, self.sizes, self.sizes
        while len(top) > 1 or not self.levels:
            cuts = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def query(self, vecs: np.ndarray, sizes: np.ndarray, percent: int = PERCENT, at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all points that pass the bound, for many queries: their ways down the tree are taken together."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(len(self.levels) - 1, np.arange(len(sizes)), np.zeros(len(sizes), np.int64))]
        while todo:
            k, q, at = todo.pop()
            if len(q) > at_once:
                todo += [(k, q[i : i + at_once], at[i : i + at_once]) for i in range(0, len(q), at_once)]
                continue
            top, low, high = self.levels[k] if k >= 0 else (self.vecs, self.sizes, self.sizes)
            fits = (low[at] * percent <= 100 * sizes[q]) & (high[at] * 100 >= percent * sizes[q])
            q, at = q[fits], at[fits]
            # The least overlap that any size in the node's range asks for.
            least = needed(np.maximum(low[at], -(-percent * sizes[q] // 100)), sizes[q], percent)
            fits = np.minimum(top[at], vecs[q]).sum(axis=1) >= least
            q, at = q[fits], at[fits]
            if k < 0:
                found.append((q, self.order[at]))
            elif len(q):
                below = len(self.levels[k - 1][0]) if k else len(self.sizes)
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                q = np.repeat(q, LEAF)
                todo.append((k - 1, q[at < below], at[at < below]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _tree_join(table: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Pairs that pass the bound and are not known to be linked, for each tree of the table; queries: rows marked so, points: the rows marked so."""
    trees, ids, sizes, comp = (table[x].to_numpy() for x in ("tree", "cid", "n", "comp"))
    asks, holds = (table[x].to_numpy(zero_copy_only=False) for x in ("asks", "holds"))
    raws = table["vec"].to_pylist()
    vecs = folded(raws, sizes)
    order = np.argsort(trees, kind="stable")
    pairs = [np.zeros((0, 2), np.int64)]
    for rows in np.split(order, np.flatnonzero(np.diff(trees[order])) + 1):
        points, queries = rows[holds[rows]], rows[asks[rows]]
        if len(points) and len(queries):
            q, at = RTree(vecs[points], sizes[points]).query(vecs[queries], sizes[queries], percent)
            a, b = queries[q], points[at]
            other = comp[a] != comp[b]
            a, b = a[other], b[other]
            other = can_link(raws, sizes, a, b, percent)
            a, b = ids[a[other]], ids[b[other]]
            pairs.append(np.c_[np.minimum(a, b), np.maximum(a, b)])
    every = np.unique(np.concatenate(pairs), axis=0)
    return pa.table({"a": pa.array(every[:, 0]), "b": pa.array(every[:, 1])})


class _Classes:
    """The classes of a table: staged points, and their sets made again from the texts that are asked for."""

    def __init__(self, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str):
        self.rows, self.words, self.percent = texts(docs, id_col, text_col), words, percent
        made = staged(features(self.rows, words, percent), "jaccard-features")
        self.every = staged(made.select("doc_id", "rid", "n", "key1", "key2"), "jaccard-rows")
        # A class is named by its first row's number; it is found again by its key.
        named = self.every.where("n > 0").groupBy("key1", "key2", "n").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("rep"))
        self.named = staged(named, "jaccard-classes")
        firsts = self.named.where("rep is not null").select("cid", "rep")
        self.sketches = staged(made.join(small(firsts, 16), F.col("rid") == F.col("cid")).select("cid", "n", "p", "vec", "sketch"), "jaccard-sketches")
        dropped(made)
        self.points = staged(self.sketches.select("cid", "n", "vec"), "jaccard-points")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(cid, n, p, s) of the classes wanted (cid)."""
        asked = staged(self.named.join(small(wanted.distinct(), 16), "cid", "left_semi"), "jaccard-asked")
        reps = asked.select(F.col("rep").alias("_rep")).distinct()
        rows = self.rows.join(small(reps, 16), F.col("doc_id") == F.col("_rep"), "left_semi").select("text")
        words, percent = self.words, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    sets = list(shingle_sets(part.column(0), words))
                    keys = [class_key(s) for s in sets]
                    yield pa.record_batch(
                        {
                            "k1": pa.array([k[0] for k in keys], pa.int64()), "k2": pa.array([k[1] for k in keys], pa.int64()), "size": pa.array([len(s) for s in sets], pa.int64()),
                            "p": pa.array([prefix(len(s), percent) for s in sets], pa.int32()), "s": pa.array([ordered(s) for s in sets], pa.list_(pa.int64())),
                        }
                    )

        made = rows.mapInArrow(run, "k1 long, k2 long, size long, p int, s array<long>")
        same = (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")) & (F.col("n") == F.col("size"))
        out = staged(made.join(small(asked.drop("rep"), 48), same).select("cid", "n", "p", "s"), "jaccard-sets")
        # Only rows that repeat an id and its text make a class's set twice.
        if out.groupBy("cid").count().where("count > 1").isEmpty():
            dropped(asked)
            return out
        once = staged(out.dropDuplicates(["cid"]), "jaccard-sets-once")
        dropped(asked, out)
        return once

    def verified(self, pairs: DataFrame, bounded: bool = False) -> DataFrame:
        """Pairs of classes (a, b) that reach the threshold: by the bound of their counts unless ``bounded``, by a finer bound, then by their sets."""
        percent = self.percent
        side = lambda x: self.points.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("vec").alias(f"v{x}"))

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, na, nb = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("a", "b", "na", "nb"))
                raws = [raw for x in ("va", "vb") for raw in batch.column(batch.schema.get_field_index(x)).to_pylist()]
                fits = can_link(raws, np.r_[na, nb], np.arange(len(a)), len(a) + np.arange(len(a)), percent)
                yield pa.record_batch({"a": pa.array(a[fits]), "b": pa.array(b[fits])})

        near = pairs if bounded else pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(bound, "a long, b long")
        near = staged(near, "jaccard-near")
        sets = self.sets(near.select(F.explode(F.array("a", "b")).alias("cid")))
        # Long texts pass the points' bound by chance, and their sets are large: first by finer groups, of two bytes a shingle. A group
        # that only one of two sets has counts against that set's part of the overlap.
        fine = sets.select("cid", F.transform("s", lambda x: F.shiftright(x, 48).cast("short")).alias("f"))
        part = lambda n, x, y: F.col(n) - F.size(F.array_except(x, y))
        of = lambda x: fine.select(F.col("cid").alias(x), F.size("f").cast("long").alias(f"n{x}"), F.col("f").alias(f"f{x}"))
        least = (100 + percent) * F.least(part("na", "fa", "fb"), part("nb", "fb", "fa")) >= percent * (F.col("na") + F.col("nb"))
        closer = staged(near.join(of("a"), "a").join(of("b"), "b").where(least).select("a", "b"), "jaccard-closer")
        dropped(near)
        both = closer.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
        both = both.withColumn("x", F.size(F.array_intersect("sa", "sb")))
        linked = both.where(100 * F.col("x") >= percent * (F.size("sa") + F.size("sb") - F.col("x")))
        links = staged(linked.select("a", "b").distinct(), "jaccard-links")
        dropped(closer, sets)
        return links

    def blocks(self) -> DataFrame:
        """(cid, n, block): every class in the blocks of its prefix, shingles of hot blocks last in the order. Ends the sketches."""
        head = self.sketches.select("cid", "n", "p", F.explode(F.slice("sketch", F.lit(1), F.col("p"))).alias("block"))
        hot = head.groupBy("block").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > BLOCK)
        hot = staged(hot.select(F.col("block").alias("_hot")), "jaccard-hot")
        is_hot = F.col("block") == F.col("_hot")
        # Classes with hot shingles in their prefix go on in the order, past them.
        touched = staged(head.join(small(hot, 8), is_hot, "left_semi").select(F.col("cid").alias("_cid")).distinct(), "jaccard-touched")
        mine = F.col("cid") == F.col("_cid")
        plain = head.join(small(touched, 8), mine, "left_anti").select("cid", "n", "block")
        longer = self.sketches.join(small(touched, 8), mine, "left_semi").select("cid", "n", "p", F.explode("sketch").alias("block"))
        longer = longer.join(small(hot, 8), is_hot, "left_anti")
        longer = longer.withColumn("k", F.row_number().over(W.partitionBy("cid").orderBy("block"))).where("k <= p")
        longer = staged(longer, "jaccard-longer")
        enough = longer.where("k = p").select(F.col("cid").alias("_cid"))
        passed = longer.join(small(enough, 8), mine, "left_semi").select("cid", "n", "block")
        # The others take their whole sets: what is not hot, then what is.
        poor = touched.join(enough.withColumnRenamed("_cid", "cid"), mine, "left_anti").select(F.col("_cid").alias("cid"))
        sets = self.sets(poor)
        whole = sets.select("cid", "n", "p", F.explode("s").alias("block")).join(small(hot, 8), is_hot, "left")
        whole = whole.withColumn("k", F.row_number().over(W.partitionBy("cid").orderBy(F.col("_hot").isNotNull(), "block"))).where("k <= p")
        placed = staged(plain.union(passed).union(whole.select("cid", "n", "block")), "jaccard-placed")
        dropped(self.sketches, hot, touched, longer, sets)
        return placed


def components(links: DataFrame) -> DataFrame:
    """(cid, comp): smallest id reachable, for every id in a link.

    Each vertex hangs on its smallest neighbour if that is smaller; doubling the
    ways up finds the roots of these trees, and the trees are contracted, until no links are left. A
    path of n vertices takes about log2(n) joins, whatever the order of its ids.
    """
    levels = []
    edges = links
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        up = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "components")
        while True:
            far = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            up = staged(up.select("u", "p").join(far, "p").select("u", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "components-up")
            if up.where("moved").isEmpty():
                break
        levels.append(up)
        end = lambda x: up.select(F.col("u").alias(x), F.col("p").alias(f"p{x}"))  # noqa: E731, B023
        moved = edges.join(end("a"), "a").join(end("b"), "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = staged(moved.distinct(), "components-edges")
        if edges.isEmpty():
            break
    found = levels[-1].select(F.col("u").alias("cid"), F.col("p").alias("comp"))
    for up in reversed(levels[:-1]):
        step = found.select(F.col("cid").alias("p"), F.col("comp"))
        found = up.join(step, "p", "left").select(F.col("u").alias("cid"), F.coalesce("comp", "p").alias("comp"))
        found = staged(found, "components-found")
    return found


def one_of_alike(rows: DataFrame) -> DataFrame:
    """(block, weight) of one block for each set of classes, of ``rows`` (cid, block, members); weight: the blocks that have this set, told by 128 bits."""
    sums = rows.groupBy("block", "members").agg(F.bit_xor(F.xxhash64("cid")).alias("k1"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("k2"))
    return sums.groupBy("members", "k1", "k2").agg(F.min("block").alias("block"), F.count(F.lit(1)).alias("weight")).select("block", "weight")


def _tiled(m: DataFrame, percent: int) -> DataFrame:
    """Rows of hot blocks, dealt to trees: a tile has at most about ``TILE`` points of one size and ``TILE`` rows that ask them."""
    band = math.log(100 / percent) + 1e-9
    m = m.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / band).cast("int"))
    held = m.groupBy(F.col("block").alias("_b"), F.col("size").alias("_s")).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    near = F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))
    asking = m.where("rest").withColumn("size", near)
    asked = asking.groupBy("block", "size").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("asks_parts"))
    here = (F.col("block") == F.col("_b")) & (F.col("size") == F.col("_s"))
    tiles = staged(held.join(asked, here).select("_b", "_s", "parts", "asks_parts"), "jaccard-tiles")
    deal = lambda c, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    points = m.join(tiles, here).withColumn("x", deal("parts", 1)).withColumn("y", each("asks_parts")).withColumns({"asks": F.lit(False), "holds": F.lit(True)})
    queries = asking.join(tiles, here).withColumn("y", deal("asks_parts", 2)).withColumn("x", each("parts")).withColumns({"asks": F.lit(True), "holds": F.lit(False)})
    return points.unionByName(queries).withColumn("tree", F.xxhash64("block", "size", "x", "y"))


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    classes = _Classes(docs, words, percent, id_col, text_col)
    every, points = classes.every, classes.points
    placed = classes.blocks()
    held = placed.groupBy("block").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = staged(placed.join(held, "block"), "jaccard-shared")
    dropped(placed)
    alike = one_of_alike(shared)
    met_in = staged(shared.join(alike, "block"), "jaccard-members")
    dropped(shared)
    # The first of a block is the class that meets the most others: it stands in the middle of its copies.
    met = met_in.groupBy("cid").agg(F.sum("weight").alias("met"))
    first = met_in.join(met, "cid").groupBy("block").agg(F.max(F.struct("met", (-F.col("cid")).alias("last"), "n")).alias("m"))
    first = staged(first.select("block", (-F.col("m.last")).alias("pivot"), F.col("m.n").alias("pivot_n")), "jaccard-first")
    members = staged(met_in.drop("weight").join(first, "block"), "jaccard-blocked")
    dropped(met_in, first)

    fits = (100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")) & (F.col("cid") != F.col("pivot"))
    stars = members.where(fits).select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
    links = classes.verified(stars)

    known = components(links)
    of = lambda x: known.select(F.col("cid").alias(x), F.col("comp").alias(f"c{x}"))
    m = members.join(of("cid"), "cid", "left").join(of("pivot"), "pivot", "left")
    m = m.withColumn("comp", F.coalesce("ccid", "cid")).withColumn("rest", F.col("comp") != F.coalesce("cpivot", "pivot")).drop("ccid", "cpivot")
    m = opened = staged(m, "jaccard-open")
    dropped(members, known)
    others = m.where("cid <> pivot").groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("rest").alias("any"))
    left = staged(others.where("low <> high or any").select("block"), "jaccard-left")
    # Written, so that what follows is dealt anew and a hot block's rows can be split.
    m = staged(m.join(left, "block", "left_semi"), "jaccard-still-open")
    dropped(opened, left)
    # A block of moderate size is one R-tree that its members query (all were held against the pivot already).
    moderate = m.where((F.col("members") <= BLOCK) & (F.col("cid") != F.col("pivot"))).withColumns({"tree": F.xxhash64("block"), "asks": F.lit(True), "holds": F.lit(True)})
    pick = lambda d: d.select("tree", "cid", "n", "comp", "asks", "holds")
    dealt = staged(pick(moderate).union(pick(_tiled(m.where(F.col("members") > BLOCK), percent))), "jaccard-dealt")
    groups = -(-dealt.count() // (2 * TILE)) or 1
    dealt = dealt.withColumn("g", F.pmod("tree", F.lit(groups))).join(points.select("cid", "vec"), "cid")
    more = dealt.groupBy("g").applyInArrow(lambda t: _tree_join(t, percent), "a long, b long").distinct()
    links = links.union(classes.verified(more, bounded=True))
    dropped(m, points)

    # Rows of one id are one document, whatever their texts.
    twice = every.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.countDistinct("key1", "key2", "n").alias("texts")).where("texts > 1")
    twice = staged(twice.select(F.col("doc_id").alias("_id")), "jaccard-repeated")
    keys = ["key1", "key2", "n"]
    of_id = every.join(small(twice, 24), F.col("doc_id") == F.col("_id"), "left_semi").where("n > 0").select("doc_id", *keys).join(classes.named.select("cid", *keys), keys)
    of_id = staged(of_id.select("doc_id", "cid").distinct(), "jaccard-by-id")
    least = of_id.groupBy("doc_id").agg(F.min("cid").alias("a"))
    by_id = of_id.join(least, "doc_id").where("a <> cid").select("a", F.col("cid").alias("b"))

    comps = components(staged(links.union(by_id).distinct(), "jaccard-every-link"))
    linked = staged(classes.named.join(comps, "cid").select("cid", "comp", "rep"), "jaccard-linked")
    lowest = linked.groupBy("comp").agg(F.min("rep").alias("lowest"))
    lowest = linked.join(lowest, "comp").select("cid", "lowest")
    named = staged(classes.named.join(lowest, "cid", "left").select("key1", "key2", F.col("n").alias("_n"), F.coalesce("lowest", "rep").alias("comp")), "jaccard-named")
    out = every.select("doc_id", "n", "key1", "key2").join(named, ["key1", "key2"], "left").where("_n is null or _n = n")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id")).alias("component_id"))
