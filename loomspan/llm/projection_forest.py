"""Embedding near-duplicates by a forest of random-projection trees.

A node splits its vectors at the median of their projections on a random direction; vectors within ``overlap``
of the median go to both sides (spill). Trees differ in their directions. The medians are fitted on a bounded
sample of ``SAMPLE`` distinct vectors, then every vector is led down every tree. Where the sample is too small for
leaves of the wanted size, splitting goes on around the mean of the sample's vectors in a leaf, along directions
that all leaves of the tree share, so the tree that is broadcast stays as small as its sample. A node most of whose vectors
lie within the overlap is dense: splitting would only copy it, and it is a leaf of whatever size. Vectors that share a leaf
are compared by cosine in double precision, and those linked are united.

For vectors that lie alike in all directions, a level parts a pair at the threshold with a chance of some 2 %; as many trees
are grown as bring the chance that all of them part it below ``MISSED``, ``TREES`` at least.

Trees are worked one after the other. A tree's leaves are dealt to tasks by subtrees of about ``BUCKET`` vectors, and a task
leads the vectors of its subtree on to their leaves, so a vector travels once for each subtree that it reaches, not for each leaf.
A subtree that is far larger (a dense leaf) is dealt in pairs of blocks. A pair that shares several leaves counts in the
least of them in the first tree alone; a task knows the leaves of its vectors in that and all earlier trees from the forest,
which makes the counts exact without a list of pairs. Equal vectors become one class first (128 bits of hash), so copies of one
vector, however many, take one place.

Edge cases: a vector that is null, empty, zero, or has null or non-finite components links with nothing;
vectors of different lengths never link; repeated rows and rows that share an id are rows of their own, each
counted as another vector; ties have no order; a null id is passed over when the smallest id is taken; an empty table gives an
empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from math import erfc, exp, log2, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from loomspan.llm.chosen_path import _groups, _roots, least_connected
from loomspan.llm.common import cut, dropped, linked_groups, small_batches, written

THRESHOLD = 0.95
TREES = 4  # at least
MISSED = 0.01
LEAF = 256
SAMPLE = 20_000
BUCKET = 1 << 16
DENSE = 0.5  # share of a node's vectors within the overlap, from which on it isn't split
SIDE = 1024  # rows of a leaf that are compared with as many others at once


class Tree:
    """Nodes in arrays: direction's seed, threshold, children; a leaf has the number -1 - leaf as a child, and is split
    ``extra`` times more around its mean unless it is dense."""

    def __init__(self, sample: np.ndarray, scale: float, leaf: int, seed: int, overlap: float, bucket: int = BUCKET):
        self.seed, self.dim, self.overlap = seed, sample.shape[1], overlap
        self.cuts, self.kids, self.means, self.loose, self.starts = [], [], [], [], []
        self.count = self.extra = self.deep = 0
        self.leaf, self.scale, self.bucket = leaf, scale, bucket
        self.root = self._grow(sample, np.arange(len(sample)), False)
        self.cuts, self.means, self.loose, self.starts = np.array(self.cuts), np.array(self.means), np.array(self.loose), np.array(self.starts)
        self.leaves = self.count << self.extra

    def _leaf(self, x: np.ndarray, at: np.ndarray, dense: bool, inside: bool) -> int:
        if not inside:
            self.starts.append(self.count)
        self.count += 1
        self.means.append(x[at].mean(0))
        self.loose.append(not dense)
        if not dense:
            many = len(at) * self.scale
            self.extra = max(self.extra, int(np.ceil(log2(max(1.0, many / self.leaf)))))
            self.deep = max(self.deep, int(np.ceil(log2(max(1.0, many / self.bucket)))))
        return -self.count

    def direction(self, node: int) -> np.ndarray:
        d = np.random.default_rng([self.seed, node]).standard_normal(self.dim)
        return d / np.linalg.norm(d)

    def _grow(self, x: np.ndarray, at: np.ndarray, inside: bool) -> int:
        if not inside and len(at) * self.scale <= self.bucket:
            self.starts.append(self.count)
            inside = True
        few = len(at) * self.scale <= self.leaf
        if few or len(at) < 8:
            near = few or (np.abs((x[at] - x[at].mean(0)) @ self.direction((1 << 40) + self.count)) <= self.overlap).mean() > DENSE
            return self._leaf(x, at, not few and near, inside)
        node = len(self.cuts)
        p = x[at] @ self.direction(node)
        middle = float(np.median(p))
        if (np.abs(p - middle) <= self.overlap).mean() > DENSE:
            return self._leaf(x, at, True, inside)
        left = p <= middle
        self.cuts.append(middle)
        self.kids.append(None)
        self.kids[node] = (self._grow(x, at[left], inside), self._grow(x, at[~left], inside))
        return node

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row of ``x`` reaches."""
        rows, leaves, todo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node >= 0:
                p = x[at] @ self.direction(node)
                left, right = self.kids[node]
                todo += [(left, at[p <= self.cuts[node] + self.overlap]), (right, at[p > self.cuts[node] - self.overlap])]
                continue
            parts = [(0, at)]
            for level in range(self.extra if self.loose[-1 - node] else 0):
                d = self.direction(len(self.cuts) + level)
                middle, halves = self.means[-1 - node] @ d, []
                for code, part in parts:
                    p = x[part] @ d
                    halves += [(2 * code, part[p <= middle + self.overlap]), (2 * code + 1, part[p > middle - self.overlap])]
                parts = [h for h in halves if len(h[1])]
            for code, part in parts:
                rows.append(part)
                leaves.append(np.full(len(part), ((-1 - node) << self.extra) + code))
        return np.concatenate(rows), np.concatenate(leaves).astype(np.int64)

    def buckets(self, leaves: np.ndarray) -> np.ndarray:
        """The subtree that each leaf belongs to."""
        if self.deep:  # leaves of the sample are subtrees, or several
            return leaves >> (self.extra - self.deep)
        return np.searchsorted(self.starts, leaves >> self.extra, "right") - 1


def overlap_for(threshold: float, dim: int) -> float:
    """Half the deviation of the difference that a pair at the threshold has on a random direction."""
    return 0.5 * (2 - 2 * threshold) ** 0.5 / dim**0.5


def trees_needed(n: int, threshold: float = THRESHOLD, leaf: int = LEAF, missed: float = MISSED) -> int:
    """Trees after which a pair at the threshold has shared a leaf of one with a chance of 1 - ``missed`` or more, for vectors that
    lie alike in all directions: a split at the middle parts a pair whose projections differ by more than the overlap, which is
    one deviation of their difference."""
    beyond = 2 * (exp(-0.5) / sqrt(2 * pi) - 0.5 * erfc(1 / sqrt(2)))  # mean excess of a standard normal over 1, both ways
    level = sqrt(2 - 2 * threshold) * beyond / sqrt(2 * pi)
    parted = 1 - (1 - level) ** max(1.0, log2(max(2.0, n / leaf)))
    trees = TREES
    while parted**trees > missed:
        trees += 1
    return trees


def fit(sample: np.ndarray, population: int, trees: int, leaf: int = LEAF, seed: int = 0, threshold: float = THRESHOLD, bucket: int = BUCKET) -> list[Tree]:
    scale, overlap = max(1.0, population / max(1, len(sample))), overlap_for(threshold, sample.shape[1])
    return [Tree(sample, scale, leaf, 1000 * seed + t, overlap, bucket) for t in range(trees)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matched(x: np.ndarray, m: np.ndarray, side: np.ndarray | None, forest: list[Tree], t: int, bucket: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, least row connected) of each row of ``x``, from the leaves of tree ``t`` in that subtree. With ``side`` only rows of
    different sides are compared."""
    n = len(x)
    links = np.zeros(n, np.int64)
    # all leaves of a row in this and earlier trees, numbered in the order of trees
    rows, codes, base = [], [], 0
    for tree in forest[: t + 1]:
        r, leaves = tree.route(x)
        rows.append(r)
        codes.append(leaves + base)
        first, base = base, base + tree.leaves
    mine, leaves = rows[-1], codes[-1] - first
    here = np.flatnonzero(forest[t].buckets(leaves) == bucket)
    order = here[np.lexsort((mine[here], leaves[here]))]
    mine, leaves = mine[order], leaves[order]
    rows, codes = np.concatenate(rows), np.concatenate(codes)
    by = np.lexsort((codes, rows))
    rows, codes = rows[by], codes[by]
    begins = np.searchsorted(rows, np.arange(n + 1))
    ends = np.flatnonzero(np.append(leaves[1:] != leaves[:-1], True)) + 1
    edges = []

    def before(k: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """(place among k, leaf) of the leaves that come before this one."""
        lens = begins[k + 1] - begins[k]
        at = np.repeat(begins[k] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
        owner = np.repeat(np.arange(len(k)), lens)
        ok = codes[at] < leaf + first
        return owner[ok], codes[at][ok]

    def shared(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
        """Whether rows have met before."""
        (oa, ca), (ob, cb) = before(a, leaf), before(b, leaf)
        names = np.intersect1d(ca, cb)
        out = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, len(names), 4096):
            part = names[at : at + 4096]
            sides = []
            for o, c, k in ((oa, ca, a), (ob, cb, b)):
                place = np.minimum(np.searchsorted(part, c), len(part) - 1)
                ok = part[place] == c
                one = np.zeros((len(k), len(part)), np.float32)
                one[o[ok], place[ok]] = 1
                sides.append(one)
            out += sides[0] @ sides[1].T
        return out > 0

    for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
        leaf, members = int(leaves[begin]), mine[begin:end]
        for at in range(0, len(members), SIDE):
            for to in range(at, len(members), SIDE):
                a, b = members[at : at + SIDE], members[to : to + SIDE]
                near = x[a] @ x[b].T >= threshold
                if at == to:
                    np.fill_diagonal(near, False)
                if side is not None:
                    near &= side[a][:, None] != side[b][None, :]
                ka, kb = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                if not len(ka):
                    continue
                a, b, near = a[ka], b[kb], near[np.ix_(ka, kb)]
                names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                root = least_connected(near, place[: len(a)], place[len(a) :], len(names))
                edges.append((names, names[root]))
                near &= ~shared(a, b, leaf)
                links[a] += near @ m[b]
                if at != to:
                    links[b] += m[a] @ near
    if not edges:
        return links, np.arange(n)
    return links, _roots(n, *map(np.concatenate, zip(*edges)))


def link(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, trees: int | None = None, leaf: int = LEAF, bucket: int = BUCKET) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    small_batches(spark)
    single = isinstance(vectors.schema[embedding].dataType, ArrayType) and isinstance(vectors.schema[embedding].dataType.elementType, FloatType)
    kind, number = ("float", np.float32) if single else ("double", np.float64)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("v"))
    bad = "v is null or size(v) = 0 or exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) or not exists(v, x -> x <> 0)"
    rows = rows.withColumn("ok", ~F.expr(bad))
    hashed = F.transform("v", lambda x: x + F.lit(0.0))
    rows = rows.withColumns({"f1": F.when(F.col("ok"), F.xxhash64(hashed)), "f2": F.when(F.col("ok"), F.xxhash64(hashed, F.lit(5)))})
    classes = rows.where("ok").groupBy("f1", "f2").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("v").alias("v"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()))  # unique, and fixed once written
    dims = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    checked = None
    for dim, n in sorted(dims.items()):
        these = classes.where(F.size("v") == dim).select("c", "m", "v", "f1")
        taken = these.orderBy(F.xxhash64("f1", F.lit(9))).limit(SAMPLE).select("v").toPandas()["v"]
        forest = fit(unit(np.stack(taken.to_list())), n, trees or trees_needed(n, threshold, leaf), leaf, dim, threshold, bucket)
        these, sent = these.drop("f1"), spark.sparkContext.broadcast(forest)
        for t in range(len(forest)):
            found = written(_compared(these, sent, t, dim, number, threshold, bucket))
            checked = found if checked is None else checked.unionByName(found)
            del found
            # else the vectors that were dealt for this tree stay on disk until the driver happens to collect its garbage
            gc.collect()
            spark.sparkContext._jvm.System.gc()
    checked = spark.createDataFrame([], "c long, links long, root long") if checked is None else checked
    groups = cut(linked_groups(checked.select(F.col("c").alias("a"), F.col("root").alias("b")))).withColumnRenamed("node", "c")
    linked = checked.groupBy("c").agg(F.sum("links").alias("links"))
    facts = classes.select("f1", "f2", "c", "least", "m").join(linked, "c", "left").join(groups, "c", "left").withColumn("component", F.coalesce("component", "c"))
    first = facts.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = cut(facts.join(first, "component").select("f1", "f2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    dropped(classes)
    out = rows.select("vec_id", "f1", "f2").join(facts, ["f1", "f2"], "left")
    component = F.when(F.col("f1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _compared(these: DataFrame, sent, t: int, dim: int, number, threshold: float, bucket: int) -> DataFrame:
    """(c, links, root) from tree ``t``: of the rows (c, m, v), how many rows each links to that it meets in no earlier leaf, and
    the least class that it is connected to."""

    def led(batches: Iterator) -> Iterator:
        """(c, m, v, subtree) for each subtree that a vector reaches."""
        import pyarrow as pa

        tree = sent.value[t]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.ascontiguousarray(batch.column(2).flatten().to_numpy(), number).reshape(-1, dim)
            row, leaves = tree.route(unit(x))
            pairs = np.unique(np.stack([row, tree.buckets(leaves)]), axis=1)
            raw = [y.tobytes() for y in x]
            at = pa.array(pairs[0])
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array([raw[k] for k in pairs[0].tolist()], pa.binary()), pa.array(pairs[1])], names=["c", "m", "v", "bucket"])

    def sized(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in led(batches):
            b, n = np.unique(batch.column(3).to_numpy(), return_counts=True)
            yield pa.record_batch([pa.array(b), pa.array(n)], names=["bucket", "n"])

    # led twice rather than written: the sizes are a row a subtree
    sizes = cut(these.mapInArrow(sized, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("g")).where("g > 1").select("bucket", F.expr(f"if(g <= {2 * bucket}, 1, int(ceil(g / {bucket})))").alias("nb")))
    placed = these.mapInArrow(led, "c long, m long, v binary, bucket long").join(sizes, "bucket").withColumn("b", F.expr("int(pmod(xxhash64(c), nb))"))
    spread = placed.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)")))
    members = spread.select("bucket", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "c", "m", "v")
    # a number of partitions is given as the work of a subtree is more than its bytes say
    members = members.repartition(int(these.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "c")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forest = sent.value
        for group in _groups(batches, 3):
            where, i, j, side, c, m = (group.column(k).to_numpy() for k in range(6))
            v = group.column(6).combine_chunks()
            v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
            x = np.frombuffer(b"".join(v.to_pylist()), number).reshape(-1, dim)
            stops = np.flatnonzero(np.append((where[1:] != where[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True)) + 1
            for begin, stop in zip([0, *stops[:-1].tolist()], stops.tolist()):
                part = slice(begin, stop)
                links, root = matched(unit(x[part]), m[part], None if i[begin] == j[begin] else side[part], forest, t, int(where[begin]), threshold)
                at = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
                yield pa.record_batch([pa.array(c[part][at]), pa.array(links[at]), pa.array(c[part][root[at]])], names=["c", "links", "root"])

    return members.mapInArrow(run, "c long, links long, root long")


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS reach FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.node LEFT JOIN n ON n.a = v.vec_id
"""
