"""N-gram Jaccard join by chosen paths: sets are split again and again on sampled shared tokens.

Each document is the set of its 5-word shingles (all its words as one, if it has fewer). Documents with equal
sets (128 bits of hash) become one class before anything is compared. A class carries ``TOKENS`` MinHash tokens, each
of which two sets share with a chance equal to their Jaccard similarity. A run starts with all classes in one node; a node
with more than ``SMALL`` classes is split on ``BRANCH`` of the tokens, sampled by a hash of its path: its
children are the classes that share one of them. Small nodes are compared by brute force on the tokens. A large
node that holds most classes of the node above it consists of sets that are alike, and splitting on would only copy it: its
classes become candidates of each other, as are those of nodes at the greatest depth, and are compared in full below
(the brute-force step of CPSJoin for points that are similar to most of their node). Runs are repeated until a link at the
threshold is missed by all of them, or by the brute force on tokens, with a chance of at most ``1 - RECALL``; given the
number of tokens that a pair shares, runs are independent, and the chance that one run misses it is that of a branching
process dying out (Chosen Path: Christiani and Pagh 2017; CPSJoin: Christiani, Pagh and Sivertsen 2018).

Candidates are kept as links to the least class of a node, never as all pairs. Classes connected by them form
a cluster; only clusters of two or more are given their full sets, and within a cluster all pairs are counted exactly:
the sets of a cluster go to blocks of a bounded number of classes and shingles, each of which is written once to the shared
folder (its distinct shingles and, for each class, places among these), and tasks read two blocks and compare them. A cluster
of any size is thus spread over tasks and copies no sets. Blocks whose set sizes rule out the threshold don't meet. A link
needs ``|A & B| / |A | B| >= threshold``.

Edge cases: a null text and one without words have no links and stay; ties and repeated rows are members of one
class; a long text is one set, whole; an empty table gives an empty result; further columns are ignored by
``join`` and carried through by ``deduplicated``.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import cache, carried, claim, cut, dropped, folder_for, forget_written, linked_groups, mark, row_key, slices, small_batches, unpacked, written

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
TOKENS = 64
SMALL, DEPTH, BRANCH = 256, 8, 2
DENSE = 0.75  # share of a node's classes that hold the token of a child, from which on they aren't split further
BLOCK = 512  # classes of a block
SHINGLES = 1_000_000  # of a block (one class at least)
DEVIATIONS = 4.0  # by which the similarity of the tokens may fall below the threshold
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def missed(runs: int, threshold: float = THRESHOLD, branch: int = BRANCH, depth: int = DEPTH) -> float:
    """The chance that a pair of that similarity is no candidate after so many runs: over the number of tokens that the
    pair shares, either too few for the brute force, or no node with both in any run."""
    total = 0.0
    for k in range(TOKENS + 1):
        chance = comb(TOKENS, k) * threshold**k * (1 - threshold) ** (TOKENS - k)
        if k < least_tokens(threshold):
            total += chance
            continue
        miss = 0.0
        for _ in range(depth):  # a node takes different tokens, of which the pair shares j
            miss = sum(comb(k, j) * comb(TOKENS - k, branch - j) / comb(TOKENS, branch) * miss**j for j in range(branch + 1))
        total += chance * miss**runs
    return total


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, branch: int = BRANCH, depth: int = DEPTH) -> int:
    """Runs after which a pair of that similarity is a candidate with at least that chance. What the filter of shared tokens misses no
    number of runs brings back, so a recall beyond that is an error."""
    if missed(1 << 40, threshold, branch, depth) >= 1 - recall:
        raise ValueError(f"a recall of {recall} is out of reach: the filter of shared tokens alone misses {missed(1 << 40, threshold, branch, depth):.2e}")
    runs = 1
    while missed(runs, threshold, branch, depth) > 1 - recall:
        runs += 1
    return runs


def least_tokens(threshold: float) -> int:
    """Tokens that candidates of a small node share."""
    return int(np.ceil(TOKENS * (threshold - DEVIATIONS * (threshold * (1 - threshold) / TOKENS) ** 0.5)))


_WORDS: dict[bytes, int] = {}
cache("shingles", _WORDS.clear)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text."""
    import xxhash

    claim("shingles")
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    flat = [w for ws in split for w in ws]
    if len(_WORDS) > 400_000:
        _WORDS.clear()
    for w in set(flat):
        if w not in _WORDS:
            _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, flat), np.uint64, len(flat))
    roll = np.zeros(len(h), np.uint64)
    for k in range(words):
        n = max(0, len(h) - k)
        roll[:n] = mix(roll[:n] * P2 + h[k:] + P1)
    out, at = [], 0
    for ws in split:
        n = len(ws)
        if n >= words:
            out.append(np.unique(roll[at : at + n - words + 1]))
        else:
            whole = np.full(1, n, np.uint64)
            for x in h[at : at + n]:
                whole = mix(whole * P2 + x + P1)
            out.append(whole[: min(n, 1)])
        at += n
    return out


_FACTORS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * P1) | np.uint64(1)
_SHIFTS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * P2)


def min_tokens(values: np.ndarray) -> np.ndarray:
    """MinHash tokens of a set that isn't empty, by as many multiply-shift functions."""
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), 4096):
        part = (values[None, at : at + 4096] * _FACTORS[:, None] + _SHIFTS[:, None]) >> np.uint64(32)
        out = np.minimum(out, part.min(1).astype(np.uint32))
    return out


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, _k1, _k2, n, f1, f2, tokens): a row a document; f1, f2 name its set, n is the set's size."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(batch.column(3).to_pylist(), words)
                names = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                both = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
                tokens = [min_tokens(x).tobytes() if len(x) else None for x in sets]
                yield pa.record_batch([*batch.columns[:3], pa.array([len(x) for x in sets], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(tokens, pa.binary())], names=["doc_id", "_k1", "_k2", "n", "f1", "f2", "tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *row_key(doc_id, text)).select("doc_id", "_k1", "_k2", "text")
    return rows.mapInArrow(run, "doc_id long, _k1 long, _k2 long, n long, f1 long, f2 long, tokens binary")


def _children(path: np.ndarray, tokens: np.ndarray, branch: int) -> np.ndarray:
    """Paths of the children that rows of ``tokens`` fall to below ``path``: (rows, branch)."""
    out = np.empty((len(path), branch), np.uint64)
    for b in range(branch):
        # different tokens of one node: an odd step through the tokens from a sampled start
        pick = mix(path * P1 + np.uint64(1))
        which = ((pick >> np.uint64(8)) + np.uint64(b) * (pick | np.uint64(1))) % np.uint64(TOKENS)
        value = tokens[np.arange(len(path)), which.astype(np.int64)].astype(np.uint64)
        out[:, b] = mix(mix(path + which * P2) + value * P1)
    return out


def _split(rows: DataFrame, runs: int, branch: int) -> DataFrame:
    """(path, c, above) of children, from rows of (path, c, tokens, s); a null path is the root of every run;
    ``above`` is the size s of the node that was split."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(1).to_numpy()
            tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, TOKENS)
            if batch.column(0).null_count:
                starts = [np.full(len(c), mix(np.array([r + 1], np.uint64) * P2)[0]) for r in range(runs)]
            else:
                starts = [batch.column(0).to_numpy().view(np.uint64)]
            paths = np.concatenate([_children(p, tokens, branch) for p in starts])
            above = batch.column(3).take(pa.array(np.repeat(np.tile(np.arange(len(c)), len(starts)), branch)))
            yield pa.record_batch([pa.array(paths.ravel().view(np.int64)), pa.array(np.repeat(np.tile(c, len(starts)), branch)), above], names=["path", "c", "above"])

    return rows.mapInArrow(run, "path long, c long, above long")


def _groups(batches: Iterator, keys: int) -> Iterator:
    """Arrow tables of whole groups, from batches sorted by their first ``keys`` columns."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
        if len(change):
            stop = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, stop)])
            held = [batch.slice(stop)]
        elif held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in enumerate(cols)):
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of n nodes' group under the links a, b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def _similar(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b) links of classes to the least class of what they are connected to within a small node, from rows of
    (path, c, n, tokens) that stand by path."""
    least = least_tokens(threshold)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t in _groups(batches, 1):
            path, c, n = (t.column(k).to_numpy() for k in range(3))
            tokens = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint32).reshape(-1, TOKENS)
            left, right = [], []
            for d in range(1, len(path)):
                i = np.flatnonzero(path[:-d] == path[d:])
                if not len(i):
                    break
                small, large = np.minimum(n[i], n[i + d]), np.maximum(n[i], n[i + d])
                i = i[small >= threshold * large]
                for at in range(0, len(i), 50_000):
                    k = i[at : at + 50_000]
                    same = (tokens[k] == tokens[k + d]).sum(1)
                    k = k[same >= least]
                    left.append(k)
                    right.append(k + d)
            if not left:
                continue
            a, b = np.concatenate(left), np.concatenate(right)
            root = _roots(len(path), a, b)
            at = np.flatnonzero(root != np.arange(len(path)))
            yield pa.record_batch([pa.array(c[at]), pa.array(c[root[at]])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def candidates(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH, branch: int = BRANCH) -> DataFrame:
    """(a, b) links between classes (c, n, tokens) that may be similar."""
    small_batches(classes.sparkSession)
    runs = runs_needed(threshold, recall, branch, depth)
    rows = _split(classes.select(F.lit(None).cast("long").alias("path"), "c", "tokens", F.lit(None).cast("long").alias("s")), runs, branch)
    leaves = stars = None
    for level in range(1, depth + 1):
        rows = cut(rows)
        sizes = rows.groupBy("path").agg(F.count("*").alias("s"), F.min("c").alias("least"), F.max("above").alias("above")).where("s > 1")
        nodes = cut(rows.drop("above").join(sizes, "path"))
        dropped(rows)
        leaf = nodes.where(F.col("s") <= small).select("path", "c")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        big = nodes.where(F.col("s") > small)
        done = F.lit(True) if level == depth else F.coalesce(F.col("s") >= DENSE * F.col("above"), F.lit(False))
        star = big.where(done & (F.col("c") != F.col("least"))).select(F.col("c").alias("a"), F.col("least").alias("b"))
        stars = star if stars is None else stars.unionByName(star)
        big = big.where(~done)
        if level == depth or big.isEmpty():
            break
        rows = _split(big.join(classes.select("c", "tokens"), "c").select("path", "c", "tokens", "s"), 1, branch)
    small_nodes = leaves.join(classes.select("c", "n", "tokens"), "c").select("path", "c", "n", "tokens")
    return _similar(small_nodes.repartition("path").sortWithinPartitions("path", "c"), threshold).unionByName(stars)


class Block:
    """Sets of a cluster in the order of their sizes: class, rows of the class, size, and the sets as places among the
    block's distinct shingles."""

    def __init__(self, c: np.ndarray, m: np.ndarray, size: np.ndarray, names: np.ndarray, at: np.ndarray):
        self.c, self.m, self.size, self.names, self.at = c, m, size, names, at
        self.owner = np.repeat(np.arange(len(c)), size)

    @classmethod
    def of(cls, c: list[int], m: list[int], sets: list[np.ndarray]) -> Block:
        names, at = np.unique(np.concatenate(sets), return_inverse=True)
        return cls(np.array(c), np.array(m), np.array([len(x) for x in sets]), names, at.astype(np.int32))

    def write(self, folder: str) -> str:
        """The address of a new file, so that a repeated task does no harm."""
        from pyarrow import fs

        raw = io.BytesIO()
        # places ascend within a set, so near copies have differences of 1 for the most part
        np.savez(raw, c=self.c, m=self.m, size=self.size, names=self.names, at=np.diff(self.at, prepend=np.int32(0)))
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.block"
        with store.open_output_stream(f"{base}/{name}", compression="zstd") as out:
            out.write(raw.getvalue())
        return f"{folder}/{name}"

    @classmethod
    def read(cls, path: str) -> Block:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_stream(name, compression="zstd") as f:
            z = np.load(io.BytesIO(f.read()))
        return cls(z["c"], z["m"], z["size"], z["names"], np.cumsum(z["at"], dtype=np.int32))


def overlaps(a: Block, b: Block) -> np.ndarray:
    """Matrix of the sizes of all intersections."""
    if a is b:  # a shingle of one class alone joins nothing
        ia = ib = np.flatnonzero(np.bincount(a.at) > 1)
    else:
        _, ia, ib = np.intersect1d(a.names, b.names, assume_unique=True, return_indices=True)
    sides = []
    for x, i in ((a, ia), (b, ib)):
        column = np.full(len(x.names), -1, np.int32)
        column[i] = np.arange(len(i), dtype=np.int32)
        column = column[x.at]
        keep = np.flatnonzero(column >= 0)
        keep = keep[np.argsort(column[keep], kind="stable")]
        sides.append((x.owner[keep], column[keep]))
    out = np.zeros((len(a.c), len(b.c)))
    width = 2048
    for first in range(0, len(ia), width):
        parts = []
        for (owner, column), x in zip(sides, (a, b)):
            lo, hi = np.searchsorted(column, [first, first + width])
            m = np.zeros((len(x.c), min(width, len(ia) - first)), np.float32)
            m[owner[lo:hi], column[lo:hi] - first] = 1
            parts.append(m)
            if a is b:
                parts *= 2
                break
        out += parts[0] @ parts[1].T
    return out


def least_connected(near: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least of the n places that each is connected to, rows of ``near`` being the places ``left``, its columns ``right``."""
    root = np.arange(n)
    while True:
        new = root.copy()
        new[left] = np.minimum(new[left], np.where(near, root[right][None, :], n).min(1, initial=n))
        new[right] = np.minimum(new[right], np.where(near, root[left][:, None], n).min(0, initial=n))
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def compared(a: Block, b: Block, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, rows that it links to in the other block, least class that it is connected to) of two blocks, or of one with
    itself; classes without a link are left out."""
    common = overlaps(a, b)
    near = common >= threshold * (a.size[:, None] + b.size[None, :] - common) - 1e-6
    if a is b:
        np.fill_diagonal(near, False)
        c, links = a.c, near @ a.m
    else:
        c, links = np.concatenate([a.c, b.c]), np.concatenate([near @ b.m, a.m @ near])
    order = np.argsort(c, kind="stable")
    rank = np.empty(len(c), np.int64)
    rank[order] = np.arange(len(c))
    left, right = (rank, rank) if a is b else (rank[: len(a.c)], rank[len(a.c) :])
    root = least_connected(near, left, right, len(c))
    at = np.flatnonzero(links)
    return c[at], links[at].astype(np.int64), c[order][root[rank[at]]]


class Sums:
    """Links of classes, added up before they leave a task."""

    def __init__(self, most: int = 300_000):
        self.most, self.held, self.n = most, [], 0

    def add(self, part: tuple) -> Iterator:
        self.held.append(part)
        self.n += len(part[0])
        if self.n > self.most:
            yield from self.rows()

    def rows(self) -> Iterator:
        import pyarrow as pa

        if self.n:
            c, links, root = map(np.concatenate, zip(*self.held))
            pairs, where = np.unique(np.stack([c, root]), axis=1, return_inverse=True)
            n = len(pairs[0])
            none = pa.nulls(n, pa.int64())
            links = np.bincount(where.ravel(), links, n).astype(np.int64)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(links), pa.array(pairs[1]), none, pa.nulls(n, pa.string()), none, none], names=NAMES)
        self.held, self.n = [], 0


NAMES = ["c", "links", "root", "cluster", "path", "low", "high"]
SCHEMA = "c long, links long, root long, cluster long, path string, low long, high long"


def within(members: DataFrame, folder: str, threshold: float, words: int) -> DataFrame:
    """From rows (cluster, part, n, c, m, nb, text) that stand by cluster, part, n and c: links within blocks, and for
    clusters of several blocks a row for each that was written to ``folder``: cluster, path, least and greatest size."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = Sums()
        held, key, last = [], None, None  # (c, m, set) of the block so far, what it belongs to, and the class met last

        def flush() -> Iterator:
            block = Block.of(*map(list, zip(*held)))
            if len(held) > 1:
                yield from sums.add(compared(block, block, threshold))
            if key[2] > 1:
                path = block.write(folder)
                none = pa.nulls(1, pa.int64())
                yield pa.record_batch([none, none, none, pa.array([key[0]]), pa.array([path]), pa.array([int(block.size.min())]), pa.array([int(block.size.max())])], names=NAMES)

        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(batch.column(6).to_pylist(), words)
                cluster, part, _, c, m, nb = (batch.column(k).to_pylist() for k in range(6))
                for k, values in enumerate(sets):
                    if c[k] == last:  # a repeated row
                        continue
                    now, last = (cluster[k], part[k], nb[k]), c[k]
                    if held and (now != key or (nb[k] > 1 and (len(held) >= BLOCK or sum_ + len(values) > SHINGLES))):
                        yield from flush()
                        held = []
                    if not held:
                        key, sum_ = now, 0
                    held.append((c[k], m[k], values))
                    sum_ += len(values)
        if held:
            yield from flush()
        yield from sums.rows()

    return members.mapInArrow(run, SCHEMA)


def between(blocks: DataFrame, threshold: float) -> DataFrame:
    """Links between the blocks (cluster, path, low, high) of each cluster, from all pairs of blocks that may have some."""
    spark = blocks.sparkSession
    # a cluster of many blocks: the pairs of one block are made by several tasks
    salts = blocks.groupBy("cluster").agg(F.expr("int(ceil(count(*) / 64))").alias("salts"))
    both = blocks.join(salts, "cluster")
    left = both.select("cluster", "path", "low", "high", F.expr("int(pmod(xxhash64(path), salts))").alias("salt"))
    right = both.select("cluster", F.col("path").alias("other"), F.col("low").alias("low_"), F.col("high").alias("high_"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    pairs = left.join(right, ["cluster", "salt"]).where("path < other").where((F.col("high") >= F.col("low_") * threshold - 1) & (F.col("high_") >= F.col("low") * threshold - 1))
    # a number of partitions is given as these rows are few and short, though the blocks aren't
    pairs = pairs.select("path", "other").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "other").sortWithinPartitions("path")

    def run(batches: Iterator) -> Iterator:
        sums, left = Sums(), (None, None)
        for batch in batches:
            for path, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if left[0] != path:
                    left = path, Block.read(path)
                yield from sums.add(compared(left[1], Block.read(other), threshold))
        yield from sums.rows()

    return pairs.mapInArrow(run, SCHEMA)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, _k1, _k2, class_id, n_links, kept of every row: class_id is the least doc_id of the documents
    connected by links, n_links counts the other documents linked directly, kept marks the first of a class."""
    spark = docs.sparkSession
    rows = written(described(docs, doc_id, text, words))
    me = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_k1", "_k2")
    classes = rows.where("n > 0").groupBy("f1", "f2").agg(F.min(me).alias("rep"), F.count("*").alias("m"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()))  # unique, and fixed once written
    since = mark()
    clusters = cut(linked_groups(candidates(classes, threshold)))
    forget_written(spark, since, (clusters,))

    # full sets for the classes in clusters, from the text of the class's first document
    placed = clusters.select(F.col("component").alias("cluster"), F.col("node").alias("c")).join(classes.select("c", "rep", "m", "n"), "c")
    sizes = placed.groupBy("cluster").agg(F.expr(f"int(ceil(greatest(count(*) / {BLOCK}, sum(n) / {SHINGLES})))").alias("nb"))
    placed = placed.join(sizes, "cluster").select("cluster", F.expr("int(pmod(xxhash64(c), ceil(nb / 8)))").alias("part"), "n", "c", "m", "nb", F.col("rep._k1").alias("_k1"), F.col("rep._k2").alias("_k2"))
    placed = cut(placed)
    keyed = docs.select(F.col(text).cast("string").alias("text"), *row_key(doc_id, text))
    # a merge at every size: the clusters grow with the corpus, and are small enough to broadcast only where it is small
    members = keyed.join(placed.hint("merge"), ["_k1", "_k2"]).select("cluster", "part", "n", "c", "m", "nb", "text")
    members = members.repartition("cluster", "part").sortWithinPartitions("cluster", "part", "n", "c")
    folder = folder_for(spark, "blocks")
    own = written(within(members, folder, threshold, words))
    blocks = own.where("path is not null").select("cluster", "path", "low", "high")
    links = own.where("path is null")
    if not blocks.isEmpty():
        links = links.unionByName(written(between(blocks, threshold)))

    since = mark()
    groups = cut(linked_groups(links.select(F.col("c").alias("a"), F.col("root").alias("b"))))
    forget_written(spark, since, (groups,))
    linked = links.groupBy("c").agg(F.sum("links").alias("links")).join(groups.withColumnRenamed("node", "c"), "c", "left")
    facts = classes.select("f1", "f2", "c", "rep", "m").join(linked, "c", "left").withColumn("component", F.coalesce("component", "c"))
    first = facts.groupBy("component").agg(F.min("rep").alias("first"))
    facts = cut(facts.join(first, "component").select("f1", "f2", "first", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    dropped(clusters, placed, own, folder, groups, classes)
    out = rows.drop("tokens").join(facts, ["f1", "f2"], "left")
    alone = F.col("first").isNull()
    return out.select("doc_id", "_k1", "_k2", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | ((F.col("first._k1") == F.col("_k1")) & (F.col("first._k2") == F.col("_k2")))).alias("kept"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The first document of each class, with its own columns; of rows that agree in id and text one stays,
    unless they have no words."""
    verdicts = join(docs, doc_id, text, words, threshold).groupBy("_k1", "_k2").agg(F.min("kept").alias("_kept"))
    joined = carried(docs, doc_id, text).join(verdicts.where("_kept"), ["_k1", "_k2"])
    once = joined.withColumn("_nth", F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1")))
    empty = F.coalesce(~F.col("_row")[text].rlike("[^\\x20\\x09-\\x0D]"), F.lit(True))
    return once.where((F.col("_nth") == 1) | empty).select(*unpacked(docs.columns))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-6),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS class_id FROM r GROUP BY node), k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT d.doc_id, class_id, coalesce(k, 0) AS n_links, d.doc_id = class_id AS kept
FROM d JOIN c ON d.doc_id = c.node LEFT JOIN k ON k.a = d.doc_id
"""
