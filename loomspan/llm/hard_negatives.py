"""Hard negatives for anchors by blocked dense matrix products.

Anchors are taken in rounds of at most ``ROUND_BYTES`` of vectors. A round is broadcast, and every task multiplies it with the
blocks of its rows in float64, which is exact for whole numbers below 2**53. A task keeps the best rows of each anchor, and those of all
tasks are merged by a ranked window: first the best positives (rows of the anchor's label), then, as a positive's score bounds its
negatives, the best negatives of each positive's window. So a row is read twice a round, what is shuffled is a few rows for each
anchor and task, and no pair is ever a row. The number of rounds grows with the anchors alone.

Candidates of one label meet the anchors of that label only in the first pass, as blocks are sorted by label; no label has a task of its own, so
one that holds a third of all rows is dealt like the rest.

Edge cases: a row with a null id, a null label, a null or empty vector, or with a null or non-finite component takes no part;
vectors of different lengths never meet. Other rows of an anchor are those with another id; rows that repeat an
anchor in all three columns are one anchor, and repeated candidates count as often as they occur. Equal scores go by the smaller id.
Products that could reach 2**53 raise an error, as they would not be exact. An empty table, or one without anchors, gives an empty
result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import folder_for, small_batches

ROUND_BYTES = 8 << 20  # of anchors that are broadcast at once
SIDE = 2048  # candidates in a block
ROWS = 512  # anchors in a block
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def vectors(batch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, ids, labels, matrix of floor(scale * x)) for the rows of a batch (id, label, vec) that take part."""
    import pyarrow.compute as pc

    batch = batch.filter(pc.and_(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))), pc.is_valid(batch.column(2))))
    if not batch.num_rows:
        return
    column = batch.column(2)
    lens = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)  # a null is not a number
    ends = np.cumsum(lens)
    ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    for n in np.unique(lens[lens > 0]).tolist():
        rows = np.flatnonzero(lens == n)
        x = values[(ends[rows] - n)[:, None] + np.arange(n)].astype(np.float64)
        good = np.isfinite(x).all(1)
        yield n, ids[rows][good], labels[rows][good], np.floor(scale * x[good])


class Best:
    """The k best (score, id) of each of n anchors: higher scores first, ties by the smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.k = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), k

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """Offer candidates with ascending ``ids`` to the anchors ``at``; score: a row for each anchor, a column for each candidate."""
        last, last_id = self.score[at, -1][:, None], self.id[at, -1][:, None]
        hit, even = score > last, score == last
        if even.any():
            hit |= even & (ids[None] < last_id)
        if allowed is not None:
            hit &= allowed
        n = np.count_nonzero(hit)
        if not n:
            return
        if n > 4 * self.k * len(at) and score.shape[1] > self.k:  # only a block's best k can matter, the first of equals
            x = np.where(hit, score, -np.inf)
            least = np.partition(x, -self.k, axis=1)[:, -self.k][:, None]
            even = hit & (x == least)
            hit = (x > least) | (even & (np.cumsum(even, 1) <= self.k))
        r, c = np.nonzero(hit)
        some = np.unique(r)
        row = np.concatenate([np.repeat(some, self.k), r])
        s = np.concatenate([self.score[at[some]].ravel(), score[r, c]])
        i = np.concatenate([self.id[at[some]].ravel(), ids[c]])
        order = np.lexsort((i, -s, row))
        row, s, i = row[order], s[order], i[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.score[at[row[keep]], place[keep]] = s[keep]
        self.id[at[row[keep]], place[keep]] = i[keep]


class Anchors:
    """The anchors of a round with vectors of one length, in order of their labels."""

    def __init__(self, first: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, labels))
        self.first, self.ids, self.labels, self.x = first, ids[order], labels[order], x[order]
        self.most = float(np.abs(x).max(initial=0))

    def blocks(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, by_label: bool) -> Iterator[tuple]:
        """(anchors, ids, labels, scores) of blocks of candidates, ids ascending; ``by_label``: of equal labels alone."""
        if len(x) and self.most * float(np.abs(x).max()) * x.shape[1] >= 2.0**53:
            raise ValueError("inner products could reach 2**53, where float64 stops being exact; scale the vectors down")
        order = np.lexsort((ids, labels)) if by_label else np.argsort(ids, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        cuts = np.flatnonzero(np.diff(labels)) + 1 if by_label else np.zeros(0, int)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            lo, hi = (np.searchsorted(self.labels, labels[a], s) for s in ("left", "right")) if by_label and b > a else (0, len(self.ids))
            for c in range(a, b, SIDE):
                d = min(b, c + SIDE)
                for r in range(lo, hi, ROWS):
                    at = np.arange(r, min(hi, r + ROWS))
                    yield at, ids[c:d], labels[c:d], self.x[at] @ x[c:d].T


def _table(**columns):
    import pyarrow as pa

    return pa.record_batch(list(columns.values()), names=list(columns))


def best_positives(rows: DataFrame, sent, k: int, scale: float) -> DataFrame:
    """anchor (number in the round), score, id, rank: the k best rows of each anchor's own label."""

    def run(batches: Iterator) -> Iterator:
        groups = {g.x.shape[1]: (g, Best(len(g.ids), k)) for g in sent.value}
        for batch in batches:
            for n, ids, labels, x in vectors(batch, scale):
                if n in groups:
                    g, best = groups[n]
                    for at, some, _, score in g.blocks(ids, labels, x, True):
                        best.add(at, score, some, g.ids[at][:, None] != some[None])
        for g, best in groups.values():
            r, c = np.nonzero(np.isfinite(best.score))
            yield _table(anchor=(g.first + r).astype(np.int64), score=best.score[r, c].astype(np.int64), id=best.id[r, c])

    merged = rows.mapInArrow(run, "anchor long, score long, id long")
    return ranked(merged, ["anchor"], "score", "id", k)


def ranked(rows: DataFrame, keys: list[str], score: str, ident: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), ident)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def windowed_negatives(rows: DataFrame, sent, k: int, low: int, high: int, scale: float) -> DataFrame:
    """The k best rows of other labels in the window of each (anchor, positive); sent: (anchors, their positives' scores and ids)."""

    def run(batches: Iterator) -> Iterator:
        groups = {}
        for g, score, ident in sent.value:
            whole, none = score.astype(np.int64), ~np.isfinite(score)
            whole[none] = 0
            least, most = -((-low * whole) // 100), (high * whole) // 100
            groups[g.x.shape[1]] = g, np.where(none, np.inf, least), np.where(none, -np.inf, most), [Best(len(g.ids), k) for _ in range(score.shape[1])], whole, ident
        for batch in batches:
            for n, ids, labels, x in vectors(batch, scale):
                if n in groups:
                    g, least, most, bests, _, _ = groups[n]
                    for at, some, theirs, score in g.blocks(ids, labels, x, False):
                        other = g.labels[at][:, None] != theirs[None]
                        for j, best in enumerate(bests):
                            best.add(at, score, some, other & (score >= least[at, j][:, None]) & (score <= most[at, j][:, None]) & (g.ids[at][:, None] != some[None]))
        for g, _, _, bests, whole, ident in groups.values():
            for j, best in enumerate(bests):
                r, c = np.nonzero(np.isfinite(best.score))
                yield _table(anchor=(g.first + r).astype(np.int64), nth=np.full(len(r), j), anchor_id=g.ids[r], positive_id=ident[r, j], positive_score=whole[r, j], negative_score=best.score[r, c].astype(np.int64), negative_id=best.id[r, c])

    found = rows.mapInArrow(run, "anchor long, nth long, anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long")
    return ranked(found, ["anchor", "nth"], "negative_score", "negative_id", k)


def mine(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows for which ``anchor``, an
    expression over the id column as ``id``, holds) and each of its best ``positives`` the best ``negatives`` among rows of other labels
    whose score lies between ``low`` and ``high`` per cent of the positive's."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("vec"))
    anchors = rows.where(anchor & F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).distinct()
    size = anchors.agg(F.sum(F.size("vec") * 8)).first()[0] or 0
    rounds = max(1, -(-int(size * 5) // (4 * ROUND_BYTES)))
    path = folder_for(spark, "negatives")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    for r in range(rounds):
        some = anchors.where(F.pmod(F.xxhash64("id", "label", "vec"), F.lit(rounds)) == r) if rounds > 1 else anchors
        groups, first = [], 0
        for n, ids, labels, x in _local(some.toArrow(), scale):  # bounded by ROUND_BYTES
            groups.append(Anchors(first, ids, labels, x))
            first += len(ids)
        if not first:
            continue
        sent = spark.sparkContext.broadcast(groups)
        scores, idents = np.full((first, positives), -np.inf), np.zeros((first, positives), np.int64)
        got = best_positives(rows, sent, positives, scale).toArrow()  # at most ``positives`` rows an anchor of the round
        at, place = got.column("anchor").to_numpy(), got.column("rank").to_numpy() - 1
        scores[at, place], idents[at, place] = got.column("score").to_numpy(), got.column("id").to_numpy()
        both = spark.sparkContext.broadcast([(g, scores[g.first : g.first + len(g.ids)], idents[g.first : g.first + len(g.ids)]) for g in groups])
        windowed_negatives(rows, both, negatives, low, high, scale).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
        sent.unpersist()
        both.unpersist()
    return spark.read.schema(SCHEMA).parquet(path)


def _local(table, scale: float) -> list[tuple]:
    """The vectors of a small table, all of a length together, in order of their ids."""
    parts: dict[int, list] = {}
    for batch in table.combine_chunks().to_batches():
        for n, *columns in vectors(batch, scale):
            parts.setdefault(n, []).append(columns)
    return [(n, *(np.concatenate([p[k] for p in parts[n]]) for k in range(3))) for n in sorted(parts)]


ORACLE = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256.0e0 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT vec_id AS anchor_id, label, v FROM e WHERE vec_id % 100 = 0),
s AS (SELECT a.anchor_id, a.label = e.label AS same, e.vec_id, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score FROM a JOIN e ON e.vec_id <> a.anchor_id AND len(e.v) = len(a.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
