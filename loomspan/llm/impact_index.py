"""Ranked lexical search over a bit-sliced impact index.

A task that reads documents cuts them into shards of at most ``SHARD`` documents and ``POSTINGS`` postings, numbered in order of
their ids, and writes for every term of a shard the places of the documents that hold it and the bits of its impact on them
as ``BITS`` bitmaps, one a bit (over the term's own documents, as most terms are rare). So the index is built where the text
is read, without a shuffle, and no term, however common, has a row longer than a shard. Impacts stand without the term's weight, which
changes when documents are added; a search multiplies the bitmaps by it, by shifts and additions with carry.

A search joins the index with the terms of the queries, and a task that gets a shard and a block of queries spreads each term's bitmaps over
the shard, adds them into the queries' sums bit by bit (exclusive or for the sum, and for the carry), and finds
the k highest sums by going down from the most significant bitmap: while more than k documents are left, those with the bit stay; the rest are kept
beside. Ties go by place, which is the order of ids. The best of all shards are merged by a ranked window.

Edge cases: a null or empty text, or one of separators alone, has no terms and doesn't count as a document; repeated rows and rows
with one id are documents of their own; null ids come last among equals and are returned as null; very long texts are a
shard's matter of counts; a query without terms, or whose terms no document holds, has no rows; a null query id is an
id like others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import claim, small_batches, slices, table, written
from loomspan.llm.terms import Numbers, terms_of

SHARD = 16_384  # documents
POSTINGS = 3_000_000
BITS = 20  # an impact is below 10**6
QUERIES = 256  # queries in a block
SCHEMA = "shard long, term string, df int, places binary, slices binary, docs array<long>"
NONE = np.iinfo(np.int64).max  # stands for a null id in a shard's order


def texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))


def totals(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, their terms with repeats)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = [len(terms_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([sum(1 for x in n if x)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["n", "l"])

    row = docs.select("text").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return int(row[0] or 0), int(row[1] or 0)


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """How much a term that occurs ``tf`` times in a document of ``n`` terms weighs there, before its own weight."""
    m = 100 - 90 + (90 * n * docs) // max(terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Shard:
    """Documents of one shard while they come in."""

    def __init__(self):
        self.numbers, self.term, self.tf, self.held, self.n, self.ids = Numbers(), array("i"), array("q"), [], [], []

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        counts = Counter(words)
        self.term.extend(map(self.numbers.__getitem__, counts))
        self.tf.extend(counts.values())
        self.held.append(len(counts))
        self.n.append(len(words))
        self.ids.append(NONE if doc_id is None else doc_id)

    def full(self) -> bool:
        return len(self.ids) >= SHARD or len(self.term) >= POSTINGS

    def rows(self, number: int, docs: int, terms: int) -> Iterator:
        """Record batches of the shard's rows: its documents' ids in order, and a row for each term."""
        import pyarrow as pa

        ids = np.array(self.ids, np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc = np.repeat(np.arange(len(ids)), self.held)
        term, tf = np.frombuffer(self.term, np.int32).astype(np.int64), np.frombuffer(self.tf, np.int64)
        q = impacts(tf, np.array(self.n, np.int64)[doc], docs, terms)
        at = np.argsort(term * SHARD + place[doc])
        term, q, places = term[at], q[at], place[doc][at].astype("<u2")
        df = np.bincount(term, minlength=len(self.numbers))
        # each term's documents fill whole bytes of its bitmaps
        room = (df + 7) // 8
        begin = np.cumsum(room) - room
        spread = np.zeros(int(room.sum()) * 8, np.int64)
        spread[8 * begin[term] + np.arange(len(term)) - (np.cumsum(df) - df)[term]] = q
        owner = np.repeat(np.arange(len(df)), room)
        within = np.arange(len(owner)) - begin[owner]
        bits = np.empty(len(owner) * BITS, np.uint8)
        for b in range(BITS):
            bits[BITS * begin[owner] + b * room[owner] + within] = np.packbits(((spread >> b) & 1).astype(np.uint8))
        binary = lambda lens, data: pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.py_buffer(data)])
        columns = [pa.array(np.full(len(df), number, np.int64)), pa.array(list(self.numbers), pa.binary()).cast(pa.string()), pa.array(df.astype(np.int32)), binary(2 * df, places.tobytes()), binary(BITS * room, bits.tobytes()), pa.nulls(len(df), pa.list_(pa.int64()))]
        names = ["shard", "term", "df", "places", "slices", "docs"]
        known = [None if x == NONE else x for x in ids[order].tolist()]
        yield pa.record_batch([pa.array([number], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([known], pa.list_(pa.int64()))], names=names)
        whole = pa.record_batch(columns, names=names)
        for a in range(0, whole.num_rows, 20_000):
            yield whole.slice(a, 20_000)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(index, documents that hold a term). Rows of the index: shard, term, df (documents of the shard that hold it), places, slices; one row
    a shard has no term and holds its documents' ids. The index is a table in the shared folder."""
    rows = texts(docs, doc_id, text)
    n, total = totals(rows)

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        claim("impact_index")
        shard, number = Shard(), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole):
                for ident, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = terms_of(data)
                    if words:
                        shard.add(ident, words)
                    if shard.full():
                        yield from shard.rows(number, n, total)
                        shard, number = Shard(), number + 1
        if shard.ids:
            yield from shard.rows(number, n, total)

    return written(rows.mapInArrow(run, SCHEMA)), n


def weight(docs: int, df) -> F:
    return F.floor(1000 * F.log((2.0 * docs + 2.0) / (2.0 * df + 1.0))).cast("long")


def added(total: np.ndarray, more: np.ndarray, shift: int = 0) -> None:
    """Add the numbers in the bitmaps ``more`` (bit, word), shifted, to those in ``total`` (..., bit, word), in place."""
    carry = None
    for b in range(shift, total.shape[-2]):
        mine, theirs = total[..., b, :], more[b - shift] if b - shift < len(more) else None
        if theirs is None and (carry is None or not carry.any()):
            break
        if theirs is None:
            total[..., b, :], carry = mine ^ carry, mine & carry
        elif carry is None:
            total[..., b, :], carry = mine ^ theirs, mine & theirs
        else:
            part = mine ^ theirs
            total[..., b, :], carry = part ^ carry, (mine & theirs) | (part & carry)


def weighted(slices_: list[np.ndarray], weights: list[int]) -> np.ndarray:
    """The bitmaps of all terms (BITS, bytes of the term) side by side, each multiplied by its term's weight: for each bit of the weights the
    bitmaps of the terms that have it, shifted, are added."""
    q = np.concatenate(slices_, axis=1)
    w = np.repeat(np.array(weights, np.int64), [x.shape[1] for x in slices_])
    width = int(w.max(initial=0)).bit_length()
    out = np.zeros((BITS + width, q.shape[1]), np.uint8)
    for b in range(width):
        some = np.where((w >> b) & 1, 255, 0).astype(np.uint8)
        added(out, q & some, b)
    return out


def highest(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, numbers) of the k highest numbers above 0 in bitmaps (bit, word), ties by place, going down from the most significant bitmap."""
    left, sure = np.bitwise_or.reduce(total, axis=0), np.zeros(total.shape[1], total.dtype)
    count = lambda x: int(np.bitwise_count(x).sum())
    if count(left) > k:
        need = k
        for b in range(len(total) - 1, -1, -1):
            with_bit = left & total[b]
            n = count(with_bit)
            if n >= need:
                left = with_bit
                if n == need:
                    break
            else:
                sure, left, need = sure | with_bit, left & ~total[b], need - n
    at = np.flatnonzero(np.unpackbits((sure | left).view(np.uint8), bitorder="little"))
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    number = np.zeros(len(at), np.int64)
    for b in range(len(total)):
        number |= ((total[b, word] >> bit) & np.uint64(1)).astype(np.int64) << b
    order = np.lexsort((at, -number))[:k]
    return at[order], number[order]


def search_shard(rows, k: int) -> tuple[list, list, list]:
    """(queries, places, scores) of the best documents of a shard for a block of queries; rows: a table of term rows with
    df, places, slices, w and queries (numbers within the block)."""
    df, w, asked = (rows.column(c).to_pylist() for c in ("df", "w", "queries"))
    places = [np.frombuffer(x, "<u2") for x in rows.column("places").to_pylist()]
    bits = [np.frombuffer(x, np.uint8).reshape(BITS, -1) for x in rows.column("slices").to_pylist()]
    product, at = weighted(bits, w), np.cumsum([0] + [x.shape[1] for x in bits]).tolist()
    words = (max(int(p[-1]) for p in places) >> 6) + 1
    numbers = sorted({q for qs in asked for q in qs})
    row_of = {q: i for i, q in enumerate(numbers)}
    total = np.zeros((len(numbers), BITS + max(1, sum(w).bit_length()), words), np.uint64)
    wide = np.zeros((len(product), 64 * words), np.uint8)
    for i, own in enumerate(places):
        wide[:, own] = np.unpackbits(product[:, at[i] : at[i + 1]], axis=1)[:, : df[i]]
        maps = np.packbits(wide, axis=1, bitorder="little").view(np.uint64)
        wide[:, own] = 0
        some = [row_of[q] for q in asked[i]]
        if len(some) == 1:
            added(total[some[0]], maps)
        else:
            sums = total[some]
            added(sums, maps)
            total[some] = sums
    out = ([], [], [])
    for q, sums in zip(numbers, total):
        where, score = highest(sums, k)
        for column, values in zip(out, ([q] * len(where), where.tolist(), score.tolist())):
            column.extend(values)
    return out


def asked(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term) once each for the queries; ``item`` holds the id."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [(i, t) for i, data in enumerate(batch.column(1).to_pylist()) for t in sorted(set(terms_of(data)))]
            yield pa.record_batch([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([t for _, t in found], pa.binary()).cast(pa.string())], names=["item_id", "term"])

    kind = items.schema[item_id].dataType.simpleString()
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, term string").distinct()


def search(index: DataFrame, docs: int, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each query; index and docs as from :func:`build`. Rows of ``items`` that share
    an id are one query with the terms of all."""
    spark = index.sparkSession
    small_batches(spark)
    pairs = written(asked(items, item_id, text))
    ids = pairs.select("item_id").distinct()
    blocks = max(1, -(-ids.count() // (QUERIES // 2)))
    # a query's number within its block, by rank within the block
    numbered = ids.withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string"), F.lit(3)), F.lit(blocks)))
    numbered = written(numbered.withColumn("query", F.row_number().over(Window.partitionBy("block").orderBy("item_id")) - 1))
    hits = written(index.where("term is not null").drop("docs").join(pairs.select("term").distinct(), "term"))
    weights = hits.groupBy("term").agg(weight(docs, F.sum("df")).alias("w"))
    wanted = pairs.join(numbered, pairs["item_id"].eqNullSafe(numbered["item_id"])).groupBy("block", "term").agg(F.array_sort(F.collect_list("query")).alias("queries"))
    rows = hits.join(wanted.join(weights, "term"), "term").select("shard", "block", "df", "places", "slices", "w", "queries")

    def run(key, rows):
        import pyarrow as pa

        queries, places, scores = search_shard(rows.combine_chunks(), k)
        n = len(queries)
        return pa.table([pa.array([key[0].as_py()] * n, pa.int64()), pa.array([key[1].as_py()] * n, pa.int64()), pa.array(queries, pa.int32()), pa.array(places, pa.int32()), pa.array(scores, pa.int64())], names=["shard", "block", "query", "place", "score"])

    # a shard's best for a query are ten rows; ids break ties between shards
    best = rows.groupBy("shard", "block").applyInArrow(run, "shard long, block long, query int, place int, score long")
    known = index.where("term is null").select("shard", F.posexplode("docs").alias("place", "doc_id"))
    named = best.join(known, ["shard", "place"])
    w = Window.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(numbered, ["block", "query"]).select("item_id", "rank", "doc_id", "score")


def ranked(spark, sf_dir: str) -> DataFrame:
    index, n = build(table(spark, sf_dir, "documents"))
    return search(index, n, table(spark, sf_dir, "benchmark"))


ORACLE = r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT r, doc_id, len(ws) AS n, list_transform(ws, lambda s: translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM t WHERE len(ws) > 0),
z AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS lt FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ws) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY term, nd),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // lt)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), z GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""
