"""Benchmark decontamination with an FM-index for each training shard.

A task that reads documents cuts them into shards of about ``WORDS`` words and indexes each: words become numbers, documents
end in separators that all differ, suffixes are sorted by prefix doubling (only those that are still alike are sorted again), and
the word before every suffix, in that order, goes into a wavelet matrix, one bitmap for each bit of the numbers. With every
``STEP``-th place of the text kept for the suffixes that begin there, a shard is one row of the index; nothing is shuffled to make it.
Documents longer than ``PIECE`` words are indexed in pieces that share ``REACH - 1`` words with their neighbours.

A search takes windows of up to ``REACH`` words from the benchmark, in rounds of at most ``ROUND`` windows that are broadcast, and a task
searches all of a round in a shard at once: the range of suffixes that begin with a window's last words is narrowed word by word
from the end, by two ranks in the wavelet matrix each. What is left is located by stepping back through the text to the next kept
place. Covered words become spans, which are merged by shard, and those of all rounds and pieces by a window over each document's spans.

Edge cases: a null or empty text, or one of separators alone, has no words and gets a row with none hit; repeated rows and rows
that share an id are rows of their own; an item without words has no window; items with one id are one item, and a null id is
an item with an empty name; windows that several items share are looked up once and joined with their items afterwards, so neither
an item nor a window is gathered in one task; an empty table or benchmark gives the rows of the documents with nothing hit; further columns
are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import claim, small_batches, slices, table, written
from loomspan.llm.terms import Numbers, terms_of

WINDOW = 10
REACH = WINDOW  # longest phrase that an index can be asked for
WORDS = 1 << 20  # of a shard
PIECE = 1 << 17  # words of a document that are indexed together
STEP = 16
ROUND = 1 << 16  # windows that are broadcast at once


def order_of_suffixes(symbols: np.ndarray, count: int) -> np.ndarray:
    """Where the suffixes begin, in their order, of numbers below ``count``; each suffix holds one of the numbers that
    occur once, so two of them differ somewhere before they would run over the end."""
    n, bits = len(symbols), max(1, int(count - 1).bit_length())
    deep = max(1, 62 // bits)
    key = symbols.astype(np.int64)
    for j in range(1, deep):
        key = (key << bits) | np.roll(symbols, -j)
    order = np.argsort(key)
    key = key[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    at = np.arange(n)
    while True:
        alone = head & np.concatenate([head[1:], [True]])
        at, head = at[~alone], None
        if not len(at):
            return order
        some = order[at]
        key = rank[some] * n + rank[(some + deep) % n]
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[at] = some
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[some] = np.maximum.accumulate(np.where(head, at, 0))
        deep *= 2


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, with a word to spare."""
    out = np.zeros((len(bits) >> 6) + 1, np.uint64)
    raw = np.packbits(bits, bitorder="little")
    out.view(np.uint8)[: len(raw)] = raw
    return out


class Ranks:
    """A bitmap with counts of the ones before each place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


def encoded(symbols: np.ndarray, count: int) -> tuple[bytes, bytes, bytes, bytes]:
    """(levels, starts, marks, samples): the bitmaps of the wavelet matrix, where each number's suffixes begin, which suffixes' places
    are kept, and these places in steps."""
    order = order_of_suffixes(symbols, count)
    n, bits = len(symbols), max(1, int(count - 1).bit_length())
    row = symbols[order - 1].astype(np.int32)  # the one before the first is the last
    levels = []
    for b in range(bits - 1, -1, -1):
        one = (row >> b) & 1
        levels.append(packed(one.astype(np.uint8)))
        one = one.astype(bool)
        row = np.concatenate([row[~one], row[one]])
    first = np.zeros(n, np.uint8)
    first[np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=count))[:-1]])] = 1
    kept = order % STEP == 0
    return b"".join(x.tobytes() for x in levels), packed(first).tobytes(), packed(kept.astype(np.uint8)).tobytes(), (order[kept] // STEP).astype("<u4").tobytes()


class Index:
    """The FM-index of one shard, from what :func:`encoded` made."""

    def __init__(self, n: int, count: int, levels: bytes, starts: bytes, marks: bytes, samples: bytes):
        self.n, self.bits = n, max(1, int(count - 1).bit_length())
        words = (n >> 6) + 1
        self.levels = [Ranks(x) for x in np.frombuffer(levels, np.uint64).reshape(self.bits, words)]
        self.zeros = [n - int(x.before[-1]) for x in self.levels]
        self.first = np.concatenate([np.flatnonzero(np.unpackbits(np.frombuffer(starts, np.uint8), bitorder="little")), [n]])
        self.marks, self.samples = Ranks(np.frombuffer(marks, np.uint64)), np.frombuffer(samples, "<u4").astype(np.int64)

    def rank(self, symbol: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """How many of the first ``at`` rows hold the symbol, for each of the arrays ``at``; walks all levels of the matrix."""
        places = [np.zeros_like(symbol), *at]
        for level, (ranks, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            for k, p in enumerate(places):
                ones = ranks.ones(p)
                places[k] = np.where(one, zeros + ones, p - ones)
        return [p - places[0] for p in places[1:]]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases (one a row, of equal length) the ranges [low, high) of the suffixes that begin with them."""
        low, high = self.first[phrases[:, -1]], self.first[phrases[:, -1] + 1]
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 2, -1, -1):
            symbol = phrases[alive, k]
            a, b = self.rank(symbol, low[alive], high[alive])
            low[alive], high[alive] = self.first[symbol] + a, self.first[symbol] + b
            alive = alive[a < b]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def located(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows begin."""
        count = np.diff(self.first)
        backwards = np.zeros(len(count), np.int64)
        for b in range(self.bits):
            backwards |= ((np.arange(len(count)) >> b) & 1) << (self.bits - 1 - b)
        by = np.argsort(backwards)
        bottom = np.empty(len(count), np.int64)
        bottom[by] = np.cumsum(count[by]) - count[by]
        move = self.first[:-1] - bottom
        out, left, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(left):
            known = self.marks.bit(at).astype(bool)
            out[left[known]] = self.samples[self.marks.ones(at[known])] * STEP + steps
            left, at = left[~known], at[~known]
            symbol = np.zeros(len(at), np.int64)
            for ranks, zeros in zip(self.levels, self.zeros):
                one, ones = ranks.bit(at), ranks.ones(at)
                symbol = (symbol << 1) | one
                at = np.where(one.astype(bool), zeros + ones, at - ones)
            at, steps = at + move[symbol], steps + 1
        return out


class Shard:
    """Documents of one shard while they come in."""

    def __init__(self):
        self.numbers, self.text, self.pieces = Numbers(), array("i"), []

    def add(self, doc: int, ident, words: list[bytes], begin: int, end: int, n: int) -> None:
        """Words ``begin`` to ``end`` of a document of ``n`` are this piece's own; it holds some before and after them besides."""
        a, b = max(0, begin - REACH + 1), min(n, end + REACH - 1)
        self.pieces.append((doc, ident, len(self.text), a, begin, end, n))
        self.text.extend(map(self.numbers.__getitem__, words[a:b]))
        self.text.append(-1)

    def row(self, number: int, kind):
        import pyarrow as pa

        text, count = np.frombuffer(self.text, np.int32).astype(np.int64), len(self.pieces) + len(self.numbers)
        text += len(self.pieces)
        text[np.flatnonzero(np.frombuffer(self.text, np.int32) < 0)] = np.arange(len(self.pieces))
        columns = list(zip(*self.pieces))
        names = ("doc", "doc_id", "at", "first", "begin", "end", "n_words")
        pieces = pa.StructArray.from_arrays([pa.array(c, kind if f == "doc_id" else pa.int64()) for f, c in zip(names, columns)], names)
        data = [number, len(text), count, b"\n".join(self.numbers), *encoded(text, count)]
        fields = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.record_batch([*[pa.array([x], t) for x, t in zip(data, fields)], pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)], names=["shard", "n", "symbols", "words", "levels", "starts", "marks", "samples", "pieces"])


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index, a table in the shared folder with a row for each shard; ``pieces`` lists its documents (doc is a number of
    the row, n_words its words)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        claim("fm_index")
        shard = Shard()
        number = doc = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole):
                for ident, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = terms_of(data)
                    for begin in range(0, max(1, len(words)), PIECE):
                        end = min(len(words), begin + PIECE)
                        if shard.pieces and len(shard.text) + end - begin > WORDS:
                            yield shard.row(number, batch.column(0).type)
                            shard, number = Shard(), number + 1
                        shard.add(doc, ident, words, begin, end, len(words))
                    doc += 1
        if shard.pieces:
            yield shard.row(number, batch.column(0).type)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    pieces = f"array<struct<doc: long, doc_id: {kind}, at: long, first: long, begin: long, end: long, n_words: long>>"
    return written(rows.mapInArrow(run, f"shard long, n long, symbols long, words binary, levels binary, starts binary, marks binary, samples binary, pieces {pieces}"))


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(win, item): windows of ``size`` consecutive words, joined by blanks, and the names of the items that have them; an item of fewer words, but
    not none, is one window."""
    if size > REACH:
        raise ValueError(f"an index answers phrases of at most {REACH} words")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms_of(data)
                found += [(b" ".join(words[k : k + size]), name) for k in range(max(1, len(words) - size + 1)) if words]
            yield pa.record_batch([pa.array([w for w, _ in found], pa.binary()).cast(pa.string()), pa.array([i for _, i in found], pa.string())], names=["win", "item"])

    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "win string, item string").distinct()


def search_shard(row: dict, phrases: list[tuple[list[bytes], int]]) -> tuple[np.ndarray, ...]:
    """(piece, begin, end) of merged spans in words of the document, and (piece, phrase) of what occurs where; row: a shard."""
    pieces = row["pieces"]
    shift, wanted = len(pieces), {w for words, _ in phrases for w in words}
    local = {w: k + shift for k, w in enumerate(row["words"].split(b"\n") if row["words"] else []) if w in wanted}
    by_length: dict[int, list] = {}
    for words, k in phrases:
        if all(w in local for w in words):
            by_length.setdefault(len(words), []).append((k, [local[w] for w in words]))
    nothing = np.zeros(0, np.int64)
    if not by_length:
        return (nothing,) * 5
    index = Index(row["n"], row["symbols"], row["levels"], row["starts"], row["marks"], row["samples"])
    at = np.array([p["at"] for p in pieces], np.int64)
    own_from = at + np.array([p["begin"] - p["first"] for p in pieces])
    own_to = at + np.array([p["end"] - p["first"] for p in pieces])
    cover, which, who = np.zeros(row["n"] + 1, np.int64), [], []
    for length, some in by_length.items():
        names, symbols = np.array([k for k, _ in some]), np.array([s for _, s in some], np.int64)
        low, high = index.ranges(symbols)
        times = high - low
        names, low, times = (x[times > 0] for x in (names, low, times))
        for a in range(0, len(names), 4096):
            n = times[a : a + 4096]
            rows = np.repeat(low[a : a + 4096], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            place = index.located(rows)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + length, -1)
            pair = np.unique((np.searchsorted(at, place, "right") - 1) * (int(names.max()) + 1) + np.repeat(names[a : a + 4096], n))
            which.append(pair // (int(names.max()) + 1))
            who.append(pair % (int(names.max()) + 1))
    if not which:
        return (nothing,) * 5
    hit = np.cumsum(cover[:-1]) > 0
    touched = np.unique(np.concatenate(which))
    own = np.zeros(row["n"] + 2, bool)
    for p in touched.tolist():
        own[own_from[p] + 1 : own_to[p] + 1] = hit[own_from[p] : own_to[p]]
    begin, end = np.flatnonzero(own[1:] & ~own[:-1]), np.flatnonzero(own[:-1] & ~own[1:])
    piece = np.searchsorted(at, begin, "right") - 1
    first = np.array([p["first"] for p in pieces], np.int64)[piece] - at[piece]
    return piece, begin + first, end + first, np.concatenate(which), np.concatenate(who)


def found(index: DataFrame, win: DataFrame) -> DataFrame:
    """(doc, span, item, win): merged spans of hit words, a row each; the items with a window in the document, or the
    windows, where several items share one. One row a shard, document and round; a table in the shared folder."""
    spark = index.sparkSession
    small_batches(spark)
    sole = written(win.groupBy("win").agg(F.count("*").alias("items"), F.min("item").alias("item")))
    rounds = max(1, -(-sole.count() * 5 // (4 * ROUND)))
    parts = []
    for r in range(rounds):
        some = sole.where(F.pmod(F.xxhash64("win"), F.lit(rounds)) == r).toArrow()  # bounded by ROUND
        sent = spark.sparkContext.broadcast(([([w.encode() for w in win.split(" ")], k) for k, win in enumerate(some.column("win").to_pylist())], [None if n > 1 else i for n, i in zip(some.column("items").to_pylist(), some.column("item").to_pylist())], some.column("win").to_pylist()))

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            phrases, item, name = sent.value
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    piece, begin, end, which, who = search_shard(row, phrases)
                    out: dict[int, tuple] = {}
                    for p, a, b in zip(piece.tolist(), begin.tolist(), end.tolist()):
                        out.setdefault(p, ([], set(), set()))[0].append({"a": a, "b": b})
                    for p, w in zip(which.tolist(), who.tolist()):
                        kept = out.setdefault(p, ([], set(), set()))
                        if item[w] is None:
                            kept[2].add(name[w])
                        else:
                            kept[1].add(item[w])
                    docs = [row["pieces"][p]["doc"] for p in out]
                    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                    yield pa.record_batch([pa.array(docs, pa.int64()), pa.array([x[0] for x in out.values()], span), *[pa.array([sorted(x[c]) for x in out.values()], pa.list_(pa.string())) for c in (1, 2)]], names=["doc", "spans", "items", "wins"])

        parts.append(written(index.mapInArrow(run, "doc long, spans array<struct<a: long, b: long>>, items array<string>, wins array<string>")))
        sent.unpersist()
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def removal_spans(hits: DataFrame) -> DataFrame:
    """(doc, begin, end) of the words to remove, apart from each other; hits: as from :func:`found`."""
    spans = hits.select("doc", F.inline("spans")).distinct()
    w = Window.partitionBy("doc").orderBy("a", "b")
    new = F.coalesce(F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).cast("int")
    return spans.withColumn("_n", new).withColumn("_n", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc", "_n").agg(F.min("a").alias("begin"), F.max("b").alias("end")).drop("_n")


def contaminated(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit (words in occurrences of windows), n_items (items with such), items_sha256,
    contaminated."""
    win = written(windows(items, item_id, text))
    hits = found(index, win)
    words = removal_spans(hits).groupBy("doc").agg(F.sum(F.col("end") - F.col("begin")).alias("n_hit"))
    shared = hits.select("doc", F.explode("wins").alias("win")).distinct().join(win, "win").select("doc", "item")
    named = hits.select("doc", F.explode("items").alias("item")).unionByName(shared).distinct()
    named = named.groupBy("doc").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("names"))
    docs = index.select(F.inline("pieces")).where("begin = 0").select("doc", "doc_id", "n_words")
    out = docs.join(words, "doc", "left").join(named, "doc", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", zero("n_hit").alias("n_hit"), zero("n_items").alias("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), (zero("n_hit") > 0).alias("contaminated"))


def decontaminated(spark, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))
    return contaminated(index, table(spark, sf_dir, "benchmark"))


ORACLE = r"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT item, least(len(ws), 10) AS k, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS b, ws FROM i WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(ws[b:b + k - 1], ' ') AS win FROM v),
ks AS (SELECT DISTINCT k FROM win),
p AS (SELECT r, b, ws, len(ws) AS n FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS b FROM w)),
h AS (SELECT p.r, p.b, win.item, win.k FROM p JOIN ks ON p.b + ks.k - 1 <= p.n JOIN win ON win.k = ks.k AND win.win = array_to_string(p.ws[p.b:p.b + ks.k - 1], ' ')),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(b, b + k)) AS x FROM h) GROUP BY r),
g AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN c USING (r) LEFT JOIN g USING (r)"""
