"""Removal of repeated runs of lines with a suffix array over line ids, in DataFrame operations only.

The corpus is a sequence of line ids, with an end after each document. Lines that occur once in the corpus end
every run, so only lines that occur again take part. Prefix doubling gives each position the rank of its
suffix by the first 1, 2, 4, ... lines: a round ranks the pairs (rank, rank 2**k lines on), of which it sorts
the distinct ones by range partitions. As no more than ``min_words`` lines are needed to tell which suffixes
share a run of ``min_words`` words, rounds stop there; the positions in order of rank are the suffix array to
that depth.

A run counts from ``min_words`` words on (50 by default; 1 is every repeated line). Two suffixes have a longest common
prefix of that many words of whole lines if and only if they share the shortest prefix of whole lines that reaches it.
So of the longest common prefixes only whether they reach ``min_words`` is found: the positions that share such a prefix of n
lines are neighbours in the array and form an interval, and n with the ranks of the two overlapping halves of the prefix
(of 2**p lines each) names it. The least position of an interval (by doc_id with nulls last, then key, then line) is the
original, all others are later copies. The same intervals are read from the ends of runs backwards, so that their union
is the whole of each maximal repeated run, and the lines of later copies are deleted.

Segments of repeated lines travel in pieces of ``PIECE`` lines that overlap by as many as a prefix can have, so a document of
any number of lines is no large row; what is deleted travels as ranges of lines.

Edge cases: lines without words (of characters other than ASCII white space) are never deleted and do not
break a run; a null text stays null and an empty one empty; a line of any length is one line; rows that agree
in id and text count as one document and get the same result; an empty table gives an empty result; further
columns, whatever their names, are carried through ``dedup`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import carried, cut, dropped, row_key, unpacked

MIN_WORDS = 50
PIECE = 1024
BLANKS = "[\\\\x20\\\\x09-\\\\x0D]+"


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_k1, _k2, doc_id, line, seq, h, g, words): every line with words; ``seq`` counts these alone, h and g
    are 128 bits of hash."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *row_key(doc_id, text))
    rows = rows.withColumn("parts", F.expr("filter(transform(split(text, '\\n', -1), (x, i) -> struct(x, i)), p -> p.x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    each = rows.select("doc_id", "_k1", "_k2", F.posexplode("parts").alias("seq", "p"))
    words = F.expr(f"size(filter(split(p.x, '{BLANKS}'), w -> w <> ''))")
    return each.select("_k1", "_k2", "doc_id", F.col("p.i").alias("line"), "seq", F.xxhash64("p.x").alias("h"), F.xxhash64("p.x", F.lit(11)).alias("g"), words.alias("words"))


def repeated(lines: DataFrame) -> DataFrame:
    """The lines that occur more than once, each position once."""
    again = lines.groupBy("h", "g").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return lines.join(again, ["h", "g"]).dropDuplicates(["_k1", "_k2", "seq"])


def ranked(rows: DataFrame, pair: list[str], out: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the rank of ``pair`` in ``out``, and the table of ranks. Distinct pairs are sorted by range partitions; their ids
    rise with the partition and the place in it, so no task sees them all."""
    order = cut(rows.select(*pair).distinct().repartitionByRange(*pair).sortWithinPartitions(*pair).withColumn(out, F.monotonically_increasing_id()))
    return rows.join(order, pair), order


def suffix_ranks(positions: DataFrame, rounds: int) -> DataFrame:
    """Columns r0, r1, ... of ``positions`` (_k1, _k2, seg, seq, h, g): ranks by the first 2**k lines."""
    first, order = ranked(positions, ["h", "g"], "r0")
    out = cut(first.drop("h", "g"))
    dropped(order)
    inside = Window.partitionBy("_k1", "_k2", "seg").orderBy("seq")
    for k in range(rounds):
        ahead = out.withColumn("_next", F.coalesce(F.lead(f"r{k}", 1 << k).over(inside), F.lit(-1).cast("long")))
        more, order = ranked(ahead, [f"r{k}", "_next"], f"r{k + 1}")
        before, out = out, cut(more.drop("_next"))
        dropped(before, order)
    return out


def _windows(rounds: int, min_words: int) -> Column:
    """Runs of at least ``min_words`` words in the array ``a`` of a piece of a segment, as short as can be from every line of
    the piece itself on, and up to every such line: (start, n, x, y), x and y being the ranks of the run's overlapping halves."""
    power = "0" if rounds == 0 else "CASE " + " ".join(f"WHEN z.n >= {1 << k} THEN {k}" for k in range(rounds, -1, -1)) + " END"
    rank = "CASE z.p " + " ".join(f"WHEN {k} THEN a[{{0}}].r{k}" for k in range(rounds + 1)) + " END"
    forward = f"transform(a, (e, i) -> struct(i AS start, e.own AS own, array_position(transform(slice(a, i + 1, {min_words}), z -> z.c - e.c + e.words >= {min_words}), true) AS n))"
    backward = f"transform(a, (e, i) -> struct(i AS stop, e.own AS own, array_position(reverse(transform(slice(a, greatest(1, i + 2 - {min_words}), least(i + 1, {min_words})), z -> e.c - z.c + z.words >= {min_words})), true) AS n))"
    both = f"array_distinct(concat(transform(filter({forward}, z -> z.n > 0 and z.own), z -> struct(z.start AS start, z.n AS n)), transform(filter({backward}, z -> z.n > 0 and z.own), z -> struct(int(z.stop - z.n + 1) AS start, z.n AS n))))"
    sized = f"transform({both}, z -> struct(z.start AS start, z.n AS n, {power} AS p))"
    named = "struct(z.start AS start, int(z.n) AS n, " + rank.format("z.start") + " AS x, " + rank.format("int(z.start + z.n - shiftleft(1, z.p))") + " AS y)"
    return F.expr(f"transform({sized}, z -> {named})")


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(_k1, _k2, ranges): the lines, counted from 0, that belong to later copies of a repeated run, as ascending ranges
    (first, last) without gaps in between."""
    found = cut(repeated(lines_of(docs, doc_id, text)))
    inside = Window.partitionBy("_k1", "_k2").orderBy("seq")
    segs = found.withColumn("seg", F.col("seq") - F.row_number().over(inside))
    seg = Window.partitionBy("_k1", "_k2", "seg").orderBy("seq")
    segs = segs.withColumn("c", F.sum("words").over(seg.rowsBetween(Window.unboundedPreceding, 0)))
    # a segment with too few words holds no run
    segs = cut(segs.withColumn("_all", F.sum("words").over(Window.partitionBy("_k1", "_k2", "seg"))).where(F.col("_all") >= min_words).drop("_all"))
    dropped(found)
    shortest = segs.agg(F.min("words")).first()[0]
    if shortest is None:
        return segs.select("_k1", "_k2", F.array(F.struct(F.col("line").alias("first"), F.col("line").alias("last"))).alias("ranges"))
    most = -(-min_words // max(1, shortest))  # lines of a prefix
    rounds = max(0, most.bit_length() - 1)
    ranks = suffix_ranks(segs, rounds)
    dropped(segs)
    # a piece is PIECE lines and the `most - 1` on either side that prefixes of its own lines may have
    pieces = ranks.withColumn("piece", F.explode(F.expr(f"sequence((seq - {most - 1}) div {PIECE}, (seq + {most - 1}) div {PIECE})"))).where("piece >= 0")
    fields = ["seq", "line", "words", "c", F.expr(f"seq div {PIECE} = piece").alias("own"), *[f"r{k}" for k in range(rounds + 1)]]
    held = pieces.groupBy("_k1", "_k2", "doc_id", "seg", "piece").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("a"))
    runs = held.select("doc_id", "_k1", "_k2", F.col("a.line").alias("line_nos"), F.col("a")[0]["seq"].alias("base"), F.explode(_windows(rounds, min_words)).alias("w"))
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_k1", "_k2", (F.col("base") + F.col("w.start")).alias("s"))
    runs = cut(runs.select("_k1", "_k2", F.col("w.n").alias("n"), F.col("w.x").alias("x"), F.col("w.y").alias("y"), place.alias("place"), F.slice("line_nos", F.col("w.start") + 1, F.col("w.n")).alias("lines")))
    dropped(ranks)
    intervals = runs.groupBy("n", "x", "y").agg(F.min("place").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    later = runs.join(intervals, ["n", "x", "y"]).where("place <> first")
    lines = later.select("_k1", "_k2", F.explode("lines").alias("line")).distinct()
    row = Window.partitionBy("_k1", "_k2").orderBy("line")
    ranges = lines.withColumn("_run", F.col("line") - F.row_number().over(row)).groupBy("_k1", "_k2", "_run").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    out = cut(ranges.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges")))
    dropped(runs)
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, length: str | None = None, facts: bool = True) -> DataFrame:
    """``docs`` with the text less its copied lines; ``length`` names a column that follows the text's length. With
    ``facts`` also _l_n_lines and _l_n_removed (where ``docs`` has columns of these names, those of ``docs`` are left out)."""
    gone = copies(docs, doc_id, text, min_words).withColumnRenamed("ranges", "_l_gone")
    # a merge at every size: documents with copied lines grow with the corpus, and can be broadcast only where it is small
    joined = carried(docs, doc_id, text).join(gone.hint("merge"), ["_k1", "_k2"], "left")
    body = F.col("_row")[text]
    # what lies before each range and after the last, so a line is looked at once
    stays = "transform(sequence(0, size(_l_gone)), k -> slice(_l_parts, if(k = 0, 0, _l_gone[k - 1].last + 1) + 1, if(k = size(_l_gone), size(_l_parts), _l_gone[k].first) - if(k = 0, 0, _l_gone[k - 1].last + 1)))"
    joined = joined.withColumn("_l_parts", F.split(body, "\n", -1))
    joined = joined.withColumn("_l_kept", F.when(F.col("_l_gone").isNull(), body).otherwise(F.array_join(F.expr(f"flatten({stays})"), "\n")))
    changed = {text: F.col("_l_kept")}
    if length:
        changed[length] = F.when(F.col("_l_gone").isNotNull(), F.length("_l_kept")).otherwise(F.col("_row")[length]).cast(docs.schema[length].dataType)
    n = [
        F.when(body.isNull(), 0).otherwise(F.size("_l_parts")).cast("long").alias("_l_n_lines"),
        F.coalesce(F.expr("aggregate(_l_gone, 0, (s, r) -> s + r.last - r.first + 1)"), F.lit(0)).cast("long").alias("_l_n_removed"),
    ]
    columns = [c for c in docs.columns if not facts or c not in ("_l_n_lines", "_l_n_removed")]
    return joined.select(*unpacked(columns, changed), *(n if facts else []))


ORACLE = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM d),
e AS (SELECT doc_id, i AS line, parts[i + 1] AS s FROM p, unnest(range(len(parts))) AS t(i)),
l AS (SELECT doc_id, line, s, len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) AS w FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq,
             sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS c FROM l WHERE w > 0),
f AS (SELECT a.doc_id, a.seq AS s0, min(b.seq) AS s1 FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.seq >= a.seq
      AND b.c - a.c + a.w >= 50 GROUP BY ALL),
b AS (SELECT a.doc_id, max(b.seq) AS s0, a.seq AS s1 FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.seq <= a.seq
      AND a.c - b.c + b.w >= 50 GROUP BY a.doc_id, a.seq),
r AS (SELECT * FROM f UNION SELECT * FROM b),
k AS (SELECT r.doc_id, r.s0, r.s1, md5(string_agg(n.s, chr(10) ORDER BY n.seq)) AS h
      FROM r JOIN n ON r.doc_id = n.doc_id AND n.seq BETWEEN r.s0 AND r.s1 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY h, s1 - s0 ORDER BY doc_id, s0) AS copy FROM k),
g AS (SELECT DISTINCT n.doc_id, n.line FROM o JOIN n ON o.doc_id = n.doc_id AND n.seq BETWEEN o.s0 AND o.s1 WHERE copy > 1),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
             coalesce(string_agg(l.s, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT x.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN x.text IS NOT NULL THEN kept END AS text
FROM documents x LEFT JOIN t ON x.doc_id = t.doc_id
"""
