"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slot j of the schedule has the point frac(j * golden ratio); mapped through the cumulative target shares it
falls to a source, and its rank among the slots of that source names the block that fills it. A source's
documents are put in an order shuffled by hash and laid on end; the source is this sequence cut into blocks of
equal numbers of words (to within one), and rank r takes block r mod (number of blocks). A document's part in the
mix is thus the words of it that lie in blocks, times how often each block is taken.

Blocks are sized by source, so that a source of any size has ``SLOTS_A_SOURCE`` slots or more: the schedule is off
by a few slots, which is a small part of that. Where even blocks of one word are too few, several slots in a row
stand for one block. A source's share of the slots is its target divided by the words that a slot of it brings.

Nothing is ordered or ranked within a whole source: positions and ranks are sums over buckets plus a rank
within the bucket, so a source with a third of all rows is spread over tasks like any other.

``scheduled`` returns the mix itself: the blocks in the order of their slots, each joined from the words of its documents.
``mix`` adds up what it takes of each document, and ``mixed`` gives whole documents for use as a table.

A source that may be taken ``cap`` times over has slots for so many rounds of its blocks; further ones that the rounding of shares
would give it are passed over, so no document is taken more often.

Targets: sources ordered by code point (null last) weigh 5, 2, 1, repeating, and share the sum of all sizes; a
target stops at ``cap`` times its source's size, and the excess is shared again by weight until none is above.

Edge cases: a null or empty text has size 0 and is never taken; very long texts lie in many blocks; rows that agree in id and
text are ties in the shuffled order and may take different amounts, the same amounts in every run; a null source is a source;
an empty table gives an empty result; further columns, whatever their names, are left out or carried by ``mixed``. A row for each source
goes through the driver (its size and number of rows, from which shares are told), and comes back as a table whose size Spark checks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import carried, cut, row_key, running_total, unpacked

WEIGHTS = (5, 2, 1)
BLANKS = "[\\\\x20\\\\x09-\\\\x0D]+"
SLOTS = 1 << 17
MOST_WORDS = 1 << 16  # in a block
GOLDEN = 11400714819323198485  # 2**64 times the golden ratio's fraction
SLOTS_A_SOURCE = 4096  # at least
SLOTS_A_BUCKET = 4096
ROWS_A_BUCKET = 4096


def shares(sources: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> list[tuple[str | None, int, float]]:
    """(source, size, target), in order, for (source, size) pairs: one row a source, by water filling."""
    ordered = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    left, open_ = float(sum(n for _, n in ordered)), [x for x in ordered if x[1]]
    target = {s: 0.0 for s, _ in ordered}
    while open_:
        per = left / sum(weight[s] for s, _ in open_)
        full = [(s, n) for s, n in open_ if weight[s] * per > cap * n]
        if not full:
            target |= {s: weight[s] * per for s, _ in open_}
            break
        for s, n in full:
            target[s] = cap * n
            left -= cap * n
        over = set(full)
        open_ = [x for x in open_ if x not in over]
    return [(s, n, target[s]) for s, n in ordered]


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", with_text: bool = False) -> DataFrame:
    """(doc_id, source, size, _h, _k1, _k2), size being the number of words and _h what the rows of a source are shuffled by."""
    # a word begins at every character that isn't white space and follows white space or the beginning
    size = F.when(F.length(F.col(text)) > 0, F.size(F.expr(f"filter(split(`{text}`, '{BLANKS}'), w -> w <> '')"))).otherwise(0)
    h = F.md5(F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("binary"))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.cast("long").alias("size"), h.alias("_h"), *row_key(doc_id, text), *([F.col(text).cast("string").alias("_text")] if with_text else []))


def schedule(plan: list[tuple[str | None, int, float]], spark, block: int, slots: int) -> DataFrame:
    """(id, bucket, source_no) of every slot. The cumulative shares are a table of ranges; slots and ranges meet by cells of the unit interval, as
    many as there are sources, so a slot looks at two ranges on average, however many there are."""
    total = sum(t for _, _, t in plan) or 1.0
    rows, run = [], 0.0
    for i, (_, _, target) in enumerate(plan):
        low, run = run, run + target / total
        rows.append((i, low, run if i < len(plan) - 1 else 2.0))
    cells = max(1, len(rows))
    ranges = spark.createDataFrame([r for r in rows if r[2] > r[1]], "source_no int, low double, high double")
    last = F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("low") * cells), F.lit(cells - 1)), last)))
    size = SLOTS_A_BUCKET * max(1, len(plan) // 64)
    j = spark.range(slots).withColumn("bucket", F.expr(f"id div {size}"))
    # the low 53 bits of the product are enough, and exact in a long: j * golden mod 2**52
    step = (GOLDEN >> 12) | 1
    lo, hi = step & ((1 << 26) - 1), step >> 26
    low, high = F.col("id").bitwiseAND(F.lit((1 << 26) - 1)), F.shiftright("id", 26).bitwiseAND(F.lit((1 << 26) - 1))
    # (hi 2^26 + lo)(high 2^26 + low) mod 2^52
    cross = (low * F.lit(hi) + high * F.lit(lo)).bitwiseAND(F.lit((1 << 26) - 1))
    point = (F.shiftleft(cross, 26) + low * F.lit(lo)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    j = j.withColumn("point", point).withColumn("cell", F.floor(F.col("point") * cells))
    return j.join(ranges, "cell").where("point >= low and point < high").select("id", "bucket", "source_no")


def taken_blocks(slots: DataFrame, blocks: DataFrame, cap: float) -> DataFrame:
    """(slot, source_no, block): the block of each slot. ``blocks``: (source_no, n_blocks, per_block), a row a
    source; so many slots in a row stand for one block, and a source has ``cap`` rounds of its blocks at most.

    The rank of a slot among its source's slots is the count in earlier buckets plus its rank in its own.
    """
    per = slots.groupBy("source_no", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("source_no", "bucket").orderBy("id")
    ranked = slots.withColumn("r", F.row_number().over(within) - 1).join(per, ["source_no", "bucket"])
    ranked = ranked.join(blocks, "source_no").where("(first + r) % per_block = per_block div 2").withColumn("turn", F.expr("(first + r) div per_block"))
    return ranked.where(F.col("turn") < cap * F.col("n_blocks")).select(F.col("id").alias("slot"), "source_no", F.expr("turn % n_blocks").alias("block"))


def blocks_of(n: int, target: float, block: int) -> tuple[int, int, float]:
    """(blocks, slots for each, slots in all) of a source of ``n`` words, in blocks of at most ``block``."""
    if not n or not target:
        return 1, 1, 0.0
    n_blocks = -(-n // max(1, min(block, int(target) // SLOTS_A_SOURCE)))
    slots = target * n_blocks / n
    per_block = max(1, int(SLOTS_A_SOURCE // slots))
    return n_blocks, per_block, slots * per_block


def laid_out(rows: DataFrame, weights: tuple[int, ...], cap: float, min_slots: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``sized`` in pieces, one for each block that a row lies in (source_no, block, _at, words from ``begin`` on,
    ``words`` of them, beside the columns of the row), rows of no words with null; and (slot, source_no, block) of the schedule."""
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()  # one row a source
    plan = shares([(r["source"], r["n"]) for r in found], weights, cap)
    many = {r["source"]: r["rows"] for r in found}
    total = sum(n for _, n, _ in plan)
    block = max(1, min(total // min_slots, MOST_WORDS))
    laid = [blocks_of(n, t, block) for _, n, t in plan]
    slots = math.ceil(sum(x[2] for x in laid))
    # the first n % n_blocks blocks of a source have one word more than the others
    facts = [(i, s, n, t, x[0], x[1], n // x[0], n % x[0], max(0, (many[s] // ROWS_A_BUCKET).bit_length())) for i, ((s, n, t), x) in enumerate(zip(plan, laid))]
    by_source = spark.createDataFrame(facts, "source_no int, _s string, source_size long, target double, n_blocks long, per_block long, _short long, _longer long, _bits int")
    placed = rows.join(by_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # the shuffled order is that of _h; its leading bits, more of them for a source with more rows, are the bucket
    bucket = F.when(F.col("_bits") > 0, F.expr("shiftright(cast(conv(substring(_h, 1, 12), 16, 10) as bigint), 48 - greatest(_bits, 1))")).otherwise(F.lit(0).cast("long"))
    placed = running_total(placed, ["source_no"], ["_h"], "size", "_at", bucket)
    due = [(s, n, x[2]) for (s, n, _), x in zip(plan, laid)]
    schedule_ = taken_blocks(schedule(due, spark, block, slots), by_source.select("source_no", "n_blocks", "per_block"), cap)
    holds = "if({0} < _longer * (_short + 1), {0} div (_short + 1), _longer + ({0} - _longer * (_short + 1)) div greatest(_short, 1))"
    spans = F.when(F.col("size") > 0, F.sequence(F.expr(holds.format("_at")), F.expr(holds.format("(_at + size - 1)"))))
    pieces = placed.withColumn("block", F.explode_outer(spans))
    begins = "({0} * _short + least({0}, _longer))"
    pieces = pieces.withColumn("begin", F.expr(f"greatest(_at, {begins.format('block')}) - _at"))
    return pieces.withColumn("words", F.expr(f"least(size, {begins.format('(block + 1)')} - _at) - begin")), schedule_


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, min_slots: int = SLOTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row, and its key (_k1, _k2)."""
    rows = cut(sized(docs, doc_id, text, source).withColumn("_id", F.monotonically_increasing_id()))
    pieces, slots = laid_out(rows, weights, cap, min_slots)
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    took = pieces.join(times, ["source_no", "block"], "left")
    columns = ["doc_id", "source", "size", "source_size", "target", "_k1", "_k2"]
    summed = took.groupBy("_id", *columns).agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
    return summed.select("doc_id", "source", "size", "source_size", "target", "taken", "_k1", "_k2")


def scheduled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, min_slots: int = SLOTS) -> DataFrame:
    """slot, source_no (in the order of sources), block, n_words, doc_ids, text: the mix in the order of ``slot``, each block being the words
    of its documents joined by single blanks. Order or range-partition the result by ``slot`` when it is written."""
    rows = cut(sized(docs, doc_id, text, source, with_text=True))
    pieces, slots = laid_out(rows, weights, cap, min_slots)
    words = F.expr(f"slice(filter(split(_text, '{BLANKS}'), w -> w <> ''), int(begin + 1), int(words))")
    parts = pieces.where("size > 0").select("source_no", "block", F.struct("_at", "doc_id", "words", F.array_join(words, " ").alias("t")).alias("p"))
    # a block has MOST_WORDS words at most
    whole = parts.groupBy("source_no", "block").agg(F.array_sort(F.collect_list("p")).alias("p"))
    out = slots.join(whole, ["source_no", "block"])
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select("slot", "source_no", "block", n.alias("n_words"), F.col("p.doc_id").alias("doc_ids"), F.array_join("p.t", " ").alias("text"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix with their own columns: a row as often as its words are taken, rounded to whole documents (half
    up)."""
    took = mix(docs, doc_id, text, source)
    copies = took.where("taken > 0").groupBy("_k1", "_k2").agg(F.sum(F.expr("(2 * taken + size) div (2 * size)")).alias("_copies"), F.count("*").alias("_rows"))
    joined = carried(docs, doc_id, text).join(copies.where("_copies > 0"), ["_k1", "_k2"])
    # rows that agree in id and text share their copies evenly, the first ones taking what is left over
    first = joined.where("_rows > 1").withColumn("_n", F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_copies")))
    uneven = first.withColumn("_own", F.expr("_copies div _rows + int(_n <= _copies % _rows)")).drop("_n")
    each = joined.where("_rows = 1").withColumn("_own", F.col("_copies")).unionByName(uneven).where("_own > 0")
    return each.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_own").cast("long")))).select(*unpacked(docs.columns))


STEP = (GOLDEN >> 12) | 1
_HOLDS = "CASE WHEN {0} < longer * (short + 1) THEN {0} // (short + 1) ELSE longer + ({0} - longer * (short + 1)) // greatest(short, 1) END"
ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
            md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ' ' || coalesce(text, '')) AS h, row_number() OVER () AS id FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][no % 3 + 1] AS w, 3.0e0 * n / [5, 2, 1][no % 3 + 1] AS full_at FROM s),
c AS (SELECT *, sum(n) OVER () - 3.0e0 * coalesce(sum(n) OVER (ORDER BY full_at, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY full_at, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w WHERE n > 0),
p AS (SELECT arg_min(rest / ws, (full_at, no)) FILTER (WHERE full_at >= rest / ws) AS per FROM c),
t AS (SELECT w.*, CASE WHEN n = 0 THEN 0.0e0 WHEN w * per > 3.0e0 * n THEN 3.0e0 * n ELSE w * per END AS target FROM w, p),
b AS (SELECT *, greatest(1, least(greatest(1, least(CAST(sum(n) OVER () AS BIGINT) // {SLOTS}, {MOST_WORDS})), CAST(floor(target) AS BIGINT) // {SLOTS_A_SOURCE})) AS most FROM t),
k AS (SELECT *, CASE WHEN n = 0 OR target = 0 THEN 1 ELSE (n + most - 1) // most END AS n_blocks FROM b),
l AS (SELECT *, CASE WHEN n = 0 OR target = 0 THEN 0.0e0 ELSE target * n_blocks / n END AS slots, n // n_blocks AS short, n % n_blocks AS longer FROM k),
m AS (SELECT *, CASE WHEN slots = 0 THEN 1 ELSE greatest(1, CAST(floor({SLOTS_A_SOURCE} / slots) AS BIGINT)) END AS per_block FROM l),
q AS (SELECT *, slots * per_block AS due FROM m),
a AS (SELECT list_sum(list(due ORDER BY no)) AS total, CAST(ceil(list_sum(list(due ORDER BY no))) AS BIGINT) AS slots FROM q),
u AS (SELECT list(upto ORDER BY no)[1:-2] AS uppers FROM (SELECT no, sum(due / total) OVER (ORDER BY no) AS upto FROM q, a)),
j AS (SELECT j, len(list_filter(uppers, lambda x: x <= CAST((CAST(j AS HUGEINT) * {STEP}) % {1 << 52} AS DOUBLE) / {float(1 << 52)!r})) AS no
      FROM (SELECT unnest(range(0, slots)) AS j FROM a), u),
r AS (SELECT no, row_number() OVER (PARTITION BY no ORDER BY j) - 1 AS r FROM j),
x AS (SELECT no, r // per_block % n_blocks AS block, count(*) AS times FROM r JOIN q USING (no)
      WHERE r % per_block = per_block // 2 AND r // per_block < 3 * n_blocks GROUP BY ALL),
e AS (SELECT d.*, no, n, target, short, longer, CAST(coalesce(sum(size) OVER (PARTITION BY no ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
z AS (SELECT *, unnest(range({_HOLDS.format('pos')}, {_HOLDS.format('(pos + size - 1)')} + 1)) AS block FROM e WHERE size > 0),
y AS (SELECT id, sum(times * (least(pos + size, (z.block + 1) * short + least(z.block + 1, longer)) - greatest(pos, z.block * short + least(z.block, longer)))) AS taken
      FROM z JOIN x ON x.no = z.no AND x.block = z.block GROUP BY id)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM e LEFT JOIN y USING (id)
"""
