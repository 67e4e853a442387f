"""Queries on detections as boxes, and on scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import scalar
from loomspan.operators import boxes, votes
from loomspan.plans import views
from loomspan.plans.catalog import query

OK = "x BETWEEN -0.10e0 AND 1.50e0 AND y BETWEEN -0.10e0 AND 1.50e0 AND x + w BETWEEN -0.10e0 AND 1.50e0 AND y + h BETWEEN -0.10e0 AND 1.50e0 AND w > 0 AND h > 0"
WIDE = f"({OK} AND (w / h) * {16 / 9!r}e0 > 3.0e0)"
CHECKED = views.DET_RAW + f""",
chk AS (SELECT *, NOT ({OK}) AS off_, {WIDE} AS wide_ FROM det_raw),
cnt AS (SELECT clip, frame, count(*) AS total, count(*) FILTER (WHERE off_ OR wide_) AS dropped, count(*) FILTER (WHERE wide_) AS wide,
               count(*) FILTER (WHERE off_ OR wide_) / greatest(count(*), 1) > 0.40e0 AS frame_rejected FROM chk GROUP BY ALL),
val AS (SELECT chk.* FROM chk JOIN cnt USING (clip, frame) WHERE NOT frame_rejected AND NOT off_ AND NOT wide_)"""
KEYS = ["clip", "frame"]


@query("validate_boxes", f"WITH {CHECKED} SELECT * FROM cnt")
def validate_boxes(spark, d) -> DataFrame:
    return boxes.frame_counts(views.det_raw(spark, d), KEYS)


@query("frame_reject", f"WITH {CHECKED} SELECT clip, frame, idx, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM val")
def frame_reject(spark, d) -> DataFrame:
    out = boxes.valid(views.det_raw(spark, d), KEYS)
    return out.select("clip", "frame", "idx", *[F.round(c, 6).alias(c) for c in "xywh"])


def nms_sql(source: str) -> str:
    over = "greatest(0.0e0, least(o.x + o.w, q.x + q.w) - greatest(o.x, q.x)) * greatest(0.0e0, least(o.y + o.h, q.y + q.h) - greatest(o.y, q.y))"
    box = "{'idx': o.idx, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h, 'kit': o.kit}"
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, idx) AS rn, count(*) OVER (PARTITION BY frame) AS raw FROM {source}),
k AS (SELECT clip, frame, rn, raw, [{box}] AS kept FROM o WHERE rn = 1
      UNION ALL
      SELECT o.clip, o.frame, o.rn, o.raw, CASE WHEN len(list_filter(k.kept, lambda q: {over} / (o.w * o.h + q.w * q.h - {over}) > 0.45e0)) > 0 THEN k.kept
             ELSE list_append(k.kept, {box}) END FROM k JOIN o ON o.frame = k.frame AND o.rn = k.rn + 1),
dd AS (SELECT clip, frame, raw, kept FROM k WHERE rn = raw)"""


@query("nms_dedupe", f"WITH RECURSIVE {views.DET_RAW}, {nms_sql('det_raw')} SELECT clip, frame, b.idx AS idx FROM (SELECT clip, frame, unnest(kept) AS b FROM dd)")
def nms_dedupe(spark, d) -> DataFrame:
    return boxes.deduped(views.det_raw(spark, d), KEYS).select("clip", "frame", "idx")


@query("degenerate_frames", f'WITH RECURSIVE {views.DET_RAW}, {nms_sql("det_raw")} SELECT clip, frame, raw, len(kept) AS "unique" FROM dd WHERE raw >= 4 AND len(kept) / raw < 0.40e0')
def degenerate_frames(spark, d) -> DataFrame:
    return boxes.degenerate(views.det_raw(spark, d), KEYS)


def flagship(spark, d) -> DataFrame:
    good = boxes.deduped(boxes.valid(views.det_raw(spark, d), KEYS), KEYS, carry=("kit",))
    # counted once by frame and kit; teams and frames are told from the counts in one pass
    g = good.groupBy("clip", "frame", "kit").agg(F.count("*").alias("n"), F.min("idx").alias("idx"))
    kits = Window.partitionBy("clip", "kit")
    g = g.withColumns({"_n": F.sum("n").over(kits), "_p": F.min(F.struct("frame", "idx")).over(kits)})
    g = g.withColumn("_r", F.dense_rank().over(Window.partitionBy("clip").orderBy(F.desc("_n"), "_p")))
    team = {c: F.max(F.when(F.col("_r") == r, F.col("kit"))).over(Window.partitionBy("clip")) for r, c in ((1, "team_a"), (2, "team_b"))}
    return g.withColumns(team).groupBy("clip", "frame").agg(F.sum("n").alias("n"), F.first("team_a").alias("team_a"), F.first("team_b").alias("team_b"))


query("clean_frames", f"""WITH RECURSIVE {CHECKED}, {nms_sql('val')}, b AS (SELECT clip, frame, unnest(kept) AS b FROM dd),
g AS (SELECT clip, b.kit AS kit, count(*) AS n, min((frame, b.idx)) AS p FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY n DESC, p) AS r FROM g)
SELECT b.clip, frame, count(*) AS n, any_value(t1.kit) AS team_a, any_value(t2.kit) AS team_b FROM b
LEFT JOIN r t1 ON t1.clip = b.clip AND t1.r = 1 LEFT JOIN r t2 ON t2.clip = b.clip AND t2.r = 2 GROUP BY b.clip, frame""")(flagship)


@query("confidence_split", f"WITH {views.DET} SELECT frame, CASE WHEN conf >= 0.5e0 THEN 'hi' ELSE 'lo' END AS stage, count(*) AS n FROM det GROUP BY ALL")
def confidence_split(spark, d) -> DataFrame:
    return boxes.by_confidence(views.det(spark, d)).groupBy("frame", "stage").agg(F.count("*").alias("n"))


@query("probe_frames", f"WITH {views.DET}, f AS (SELECT DISTINCT clip, frame FROM det), r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS n FROM f) SELECT clip, frame FROM r WHERE n % 10 = 0 AND n < 30")
def probe_frames(spark, d) -> DataFrame:
    return boxes.every_kth(views.det(spark, d).select("clip", "frame").distinct(), "clip", "frame", 10, 3)


CONVENTIONS = [(0, "fraction"), (1, "permille"), (2, "pixel")]


@query("to_fractions", f"""WITH {views.DET}, c AS (SELECT * FROM (VALUES (0, 'fraction'), (1, 'permille'), (2, 'pixel')) v(model, convention)),
m AS (SELECT event_id, CAST(event_id % 3 AS INTEGER) AS model, x * 100 AS x, y * 100 AS y, w * 100 AS w, h * 100 AS h FROM det)
SELECT event_id, round(x / CASE convention WHEN 'permille' THEN 1000.0e0 WHEN 'pixel' THEN 1280.0e0 ELSE 1.0e0 END, 6) AS x,
       round(y / CASE convention WHEN 'permille' THEN 1000.0e0 WHEN 'pixel' THEN 720.0e0 ELSE 1.0e0 END, 6) AS y,
       round(w / CASE convention WHEN 'permille' THEN 1000.0e0 WHEN 'pixel' THEN 1280.0e0 ELSE 1.0e0 END, 6) AS w,
       round(h / CASE convention WHEN 'permille' THEN 1000.0e0 WHEN 'pixel' THEN 720.0e0 ELSE 1.0e0 END, 6) AS h FROM m JOIN c USING (model)""")
def to_fractions(spark, d) -> DataFrame:
    rows = views.det(spark, d).select("event_id", F.expr("int(event_id % 3)").alias("model"), *[(F.col(c) * 100).alias(c) for c in "xywh"]).withColumns({"iw": F.lit(1280.0), "ih": F.lit(720.0)})
    known = spark.createDataFrame(CONVENTIONS, "model int, convention string")
    return boxes.to_fractions(rows, known, "model").select("event_id", *[F.round(c, 6).alias(c) for c in "xywh"])


WIRE = views.DET + """, r AS (SELECT event_id, frame, CASE WHEN event_id % 31 = 0 THEN [CAST(event_id AS VARCHAR), 'x'] ELSE
 [CASE WHEN event_id % 17 = 0 THEN 'bad' ELSE CAST(event_id % 100 AS VARCHAR) END, '0.5', '0.1', '0.2', '  ' || upper(kit) || ' ', CASE WHEN num IS NULL THEN 'n/a' ELSE CAST(num AS VARCHAR) END, '0.75'][1:CASE WHEN event_id % 2 = 0 THEN 7 ELSE 6 END] END AS v FROM det)"""


def wire(spark, d) -> DataFrame:
    """Detections as positional rows of text, some too short and some with a number that can't be read."""
    good = "slice(array(if(event_id % 17 = 0, 'bad', cast(event_id % 100 as string)), '0.5', '0.1', '0.2', concat('  ', upper(kit), ' '), if(num is null, 'n/a', cast(num as string)), '0.75'), 1, if(event_id % 2 = 0, 7, 6))"
    return boxes.wire_rows(views.det(spark, d).select("event_id", "frame", F.expr(f"if(event_id % 31 = 0, array(cast(event_id as string), 'x'), {good})").alias("v")), "v")


@query("wire_rows", f"""WITH {WIRE}
SELECT event_id, len(v) < 6 AS malformed, coalesce(TRY_CAST(v[1] AS DOUBLE), 0) AS x, coalesce(TRY_CAST(v[3] AS DOUBLE), 0) AS w, lower(trim(v[5])) AS kit, TRY_CAST(v[6] AS INTEGER) AS num, coalesce(TRY_CAST(v[7] AS DOUBLE), 1.0e0) AS conf FROM r""")
def wire_rows(spark, d) -> DataFrame:
    return wire(spark, d).select("event_id", "malformed", "x", "w", "kit", "num", "conf")


@query("malformed_rows", f"WITH {WIRE} SELECT frame, count(*) AS malformed_count, list(event_id ORDER BY event_id)[1:5] AS sample FROM r WHERE len(v) < 6 GROUP BY frame")
def malformed_rows(spark, d) -> DataFrame:
    """Frames with rows that the parser found too short: how many, and the first five (a sample, as the report asks)."""
    bad = wire(spark, d).where("malformed")
    return bad.groupBy("frame").agg(F.count("*").alias("malformed_count"), F.slice(F.array_sort(F.collect_list("event_id")), 1, 5).alias("sample"))


@query("ball_range", f"""WITH {views.BALL}, b AS (SELECT clip, frame, CASE WHEN frame % 7 = 3 THEN x * 1000 ELSE x END AS x, CASE WHEN frame % 11 = 4 THEN NULL ELSE y END AS y, CASE WHEN frame % 13 = 5 THEN NULL ELSE w END AS w, h FROM ball),
o AS (SELECT *, coalesce(x BETWEEN -0.10e0 AND 1.50e0 AND y BETWEEN -0.10e0 AND 1.50e0 AND x + coalesce(w, 0) BETWEEN -0.10e0 AND 1.50e0 AND y + h BETWEEN -0.10e0 AND 1.50e0, false) AS ok FROM b)
SELECT clip, frame, round(CASE WHEN ok THEN x END, 6) AS x, round(CASE WHEN ok THEN y END, 6) AS y, NOT ok AS ball_dropped FROM o""")
def ball_range(spark, d) -> DataFrame:
    b = views.ball(spark, d).withColumns({"x": F.expr("if(frame % 7 = 3, x * 1000, x)"), "y": F.expr("if(frame % 11 = 4, null, y)"), "w": F.expr("if(frame % 13 = 5, null, w)")})
    return boxes.ball_in_range(b).select("clip", "frame", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "ball_dropped")


@query("to_pixels", f"WITH {views.DET} SELECT event_id, round(x * 1280, 4) AS x, round(y * 720, 4) AS y, round(w * 1280, 4) AS w, round(h * 720, 4) AS h FROM det")
def to_pixels(spark, d) -> DataFrame:
    rows = views.det(spark, d).withColumns({"iw": F.lit(1280.0), "ih": F.lit(720.0)})
    return boxes.from_fractions(rows).select("event_id", *[F.round(c, 4).alias(c) for c in "xywh"])


@query("top_candidate", f"""WITH {views.DET}, f AS (SELECT frame, list(idx ORDER BY idx) FILTER (WHERE kit = 'purchase') AS balls FROM det GROUP BY frame)
SELECT frame, balls[1] AS ball, coalesce(len(balls), 0) AS n_candidates FROM f""")
def top_candidate(spark, d) -> DataFrame:
    f = views.det(spark, d).groupBy("frame").agg(F.array_sort(F.collect_list(F.when(F.col("kit") == "purchase", F.col("idx")))).alias("balls"))
    return boxes.top_candidate(f).select("frame", "ball", F.size("balls").cast("long").alias("n_candidates"))


ROMAN = "CASE WHEN count(*) > 0 THEN list_aggregate(list_transform([(1000,'M'),(900,'CM'),(500,'D'),(400,'CD'),(100,'C'),(90,'XC'),(50,'L'),(40,'XL'),(10,'X'),(9,'IX'),(5,'V'),(4,'IV'),(1,'I')], lambda s: repeat(s[2], CASE s[1] WHEN 1000 THEN (l_partkey + 1) // 1000 WHEN 900 THEN (l_partkey + 1) % 1000 // 900 WHEN 500 THEN (l_partkey + 1) % 1000 % 900 // 500 WHEN 400 THEN (l_partkey + 1) % 500 // 400 * CAST((l_partkey + 1) % 1000 < 900 AS INTEGER) WHEN 100 THEN CASE WHEN (l_partkey + 1) % 1000 >= 900 OR (l_partkey + 1) % 500 >= 400 THEN 0 ELSE (l_partkey + 1) % 500 // 100 END WHEN 90 THEN (l_partkey + 1) % 100 // 90 WHEN 50 THEN (l_partkey + 1) % 100 % 90 // 50 WHEN 40 THEN CASE WHEN (l_partkey + 1) % 100 >= 90 THEN 0 ELSE (l_partkey + 1) % 50 // 40 END WHEN 10 THEN CASE WHEN (l_partkey + 1) % 100 >= 90 OR (l_partkey + 1) % 50 >= 40 THEN 0 ELSE (l_partkey + 1) % 50 // 10 END WHEN 9 THEN (l_partkey + 1) % 10 // 9 WHEN 5 THEN CASE WHEN (l_partkey + 1) % 10 = 9 THEN 0 ELSE (l_partkey + 1) % 10 // 5 END WHEN 4 THEN CASE WHEN (l_partkey + 1) % 10 = 9 THEN 0 ELSE (l_partkey + 1) % 5 // 4 END ELSE CASE WHEN (l_partkey + 1) % 5 = 4 THEN 0 ELSE (l_partkey + 1) % 5 END END)), 'string_agg', '') END"
DIGIT = "chr(CAST(97 + ({0}) % 26 AS INTEGER))"
#: Small letters in bijective base 26: two letters begin at 26, three at 702, four at 18278, which is enough for 475,254 numbers.
LETTERS = " ".join(f"WHEN l_partkey < {stop} THEN " + " || ".join(DIGIT.format(f"(l_partkey - {start}) // {26**k}") for k in range(n - 1, -1, -1)) for n, (start, stop) in enumerate([(0, 26), (26, 702), (702, 18278), (18278, 475254)], 1))


@query("roman_label", f"SELECT l_partkey AS n, CASE WHEN l_partkey < 3999 THEN {ROMAN} ELSE CASE {LETTERS} END END AS label FROM lineitem GROUP BY l_partkey")
def roman_label(spark, d) -> DataFrame:
    n = views.table(spark, d, "lineitem").select(F.col("l_partkey").alias("n")).distinct()
    return n.withColumn("label", scalar.roman(F.col("n")))


WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: length(w) > 3))"


@query("word_jaccard", f"""WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
w AS (SELECT conv_id, turn, {WORDS.format('text')} AS a, {WORDS.format('next')} AS b FROM c WHERE next IS NOT NULL AND text IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0e0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM w""")
def word_jaccard(spark, d) -> DataFrame:
    c = views.table(spark, d, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null and text is not null")
    return c.select("conv_id", "turn", F.round(scalar.word_jaccard(F.col("text"), F.col("next")), 6).alias("jaccard"))


@query("slug_normalise", "SELECT p_partkey AS id, left(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS tag FROM part")
def slug_normalise(spark, d) -> DataFrame:
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), scalar.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("tag"))


@query("label_suffix", "SELECT p_partkey AS id, list_last(string_split(p_brand || '·' || p_type, '·')) AS label FROM part")
def label_suffix(spark, d) -> DataFrame:
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), scalar.label_suffix(F.concat_ws("·", "p_brand", "p_type")).alias("label"))


@query("sample_index", "SELECT o_orderkey AS i, CAST(round_even(o_orderkey * 30.0e0 / 12.0e0, 0) AS INTEGER) AS source_frame FROM orders")
def sample_index(spark, d) -> DataFrame:
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), scalar.source_index(F.col("o_orderkey"), 30.0, 12.0).alias("source_frame"))


def _lab_sql(c: str) -> str:
    lin = lambda v: f"CASE WHEN {v} / 255.0e0 <= 0.04045e0 THEN {v} / 255.0e0 / 12.92e0 ELSE pow(({v} / 255.0e0 + 0.055e0) / 1.055e0, 2.4e0) END"
    f = lambda t: f"CASE WHEN {t} > 0.008856e0 THEN pow({t}, 1.0e0 / 3.0e0) ELSE 7.787e0 * {t} + 16.0e0 / 116.0e0 END"
    return f"""{c}l AS (SELECT id, {lin('r')} AS r, {lin('g')} AS g, {lin('b')} AS b FROM {c}),
{c}x AS (SELECT id, (0.4124e0 * r + 0.3576e0 * g + 0.1805e0 * b) / 0.95047e0 AS x, 0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b AS y, (0.0193e0 * r + 0.1192e0 * g + 0.9505e0 * b) / 1.08883e0 AS z FROM {c}l),
{c}f AS (SELECT id, {f('x')} AS x, {f('y')} AS y, {f('z')} AS z FROM {c}x)"""


@query("delta_e_pairs", f"""WITH p AS (SELECT p_partkey AS id, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 53 % 256 AS b FROM part),
q AS (SELECT p_partkey AS id, (p_partkey * 11 + 40) % 256 AS r, p_partkey * 71 % 256 AS g, (p_partkey * 29 + 9) % 256 AS b FROM part), {_lab_sql('p')}, {_lab_sql('q')}
SELECT pf.id, round(sqrt(pow(116.0e0 * (pf.y - qf.y), 2) + pow(500.0e0 * ((pf.x - pf.y) - (qf.x - qf.y)), 2) + pow(200.0e0 * ((pf.y - pf.z) - (qf.y - qf.z)), 2)), 4) AS delta_e FROM pf JOIN qf USING (id)""")
def delta_e_pairs(spark, d) -> DataFrame:
    c = lambda e: F.expr(f"({e}) % 256")
    p = c("p_partkey * 37"), c("p_partkey * 91"), c("p_partkey * 53")
    q = c("p_partkey * 11 + 40"), c("p_partkey * 71"), c("p_partkey * 29 + 9")
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(scalar.delta_e(p, q), 4).alias("delta_e"))


@query("opposite_hue", """WITH p AS (SELECT p_partkey AS id, (p_partkey * 37 % 256) / 255.0e0 AS r, (p_partkey * 91 % 256) / 255.0e0 AS g, (p_partkey * 53 % 256) / 255.0e0 AS b FROM part),
m AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS sp FROM p),
h AS (SELECT *, CASE WHEN sp = 0 THEN 0.0e0 WHEN hi = r THEN (g - b) / sp + CASE WHEN g < b THEN 6.0e0 ELSE 0.0e0 END WHEN hi = g THEN (b - r) / sp + 2.0e0 ELSE (r - g) / sp + 4.0e0 END / 6.0e0 AS h0 FROM m),
t AS (SELECT id, (CASE WHEN h0 + 0.5e0 >= 1.0e0 THEN h0 + 0.5e0 - 1.0e0 ELSE h0 + 0.5e0 END) * 6.0e0 AS h, greatest(CASE WHEN hi = 0 THEN 0.0e0 ELSE sp / hi END, 0.75e0) AS s, greatest(hi, 0.85e0) AS v FROM h),
u AS (SELECT id, CAST(floor(h) AS INTEGER) % 6 AS i, v, v * (1.0e0 - s) AS p, v * (1.0e0 - s * (h - floor(h))) AS q, v * (1.0e0 - s * (1.0e0 - (h - floor(h)))) AS t FROM t)
SELECT id, CAST(round_even(255.0e0 * [v, q, p, p, t, v][i + 1], 0) AS INTEGER) AS r, CAST(round_even(255.0e0 * [t, v, v, q, p, p][i + 1], 0) AS INTEGER) AS g, CAST(round_even(255.0e0 * [p, p, t, v, v, q][i + 1], 0) AS INTEGER) AS b FROM u""")
def opposite_hue(spark, d) -> DataFrame:
    c = scalar.opposite(F.expr("p_partkey * 37 % 256"), F.expr("p_partkey * 91 % 256"), F.expr("p_partkey * 53 % 256"))
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), c[0].alias("r"), c[1].alias("g"), c[2].alias("b"))


WORDS_SQL = ", ".join(f"('{w}', {r}, {g}, {b})" for w, (r, g, b) in scalar.PALETTE.items())


@query("named_colour", f"WITH c AS (SELECT * FROM (VALUES {WORDS_SQL}) v(word, r, g, b)) SELECT p_partkey AS id, coalesce(c.r, 150) AS r, coalesce(c.g, 150) AS g, coalesce(c.b, 150) AS b, c.word IS NULL AS unknown FROM part LEFT JOIN c ON c.word = lower(trim(string_split(p_name, ' ')[1]))")
def named_colour(spark, d) -> DataFrame:
    known = spark.createDataFrame([(w, *rgb) for w, rgb in scalar.PALETTE.items()], "word string, r int, g int, b int")
    p = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.trim(F.substring_index("p_name", " ", 1))).alias("word"))
    return p.join(F.broadcast(known), "word", "left").select("id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zip("rgb", scalar.GREY)], F.col("r").isNull().alias("unknown"))


@query("gate_width", f"""WITH {views.DET} SELECT event_id, round(least(least(12.0e0 * greatest(h, 0.02e0), 0.88e0) * 0.2e0 + 0.01e0, 1.5e0 * 0.1e0), 6) AS gate FROM det""")
def gate_width(spark, d) -> DataFrame:
    return views.det(spark, d).select("event_id", F.round(scalar.gate_width(F.col("h"), F.lit(0.2), F.lit(0.1)), 6).alias("gate"))


@query("smoothstep", f"WITH {views.DET} SELECT event_id, round(greatest(0.0e0, least(1.0e0, conf)) * greatest(0.0e0, least(1.0e0, conf)) * (3.0e0 - 2.0e0 * greatest(0.0e0, least(1.0e0, conf))), 6) AS eased FROM det")
def smoothstep(spark, d) -> DataFrame:
    return views.det(spark, d).select("event_id", F.round(scalar.smoothstep(F.col("conf")), 6).alias("eased"))


@query("marker_radius", f"WITH {views.DET} SELECT event_id, round(least(greatest((w * 1280 + h * 720) / 4.0e0, 4.0e0), 18.0e0), 6) AS radius FROM det")
def marker_radius(spark, d) -> DataFrame:
    return views.det(spark, d).select("event_id", F.round(F.least(F.greatest(F.expr("(w * 1280 + h * 720) / 4.0e0"), F.lit(4.0)), F.lit(18.0)), 6).alias("radius"))
