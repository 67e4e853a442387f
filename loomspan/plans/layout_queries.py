"""Queries on label layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import scalar
from loomspan.operators import layout
from loomspan.plans import views
from loomspan.plans.catalog import ORACLE, QUERIES, query

D = views.DET
KEYS = ["clip", "frame"]
LABELS = D + ", lb AS (SELECT clip, frame, idx, (x + w / 2) * 1280 AS cx, (y - h) * 720 - 20 AS top, 30.0e0 + idx % 3 * 10 AS w, 14.0e0 AS h, h * 720 AS priority FROM det)"


def labels(spark, d) -> DataFrame:
    return views.det(spark, d).select("clip", "frame", "idx", F.expr("(x + w / 2) * 1280").alias("cx"), F.expr("(y - h) * 720 - 20").alias("top"), F.expr("30.0e0 + idx % 3 * 10").alias("w"), F.lit(14.0).alias("h"), F.expr("h * 720").alias("priority"))


@query("rank_fade", f"""WITH {views.BALL}, j AS (SELECT d.clip, d.frame, d.idx, b.x AS bx, d.idx % 11 = 0 AS on_ball, sqrt((d.x - b.x) * (d.x - b.x) + (d.y - b.y) * (d.y - b.y)) AS dist FROM det d LEFT JOIN ball b USING (clip, frame)),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY dist, idx) - 1 AS r, count(*) OVER (PARTITION BY frame) AS n FROM j)
SELECT clip, frame, idx, round(CASE WHEN bx IS NULL OR n <= 6 OR on_ball OR r < 6 THEN 1.0e0 WHEN r < 10 THEN 1.0e0 - (r - 6 + 1) / 5 ELSE 0.38e0 END, 6) AS alpha FROM r""")
def rank_fade(spark, d) -> DataFrame:
    p = views.det(spark, d).select("clip", "frame", "idx", "x", "y", F.expr("idx % 11 = 0").alias("on_ball"))
    return layout.rank_fade(p, views.ball(spark, d), KEYS).select("clip", "frame", "idx", F.round("alpha", 6).alias("alpha"))


MOVED = LABELS + """,
o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY priority DESC, idx) AS rn, count(*) OVER (PARTITION BY frame) AS n, list_transform(range(0, 6), lambda k: top - k * greatest(1.0e0, h * 0.75e0)) AS ys FROM lb),
s AS (SELECT clip, frame, rn, n, [{'idx': idx, 'x0': cx - w / 2, 'x1': cx + w / 2, 'y0': top, 'y1': top + h, 'u': false}] AS kept FROM o WHERE rn = 1 UNION ALL
  SELECT clip, frame, rn, n, list_append(kept, {'idx': idx, 'x0': cx - w / 2, 'x1': cx + w / 2, 'y0': ys[pos], 'y1': ys[pos] + h, 'u': u}) FROM (
    SELECT o.*, s.kept, coalesce(list_position(list_transform(o.ys[1:5], lambda y: len(list_filter(s.kept, lambda q: NOT (o.cx + o.w / 2 <= q.x0 OR o.cx - o.w / 2 >= q.x1 OR y + o.h <= q.y0 OR y >= q.y1))) = 0), true), 0) = 0 AS u,
      coalesce(nullif(list_position(list_transform(o.ys[1:5], lambda y: len(list_filter(s.kept, lambda q: NOT (o.cx + o.w / 2 <= q.x0 OR o.cx - o.w / 2 >= q.x1 OR y + o.h <= q.y0 OR y >= q.y1))) = 0), true), 0), 6) AS pos
    FROM s JOIN o ON o.frame = s.frame AND o.rn = s.rn + 1)),
mv AS (SELECT clip, frame, p.idx AS idx, p.y0 AS y, p.u AS unresolved FROM (SELECT clip, frame, unnest(kept) AS p FROM s WHERE rn = n))"""


@query("label_collisions", f"WITH RECURSIVE {MOVED} SELECT clip, frame, idx, round(y, 4) AS y, unresolved FROM mv")
def label_collisions(spark, d) -> DataFrame:
    return layout.moved_labels(labels(spark, d), KEYS).withColumn("y", F.round("y", 4))


OVER = """SELECT a.clip, a.frame, a.idx, round(coalesce(min(CASE WHEN bw IS NOT NULL AND ox > 0 AND oy > 0 THEN 1.0e0 - 0.55e0 * least(1.0e0, ox * oy / greatest(1.0e0, least(aw, bw))) END), 1.0e0), 6) AS alpha FROM (
 SELECT a.clip, a.frame, a.idx, least(a.cx + a.w / 2, b.cx + b.w / 2) - greatest(a.cx - a.w / 2, b.cx - b.w / 2) AS ox, least(a.top + a.h, b.top + b.h) - greatest(a.top, b.top) AS oy, a.w * a.h AS aw, b.w * b.h AS bw
 FROM lb a LEFT JOIN lb b ON a.frame = b.frame AND a.idx <> b.idx) a GROUP BY ALL"""


@query("overlap_alpha", f"WITH {LABELS} {OVER}")
def overlap_alpha(spark, d) -> DataFrame:
    return layout.overlap_alpha(labels(spark, d).withColumnRenamed("top", "y"), KEYS).select("clip", "frame", "idx", F.round("alpha", 6).alias("alpha"))


@query("density_alpha", f"""WITH {LABELS}, n AS (SELECT a.clip, a.frame, a.idx, count(*) FILTER (WHERE a.idx <> b.idx AND abs(a.cx - b.cx) < 4.0e0 * greatest(a.w, 1.0e0) AND abs(a.top - b.top) < 2.0e0 * a.h) AS near, count(*) AS n FROM lb a JOIN lb b ON a.frame = b.frame GROUP BY ALL)
SELECT clip, frame, idx, near, round(CASE WHEN n > 5 AND near >= 5 THEN 1.0e0 - 0.45e0 * least(1.0e0, (near - 4) / 5.0e0) ELSE 1.0e0 END, 6) AS alpha FROM n""")
def density_alpha(spark, d) -> DataFrame:
    return layout.density_alpha(labels(spark, d).withColumnRenamed("top", "y"), KEYS).withColumn("alpha", F.round("alpha", 6))


P = "(least(1.0e0, CASE WHEN abs(o.v - s.dst) > 0.5e0 THEN 0.0e0 ELSE s.p END + 0.4e0))"
SRC, DST = "(CASE WHEN abs(o.v - s.dst) > 0.5e0 THEN s.cur ELSE s.src END)", "(CASE WHEN abs(o.v - s.dst) > 0.5e0 THEN o.v ELSE s.dst END)"


@query("label_offsets", f"""WITH RECURSIVE {views.TRACKS}, o AS (SELECT trk, frame, CAST(coalesce(num, 0) AS DOUBLE) AS v, row_number() OVER (PARTITION BY trk ORDER BY frame) AS rn FROM tracks),
i AS (SELECT trk, -1 AS frame, 0 AS rn, v AS cur, v AS src, v AS dst, 1.0e0 AS p FROM o WHERE rn = 1),
s AS (SELECT * FROM i UNION ALL SELECT o.trk, o.frame, o.rn, {SRC} + ({DST} - {SRC}) * ({P} * {P} * (3.0e0 - 2.0e0 * {P})), {SRC}, {DST}, {P} FROM s JOIN o ON o.trk = s.trk AND o.rn = s.rn + 1)
SELECT trk, frame, round(cur, 6) AS "offset" FROM s WHERE rn > 0""")
def label_offsets(spark, d) -> DataFrame:
    t = views.tracks(spark, d).select("trk", "frame", F.coalesce("num", F.lit(0)).alias("offset"))
    return layout.eased_offsets(t, ["trk"], 10.0).withColumn("offset", F.round("offset", 6))


@query("maximin_colour", """WITH c AS (SELECT p_partkey AS cand, CAST(p_partkey * 37 % 256 AS INTEGER) AS r, CAST(p_partkey * 91 % 256 AS INTEGER) AS g, CAST(p_partkey * 53 % 256 AS INTEGER) AS b FROM part),
t AS (SELECT * FROM (VALUES (245, 245, 245), (24, 24, 26), (206, 32, 41)) v(r, g, b)), d AS (SELECT cand, min(sqrt((c.r - t.r) * (c.r - t.r) + (c.g - t.g) * (c.g - t.g) + (c.b - t.b) * (c.b - t.b))) AS distance FROM c, t GROUP BY cand)
SELECT cand, round(distance, 4) AS distance FROM d ORDER BY d.distance DESC, cand LIMIT 1""")
def maximin_colour(spark, d) -> DataFrame:
    c = views.table(spark, d, "part").select(F.col("p_partkey").alias("cand"), F.expr("int(p_partkey * 37 % 256)").alias("r"), F.expr("int(p_partkey * 91 % 256)").alias("g"), F.expr("int(p_partkey * 53 % 256)").alias("b"))
    t = spark.createDataFrame([scalar.PALETTE[w] for w in ("white", "black", "red")], "tr int, tg int, tb int")
    dist = F.expr("sqrt(double((r - tr) * (r - tr) + (g - tg) * (g - tg) + (b - tb) * (b - tb)))")
    return layout.farthest_candidate(c, t, dist).withColumn("distance", F.round("distance", 4))


@query("channel_median", f"WITH {D} SELECT frame, list_sort(list(CAST(x * 255 AS INTEGER)))[count(*) // 2 + 1] AS r, list_sort(list(CAST(conf * 255 AS INTEGER)))[count(*) // 2 + 1] AS g FROM det GROUP BY frame")
def channel_median(spark, d) -> DataFrame:
    p = views.det(spark, d).select("frame", F.rint(F.expr("x * 255")).cast("int").alias("r"), F.rint(F.expr("conf * 255")).cast("int").alias("g"))
    return p.groupBy("frame").agg(*[scalar.index_percentile(F.collect_list(c), 0.5).alias(c) for c in "rg"])


for _name in ("label_collisions", "overlap_alpha", "density_alpha"):  # the names of the time when these took a quarter of the frames
    query(f"{_name}_whole", ORACLE.get(_name))(QUERIES[_name])
