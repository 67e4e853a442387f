"""Queries along tracks and along the ball's path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import series
from loomspan.plans import frame_queries, views
from loomspan.plans.catalog import query

T, B = views.TRACKS, views.BALL
R = [("x", 6), ("y", 6)]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def bh(px, py, ph, qx, qy, qh) -> str:
    a = f"(({qx} - {px}) * {16 / 9!r}e0)"
    return f"(sqrt({a} * {a} + ({qy} - {py}) * ({qy} - {py})) / greatest(({ph} + {qh}) / 2, 0.02e0))"


FOLD = f"""o AS (SELECT trk, frame, x, y, h, row_number() OVER w AS rn, count(*) OVER (PARTITION BY trk) AS n, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(h) OVER w AS nh FROM tracks WINDOW w AS (PARTITION BY trk ORDER BY frame)),
s AS (SELECT trk, frame, rn, n, true AS keep, x AS kx, y AS ky, h AS kh FROM o WHERE rn = 1 UNION ALL
  SELECT trk, frame, rn, n, keep, CASE WHEN keep THEN x ELSE kx END, CASE WHEN keep THEN y ELSE ky END, CASE WHEN keep THEN h ELSE kh END FROM (
   SELECT o.*, s.kx, s.ky, s.kh, CASE WHEN o.n < 3 THEN true WHEN o.rn = o.n THEN {bh('s.kx', 's.ky', 's.kh', 'o.x', 'o.y', 'o.h')} <= 2.0e0 * 0.35e0
     ELSE NOT ({bh('s.kx', 's.ky', 's.kh', 'o.x', 'o.y', 'o.h')} > 0.35e0 AND {bh('o.x', 'o.y', 'o.h', 'o.nx', 'o.ny', 'o.nh')} > 0.35e0 AND {bh('s.kx', 's.ky', 's.kh', 'o.nx', 'o.ny', 'o.nh')} < 0.5e0 * {bh('s.kx', 's.ky', 's.kh', 'o.x', 'o.y', 'o.h')}) END AS keep
   FROM s JOIN o ON o.trk = s.trk AND o.rn = s.rn + 1))"""


@query("outlier_reject", f"WITH RECURSIVE {T}, {FOLD} SELECT trk, frame FROM s WHERE keep")
def outlier_reject(spark, d) -> DataFrame:
    return series.without_round_trips(views.tracks(spark, d), ["trk"]).select("trk", "frame")


@query("smooth3", f"""WITH {T}, o AS (SELECT *, lag(frame) OVER w AS af, lead(frame) OVER w AS cf, lag(x) OVER w AS ax, lead(x) OVER w AS cx, lag(y) OVER w AS ay, lead(y) OVER w AS cy FROM tracks WINDOW w AS (PARTITION BY trk ORDER BY frame)),
k AS (SELECT *, coalesce(frame - af <= 20 AND cf - frame <= 20 AND sqrt((cx - 2 * x + ax) * (cx - 2 * x + ax) + (cy - 2 * y + ay) * (cy - 2 * y + ay)) <= 0.15e0, false) AS ok FROM o)
SELECT trk, frame, round(CASE WHEN ok THEN 0.25e0 * ax + 0.5e0 * x + 0.25e0 * cx ELSE x END, 6) AS x, round(CASE WHEN ok THEN 0.25e0 * ay + 0.5e0 * y + 0.25e0 * cy ELSE y END, 6) AS y FROM k""")
def smooth3(spark, d) -> DataFrame:
    return rounded(series.smoothed(views.tracks(spark, d), ["trk"], max_gap=20, curve=0.15).select("trk", "frame", "x", "y"), "x", "y")


@query("confirmed_sightings", f"WITH {T}, o AS (SELECT trk, frame, lag(frame) OVER w AS a, lead(frame) OVER w AS c, count(*) OVER (PARTITION BY trk) AS n FROM tracks WINDOW w AS (PARTITION BY trk ORDER BY frame)) SELECT trk, frame FROM o WHERE n < 3 OR coalesce(frame - a <= 6, false) OR coalesce(c - frame <= 6, false)")
def confirmed_sightings(spark, d) -> DataFrame:
    return series.confirmed(views.tracks(spark, d), ["trk"], 4).select("trk", "frame")


def seg_sql(key: str = "trk") -> str:
    return f"""sf AS (SELECT *, CASE WHEN frame - lag(frame) OVER w > 15 OR (frame - lag(frame) OVER w > 8 AND sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) > 0.02e0 * (frame - lag(frame) OVER w)) THEN 1 ELSE 0 END AS nw
 FROM (SELECT *, CAST(frame // {views.CLIP_FRAMES} AS INTEGER) AS clip FROM tracks) WINDOW w AS (PARTITION BY {key} ORDER BY frame)), sg AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY {key} ORDER BY frame) AS BIGINT) AS seg FROM sf)"""


def by_clip(spark, d) -> DataFrame:
    return views.tracks(spark, d).withColumn("clip", F.expr(f"int(frame div {views.CLIP_FRAMES})"))


def segments(spark, d, keys: tuple[str, ...] = ("trk",)) -> DataFrame:
    return series.segmented(by_clip(spark, d), list(keys), max_gap=15, step=8, speed=0.02)


@query("segment_gaps", f"WITH {T}, {seg_sql()} SELECT trk, frame, seg FROM sg")
def segment_gaps(spark, d) -> DataFrame:
    return segments(spark, d).select("trk", "frame", "seg")


def grid_sql(key: str = "trk") -> str:
    return seg_sql(key) + f""",
g1 AS (SELECT *, lead(frame) OVER w AS f2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY {key}, seg) AS n FROM sg WINDOW w AS (PARTITION BY {key}, seg ORDER BY frame)),
g2 AS (SELECT *, unnest(range(frame, greatest(CASE WHEN f2 IS NULL THEN least(frame + 2, (SELECT max(frame) FROM tracks)) ELSE f2 - 1 END, frame) + 1)) AS g FROM g1 WHERE n >= 2),
gr AS (SELECT {key}, seg, CAST(g AS INTEGER) AS frame, CASE WHEN f2 IS NULL OR g = frame THEN x ELSE x + (x2 - x) * ((g - frame) / (f2 - frame)) END AS x, CASE WHEN f2 IS NULL OR g = frame THEN y ELSE y + (y2 - y) * ((g - frame) / (f2 - frame)) END AS y FROM g2)"""


GRID = grid_sql()


def grid(spark, d, keys: tuple[str, ...] = ("trk",)) -> DataFrame:
    return series.on_grid(segments(spark, d, keys), [*keys, "seg"], 3)


@query("interpolate_grid", f"WITH {T}, {GRID} SELECT trk, seg, frame, round(x, 6) AS x, round(y, 6) AS y FROM gr")
def interpolate_grid(spark, d) -> DataFrame:
    return rounded(grid(spark, d).select("trk", "seg", "frame", "x", "y"), "x", "y")


OMEGA = 2.0 / 0.10
STEP = OMEGA * (1 / 30)
EX = 1.0 / (1.0 + STEP + 0.48 * STEP * STEP + 0.235 * STEP * STEP * STEP)


def _push(c: str) -> str:
    return f"((s.v{c} + {OMEGA!r}e0 * (s.p{c} - o.{c})) * {1 / 30!r}e0)"


@query("damped_follow", f"""WITH RECURSIVE {T}, {GRID}, o AS (SELECT *, row_number() OVER (PARTITION BY trk, seg ORDER BY frame) AS rn FROM gr),
i AS (SELECT trk, seg, 0 AS rn, x AS px, y AS py, 0.0e0 AS vx, 0.0e0 AS vy, -1 AS frame FROM o WHERE rn = 1),
s AS (SELECT * FROM i UNION ALL SELECT o.trk, o.seg, o.rn, o.x + (s.px - o.x + {_push('x')}) * {EX!r}e0, o.y + (s.py - o.y + {_push('y')}) * {EX!r}e0, (s.vx - {OMEGA!r}e0 * {_push('x')}) * {EX!r}e0, (s.vy - {OMEGA!r}e0 * {_push('y')}) * {EX!r}e0, o.frame
  FROM s JOIN o ON o.trk = s.trk AND o.seg = s.seg AND o.rn = s.rn + 1)
SELECT trk, seg, frame, round(px, 6) AS x, round(py, 6) AS y FROM s WHERE rn > 0""")
def damped_follow(spark, d) -> DataFrame:
    g = grid(spark, d).select("trk", "seg", "frame", "x", "y")
    return rounded(series.damped(g, ["trk", "seg"], 1 / 30, 0.10), "x", "y")


#: the cuts that the cut detector finds in the supplied events, under thresholds at which they have some
CUTS = frame_queries.CUTS.format(ratio="1.5e0", kits="0.7e0") + ", " + frame_queries.DEBOUNCED + ", cu AS (SELECT clip, frame FROM dc)"


def cuts(spark, d) -> DataFrame:
    return frame_queries.found_cuts(spark, d).select("clip", "frame")


@query("fade_profile", f"""WITH RECURSIVE {T}, {grid_sql('clip, trk')}, {CUTS}, e AS (SELECT clip, trk, seg, frame, min(frame) OVER w AS f0, max(frame) OVER w AS f1 FROM gr WINDOW w AS (PARTITION BY clip, trk, seg))
SELECT clip, trk, seg, frame, round(least(CASE WHEN EXISTS (SELECT 1 FROM cu WHERE cu.clip = e.clip AND f0 - cu.frame BETWEEN 0 AND 4) THEN 1.0e0 ELSE least(1.0e0, (frame - f0) / 9.0e0) END,
  CASE WHEN EXISTS (SELECT 1 FROM cu WHERE cu.clip = e.clip AND cu.frame - f1 BETWEEN 0 AND 4) THEN 1.0e0 ELSE least(1.0e0, (f1 - frame) / 9.0e0) END), 6) AS fade FROM e""")
def fade_profile(spark, d) -> DataFrame:
    g = grid(spark, d, ("clip", "trk"))
    return rounded(series.faded(g, ["clip", "trk", "seg"], "clip", cuts(spark, d), 9.0, 3).select("clip", "trk", "seg", "frame", "fade"), "fade")


@query("ball_flat_filter", f"WITH {B}, m AS (SELECT clip, quantile_cont(h, 0.5) AS m, count(*) AS n FROM ball GROUP BY clip) SELECT clip, frame FROM ball JOIN m USING (clip) WHERE n < 8 OR h >= 0.65e0 * m")
def ball_flat_filter(spark, d) -> DataFrame:
    return series.without_flat(views.ball(spark, d), "clip").select("clip", "frame")


SCALE = "fs AS (SELECT clip, frame, list_sort(list(h))[count(*) // 2 + 1] AS scale FROM det GROUP BY clip, frame HAVING count(*) >= 4)"


def scaled(spark, d) -> DataFrame:
    s = series.frame_scale(views.det(spark, d), ["clip", "frame"])
    return series.nearest_scale(views.ball(spark, d), s, "clip", 5)


@query("scale_asof", f"""WITH {B}, {SCALE} SELECT b.clip, b.frame, round(arg_min(fs.scale, (abs(b.frame - fs.frame), fs.frame)), 6) AS scale FROM ball b LEFT JOIN fs ON fs.clip = b.clip AND abs(b.frame - fs.frame) <= 5 GROUP BY ALL""")
def scale_asof(spark, d) -> DataFrame:
    return rounded(scaled(spark, d).select("clip", "frame", "scale"), "scale")


def fixed_point_sql(fps: float, step: int, passes: int = 4) -> str:
    """The ball's filters as recursions over a clip's sightings, whose state is the last one kept: pb0 is what comes in."""
    gap = lambda p, q: f"greatest(({q} - {p}) / {fps!r}e0, 1e-3)"
    far = lambda px, py, qx, qy: f"sqrt(({qx} - {px}) * ({qx} - {px}) + ({qy} - {py}) * ({qy} - {py}))"
    gate = "(CASE WHEN coalesce(o.scale, 0) <> 0 THEN least(14.3e0 * o.scale, 1.2e0) ELSE 1.2e0 END * (0.5e0 + o.conf))"
    jump = "CASE WHEN coalesce(o.scale, 0) <> 0 THEN least(1.19e0 * o.scale, 0.1e0) ELSE 0.1e0 END"
    ab, bc, ac = far("t.kx", "t.ky", "o.x", "o.y"), far("o.x", "o.y", "o.cx", "o.cy"), far("t.kx", "t.ky", "o.cx", "o.cy")
    slow = f"{ab} / {gap('t.kf', 'o.frame')} <= {gate} AND {bc} / {gap('o.frame', 'o.cf')} <= {gate}"
    upright = f"abs(o.y - (t.ky + o.cy) / 2) >= 2.0e0 * abs((o.x - (t.kx + o.cx) / 2) * {16 / 9!r}e0)"
    trips = f"o.n < 3 OR o.rn = o.n OR NOT (o.frame - t.kf <= {2 * step + 1} AND {ab} > {jump} AND {bc} > {jump} AND {ac} < {ab} * 0.5e0 AND NOT ({slow} AND {upright}))"
    speed = f"{ab} / {gap('t.kf', 'o.frame')} <= {gate}"
    out = []
    for k, keep in enumerate([trips, speed] * passes):
        out += [f"po{k} AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY clip) AS n, lead(frame) OVER w AS cf, lead(x) OVER w AS cx, lead(y) OVER w AS cy FROM pb{k} WINDOW w AS (PARTITION BY clip ORDER BY frame))",
                f"ps{k} AS (SELECT clip, rn, true AS keep, frame AS kf, x AS kx, y AS ky FROM po{k} WHERE rn = 1 UNION ALL SELECT clip, rn, keep, CASE WHEN keep THEN frame ELSE kf END, CASE WHEN keep THEN x ELSE kx END, CASE WHEN keep THEN y ELSE ky END FROM (SELECT o.clip, o.rn, o.frame, o.x, o.y, t.kf, t.kx, t.ky, {keep} AS keep FROM ps{k} t JOIN po{k} o ON o.clip = t.clip AND o.rn = t.rn + 1))",
                f"pb{k + 1} AS (SELECT o.clip, o.frame, o.x, o.y, o.w, o.h, o.conf, o.scale FROM po{k} o JOIN ps{k} t ON t.clip = o.clip AND t.rn = o.rn WHERE t.keep)"]
    return ", ".join(out)


@query("ball_fixed_point", f"""WITH RECURSIVE {B}, {SCALE}, pb0 AS (SELECT b.clip, b.frame, any_value(b.x) AS x, any_value(b.y) AS y, any_value(b.w) AS w, any_value(b.h) AS h, any_value(b.conf) AS conf, arg_min(fs.scale, (abs(b.frame - fs.frame), fs.frame)) AS scale
 FROM ball b LEFT JOIN fs ON fs.clip = b.clip AND abs(b.frame - fs.frame) <= 5 GROUP BY b.clip, b.frame), {fixed_point_sql(2.0, 2)}
SELECT clip, frame, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM pb8""")
def ball_fixed_point(spark, d) -> DataFrame:
    return series.ball_fixed_point(scaled(spark, d), "clip", 2.0, 2).select("clip", "frame", *[F.round(c, 6).alias(c) for c in "xywh"])


@query("ball_bridge", f"""WITH RECURSIVE {B}, {CUTS},
n AS (SELECT *, lead(frame) OVER w AS f2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(h) OVER w AS h2 FROM ball WINDOW w AS (PARTITION BY clip ORDER BY frame)),
l AS (SELECT clip, CAST(unnest(range(frame + 1, f2)) AS INTEGER) AS g, * FROM n WHERE f2 - frame <= 4 AND NOT EXISTS (SELECT 1 FROM cu WHERE cu.clip = n.clip AND cu.frame > n.frame AND cu.frame <= f2)),
e AS (SELECT clip, frame, x, y, h, 0 AS p, frame AS o FROM ball UNION ALL
 SELECT clip, g, x + (x2 - x) * ((g - frame) / (f2 - frame)), y + (y2 - y) * ((g - frame) / (f2 - frame)), h + (h2 - h) * ((g - frame) / (f2 - frame)), 1, frame FROM l UNION ALL
 SELECT k.clip, k.frame + j, x, y, h, 2, k.frame FROM ball k, (VALUES (1), (2)) v(j) WHERE k.frame + j <= (SELECT max(frame) FROM det) AND NOT EXISTS (SELECT 1 FROM cu WHERE cu.clip = k.clip AND cu.frame > k.frame AND cu.frame <= k.frame + j))
SELECT clip, frame, round(x, 6) AS x, round(y, 6) AS y, round(h, 6) AS h, ['exact', 'bridge', 'hold'][p + 1] AS kind FROM e QUALIFY row_number() OVER (PARTITION BY clip, frame ORDER BY p, o) = 1""")
def ball_bridge(spark, d) -> DataFrame:
    last = series.last_frame(views.det(spark, d))
    return rounded(series.bridged(views.ball(spark, d), cuts(spark, d), "clip", 4, 3, last).select("clip", "frame", "x", "y", "h", "kind"), "x", "y", "h")


@query("ball_confidence", f"WITH {B} SELECT clip, frame, round(conf, 6) AS conf, conf < 0.82e0 AS low_conf FROM ball")
def ball_confidence(spark, d) -> DataFrame:
    return rounded(series.confident(views.ball(spark, d), 0.82).select("clip", "frame", "conf", "low_conf"), "conf")


@query("crosses_cut", f"WITH RECURSIVE {T}, {CUTS}, c AS (SELECT trk, frame, CAST(frame // {views.CLIP_FRAMES} AS INTEGER) AS clip FROM tracks), n AS (SELECT clip, trk, frame, lead(frame) OVER (PARTITION BY clip, trk ORDER BY frame) AS f2 FROM c) SELECT clip, trk, frame, f2, EXISTS (SELECT 1 FROM cu WHERE cu.clip = n.clip AND cu.frame > n.frame AND cu.frame <= f2) AS crossed FROM n WHERE f2 IS NOT NULL")
def crosses_cut(spark, d) -> DataFrame:
    return series.crossing(by_clip(spark, d).select("clip", "trk", "frame"), ["trk"], "clip", cuts(spark, d)).select("clip", "trk", "frame", "f2", "crossed")


@query("drawn_tracks", f"WITH {T} SELECT trk, count(*) AS observations, min(frame) AS f0, max(frame) AS f1 FROM tracks GROUP BY trk HAVING count(*) >= 4")
def drawn_tracks(spark, d) -> DataFrame:
    return views.tracks(spark, d).groupBy("trk").agg(F.count("*").alias("observations"), F.min("frame").alias("f0"), F.max("frame").alias("f1")).where("observations >= 4")
