"""Queries on frames: spacing, cuts, camera motion, gates, ground plane, possession."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import scalar
from loomspan.operators import frames, votes
from loomspan.plans import views
from loomspan.plans.catalog import query

D = views.DET


@query("team_topk", f"WITH {D}, g AS (SELECT kit, count(*) AS n, min((frame, idx)) AS p FROM det GROUP BY kit) SELECT kit, n, CAST(row_number() OVER (ORDER BY n DESC, p) AS INTEGER) AS rank FROM g QUALIFY rank <= 2")
def team_topk(spark, d) -> DataFrame:
    return votes.top_values(views.det(spark, d), [], "kit", F.struct("frame", "idx"), 2)


@query("kit_vote", f"WITH {D}, g AS (SELECT trk, kit, count(*) AS n, min((frame, idx)) AS p FROM det GROUP BY ALL) SELECT trk, kit, n FROM g QUALIFY row_number() OVER (PARTITION BY trk ORDER BY n DESC, p) = 1")
def kit_vote(spark, d) -> DataFrame:
    return votes.mode_vote(views.det(spark, d).withColumn("p", F.struct("frame", "idx")), ["trk"], "kit", "p")


@query("accent_vote", f"WITH {D}, g AS (SELECT kit, num AS accent, count(*) AS n, min((frame, idx)) AS p FROM det WHERE num IS NOT NULL GROUP BY ALL) SELECT kit, accent, n FROM g QUALIFY row_number() OVER (PARTITION BY kit ORDER BY n DESC, p) = 1")
def accent_vote(spark, d) -> DataFrame:
    rows = views.det(spark, d).where("num is not null").select("kit", F.col("num").alias("accent"), F.struct("frame", "idx").alias("p"))
    return votes.mode_vote(rows, ["kit"], "accent", "p")


NUMBERS = """nv AS (SELECT trk, num, sum(conf) AS weight, count(*) AS times, min((frame, idx)) AS p FROM det WHERE num IS NOT NULL GROUP BY ALL),
nb AS (SELECT * FROM nv QUALIFY row_number() OVER (PARTITION BY trk ORDER BY round(weight, 9) DESC, p) = 1)"""


@query("number_vote", f"WITH {D}, {NUMBERS} SELECT trk, CASE WHEN weight >= 1.2e0 AND times >= 2 THEN num END AS num, times, round(weight, 6) AS weight FROM nb")
def number_vote(spark, d) -> DataFrame:
    rows = views.det(spark, d).withColumn("p", F.struct("frame", "idx"))
    return votes.number_vote(rows, ["trk"], position="p").withColumn("weight", F.round("weight", 6))


PTS = D + ", pts AS (SELECT clip, frame, idx, x + w / 2 AS x, y + h AS y, h, kit, trk FROM det)"


def points(spark, d) -> DataFrame:
    return views.det(spark, d).select("clip", "frame", "idx", F.expr("x + w / 2").alias("x"), F.expr("y + h").alias("y"), "w", "h", "kit", "num", "conf", "trk")


NEAR = PTS + ", nn AS (SELECT a.clip, a.frame, a.idx, min(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) AS nearest FROM pts a JOIN pts b ON a.frame = b.frame AND a.idx <> b.idx GROUP BY ALL)"


@query("nn_distance", f"WITH {NEAR} SELECT clip, frame, idx, round(nearest, 6) AS nearest FROM nn")
def nn_distance(spark, d) -> DataFrame:
    return frames.nearest_other(points(spark, d), ["clip", "frame"]).withColumn("nearest", F.round("nearest", 6))


@query("clip_spacing", f"WITH {NEAR} SELECT clip, count(*) AS samples, CASE WHEN count(*) >= 40 THEN round(list_sort(list(nearest))[count(*) // 4 + 1], 6) END AS spacing FROM nn GROUP BY clip")
def clip_spacing(spark, d) -> DataFrame:
    return frames.clip_spacing(points(spark, d), "clip", ["frame"]).withColumn("spacing", F.round("spacing", 6))


L1 = """kc AS (SELECT clip, frame, kit, count(*) AS n FROM det GROUP BY ALL), fc AS (SELECT clip, frame, sum(n) AS al, lag(frame) OVER (PARTITION BY clip ORDER BY frame) AS prev FROM kc GROUP BY clip, frame),
sh AS (SELECT kc.clip, kc.frame, kit, n / al AS s FROM kc JOIN fc USING (clip, frame)),
ks AS (SELECT DISTINCT f.clip, f.frame, f.prev, s.kit FROM fc f JOIN sh s ON s.clip = f.clip AND s.frame IN (f.frame, f.prev) WHERE prev IS NOT NULL),
l1 AS (SELECT ks.clip, ks.frame, round(sum(abs(coalesce(p.s, 0) - coalesce(c.s, 0))), 9) AS kit_l1 FROM ks LEFT JOIN sh c ON c.clip = ks.clip AND c.frame = ks.frame AND c.kit = ks.kit
       LEFT JOIN sh p ON p.clip = ks.clip AND p.frame = ks.prev AND p.kit = ks.kit GROUP BY ALL)"""


@query("kit_l1", f"WITH {D}, {L1} SELECT clip, frame, round(kit_l1, 6) AS kit_l1 FROM l1")
def kit_l1(spark, d) -> DataFrame:
    return frames.kit_l1(views.det(spark, d), "clip").withColumn("kit_l1", F.round("kit_l1", 6))


CUTS = L1 + """, pf AS (SELECT clip, frame, median(h) AS med_h, count(*) AS n FROM det GROUP BY ALL),
pb AS (SELECT *, lag(med_h) OVER w AS pm, lag(n) OVER w AS pn FROM pf WINDOW w AS (PARTITION BY clip ORDER BY frame)),
cs AS (SELECT pb.clip, pb.frame, abs(med_h - pm) / greatest(pm, 1e-4) AS h_ratio, abs(n - pn) AS d_n, greatest(n, pn) / greatest(least(n, pn), 1) AS n_ratio, kit_l1,
       CAST(greatest(n, pn) >= 4 AND (abs(med_h - pm) / greatest(pm, 1e-4) > 0.5e0 OR abs(n - pn) >= 5) AS INTEGER) + CAST(greatest(n, pn) / greatest(least(n, pn), 1) >= {ratio} AS INTEGER) + CAST(coalesce(kit_l1, 0) > {kits} AS INTEGER) AS signals
       FROM pb LEFT JOIN l1 USING (clip, frame) WHERE pn IS NOT NULL)"""


@query("cut_signals", f"WITH {D}, {CUTS.format(ratio='2.5e0', kits='0.9e0')} SELECT clip, frame, round(h_ratio, 6) AS h_ratio, d_n, round(n_ratio, 6) AS n_ratio, round(kit_l1, 6) AS kit_l1, signals FROM cs")
def cut_signals(spark, d) -> DataFrame:
    s = frames.cut_signals(views.det(spark, d), "clip")
    return s.select("clip", "frame", "d_n", "signals", *[F.round(c, 6).alias(c) for c in ("h_ratio", "n_ratio", "kit_l1")])


DEBOUNCED = """fr AS (SELECT clip, frame, n_ratio, row_number() OVER (PARTITION BY clip ORDER BY frame) AS rn FROM cs WHERE signals >= 2),
st AS (SELECT clip, rn, [(frame, n_ratio)] AS cuts FROM fr WHERE rn = 1 UNION ALL
  SELECT fr.clip, fr.rn, CASE WHEN fr.frame - list_last(cuts)[1] >= 12 THEN list_append(cuts, (fr.frame, fr.n_ratio)) WHEN fr.n_ratio > list_last(cuts)[2] THEN list_append(cuts[1:-2], (fr.frame, fr.n_ratio)) ELSE cuts END
  FROM st JOIN fr ON fr.clip = st.clip AND fr.rn = st.rn + 1),
dc AS (SELECT clip, c[1] AS frame, c[2] AS n_ratio FROM (SELECT clip, unnest(cuts) AS c FROM st QUALIFY row_number() OVER (PARTITION BY clip ORDER BY rn DESC) = 1))"""


def found_cuts(spark, d) -> DataFrame:
    s = frames.cut_signals(views.det(spark, d), "clip", ratio=1.5, kits=0.7)
    return frames.debounced(s, "clip", within=12)


@query("cut_debounce", f"WITH RECURSIVE {D}, {CUTS.format(ratio='1.5e0', kits='0.7e0')}, {DEBOUNCED} SELECT clip, frame, round(n_ratio, 6) AS n_ratio FROM dc")
def cut_debounce(spark, d) -> DataFrame:
    return found_cuts(spark, d).withColumn("n_ratio", F.round("n_ratio", 6))


VOTE = f"""{PTS}, od AS (SELECT clip, frame, lead(frame) OVER (PARTITION BY clip ORDER BY frame) AS nx FROM (SELECT DISTINCT clip, frame FROM pts)),
a AS (SELECT pts.clip, nx AS frame, idx AS i, x, y FROM pts JOIN od USING (clip, frame) WHERE nx IS NOT NULL),
pr AS (SELECT a.clip, a.frame, i, b.idx AS j, b.x - a.x AS dx, b.y - a.y AS dy FROM a JOIN pts b USING (clip, frame) WHERE abs(b.x - a.x) <= 0.386e0 AND abs(b.y - a.y) <= 0.386e0),
bn AS (SELECT clip, frame, round_even(dx / (0.386e0 / 12.0e0), 0) AS bx, round_even(dy / (0.386e0 / 12.0e0), 0) AS b_y, count(*) AS v, median(dx) AS cx, median(dy) AS cy, min((i, j)) AS fst FROM pr GROUP BY ALL),
bs AS (SELECT * FROM bn QUALIFY row_number() OVER (PARTITION BY clip, frame ORDER BY v DESC, fst) = 1),
vt AS (SELECT bs.clip, bs.frame, cx, cy, v / n AS support FROM bs JOIN (SELECT clip, frame, count(*) AS n FROM a GROUP BY ALL) USING (clip, frame))"""


@query("camera_vote", f"WITH {VOTE} SELECT clip, frame, round(cx, 6) AS cx, round(cy, 6) AS cy, round(support, 6) AS support FROM vt")
def camera_vote(spark, d) -> DataFrame:
    v = frames.camera_vote(points(spark, d), "clip")
    return v.select("clip", "frame", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "support")])


@query("camera_path", f"WITH {VOTE} SELECT clip, frame, round(sum(CASE WHEN support >= 0.5e0 THEN cx ELSE 0.0e0 END) OVER w, 5) AS ox, round(sum(CASE WHEN support >= 0.5e0 THEN cy ELSE 0.0e0 END) OVER w, 5) AS oy FROM vt WINDOW w AS (PARTITION BY clip ORDER BY frame)")
def camera_path(spark, d) -> DataFrame:
    p = frames.camera_path(frames.camera_vote(points(spark, d), "clip"), "clip")
    return p.select("clip", "frame", *[F.round(c, 5).alias(c) for c in ("ox", "oy")])


PAIRS = f"""{views.TRACKS}, t AS (SELECT trk, frame, lead(frame) OVER w AS nx, x, y, h, kit, num, row_number() OVER w AS hits FROM tracks WINDOW w AS (PARTITION BY trk ORDER BY frame)),
p AS (SELECT t.trk, b.frame, b.trk AS idx, t.hits, t.h AS th, b.h, t.kit AS tk, b.kit AS k, t.num AS tn, b.num AS n, sqrt((b.x - t.x) * (b.x - t.x) + (b.y - t.y) * (b.y - t.y)) AS dist,
  least(12.0e0 * greatest(t.h, 0.02e0), 0.88e0) * 0.2e0 + 0.01e0 AS gate, sqrt((b.x - t.x) * {16 / 9!r}e0 * ((b.x - t.x) * {16 / 9!r}e0) + (b.y - t.y) * (b.y - t.y)) / greatest(t.h, 0.02e0) AS r FROM t JOIN tracks b ON b.frame = t.nx)"""


def expected_and_seen(spark, d) -> tuple[DataFrame, DataFrame]:
    """Where tracks are expected in their next frame, and what that frame holds."""
    from pyspark.sql import Window

    t = views.tracks(spark, d)
    w = Window.partitionBy("trk").orderBy("frame")
    before = t.select("trk", F.lead("frame").over(w).alias("nx"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("h").alias("th"), F.col("kit").alias("tkit"), F.col("num").alias("tnum"), F.row_number().over(w).alias("hits")).where("nx is not null").withColumnRenamed("nx", "frame")
    now = t.select("frame", F.col("trk").alias("idx"), "x", "y", "h", "kit", "num")
    return before, now


@query("gate_pairs", f"""WITH {PAIRS}
SELECT trk, frame, idx, round(dist, 6) AS dist, round(dist * CASE WHEN tk <> k THEN 4.0e0 ELSE 1.0e0 END * CASE WHEN tn = n THEN 0.55e0 ELSE 1.0e0 END * (1.0e0 + 0.5e0 * (greatest(th, h) / greatest(least(th, h), 1e-4) - 1.0e0)), 6) AS cost
FROM p WHERE dist <= gate AND NOT (hits >= 3 AND r > 1.2e0)""")
def gate_pairs(spark, d) -> DataFrame:
    return frames.gated_pairs(*expected_and_seen(spark, d), ["frame"], 0.2).select("trk", "frame", "idx", *[scalar.rounded(F.col(c), 6).alias(c) for c in ("dist", "cost")])


@query("association_costs", f"""WITH {PAIRS}, m AS (SELECT *, dist <= gate AS g, CASE WHEN dist <= gate AND tk <> k THEN 4.0e0 ELSE 1.0e0 END AS km, CASE WHEN dist <= gate AND tn = n THEN 0.55e0 ELSE 1.0e0 END AS nm,
 CASE WHEN dist <= gate THEN 1.0e0 + 0.5e0 * (greatest(th, h) / greatest(least(th, h), 1e-4) - 1.0e0) ELSE 1.0e0 END AS hm FROM p)
SELECT trk, frame, idx, round(dist, 5) AS dist, round(gate, 5) AS gate, g AS in_gate, km AS kit_mul, nm AS num_mul, round(hm, 5) AS h_mul, round(CASE WHEN g AND NOT (hits >= 3 AND r > 1.2e0) THEN dist * km * nm * hm END, 5) AS cost FROM m""")
def association_costs(spark, d) -> DataFrame:
    p = frames.association_costs(*expected_and_seen(spark, d), ["frame"], 0.2)
    r = {c: scalar.rounded(F.col(c), 5).alias(c) for c in ("dist", "gate", "h_mul", "cost")}
    return p.select("trk", "frame", "idx", r["dist"], r["gate"], "in_gate", "kit_mul", "num_mul", r["h_mul"], r["cost"])


PLANE = PTS + ", pl AS (SELECT clip, frame, count(*) AS n, regr_slope(y, h) AS slope, regr_intercept(y, h) AS intercept, regr_r2(y, h) AS r2, max(h) - min(h) AS span FROM pts GROUP BY ALL), pu AS (SELECT *, n >= 6 AND span >= 1e-3 AND coalesce(r2 >= 0.55e0, false) AS usable FROM pl)"


@query("ground_plane_fit", f"WITH {PLANE} SELECT clip, frame, n, usable, CASE WHEN usable THEN round(slope, 4) END AS slope, CASE WHEN usable THEN round(intercept, 4) END AS intercept FROM pu")
def ground_plane_fit(spark, d) -> DataFrame:
    g = frames.ground_plane(points(spark, d), ["clip", "frame"])
    return g.select("clip", "frame", "n", "usable", *[F.when(F.col("usable"), F.round(c, 4)).alias(c) for c in ("slope", "intercept")])


PICK = PLANE + views.BALL[len(views.DET):] + """,
bl AS (SELECT b.*, coalesce(usable AND b.h > 0 AND slope * (b.h / 0.15e0) + intercept - b.y > 1.5e0 * (b.h / 0.15e0), false) AS airborne FROM ball b LEFT JOIN pu USING (clip, frame)),
cd AS (SELECT b.clip, b.frame, p.trk AS pid, d.idx AS pos, b.x AS bx, b.y AS b_y, p.x, p.y, d.w, p.h, greatest(p.x - d.w / 2 - b.x, 0.0e0, b.x - (p.x + d.w / 2)) AS dx, greatest(p.y - p.h - b.y, 0.0e0, b.y - p.y) AS dy
       FROM bl b JOIN pts p USING (clip, frame) JOIN det d ON d.frame = p.frame AND d.idx = p.idx WHERE NOT airborne AND (NOT (b.h > 0 AND p.h > 0) OR b.h / p.h BETWEEN 0.05e0 AND 0.35e0)),
cr AS (SELECT clip, frame, pid, pos, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE 1 END AS r1, CASE WHEN dx = 0 AND dy = 0 THEN -least(bx - (x - w / 2), x + w / 2 - bx, b_y - (y - h), y - b_y) ELSE sqrt(dx * dx + dy * dy) END AS r2
       FROM cd WHERE (dx = 0 AND dy = 0) OR sqrt(dx * dx + dy * dy) <= 0.4e0 * greatest(h, 0.02e0)),
bp AS (SELECT * FROM cr QUALIFY row_number() OVER (PARTITION BY clip, frame ORDER BY r1, r2, pos) = 1),
pk AS (SELECT bl.clip, bl.frame, bp.pid AS pick FROM bl LEFT JOIN bp USING (clip, frame))"""


def picks(spark, d) -> DataFrame:
    p = points(spark, d)
    ball = frames.airborne(views.ball(spark, d), frames.ground_plane(p, ["clip", "frame"]), ["clip", "frame"])
    return frames.possession_pick(ball, p.select("clip", "frame", F.col("trk").alias("pid"), F.col("idx").alias("pos"), "x", "y", "w", "h"), ["clip", "frame"])


@query("possession_pick", f"WITH {PICK} SELECT * FROM pk")
def possession_pick(spark, d) -> DataFrame:
    return picks(spark, d)


HOLD = PICK + """,
hr AS (SELECT pk.*, (SELECT list(trk) FROM pts WHERE pts.frame = pk.frame) AS here, row_number() OVER (PARTITION BY clip ORDER BY frame) AS rn FROM pk),
hs AS (SELECT clip, frame, rn, pick AS run, 1 AS len, CASE WHEN pick IS NOT NULL OR 1 >= 2 THEN pick END AS cur FROM hr WHERE rn = 1 UNION ALL
  SELECT clip, frame, rn, run, len, CASE WHEN (c IS NULL OR (run IS DISTINCT FROM c AND len >= 2)) AND (run IS NOT NULL OR len >= 2) THEN run ELSE c END AS cur FROM (
    SELECT hr.clip, hr.frame, hr.rn, hr.pick AS run, CASE WHEN hr.pick IS NOT DISTINCT FROM hs.run THEN hs.len + 1 ELSE 1 END AS len, CASE WHEN hs.cur IS NOT NULL AND list_contains(hr.here, hs.cur) THEN hs.cur END AS c
    FROM hs JOIN hr ON hr.clip = hs.clip AND hr.rn = hs.rn + 1))"""


def held(spark, d) -> DataFrame:
    here = points(spark, d).groupBy("clip", "frame").agg(F.collect_list("trk").alias("present"))
    return frames.possession_hold(picks(spark, d).join(here, ["clip", "frame"]), "clip", "frame", 2)


@query("possession_hysteresis", f"WITH RECURSIVE {HOLD} SELECT clip, frame, cur AS holder FROM hs")
def possession_hysteresis(spark, d) -> DataFrame:
    return held(spark, d)


@query("possession_min_spell", f"""WITH RECURSIVE {HOLD}, ch AS (SELECT clip, frame, cur, CASE WHEN rn > 1 AND cur IS DISTINCT FROM lag(cur) OVER (PARTITION BY clip ORDER BY frame) THEN 1 ELSE 0 END AS c FROM hs),
il AS (SELECT *, sum(c) OVER (PARTITION BY clip ORDER BY frame) AS i FROM ch) SELECT clip, frame, CASE WHEN count(*) OVER (PARTITION BY clip, i) >= 2 THEN cur END AS holder FROM il""")
def possession_min_spell(spark, d) -> DataFrame:
    return frames.long_spells(held(spark, d), "clip", "frame", 2)


@query("dense_grid", f"""WITH {views.BALL}, g AS (SELECT clip, unnest(range(min(frame), max(frame) + 1)) AS frame FROM det GROUP BY clip)
SELECT g.clip, CAST(g.frame AS INTEGER) AS frame, count(ball.frame) AS n, round(coalesce(max(ball.x), -1), 6) AS x FROM g LEFT JOIN ball ON ball.frame = g.frame GROUP BY ALL""")
def dense_grid(spark, d) -> DataFrame:
    ends = views.det(spark, d).groupBy("clip").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"))
    g = frames.dense_grid(views.ball(spark, d), "clip", "frame", ends, ["x", "y"])
    return g.select("clip", "frame", F.size("rows").cast("long").alias("n"), F.round(F.coalesce(F.array_max(F.transform("rows", lambda r: r["x"])), F.lit(-1.0)), 6).alias("x"))


@query("next_frame_correspondence", f"""WITH {PTS}, s AS (SELECT a.clip, a.frame, a.idx, coalesce(bool_or((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 0.05e0 * 0.05e0), false) AS ok
FROM pts a LEFT JOIN pts b ON b.clip = a.clip AND b.frame = a.frame + 1 WHERE a.frame < (SELECT max(frame) FROM pts m WHERE m.clip = a.clip) GROUP BY ALL)
SELECT clip, count(*) AS sightings, count(*) FILTER (WHERE NOT ok) AS lost FROM s GROUP BY clip""")
def next_frame_correspondence(spark, d) -> DataFrame:
    return frames.without_counterpart(points(spark, d), "clip")


@query("clip_frames_diag", f"WITH {D}, c AS (SELECT clip, frame, count(*) AS n FROM det GROUP BY ALL) SELECT clip, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90 FROM c GROUP BY clip")
def clip_frames_diag(spark, d) -> DataFrame:
    c = views.det(spark, d).groupBy("clip", "frame").agg(F.count("*").alias("n")).groupBy("clip").agg(F.percentile("n", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"))
    return c.select("clip", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])
