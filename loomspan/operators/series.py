"""Operators along a time series of observations, partitioned by key: outliers, smoothing, gaps, interpolation.

What looks only at neighbours is a window expression; what depends on earlier decisions is a fold over the ordered
observations of a key, which stays in the engine and is as parallel as there are keys.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.scan import linear

ASPECT = 16 / 9
OBS = "array<struct<f:int,x:double,y:double,w:double,h:double>>"


def _series(rows: DataFrame, keys: list[str], frame: str = "frame", values: tuple[str, ...] = ("x", "y", "w", "h")) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), *values))).alias("a"))


def _rows(df: DataFrame, keys: list[str], fold: str, frame: str = "frame", values: tuple[str, ...] = ("x", "y", "w", "h")) -> DataFrame:
    return df.select(*keys, F.explode(F.expr(fold)).alias("o")).select(*keys, F.col("o.f").alias(frame), *[F.col(f"o.{v}").alias(v) for v in values])


def _heights(p: str, q: str) -> str:
    """Displacement from p to q in body heights."""
    dx, dy = f"(({q}.x - {p}.x) * {ASPECT!r}D)", f"({q}.y - {p}.y)"
    return f"(sqrt({dx} * {dx} + {dy} * {dy}) / greatest(({p}.h + {q}.h) / 2, 0.02D))"


def without_round_trips(rows: DataFrame, keys: list[str], jump: float = 0.35) -> DataFrame:
    """Observations without those that are far from both the last one kept and the next one while these two are near
    each other; the last one is dropped if it is more than twice ``jump`` heights away. Fewer than three
    observations pass as they are."""
    b, c = "a[i]", "a[i + 1]"
    fold = f"""if(size(a) < 3, a, transform(array(aggregate(sequence(1, size(a) - 2), slice(a, 1, 1), (k, i) ->
      if({_heights('element_at(k, -1)', b)} > {jump} and {_heights(b, c)} > {jump} and {_heights('element_at(k, -1)', c)} < 0.5D * {_heights('element_at(k, -1)', b)}, k, array_append(k, {b})))),
      k -> if({_heights('element_at(k, -1)', 'element_at(a, -1)')} <= 2.0D * {jump}, array_append(k, element_at(a, -1)), k))[0])"""
    return _rows(_series(rows, keys), keys, fold)


def smoothed(rows: DataFrame, keys: list[str], frame: str = "frame", max_gap: float = 2.5, curve: float = 0.006) -> DataFrame:
    """Centred 1-2-1 means of x and y of the input series (no lag, no recursion); ends, observations at a long gap
    and sharp turns stay."""
    w = Window.partitionBy(*keys).orderBy(frame)
    s = rows.withColumns({f"_{n}{c}": f(c).over(w) for n, f in (("a", F.lag), ("c", F.lead)) for c in (frame, "x", "y")})
    turn = {c: F.col(f"_c{c}") - 2 * F.col(c) + F.col(f"_a{c}") for c in "xy"}
    ok = (F.col(frame) - F.col(f"_a{frame}") <= max_gap) & (F.col(f"_c{frame}") - F.col(frame) <= max_gap) & (F.sqrt(turn["x"] * turn["x"] + turn["y"] * turn["y"]) <= curve)
    mean = {c: 0.25 * F.col(f"_a{c}") + 0.5 * F.col(c) + 0.25 * F.col(f"_c{c}") for c in "xy"}
    s = s.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return s.withColumns({c: F.when(F.col("_ok"), mean[c]).otherwise(F.col(c)) for c in "xy"}).select(*rows.columns)


def confirmed(rows: DataFrame, keys: list[str], step: float, frame: str = "frame") -> DataFrame:
    """Observations that have another within 1.5 steps before or after; fewer than three pass as they are."""
    w = Window.partitionBy(*keys).orderBy(frame)
    near = F.coalesce(F.col(frame) - F.lag(frame).over(w) <= 1.5 * step, F.lit(False)) | F.coalesce(F.lead(frame).over(w) - F.col(frame) <= 1.5 * step, F.lit(False))
    return rows.withColumns({"_near": near, "_n": F.count("*").over(Window.partitionBy(*keys))}).where("_near or _n < 3").drop("_near", "_n")


def segmented(rows: DataFrame, keys: list[str], max_gap: float, step: float, speed: float, frame: str = "frame") -> DataFrame:
    """``rows`` with ``seg``: a new stretch begins after a gap longer than ``max_gap`` frames, or after a missed
    sample with a move faster than ``speed`` a frame."""
    w = Window.partitionBy(*keys).orderBy(frame)
    span = F.col(frame) - F.lag(frame).over(w)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    new = (span > max_gap) | ((span > step) & (F.sqrt(dx * dx + dy * dy) > speed * span))
    return rows.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def last_frame(rows: DataFrame, frame: str = "frame") -> Column:
    """The last frame of a table, as a scalar subquery."""
    return rows.agg(F.max(frame)).scalar()


def on_grid(segments: DataFrame, keys: list[str], step: int, total: int | None = None, frame: str = "frame", values: tuple[str, ...] = ("x", "y", "w", "h")) -> DataFrame:
    """Every frame from the first to the last observation of a stretch, values between observations interpolated
    linearly; the last is held for the rest of its step, within ``total`` frames (by default up to the last frame of the
    table). Stretches of one observation are dropped."""
    w = Window.partitionBy(*keys).orderBy(frame)
    s = segments.withColumns({"_f2": F.lead(frame).over(w), "_n": F.count("*").over(Window.partitionBy(*keys)), **{f"_2{v}": F.lead(v).over(w) for v in values}}).where("_n >= 2")
    stop = F.when(F.col("_f2").isNull(), F.least(F.col(frame) + step - 1, last_frame(segments, frame) if total is None else F.lit(total - 1))).otherwise(F.col("_f2") - 1)
    s = s.withColumn("_g", F.explode(F.sequence(F.col(frame), F.greatest(stop, F.col(frame)))))
    t = (F.col("_g") - F.col(frame)) / (F.col("_f2") - F.col(frame))
    at = {v: F.when(F.col("_f2").isNull() | (F.col("_g") == F.col(frame)), F.col(v)).otherwise(F.col(v) + (F.col(f"_2{v}") - F.col(v)) * t).alias(v) for v in values}
    return s.select(*keys, F.col("_g").alias(frame), *[at[v] for v in values])


def damped(grid: DataFrame, keys: list[str], dt: float, smooth_time: float, frame: str = "frame") -> DataFrame:
    """x and y eased by a critically damped spring that follows them (a cubic stands for the exponential): position and velocity are a
    linear recurrence, which is worked in blocks, so a stretch of any length is spread over tasks."""
    if smooth_time <= 0:
        return grid
    omega = 2.0 / smooth_time
    x = omega * dt
    ex = 1.0 / (1.0 + x + 0.48 * x * x + 0.235 * x * x * x)
    # p' = e + (p - e + push) * ex, v' = (v - omega * push) * ex with push = (v + omega * (p - e)) * dt
    move = np.array([[(1 + x) * ex, dt * ex], [-omega * x * ex, (1 - x) * ex]])
    pull = np.array([1 - (1 + x) * ex, omega * x * ex])
    return linear(grid, keys, frame, ["x", "y"], move, pull)


def faded(grid: DataFrame, keys: list[str], clip: str, cuts: DataFrame, fade: float, step: int, frame: str = "frame") -> DataFrame:
    """``grid`` with ``fade`` from 0 to 1 over ``fade`` frames at both ends of a stretch, except at a cut. cuts: clip,
    frame; the few cuts of a clip travel as one array."""
    lists = cuts.groupBy(clip).agg(F.collect_set(frame).alias("_cuts"))
    w = Window.partitionBy(*keys)
    g = grid.join(lists, clip, "left").withColumns({"_f0": F.min(frame).over(w), "_f1": F.max(frame).over(w), "_cuts": F.coalesce("_cuts", F.array().cast("array<int>"))})
    at_end = F.expr(f"exists(_cuts, c -> c - _f1 between 0 and {step + 1})")
    at_start = F.expr(f"exists(_cuts, c -> _f0 - c between 0 and {step + 1})")
    out = F.when(at_end, 1.0).otherwise(F.least(F.lit(1.0), (F.col("_f1") - F.col(frame)) / fade))
    into = F.when(at_start, 1.0).otherwise(F.least(F.lit(1.0), (F.col(frame) - F.col("_f0")) / fade))
    return g.withColumn("fade", F.least(into, out)).drop("_cuts", "_f0", "_f1")


def crossing(rows: DataFrame, keys: list[str], clip: str, cuts: DataFrame, frame: str = "frame") -> DataFrame:
    """``rows`` that have a next one in their series, with its frame ``f2`` and ``crossed``: whether the clip has a cut after
    the one and up to the other. cuts: clip, frame; the cuts of a clip travel as one array to its rows."""
    n = rows.withColumn("f2", F.lead(frame).over(Window.partitionBy(clip, *keys).orderBy(frame))).where("f2 is not null")
    lists = cuts.groupBy(clip).agg(F.collect_set(frame).alias("_cuts"))
    return n.join(lists, clip, "left").withColumn("crossed", F.coalesce(F.expr(f"exists(_cuts, c -> c > {frame} and c <= f2)"), F.lit(False))).drop("_cuts")


def confident(ball: DataFrame, floor: float = 0.0) -> DataFrame:
    """``ball`` with ``low_conf``: below the floor of confidence; a floor of 0 is off."""
    return ball.withColumn("low_conf", F.coalesce(F.col("conf") < floor, F.lit(False)) if floor > 0 else F.lit(False))


def without_flat(ball: DataFrame, clip: str, share: float = 0.65, least: int = 8) -> DataFrame:
    """Sightings less those whose height is below ``share`` of the clip's median, in clips with enough of them."""
    m = ball.groupBy(clip).agg(F.percentile("h", 0.5).alias("_m"), F.count("*").alias("_n"))
    return ball.join(m, clip).where((F.col("_n") < least) | (F.col("h") >= share * F.col("_m"))).drop("_m", "_n")


def frame_scale(players: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """The upper median of player heights of a frame with enough players."""
    from loomspan.functions.scalar import index_percentile

    return players.where("h > 0").groupBy(*keys).agg(F.count("*").alias("_n"), index_percentile(F.collect_list("h"), 0.5).alias("scale")).where(F.col("_n") >= least).drop("_n")


def nearest_scale(ball: DataFrame, scale: DataFrame, clip: str, within: int, frame: str = "frame") -> DataFrame:
    """``ball`` with the scale of its frame, or of the nearest within ``within`` frames (the earlier of two). The
    range is turned into an equi-join on blocks of frames, so it is dealt by clip and block."""
    size = max(1, within)
    b = ball.withColumn("_b", F.explode(F.expr(f"sequence(({frame} - {within}) div {size}, ({frame} + {within}) div {size})")))
    s = scale.select(F.col(clip).alias("_clip"), F.col(frame).alias("_f"), "scale", F.expr(f"{frame} div {size}").alias("_sb"))
    j = b.join(s, (F.col(clip) == F.col("_clip")) & (F.col("_b") == F.col("_sb")) & (F.abs(F.col(frame) - F.col("_f")) <= within))
    best = j.groupBy(clip, frame).agg(F.min_by("scale", F.struct(F.abs(F.col(frame) - F.col("_f")), "_f")).alias("scale"))
    return ball.join(best, [clip, frame], "left")


def _ball_filters(fps: float, step: int) -> list[str]:
    """The two filters of a pass as folds over ``a``, a clip's sightings in order; each looks at the last one it kept."""
    gap = lambda p, q: f"greatest(({q}.f - {p}.f) / {fps!r}D, 1e-3D)"
    far = lambda p, q: f"sqrt(({q}.x - {p}.x) * ({q}.x - {p}.x) + ({q}.y - {p}.y) * ({q}.y - {p}.y))"
    scaled = lambda e, rate, most: f"if(coalesce({e}.scale, 0D) <> 0, least({rate}D * {e}.scale, {most}D), {most}D)"
    gate = lambda e: f"({scaled(e, 14.3, 1.2)} * (0.5D + {e}.conf))"
    l, b, c = "element_at(k, -1)", "a[i]", "a[i + 1]"
    slow = f"{far(l, b)} / {gap(l, b)} <= {gate(b)} and {far(b, c)} / {gap(b, c)} <= {gate(b)}"
    upright = f"abs({b}.y - ({l}.y + {c}.y) / 2) >= 2.0D * abs(({b}.x - ({l}.x + {c}.x) / 2) * {ASPECT!r}D)"
    jump = scaled(b, 1.19, 0.1)
    trip = f"{b}.f - {l}.f <= {2 * step + 1} and {far(l, b)} > {jump} and {far(b, c)} > {jump} and {far(l, c)} < {far(l, b)} * 0.5D and not ({slow} and {upright})"
    trips = f"if(size(a) < 3, a, array_append(aggregate(sequence(1, size(a) - 2), slice(a, 1, 1), (k, i) -> if({trip}, k, array_append(k, {b}))), element_at(a, -1)))"
    speed = f"aggregate(slice(a, 2, size(a)), slice(a, 1, 1), (k, e) -> if({far(l, 'e')} / {gap(l, 'e')} <= {gate('e')}, array_append(k, e), k))"
    return [trips, speed]


def ball_fixed_point(ball: DataFrame, clip: str, fps: float, step: int, passes: int = 4, frame: str = "frame") -> DataFrame:
    """Sightings that are left when the filters (round trips, then speed against the last kept) remove no more, or after ``passes``; a pass
    over what the filters leave alone changes nothing, so all passes are made. Folds over a clip's sightings; clips are independent. ball: clip,
    frame, x, y, w, h, conf, scale."""
    rest = ("x", "y", "w", "h", "conf", "scale")
    out = ball.groupBy(clip).agg(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), *rest))).alias("a"))
    trips, speed = _ball_filters(fps, step)
    return _rows(out, [clip], f"aggregate(sequence(1, {passes}), a, (a, n) -> transform(array({trips}), a -> {speed})[0])", frame, rest)


def bridged(ball: DataFrame, cuts: DataFrame, clip: str, max_gap: int, hold: int, last: int | Column, frame: str = "frame") -> DataFrame:
    """The ball on every frame that can be told: sightings, the line between two at most ``max_gap`` frames apart with
    no cut between them, else the sighting held for ``hold`` frames up to a cut and the ``last`` frame. One row a
    frame, the surest."""
    w = Window.partitionBy(clip).orderBy(frame)
    lists = cuts.groupBy(clip).agg(F.collect_set(frame).alias("_cuts"))
    b = ball.join(lists, clip, "left").withColumns({"_cuts": F.coalesce("_cuts", F.array().cast("array<int>")), "_f2": F.lead(frame).over(w), **{f"_2{v}": F.lead(v).over(w) for v in "xywh"}})
    crossed = F.expr(f"exists(_cuts, c -> c > {frame} and c <= _f2)")
    joined = (F.col("_f2") - F.col(frame) <= max_gap) & ~crossed
    line = b.where(joined).withColumn("_g", F.explode(F.expr(f"sequence({frame} + 1, _f2)"))).where("_g < _f2")
    t = (F.col("_g") - F.col(frame)) / (F.col("_f2") - F.col(frame))
    line = line.select(clip, F.col("_g").alias(frame), *[(F.col(v) + (F.col(f"_2{v}") - F.col(v)) * t).alias(v) for v in "xywh"], F.lit(1).alias("_p"), F.col(frame).alias("_o"))
    held = b.withColumn("_g", F.explode(F.expr(f"sequence({frame}, {frame} + {max(hold, 1) - 1})"))).where(f"_g > {frame} and not exists(_cuts, c -> c > {frame} and c <= _g)").where(F.col("_g") <= last)
    held = held.select(clip, F.col("_g").alias(frame), *"xywh", F.lit(2).alias("_p"), F.col(frame).alias("_o"))
    exact = b.select(clip, frame, *"xywh", F.lit(0).alias("_p"), F.col(frame).alias("_o"))
    every = exact.unionByName(line).unionByName(held)
    best = every.groupBy(clip, frame).agg(F.min_by(F.struct(*"xywh", "_p"), F.struct("_p", "_o")).alias("b"))
    return best.select(clip, frame, *[F.col(f"b.{v}").alias(v) for v in "xywh"], F.element_at(F.array(F.lit("exact"), F.lit("bridge"), F.lit("hold")), F.col("b._p") + 1).alias("kind"))
