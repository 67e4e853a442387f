"""Frame-level operators: nearest neighbours, cut signals, camera motion, gated pairs, ground plane, possession."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.grid import blocks, dealt, into_cells, nearest_other, paired, within
from loomspan.operators.reports import ranked_values
from loomspan.tables import kept

ASPECT = 16 / 9


def clip_spacing(points: DataFrame, clip: str, frame: list[str], least: int = 40) -> DataFrame:
    """The value at a quarter of a clip's sorted nearest distances, or null below ``least`` of them. The distances are written once, as they
    are counted and ranked."""
    at = ranked_values(kept(nearest_other(points, [clip, *frame])), [clip], "nearest", {"quarter": 0.25})
    return at.select(clip, F.col("n").alias("samples"), F.when(F.col("n") >= least, F.col("quarter")).alias("spacing"))


def kit_l1(rows: DataFrame, clip: str, frame: str = "frame", kit: str = "kit") -> DataFrame:
    """clip, frame, kit_l1: distance between the shares of kits in a frame and in the one before it (of those
    with rows); the shares are joined in full, so a kit that only one frame has counts."""
    counts = rows.groupBy(clip, frame, kit).agg(F.count("*").alias("n"))
    frames = counts.groupBy(clip, frame).agg(F.sum("n").alias("all"))
    frames = frames.withColumn("prev", F.lag(frame).over(Window.partitionBy(clip).orderBy(frame)))
    share = counts.join(frames, [clip, frame]).select(clip, frame, kit, (F.col("n") / F.col("all")).alias("s"))
    now = frames.where("prev is not null").join(share, [clip, frame]).select(clip, frame, kit, "s", F.lit(0.0).alias("p"))
    old = frames.where("prev is not null").select(clip, F.col(frame).alias("_f"), F.col("prev").alias(frame)).join(share, [clip, frame]).select(clip, F.col("_f").alias(frame), kit, F.lit(0.0).alias("s"), F.col("s").alias("p"))
    each = now.unionByName(old).groupBy(clip, frame, kit).agg(F.sum("s").alias("s"), F.sum("p").alias("p"))
    # rounded: the order of a sum must not decide whether a threshold is passed
    return each.groupBy(clip, frame).agg(F.round(F.sum(F.abs(F.col("p") - F.col("s"))), 9).alias("kit_l1"))


def cut_signals(rows: DataFrame, clip: str, frame: str = "frame", scale: float = 0.5, count: int = 5, ratio: float = 2.5, kits: float = 0.9, least: int = 4) -> DataFrame:
    """Per boundary between frames: h_ratio, d_n, n_ratio, kit_l1 and signals (how many of the three fire: scale
    or count among enough detections, ratio of counts, change of kits)."""
    per = rows.groupBy(clip, frame).agg(F.median("h").alias("med_h"), F.count("*").alias("n"))
    w = Window.partitionBy(clip).orderBy(frame)
    b = per.withColumns({"prev_med_h": F.lag("med_h").over(w), "prev_n": F.lag("n").over(w)}).where("coalesce(prev_med_h, 0) <> 0 and med_h <> 0 and coalesce(prev_n, 0) <> 0")
    b = b.join(kit_l1(rows, clip, frame), [clip, frame], "left")
    b = b.withColumns({
        "h_ratio": F.abs(F.col("med_h") - F.col("prev_med_h")) / F.greatest("prev_med_h", F.lit(1e-4)),
        "d_n": F.abs(F.col("n") - F.col("prev_n")),
        "n_ratio": F.greatest("n", "prev_n") / F.greatest(F.least("n", "prev_n"), F.lit(1)),
    })
    big = F.greatest("n", "prev_n") >= least
    fired = (big & ((F.col("h_ratio") > scale) | (F.col("d_n") >= count))).cast("int") + (F.col("n_ratio") >= ratio).cast("int") + (F.coalesce("kit_l1", F.lit(0.0)) > kits).cast("int")
    return b.withColumn("signals", fired)


def debounced(signals: DataFrame, clip: str, frame: str = "frame", within: float = 3, least: int = 2) -> DataFrame:
    """Cuts: boundaries with enough signals; within ``within`` frames of a cut only stronger evidence counts, and
    takes its place. A fold over the fired boundaries of a clip, which are few."""
    fired = signals.where(F.col("signals") >= least).groupBy(clip).agg(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), F.col("n_ratio").alias("r")))).alias("a"))
    fold = f"""aggregate(a, cast(array() as array<struct<f:int,r:double>>), (acc, b) ->
      if(size(acc) = 0 or b.f - element_at(acc, -1).f >= {within}, array_append(acc, b),
         if(b.r > element_at(acc, -1).r, array_append(slice(acc, 1, size(acc) - 1), b), acc)))"""
    return fired.select(clip, F.explode(F.expr(fold)).alias("c")).select(clip, F.col("c.f").alias(frame), F.col("c.r").alias("n_ratio"))


def camera_vote(points: DataFrame, clip: str, frame: str = "frame", idx: str = "idx", max_shift: float = 0.386) -> DataFrame:
    """Motion of the whole picture between a frame and the next one: displacements of all pairs within
    ``max_shift`` vote in square bins of a twelfth of it; the medians of the fullest bin (ties to the first pair)
    and its support. ``idx`` is a whole number from 0 to below 2**31.

    Points of one place move alike, so places meet, each with its number of points and its first one. The pairs are of neighbouring
    frames alone, and are counted in fixed-size rows by bin as they are made, without a sort; then only the pairs of the fullest bin are made again,
    through a grid of its place, for their medians."""
    size = max_shift / 12.0
    p = dealt(points, [clip, frame]).groupBy(clip, frame, "x", "y").agg(F.count("*").alias("_n"), F.min(F.col(idx).cast("long")).alias("_i"))
    order = p.select(clip, frame).distinct().withColumn("_next", F.lead(frame).over(Window.partitionBy(clip).orderBy(frame)))
    a = p.join(order, [clip, frame]).where("_next is not null").select(clip, F.col("_next").alias(frame), "_i", "_n", F.col("x").alias("_x"), F.col("y").alias("_y"))
    b = p.select(clip, frame, F.col("_i").alias("_j"), F.col("_n").alias("_m"), "x", "y")
    move = {"dx": F.col("x") - F.col("_x"), "dy": F.col("y") - F.col("_y")}
    bins = {"bx": F.rint(F.col("dx") / size), "by": F.rint(F.col("dy") / size)}
    near = (F.abs("dx") <= max_shift) & (F.abs("dy") <= max_shift)
    pairs = dealt(a, [clip, frame]).join(dealt(b, [clip, frame]), [clip, frame])
    # the first pair as one number: a pair of columns has no place in a hash aggregate, and all pairs would be sorted
    votes = pairs.withColumns(move).where(near).withColumns(bins).groupBy(clip, frame, "bx", "by").agg(F.sum(F.col("_n") * F.col("_m")).alias("votes"), F.min(F.shiftleft("_i", 32) + F.col("_j")).alias("_first"))
    best = votes.groupBy(clip, frame).agg(F.min(F.struct((-F.col("votes")).alias("v"), "_first", "bx", "by")).alias("w")).select(clip, frame, (-F.col("w.v")).alias("votes"), F.col("w.bx").alias("_bx"), F.col("w.by").alias("_by"))
    moved = a.join(best, [clip, frame])
    at = (F.col("_x") + F.col("_bx") * size, F.col("_y") + F.col("_by") * size)
    full = within(moved, b, [clip, frame], at, (F.lit(size), F.lit(size)), (F.col("x"), F.col("y")), (size, size))
    full = full.withColumns(move).where(near).withColumns(bins).where("bx = _bx and by = _by").withColumn("_w", F.col("_n") * F.col("_m"))
    each = [full.groupBy(clip, frame, d).agg(F.sum("_w").alias("_w"), F.max("votes").alias("votes")).groupBy(clip, frame).agg(F.percentile(d, F.lit(0.5), F.col("_w")).alias(c), F.max("votes").alias("votes")) for d, c in (("dx", "cx"), ("dy", "cy"))]
    n = a.groupBy(clip, frame).agg(F.sum("_n").alias("preds"))
    return each[0].join(each[1].drop("votes"), [clip, frame]).join(n, [clip, frame]).select(clip, frame, "cx", "cy", (F.col("votes") / F.col("preds")).alias("support"))


def gated_pairs(tracks: DataFrame, detections: DataFrame, keys: list[str], dt: float, spacing: float | None = None) -> DataFrame:
    """All (track, detection) pairs of a frame within the track's gate, with their cost.

    tracks: keys, trk, px, py, th, tkit, tnum, hits; detections: keys, idx, x, y, h, kit, num. Pairs of a track
    with enough hits whose residual exceeds 1.2 heights are refused. A track meets the cells that its gate touches, or, with enough hits, those
    that the residual allows, which are fewer. Cells deal out the work; in a cell, blocks of tracks at one place meet the blocks of detections within their
    reach, so that pairs follow each other by place and are small when written.
    """
    from loomspan.functions.scalar import gate_width

    widest = min(0.88 * dt + 0.01, 1.5 * spacing if spacing else 9e9)
    tall = F.greatest("th", F.lit(0.02))
    t = tracks.withColumn("gate", gate_width(F.col("th"), F.lit(dt), F.lit(spacing) if spacing else None))
    # a hair more than the rules allow, as they round in their own ways
    reach = [F.when(F.col("hits") >= 3, F.least(F.col("gate"), 1.2 * tall / by)).otherwise(F.col("gate")) + 1e-9 for by in (ASPECT, 1.0)]
    t = t.withColumns({"_rx": reach[0], "_ry": reach[1]})
    at, size = [F.col("px"), F.col("py")], [2 * widest, 2 * widest]
    by = [*keys, "_cx", "_cy"]
    wide, own = into_cells(t, detections, at, [F.col("_rx"), F.col("_ry")], [F.col("x"), F.col("y")], size)
    fine = lambda v, n: F.floor(F.col(v) / (widest / n))
    wide = wide.withColumns({"_ox": fine("px", 3), "_oy": fine("py", 2), "_old": F.col("hits") >= 3})
    own = own.withColumns({"_px": fine("x", 3), "_py": fine("y", 2)})
    a = blocks(dealt(wide, by), by, ["_ox", "_oy", "px", "py", "th", "_old", "tkit", "tnum"], "_a")
    b = blocks(dealt(own, by), by, ["_px", "_py", "x", "y", "h", "kit", "num"], "_b")
    for v in "xy":
        least, most = (F.transform("_a", lambda r: r["p" + v] - r["_r" + v]), F.transform("_a", lambda r: r["p" + v] + r["_r" + v]))  # noqa: B023
        a = a.withColumns({f"_from_{v}": F.array_min(least), f"_to_{v}": F.array_max(most)})
        b = b.withColumns({f"_least_{v}": F.array_min(f"_b.{v}"), f"_most_{v}": F.array_max(f"_b.{v}")})
    met = b.join(a, by).where(" and ".join(f"_from_{v} <= _most_{v} and _least_{v} <= _to_{v}" for v in "xy"))
    ends = [f"_{e}_{v}" for v in "xy" for e in ("least", "most")]
    near = " and ".join(f"p{v} - _r{v} <= _most_{v} and _least_{v} <= p{v} + _r{v}" for v in "xy")
    p = paired(met.select(*keys, *ends, "_a", "_b"), near).drop(*ends, "_ox", "_oy", "_px", "_py", "_old")
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    p = p.where((F.abs(dx) <= F.col("_rx")) & (F.abs(dy) <= F.col("_ry"))).drop("_rx", "_ry")  # cheap, and most that fail fail here
    p = p.withColumn("dist", F.sqrt(dx * dx + dy * dy)).where("dist <= gate")
    p = p.withColumn("resid_bh", F.sqrt(dx * ASPECT * (dx * ASPECT) + dy * dy) / tall)
    p = p.where("not (hits >= 3 and resid_bh > 1.2e0)")
    ratio = F.greatest("th", "h") / F.greatest(F.least("th", "h"), F.lit(1e-4))
    cost = F.col("dist") * F.when(F.col("tkit") != F.col("kit"), 4.0).otherwise(1.0) * F.when(F.col("tnum") == F.col("num"), 0.55).otherwise(1.0) * (1.0 + 0.5 * (ratio - 1.0))
    return p.withColumn("cost", cost)


def association_costs(tracks: DataFrame, detections: DataFrame, keys: list[str], dt: float, spacing: float | None = None, other_kit: float = 4.0, same_number: float = 0.55, height: float = 0.5) -> DataFrame:
    """The audit of an association: every (track, detection) pair of a frame with its distance, gate, the factors of kit,
    number and height, and its cost; the factors are 1 and the cost null for pairs outside the gate, the cost null also for those that the
    residual refuses. Columns as for :func:`gated_pairs`; the pairs are of single frames. What hangs on the track alone is worked out before
    the pairs are made; a frame's pairs are made in one task, by blocks of tracks and detections that stand at one place, and never shuffled or held."""
    from loomspan.functions.scalar import gate_width

    t = tracks.withColumn("gate", gate_width(F.col("th"), F.lit(dt), F.lit(spacing) if spacing else None))
    a = blocks(dealt(t, keys), keys, ["px", "py", "th", "tkit", "tnum", "hits"], "_a")
    p = paired(a.join(blocks(dealt(detections, keys), keys, ["x", "y", "h", "kit", "num"], "_b"), keys))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    p = p.withColumn("dist", F.sqrt(dx * dx + dy * dy))
    p = p.withColumn("in_gate", F.col("dist") <= F.col("gate"))
    ratio = F.greatest("th", "h") / F.greatest(F.least("th", "h"), F.lit(1e-4))
    near = F.col("in_gate")
    p = p.withColumns({
        "kit_mul": F.when(near & (F.col("tkit") != F.col("kit")), other_kit).otherwise(1.0),
        "num_mul": F.when(near & (F.col("tnum") == F.col("num")), same_number).otherwise(1.0),
        "h_mul": F.when(near, 1.0 + height * (ratio - 1.0)).otherwise(1.0),
    })
    residual = F.sqrt(dx * ASPECT * (dx * ASPECT) + dy * dy) / F.greatest("th", F.lit(0.02))
    refused = (F.col("hits") >= 3) & (residual > 1.2)
    return p.withColumn("cost", F.when(near & ~refused, F.col("dist") * F.col("kit_mul") * F.col("num_mul") * F.col("h_mul")))


def camera_path(votes: DataFrame, clip: str, frame: str = "frame", least: float = 0.5) -> DataFrame:
    """clip, frame, ox, oy: how far the picture has moved since the clip began, the sum of the moves of
    :func:`camera_vote` that a share of ``least`` or more of the tracks agree on. A window over a clip's frames, one row each."""
    w = Window.partitionBy(clip).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    sure = F.col("support") >= least
    return votes.select(clip, frame, *[F.sum(F.when(sure, F.col(c)).otherwise(0.0)).over(w).alias(o) for c, o in (("cx", "ox"), ("cy", "oy"))])


def ground_plane(players: DataFrame, keys: list[str], least: int = 6, r2: float = 0.55) -> DataFrame:
    """Per frame the least-squares line of foot height on body height; ``usable`` where there are enough rows, they
    differ in height, and the fit is good enough."""
    g = players.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("y", "h").alias("slope"), F.regr_intercept("y", "h").alias("intercept"), F.regr_r2("y", "h").alias("r2"), (F.max("h") - F.min("h")).alias("span"))
    return g.withColumn("usable", (F.col("n") >= least) & (F.col("span") >= 1e-3) & F.coalesce(F.col("r2") >= r2, F.lit(False)))


def airborne(ball: DataFrame, plane: DataFrame, keys: list[str], heights: float = 1.5, ball_share: float = 0.15) -> DataFrame:
    """``ball`` with ``airborne``: more than ``heights`` bodies above the ground at the depth that its size tells."""
    tall = F.col("h") / ball_share
    above = F.col("slope") * tall + F.col("intercept") - F.col("y") > heights * tall
    return ball.join(plane.select(*keys, "slope", "intercept", "usable"), keys, "left").withColumn("airborne", F.coalesce(F.col("usable") & (F.col("h") > 0) & above, F.lit(False))).drop("slope", "intercept", "usable")


def possession_pick(ball: DataFrame, players: DataFrame, keys: list[str], radius: float = 0.4, low: float = 0.05, high: float = 0.35) -> DataFrame:
    """Per frame with a ball the player who has it, or null: containment outranks distance, the deepest or nearest
    wins, ties to the first in the list. An airborne ball is nobody's. players: keys, pid, pos, x, y (foot), w, h."""
    b = ball.select(*keys, F.col("x").alias("bx"), F.col("y").alias("by"), F.col("h").alias("bh"), "airborne")
    p = b.where("not airborne").join(players, keys)
    p = p.where(f"not (bh > 0 and h > 0) or bh / h between {low}D and {high}D")
    dx = F.greatest(F.expr("x - w / 2 - bx"), F.lit(0.0), F.expr("bx - (x + w / 2)"))
    dy = F.greatest(F.expr("y - h - by"), F.lit(0.0), F.expr("by - y"))
    p = p.withColumns({"dx": dx, "dy": dy}).withColumns({"d": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), "inside": (F.col("dx") == 0) & (F.col("dy") == 0)})
    p = p.where((F.col("inside")) | (F.col("d") <= radius * F.greatest("h", F.lit(0.02))))
    depth = F.least(F.expr("bx - (x - w / 2)"), F.expr("x + w / 2 - bx"), F.expr("by - (y - h)"), F.expr("y - by"))
    rank = F.struct(F.when(F.col("inside"), 0).otherwise(1).alias("a"), F.when(F.col("inside"), -depth).otherwise(F.col("d")).alias("b"), F.col("pos").alias("c"), F.col("pid").alias("pid"))
    best = p.groupBy(*keys).agg(F.min(rank).alias("best"))
    return b.select(*keys).join(best, keys, "left").select(*keys, F.col("best.pid").alias("pick"))


def possession_hold(picks: DataFrame, clip: str, frame: str, need: int) -> DataFrame:
    """Picks with hysteresis: a challenger (or nobody) takes over after ``need`` picks in a row; a holder who has
    left the frame is dropped at once. picks: clip, frame, pick, present (array of ids).

    Where a run reaches ``need`` the pick holds, whoever held before. So a clip falls into stretches that begin at such rows, and a fold
    goes over each stretch alone, in which a holder stays while present, and else the next pick takes over."""
    run = islands(picks, [clip], frame, "pick", "_run")
    run = run.withColumn("_len", F.row_number().over(Window.partitionBy(clip, "_run").orderBy(frame)))
    sure = (F.col("_len") >= need).alias("s")
    run = run.withColumn("_part", F.sum(sure.cast("int")).over(Window.partitionBy(clip).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)))
    rows = run.groupBy(clip, "_part").agg(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), F.col("pick").alias("p"), sure, F.col("present").alias("here")))).alias("a"))
    kind = picks.schema["pick"].dataType.simpleString()
    now = "if(e.s, e.p, if(t.cur is not null and array_contains(e.here, t.cur), t.cur, e.p))"
    fold = f"""aggregate(a, named_struct('cur', cast(null as {kind}), 'out', cast(array() as array<{kind}>)),
      (t, e) -> transform(array({now}), c -> named_struct('cur', c, 'out', array_append(t.out, c)))[0], t -> t.out)"""
    held = rows.select(clip, F.explode(F.arrays_zip(F.expr("transform(a, e -> e.f)").alias("f"), F.expr(fold).alias("holder"))).alias("o"))
    return held.select(clip, F.col("o.f").alias(frame), F.col("o.holder").alias("holder"))


def islands(rows: DataFrame, keys: list[str], order: str, value: str, out: str = "island") -> DataFrame:
    """Number of the run of equal values (nulls equal each other) that a row belongs to."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"))
    return rows.withColumn("_c", changed).withColumn(out, F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def long_spells(held: DataFrame, clip: str, frame: str, least: int, holder: str = "holder") -> DataFrame:
    """Spells of a holder shorter than ``least`` rows become nobody's."""
    i = islands(held, [clip], frame, holder)
    n = F.count("*").over(Window.partitionBy(clip, "island"))
    return i.withColumn(holder, F.when(n >= least, F.col(holder))).drop("island")


def dense_grid(rows: DataFrame, clip: str, frame: str, frames: DataFrame, values: list[str]) -> DataFrame:
    """Every frame of every clip (frames: clip, f0, f1) with the list of its rows, empty where there is none."""
    grid = frames.select(clip, F.explode(F.sequence("f0", "f1")).alias(frame))
    lists = rows.groupBy(clip, frame).agg(F.array_sort(F.collect_list(F.struct(*values))).alias("rows"))
    out = grid.join(lists, [clip, frame], "left")
    return out.withColumn("rows", F.coalesce("rows", F.array().cast(lists.schema["rows"].dataType)))


def without_counterpart(points: DataFrame, clip: str, frame: str = "frame", idx: str = "idx", near: float = 0.05) -> DataFrame:
    """Per clip the sightings with a next frame, and how many have nothing within ``near`` in it."""
    last = points.groupBy(clip).agg(F.max(frame).alias("_last"))
    a = points.join(last, clip).where(F.col(frame) < F.col("_last")).select(clip, (F.col(frame) + 1).alias(frame), F.col(idx).alias("_i"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    b = points.select(clip, frame, "x", "y")
    close = ((F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y"))) <= near * near
    met = within(a, b, [clip, frame], (F.col("_x"), F.col("_y")), (F.lit(near), F.lit(near)), (F.col("x"), F.col("y")), (2 * near, 2 * near))
    met = met.where(close).groupBy(clip).agg(F.count_distinct(F.col(frame), F.col("_i")).alias("met"))
    return a.groupBy(clip).agg(F.count("*").alias("sightings")).join(met, clip, "left").select(clip, "sightings", (F.col("sightings") - F.coalesce("met", F.lit(0))).alias("lost"))
