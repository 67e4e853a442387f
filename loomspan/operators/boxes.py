"""Detections as boxes: validation, frame rejection, duplicates, degenerate frames, unit conversion, wire rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.grid import within

LOW, HIGH, MAX_ASPECT, REJECT_SHARE = -0.10, 1.50, 3.0, 0.40
DEDUPE_IOU, DEGENERATE_RATIO = 0.45, 0.40


def in_range(x: str = "x", y: str = "y", w: str = "w", h: str = "h", low: float = LOW, high: float = HIGH) -> Column:
    inside = [F.expr(e).between(low, high) for e in (x, y, f"{x} + {w}", f"{y} + {h}")]
    return inside[0] & inside[1] & inside[2] & inside[3] & (F.col(w) > 0) & (F.col(h) > 0)


def checked(boxes: DataFrame, aspect: float = 16 / 9, max_aspect: float = MAX_ASPECT) -> DataFrame:
    """``boxes`` with ``off`` (out of range) and ``wide`` (in range, but a ribbon)."""
    ok = in_range()
    wide = ok & (F.expr(f"(w / h) * {aspect!r}D") > max_aspect)
    return boxes.withColumns({"off": ~ok, "wide": wide})


def frame_counts(boxes: DataFrame, keys: list[str], reject: float = REJECT_SHARE) -> DataFrame:
    """Per frame: total, dropped, wide, frame_rejected (too large a share was dropped)."""
    c = checked(boxes).groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("off") | F.col("wide")).alias("dropped"), F.count_if("wide").alias("wide"))
    return c.withColumn("frame_rejected", F.col("dropped") / F.greatest("total", F.lit(1)) > reject)


def valid(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Valid boxes of the frames that aren't rejected. The rejected frames are few and found by a semi join
    on the same key, so boxes are shuffled once."""
    good = frame_counts(boxes, keys).where("not frame_rejected").select(*keys)
    return checked(boxes).where("not off and not wide").drop("off", "wide").join(good, keys, "left_semi")


def ball_in_range(frames: DataFrame, columns: tuple[str, ...] = ("x", "y", "w", "h"), low: float = LOW, high: float = HIGH) -> DataFrame:
    """Frames (at most one ball each, its box in ``columns``) whose ball is null where it lies off the scale, with ``ball_dropped``. A missing size
    counts as 0, a missing place as off the scale."""
    x, y, w, h = (F.col(c) for c in columns)
    far = [x + F.coalesce(w, F.lit(0.0)), y + F.coalesce(h, F.lit(0.0))]
    ok = F.lit(True)
    for v in (x, y, *far):
        ok = ok & F.coalesce(v.between(low, high), F.lit(False))
    some = x.isNotNull() | y.isNotNull() | w.isNotNull() | h.isNotNull()
    out = frames.withColumns({"_ok": ok, "ball_dropped": some & ~ok})
    return out.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in columns}).drop("_ok")


def overlap(p: str, q: str) -> Column:
    """Intersection over union of two boxes whose columns begin with ``p`` and ``q``; 0 where the union has no area."""
    side = lambda at, long: F.greatest(F.lit(0.0), F.least(F.expr(f"{p}{at} + {p}{long}"), F.expr(f"{q}{at} + {q}{long}")) - F.greatest(f"{p}{at}", f"{q}{at}"))
    both = side("x", "w") * side("y", "h")
    union = F.expr(f"{p}w * {p}h + {q}w * {q}h") - both
    return F.when(union > 0, both / union).otherwise(0.0)


def suppressed(boxes: DataFrame, keys: list[str], threshold: float = DEDUPE_IOU, carry: tuple[str, ...] = ()) -> DataFrame:
    """Greedy suppression of overlaps by falling confidence (ties by position): keys, raw (boxes of the frame), kept (those left, in
    that order). ``carry``: further columns to keep.

    Of boxes that are one and the same the first is taken at once, so a frame that repeats one box is small. Pairs that overlap
    too much have their centres near each other and are found by a grid join; each box is given the list of earlier boxes that it
    overlaps, and a fold over the frame marks a box as left if none of its list is. The fold looks at those lists alone, not at all
    pairs.
    """
    fields = ["idx", "x", "y", "w", "h", "conf", *carry]
    order = F.struct((-F.col("conf")).alias("order"), *fields)
    one = F.when((F.col("w") * F.col("h") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull(), 0).otherwise(F.col("idx"))
    same = boxes.groupBy(*keys, "x", "y", "w", "h", one.alias("_one")).agg(F.count("*").alias("_n"), F.min(order).alias("_b"))
    frame = Window.partitionBy(*keys)
    sizes = {f"_s{c}": F.greatest(F.max(F.col(f"_b.{c}")).over(frame), F.lit(1e-6)) for c in "wh"}  # of cells: a frame's largest box
    ranked = same.select(*keys, "_n", "_b", F.row_number().over(frame.orderBy("_b")).alias("_r"), *[v.alias(k) for k, v in sizes.items()])
    a = ranked.select(*keys, *sizes, F.col("_r").alias("_p"), *[F.col(f"_b.{c}").alias(f"p{c}") for c in "xywh"])
    b = ranked.select(*keys, *sizes, F.col("_r").alias("_q"), *[F.col(f"_b.{c}").alias(f"q{c}") for c in "xywh"])
    # centres of boxes with an overlap of t lie apart by half a side, and where t is below a half by some more, at most
    share = 0.5 + max(0.0, 0.5 - threshold) / threshold
    middle = lambda s: (F.expr(f"{s}x + {s}w / 2"), F.expr(f"{s}y + {s}h / 2"))
    reach = [share * F.greatest(c, F.lit(0.0)) for c in ("pw", "ph")]
    met = within(a, b, [*keys, *sizes], middle("p"), reach, middle("q"), [F.col(c) for c in sizes])
    met = met.where(F.col("_p") < F.col("_q")).where(overlap("p", "q") > threshold).groupBy(*keys, F.col("_q").alias("_r")).agg(F.collect_list("_p").alias("_before"))
    rows = ranked.join(met, [*keys, "_r"], "left").groupBy(*keys).agg(F.sum("_n").alias("raw"), F.array_sort(F.collect_list(F.struct("_r", "_b", F.coalesce("_before", F.array().cast("array<int>")).alias("_before")))).alias("a"))
    left = "aggregate(a, cast(array() as array<boolean>), (acc, p) -> array_append(acc, not exists(p._before, k -> element_at(acc, k))))"
    both = F.arrays_zip(F.col("a"), F.expr(left).alias("left"))  # side by side, as a column that a lambda names is made for every element
    return rows.select(*keys, "raw", F.transform(F.filter(both, lambda z: z["left"]), lambda z: z["a"]["_b"]).alias("kept"))


def repeats(ratio: float = DEGENERATE_RATIO, least: int = 4) -> Column:
    """Whether a frame of ``suppressed`` is one box repeated: ``least`` raw boxes of which too small a share is left."""
    return (F.col("raw") >= least) & (F.size("kept") / F.col("raw") < ratio)


def deduped(boxes: DataFrame, keys: list[str], threshold: float = DEDUPE_IOU, carry: tuple[str, ...] = (), mark: bool = False) -> DataFrame:
    """The boxes that are left; ``mark`` adds ``degenerate``, whether their frame is one box repeated."""
    out = suppressed(boxes, keys, threshold, carry).withColumn("degenerate", repeats())
    fields = ("idx", "x", "y", "w", "h", "conf", *carry)
    return out.select(*keys, "degenerate", F.explode("kept").alias("p")).select(*keys, *[F.col(f"p.{c}").alias(c) for c in fields], *(["degenerate"] if mark else []))


def degenerate(boxes: DataFrame, keys: list[str], ratio: float = DEGENERATE_RATIO, least: int = 4) -> DataFrame:
    """Frames in which one box is repeated: at least ``least`` raw boxes of which too small a share remains."""
    return suppressed(boxes, keys).where(repeats(ratio, least)).select(*keys, "raw", F.size("kept").cast("long").alias("unique"))


def to_fractions(boxes: DataFrame, conventions: DataFrame, on: str, width: str = "iw", height: str = "ih") -> DataFrame:
    """Boxes in the units of their model's convention, as fractions: ``fraction`` stays, ``permille`` is divided by
    1000, ``pixel`` by the image's size. Conventions are looked up, never guessed; an unknown model is an error."""
    j = boxes.join(conventions.select(F.col(on).alias("_on"), "convention"), F.col(on) == F.col("_on"), "left").drop("_on")
    j = j.withColumn("convention", F.when(F.col("convention").isNull(), F.raise_error(F.lit("no coordinate convention for this model"))).otherwise(F.col("convention")))
    by_x = F.when(F.col("convention") == "permille", 1000.0).when(F.col("convention") == "pixel", F.col(width)).otherwise(1.0)
    by_y = F.when(F.col("convention") == "permille", 1000.0).when(F.col("convention") == "pixel", F.col(height)).otherwise(1.0)
    return j.withColumns({"x": F.col("x") / by_x, "w": F.col("w") / by_x, "y": F.col("y") / by_y, "h": F.col("h") / by_y})


def from_fractions(boxes: DataFrame, width: str = "iw", height: str = "ih") -> DataFrame:
    """The inverse, to pixels."""
    return boxes.withColumns({"x": F.col("x") * F.col(width), "w": F.col("w") * F.col(width), "y": F.col("y") * F.col(height), "h": F.col("h") * F.col(height)})


def wire_rows(rows: DataFrame, row: str, order: tuple[str, ...] = ("x", "y", "w", "h", "kit", "num", "conf"), required: int = 6) -> DataFrame:
    """Positional arrays of strings as named columns: a number that can't be read is 0, a jersey null, a missing
    confidence 1. Rows that are too short have ``malformed`` set."""
    kinds = {"x": "double", "y": "double", "w": "double", "h": "double", "num": "int", "conf": "double"}
    rest = {"x": 0.0, "y": 0.0, "w": 0.0, "h": 0.0, "conf": 1.0}
    out = {"malformed": F.coalesce(F.size(row) < required, F.lit(True))}
    for k, name in enumerate(order):
        value = F.try_element_at(F.col(row), F.lit(k + 1))
        if name in kinds:
            value = value.try_cast(kinds[name])
            if name in rest:
                value = F.coalesce(value, F.lit(rest[name]))
        else:
            value = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
        out[name] = value
    return rows.withColumns(out)


def top_candidate(frames: DataFrame, balls: str = "balls") -> DataFrame:
    """The first of a list of candidates as the ball, or null; the list stays."""
    return frames.withColumn("ball", F.try_element_at(F.col(balls), F.lit(1)))


def by_confidence(boxes: DataFrame, high: float = 0.5) -> DataFrame:
    return boxes.withColumn("stage", F.when(F.col("conf") >= high, "hi").otherwise("lo"))


def every_kth(frames: DataFrame, key: str, order: str, k: int, most: int) -> DataFrame:
    """Every k-th frame of each key, the first ``most`` of them (a probe set, asked for as such)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return frames.withColumn("_n", n).where((F.col("_n") % k == 0) & (F.col("_n") < k * most)).drop("_n")
