"""Label layout: rank fade, collisions, overlap, density, easing, colours that keep their distance."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from loomspan.operators.grid import dealt, largest, within
from loomspan.session import ship

NUDGE, MAX_NUDGE = 0.75, 3.0
FULL, FADING, FLOOR = 6, 4, 0.38
CROWD_FLOOR = 0.45
DENSITY_R, DENSITY_N, DENSITY_FLOOR = 4.0, 5, 0.55
EASE_S = 0.25


def rank_fade(players: DataFrame, ball: DataFrame, keys: list[str], full: int = FULL, fading: int = FADING, floor: float = FLOOR) -> DataFrame:
    """Opacity by rank of distance to the ball (ties by position): ``full`` at 1, ``fading`` steps down, then a floor.
    Frames without a ball or with few players, and the one on the ball, stay at 1. players: keys, idx, x, y, on_ball."""
    j = players.join(ball.select(*keys, F.col("x").alias("bx"), F.col("y").alias("by")), keys, "left")
    d = F.sqrt((F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by")))
    w = Window.partitionBy(*keys)
    j = j.withColumn("_d", d).withColumns({"_r": F.row_number().over(w.orderBy("_d", "idx")) - 1, "_n": F.count("*").over(w)})
    steps = F.when(F.col("_r") < full, 1.0).when(F.col("_r") < full + fading, 1.0 - (F.col("_r") - full + 1) / (fading + 1)).otherwise(floor)
    return j.withColumn("alpha", F.when(F.col("bx").isNull() | (F.col("_n") <= full) | F.col("on_ball"), 1.0).otherwise(steps)).drop("_d", "_r", "_n", "bx", "by")


def moved_labels(labels: DataFrame, keys: list[str], nudge: float = NUDGE, most: float = MAX_NUDGE) -> DataFrame:
    """Labels (keys, idx, cx, top, w, h, priority) moved up step by step until they are free of those placed before
    them, by falling priority (ties by position): keys, idx, y, unresolved. The place of a label is the first of its few
    possible steps without a hit, else the last with ``unresolved``.

    No pairs are made: a task takes its frames' labels one after the other in their order, and keeps the labels placed so far of one frame, by
    columns as wide as the widest label and by height. A label without a place hits nothing.
    """
    ship(labels.sparkSession)
    wide = largest(labels, "w")
    rows = dealt(labels.select(*keys, F.col("idx").cast("int").alias("idx"), "priority", *[F.col(c).cast("double").alias(c) for c in ("cx", "top", "w", "h")]), keys)
    rows = rows.sortWithinPartitions(*keys, F.desc("priority"), "idx").withColumn("_wide", wide.cast("double"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, placed = None, None
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            cells = lambda c: batch.column(at[c]).to_pylist()
            out = []
            for key, cx, top, w, h, step in zip(zip(*map(cells, keys)), *map(cells, ("cx", "top", "w", "h", "_wide"))):
                if placed is None or key != now:
                    now, placed = key, Placed(step)
                out.append(placed.add(cx, top, w, h, nudge, most))
            yield pa.record_batch([batch.column(at[c]) for c in (*keys, "idx")] + [pa.array([y for y, _ in out], pa.float64()), pa.array([u for _, u in out], pa.bool_())], names=[*keys, "idx", "y", "unresolved"])

    schema = StructType([rows.schema[k] for k in (*keys, "idx")]).add("y", DoubleType()).add("unresolved", BooleanType())
    return rows.mapInArrow(run, schema)


class Placed:
    """The labels placed so far in a frame: in columns of width ``wide``, each in order of height."""

    def __init__(self, wide: float):
        self.wide, self.tallest, self.columns = wide, 0.0, {}

    def hit(self, columns: list, x0: float, x1: float, y: float, h: float) -> bool:
        low, high = y - self.tallest * 1.0001 - abs(y) * 1e-9, y + h
        for tops, boxes in columns:
            for k in range(bisect_left(tops, low), bisect_left(tops, high)):
                a, b, tall = boxes[k]
                if x1 > a and x0 < b and y < tops[k] + tall:
                    return True
        return False

    def add(self, cx: float | None, top: float | None, w: float | None, h: float | None, nudge: float, most: float) -> tuple[float | None, bool | None]:
        """The y of the next label, and whether it hits others there."""
        if h is None:
            return None, None
        if cx is None or top is None or w is None:
            return top, False
        x0, x1, step = cx - w / 2, cx + w / 2, max(1.0, h * nudge)
        columns = [self.columns.setdefault(c, ([], [])) for c in range(floor(x0 / self.wide), floor(x1 / self.wide) + 1)]
        last = floor(h * most / step) + 1
        # the last try lies past the limit and is taken whatever it hits
        k = next((k for k in range(last) if not self.hit(columns, x0, x1, top - k * step, h)), last)
        y = top - k * step
        for tops, boxes in columns:
            place = bisect_left(tops, y)
            tops.insert(place, y)
            boxes.insert(place, (x0, x1, h))
        self.tallest = max(self.tallest, h)
        return y, k == last


def overlap_alpha(labels: DataFrame, keys: list[str], floor: float = CROWD_FLOOR) -> DataFrame:
    """Opacity of labels (keys, idx, cx, y, w, h) that overlap others: by the largest share of the smaller one."""
    a = labels.select(*keys, "idx", *[F.col(c).alias(f"a_{c}") for c in ("cx", "y", "w", "h")])
    b = labels.select(*keys, F.col("idx").alias("_j"), *[F.col(c).alias(f"b_{c}") for c in ("cx", "y", "w", "h")])
    ox = F.expr("least(a_cx + a_w / 2, b_cx + b_w / 2) - greatest(a_cx - a_w / 2, b_cx - b_w / 2)")
    oy = F.expr("least(a_y + a_h, b_y + b_h) - greatest(a_y, b_y)")
    wide, tall = largest(labels, "w"), largest(labels, "h")
    near = within(a, b, keys, (F.col("a_cx"), F.col("a_y")), (F.col("a_w") / 2 + wide / 2, F.greatest(F.col("a_h"), tall)), (F.col("b_cx"), F.col("b_y")), (wide, tall))
    pairs = near.where(F.col("idx") != F.col("_j")).withColumns({"ox": ox, "oy": oy}).where("ox > 0 and oy > 0")
    share = F.col("ox") * F.col("oy") / F.greatest(F.lit(1.0), F.least(F.expr("a_w * a_h"), F.expr("b_w * b_h")))
    low = pairs.groupBy(*keys, "idx").agg(F.min(1.0 - (1.0 - floor) * F.least(F.lit(1.0), share)).alias("alpha"))
    return labels.join(low, [*keys, "idx"], "left").withColumn("alpha", F.coalesce("alpha", F.lit(1.0)))


def density_alpha(labels: DataFrame, keys: list[str], reach: float = DENSITY_R, many: int = DENSITY_N, floor: float = DENSITY_FLOOR) -> DataFrame:
    """Opacity of labels with many neighbours, in frames with more than ``many`` labels."""
    a = labels.select(*keys, "idx", F.col("cx").alias("_x"), F.col("y").alias("_y"), F.col("w").alias("_w"), F.col("h").alias("_h"))
    b = labels.select(*keys, F.col("idx").alias("_j"), "cx", "y")
    reaches = (reach * F.greatest("_w", F.lit(1.0)), 2.0 * F.col("_h"))
    close = (F.abs(F.col("_x") - F.col("cx")) < reaches[0]) & (F.abs(F.col("_y") - F.col("y")) < reaches[1])
    size = (largest(labels, f"{reach}D * greatest(w, 1.0D)"), largest(labels, "2.0D * h"))
    near = within(a, b, keys, (F.col("_x"), F.col("_y")), reaches, (F.col("cx"), F.col("y")), size).where(close & (F.col("idx") != F.col("_j"))).groupBy(*keys, "idx").agg(F.count("*").alias("near"))
    counts = labels.groupBy(*keys).agg(F.count("*").alias("n"))
    all_ = labels.select(*keys, "idx").join(counts, keys).join(near, [*keys, "idx"], "left").withColumn("near", F.coalesce("near", F.lit(0)))
    over = F.least(F.lit(1.0), (F.col("near") - many + 1) / float(many))
    return all_.select(*keys, "idx", "near", F.when((F.col("n") > many) & (F.col("near") >= many), 1.0 - (1.0 - floor) * over).otherwise(1.0).alias("alpha"))


def eased_offsets(offsets: DataFrame, key: list[str], fps: float, seconds: float = EASE_S, frame: str = "frame", value: str = "offset", dead: float = 0.5) -> DataFrame:
    """Offsets of each label over time, eased: a change of target by more than ``dead`` starts a move from where the
    label stands, along a smooth step. A fold over each label."""
    step = 1.0 / max(1.0, seconds * fps)
    a = offsets.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), F.col(value).cast("double").alias("v")))).alias("a"))
    fold = f"""aggregate(a, named_struct('cur', a[0].v, 'src', a[0].v, 'dst', a[0].v, 'p', 1.0D, 'out', cast(array() as array<struct<f:int,v:double>>)),
      (s, e) -> transform(transform(array(named_struct('n', abs(e.v - s.dst) > {dead}D)), z -> named_struct('src', if(z.n, s.cur, s.src), 'dst', if(z.n, e.v, s.dst), 'p', least(1.0D, if(z.n, 0.0D, s.p) + {step!r}D))),
        t -> named_struct('cur', t.src + (t.dst - t.src) * (t.p * t.p * (3.0D - 2.0D * t.p)), 'src', t.src, 'dst', t.dst, 'p', t.p,
          'out', array_append(s.out, named_struct('f', e.f, 'v', t.src + (t.dst - t.src) * (t.p * t.p * (3.0D - 2.0D * t.p))))))[0], s -> s.out)"""
    return a.select(*key, F.explode(F.expr(fold)).alias("o")).select(*key, F.col("o.f").alias(frame), F.col("o.v").alias(value))


def farthest_candidate(candidates: DataFrame, taken: DataFrame, distance, cand: str = "cand") -> DataFrame:
    """The candidate whose least distance to all taken colours is largest (maximin). ``taken`` is a palette: a few
    rows, so each candidate meets each of them in a broadcast."""
    pairs = candidates.join(F.broadcast(taken))
    low = pairs.groupBy(cand).agg(F.min(distance).alias("distance"))
    return low.agg(F.max_by(F.struct(cand, "distance"), F.struct("distance", -F.col(cand))).alias("b")).select(f"b.{cand}", "b.distance")
