"""Joins of what lies near each other, by cells of a grid.

Rows of both sides fall into cells; a row of the left goes to the few cells that its reach touches, a row of the right
to its own, and cells meet by an equi-join. So the pairs that are looked at are of the order of those that are near, not of the
square of a frame, and a crowded frame is dealt over tasks by its cells. Each pair is looked at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 15  # of a place along one side of a frame, in Z order
BLOCK = 128  # rows of a side whose pairs are made together


def cell(value: Column | str, size: Column | float) -> Column:
    return F.floor((F.col(value) if isinstance(value, str) else value) / size)


def within(left: DataFrame, right: DataFrame, keys: list[str], at: Sequence[Column], reach: Sequence[Column], place: Sequence[Column], size: Sequence) -> DataFrame:
    """Pairs with equal ``keys`` whose places differ by at most the left row's ``reach``, and some more within the cells that it touches.

    at, reach: over the columns of ``left``; place: over those of ``right``; size: of a cell, about the reach (a number, a scalar, or
    a column among ``keys``). The two sides have no column but ``keys`` in common. Nulls are near nothing.
    """
    wide, own = into_cells(left, right, at, reach, place, size)
    return wide.join(own, [*keys, "_cx", "_cy"]).drop("_cx", "_cy")


def into_cells(left: DataFrame, right: DataFrame, at: Sequence[Column], reach: Sequence[Column], place: Sequence[Column], size: Sequence) -> tuple[DataFrame, DataFrame]:
    """Both sides with _cx and _cy: of each left row once for every cell that its reach touches, of each right row its own."""
    cells = [F.sequence(cell(a - r, s), cell(a + r, s)) for a, r, s in zip(at, reach, size)]
    wide = left.withColumn("_cx", F.explode(cells[0])).withColumn("_cy", F.explode(cells[1]))
    return wide, right.withColumns({"_cx": cell(place[0], size[0]), "_cy": cell(place[1], size[1])})


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by ``keys`` to a fixed number of tasks. Where each key's rows meet in pairs, the work isn't told by bytes, by which
    adaptive execution would put many keys into few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def blocks(rows: DataFrame, keys: list[str], order: Sequence[str], out: str, size: int = BLOCK) -> DataFrame:
    """keys, out: the rows of a key in the order of the columns ``order``, ``size`` at a time, as arrays of their other columns. Rows are numbered
    as a key's sorted rows are read, and one block is held at a time."""
    rest = [*order, *[c for c in rows.columns if c not in keys and c not in order]]
    numbered = rows.withColumn("_n", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))
    return numbered.groupBy(*keys, "_n").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(out)).drop("_n")


def paired(met: DataFrame, near: str = "true") -> DataFrame:
    """All pairs of a row of ``_a`` with a row of ``_b``, two blocks that a row of ``met`` holds beside other columns; rows of ``_a`` without ``near``, over these
    columns and their own, make none. What is joined, sorted and buffered is a row for two blocks, not for two rows, and a pair is made where it
    is passed on. Pairs come in the order of their blocks, so where rows that are alike stand together their pairs do too, and columnar files of them are small."""
    for side in ("_a", "_b"):
        met = met.withColumn(side, F.explode(side)).select(*[c for c in met.columns if c != side], f"{side}.*")
        met = met.where(near) if side == "_a" else met
    return met


def largest(rows: DataFrame, value: str, least: float = 1e-6) -> Column:
    """The largest ``value`` of a table as a scalar subquery, for the size of cells."""
    return rows.agg(F.greatest(F.coalesce(F.max(F.expr(value)), F.lit(0.0)), F.lit(least)).alias("m")).scalar()


def z_order(x: Column, y: Column) -> Column:
    """The bits of two whole numbers below 2**BITS by turns."""

    def spread(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(x.cast("long")).bitwiseOR(F.shiftleft(spread(y.cast("long")), 1))


def nearest_other(points: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """keys, idx, nearest: the distance from each point to the nearest other one of its frame, for frames with two or more.

    Points of one place are 0 apart. Of the others, the neighbours along a Z-shaped path bound the distance; then a point looks into the
    cells that a square of that half width touches, in a grid whose cells are up to twice the square (four cells at most). Cells' sizes are
    halves of halves of the frame, so points with bounds of one order share a grid.
    """
    p = points.where("x is not null and y is not null").select(*keys, idx, "x", "y")
    places = p.groupBy(*keys, "x", "y").agg(F.count("*").alias("_n"))
    frame = Window.partitionBy(*keys)
    span = F.greatest(F.max("x").over(frame) - F.min("x").over(frame), F.max("y").over(frame) - F.min("y").over(frame))
    m = places.withColumns({"_span": span, "_x0": F.min("x").over(frame), "_y0": F.min("y").over(frame)})
    whole = lambda v, low: F.least(F.floor((F.col(v) - F.col(low)) / F.nullif("_span", F.lit(0.0)) * (1 << BITS)), F.lit((1 << BITS) - 1))
    m = m.withColumn("_z", F.coalesce(z_order(whole("x", "_x0"), whole("y", "_y0")), F.lit(0)))
    w = frame.orderBy("_z", "x", "y")
    far = lambda f: F.sqrt((f("x").over(w) - F.col("x")) * (f("x").over(w) - F.col("x")) + (f("y").over(w) - F.col("y")) * (f("y").over(w) - F.col("y")))
    m = m.withColumn("_d", F.least(far(F.lag), far(F.lead)))
    # cells of span / 2**level, at least as wide as the square
    m = m.withColumn("_level", F.greatest(F.lit(0), F.least(F.lit(BITS), F.floor(F.log2(F.col("_span") / (2 * F.col("_d")))))).cast("int"))
    alone = m.where("_n = 1 and _d is not null")
    size = F.col("_span") / F.pow(F.lit(2.0), F.col("_level"))
    cells = [F.sequence(cell(F.col(v) - F.col("_d") - F.col(low), size), cell(F.col(v) + F.col("_d") - F.col(low), size)) for v, low in (("x", "_x0"), ("y", "_y0"))]
    a = alone.select(*keys, "_level", F.col("x").alias("_ax"), F.col("y").alias("_ay"), F.explode(cells[0]).alias("_cx"), cells[1].alias("_cys")).withColumn("_cy", F.explode("_cys")).drop("_cys")
    levels = alone.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    b = m.join(levels, keys).withColumn("_level", F.explode("_levels"))
    b = b.select(*keys, "_level", "x", "y", cell(F.col("x") - F.col("_x0"), size).alias("_cx"), cell(F.col("y") - F.col("_y0"), size).alias("_cy"))
    pairs = a.join(b, [*keys, "_level", "_cx", "_cy"]).where("x <> _ax or y <> _ay")
    dx, dy = F.col("x") - F.col("_ax"), F.col("y") - F.col("_ay")
    near = pairs.groupBy(*keys, F.col("_ax").alias("x"), F.col("_ay").alias("y")).agg(F.min(F.sqrt(dx * dx + dy * dy)).alias("nearest"))
    shared = places.where("_n > 1").select(*keys, "x", "y", F.lit(0.0).alias("nearest"))
    return p.join(near.unionByName(shared), [*keys, "x", "y"]).select(*keys, idx, "nearest")
