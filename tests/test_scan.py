"""Recurrences in blocks, grid joins, and neighbours against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import boxes, frames, grid, layout, scan, series


@pytest.mark.parametrize("block", [2, 3, 256])
def test_linear_recurrence_in_blocks(spark, block):
    r = np.random.default_rng(1)
    m, n = np.array([[0.8, 0.1], [-0.3, 0.7]]), np.array([0.2, 0.3])
    rows = [(k, int(f), float(r.normal()), float(r.normal()), f"n{f}") for k, size in ((0, 1), (1, 40), (2, 7), (3, 200)) for f in np.sort(r.choice(600, size, replace=False)) - 100]
    df = spark.createDataFrame(rows, "k int, f int, a double, b double, note string").repartition(3)
    got = {(x["k"], x["f"]): x for x in scan.linear(df, ["k"], "f", ["a", "b"], m, n, block).collect()}
    assert len(got) == len(rows)
    for key in range(4):
        mine = [x for x in rows if x[0] == key]
        state = np.array([[mine[0][2], mine[0][3]], [0, 0]])
        for k, f, a, b, note in mine:
            state = m @ state + np.outer(n, [a, b])
            assert abs(got[k, f]["a"] - state[0, 0]) < 1e-12 and abs(got[k, f]["b"] - state[0, 1]) < 1e-12 and got[k, f]["note"] == note


def test_easing_follows_the_spring(spark):
    """As the spring is written down: a pull, then position and speed."""
    r = np.random.default_rng(2)
    xs, dt, smooth = r.random((300, 2)), 0.1, 0.25
    df = spark.createDataFrame([(1, k, float(x), float(y), 0.5) for k, (x, y) in enumerate(xs)], "k int, frame int, x double, y double, w double")
    got = sorted(tuple(v) for v in series.damped(df, ["k"], dt, smooth).select("frame", "x", "y", "w").collect())
    omega = 2 / smooth
    z = omega * dt
    ex = 1 / (1 + z + 0.48 * z * z + 0.235 * z**3)
    at, v = xs[0].copy(), np.zeros(2)
    for k, target in enumerate(xs):
        push = (v + omega * (at - target)) * dt
        v, at = (v - omega * push) * ex, target + (at - target + push) * ex
        assert got[k][0] == k and abs(got[k][1] - at[0]) < 1e-12 and abs(got[k][2] - at[1]) < 1e-12 and got[k][3] == 0.5


POINT = "clip int, frame int, idx int, x double, y double"


@pytest.mark.parametrize("kind", ["even", "clusters", "line", "grid", "one place"])
def test_nearest_other(spark, kind):
    r = np.random.default_rng(3)
    rows = []
    for f in range(4):
        n = (1, 2, 40, 300)[f]
        p = r.random((n, 2))
        if kind == "clusters":
            p = np.where(r.random((n, 1)) < 0.8, 0.3 + p * 1e-4, p * 50 - 20)
        elif kind == "line":
            p[:, 1] = 0.5
        elif kind == "grid":
            p = (p * 9).round() / 9
        elif kind == "one place":
            p[:] = 0.25
        rows += [(0, f, k, float(x), float(y)) for k, (x, y) in enumerate(p)]
    rows += [(0, 9, 1, None, 1.0), (0, 9, 2, 0.0, 0.0), (0, 9, 3, 3.0, 4.0)]
    got = {(x["frame"], x["idx"]): x["nearest"] for x in grid.nearest_other(spark.createDataFrame(rows, POINT), ["clip", "frame"]).collect()}
    expected = {}
    for f in {x[1] for x in rows}:
        some = [x for x in rows if x[1] == f and x[3] is not None]
        for a in some:
            others = [((b[3] - a[3]) ** 2 + (b[4] - a[4]) ** 2) ** 0.5 for b in some if b[2] != a[2]]
            if others:
                expected[f, a[2]] = min(others)
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)


def test_pairs_within_reach_once(spark):
    r = np.random.default_rng(4)
    a = spark.createDataFrame([(f, k, *map(float, r.random(2) * 4 - 2), float(r.random() * 0.5)) for f in range(3) for k in range(60)], "frame int, i int, ax double, ay double, far double")
    b = spark.createDataFrame([(f, k, *map(float, r.random(2) * 4 - 2)) for f in range(3) for k in range(60)] + [(0, 99, None, 0.0)], "frame int, j int, bx double, by double")
    close = (F.abs(F.col("ax") - F.col("bx")) <= F.col("far")) & (F.abs(F.col("ay") - F.col("by")) <= F.col("far"))
    expected = sorted(tuple(x) for x in a.join(b, "frame").where(close).select("frame", "i", "j").collect())
    met = grid.within(a, b, ["frame"], (F.col("ax"), F.col("ay")), (F.col("far"), F.col("far")), (F.col("bx"), F.col("by")), (0.3, 0.3))
    assert sorted(tuple(x) for x in met.where(close).select("frame", "i", "j").collect()) == expected
    assert met.count() < 0.4 * a.join(b, "frame").count()


BOX = "clip int, frame int, idx int, x double, y double, w double, h double, conf double"


def greedy(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[2])):
        over = lambda q: max(0, min(r[3] + r[5], q[3] + q[5]) - max(r[3], q[3])) * max(0, min(r[4] + r[6], q[4] + q[6]) - max(r[4], q[4]))  # noqa: B023, E731
        share = lambda q: over(q) / u if (u := r[5] * r[6] + q[5] * q[6] - over(q)) > 0 else 0.0  # noqa: B023, E731
        if all(share(q) <= 0.45 for q in kept):
            kept.append(r)
    return [r[2] for r in kept]


@pytest.mark.parametrize("kind", ["crowd", "copies", "sizes", "flat", "off the scale"])
def test_duplicates_in_frames_of_all_kinds(spark, kind):
    r = np.random.default_rng(6)
    rows = []
    for f in range(3):
        for k in range(120):
            x, y = r.random(2) * (0.3 if kind == "crowd" else 1)
            w, h = (0.05, 0.1) if kind != "sizes" else (0.02 * 2 ** r.integers(0, 6), 0.02 * 2 ** r.integers(0, 6))
            if kind == "copies" and r.random() < 0.6:
                x, y, w, h = 0.5, 0.5, 0.05, 0.1
            if kind == "flat" and r.random() < 0.3:
                x, y, w, h = 0.5, 0.5, 0.05, 0.0
            if kind == "off the scale" and r.random() < 0.2:
                x, w = x * 1000, w * 100
            rows.append((0, f, k, float(x), float(y), float(w), float(h), float(round(r.random(), 1))))
    got = boxes.suppressed(spark.createDataFrame(rows, BOX).repartition(4), ["clip", "frame"]).collect()
    assert {x["frame"]: [b["idx"] for b in x["kept"]] for x in got} == {f: greedy([x for x in rows if x[1] == f]) for f in range(3)}
    assert all(x["raw"] == 120 for x in got)


def test_a_large_frame_is_no_square(spark):
    """10,000 boxes in a frame: duplicates, spacing and labels in a time that all pairs would not allow."""
    import time

    n = 10_000
    df = spark.range(n).selectExpr("0 as clip", "0 as frame", "int(id) as idx", "(id * 7919 % 10007) / 10007.0 as x", "(id * 104729 % 10009) / 10009.0 as y", "0.01 as w", "0.02 as h", "(id % 101) / 101.0 as conf")
    began = time.time()
    left = boxes.deduped(df.selectExpr("clip", "frame", "idx", "double(x) as x", "double(y) as y", "double(w) as w", "double(h) as h", "double(conf) as conf"), ["clip", "frame"]).count()
    near = frames.nearest_other(df, ["clip", "frame"]).count()
    labels = df.selectExpr("clip", "frame", "idx", "double(x) * 12800 as cx", "double(y) * 7200 as top", "40.0D as w", "14.0D as h", "double(conf) as priority")
    moved = layout.moved_labels(labels, ["clip", "frame"]).count()
    assert 0 < left <= n and near == n and moved == n and time.time() - began < 120


def test_order_statistics_are_exact(spark):
    """Of keys with few and many values, with ties and nulls, through bands that a sketch bounds."""
    from loomspan.operators import reports

    r = np.random.default_rng(7)
    data = {"one": [3.0], "few": r.integers(0, 4, 17).tolist(), "many": np.round(r.lognormal(0, 4, 6000), 3).tolist(), "ties": r.integers(0, 3, 3000).tolist(), None: r.normal(0, 1, 500).tolist()}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("few", None), ("none", None)]
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p999": 0.999}
    df = spark.createDataFrame(rows, "arm string, v double").repartition(5)
    for accuracy in (100, 10_000):
        got = {x["arm"]: x for x in reports.ranked_values(df, ["arm"], "v", shares, accuracy).collect()}
        assert set(got) == set(data)
        for k, vs in data.items():
            vs = sorted(map(float, vs))
            assert (got[k]["n"], got[k]["max"]) == (len(vs), vs[-1])
            assert [got[k][s] for s in shares] == [vs[int(len(vs) * q)] for q in shares.values()]
