"""Steps that make pairs: what they cost for a pair, and that they still make all of them."""

import math
import random
import re
import statistics

from pyspark.sql import functions as F

from loomspan.functions import scalar
from loomspan.operators import frames, intervals, layout
from loomspan.plans import frame_queries, layout_queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rounded_goes_by_the_scaled_double(spark):
    values = [0.0, 0.5, 1.000005, 1.015625, 0.1234565, 2.5e-6, 123456.7890125, 3e14, float("inf"), float("nan"), None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", "v", scalar.rounded(F.col("v"), 5).alias("r"))
    for r in rows.collect():
        if r["v"] is None or math.isinf(r["v"]) or r["v"] == 3e14:
            assert r["r"] == r["v"]
        elif math.isnan(r["v"]):
            assert math.isnan(r["r"])
        else:
            assert r["r"] == math.floor(r["v"] * 1e5 + 0.5) / 1e5


def test_association_costs_work_little_for_a_pair(spark):
    """No decimals for a pair, the gate worked out for a track, and frames dealt to a number of tasks that their bytes don't decide."""
    text = plan(frame_queries.association_costs(spark, SF))
    assert "round(" not in text
    below = text[text.index("Join Inner") :]
    assert "AS gate" in below and below.count("RepartitionByExpression [frame") == 2


def moves_by_hand(rows: list, shift: float = 0.386) -> dict:
    """Of each frame after the first: the medians of the fullest bin of displacements, and its support."""
    out, size = {}, shift / 12.0
    frames = sorted({r[0] for r in rows})
    for before, now in zip(frames, frames[1:]):
        bins = {}
        for _, i, x0, y0 in (r for r in rows if r[0] == before):
            for _, j, x1, y1 in (r for r in rows if r[0] == now):
                dx, dy = x1 - x0, y1 - y0
                if abs(dx) <= shift and abs(dy) <= shift:
                    bins.setdefault((round(dx / size), round(dy / size)), []).append(((i, j), dx, dy))
        if bins:
            best = min(bins.values(), key=lambda m: (-len(m), min(p for p, _, _ in m)))
            out[now] = (*(statistics.median(m[k] for m in best) for k in (1, 2)), len(best) / sum(r[0] == before for r in rows))
    return out


def test_camera_vote_takes_places_once(spark):
    """Many points on few places: the same votes, ties and medians as all pairs give, from a hash aggregate over places."""
    rng = random.Random(3)
    rows = [(f, i, rng.choice((0.1, 0.13, 0.3, 0.55, 0.9)) + f % 3 / 50, rng.choice((0.2, 0.24, 0.5, 0.8))) for f in (0, 1, 4, 5, 9) for i in range(1, rng.randint(2, 60))]
    df = spark.createDataFrame([(1, *r) for r in rows], "clip int, frame int, idx int, x double, y double")
    votes = frames.camera_vote(df, "clip")
    got, expected = {r["frame"]: (r["cx"], r["cy"], r["support"]) for r in votes.collect()}, moves_by_hand(rows)
    assert got.keys() == expected.keys() and len(got) == 4
    for f, v in got.items():
        assert all(abs(a - b) < 1e-12 for a, b in zip(v, expected[f]))
    by_bin = re.findall(r"(\w+Aggregate)\(keys?=\[[^]]*\bbx#", votes._jdf.queryExecution().executedPlan().toString())
    assert by_bin and set(by_bin) == {"HashAggregate"}


def labels_by_hand(rows: list) -> dict:
    """(clip, frame, idx) to y and unresolved, each label against all placed before it."""
    boxes, out = {}, {}
    for clip, frame, idx, cx, top, w, h, _ in sorted(rows, key=lambda r: (r[:2], -r[7], r[2])):
        mine = boxes.setdefault((clip, frame), [])
        step = max(1.0, h * layout.NUDGE)
        last = math.floor(h * layout.MAX_NUDGE / step) + 1
        for k in range(last + 1):
            y = top - k * step
            if k == last or not any(cx + w / 2 > a and cx - w / 2 < b and y + h > t and y < t + g for a, b, t, g in mine):
                break
        mine.append((cx - w / 2, cx + w / 2, y, h))
        out[clip, frame, idx] = y, k == last
    return out


def test_labels_move_without_pairs(spark):
    """Crowded frames with sizes of all kinds, one label as wide as the frame; nothing is joined, so what is shuffled is the labels."""
    rng = random.Random(8)
    rows = [(c, f, i, rng.uniform(0, 400), rng.choice((rng.uniform(0, 300), 50.0)), rng.choice((1.0, 30.0, rng.uniform(5, 80))), rng.choice((0.5, 14.0, rng.uniform(1, 40))), float(rng.randint(0, 9))) for c in (0, 1) for f in (3, 4) for i in range(1, 250)]
    rows.append((0, 3, 999, 200.0, 100.0, 2000.0, 14.0, 5.0))
    df = spark.createDataFrame(rows, "clip int, frame int, idx int, cx double, top double, w double, h double, priority double").repartition(5)
    moved = layout.moved_labels(df, ["clip", "frame"])
    assert {(r["clip"], r["frame"], r["idx"]): (r["y"], r["unresolved"]) for r in moved.collect()} == labels_by_hand(rows)
    assert "Join" not in plan(layout_queries.label_collisions(spark, SF))
    odd = layout.moved_labels(df.selectExpr("clip", "frame", "idx", "if(idx = 1, null, cx) AS cx", "top", "w", "h", "priority"), ["clip", "frame"])
    assert {(r["y"], r["unresolved"]) for r in odd.where("idx = 1").collect()} == {(r[4], False) for r in rows if r[2] == 1}
    assert layout.moved_labels(df.where("idx < 0"), ["clip", "frame"]).count() == 0


def test_gated_pairs_are_those_of_the_rules(spark):
    """A crowded frame: the pairs of the rules, for tracks old and new, dealt to a fixed number of tasks and without decimals."""
    rng = random.Random(5)
    t = [(f, i, rng.random(), rng.random(), rng.choice((0.01, 0.05, 0.09)), rng.choice("ab"), rng.choice((None, 3)), rng.randint(1, 9)) for f in (0, 1) for i in range(400)]
    d = [(f, i, rng.random(), rng.random(), rng.choice((0.04, 0.09)), rng.choice("ab"), rng.choice((None, 3))) for f in (0, 1) for i in range(400)]
    tracks = spark.createDataFrame(t, "frame int, trk int, px double, py double, th double, tkit string, tnum int, hits int")
    seen = spark.createDataFrame(d, "frame int, idx int, x double, y double, h double, kit string, num int")
    pairs = frames.gated_pairs(tracks, seen, ["frame"], 0.2)
    expected = set()
    for f, trk, px, py, th, _, _, hits in t:
        gate = min(12.0 * max(th, 0.02), 0.88) * 0.2 + 0.01
        for g, idx, x, y, *_ in d:
            off = math.hypot((x - px) * 16 / 9, y - py) / max(th, 0.02)
            if f == g and math.hypot(x - px, y - py) <= gate and not (hits >= 3 and off > 1.2):
                expected.add((f, trk, idx))
    got = [(r["frame"], r["trk"], r["idx"]) for r in pairs.select("frame", "trk", "idx").collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert "RepartitionByExpression [frame" in plan(pairs)
    assert "round(" not in plan(frame_queries.gate_pairs(spark, SF))


def test_lifetimes_meet_in_a_fixed_number_of_tasks(spark):
    """All pairs that share a moment, once; spans are dealt by key and bucket of time to tasks whose number their bytes don't decide."""
    rng = random.Random(4)
    spans = [(i, rng.choice("ab"), b, b + rng.choice((0, 3, 70))) for i in range(300) for b in [rng.randint(0, 200)]]
    pairs = intervals.overlapping(spark.createDataFrame(spans, "trk int, kit string, f0 int, f1 int"), ["kit"], "trk", "f0", "f1", 60)
    expected = sorted((k, i, j) for i, k, a0, a1 in spans for j, m, b0, b1 in spans if k == m and i < j and a0 <= b1 and b0 <= a1)
    assert sorted(map(tuple, pairs.collect())) == expected
    assert plan(pairs).count("RepartitionByExpression [kit") == 2


def written(df, folder) -> float:
    """Bytes of a row as Parquet."""
    df.write.parquet(str(folder))
    return sum(f.stat().st_size for f in folder.rglob("*.parquet")) / df.sparkSession.read.parquet(str(folder)).count()


def crowd(spark):
    """One frame of 1,500 tracks and as many detections, out of order, on some 300 places, and another of few."""
    rng = random.Random(6)
    place = lambda: (rng.randint(0, 14) / 20, rng.randint(0, 19) / 40)
    many = [1] * 1500 + [2] * 3
    tracks = [(f, i, *place(), rng.choice((0.05, 0.09)), rng.choice("ab"), rng.choice((None, 3)), rng.randint(1, 9)) for i, f in enumerate(many)]
    seen = [(f, i, *place(), rng.choice((0.05, 0.09)), rng.choice("ab"), rng.choice((None, 3))) for i, f in enumerate(many)]
    return (
        spark.createDataFrame(tracks, "frame int, trk int, px double, py double, th double, tkit string, tnum int, hits int"),
        spark.createDataFrame(seen, "frame int, idx int, x double, y double, h double, kit string, num int"),
    )


def test_association_costs_are_small_when_written(spark, tmp_path):
    """All pairs of a frame, each once; pairs that are alike stand together, so a file of them is a fraction of what it is in any other order."""
    pairs = frames.association_costs(*crowd(spark), ["frame"], 0.2)
    assert pairs.count() == pairs.select("frame", "trk", "idx").distinct().count() == 1500 * 1500 + 9
    assert written(pairs.select("trk", "frame", "idx", "dist", "gate", "in_gate", "kit_mul", "num_mul", "h_mul", "cost"), tmp_path / "out") < 1.0


def test_lifetimes_are_small_when_written(spark, tmp_path, monkeypatch):
    """A crowded bucket: all pairs, each once, sides dealt out by parts, names that occur twice or are null; and small as a file, as those alive at once stand together."""
    rng = random.Random(9)
    spans = [(rng.randint(0, 9999) if i % 9 else i, b, min(59, b + rng.choice((0, 0, 0, 5, 30)))) for i in range(2500) for b in [rng.randint(0, 59)]]
    df = spark.createDataFrame([("x", *s) for s in spans] + [("x", None, 3, 5), (None, 1, 3, 5)], "kit string, trk int, f0 int, f1 int")
    for part in (256, intervals.PART):
        monkeypatch.setattr(intervals, "PART", part)
        pairs = intervals.overlapping(df, ["kit"], "trk", "f0", "f1", 60).select("a", "b")
        got = pairs.groupBy().agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        plain = df.alias("l").join(df.alias("r"), F.expr("l.kit = r.kit and l.trk < r.trk and l.f0 <= r.f1 and r.f0 <= l.f1")).select(F.col("l.trk").alias("a"), F.col("r.trk").alias("b"))
        assert got == plain.groupBy().agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first() and got["n"] > 500_000
    assert written(pairs, tmp_path / "out") < 1.0


def test_gated_pairs_are_small_when_written(spark, tmp_path):
    """A crowded frame of few places: the pairs of the rules, each once; those of one place stand together, so a file of them is small."""
    tracks, seen = crowd(spark)
    pairs = frames.gated_pairs(tracks, seen, ["frame"], 0.2).select("trk", "frame", "idx", "dist", "cost")
    d = [r for r in seen.collect() if r["frame"] == 1]
    expected = set()
    for t in (r for r in tracks.collect() if r["frame"] == 1):
        gate, tall = min(12.0 * t["th"], 0.88) * 0.2 + 0.01, 1.2 * t["th"]
        for r in d:
            dx, dy = r["x"] - t["px"], r["y"] - t["py"]
            if math.sqrt(dx * dx + dy * dy) <= gate and not (t["hits"] >= 3 and math.hypot(dx * 16 / 9, dy) > tall):
                expected.add((1, t["trk"], r["idx"]))
    got = [(r["frame"], r["trk"], r["idx"]) for r in pairs.select("frame", "trk", "idx").collect()]
    assert len(got) == len(set(got)) and {g for g in got if g[0] == 1} == expected and len(got) > 50_000
    assert written(pairs, tmp_path / "out") < 3.0
