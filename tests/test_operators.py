"""Worked examples and invariants."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import scalar
from loomspan.operators import boxes, frames, layout, reports, series, tracker, votes
from loomspan.operators.assignment import assign, match_or_leave
from loomspan.plans import box_queries
from loomspan.sources import documents

BOX = "clip int, frame int, idx int, x double, y double, w double, h double, conf double, kit string, num int"


def test_assignment_is_optimal():
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(1, 6))
        m = int(r.integers(n, 7))
        cost = r.random((n, m)).round(2)
        got = assign(cost)
        assert len(set(got.tolist())) == n
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert abs(cost[np.arange(n), got].sum() - best) < 1e-9


def test_leaving_alone_is_cheaper_than_a_bad_pair():
    cost = np.array([[0.0373, 0.4061], [1e6, 0.4]])
    assert match_or_leave(cost, np.array([0.2, 0.2]), np.array([0.2, 0.2])) == [(0, 0)]
    assert match_or_leave(np.zeros((0, 3)), np.zeros(0), np.zeros(3)) == []


def test_groups_are_solved_apart():
    """The groups together cost what one large assignment costs."""
    from loomspan.operators.assignment import _solved

    r = np.random.default_rng(3)
    for _ in range(60):
        n, m = int(r.integers(1, 12)), int(r.integers(1, 12))
        cost = np.where(r.random((n, m)) < 0.25, r.random((n, m)), 1e6)
        rows, cols = r.random(n), r.random(m)
        price = lambda pairs: sum(cost[p] for p in pairs) + rows.sum() + cols.sum() - sum(rows[i] + cols[j] for i, j in pairs)  # noqa: B023, E731
        got = match_or_leave(cost, rows, cols)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and all(cost[p] < 1e5 for p in got)
        assert abs(price(got) - price(_solved(cost, rows, cols, 1e5))) < 1e-9


def brute_nms(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[5], r[0])):
        def iou(q):
            w = min(r[1] + r[3], q[1] + q[3]) - max(r[1], q[1])
            h = min(r[2] + r[4], q[2] + q[4]) - max(r[2], q[2])
            inter = max(w, 0) * max(h, 0)
            return inter / (r[3] * r[4] + q[3] * q[4] - inter)
        if all(iou(q) <= 0.45 for q in kept):
            kept.append(r)
    return {r[0] for r in kept}


def test_suppression_matches_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(0, f, i, *map(float, r.random(2)), 0.3, 0.3, float(r.integers(1, 4) / 4), "a", None) for f in range(12) for i in range(1, 12)]
    got = boxes.deduped(spark.createDataFrame(rows, BOX), ["clip", "frame"]).toPandas()
    for f in range(12):
        assert set(got[got.frame == f].idx) == brute_nms([(x[2], *x[3:8]) for x in rows if x[1] == f])


def test_validation_and_repetition(spark):
    good = [(0, 0, i, 0.1 * i, 0.2, 0.05, 0.1, 1.0, "a", None) for i in range(1, 6)]
    off = [(0, 1, 1, 945.0, 0.2, 0.05, 0.1, 1.0, "a", None), (0, 1, 2, 0.2, 0.2, 0.05, 0.1, 1.0, "a", None)]
    ribbon = [(0, 0, 6, 0.1, 0.2, 0.316, 0.1, 1.0, "a", None)]
    same = [(0, 2, i, 0.4, 0.4, 0.05, 0.1, 1.0, "a", None) for i in range(15)]
    df = spark.createDataFrame(good + off + ribbon + same, BOX)
    c = {r["frame"]: r for r in boxes.frame_counts(df, ["clip", "frame"]).collect()}
    assert (c[0]["dropped"], c[0]["wide"], c[0]["frame_rejected"]) == (1, 1, False)
    assert (c[1]["dropped"], c[1]["frame_rejected"]) == (1, True)
    assert {r["frame"] for r in boxes.valid(df, ["clip", "frame"]).collect()} == {0, 2}
    assert [r["frame"] for r in boxes.degenerate(df, ["clip", "frame"]).collect()] == [2]


def test_number_needs_two_readings(spark):
    rows = [(0, i, 1, 0.0, 0.0, 1.0, 1.0, 0.98 if i == 0 else 0.7, "a", 7 if i == 0 else 9) for i in range(3)]
    got = votes.number_vote(spark.createDataFrame(rows, BOX), ["clip"]).first()
    assert (got["num"], got["times"]) == (9, 2)
    assert votes.number_vote(spark.createDataFrame(rows[:1], BOX), ["clip"]).first()["num"] is None


def test_ties_go_to_the_first_seen(spark):
    rows = [(0, i, 1, 0.0, 0.0, 1.0, 1.0, 1.0, k, None) for i, k in enumerate(["b", "a", "a", "b"])]
    assert votes.mode_vote(spark.createDataFrame(rows, BOX), ["clip"], "kit", "frame").first()["kit"] == "b"


SERIES = "k int, frame int, x double, y double, w double, h double"


def walk(*points):
    return [(1, f, float(x), float(y), 0.05, 0.1) for f, x, y in points]


def test_round_trip_with_a_missing_return(spark):
    rows = walk((0, 0.50, 0.5), (1, 0.51, 0.5), (2, 0.60, 0.5), (4, 0.52, 0.5), (5, 0.53, 0.5))
    got = series.without_round_trips(spark.createDataFrame(rows, SERIES), ["k"]).toPandas()
    assert sorted(got.frame) == [0, 1, 4, 5]
    two = series.without_round_trips(spark.createDataFrame(rows[:2], SERIES), ["k"]).count()
    assert two == 2


def test_smoothing_is_not_recursive(spark):
    rows = walk((0, 0, 0), (1, 1, 0), (2, 3, 0), (3, 6, 0))
    got = series.smoothed(spark.createDataFrame(rows, SERIES), ["k"], max_gap=5, curve=9.0).orderBy("frame").toPandas()
    assert got.x.tolist() == [0.0, 1.25, 3.25, 6.0]


def test_grid_holds_the_last_step(spark):
    rows = walk((0, 0.0, 0.0), (4, 0.4, 0.8))
    s = series.segmented(spark.createDataFrame(rows, SERIES), ["k"], 10, 4, 9.0)
    got = series.on_grid(s, ["k", "seg"], 3, 6).orderBy("frame").toPandas()
    assert got.frame.tolist() == [0, 1, 2, 3, 4, 5]
    assert np.allclose(got.x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.4])


def test_debounce_keeps_the_strongest(spark):
    s = spark.createDataFrame([(0, 642, 2.6, 2), (0, 648, 3.1, 3), (0, 652, 2.7, 2), (0, 700, 2.5, 2)], "clip int, frame int, n_ratio double, signals int")
    got = frames.debounced(s, "clip", within=15).orderBy("frame").toPandas()
    assert got.frame.tolist() == [648, 700]


def test_possession_holds(spark):
    rows = [(0, f, p, [1, 2]) for f, p in enumerate([1, 2, 1, 2, 2, 2, None, 2])] + [(0, 8, None, [1])]
    df = spark.createDataFrame(rows, "clip int, frame int, pick long, present array<long>")
    got = frames.possession_hold(df, "clip", "frame", 3).orderBy("frame").toPandas().holder.tolist()
    assert [None if x != x else int(x) for x in got] == [1, 1, 1, 1, 1, 2, 2, 2, None]


def test_identities_share_and_contest(spark):
    t = spark.createDataFrame([(0, 1, "red", 7, 0, 10), (0, 2, "red", 7, 11, 20), (0, 3, "red", 7, 5, 15), (0, 4, "blue", None, 3, 9)], "clip int, trk long, kit string, num int, f0 int, f1 int")
    teams = spark.createDataFrame([(0, "red", "A")], "clip int, kit string, team string")
    got = {r["trk"]: (r["identity"], r["number_source"]) for r in votes.stitched(t, teams, ["clip"]).collect()}
    assert got == {1: ("A7", "read"), 2: ("A7", "read"), 3: ("A7^1", "contested"), 4: ("?·4", "fallback")}


def test_labels_make_room(spark):
    rows = [(0, i, 100.0, 50.0, 40.0, 10.0, float(10 - i)) for i in range(3)]
    got = layout.moved_labels(spark.createDataFrame(rows, "frame int, idx int, cx double, top double, w double, h double, priority double"), ["frame"]).orderBy("idx").toPandas()
    assert got.y.tolist() == [50.0, 35.0, 20.0] and not got.unresolved.any()


@pytest.mark.parametrize(("n", "label"), [(0, "I"), (3, "IV"), (8, "IX"), (1993, "MCMXCIV"), (3998, "MMMCMXCIX"), (3999, None), (18277, None), (18278, None), (475254, None), (2**40, None)])
def test_roman(spark, n, label):
    if n > 3998:
        label, m = "", n
        while m >= 0:
            label, m = chr(97 + m % 26) + label, m // 26 - 1
    assert spark.range(1).select(scalar.roman(F.lit(n)).alias("r")).first()["r"] == label


def test_roman_label_of_any_key(spark, tmp_path):
    """A key of 64 bits has its label, whose letters don't end where four are used up, and null has none."""
    keys = [0, 475253, 475254, 12356629, 12356630, 2**31 - 1, 2**31, 2**53 + 1, 25 * 10**17 + 7, 2**63 - 1, None, None]
    spark.createDataFrame([(k,) for k in keys], "l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {None: None, 0: "I"}
    for k in keys[1:-2]:
        label, m = "", k
        while m >= 0:
            label, m = chr(97 + m % 26) + label, m // 26 - 1
        want[k] = label
    got = box_queries.roman_label(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r["n"]: r["label"] for r in got} == want


def test_tracker_keeps_two_walkers_apart(spark):
    rows = []
    for f in range(30):
        for i, (x, kit) in enumerate([(0.2 + 0.01 * f, "red"), (0.5 - 0.01 * f, "blue")]):
            rows.append((0, f, i, x, 0.5, 0.04, 0.12, 0.9, kit, 7 if kit == "red" else None))
    got = tracker.track_clips(spark.createDataFrame(rows, BOX)).toPandas()
    assert got.groupby("trk").size().tolist() == [30, 30]
    assert got.groupby("trk").kit.nunique().tolist() == [1, 1]
    assert got[got.kit == "red"].num.iloc[0] == 7
    assert not got.duplicated(["trk", "frame"]).any()


def test_unsure_detections_begin_no_track(spark):
    rows = [(0, f, 1, 0.5, 0.5, 0.04, 0.12, 0.3, "red", None) for f in range(6)]
    assert tracker.track_clips(spark.createDataFrame(rows, BOX)).count() == 0


def test_unknown_convention_is_an_error(spark):
    rows = spark.createDataFrame([(9, 1.0, 1.0, 1.0, 1.0, 10.0, 10.0)], "model int, x double, y double, w double, h double, iw double, ih double")
    known = spark.createDataFrame([(0, "pixel")], "model int, convention string")
    with pytest.raises(Exception, match="no coordinate convention"):
        boxes.to_fractions(rows, known, "model").collect()


def test_unpinned_and_spec(spark):
    s = spark.createDataFrame([("m:v2",), ("m",), (":v1",), ("m:v9",)], "spec string")
    got = reports.parsed_spec(s, "spec", ["v1", "v2"]).toPandas()
    assert got.problem.fillna("").tolist() == ["", "", "no model", "unknown version"]


def test_documents_of_different_ages(spark, tmp_path):
    old = {"clip": "c", "tag": "old", "fps": 5, "frames": [{"frame": 0, "scene": "s", "kits": [{"colour": "red", "accent": None}], "players": [{"x": 0.1, "y": 0.1, "w": 0.1, "h": 0.2, "kit": " Red ", "num": None}], "ball": None}], "dropped": [{"frame": 6, "error": "timeout: 30"}]}
    empty = {"clip": "c", "tag": "none", "frames": [], "dropped": []}
    for name, doc in (("old", old), ("none", empty)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    runs = documents.read_detections(spark, str(tmp_path))
    facts = {r["tag"]: r for r in documents.run_table(runs).collect()}
    assert (facts["old"]["n_frames"], facts["none"]["n_frames"], facts["none"]["fps"]) == (1, 0, 10)
    player = documents.player_table(runs).collect()
    assert [(p["kit"], p["conf"], p["idx"]) for p in player] == [("red", 1.0, 1)]
    assert documents.ball_table(runs).count() == 0
    assert documents.dropped_table(runs).first()["error"] == "timeout: 30"


def test_logs_and_sinks(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"stage":"detect","ok":true,"cost_usd":0.1}\n\n{"stage":"detect","ok":false,"error":"http: 500"}\n')
    assert documents.read_call_log(spark, str(tmp_path / "log.jsonl")).count() == 2
    rows = spark.createDataFrame([("c", "t", "A", 0, 1, 0.1, 0.1, 0.1, 0.2, "red", None, 1.0)], "clip string, tag string, arm string, frame int, idx int, x double, y double, w double, h double, kit string, num int, conf double")
    documents.write_detections(rows, str(tmp_path / "d"))
    documents.write_arms(rows, str(tmp_path / "a"))
    documents.append_log(rows, str(tmp_path / "l"))
    documents.append_log(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    assert (tmp_path / "a" / "arm=A").is_dir()
    assert documents.nested_frames(rows).first()["frames"][0]["players"][0]["kit"] == "red"
    with pytest.raises(ValueError):
        documents.rewritten(rows, str(tmp_path / "d"), str(tmp_path / "d"))
    (tmp_path / "i.bin").write_bytes(b"abc")
    assert documents.encoded_images(spark, str(tmp_path / "i.bin")).first()["payload"] == "YWJj"


def test_repeated_boxes_are_passed_over(spark):
    """A frame that is one box fifteen times is no cut: tracks coast over it."""
    rows = []
    for f in range(20):
        if f == 10:
            rows += [(0, f, i, 0.8, 0.8, 0.05, 0.1, 0.9, "red", None) for i in range(15)]
        else:
            rows += [(0, f, i, 0.1 + 0.15 * i, 0.5, 0.04, 0.12, 0.9, "red", None) for i in range(6)]
    df = spark.createDataFrame(rows, BOX)
    marked = boxes.deduped(df, ["clip", "frame"], carry=("kit", "num"), mark=True)
    got = tracker.track_clips(marked).toPandas()
    assert got.trk.nunique() == 6 and (got.groupby("trk").size() == 19).all()
    plain = tracker.track_clips(boxes.deduped(df, ["clip", "frame"], carry=("kit", "num"))).toPandas()
    assert plain.trk.nunique() > 6


def test_spacing_narrows_the_gate(spark):
    rows = [(0, f, i, 0.1 + 0.15 * i + (0.02 * f if i == 5 else 0.0), 0.5, 0.04, 0.12, 0.9, "red", None) for f in range(8) for i in range(6)]
    df = spark.createDataFrame(rows, BOX)
    wide = tracker.track_clips(df).toPandas()
    narrow = tracker.track_clips(df.withColumn("spacing", F.lit(0.01))).toPandas()
    assert wide.trk.nunique() == 6 and narrow.trk.nunique() == 5


def test_refusals(spark):
    used = spark.createDataFrame([("a",), ("b",)], "model string")
    pins = spark.createDataFrame([("a",)], "model string")
    assert reports.all_pinned(used.limit(1), pins, "model").count() == 1
    with pytest.raises(Exception, match="b has no pinned coordinate convention"):
        reports.all_pinned(used, pins, "model").collect()
    with pytest.raises(Exception, match="unknown version"):
        reports.parsed_spec(spark.createDataFrame([("m:v9",)], "spec string"), "spec", ["v1"], refuse=True).collect()


def test_ball_off_the_scale(spark):
    rows = [(0, 0.5, 0.5, 0.01, 0.01), (1, 945.0, 0.5, 0.01, 0.01), (2, 0.5, None, 0.01, 0.01), (3, 0.5, 0.5, None, None), (4, None, None, None, None)]
    got = boxes.ball_in_range(spark.createDataFrame(rows, "frame int, x double, y double, w double, h double")).orderBy("frame").collect()
    assert [(r["x"] is not None, r["ball_dropped"]) for r in got] == [(True, False), (False, True), (False, True), (True, False), (False, False)]


def test_track_documents_are_read_back(spark, tmp_path):
    players = spark.createDataFrame([("c", f, t, f"p{t}", 0.1 * t, 0.5, 0.05, 0.1) for f in range(3) for t in (2, 1)] + [("d", 0, 1, "p1", 0.1, 0.5, 0.05, 0.1)], "clip string, frame int, track int, id string, x double, y double, w double, h double")
    runs = spark.createDataFrame([("c", "m", "t", 10, 30, 3), ("d", "m", "t", 10, 30, 1)], "clip string, model string, tag string, fps_sampled int, source_fps int, n_frames int")
    cuts = spark.createDataFrame([("c", 2, 0.6, 5)], "clip string, frame int, h_ratio double, d_n int")
    ids = spark.createDataFrame([("c", "p1", "A", "red", "7", "read")], "clip string, id string, team string, kit string, number string, number_source string")
    balls = spark.createDataFrame([("c", 1, 0.5, 0.5, 0.01, 0.01), ("c", 7, 0.4, 0.5, 0.01, 0.01)], "clip string, frame int, x double, y double, w double, h double")
    docs = documents.track_documents(runs, players, cuts, ids, balls)
    documents.write_tracks(docs.repartition(1), str(tmp_path / "t"))
    got = {r["clip"]: r for r in documents.read_tracks(spark, str(tmp_path / "t")).collect()}
    assert set(got) == {"c", "d"} and got["c"]["n_frames"] == 3
    assert [(f["frame"], [p["track"] for p in f["players"] or []]) for f in got["c"]["frames"]] == [(0, [1, 2]), (1, [1, 2]), (2, [1, 2]), (7, [])]
    assert got["c"]["frames"][1]["ball"]["x"] == 0.5 and got["c"]["cuts"][0]["frame"] == 2
    assert got["c"]["identities"]["p1"]["number"] == "7"


def test_cost_sink_and_catalogue_source(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 1, 2, 0.1)], "clip int, trk int, idx int, cost double")
    documents.write_costs(pairs, str(tmp_path / "costs"), "clip")
    assert spark.read.json(str(tmp_path / "costs")).first()["cost"] == 0.1
    (tmp_path / "models.json").write_text(json.dumps({"data": [{"id": "m", "name": "n", "created": 1, "architecture": {"input_modalities": ["text", "image"]}, "pricing": {"prompt": "0.000001", "completion": "n/a"}, "supported_parameters": ["tools", "reasoning"], "top_provider": {"context_length": 9}}, {"id": "bare"}]}, indent=1))
    got = {r["id"]: r for r in reports.flattened(documents.read_catalogue(spark, str(tmp_path / "models.json"))).collect()}
    assert (got["m"]["modalities"], got["m"]["in_per_m"], got["m"]["out_per_m"], got["m"]["context"], got["m"]["tools"], got["m"]["reasoning"]) == (["text", "image"], 1.0, 0.0, 9, True, True)
    assert (got["bare"]["modalities"], got["bare"]["structured"], got["bare"]["per_image"]) == ([], False, None)


def test_last_frame_comes_from_the_data(spark):
    rows = [(1, 790, 0.1, 0.1, 0.05, 0.1), (1, 795, 0.2, 0.1, 0.05, 0.1), (2, 796, 0.2, 0.1, 0.05, 0.1)]
    s = series.segmented(spark.createDataFrame(rows, SERIES), ["k"], 10, 4, 9.0)
    got = series.on_grid(s, ["k", "seg"], 3)
    assert sorted(r["frame"] for r in got.collect()) == list(range(790, 797))


def test_ball_filters_by_hand(spark):
    """Frames 2 apart at 2 fps: a second each; scales of 0.05 make a jump 0.0595 and a gate 0.715 a second."""
    flat = [(f, 0.30 + 0.001 * f, 0.5, 0.9) for f in range(0, 10, 2)]
    decoy = [*flat[:2], (4, 0.95, 0.5, 0.9), *flat[3:]]  # out and back at once
    bounce = [*flat[:2], (4, 0.302, 0.62, 0.9), *flat[3:]]  # up and down again, slowly enough
    away = [*flat[:3], (6, 0.99, 0.99, 0.2), (8, 0.99, 0.98, 0.2)]  # too fast for how sure they are, and no way back
    expected = {"flat": [0, 2, 4, 6, 8], "decoy": [0, 2, 6, 8], "bounce": [0, 2, 4, 6, 8], "unknown": [0, 2, 6, 8], "away": [0, 2, 4, 8], "one": [0]}
    cases = {"flat": flat, "decoy": decoy, "bounce": bounce, "away": away, "unknown": decoy, "one": flat[:1]}
    rows = [(c, f, x, y, 0.01, 0.01, conf, None if c == "unknown" else 0.05) for c, some in cases.items() for f, x, y, conf in some]
    df = spark.createDataFrame(rows, "clip string, frame int, x double, y double, w double, h double, conf double, scale double").repartition(3)
    got = series.ball_fixed_point(df, "clip", 2.0, 2).collect()
    assert {c: sorted(r["frame"] for r in got if r["clip"] == c) for c in cases} == expected


def test_ball_passes_agree_with_the_plain_version(spark):
    from tests.plain import filter_pass

    r = np.random.default_rng(5)
    rows = [(k, int(f), *r.random(2).tolist(), 0.01, 0.01, float(r.random()), None if r.random() < 0.2 else float(r.random() * 0.2)) for k in range(12) for f in np.sort(r.choice(200, int(r.integers(1, 90)), replace=False))]
    rows = [(k, f, 0.5 + (x - 0.5) * (0.05 if f % 5 else 1), 0.5 + (y - 0.5) * 0.1, *rest) for k, f, x, y, *rest in rows]
    df = spark.createDataFrame(rows, "clip int, frame int, x double, y double, w double, h double, conf double, scale double")
    got = {(x["clip"], x["frame"]) for x in series.ball_fixed_point(df, "clip", 10.0, 3).collect()}
    expected = set()
    for k in range(12):
        left, scale = [(f, x, y, c) for i, f, x, y, _, _, c, _ in rows if i == k], {f: s for i, f, *_, s in rows if i == k}
        for _ in range(4):
            left = filter_pass(left, scale, 10.0, 3)
        expected |= {(k, x[0]) for x in left}
    assert got == expected and len(got) < len(rows)


def test_ball_centres_and_corrected_rows(spark, tmp_path):
    doc = {"clip": "c", "tag": "t", "frames": [{"frame": 3, "players": [], "ball": {"x": 0.2, "y": 0.4, "w": 0.02, "h": 0.04}}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    runs = documents.read_detections(spark, str(tmp_path / "d.json"))
    b = documents.ball_table(runs).first()
    assert (round(b["x"], 9), round(b["y"], 9), b["conf"], b["frame"]) == (0.21, 0.42, 1.0, 3)
    rows = spark.createDataFrame([("c", 1)], "clip string, frame int")
    rows.write.parquet(str(tmp_path / "old"))
    assert documents.rewritten(rows.withColumn("frame", F.lit(2)), str(tmp_path / "old"), str(tmp_path / "new")) == str(tmp_path / "new")
    assert spark.read.parquet(str(tmp_path / "old")).first()["frame"] == 1 and spark.read.parquet(str(tmp_path / "new")).first()["frame"] == 2
