"""The association against a plain version of its rules, and its pieces against one pass."""

import math

import numpy as np
import pytest

from loomspan.operators import tracker
from loomspan.operators.assignment import assign

BOX = "clip int, frame int, idx int, x double, y double, w double, h double, conf double, kit string, num int, degenerate boolean"


def scene(seed: int, shots: list[int], players: int, clip: int = 0, few: bool = False) -> list[tuple]:
    """Walkers in shots of so many frames each; between shots their number, size and kits change."""
    r = np.random.default_rng(seed)
    rows, frame = [], 0
    for shot, length in enumerate(shots):
        n = players if not few else int(r.integers(1, 4))
        n = n if shot % 2 == 0 else max(1, n // 3)
        size = 0.2 if shot % 2 == 0 else 0.4
        at, speed = r.random((n, 2)) * 0.6 + 0.1, r.normal(0, 0.004, (n, 2))
        kits = [("red", "blue", "green")[int(r.integers(0, 3)) if shot % 2 else k % 2] for k in range(n)]
        for f in range(length):
            at += speed + np.array([0.01 * (f % 5 == 4), 0])
            order = r.permutation(n)
            idx = 0
            for k in order.tolist():
                if r.random() < 0.12:
                    continue
                idx += 1
                h = size * (0.8 + 0.1 * (k % 4)) * r.normal(1, 0.03)
                kit = kits[k] if r.random() < 0.9 else "blue"
                rows.append((clip, frame + f, idx, *(at[k] + r.normal(0, 0.003, 2)).tolist(), 0.05, float(h), float(np.clip(r.normal(0.7, 0.25), 0.05, 1)), kit, int(k) if r.random() < 0.5 else None, False))
            if f % 11 == 7:  # a frame that says nothing
                rows = [x if x[1] != frame + f else (*x[:-1], True) for x in rows]
        frame += length + (3 if shot % 3 == 2 else 0)
    return rows


def gate(h, dt, spacing=None):
    g = min(12 * max(h, 0.02), 0.88) * dt + 0.01
    return min(g, 1.5 * spacing) if spacing else g


class Track:
    def __init__(self, ident, d, t):
        self.id, self.x = ident, np.array([d["fx"], d["fy"], 0, 0, d["w"], d["h"]], float)
        self.P = np.diag([1e-3, 1e-3, 1e-2, 1e-2, 1e-4, 1e-4])
        self.hits, self.kits, self.weight, self.times, self.obs = 0, {}, {}, {}, []
        self.take(d, t)

    def take(self, d, t):
        self.hits += 1
        self.kits[d["kit"]] = self.kits.get(d["kit"], 0) + 1
        if d["num"] is not None:
            self.weight[d["num"]] = self.weight.get(d["num"], 0.0) + d["conf"]
            self.times[d["num"]] = self.times.get(d["num"], 0) + 1
        self.obs.append((d["frame"], d["fx"], d["fy"], self.x[4], self.x[5]))
        self.last = t

    @property
    def kit(self):
        return max(self.kits, key=self.kits.get)

    @property
    def number(self):
        if not self.weight:
            return None
        n = max(self.weight, key=self.weight.get)
        return n if self.weight[n] >= 1.2 and self.times[n] >= 2 else None

    def predict(self, dt):
        move = np.eye(6)
        move[0, 2] = move[1, 3] = dt
        q = (self.x[5] * dt) ** 2
        self.x, self.P = move @ self.x, move @ self.P @ move.T + np.diag([q / 4, q / 4, 4 * q, 4 * q, 0.1225 * q, 0.1225 * q])
        return self.x[:2].copy()

    def update(self, d):
        H = np.zeros((4, 6))
        H[[0, 1, 2, 3], [0, 1, 4, 5]] = 1
        p, s = (0.06 * d["h"] / max(d["conf"], 0.15)) ** 2, (0.18 * d["h"]) ** 2
        K = self.P @ H.T @ np.linalg.inv(H @ self.P @ H.T + np.diag([p, p, s, s]))
        self.x = self.x + K @ (np.array([d["fx"], d["fy"], d["w"], d["h"]]) - H @ self.x)
        self.P = (np.eye(6) - K @ H) @ self.P


def plain(rows, fps=10.0):
    """Track by track and detection by detection: (observations, cuts, health, priced pairs that were taken, births)."""
    frames = {}
    for r in rows:
        frames.setdefault(r[1], []).append(dict(zip("clip frame idx x y w h conf kit num degenerate".split(), r)) | {"fx": r[3] + r[5] / 2, "fy": r[4] + r[6]})
    counts = {}
    for f in sorted(frames):
        for d in sorted(frames[f], key=lambda d: d["idx"]):
            counts[d["kit"]] = counts.get(d["kit"], 0) + 1
    team = {k: n for n, k in enumerate(sorted(counts, key=lambda k: -counts[k])[:2])}
    alive, finished, cuts, health, taken, births = [], [], [], [], [], []
    before, prev_t, count = None, None, 0

    def match(tracks, preds, dets, dt, cam, stage):
        if not tracks or not dets:
            return []
        n, m = len(tracks), len(dets)
        big = np.full((n + m, m + n), 1e6)
        for i, t in enumerate(tracks):
            px, py = preds[i] + np.array(cam)
            for j, d in enumerate(dets):
                dist = math.hypot(d["fx"] - px, d["fy"] - py)
                if dist > gate(t.x[5], dt) or t.hits >= 3 and math.hypot((d["fx"] - px) * 16 / 9, d["fy"] - py) / max(t.x[5], 0.02) > 1.2:
                    continue
                a, b = team.get(t.kit), team.get(d["kit"])
                c = dist * (4.0 if a is not None and b is not None and a != b else 1) * (0.55 if t.number is not None and d["num"] == t.number else 1)
                big[i, j] = c * (1 + 0.5 * (max(t.x[5], d["h"]) / max(min(t.x[5], d["h"]), 1e-4) - 1))
            big[i, m + i] = 2.5 * gate(t.x[5], dt)
        for j, d in enumerate(dets):
            big[n + j, j] = 2.5 * gate(d["h"], dt)
        big[n:, m:] = 0
        got = assign(big)
        pairs = [(i, int(got[i])) for i in range(n) if got[i] < m and big[i, got[i]] < 1e5]
        taken.extend((dets[j]["frame"], stage, tracks[i].id, dets[j]["idx"]) for i, j in pairs)
        return pairs

    for f in sorted(frames):
        dets, t = sorted(frames[f], key=lambda d: d["idx"]), f / fps
        dt = max(t - prev_t if prev_t is not None else 1 / fps, 1e-3)
        prev_t = t
        preds = [x.predict(dt) for x in alive]
        if dets[0]["degenerate"]:
            continue
        med, n, kits = float(np.median([d["h"] for d in dets])), len(dets), {}
        for d in dets:
            kits[d["kit"]] = kits.get(d["kit"], 0) + 1
        if before:
            ratio = max(n, before[1]) / min(n, before[1])
            l1 = round(sum(abs(before[2].get(k, 0) / before[1] - kits.get(k, 0) / n) for k in {*kits, *before[2]}), 9)
            signals = (max(len(alive), n) >= 4 and (abs(med - before[0]) / before[0] > 0.5 or abs(n - before[1]) >= 5)) + (ratio >= 2.5) + (l1 > 0.9)
            recent = cuts and f - cuts[-1][0] < 0.5 * fps
            if signals >= 2 and (not recent or ratio > cuts[-1][1]):
                if recent:
                    cuts.pop()
                cuts.append((f, ratio))
                finished += [x for x in alive if x.hits >= 3]
                alive, preds = [], []
        before = (med, n, kits)
        most, bins = 12 * 0.14 * dt + 0.05, {}
        for p in preds:
            for d in dets:
                dx, dy = d["fx"] - p[0], d["fy"] - p[1]
                if abs(dx) <= most and abs(dy) <= most:
                    bins.setdefault((round(dx / (most / 12)), round(dy / (most / 12))), []).append((dx, dy))
        best = max(bins.values(), key=len) if bins else []
        cam = tuple(np.median(best, axis=0)) if preds and len(best) / len(preds) >= 0.5 else (0.0, 0.0)
        hi, lo = [d for d in dets if d["conf"] >= 0.5], [d for d in dets if d["conf"] < 0.5]
        pairs = match(alive, preds, hi, dt, cam, "hi")
        off = []
        for i, j in pairs:
            x, d = alive[i], hi[j]
            off.append((d["fx"] - preds[i][0], d["fy"] - preds[i][1]))
            if t - x.last > 0.25:
                x.x[2:4] = (np.array([d["fx"], d["fy"]]) - x.x[:2]) / (t - x.last)
                x.x[:2] = d["fx"], d["fy"]
            x.update(d)
            x.take(d, t)
        rest = [i for i in range(len(alive)) if i not in {p[0] for p in pairs}]
        second = match([alive[i] for i in rest], [preds[i] for i in rest], lo, dt, cam, "lo")
        for i, j in second:
            alive[rest[i]].update(lo[j])
            alive[rest[i]].take(lo[j], t)
        rest = [i for k, i in enumerate(rest) if k not in {p[0] for p in second}]
        new = [d for j, d in enumerate(hi) if j not in {p[1] for p in pairs}]
        if alive:
            cam = tuple(np.median(off, axis=0)) if len(off) >= 3 else (cam[0] / 2, cam[1] / 2)
            missed = blocked = 0
            for i in rest:
                near = [d for d in hi if math.hypot(d["fx"] - preds[i][0] - cam[0], d["fy"] - preds[i][1] - cam[1]) <= gate(alive[i].x[5], dt)]
                a = team.get(alive[i].kit)
                missed += not near
                blocked += bool(near) and all(a is not None and team.get(d["kit"]) is not None and team[d["kit"]] != a for d in near)
            health.append((f, len(pairs) / len(alive), len(new), blocked, missed))
        for i in rest:
            alive[i].x[2:4] *= 0.72
        for d in new:
            count += 1
            alive.append(Track(count, d, t))
            births.append((f, count, d["idx"]))
        keep = []
        for x in alive:
            if t > x.last and not all(-0.015 <= c <= 1.015 for c in x.x[:2]) or t - x.last > 0.6:
                finished += [x] if x.hits >= 3 else []
            else:
                keep.append(x)
        alive = keep
    finished += [x for x in alive if x.hits >= 3]
    return [(x.id, *o, x.kit, x.number, k) for k, x in enumerate(finished) for o in x.obs], cuts, health, taken, births


CASES = {"cuts": scene(1, [14, 9, 20, 6, 3, 12], 9), "none": scene(2, [40], 7), "few": scene(3, [6, 5, 7, 4, 9, 3, 8], 3, few=True), "many": scene(4, [3] * 14, 12)}


@pytest.mark.parametrize("case", sorted(CASES))
@pytest.mark.parametrize("pieces", [True, False])
def test_agrees_with_the_plain_version(spark, case, pieces):
    rows = CASES[case]
    a = tracker.associate(spark.createDataFrame(rows, BOX).repartition(3), settings=tracker.Settings(audit="near"), pieces=pieces)
    observations, cuts, health, taken, births = plain(rows)
    got = sorted(tuple(r) for r in a.observations.select("trk", "frame", "x", "y", "w", "h", "kit", "num", "ended").collect())
    expected = sorted(observations)
    assert [(*r[:2], *r[6:]) for r in got] == [(*r[:2], *r[6:]) for r in expected] and len(got) > 30
    np.testing.assert_allclose([r[2:6] for r in got], [r[2:6] for r in expected], rtol=1e-9, atol=1e-12)
    assert sorted((r["frame"], round(r["n_ratio"], 9)) for r in a.cuts.collect()) == [(f, round(x, 9)) for f, x in cuts]
    assert sorted(tuple(r) for r in a.health.select("frame", "rate", "births", "kit_blocked", "gate_missed").collect()) == health
    pairs = a.pairs.collect()
    assert sorted((r["frame"], r["stage"], r["trk"], r["idx"]) for r in pairs if r["taken"]) == sorted(taken)
    assert sorted((r["frame"], r["trk"], r["idx"]) for r in pairs if r["stage"] == "birth") == births
    by = {r[:2] for r in got}
    assert by <= {(r["trk"], r["frame"]) for r in pairs if r["taken"] or r["stage"] == "birth"}
    for r in pairs:
        if r["cost"] is not None:
            assert abs(r["cost"] - r["dist"] * r["kit_mul"] * r["num_mul"] * r["h_mul"]) < 1e-12 and r["in_gate"] and r["tr_kit"] in dict(r["tr_kit_votes"])
    if pieces and case in ("cuts", "many"):
        assert a.pieces.count() > 1


def test_borders_that_are_no_cuts_go(spark):
    """A change of size and kits among few boxes is a cut only while tracks are many, which facts of frames can't tell."""
    rows = []
    for f in range(30):
        big = f // 6 % 2
        rows += [(0, f, k, 0.2 + 0.3 * k, 0.3, 0.05, 0.4 if big else 0.15, 0.9, "red" if big else "blue", None, False) for k in range(1, 3)]
    df = spark.createDataFrame(rows, BOX)
    border = tracker._facts(df, tracker.Settings()).where("may_cut").count()
    a, one = tracker.associate(df), tracker.associate(df, pieces=False)
    assert border == 4 and a.pieces.count() == 1 and a.cuts.collect() == one.cuts.collect() != []
    assert sorted(map(str, a.observations.collect())) == sorted(map(str, one.observations.collect()))


def test_clips_of_all_kinds_together(spark):
    rows = [(k, *r[1:]) for k, case in enumerate(sorted(CASES)) for r in CASES[case]]
    rows += [(9, 0, 1, 0.1, 0.1, 0.1, 0.1, 0.1, None, None, False)]
    df = spark.createDataFrame(rows, BOX)
    a, one = tracker.associate(df), tracker.associate(df, pieces=False)
    for part in ("observations", "cuts", "camera", "health"):
        assert sorted(map(str, getattr(a, part).collect())) == sorted(map(str, getattr(one, part).collect()))
    assert a.pieces.count() > 4 + 1
    none = df.where("false")
    assert tracker.associate(none).observations.count() == 0 and tracker.associate(none, pieces=False).health.count() == 0


def test_frames_without_detections_move_the_clock(spark):
    rows = [(0, f, 1, 0.3, 0.3, 0.05, 0.2, 0.9, "red", None, False) for f in (0, 1, 2)]
    df = spark.createDataFrame(rows + [(0, f, *[None] * 8, False) for f in range(3, 12)] + [(0, 12, *rows[0][2:])], BOX)
    got = tracker.associate(df).observations.collect()
    assert sorted(r["frame"] for r in got) == [0, 1, 2]  # the track ended before the last sighting
