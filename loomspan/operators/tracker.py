"""Association of detections into tracks, with all that it finds out on its way.

A track's expected place depends on all that it was given before, so a clip is worked in order. But where a shot ends every track
does too, and what comes after starts from nothing. So a clip is cut into pieces where the facts of its frames say that a
cut may be, the pieces are tracked apart (``applyInArrow``, one group a piece), and then each border is looked at once more
with what the piece before it really left: how many tracks were alive, and when the last cut was. A border that proves to
be no cut goes, and the piece before it is tracked again up to the next one. When all borders hold, the result is that of one pass
over each clip; tracks are then numbered on from piece to piece. A clip without cuts is one piece, and its length bounds it.

One pass gives rows of several kinds, which :class:`Association` takes apart: observations, cuts, the camera's moves, the health of
every frame, and the pairs that were priced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import votes
from loomspan.operators.assignment import match_or_leave
from loomspan.operators.frames import cut_signals
from loomspan.session import ship
from loomspan.tables import kept


@dataclass(frozen=True)
class Settings:
    fps: float = 10.0  # frames of the time axis in a second
    nominal_dt: float = 0.1
    high: float = 0.5
    min_hits: int = 3
    coast_s: float = 0.60
    damp: float = 0.72
    edge: float = 0.015
    reach: float = 12.0  # heights in a second
    top_speed: float = 0.88
    floor: float = 0.010
    other_team: float = 4.0
    same_number: float = 0.55
    height_weight: float = 0.5
    leave: float = 2.5  # gates
    residual: float = 1.2  # heights, from min_hits on
    aspect: float = 16 / 9
    camera_support: float = 0.5
    cut_scale: float = 0.5
    cut_count: int = 5
    cut_ratio: float = 2.5
    cut_kits: float = 0.9
    cut_least: int = 4
    debounce_s: float = 0.5
    audit: str = ""  # which pairs are told: none, "near" (within the gate), or "all"


PARTS = [0, 1, 4, 5]
FOUND = ("fx", "fy", "w", "h", "conf", "num", "side", "idx")


@dataclass
class Found:
    """The detections of a frame as arrays; ``kit`` is a list."""

    fx: np.ndarray
    fy: np.ndarray
    w: np.ndarray
    h: np.ndarray
    conf: np.ndarray
    num: np.ndarray
    side: np.ndarray
    idx: np.ndarray
    kit: list

    def __len__(self) -> int:
        return len(self.kit)

    def some(self, at: np.ndarray) -> Found:
        return Found(*[getattr(self, c)[at] for c in FOUND], [self.kit[k] for k in at.tolist()])


class Bodies:
    """Tracks that are alive: constant-velocity filters of foot point and size side by side, and the votes each has had."""

    def __init__(self):
        self.state, self.spread = np.zeros((0, 6)), np.zeros((0, 6, 6))
        self.last_t, self.hits, self.trk, self.side, self.number = np.zeros(0), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        self.kits: list[dict] = []
        self.numbers: list[dict] = []

    def __len__(self) -> int:
        return len(self.trk)

    @property
    def height(self) -> np.ndarray:
        return self.state[:, 5]

    def only(self, at: np.ndarray) -> None:
        for name in ("state", "spread", "last_t", "hits", "trk", "side", "number"):
            setattr(self, name, getattr(self, name)[at])
        self.kits, self.numbers = [self.kits[k] for k in at.tolist()], [self.numbers[k] for k in at.tolist()]

    def expect(self, dt: float) -> np.ndarray:
        """Moves all on by ``dt``; where they are expected."""
        move = np.eye(6)
        move[0, 2] = move[1, 3] = dt
        self.state = self.state @ move.T
        unit = (self.height * dt) ** 2
        self.spread = move @ self.spread @ move.T
        for k, share in enumerate((0.25, 0.25, 4.0, 4.0, 0.35**2, 0.35**2)):
            self.spread[:, k, k] += share * unit
        return self.state[:, :2].copy()

    def correct(self, at: np.ndarray, d: Found) -> None:
        place, size = (0.06 * d.h / np.maximum(d.conf, 0.15)) ** 2, (0.18 * d.h) ** 2
        spread = self.spread[at]
        noise = spread[:, PARTS][:, :, PARTS]
        for k, x in enumerate((place, place, size, size)):
            noise[:, k, k] += x
        gain = np.linalg.solve(noise, spread[:, PARTS]).transpose(0, 2, 1)
        off = np.stack([d.fx, d.fy, d.w, d.h], 1) - self.state[at][:, PARTS]
        self.state[at] += (gain @ off[:, :, None])[:, :, 0]
        self.spread[at] = spread - gain @ spread[:, PARTS]

    def take(self, at: np.ndarray, d: Found, t: float, sides: dict) -> None:
        """Count the detections ``d`` as those of the bodies ``at``."""
        self.hits[at] += 1
        self.last_t[at] = t
        for k, kit, num, conf in zip(at.tolist(), d.kit, d.num.tolist(), d.conf.tolist()):
            self.kits[k][kit] = self.kits[k].get(kit, 0) + 1
            self.side[k] = sides.get(self.kit(k), -1)
            if num == num:
                weight, times = self.numbers[k].get(num, (0.0, 0))
                self.numbers[k][num] = weight + conf, times + 1
                best = max(self.numbers[k], key=lambda n: self.numbers[k][n][0])  # noqa: B023
                weight, times = self.numbers[k][best]
                self.number[k] = best if weight >= 1.2 and times >= 2 else np.nan

    def kit(self, k: int):
        return max(self.kits[k], key=self.kits[k].get)  # the first of equals

    def begin(self, d: Found, first: int, t: float, sides: dict) -> np.ndarray:
        n, m = len(self), len(d)
        state = np.zeros((m, 6))
        state[:, PARTS] = np.stack([d.fx, d.fy, d.w, d.h], 1)
        self.state = np.concatenate([self.state, state])
        self.spread = np.concatenate([self.spread, np.broadcast_to(np.diag([1e-3, 1e-3, 1e-2, 1e-2, 1e-4, 1e-4]), (m, 6, 6))])
        self.trk = np.concatenate([self.trk, np.arange(first, first + m)])
        self.last_t, self.number = np.concatenate([self.last_t, np.full(m, t)]), np.concatenate([self.number, np.full(m, np.nan)])
        self.hits, self.side = np.concatenate([self.hits, np.zeros(m, int)]), np.concatenate([self.side, np.full(m, -1)])
        self.kits += [{} for _ in range(m)]
        self.numbers += [{} for _ in range(m)]
        at = np.arange(n, n + m)
        self.take(at, d, t, sides)
        return at


def _gate(h, dt: float, s: Settings, spacing: float | None):
    g = np.minimum(s.reach * np.maximum(h, 0.02), s.top_speed) * dt + s.floor
    return np.minimum(g, 1.5 * spacing) if spacing else g


def camera_move(expected: np.ndarray, found: np.ndarray, dt: float, s: Settings) -> tuple[float, float, float]:
    """Motion of the picture by the fullest bin of displacements (the first of equals), and the share of tracks in it."""
    if not len(expected) or not len(found):
        return 0.0, 0.0, 0.0
    most = s.reach * 0.14 * dt + 0.05
    off = (found[None] - expected[:, None]).reshape(-1, 2)
    off = off[(np.abs(off) <= most).all(1)]
    if not len(off):
        return 0.0, 0.0, 0.0
    bins = np.rint(off / (most / 12)).astype(int)
    _, first, where, times = np.unique(bins, axis=0, return_index=True, return_inverse=True, return_counts=True)
    best = min(range(len(times)), key=lambda k: (-times[k], first[k]))
    middle = np.median(off[where.ravel() == best], axis=0)
    return float(middle[0]), float(middle[1]), float(times[best] / len(expected))


def cut_fires(facts: dict | None, alive: int, last: tuple[int, float] | None, frame: int, s: Settings) -> bool:
    """Whether a shot ends before a frame: enough signals, and within the debounce of a cut stronger evidence than its."""
    if facts is None:
        return False
    scale = max(alive, facts["n"]) >= s.cut_least and (facts["h_ratio"] > s.cut_scale or facts["d_n"] >= s.cut_count)
    signals = int(scale) + int(facts["n_ratio"] >= s.cut_ratio) + int(facts["kit_l1"] > s.cut_kits)
    recent = last is not None and frame - last[0] < s.debounce_s * s.fps
    return signals >= 2 and (not recent or facts["n_ratio"] > last[1])


@dataclass
class Piece:
    """A stretch of a clip while it is tracked. ``rows`` collects tuples of each kind."""

    settings: Settings
    sides: dict
    spacing: float | None = None
    last_cut: tuple[int, float] | None = None
    previous_t: float | None = None
    births: int = 0
    bodies: Bodies = field(default_factory=Bodies)
    ended: dict = field(default_factory=dict)
    rows: dict = field(default_factory=lambda: {k: [] for k in ("obs", "cut", "camera", "health", "pair")})

    def retire(self, at: np.ndarray) -> None:
        for k in at.tolist():
            if self.bodies.hits[k] >= self.settings.min_hits:
                number = self.bodies.number[k]
                self.ended[int(self.bodies.trk[k])] = (len(self.ended), self.bodies.kit(k), None if number != number else int(number))

    def cut(self, frame: int, ratio: float) -> None:
        if self.rows["cut"] and frame - self.rows["cut"][-1][0] < self.settings.debounce_s * self.settings.fps:
            self.rows["cut"].pop()  # weaker evidence of the same event
        self.rows["cut"].append((frame, ratio))
        self.last_cut = frame, ratio
        self.retire(np.arange(len(self.bodies)))
        self.bodies = Bodies()

    def pairs(self, at: np.ndarray, expected: np.ndarray, d: Found, dt: float, camera: tuple, frame: int, stage: str) -> list[tuple[int, int]]:
        """Which of the bodies ``at`` get which of the detections."""
        s, b = self.settings, self.bodies
        if not len(at) or not len(d):
            return []
        where = expected[at] + np.array(camera[:2])
        tall = b.height[at]
        dx, dy = d.fx[None] - where[:, :1], d.fy[None] - where[:, 1:]
        dist = np.hypot(dx, dy)
        gate = _gate(tall, dt, s, self.spacing)
        near = dist <= gate[:, None]
        residual = np.hypot(dx * s.aspect, dy) / np.maximum(tall, 0.02)[:, None]
        sure = b.hits[at] >= s.min_hits
        allowed = near & ~(sure[:, None] & (residual > s.residual))
        ratio = np.maximum(tall[:, None], d.h[None]) / np.maximum(np.minimum(tall[:, None], d.h[None]), 1e-4)
        mine, theirs = b.side[at][:, None], d.side[None]
        against = np.where((mine >= 0) & (theirs >= 0) & (mine != theirs), s.other_team, 1.0)
        same = np.where(b.number[at][:, None] == d.num[None], s.same_number, 1.0)  # unread numbers equal nothing
        tallness = 1 + s.height_weight * (ratio - 1)
        cost = np.where(allowed, dist * against * same * tallness, 1e6)
        out = match_or_leave(cost, s.leave * gate, s.leave * _gate(d.h, dt, s, self.spacing))
        if s.audit:
            taken = set(out)
            one = lambda x, ok: float(x) if ok else 1.0
            none = lambda x: None if x != x else int(x)
            for i, j in np.argwhere(near | (s.audit == "all")).tolist():
                k, ok = int(at[i]), bool(allowed[i, j])
                self.rows["pair"].append((frame, stage, int(b.trk[k]), int(d.idx[j]), float(dist[i, j]), float(gate[i]), float(residual[i, j]) if near[i, j] and sure[i] else None, one(against[i, j], ok), one(same[i, j], ok), one(tallness[i, j], ok), float(cost[i, j]) if ok else None, bool(near[i, j]), (i, j) in taken, b.kit(k), d.kit[j], none(b.number[k]), none(d.num[j]), float(tall[i]), float(d.h[j]), float(d.fx[j]), float(d.fy[j]), float(where[i, 0]), float(where[i, 1]), list(b.kits[k].items())))
        return out

    def observe(self, at: np.ndarray, frame: int, d: Found) -> None:
        b = self.bodies
        b.take(at, d, frame / self.settings.fps, self.sides)
        self.rows["obs"] += zip(b.trk[at].tolist(), [frame] * len(at), d.fx.tolist(), d.fy.tolist(), b.state[at, 4].tolist(), b.state[at, 5].tolist())

    def frame(self, frame: int, found: Found, facts: dict | None, skip: bool = False, begins: bool = False) -> None:
        """Work one frame. ``skip``: it says nothing, tracks coast over it. ``begins``: the piece begins here with a cut, which was
        found to be one."""
        s, t = self.settings, frame / self.settings.fps
        dt = max(1 / s.fps if self.previous_t is None else t - self.previous_t, 1e-3)
        self.previous_t = t
        expected = self.bodies.expect(dt)
        if skip:
            return
        if begins or cut_fires(facts, len(self.bodies), self.last_cut, frame, s):
            self.cut(frame, facts["n_ratio"])
            expected = np.zeros((0, 2))
        b = self.bodies
        places = np.stack([found.fx, found.fy], 1)
        cx, cy, support = camera_move(expected, places, dt, s)
        camera = (cx, cy) if support >= s.camera_support else (0.0, 0.0)
        self.rows["camera"].append((frame, cx, cy, support, *camera))
        high, low = np.flatnonzero(found.conf >= s.high), np.flatnonzero(~(found.conf >= s.high))
        sure = found.some(high)
        n = len(b)
        made = self.pairs(np.arange(n), expected, sure, dt, camera, frame, "hi")
        at, which = (np.array([p[k] for p in made], int) for k in (0, 1))
        if made:
            d = sure.some(which)
            gap = t - b.last_t[at]
            far = gap > 2.5 * s.nominal_dt  # the speed that bridges the gap was not what the filter believed
            back, here = at[far], np.stack([d.fx, d.fy], 1)[far]
            b.state[back, 2:4] = (here - b.state[back, :2]) / gap[far][:, None]
            b.state[back, :2] = here
            b.correct(at, d)
            self.observe(at, frame, d)
        rest = np.setdiff1d(np.arange(n), at)
        if len(rest) and len(low):
            unsure = found.some(low)
            more = self.pairs(rest, expected, unsure, dt, camera, frame, "lo")
            if more:
                late = rest[[i for i, _ in more]]
                d = unsure.some(np.array([j for _, j in more]))
                b.correct(late, d)
                self.observe(late, frame, d)
                rest = np.setdiff1d(rest, late)
        if n:
            self.health(frame, expected, places, at, which, rest, sure, dt, camera)
        b.state[rest, 2:4] *= s.damp
        alone = np.setdiff1d(np.arange(len(sure)), which)
        if len(alone):  # only sure detections begin a track
            d = sure.some(alone)
            new = b.begin(d, self.births + 1, t, self.sides)
            self.rows["obs"] += zip(b.trk[new].tolist(), [frame] * len(new), d.fx.tolist(), d.fy.tolist(), d.w.tolist(), d.h.tolist())
            if s.audit:
                for k, trk in enumerate(b.trk[new].tolist()):
                    num = d.num[k]
                    self.rows["pair"].append((frame, "birth", trk, int(d.idx[k]), *[None] * 10, d.kit[k], None, None if num != num else int(num), None, float(d.h[k]), float(d.fx[k]), float(d.fy[k]), None, None, None))
            self.births += len(new)
        inside = ((b.state[:, :2] >= -s.edge) & (b.state[:, :2] <= 1 + s.edge)).all(1)
        dead = (t > b.last_t) & (~inside | (t - b.last_t > s.coast_s))
        self.retire(np.flatnonzero(dead))
        b.only(np.flatnonzero(~dead))

    def health(self, frame, expected, places, at, which, rest, sure: Found, dt: float, camera: tuple) -> None:
        """How the frame went: share of tracks that got a sure detection, sure detections that got none, and of the tracks left over
        those whose gate held none and those kept from it by their team alone. The gate lies where the matches say the picture moved."""
        s, b = self.settings, self.bodies
        if len(at) >= 3:
            off = np.stack([sure.fx, sure.fy], 1)[which] - expected[at]
            shift = np.median(off, axis=0)
        else:
            shift = np.array(camera) * 0.5
        missed = blocked = 0
        if len(rest):
            where = expected[rest] + shift
            near = np.hypot(sure.fx[None] - where[:, :1], sure.fy[None] - where[:, 1:]) <= _gate(b.height[rest], dt, s, self.spacing)[:, None]
            mine, theirs = b.side[rest][:, None], sure.side[None]
            free = near & ~((mine >= 0) & (theirs >= 0) & (mine != theirs))
            missed, blocked = int((~near.any(1)).sum()), int((near.any(1) & ~free.any(1)).sum())
        self.rows["health"].append((frame, len(at) / len(b), len(sure) - len(which), blocked, missed))

    def done(self) -> dict:
        """What the piece leaves to the next one; its tracks end with it."""
        left = {"births": self.births, "alive": len(self.bodies), "cut_frame": self.last_cut[0] if self.last_cut else None, "cut_ratio": self.last_cut[1] if self.last_cut else None}
        self.retire(np.arange(len(self.bodies)))
        return left | {"finished": len(self.ended)}


KINDS = {
    "obs": "trk long, x double, y double, w double, h double, kit string, num int, ended int",
    "cut": "n_ratio double",
    "camera": "cx double, cy double, support double, used_x double, used_y double",
    "health": "rate double, births int, kit_blocked int, gate_missed int",
    "pair": "stage string, trk long, idx int, dist double, gate double, resid_bh double, kit_mul double, num_mul double, h_mul double, cost double, in_gate boolean, taken boolean, tr_kit string, d_kit string, tr_num int, d_num int, tr_h double, d_h double, det_x double, det_y double, pred_x double, pred_y double, tr_kit_votes map<string,int>",
    "left": "births long, alive int, cut_frame int, cut_ratio double, finished int",
}


def _arrow(kind: str):
    import pyarrow as pa

    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "map<string,int>": pa.map_(pa.string(), pa.int32())}
    return pa.struct([(name, types[t]) for name, t in (c.split(" ") for c in KINDS[kind].split(", "))])


def _tagged(clip, start: int, rows: dict, clip_type):
    """One table with a row for each thing found, its struct in the column of its kind."""
    import pyarrow as pa

    schema = pa.schema([("clip", clip_type), ("start", pa.int32()), ("frame", pa.int32()), *[(k, _arrow(k)) for k in KINDS]])
    parts = []
    for kind, found in rows.items():
        if found:
            n, struct = len(found), _arrow(kind)
            columns = list(zip(*found))
            value = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns[1:], struct)], fields=list(struct))
            parts.append(pa.Table.from_arrays([pa.array([clip] * n, clip_type), pa.array([start] * n, pa.int32()), pa.array(columns[0], pa.int32()), *[value if k == kind else pa.nulls(n, _arrow(k)) for k in KINDS]], schema=schema))
    return pa.concat_tables(parts) if parts else schema.empty_table()


def _track_piece(table, settings: Settings):
    """The rows of a piece: table of detections (clip, start, first, frame, idx, ...) of one group."""
    table = table.sort_by([("frame", "ascending"), ("idx", "ascending")]).combine_chunks()
    column = lambda c: table.column(c).to_numpy(zero_copy_only=False)
    frame, kit = column("frame"), table.column("kit").to_pylist()
    side = table.column("side").fill_null(-1).to_numpy()
    arrays = [column(c).astype(float) for c in ("fx", "fy", "w", "h", "conf", "num")] + [side.astype(int), table.column("idx").fill_null(-1).to_numpy()]
    facts = {c: column(c) for c in ("n", "h_ratio", "d_n", "n_ratio", "kit_l1")}
    skip, begins = column("degenerate"), bool(table.column("border")[0].as_py())
    spacing = table.column("spacing")[0].as_py()
    piece = Piece(settings, {k: s for k, s in zip(kit, side.tolist()) if s >= 0}, spacing)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(frame)) + 1, [len(frame)]]).tolist()
    for a, b in zip(edges, edges[1:]):
        rows = np.arange(a, b)[arrays[-1][a:b] >= 0]  # a row without idx stands for a frame without detections
        found = Found(*[x[rows] for x in arrays], [kit[k] for k in rows.tolist()])
        known = {c: v[a] for c, v in facts.items()} if facts["n_ratio"][a] == facts["n_ratio"][a] else None
        piece.frame(int(frame[a]), found, known, bool(skip[a]), begins and a == 0)
    left = piece.done()
    out = {"obs": [(f, trk, x, y, w, h, piece.ended[trk][1], piece.ended[trk][2], piece.ended[trk][0]) for trk, f, x, y, w, h in piece.rows["obs"] if trk in piece.ended]}
    out |= {k: piece.rows[k] for k in ("cut", "camera", "health", "pair")}
    last = int(frame[-1])
    out["left"] = [(last, *(left[c.split(" ")[0]] for c in KINDS["left"].split(", ")))]
    clip = table.column("clip")
    return _tagged(clip[0].as_py(), int(table.column("start")[0].as_py()), out, clip.type)


class Association:
    """What an association found; each part reads only the rows of its kind."""

    def __init__(self, rows: DataFrame, pieces: DataFrame, facts: DataFrame, clip: str):
        self.rows, self.pieces, self.facts, self.clip = rows, pieces, facts, clip

    def _kind(self, kind: str, renumber: bool = False) -> DataFrame:
        """Rows of a kind; numbers of tracks go on from piece to piece of a clip."""
        r = self.rows.where(F.col(kind).isNotNull()).select("clip", "start", "frame", f"{kind}.*")
        if renumber:
            r = r.join(self.pieces.select("clip", "start", "births_before", "finished_before"), ["clip", "start"])
            r = r.withColumn("trk", F.col("trk") + F.col("births_before"))
            if "ended" in r.columns:
                r = r.withColumn("ended", (F.col("ended") + F.col("finished_before")).cast("int"))
            r = r.drop("births_before", "finished_before")
        return r.drop("start").withColumnRenamed("clip", self.clip)

    @property
    def observations(self) -> DataFrame:
        """clip, trk, frame, x, y (foot), w, h, kit, num (the track's votes), ended (order in which tracks ended)."""
        return self._kind("obs", True).select(self.clip, "trk", "frame", "x", "y", "w", "h", "kit", "num", "ended")

    @property
    def cuts(self) -> DataFrame:
        """clip, frame, h_ratio, d_n, n_ratio, kit_l1, med_h, prev_med_h of the cuts; a cut that a stronger one beside it replaced is none."""
        replaced = self.pieces.where("replaced is not null").select(F.col("clip").alias(self.clip), F.col("replaced").alias("frame"))
        cuts = self._kind("cut").select(self.clip, "frame").join(replaced, [self.clip, "frame"], "left_anti")
        return cuts.join(self.facts.select(F.col("clip").alias(self.clip), "frame", "h_ratio", "d_n", "n_ratio", "kit_l1", "med_h", "prev_med_h"), [self.clip, "frame"])

    @property
    def camera(self) -> DataFrame:
        """clip, frame, cx, cy, support (the vote), used_x, used_y (0 where too few tracks agree), ox, oy (their sums since the clip began)."""
        w = Window.partitionBy(self.clip).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
        return self._kind("camera").withColumns({"ox": F.sum("used_x").over(w), "oy": F.sum("used_y").over(w)})

    @property
    def health(self) -> DataFrame:
        """clip, frame, rate, births, kit_blocked, gate_missed, of frames that began with tracks."""
        return self._kind("health")

    @property
    def pairs(self) -> DataFrame:
        """The audit: every priced pair with its stage, factors and whether it was taken, and the births. Settings.audit says which."""
        return self._kind("pair", True)


def _facts(boxes: DataFrame, s: Settings) -> DataFrame:
    """Facts of every frame but the degenerate ones, against the one before it."""
    rows = boxes.where("not degenerate and idx is not null")
    out = cut_signals(rows, "clip", scale=s.cut_scale, count=s.cut_count, ratio=s.cut_ratio, kits=s.cut_kits, least=s.cut_least)
    may = ((F.col("h_ratio") > s.cut_scale) | (F.col("d_n") >= s.cut_count)).cast("int") + (F.col("n_ratio") >= s.cut_ratio).cast("int") + (F.coalesce("kit_l1", F.lit(0.0)) > s.cut_kits).cast("int")
    return out.select("clip", "frame", F.col("n").cast("int").alias("n"), "h_ratio", F.col("d_n").cast("int").alias("d_n"), "n_ratio", F.coalesce("kit_l1", F.lit(0.0)).alias("kit_l1"), "med_h", "prev_med_h", (may >= 2).alias("may_cut"))


def associate(boxes: DataFrame, clip: str = "clip", settings: Settings = Settings(), teams: DataFrame | None = None, pieces: bool = True) -> Association:
    """Tracks from detections (clip, frame, idx, x, y, w, h, conf, kit, num), duplicates removed.

    teams: (clip, kit, rank), rank 1 and 2 the clip's teams; by default its two most frequent kits. A column ``degenerate`` marks frames that are
    one box repeated, which are passed over; a column ``spacing`` gives how far apart players of the clip stand (null: not known),
    which narrows the gates. A row whose idx is null stands for a frame without detections. ``pieces``: clips are worked in pieces; without, each
    clip is one group.
    """
    ship(boxes.sparkSession)
    has = lambda c, kind, rest: F.col(c).cast(kind) if c in boxes.columns else F.lit(rest).cast(kind)
    rows = boxes.select(F.col(clip).alias("clip"), F.col("frame").cast("int").alias("frame"), F.col("idx").cast("int").alias("idx"), F.expr("x + w / 2").alias("fx"), F.expr("y + h").alias("fy"), "w", "h", "conf", F.lower(F.trim("kit")).alias("kit"), F.col("num").cast("double").alias("num"), F.coalesce(has("degenerate", "boolean", False), F.lit(False)).alias("degenerate"), has("spacing", "double", None).alias("spacing"))
    if pieces:
        rows = kept(rows)
    if teams is None:
        teams = votes.top_values(rows.where("idx is not null").withColumn("_p", F.struct("frame", "idx")), ["clip"], "kit", "_p", 2)
    else:
        teams = teams.select(F.col(clip).alias("clip"), "kit", "rank")
    facts = _facts(rows, settings)
    if pieces:
        facts, teams = kept(facts), kept(teams)
    rows = rows.join(teams.select("clip", "kit", (F.col("rank") - 1).cast("int").alias("side")), ["clip", "kit"], "left")
    rows = rows.join(facts.select("clip", "frame", "n", "h_ratio", "d_n", "n_ratio", "kit_l1"), ["clip", "frame"], "left")
    firsts = rows.groupBy("clip").agg(F.min("frame").alias("start")).withColumn("border", F.lit(False))
    starts = firsts
    if pieces:
        # of borders that one debounce could join only the first is tried; the kernel sees the rest
        w = Window.partitionBy("clip").orderBy("frame")
        apart = F.coalesce(F.col("frame") - F.lag("frame").over(w) >= settings.debounce_s * settings.fps, F.lit(True))
        may = facts.where("may_cut").withColumn("_ok", apart).where("_ok").select("clip", F.col("frame").alias("start"), F.lit(True).alias("border"))
        starts = kept(firsts.unionByName(may.join(firsts.select("clip", "start"), ["clip", "start"], "left_anti")))
    found = _tracked(rows, starts, None, settings)
    if not pieces:
        left = found.where("left is not null").select("clip", "start", F.lit(0).cast("long").alias("births_before"), F.lit(0).alias("finished_before"), F.lit(None).cast("int").alias("replaced"))
        return Association(found, left, facts, clip)
    found = kept(found)
    while True:
        border = _borders(found, facts, settings)
        wrong = kept(border.where("border and not fires").select("clip", "start", "before"))
        if wrong.isEmpty():
            break
        # a border that is no cut goes; the nearest piece before it that stays is tracked again, up to the next border
        starts = kept(starts.join(wrong.select("clip", "start"), ["clip", "start"], "left_anti"))
        last = wrong.join(starts.withColumnRenamed("start", "s").drop("border"), "clip").where("s < start").groupBy("clip", "start").agg(F.max("s").alias("s"))
        again = kept(last.select("clip", F.col("s").alias("start")).distinct())
        new = _tracked(rows, starts, again, settings)
        stale = again.unionByName(wrong.select("clip", "start")).distinct()
        found = kept(found.join(stale, ["clip", "start"], "left_anti").unionByName(new))
    return Association(found, _numbered(border), facts, clip)


def _tracked(rows: DataFrame, starts: DataFrame, only: DataFrame | None, settings: Settings) -> DataFrame:
    """Runs the pieces that begin at ``starts`` (those in ``only``, if given)."""
    w = Window.partitionBy("clip").orderBy("start")
    spans = starts.withColumn("stop", F.lead("start").over(w))
    if only is not None:
        spans = spans.join(only, ["clip", "start"], "left_semi")
    ends = rows.select("clip", "frame").distinct()
    # a clip's frames and starts meet by merging both in order: the last start at or before a frame
    both = ends.select("clip", F.col("frame").alias("at"), F.lit(None).cast("int").alias("s")).unionByName(starts.select("clip", F.col("start").alias("at"), F.col("start").alias("s")))
    last = both.withColumn("start", F.last("s", True).over(Window.partitionBy("clip").orderBy("at", F.asc_nulls_last("s")).rowsBetween(Window.unboundedPreceding, 0))).where("s is null").select("clip", F.col("at").alias("frame"), "start")
    dealt = rows.join(last, ["clip", "frame"]).join(spans.select("clip", "start", "border"), ["clip", "start"])
    kind = rows.schema["clip"].dataType.simpleString()
    structs = ", ".join(f"{k} struct<{', '.join(c.replace(' ', ': ', 1) for c in v.split(', '))}>" for k, v in KINDS.items())
    return dealt.groupBy("clip", "start").applyInArrow(lambda t: _track_piece(t, settings), f"clip {kind}, start int, frame int, {structs}")


def _borders(found: DataFrame, facts: DataFrame, s: Settings) -> DataFrame:
    """A row a piece with what the one before it left, and whether a cut fires at its start (``fires``)."""
    w = Window.partitionBy("clip").orderBy("start")
    p = found.where("left is not null").select("clip", "start", "left.*")
    p = p.withColumns({"before": F.lag("start").over(w), **{f"_{c}": F.lag(c).over(w) for c in ("alive", "cut_frame", "cut_ratio")}})
    p = p.withColumn("border", F.col("before").isNotNull())
    p = p.join(facts.select("clip", F.col("frame").alias("start"), "n", "h_ratio", "d_n", "n_ratio", "kit_l1"), ["clip", "start"], "left")
    scale = (F.greatest("_alive", "n") >= s.cut_least) & ((F.col("h_ratio") > s.cut_scale) | (F.col("d_n") >= s.cut_count))
    signals = scale.cast("int") + (F.col("n_ratio") >= s.cut_ratio).cast("int") + (F.col("kit_l1") > s.cut_kits).cast("int")
    recent = F.coalesce(F.col("start") - F.col("_cut_frame") < s.debounce_s * s.fps, F.lit(False))
    fires = F.coalesce((signals >= 2) & (~recent | (F.col("n_ratio") > F.col("_cut_ratio"))), F.lit(False))
    return p.withColumns({"fires": fires, "replaced": F.when(F.col("border") & recent, F.col("_cut_frame"))})


def _numbered(border: DataFrame) -> DataFrame:
    """Pieces with the tracks that were born and that ended in the pieces of the clip before them."""
    w = Window.partitionBy("clip").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return border.select("clip", "start", "replaced", F.coalesce(F.sum("births").over(w), F.lit(0)).alias("births_before"), F.coalesce(F.sum("finished").over(w), F.lit(0)).alias("finished_before"))


def track_clips(boxes: DataFrame, clip: str = "clip", settings: Settings = Settings(), teams: DataFrame | None = None) -> DataFrame:
    """The observations of :func:`associate`, one group a clip, without a table on the way."""
    return associate(boxes, clip, settings, teams, pieces=False).observations
