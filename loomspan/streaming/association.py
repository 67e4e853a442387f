"""Association on a stream: the tracker's frames as they come, with its state in Spark's state store.

Detections are keyed by clip. Those of a frame wait in a list until the watermark says that the frame is whole; an event-time timer for each
frame then works it, with the same kernel as the batch, and the tracks that end with it are given out with the votes they had. Another timer,
``coast_s`` past a clip's last frame, ends what is still alive. So a clip's state is its tracks that are alive, what has been seen
of them, and the frames that wait.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from loomspan.operators.tracker import Found, Piece, Settings
from loomspan.session import ship

RESULT = "trk long, frame int, x double, y double, w double, h double, kit string, num int, ended int"
COLUMNS = ("frame", "idx", "fx", "fy", "w", "h", "conf", "kit", "num", "side")
FLOATS = {"fx", "fy", "w", "h", "conf", "num"}
WAITING = "frame int, idx int, fx double, fy double, w double, h double, conf double, kit string, num double, side int, at_ms long"


def facts_between(before: dict | None, now: Found) -> dict | None:
    """What a frame says against the one before it, as the batch tells it from its windows."""
    if before is None or not len(now) or not before["h"]:
        return None
    kits: dict = {}
    for k in now.kit:
        kits[k] = kits.get(k, 0) + 1
    n, m = len(now), before["n"]
    apart = sum(abs(before["kits"].get(k, 0) / m - kits.get(k, 0) / n) for k in {*before["kits"], *kits})
    return {"n": n, "h_ratio": abs(float(np.median(now.h)) - before["h"]) / max(before["h"], 1e-4), "d_n": abs(n - m), "n_ratio": max(n, m) / max(min(n, m), 1), "kit_l1": round(apart, 9)}


class Associator(StatefulProcessor):
    def __init__(self, settings: Settings, clip: str, ship_state: str = "piece binary"):
        self.settings, self.clip, self.shape = settings, clip, ship_state

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.shape)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        late = timerValues.getCurrentWatermarkInMs()
        times = set()
        for batch in rows:
            batch = batch[batch["at_ms"] > late]  # frames that were worked without it stay as they are
            if len(batch):
                values = batch[[*COLUMNS, "at_ms"]].astype(object).where(batch[[*COLUMNS, "at_ms"]].notna(), None)
                # a column of whole numbers with nulls comes as floats, which a state's whole numbers would not take
                self.waiting.appendList([tuple(v if v is None or not isinstance(v, float) or c in FLOATS else int(v) for c, v in zip(values.columns, r)) for r in values.itertuples(index=False)])
                times |= {int(t) for t in batch["at_ms"]}
        for t in times:
            self.handle.registerTimer(t)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now = expiredTimerInfo.getExpiryTimeInMs()
        piece, before, last, given = pickle.loads(self.state.get()[0]) if self.state.exists() else (Piece(self.settings, {}), None, None, set())
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[-1] <= now], [r for r in rows if r[-1] > now]
        for frame in sorted({r[0] for r in due}):
            some = sorted((r for r in due if r[0] == frame), key=lambda r: r[1])
            column = lambda k, kind=float: np.array([np.nan if r[k] is None else r[k] for r in some], kind)  # noqa: B023, E731
            found = Found(column(2), column(3), column(4), column(5), column(6), column(8), np.array([-1 if r[9] is None else int(r[9]) for r in some]), np.array([r[1] for r in some]), [r[7] for r in some])
            piece.sides |= {k: int(s) for k, s in zip(found.kit, found.side) if s >= 0}
            piece.frame(frame, found, facts_between(before, found))
            kits: dict = {}
            for k in found.kit:
                kits[k] = kits.get(k, 0) + 1
            before = {"n": len(found), "h": float(np.median(found.h)), "kits": kits}
            last = some[0][-1]
        silent = int(self.settings.coast_s * 1000) + 1
        if last is not None and not rest and now >= last + silent:
            piece.done()
            yield self.told(key, piece, given)
            self.state.clear()
            self.waiting.clear()
            return
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
            self.handle.registerTimer(last + silent)
        yield self.told(key, piece, given)
        alive = {int(t) for t in piece.bodies.trk}
        piece.rows = {k: ([r for r in v if r[0] in alive] if k == "obs" else v[-1:]) for k, v in piece.rows.items()}
        self.state.update((pickle.dumps((piece, before, last, given)),))

    def told(self, key, piece: Piece, given: set):
        """The observations of tracks that ended and weren't given out yet."""
        import pandas as pd

        new = set(piece.ended) - given
        rows = [(key[0], trk, f, x, y, w, h, piece.ended[trk][1], piece.ended[trk][2], piece.ended[trk][0]) for trk, f, x, y, w, h in piece.rows["obs"] if trk in new]
        given |= new
        return pd.DataFrame(rows, columns=[self.clip, "trk", "frame", "x", "y", "w", "h", "kit", "num", "ended"]).astype({"num": "Int32"})

    def close(self) -> None:
        pass


def associate(detections: DataFrame, ts: str, clip: str = "clip", settings: Settings = Settings(), late: str = "2 seconds") -> DataFrame:
    """clip, trk, frame, x, y (foot), w, h, kit, num, ended: the observations of tracks, when these end, from a stream of detections (clip, ts,
    frame, idx, x, y, w, h, conf, kit, num, and side, 0 or 1 for the teams' kits, if it is known). The rows of a frame share their time.
    The session needs the RocksDB state store. Agrees with the batch where nothing is late and no clip is silent for longer than ``coast_s``."""
    ship(detections.sparkSession)
    side = F.col("side").cast("int") if "side" in detections.columns else F.lit(None).cast("int")
    rows = detections.withWatermark(ts, late).select(clip, ts, F.col("frame").cast("int").alias("frame"), F.col("idx").cast("int").alias("idx"), F.expr("x + w / 2").alias("fx"), F.expr("y + h").alias("fy"), "w", "h", "conf", F.lower(F.trim("kit")).alias("kit"), F.col("num").cast("double").alias("num"), side.alias("side"), F.unix_millis(ts).alias("at_ms"))
    kind = detections.schema[clip].dataType.simpleString()
    return rows.groupBy(clip).transformWithStateInPandas(Associator(settings, clip), f"{clip} {kind}, {RESULT}", "Append", "EventTime")
