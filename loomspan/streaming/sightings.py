"""Streams of sightings: stretches by gap, and counts a window with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stretches(sightings: DataFrame, key: str, ts: str, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Start, end and number of sightings of each stretch of a key: a session window, the streaming counterpart of
    segmentation by gap. State is kept for open stretches only, up to the watermark."""
    s = sightings.withWatermark(ts, late)
    w = s.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return w.select(key, "first", "last", "n")


def counts(sightings: DataFrame, ts: str, every: str = "1 second", late: str = "10 seconds", *keys: str) -> DataFrame:
    """Sightings, mean size and distinct kits a window."""
    s = sightings.withWatermark(ts, late)
    w = s.groupBy(F.window(ts, every).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("h").alias("mean_h"), F.approx_count_distinct("kit").alias("kits"))
    return w.select(F.col("w.start").alias("start"), *keys, "n", "mean_h", "kits")


def follow(sightings: DataFrame, key: str, ts: str, coast_s: float = 0.60, late: str = "10 seconds") -> DataFrame:
    """The causal half of tracking for each key: position and speed by a constant-velocity state that is updated as
    sightings come, and dropped when the watermark is ``coast_s`` past the last. Batches are Arrow frames of a key's new rows.

    sightings: key, ts, x, y. Result: key, n, x, y, vx, vy, last_s.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(group, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        n, x, y, vx, vy, last = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0)
        for rows in batches:
            for r in rows.sort_values(ts).itertuples(index=False):
                t = getattr(r, ts).timestamp()
                dt = t - last
                if n and 0 < dt <= coast_s:
                    gain = 0.5
                    vx, vy = (1 - gain) * vx + gain * (r.x - x) / dt, (1 - gain) * vy + gain * (r.y - y) / dt
                    n += 1
                elif not n or dt > coast_s:
                    n, vx, vy = 1, 0.0, 0.0
                x, y, last = float(r.x), float(r.y), max(t, last)
        state.update((n, x, y, vx, vy, last))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int((last + coast_s) * 1000)))
        yield pd.DataFrame({key: [group[0]], "n": [n], "x": [x], "y": [y], "vx": [vx], "vy": [vy], "last_s": [last]})

    kind = sightings.schema[key].dataType.simpleString()
    fields = "n long, x double, y double, vx double, vy double, last_s double"
    return sightings.select(key, ts, "x", "y").withWatermark(ts, late).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {fields}", fields, "update", GroupStateTimeout.EventTimeTimeout)
