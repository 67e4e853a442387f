"""Votes: modes with first-seen ties, weighted number votes, top values, identities of tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType


def top_values(rows: DataFrame, keys: list[str], value: str, position: str | Column, most: int) -> DataFrame:
    """keys, value, n, rank: the most frequent values of each key, ties by first appearance. Counted before any
    row is ranked, so what is sorted has a row for each value."""
    p = F.col(position) if isinstance(position, str) else position
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(p).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "_first") if keys else Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "_first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("_first")


def mode_vote(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """keys, value, n: the most frequent value of each key, ties to the one seen first."""
    return top_values(rows, keys, value, position, 1).drop("rank")


def number_vote(rows: DataFrame, keys: list[str], number: str = "num", weight: str = "conf", position: str = "frame", least: float = 1.2, times: int = 2) -> DataFrame:
    """keys, number, weight, times: the number with the largest sum of confidences (ties to the first seen), null
    unless the sum is at least ``least`` and it was read ``times`` times."""
    sums = rows.where(F.col(number).isNotNull()).groupBy(*keys, number).agg(F.sum(weight).alias("weight"), F.count("*").alias("times"), F.min(position).alias("_first"))
    best = sums.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "_first"))).where("_r = 1").drop("_r", "_first")
    return best.withColumn(number, F.when((F.col("weight") >= least) & (F.col("times") >= times), F.col(number)))


def stitched(tracks: DataFrame, teams: DataFrame, scope: list[str]) -> DataFrame:
    """Identities of finished tracks (scope, trk, kit, num, f0, f1; one row a track).

    Tracks of one kit and number share an identity where their lifetimes, ends included, don't meet: in order of
    f1 (the order in which tracks end) each goes to the first bucket that has room; buckets after the first are
    contested. As tracks come by their ends, a bucket has room if its last track ended before this one began, so one
    number a bucket is kept. Each choice depends on all before it, so a (kit, number) of a scope is one group. Tracks
    without a number are labelled in order of their first frame. ``teams``: (scope, kit, team).
    """

    def buckets(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["f1", "trk", "f0"], ignore_index=True)
        if rows["num"].isna().all():
            return rows.assign(bucket=pd.array([None] * len(rows), "Int32")).drop(columns=["f1", "_s"])
        last, used, out = np.zeros(len(rows)), 0, []
        for f0, f1 in zip(rows["f0"].tolist(), rows["f1"].tolist()):
            room = last[:used] < f0
            k = int(room.argmax()) if used else 0
            if not used or not room[k]:
                k, used = used, used + 1
            last[k] = f1
            out.append(k)
        return rows.assign(bucket=out).drop(columns=["f1", "_s"])

    # tracks without a number go along in groups by hash, so that ``tracks`` is computed once
    rows = tracks.select(*scope, "trk", "kit", "num", "f0", "f1", F.when(F.col("num").isNull(), F.pmod(F.xxhash64("trk"), F.lit(64))).alias("_s"))
    out = StructType(rows.drop("f1", "_s").schema.fields).add("bucket", IntegerType())
    both = rows.groupBy(*scope, "kit", "num", "_s").applyInPandas(buckets, out)
    nth = F.row_number().over(Window.partitionBy(*scope, F.col("num").isNull()).orderBy("f0", "trk")) - 1
    both = both.withColumn("nth", F.when(F.col("num").isNull(), nth))
    named = both.join(teams, [*scope, "kit"], "left")
    side = F.coalesce("team", F.lit("?"))
    identity = F.when(F.col("num").isNull(), F.concat(side, F.lit("·"), F.col("trk"))).otherwise(F.concat(side, F.col("num"), F.when(F.col("bucket") > 0, F.concat(F.lit("^"), F.col("bucket"))).otherwise("")))
    source = F.when(F.col("num").isNull(), "fallback").when(F.col("bucket") == 0, "read").otherwise("contested")
    return named.select(*scope, "trk", "kit", "num", "nth", "team", identity.alias("identity"), source.alias("number_source"))
