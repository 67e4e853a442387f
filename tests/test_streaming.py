import datetime as dt
import time

from pyspark.sql import functions as F

from loomspan.streaming import sightings


def run(spark, frame, build, name, mode="append"):
    q = build(frame).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return spark.table(name).toPandas()


def source(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "trk int, ts timestamp, x double, y double, h double, kit string").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema("trk int, ts timestamp, x double, y double, h double, kit string").option("maxFilesPerTrigger", 1).parquet(path)


def test_stretches_split_at_gaps(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [[(1, at(s), 0.1, 0.1, 0.1, "a") for s in (0, 0.2, 0.4, 2.0, 2.2)], [(2, at(60), 0.1, 0.1, 0.1, "a")]]
    got = run(spark, source(spark, tmp_path, rows), lambda s: sightings.stretches(s, "trk", "ts"), "stretches")
    assert sorted(got[got.trk == 1].n) == [2, 3]


def test_counts_a_window(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [[(1, t0 + dt.timedelta(seconds=s), 0.1, 0.1, 0.1, "a") for s in (0, 0.5, 1.5)], [(1, t0 + dt.timedelta(seconds=60), 0.1, 0.1, 0.1, "a")]]
    got = run(spark, source(spark, tmp_path, rows), lambda s: sightings.counts(s, "ts"), "counted")
    assert sorted(got.n)[:2] == [1, 2]


def test_follow_keeps_a_speed(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [[(1, t0 + dt.timedelta(seconds=0.1 * k), 0.01 * k, 0.5, 0.1, "a") for k in range(10)]]
    got = run(spark, source(spark, tmp_path, rows), lambda s: sightings.follow(s, "trk", "ts"), "followed", "update")
    assert got.n.max() == 10 and abs(got.vx.iloc[-1] - 0.1) < 0.02


def test_association_on_a_stream_is_that_of_the_batch(spark, tmp_path):
    """Files of some frames each; the same tracks as the kernel gives over the whole, when nothing is late."""
    from loomspan.operators import tracker
    from loomspan.streaming import association
    from tests.test_tracker import CASES

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t0 = dt.datetime(2024, 1, 1)
    shape = "clip int, frame int, idx int, x double, y double, w double, h double, conf double, kit string, num int"
    clips = {0: CASES["cuts"], 1: CASES["few"]}
    rows = [(k, *r[1:-1]) for k, case in clips.items() for r in case if not r[-1]]
    batch = spark.createDataFrame(rows, shape)
    sides = tracker.votes.top_values(batch.withColumn("_p", F.struct("frame", "idx")), ["clip"], "kit", "_p", 2)
    sided = batch.join(sides.select("clip", "kit", (F.col("rank") - 1).alias("side")), ["clip", "kit"], "left")
    path, last = str(tmp_path / "in"), max(r[1] for r in rows)
    stamped = sided.withColumn("ts", F.lit(t0) + F.expr("make_dt_interval(0, 0, 0, frame / 10.0)"))
    for a in range(0, last + 1, 20):
        stamped.where(f"frame >= {a} and frame < {a + 20}").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    for k in (1, 2):  # a later clip moves the watermark past the end
        stamped.limit(1).withColumn("clip", F.lit(99)).withColumn("ts", F.lit(t0 + dt.timedelta(hours=k))).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = spark.readStream.schema(stamped.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(spark, stream, lambda s: association.associate(s, "ts"), "associated")
    expected = tracker.associate(batch, pieces=False).observations.toPandas()
    keys = ["clip", "trk", "frame"]
    got, expected = (f[f["clip"] != 99].sort_values(keys).reset_index(drop=True) for f in (got, expected))
    assert len(expected) > 100 and got[[*keys, "kit", "ended"]].astype(str).equals(expected[[*keys, "kit", "ended"]].astype(str))
    assert abs(got[["x", "y", "w", "h"]] - expected[["x", "y", "w", "h"]]).max().max() < 1e-12
