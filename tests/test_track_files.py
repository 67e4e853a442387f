"""Named track files: round trips, backups, and jobs that fail."""

import json

import pytest
from pyspark.sql import functions as F

from loomspan.sources import documents, track_files


def tables(spark, n=300, shift=0.0):
    runs = spark.createDataFrame([("a", 30, "one"), ("b", 25, None), ("empty", 1, "none")], "clip string, source_fps int, note string")
    frames = spark.range(n).selectExpr("if(id % 3 = 0, 'b', 'a') as clip", "int(id) as frame", f"array(named_struct('track', int(id % 5), 'x', id / 10.0 + {shift}D, 'team', 'A')) as players")
    return runs, frames.repartition(5)


def test_round_trip_and_backup(spark, tmp_path):
    runs, frames = tables(spark)
    path = str(tmp_path)
    track_files.write_track_files(runs, frames, path)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.json", "b.json", "empty.json"]
    doc = json.loads((tmp_path / "a.json").read_text())
    assert (doc["clip"], doc["source_fps"], doc["note"]) == ("a", 30, "one") and [f["frame"] for f in doc["frames"]] == [k for k in range(300) if k % 3]
    assert json.loads((tmp_path / "empty.json").read_text())["frames"] == []
    shape = "frame int, players array<struct<track:int,x:double,team:string>>"
    back = track_files.read_track_frames(spark, path, shape)
    assert sorted(map(str, back.select(F.col("name").alias("clip"), "frame", F.col("players.x")[0].alias("x")).collect())) == sorted(map(str, frames.select("clip", "frame", F.col("players.x")[0].cast("double").alias("x")).collect()))
    assert documents.read_tracks(spark, f"{path}/a.json").select(F.size("frames")).first()[0] == 200  # the reader of whole documents takes it too
    runs, frames = tables(spark, 30, 1.0)
    track_files.write_track_files(runs, frames, path, backup="old")
    assert len(json.loads((tmp_path / "a.json").read_text())["frames"]) == 20 and len(json.loads((tmp_path / "a.json.old").read_text())["frames"]) == 200
    assert track_files.read_track_frames(spark, path, shape).count() == 30  # backups are not read


def test_long_files_are_split(spark, tmp_path):
    runs, frames = tables(spark, 3000)
    track_files.write_track_files(runs, frames, str(tmp_path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = track_files.read_track_frames(spark, str(tmp_path), "frame int")
        assert got.rdd.getNumPartitions() > 4 and got.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_failed_job_changes_nothing(spark, tmp_path):
    runs, frames = tables(spark)
    track_files.write_track_files(runs, frames, str(tmp_path))
    before = {p.name: p.read_text() for p in tmp_path.iterdir()}
    bad = frames.withColumn("players", F.when(F.col("frame") == 299, F.raise_error(F.lit("broken"))).otherwise(F.col("players")))
    with pytest.raises(Exception, match="broken"):
        track_files.write_track_files(runs, bad, str(tmp_path))
    assert {p.name: p.read_text() for p in tmp_path.iterdir() if p.is_file()} == before and not [p for p in tmp_path.iterdir() if p.is_dir()]
