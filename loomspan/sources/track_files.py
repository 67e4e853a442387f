"""Tracks documents as one named file a run: a sink by the Python data source API, and a reader by ranges of frames.

A file is one JSON document with a frame on each line. The sink gets a run's rows in order and writes them through as they come, so a
document may be larger than a task's memory; files are staged, and only when every task has succeeded do they take their names, an
older file of the name being kept as a backup. A failed job leaves the old files as they were. The reader takes lines, which
Spark splits by bytes, so one document is read by many tasks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from loomspan.session import ship

FORMAT = "loomspan_track_files"
ROWS = "name string, place int, line string"


def _opened(path: str):
    """(filesystem, path in it) of a folder, wherever it is."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    names: list


class TrackFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> TrackWriter:
        return TrackWriter(self.options["path"], self.options["staging"], self.options["backup"])


class TrackWriter(DataSourceWriter):
    """Rows (name, place, line) in order of name and place; the line with the least place is the head, an object without frames."""

    def __init__(self, path: str, staging: str, backup: str):
        self.path, self.staging, self.backup = path.rstrip("/"), staging, backup

    def write(self, rows) -> Written:
        system, folder = _opened(self.path)
        at, out, names, first = None, None, [], True
        task = uuid.uuid4().hex  # a task that is tried again writes files of its own
        system.create_dir(f"{folder}/{self.staging}", recursive=True)

        def close() -> None:
            if out is not None:
                out.write(b"\n]}\n")
                out.close()

        for row in rows:
            if row["name"] != at:
                close()
                at, first = row["name"], True
                staged = f"{self.staging}/{task}-{len(names)}"
                names.append((at, staged))
                out = system.open_output_stream(f"{folder}/{staged}")
                head = row["line"].strip()
                out.write((head[:-1] + (", " if len(head) > 2 else "") + '"frames": [').encode())
                continue
            out.write((("\n" if first else ",\n") + row["line"]).encode())
            first = False
        close()
        return Written(names)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, folder = _opened(self.path)
        for name, staged in (x for m in messages if m is not None for x in m.names):
            target = f"{folder}/{name}.json"
            if system.get_file_info(target).type != fs.FileType.NotFound:
                system.move(target, f"{target}.{self.backup}")
            system.move(f"{folder}/{staged}", target)
        system.delete_dir(f"{folder}/{self.staging}")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, folder = _opened(self.path)
        if system.get_file_info(f"{folder}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.staging}")


def write_track_files(runs: DataFrame, frames: DataFrame, path: str, name: str = "clip", frame: str = "frame", backup: str | None = None) -> str:
    """A file ``<name>.json`` for each run in the folder ``path``: the run's facts, then its frames in order. runs: a row each, name and
    any facts; frames: name, frame and any fields, a row a frame. A file that is there is moved to ``<name>.json.<ending>``; returns the
    ending."""
    spark = runs.sparkSession
    ship(spark)
    spark.dataSource.register(TrackFiles)
    ending = backup or f"bak-{uuid.uuid4().hex[:8]}"
    heads = runs.select(F.col(name).cast("string").alias("name"), F.lit(None).cast("int").alias("place"), F.to_json(F.struct(*runs.columns)).alias("line"))
    fields = [c for c in frames.columns if c not in (name, frame)]
    lines = frames.select(F.col(name).cast("string").alias("name"), F.col(frame).cast("int").alias("place"), F.to_json(F.struct(F.col(frame).alias("frame"), *fields)).alias("line"))
    lines = lines.join(heads.select("name"), "name", "left_semi")
    rows = heads.unionByName(lines).repartition("name").sortWithinPartitions("name", F.asc_nulls_first("place"))
    rows.write.format(FORMAT).mode("append").option("path", path).option("staging", f"_staging-{uuid.uuid4().hex}").option("backup", ending).save()
    return ending


def read_track_frames(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """name, and ``fields`` (a schema that begins with ``frame int``) of every frame of the files of :func:`write_track_files` in a folder; long files
    are split by lines."""
    lines = spark.read.option("pathGlobFilter", "*.json").text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1).alias("name"), F.rtrim(F.col("value"), F.lit(",")).alias("line"))
    # a head's line ends where its frames begin
    return lines.where("line like '{\"frame\":%'").select("name", F.from_json("line", fields).alias("f")).select("name", "f.*")
