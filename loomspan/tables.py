"""Tables that a query writes on its way to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where that is unset and all runs on one machine, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once: written as Parquet to the shared folder and read from there, so a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, what: str) -> str:
    """The name of a new folder in the shared one, which goes with the tables."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _KEPT.append(path)
    return path


def forget(spark: SparkSession) -> None:
    """Delete the tables of :func:`kept`, when nothing reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _KEPT:
        path = jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        path.getFileSystem(conf).delete(path, True)
