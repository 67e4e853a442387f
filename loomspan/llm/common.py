"""Helpers that the operators share: tables in the shared folder, row keys, Arrow maps, linked groups."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.session import ship

BATCH_BYTES = 3 << 20  # of an Arrow batch that goes to a Python worker


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Only where that is
    unset and all runs on one machine (local mode, as in tests), a temporary folder takes its place."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read on from there: no recomputation, no lost lineage. With
    ``keep`` only :func:`deleted` deletes it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not keep:
        _WRITTEN.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomspan_path = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage; the same as :func:`written`, for rows that are small."""
    return written(df)


_WRITTEN: list[str] = []


def folder_for(spark: SparkSession, what: str) -> str:
    """The name of a new folder in the shared one, which goes with the written tables."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def _delete(spark: SparkSession, name: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(conf).delete(path, True)


def dropped(*tables: DataFrame | str) -> None:
    """Delete tables of :func:`written` or folders of :func:`folder_for` that nothing reads any more."""
    spark = SparkSession.active()
    for one in tables:
        path = one if isinstance(one, str) else one.__dict__.get("_loomspan_path")
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(spark, path)


def deleted(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of :func:`written`, kept or not."""
    path = df.__dict__["_loomspan_path"]
    if path in _WRITTEN:
        _WRITTEN.remove(path)
    _delete(spark, path)


def mark() -> int:
    """A point in time for :func:`forget_written`."""
    return len(_WRITTEN)


def forget_written(spark: SparkSession, since: int = 0, but: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables that this process wrote to the shared folder after :func:`mark` gave ``since``, when
    nothing reads them any more, except those in ``but``."""
    keep = {x.__dict__.get("_loomspan_path") for x in but}
    for path in _WRITTEN[since:]:
        if path not in keep:
            _WRITTEN.remove(path)
            _delete(spark, path)


_STAGE: list[str] = []


def stage_over() -> None:
    """Delete what the last :func:`stage` wrote on its way."""
    dropped(*_STAGE)
    _STAGE.clear()


def stage(make) -> DataFrame:
    """What ``make()`` gives, for a stage whose result is written before the next one begins: what the stage before it
    wrote on its way is deleted first. Tables of other queries stay."""
    stage_over()
    since = mark()
    out = make()
    _STAGE.extend(_WRITTEN[since:])
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list:
    """128 bits that tell rows apart by id and text; repeated rows share them, null ids have them too."""
    t = F.coalesce(F.col(text), F.lit("\u0000null"))
    return [F.xxhash64(F.col(doc_id), t).alias("_k1"), F.xxhash64(t, F.lit(7), F.col(doc_id)).alias("_k2")]


def carried(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row, _k1, _k2): whole rows as a struct, so that no column of theirs meets a name that an operator uses."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key(f"`{doc_id}`", f"`{text}`"))


def unpacked(columns: list[str], changed: dict | None = None) -> list:
    """The columns of ``_row`` again; ``changed`` replaces some of them."""
    return [(changed or {}).get(c, F.col("_row")[c]).alias(c) for c in columns]


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that go to Python workers, so that long texts don't fill a worker's
    memory, whatever the number of rows. The bound is the same for every operator and is set where the session has none that
    is lower. Also ships the package."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(name, None)
    if not have or not have.isdigit() or int(have) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


_CACHES: dict[str, list] = {}
_OWNER = [""]


def cache(owner: str, clear) -> None:
    """Say how to empty a table that a worker process keeps from task to task for an operator."""
    _CACHES.setdefault(owner, []).append(clear)


def claim(owner: str) -> None:
    """Empty the tables of all other operators: a worker process holds those of one at a time."""
    if _OWNER[0] != owner:
        for name, clears in _CACHES.items():
            if name != owner:
                for clear in clears:
                    clear()
        _OWNER[0] = owner
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # give the memory back, where the C library can
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def quiet_threads() -> None:
    """One thread per Python worker: Spark's tasks already fill the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def slices(batch, mb: float = 3.0, column: str = "text") -> Iterator:
    """Parts of an Arrow batch with at most ``mb`` MB of ``column`` each (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    data = batch.column(batch.schema.get_field_index(column))
    if data.nbytes <= mb * 1e6:
        yield batch
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + mb * 1e6, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def linked_groups(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected ``edges`` (a, b), the component being its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) until a round changes nothing; each round is
    written to the shared folder and the one before it deleted. The number of rounds grows with the logarithm of the longest
    chain. Minima are taken by pre-aggregated groupBy, so a node with very many links needs no task of its own.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        before, e = e, cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        dropped(before, large)
    roots = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def running_total(df: DataFrame, group: list[str], order: list, value: str, out: str, buckets) -> DataFrame:
    """Sum of ``value`` over earlier rows of the group, without a task per group.

    ``buckets`` is an integer column that rises with ``order``. Bucket sums are added up first (as many rows
    as there are buckets), then rows within each bucket, so that a group of any size is spread over tasks.
    """
    b = df.withColumn("_b", buckets)
    sums = b.groupBy(*group, "_b").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_bb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    on = F.col("_b") == F.col("_bb")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return b.join(sums, on).withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_b", "_bb", "_before", *[f"_g{i}" for i in range(len(group))])
