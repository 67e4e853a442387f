"""Token-ID output: ids ranked by frequency over the whole corpus, in byte-aligned variable-length codes
whose lengths stand apart in control bytes (two bits a value, four values a byte), read back by numpy table
lookup.

``write`` encodes every text, appends an end id, counts the ids over all documents, gives the most frequent
id rank 0, and writes shards in ascending document order; ``read`` decodes them. A shard is a file::

    b"LSTK0001" | u32 documents | u64 ids | u32 entries of the rank table | u64 data bytes
    i64 doc_id per document | u8 1 if doc_id is null | u32 ids per document
    u32 id per rank | control bytes | data bytes

all little-endian. A task writes each of its shards under a new name and reports it in its result row, so a
task that runs again leaves a complete set of names. Shards hold a bounded number of ids (one document at
least), so neither side needs memory for a whole partition.

Edge cases: a null or empty text is a document of the end id alone; a very long text is encoded whole and is a shard of its own (up to
the 2 GB of ids that a row can hold, beyond which the job ends with an error); further columns, whatever their names, are ignored; documents are ordered by doc_id with
nulls last, rows of one id by their text's hash, and repeated rows are written as often as they occur; an
empty table gives no shard and an empty result.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import dropped, folder_for, row_key, running_total, slices, small_batches, written
from loomspan.llm.wordtable import default_vocabulary, word_table

TABLE_WORDS = 1_200_000  # remembered by a worker, about 200 MB
MAGIC = b"LSTK0001"
HEAD = struct.Struct("<8sIQIQ")
#: Lengths of the four codes of a control byte, and their sum.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    r = np.ascontiguousarray(ranks, "<u4")
    code = (r >= 1 << 8).astype(np.uint8) + (r >= 1 << 16) + (r >= 1 << 24)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The values of :func:`pack`: lengths by table lookup, then one gather for each byte of a code."""
    lens = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    starts = np.cumsum(lens) - lens
    out = np.zeros(n, np.uint32)
    if n:
        out |= raw[starts]
    for k in range(1, int(lens.max(initial=0))):
        has = np.flatnonzero(lens > k)
        out[has] |= raw[starts[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def shard_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, rank_of: np.ndarray, id_of: np.ndarray) -> bytes:
    control, data = pack(rank_of[ids])
    return b"".join([
        HEAD.pack(MAGIC, len(doc_ids), len(ids), len(id_of), len(data)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.asarray(counts, "<u4").tobytes(),
        np.asarray(id_of, "<u4").tobytes(),
        control,
        data,
    ])


def read_shard(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, all ids) of a shard."""
    magic, docs, n, ranks, size = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = HEAD.size
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    nulls = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs)
    counts = np.frombuffer(raw, "<u4", docs, at := at + docs)
    id_of = np.frombuffer(raw, "<u4", ranks, at := at + 4 * docs)
    at += 4 * ranks
    control = -(-n // 4)
    ids = id_of[unpack(raw[at : at + control], raw[at + control : at + control + size], n)] if n else np.zeros(0, "<u4")
    return [None if z else int(d) for d, z in zip(doc_ids, nulls)], counts, ids


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def encode_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, _k1, _k2, n_tokens, ids binary of little-endian unsigned 32-bit or 16-bit values, counts), and a row of
    each task with nothing but ``counts``: its ids and how often they occurred, 64-bit."""
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)
    names = ["doc_id", "_k1", "_k2", "n_tokens", "ids", "counts"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(1 << 16, np.int64)
        for whole in batches:
            for batch in slices(whole):
                words = word_table(path, TABLE_WORDS)
                ids, lens = words.texts(batch.column(3).to_pylist())
                kind = "<u2" if max(words.size, end_id + 1) <= 1 << 16 else "<u4"
                stops = np.cumsum(lens)
                flat = np.insert(ids, stops, end_id).astype(kind)
                offsets = np.concatenate([[0], stops + np.arange(1, len(stops) + 1)]).astype(np.int64)
                if offsets[-1] * flat.itemsize >= 1 << 31:
                    raise ValueError("a text has more ids than a row of Spark can hold (2 GB)")
                data = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer((offsets * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])
                seen = np.bincount(flat)
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[: len(seen)] += seen
                yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(lens + 1, pa.int64()), data, pa.nulls(len(lens), pa.binary())], names=names)
        at = np.flatnonzero(total)
        counts = np.stack([at, total[at]]).astype("<i8").tobytes()
        none = pa.nulls(1, pa.int64())
        yield pa.record_batch([none, none, none, none, pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())], names=names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", *row_key(), "text")
    return rows.mapInArrow(run, "doc_id long, _k1 long, _k2 long, n_tokens long, ids binary, counts binary")


def id_counts(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the counts that each task left in a row of its own."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0):
                at, n = np.frombuffer(raw.as_buffer(), "<i8").reshape(2, -1)
                yield pa.record_batch([pa.array(at), pa.array(n)], names=["id", "n"])

    return encoded.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 1, shard_ids: int = 4_000_000) -> DataFrame:
    """Write the shards below ``folder`` (by default in the session's shared folder) and return one row for
    each: shard (they ascend with the documents), path, n_docs, n_ids."""
    spark = docs.sparkSession
    folder = folder or folder_for(spark, "tokens")
    encoded = written(encode_ids(docs, doc_id, text, vocabulary, end_id))
    # as many rows as the vocabulary has ids, whatever the corpus
    ranked = id_counts(encoded).orderBy(F.desc("n"), "id").toPandas()
    id_of = ranked["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(id_of.max(initial=0)) + 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    tables = spark.sparkContext.broadcast((rank_of, id_of.astype(np.uint32)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        part, rank, ids_by_rank = TaskContext.get().partitionId(), *tables.value
        held, docs_held, counts, n, made = [], [], [], 0, 0

        def flush():
            nonlocal held, docs_held, counts, n, made
            name = f"shard-{part:06d}-{made:05d}-{uuid.uuid4().hex}.tok"
            with store.open_output_stream(posixpath.join(base, name)) as out:
                out.write(shard_bytes(docs_held, np.array(counts), np.concatenate(held), rank, ids_by_rank))
            row = pa.record_batch([pa.array([(part << 24) + made]), pa.array([name]), pa.array([len(docs_held)]), pa.array([n])], names=["shard", "name", "n_docs", "n_ids"])
            held, docs_held, counts, n, made = [], [], [], 0, made + 1
            return row

        for batch in batches:
            for d, size, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = raw.as_buffer()
                docs_held.append(d)
                counts.append(size)
                held.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * size else "<u4"))
                n += size
                if n >= shard_ids:
                    yield flush()
        if docs_held:
            yield flush()

    order = [F.asc_nulls_last("doc_id"), "_k1", "_k2"]
    sorted_docs = encoded.where("counts is null").drop("counts").repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")
    shards = sorted_docs.mapInArrow(run, "shard long, name string, n_docs long, n_ids long")
    out = written(shards.select("shard", F.concat(F.lit(folder + "/"), "name").alias("path"), "n_docs", "n_ids"))
    dropped(encoded)
    return out


def read(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32,
    and the ids where asked for."""
    spark: SparkSession = shards.sparkSession
    small_batches(spark)
    # files of a writing task are added up first, so what is summed in one place has a row for each of these tasks
    placed = running_total(shards, [], ["shard"], "n_ids", "first", F.shiftright("shard", 24)).select("path", "first")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = _filesystem(path)
                with store.open_input_stream(name) as f:
                    doc_ids, counts, ids = read_shard(f.read())
                ids = np.ascontiguousarray(ids, "<u4")
                ends = np.cumsum(counts, dtype=np.int64)
                cuts, raw = np.concatenate([[0], ends]).tolist(), memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
                for at in range(0, len(doc_ids), 4096):
                    part = slice(at, at + 4096)
                    columns = [pa.array(doc_ids[part], pa.int64()), pa.array(first + ends[part] - counts[part]), pa.array(counts[part].astype(np.int64)), pa.array(crc[part], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        offsets = np.array(cuts[at : at + len(columns[0]) + 1]) - cuts[at]
                        columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids[cuts[at] : cuts[at + len(columns[0])]].astype(np.int64))))
                        names.append("ids")
                    yield pa.record_batch(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    # a number of partitions is given as rows here are few and short, though the files aren't
    files = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return files.mapInArrow(run, schema)
