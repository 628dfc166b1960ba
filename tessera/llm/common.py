"""Shared plumbing: shared-folder tables, table readers, Arrow text buffers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = "8m"
PLACES = 1 << 26  # bits of a bitmap of ids: 8 MB


def bounded(spark: SparkSession) -> None:
    """Arrow batches of BATCH at most (one row where a row is larger): a session setting that all operators here run under.

    Batches are held off the heap, in the JVM and in Python, once for each running task.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a local one only where it is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tessera-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        named = _local[0]
    return named.rstrip("/")


_written: list[str] = []


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and any executor can reread it."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    return len(_written)


def release(spark: SparkSession, since: int = 0, *paths: str | None) -> int:
    """Delete ``paths`` and the tables ``written`` so far (but the first ``since``); for callers that have stored the results that read them."""
    gone = [*_written[since:], *filter(None, paths)]
    del _written[since:]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


_held: dict[str, object] = {}
_libc = ctypes.CDLL(None)


def held(name: str, make):
    """A Python worker's one large table, made when first asked for; it takes the place of any of another name."""
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Give the memory of the worker's table back to the system: workers live on from one stage to the next."""
    if _held:
        _held.clear()
        trim()


def trim() -> None:
    """Give memory that is free in this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def crc32_of_id(col: Column) -> Column:
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


def bounded_ids(labelled: DataFrame, bound: int) -> list[int]:
    """At most ``bound`` doc_ids, the first by a hash of the id: the same ones on every run and layout."""
    ids = labelled.where("doc_id is not null").select("doc_id").distinct()
    return [r[0] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()]


def among(docs: DataFrame, ids: DataFrame, text: str, key: str) -> DataFrame:
    """(key, text) of every row of ``docs`` whose key is a doc_id of ``ids``, by a join of any size.

    A bitmap of hashed ids, PLACES bits at most whatever their number, keeps most other texts out of the shuffle.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES)) + 1
    own = ids.select(F.col("doc_id").cast("long").alias("own")).where("own is not null").distinct()
    placed = own.select(place(F.col("own")).alias("place"))
    maps = placed.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).withColumn("place", place(F.col("key")))
    at = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    near = rows.withColumn("bucket", F.bitmap_bucket_number("place")).join(F.broadcast(maps), "bucket").where(F.getbit(byte, (at % 8).cast("int")) == 1)
    # ids are distinct; an inner join, as Spark puts a semi join before the bitmap and shuffles every text. The texts needn't be sorted
    return near.select("key", "text").join(own.hint("shuffle_hash"), F.col("key") == F.col("own")).select("key", "text")


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a whole Arrow text column (nulls empty) and its offsets, without a copy per row."""
    if texts.null_count:
        texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = 1 << 19):
    """(first row, end row) runs of a column of at most ``limit`` bytes, or one row."""
    if texts.null_count:
        texts = texts.fill_null("")
    sizes = np.asarray(pc.binary_length(texts.cast(pa.large_string())), np.int64)
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield first, i
            first, total = i, 0
        total += size
    if len(sizes):
        yield first, len(sizes)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(batch: pa.RecordBatch, more: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *(a for _, a in more)], [*batch.schema.names, *(n for n, _ in more)])
