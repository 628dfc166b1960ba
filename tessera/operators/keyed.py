"""Stored tables by key: an upsert rewrites the partitions of its keys and leaves the files of the others alone.

A table is a folder with ``data`` (what each batch made of its partitions, by a hash of the key) and ``log``, whose line is what
commits a batch. Nothing that is being read is replaced: readers beside a writer see the table before the batch or after it, a
run that is lost on its way leaves the table as it was, and a batch that is committed changes nothing when it comes again. What a
commit put out of use is deleted KEEP commits later. A table has one writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import upsert

LOG = "seq long, batch long, parts array<int>"
KEEP = 16


def _log(spark: SparkSession, path: str) -> list[tuple[int, int, list[int]]]:
    """(seq, batch, parts) of the committed batches in the order of their commits; one row a batch."""
    try:
        rows = spark.read.schema(LOG).json(f"{path}/log").collect()
    except AnalysisException:  # nothing is written yet
        return []
    return sorted((r["seq"], r["batch"], r["parts"]) for r in rows)


def _say(spark: SparkSession, path: str, seq: int, batch: int, parts: list[int]) -> None:
    spark.createDataFrame([(seq, batch, parts)], LOG).coalesce(1).write.mode("append").json(f"{path}/log")


def committed(spark: SparkSession, path: str, batch: int) -> bool:
    return any(b == batch for _, b, _ in _log(spark, path))


def say(spark: SparkSession, path: str, batch: int, parts: list[int] | None = None) -> None:
    """Put a batch in the log of a folder."""
    _say(spark, path, 1 + max((s for s, _, _ in _log(spark, path)), default=0), batch, parts or [])


def _files(path: str, log: list, parts: list[int] | None = None) -> list[str]:
    """The folders that hold the partitions as the last commit left them."""
    last = {p: batch for _, batch, own in log for p in own}
    return [f"{path}/data/batch={batch}/part={p}" for p, batch in sorted(last.items()) if parts is None or p in parts]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as the last batch left it."""
    return spark.read.parquet(*_files(path, _log(spark, path)))


def upsert_batch(path: str, new: DataFrame, key: str, version: str, batch: int, partitions: int = 64, created: str | None = "created_at") -> list[int]:
    """Upsert the rows of a batch; the numbers of the partitions that were rewritten, none for a batch that is committed.

    The number of partitions is that of the table and stays. The latest row of a key counts; a null key is one key. New
    columns aren't taken into old files: a batch has the columns of the table.
    """
    spark = new.sparkSession
    log = _log(spark, path)
    if any(b == batch for _, b, _ in log):
        return []
    place = F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")
    parts = sorted(r["part"] for r in new.select(place.alias("part")).distinct().collect())  # as many as partitions
    old = _files(path, log, parts)
    before = spark.read.schema(new.schema).parquet(*old) if old else new.limit(0)
    if parts or not log:
        merged = upsert(before, new, key, version, created).select(*new.columns).withColumn("part", place)
        merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/batch={batch}")
    seq = 1 + max((s for s, _, _ in log), default=0)
    _say(spark, path, seq, batch, parts)
    _clear(spark, path, log, seq - KEEP)
    return parts


def _clear(spark: SparkSession, path: str, log: list, seq: int) -> None:
    """Delete what the commit ``seq`` put out of use."""
    own = next((parts for s, _, parts in log if s == seq), [])
    for gone in _files(path, [row for row in log if row[0] < seq], own):
        at = spark._jvm.org.apache.hadoop.fs.Path(gone)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
