"""File events: the stream and the batch statement end in the same rows; telemetry counts."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.streaming import file_events as W
from tessera.streaming import telemetry

EVENTS = [
    ("a", "deleted", 0.0),  # comes back within its grace
    ("a", "created", 3.0),
    ("b", "deleted", 0.0),  # stays away
    ("c", "created", 1.0),  # re-armed twice
    ("c", "created", 1.5),
    ("c", "created", 2.0),
    ("d", "created", 4.0),  # at equal times creation comes first
    ("d", "deleted", 4.0),
]
WANT = [("a", "ingest", 4.2), ("b", "stale", 5.0), ("c", "ingest", 3.2), ("d", "stale", 9.0)]


def rounded(rows):
    return sorted((r["path"], r["action"], round(r["at"], 3)) for r in rows)


def test_settled(spark):
    df = spark.createDataFrame(EVENTS, "path string, op string, t double")
    assert rounded(W.settled(df).collect()) == WANT


def test_moves(spark):
    e = spark.createDataFrame([("x", "y", "moved", 1.0), ("z", None, "created", 2.0)], "path string, dst_path string, op string, s double")
    rows = W.split_moves(e.withColumn("ts", F.timestamp_seconds("s"))).collect()
    assert sorted((r["path"], r["op"]) for r in rows) == [("x", "deleted"), ("y", "created"), ("z", "created")]


def test_stream_replay(spark, tmp_path):
    schema = "path string, op string, s double"
    for n, part in enumerate((EVENTS[:4], EVENTS[4:], [("sentinel", "created", 100.0)], [("sentinel", "created", 200.0)], [("sentinel", "created", 300.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{n}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        for f in os.listdir(f"{tmp_path}/{n}"):
            if f.endswith(".parquet"):
                os.rename(f"{tmp_path}/{n}/{f}", f"{tmp_path}/in/{n}.parquet")
                os.utime(f"{tmp_path}/in/{n}.parquet", (n + 1, n + 1))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = stream.select("path", "op", F.timestamp_seconds(F.col("s") + 1000).alias("ts"))
    q = W.settle_stream(stream).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    finally:
        q.stop()
    got = [(p, a, round(t - 1000, 3)) for p, a, t in rounded(spark.table("settled").collect()) if p != "sentinel"]
    assert got == WANT


def test_reconcile(spark):
    indexed = spark.createDataFrame([(1, "/a", "h1"), (2, "/b", "h2"), (3, "/c", "h3")], "id int, path string, hash string")
    listing = spark.createDataFrame([("/a", "h1"), ("/new/b", "h2"), ("/other", "h9")], "path string, hash string")
    rows = sorted(map(tuple, W.reconcile(indexed, listing).collect()))
    assert rows == [(2, "/b", "relink", "/new/b"), (3, "/c", "stale", None)]


def test_observed_counts(spark):
    df = spark.createDataFrame([("new",), ("new",), ("relink",)], "action string")
    rows, seen = telemetry.counted(df)
    assert rows.count() == 3
    assert seen.get == {"rows": 3, "new": 2, "duplicate": 0, "relink": 1, "failed": 0}


@pytest.mark.parametrize("empty", [True])
def test_empty(spark, empty):
    assert W.settled(spark.createDataFrame([], "path string, op string, t double")).count() == 0
