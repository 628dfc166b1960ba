"""Upserts by partition, corrections of many words, and the debounce of queries as a stream."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import conversation as V
from tessera.operators import ingest as G
from tessera.operators import keyed as K
from tessera.operators import spelling as P

ROW = "id long, v long, created_at long, x string"


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.select("id", "v", "created_at", "x").collect()), key=repr)


def test_an_upsert_rewrites_what_changes(spark, tmp_path):
    path = str(tmp_path)
    old = spark.createDataFrame([(i, 1, 10, "a") for i in range(200)] + [(None, 1, 10, "n")], ROW)
    assert len(K.upsert_batch(path, old, "id", "v", 1, 16)) == 16
    before = files(path)
    new = spark.createDataFrame([(3, 2, 11, "b"), (3, 3, 12, "c"), (900, 1, 9, "d"), (4, 0, 5, "old")], ROW)
    parts = K.upsert_batch(path, new, "id", "v", 2, 16)
    assert 1 <= len(parts) <= 3
    assert rows(K.read(spark, path)) == rows(G.upsert(old, new, "id", "v"))
    after = files(path)
    kept = {f for f in before if not any(f"part={p}/" in f for p in parts)}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert K.upsert_batch(path, new, "id", "v", 2, 16) == [] and files(path) == after
    assert K.upsert_batch(path, new.limit(0), "id", "v", 3, 16) == [] and rows(K.read(spark, path)) == rows(G.upsert(old, new, "id", "v"))


def test_a_lost_run_leaves_the_table_and_is_run_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    old = spark.createDataFrame([(i, 1, 10, "a") for i in range(50)], ROW)
    K.upsert_batch(path, old, "id", "v", 1, 4)
    new = spark.createDataFrame([(7, 2, 11, "b"), (8, 2, 11, "b"), (9, 2, 11, "b")], ROW)
    say = K._say

    def lost(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(K, "_say", lost)
    with pytest.raises(RuntimeError):
        K.upsert_batch(path, new, "id", "v", 2, 4)
    monkeypatch.setattr(K, "_say", say)
    assert rows(K.read(spark, path)) == rows(old)
    assert len(K.upsert_batch(path, new, "id", "v", 2, 4)) >= 1
    assert rows(K.read(spark, path)) == rows(G.upsert(old, new, "id", "v"))


def test_readers_beside_a_writer_and_what_is_out_of_use(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "KEEP", 2)
    path = str(tmp_path)
    old = spark.createDataFrame([(i, 1, 10, "a") for i in range(20)], ROW)
    K.upsert_batch(path, old, "id", "v", 0, 2)
    reader, want = K.read(spark, path), rows(old)  # its files are listed, none is read yet
    part = spark.createDataFrame([(3, 2, 10, "b")], ROW)
    K.upsert_batch(path, part, "id", "v", -5, 2)  # numbers needn't rise
    assert rows(reader) == want
    state = G.upsert(old, part, "id", "v")
    for n in range(1, 5):
        new = spark.createDataFrame([(3, 2 + n, 10, str(n))], ROW)
        K.upsert_batch(path, new, "id", "v", n, 2)
        state = G.upsert(state, new, "id", "v")
    assert rows(K.read(spark, path)) == rows(state)
    batches = {d.rsplit("batch=", 1)[1].split("/")[0] for d, _, names in os.walk(f"{path}/data") if "part=" in d and any(f.endswith(".parquet") for f in names)}
    assert batches == {"0", "2", "3", "4"}  # 0 still holds the other partition



def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return 2 * row[-1] / (len(a) + len(b))


def test_corrections_equal_to_all_pairs(spark):
    draw = random.Random(11)
    words = {"".join(draw.choice("abcd") for _ in range(draw.choice([3, 5, 6, 8, 12, 13, 16, 21]))) for _ in range(150)} | {"été", "aaaaaaaaaaaaaaaa"}

    def typo(w):
        for _ in range(draw.randint(0, 4)):
            i = draw.randrange(len(w))
            w = draw.choice([w[:i] + w[i + 1 :], w[:i] + draw.choice("abcdé") + w[i:]]) or "a"
        return w

    terms = {typo(w) for w in words} | {"aaaaaaaaaaa", "", "nothing"}
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in sorted(xs)] * 2 + [(None,)], f"{c} string")
    want = {(t, w): ratio(t, w) for t in terms for w in words if t and t != w and ratio(t, w) >= 0.8}
    got = {(r["term"], r["token"]): r["ratio"] for r in P.alike(frame(terms, "term"), frame(words, "token")).collect()}
    assert got == pytest.approx(want) and any(len(t) > 12 for t, _ in want) and any(len(t) < 12 < len(w) for t, w in want)
    best = {}
    for (t, w), r in want.items():
        if len(t) >= 5 and len(w) >= 3:
            best[t] = min(best.get(t, (0, "")), (-r, w))
    assert {r["term"]: (-r["ratio"], r["correction"]) for r in P.corrections(frame(terms, "term"), frame(words, "token")).collect()} == best


def test_debounce_of_a_stream(spark, tmp_path):
    draw = random.Random(2)
    typed = [(f"u{i % 4}", round(i * 0.13 + draw.random(), 3), draw.choice(["car", "cars", " car ", "bus", "a", "bike"])) for i in range(120)] + [("u1", 16.2, None)]
    typed = [t for i, t in enumerate(typed) if (t[0], t[1]) not in {(x[0], x[1]) for x in typed[:i]}]
    schema = "user_id string, s double, text string"
    batches = [typed[i : i + 20] for i in range(0, len(typed), 20)]  # in order but for a second
    batches[3].append(("u0", 0.001, "much too late"))
    batches += [[("sentinel", t, "end of it")] for t in (1000.0, 2000.0, 3000.0)]
    os.makedirs(f"{tmp_path}/in")
    for n, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{n}")
        (name,) = [f for f in os.listdir(f"{tmp_path}/{n}") if f.endswith(".parquet")]
        os.rename(f"{tmp_path}/{n}/{name}", f"{tmp_path}/in/{n}.parquet")
        os.utime(f"{tmp_path}/in/{n}.parquet", (n + 1, n + 1))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    at = lambda df: df.select("user_id", F.timestamp_micros((F.col("s") * 1_000_000 + 10**9).cast("long")).alias("ts"), "text")
    query = V.debounced_stream(at(stream), lateness="2 seconds").writeStream.format("memory").queryName("typed").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
    finally:
        query.stop()
    shown = lambda df: sorted((r["user_id"], r["ts"], r["text"]) for r in df.where("user_id <> 'sentinel'").collect())
    want = shown(V.debounced(at(spark.createDataFrame(typed, schema))))
    assert shown(spark.table("typed")) == want and len(want) > 10
