"""A followed index: against one event after another, as a stream in any cut, after lost runs, with passes by the clock."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import keyed
from tessera.streaming import following as L
from tessera.streaming import telemetry

INDEX = "id long, path string, hash string, extra string"


def made(seed, n=60):
    """An index, events (path, dst, op, t) and what is at which path in the end."""
    r = random.Random(seed)
    index, events, there = [], [], {}
    for i in range(n):
        old, new, t = f"/old/{i}.jpg", f"/new/{i}.jpg", round(r.uniform(0, 40), 1)
        content, what = (f"h{i}" if i % 7 else "h0"), r.choice(["move", "apart", "chain", "gone", "back", "touch", "fresh", "twice", "none", "unread"])
        if i == 0:
            what = "none"  # the row that copies of it are matched with
        if what != "fresh":
            index.append((i, old, content, f"x{i}"))
        if what == "move":
            events.append((old, new, "moved", t))
            there[new] = content
        elif what == "apart":  # gone here, new there, within the grace or after it
            events += [(old, None, "deleted", t), (new, None, "created", round(t + r.choice([0.5, 2.0, 9.0]), 1))]
            there[new] = content
        elif what == "chain":
            events += [(old, "/mid" + old, "moved", t), ("/mid" + old, new, "moved", t + 0.4)]
            there[new] = content
        elif what == "gone":
            events.append((old, None, "deleted", t))
        elif what == "back":
            events += [(old, None, "deleted", t), (old, None, "created", t + 3)]
            there[old] = content
        elif what == "touch":
            events.append((old, None, "created", t))
            there[old] = content
        elif what == "fresh":
            events.append((new, None, "created", t))
            there[new] = "unknown"
        elif what == "twice":  # moved, then deleted there
            events += [(old, new, "moved", t), (new, None, "deleted", t + 8)]
        elif what == "unread":
            events.append((new, None, "created", t))  # was never there
    return index, sorted(events, key=lambda e: e[3]), there


def one_by_one(index, events, there, debounce=1.2, grace=5.0):
    """(path and staleness by id, counts of outcomes), one event after another with pending dues."""
    at = {i: [p, False] for i, p, _, _ in index}
    least = {}
    for i, _, h, _ in index:
        least[h] = min(i, least.get(h, i))
    pending, out, moved = {}, Counter(), {}

    def where(path):
        return min((i for i, (p, _) in at.items() if p == path), default=None)

    def settle(until):
        for due, _, path in sorted((d, o != "created", p) for p, (o, d, s) in pending.items() if d <= until):
            op, _, source = pending.pop(path)
            if op == "created":
                who, h = where(path), there.get(path)
                if h is None:
                    out["missing"] += 1
                elif who is not None:
                    out["done" if source and moved.get(who) == source else "relinked"] += 1
                    at[who][1] = False
                elif h in least:
                    out["matched"] += 1
                    at[least[h]] = [path, False]
                    moved.pop(least[h], None)
                else:
                    out["unknown"] += 1
            elif where(path) is not None and path not in there:
                out["stale"] += 1
                at[where(path)][1] = True
            else:
                out["kept"] += 1

    for path, dst, op, t in events:
        settle(t)
        if op == "moved":
            who = where(path)
            if who is not None and where(dst) is None and dst in there:
                out["relinked"] += 1
                at[who], moved[who] = [dst, False], path
            pending[path], pending[dst] = ("deleted", t + grace, None), ("created", t + debounce, path)
        else:
            pending[path] = (op, t + (debounce if op == "created" else grace), None)
    settle(float("inf"))
    return {i: tuple(v) for i, v in at.items()}, dict(out)


def table_of(spark, events):
    return spark.createDataFrame(events, "path string, dst_path string, op string, s double").withColumn("ts", F.timestamp_seconds("s"))


def state(df):
    return {r["id"]: (r["path"], r["stale"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_batch_is_what_one_event_after_another_gives(spark, tmp_path, seed):
    index, events, there = made(seed)
    L.create(str(tmp_path), spark.createDataFrame(index, INDEX), 4)
    start = keyed.read(spark, str(tmp_path))
    found = L.followed(start, table_of(spark, events), there.get)
    want, counts = one_by_one(index, events, there)
    assert {r["outcome"]: r["count"] for r in found.groupBy("outcome").count().collect()} == counts
    new = L.changed(start, found)
    assert {**state(start), **state(new)} == want
    assert all(r["extra"] == f"x{r['id']}" for r in new.collect())


def write(folder, n, events):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{n}", "w") as f:
        f.write("\n".join(json.dumps({"path": p, "dst_path": d, "op": o, "ts": f"2024-01-01T00:{int(t // 60):02d}:{t % 60:06.3f}Z"}) for p, d, o, t in events))
    os.rename(f"{folder}/.{n}", f"{folder}/{n}.json")


def test_a_stream_in_runs_ends_as_the_batch_does(spark, tmp_path):
    index, events, there = made(4)
    table = f"{tmp_path}/t"
    L.create(table, spark.createDataFrame(index, INDEX), 4)
    parts = [[e for e in events if 15 * k <= e[3] < 15 * (k + 1)] for k in range(4)] + [[("/end", None, "deleted", 100.0)], [("/end", None, "deleted", 200.0)]]
    for n, part in enumerate(parts):
        write(f"{tmp_path}/in", n, part)
        q = L.follow(spark, f"{tmp_path}/in", table, f"{tmp_path}/ck", resolve=there.get, live=False, partitions=4)
        q.awaitTermination(120)
        assert q.exception() is None
    want, counts = one_by_one(index, events, there)
    assert state(keyed.read(spark, table)) == want
    got = {r["outcome"]: r["files"] for r in L.totals(spark, table).collect()}
    got["kept"] -= 1  # /end
    assert {k: v for k, v in got.items() if v} == counts


def test_a_lost_batch_goes_on_and_one_that_comes_again_changes_nothing(spark, tmp_path, monkeypatch):
    index, events, there = made(5)
    table = str(tmp_path)
    L.create(table, spark.createDataFrame(index, INDEX), 4)
    rows = L.settled_moves(table_of(spark, events))
    upsert = keyed.upsert_batch
    monkeypatch.setattr(keyed, "upsert_batch", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        L.apply_batch(spark, table, rows, 0, there.get, None, 4)
    monkeypatch.setattr(keyed, "upsert_batch", upsert)
    for _ in range(2):
        L.apply_batch(spark, table, rows, 0, there.get, None, 4)
        want, counts = one_by_one(index, events, there)
        assert state(keyed.read(spark, table)) == want
        assert {r["outcome"]: r["files"] for r in L.totals(spark, table).collect()} == counts


def test_passes_by_the_clock(spark, tmp_path):
    table, folder = f"{tmp_path}/t", f"{tmp_path}/in"
    L.create(table, spark.createDataFrame([(1, "/a", "h1", ""), (2, "/b", "h2", ""), (3, "/c", "h3", ""), (4, "/d", None, "")], INDEX), 4)
    asked, there = [], {"/new/b": "h2", "/other": "h9"}

    def listing():
        asked.append(1)
        return spark.createDataFrame([("/a",), ("/new/b",), ("/other",)], "path string")

    # (seconds of the clock, passes so far): the start, the same hour after a restart, three hours later, and again
    for n, (now, so_far) in enumerate([(3600.0, 0), (3700.0, 0), (3600.0 * 4 + 5, 1), (3600.0 * 4 + 9, 1)]):
        write(folder, n, [("/end", None, "deleted", 100.0 * n)])
        q = L.follow(spark, folder, table, f"{tmp_path}/ck", listing, resolve=there.get, live=False, partitions=4, clock=lambda now=now: now)
        q.awaitTermination(120)
        assert q.exception() is None and len(asked) == so_far
    assert state(keyed.read(spark, table)) == {1: ("/a", False), 2: ("/new/b", False), 3: ("/c", True), 4: ("/d", True)}
    assert sorted(map(tuple, L.passes(spark, table).collect())) == [(1, 0, 0, 0), (4, 3, 1, 2)]
    L.pass_over(spark, table, listing(), 5, 18_000.0, there.get, 4)  # nothing is missing any more
    assert sorted(map(tuple, L.passes(spark, table).collect()))[-1] == (5, 0, 0, 0)
    L.pass_over(spark, table, listing(), 4, 15_000.0, there.get, 4)  # lost before its counts were written, taken up again
    assert sorted(map(tuple, L.passes(spark, table).collect()))[1] == (4, 3, 1, 2)
    with pytest.raises(ValueError):
        L.follow(spark, folder, table, f"{tmp_path}/ck", every=1)


def test_a_quiet_folder_settles(spark, tmp_path):
    """Nothing comes after the last event; the ticks move the watermark."""
    import datetime
    import time

    table, folder = f"{tmp_path}/t", f"{tmp_path}/in"
    L.create(table, spark.createDataFrame([(1, "/a.jpg", "h1", "")], INDEX), 4)
    os.makedirs(folder)
    q = L.follow(spark, folder, table, f"{tmp_path}/ck", resolve={"/b.jpg": "h1"}.get, partitions=4)
    try:
        now = datetime.datetime.now(datetime.timezone.utc).isoformat()
        with open(f"{folder}/.e", "w") as f:
            f.write(json.dumps({"path": "/a.jpg", "op": "deleted", "ts": now}) + "\n" + json.dumps({"path": "/b.jpg", "op": "created", "ts": now}))
        os.rename(f"{folder}/.e", f"{folder}/e.json")
        for _ in range(80):
            time.sleep(0.5)
            if state(keyed.read(spark, table)) == {1: ("/b.jpg", False)}:
                break
        assert state(keyed.read(spark, table)) == {1: ("/b.jpg", False)}
    finally:
        q.stop()


def test_awkward_rows(spark, tmp_path):
    L.create(str(tmp_path), spark.createDataFrame([(1, "/a.jpg", None, ""), (2, None, "h", "")], INDEX), 4)
    start = keyed.read(spark, str(tmp_path))
    events = [(None, None, "created", 1.0), ("", None, "deleted", 1.0), ("/a.jpg", None, "moved", 1.0), ("/a.jpg", "/a.jpg", "moved", 1.0), ("/a.jpg", None, "seen", 1.0), ("/n.txt", None, "created", 1.0), ("/n.jpg", None, "created", None), (None, "/x", "moved", 1.0)]
    there = {"/n.txt": "h", "/n.jpg": "h"}
    rows = L.followed(start, table_of(spark, events), there.get, kinds=["image"]).collect()
    assert [(r["path"], r["outcome"], r["id"]) for r in rows if r["path"] == "/n.txt"] == [("/n.txt", "unknown", None)]
    assert {r["path"] for r in rows} <= {"/n.txt", "/n.jpg"}
    assert L.followed(start, table_of(spark, events).limit(0), there.get).count() == 0


def test_counters_of_a_stream_that_was_lost_are_those_of_the_batch(spark, tmp_path):
    """One listener over three runs; the handler of a batch fails once, and the batch is run again."""
    import time

    actions = ["new", "duplicate", "new", "relink", "failed", "new", "new", None]
    for n in range(4):
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        with open(f"{tmp_path}/in/{n}.json", "w") as f:
            f.write("\n".join(json.dumps({"action": a}) for a in actions[2 * n : 2 * n + 2]))
        os.utime(f"{tmp_path}/in/{n}.json", (n + 1, n + 1))
    lost, ids = [], set()

    def handle(df, batch):
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch}")
        if batch == 2 and not lost:
            lost.append(batch)
            raise RuntimeError("lost")

    listener = telemetry.Counters(spark, f"{tmp_path}/counts")
    spark.streams.addListener(listener)
    try:
        assert telemetry.counter_totals(spark, f"{tmp_path}/counts").count() == 0
        for _ in range(2):
            stream = spark.readStream.schema("action string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
            q = telemetry.watched(stream).writeStream.foreachBatch(handle).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
            try:
                q.awaitTermination(120)
            except Exception:
                assert lost
            ids.add(str(q.id))
        rows, seen = telemetry.counted(spark.read.parquet(f"{tmp_path}/out"))
        rows.count()
        for _ in range(60):  # reports come after their batches
            got = {r["counter"]: r["value"] for r in telemetry.counter_totals(spark, f"{tmp_path}/counts", *ids).collect()}
            if got == seen.get:
                break
            time.sleep(0.5)
        assert lost and got == seen.get == {"rows": 8, "new": 4, "duplicate": 1, "relink": 1, "failed": 1}
    finally:
        spark.streams.removeListener(listener)
