"""File events: debounce of creations, grace before deletions, moves, and reconciliation.

Events are (path, dst_path, op, ts) with op created, deleted or moved. ``settled`` states the result over a closed
table of events; ``settle_stream`` keeps the same state per path in a stream, with event-time timers, so that a
replay from files ends in the same rows. An event that re-arms a path moves its due time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.tables import content_hash

DEBOUNCE, GRACE = 1.2, 5.0
STATE = "op string, ts double, due double, source string"
OUT = "path string, action string, at double, source string"


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def split_moves(events: DataFrame) -> DataFrame:
    """(path, op, t): a move is a deletion at its source and a creation at its target."""
    t = seconds(F.col("ts"))
    ends = F.when(F.col("op") == "moved", F.array(F.struct(F.col("path").alias("path"), F.lit("deleted").alias("op")), F.struct(F.col("dst_path").alias("path"), F.lit("created").alias("op")))).otherwise(
        F.array(F.struct(F.col("path").alias("path"), F.col("op").alias("op")))
    )
    return events.select(F.explode(ends).alias("e"), t.alias("t")).select("e.path", "e.op", "t")


def relinked_moves(events: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, old_path, new_path) of moves whose source is indexed (id, path) and whose target isn't, the last of each
    source; and the other events with their moves split."""
    moves = events.where("op = 'moved'").join(indexed.select("id", "path"), "path").join(indexed.select(F.col("path").alias("dst_path")), "dst_path", "left_anti")
    direct = moves.groupBy("id", F.col("path").alias("old_path")).agg(F.max_by("dst_path", F.struct("ts", "dst_path")).alias("new_path"))
    rest = events.join(direct.select(F.col("old_path").alias("path"), F.lit("moved").alias("op")), ["path", "op"], "left_anti")
    return direct, split_moves(rest)


def resolved(paths: DataFrame, resolve=None, path: str = "path") -> DataFrame:
    """``paths`` with the hash of their content, by ``resolve`` (a function of a path) in Arrow batches, or by reading each file in its task.

    A path without a file has a null hash.
    """
    run = F.pandas_udf(lambda s: s.map(resolve), "string") if resolve else content_hash
    return paths.withColumn("hash", run(F.col(path)))


def watch(spark, folder: str, handle, checkpoint: str, debounce: float = DEBOUNCE, grace: float = GRACE, lateness: str = "1 second", live: bool = True):
    """Follow a folder of event files (JSON lines of path, dst_path, op, ts): settled events go to ``handle``.

    ``live`` looks for new files every 200 milliseconds; else what is there is worked off and the stream ends.
    ``handle`` gets (rows of path, action, at; batch number).
    """
    events = spark.readStream.schema("path string, dst_path string, op string, ts timestamp").json(folder)
    ends = F.when(F.col("op") == "moved", F.array(F.struct(F.col("path").alias("path"), F.lit("deleted").alias("op")), F.struct(F.col("dst_path").alias("path"), F.lit("created").alias("op")))).otherwise(F.array(F.struct("path", "op")))
    split = events.select(F.explode(ends).alias("e"), "ts").select("e.path", "e.op", "ts")
    writer = settle_stream(split, debounce, grace, lateness).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="200 milliseconds") if live else writer.trigger(availableNow=True)).start()


def settled(events: DataFrame, debounce: float = DEBOUNCE, grace: float = GRACE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, action, at, and columns to ``keep``): creations that were quiet for ``debounce`` and deletions that nothing undid in ``grace``.

    At equal times a creation comes before a deletion.
    """
    order = Window.partitionBy("path").orderBy("t", F.when(F.col("op") == "created", 0).otherwise(1))
    rows = events.withColumn("next", F.lead("t").over(order))
    wait = F.when(F.col("op") == "created", F.lit(debounce)).otherwise(F.lit(grace))
    due = rows.withColumn("at", F.col("t") + wait).where(F.col("next").isNull() | (F.col("next") >= F.col("at")))
    return due.select("path", F.when(F.col("op") == "created", "ingest").otherwise("stale").alias("action"), "at", *keep)


def settle_stream(events: DataFrame, debounce: float = DEBOUNCE, grace: float = GRACE, lateness: str = "1 second") -> DataFrame:
    """The same as a stream (path, op, ts): one pending event a path, and a timer at its due time.

    Timers fire when the watermark passes them, so a replay ends with a later event of any path.
    """
    return settle_moves(events.withColumn("source", F.lit(None).cast("string")), debounce, grace, lateness).drop("source")


def settle_moves(events: DataFrame, debounce: float = DEBOUNCE, grace: float = GRACE, lateness: str = "1 second") -> DataFrame:
    """``settle_stream`` with the source of a creation that is the end of a move (path, op, source, ts).

    A row with op moved goes on at once, at its target and with its source; a tick only moves the watermark.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def emit(path: str, op: str, at: float, source: str | None) -> pd.DataFrame:
        action = {"created": "ingest", "moved": "move"}.get(op, "stale")
        return pd.DataFrame({"path": [path], "action": [action], "at": [at], "source": pd.Series([source], dtype=object)})

    def step(key, batches, state: GroupState):
        op, ts, due, source = state.get if state.exists else (None, None, None, None)
        if state.hasTimedOut:
            yield emit(key[0], op, due, source)
            state.remove()
            return
        rows = pd.concat(list(batches))
        rows = rows.assign(t=rows["ts"].astype("int64") / 1e9 if str(rows["ts"].dtype).endswith("[ns]") else rows["ts"].astype("datetime64[us]").astype("int64") / 1e6, late=(rows["op"] != "created"))
        for r in rows.sort_values(["t", "late"]).itertuples():
            if r.op == "moved":
                yield emit(key[0], r.op, r.t, r.source)
            if r.op not in ("created", "deleted"):
                continue
            if due is not None and r.t >= due:
                yield emit(key[0], op, due, source)
            op, ts, due, source = r.op, r.t, r.t + (debounce if r.op == "created" else grace), r.source if isinstance(r.source, str) else None
        if due is not None:
            state.update((op, ts, due, source))
            state.setTimeoutTimestamp(max(int(due * 1000), state.getCurrentWatermarkMs() + 1))

    marked = events.select("path", "op", "source", "ts").withWatermark("ts", lateness)
    return marked.groupBy("path").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def reconcile(indexed: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, path, action, new_path): what an hourly pass finds: relinked by content, or stale; the rest is as it was.

    indexed: id, path, hash; listing: path, hash. Content that isn't indexed is counted elsewhere and ignored here.
    """
    gone = indexed.join(listing.select("path"), "path", "left_anti")
    free = listing.join(indexed.select("path"), "path", "left_anti").groupBy("hash").agg(F.min("path").alias("new_path"))
    return gone.join(free, "hash", "left").select("id", "path", F.when(F.col("new_path").isNull(), "stale").otherwise("relink").alias("action"), "new_path")
