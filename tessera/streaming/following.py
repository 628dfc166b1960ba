"""Files of an index followed through their events: direct moves, moves seen as content that is gone here and new there, and periodic passes.

State is kept for a path, and content meets the index in joins, so that files of one content, however many, aren't one task's.
An index has id (one for a path), path, hash, stale, came (the path of its last direct move) and at (when it last changed); other columns stay
as they are. Rows of one batch see the index as it was before the batch and what arrived and left in the batch, but for one thing: a
direct move counts also where a copy of the file took its row elsewhere earlier in the same batch.

What becomes of a row: ``relinked`` (a direct move, or a file that is back at its indexed path), ``matched`` (content that is
indexed elsewhere), ``done`` (the arrival of a direct move), ``unknown`` (content that isn't indexed, or a kind that isn't
followed; counted and ignored), ``missing`` (no file is there now), ``stale``, ``kept`` (nothing is indexed at a path that is
gone, or its file is there). Rows without a path, with another op, or moved to nowhere or to where they were are left out.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import keyed
from tessera.sources.tables import media_kind

from .file_events import DEBOUNCE, GRACE, resolved, seconds, settle_moves, settled
from .telemetry import watched

EVENT = "path string, dst_path string, op string, ts timestamp"
ARRIVED = ("relinked", "matched", "done")
PASS = "period long, missing long, resolved long, unresolved long"


def ends(events: DataFrame) -> DataFrame:
    """(path, op, source, ts): a move is itself at its target, a deletion at its source and a creation at its target."""
    end = lambda path, op, source: F.struct(path.alias("path"), F.lit(op).alias("op"), source.alias("source"))
    src, dst, none = F.col("path"), F.col("dst_path"), F.lit(None).cast("string")
    sound = F.when(F.col("op") == "moved", (dst != "") & (src != dst)).otherwise(F.col("op").isin("created", "deleted"))
    split = F.when(F.col("op") == "moved", F.array(end(dst, "moved", src), end(src, "deleted", none), end(dst, "created", src)))
    split = split.when(F.col("op") == "created", F.array(end(src, "created", none))).otherwise(F.array(end(src, "deleted", none)))
    return events.where((src != "") & sound).select(F.explode(split).alias("e"), "ts").select("e.*", "ts")


def settled_moves(events: DataFrame, debounce: float = DEBOUNCE, grace: float = GRACE) -> DataFrame:
    """(path, action, at, source) of a closed table of events: moves at once, and what creations and deletions settle to."""
    rows = ends(events).withColumn("t", seconds(F.col("ts")))
    moves = rows.where("op = 'moved'").select("path", F.lit("move").alias("action"), F.col("t").alias("at"), "source")
    return moves.unionByName(settled(rows.where("op <> 'moved'"), debounce, grace, ("source",)))


def outcomes(index: DataFrame, rows: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(path, action, at, source, outcome, id) of settled rows (path, action, at, source, hash; a null hash: no file).

    A direct move needs its source in the index and its target not; else its deletion and creation speak for it. A file is
    what is indexed at its path, unless that has left before; else what is indexed with its content, the least id of it.
    """
    at_path = index.groupBy("path").agg(F.min("id").alias("here"), F.min_by("came", "id").alias("came"), F.min_by("stale", "id").alias("was_stale"))
    of_hash = index.where("hash is not null").groupBy("hash").agg(F.min("id").alias("known"))
    fits = media_kind(F.col("path")).isin(kinds) if kinds else F.lit(True)
    rows = rows.select("path", "action", "at", "source", "hash", fits.alias("fits")).withColumn("there", F.col("hash").isNotNull())
    new = rows.where("action <> 'stale'").join(at_path, "path", "left").join(of_hash, "hash", "left")
    new = new.join(at_path.select(F.col("path").alias("source"), F.col("here").alias("mover")), "source", "left")
    direct = (F.col("action") == "move") & F.col("there") & F.col("here").isNull()
    new = new.withColumn("moved", F.when(direct, F.col("mover")))
    # the first direct move of a source in the batch; what follows goes by content
    first = new.where("moved is not null").groupBy("moved").agg(F.min(F.struct("at", "path", "source")).alias("m")).select("moved", "m.*")
    by_move = first.select(F.col("path"), F.col("source"), F.col("at").alias("moved_at"), F.col("moved").alias("mine"))
    new = new.drop("moved").join(by_move, ["path", "source"], "left")
    found = F.col("fits") & F.col("there") & (F.col("action") == "ingest")
    left = new.where(found & F.col("here").isNull() & F.col("mine").isNull() & F.col("known").isNotNull()).select(F.col("known").alias("here"), "at")
    left = left.unionByName(first.select(F.col("moved").alias("here"), "at")).groupBy("here").agg(F.min("at").alias("left_at"))
    new = new.join(left, "here", "left")
    own = F.col("here").isNotNull() & (F.col("left_at").isNull() | (F.col("left_at") > F.col("at")))
    through = F.col("mine").isNotNull() & (F.col("moved_at") <= F.col("at"))
    outcome = (
        F.when((F.col("action") == "move") & F.col("mine").isNotNull() & (F.col("moved_at") == F.col("at")), "relinked")
        .when(F.col("action") == "move", None)
        .when(~F.col("there"), "missing")
        .when(~F.col("fits"), "unknown")
        .when(through | (own & F.col("came").eqNullSafe(F.col("source")) & F.col("source").isNotNull() & ~F.col("was_stale")), "done")
        .when(own, "relinked")
        .when(F.col("known").isNotNull(), "matched")
        .otherwise("unknown")
    )
    id_ = F.when(F.col("outcome").isin("relinked", "done"), F.coalesce(F.when(through, F.col("mine")), F.col("here"))).when(F.col("outcome") == "matched", F.col("known"))
    new = new.withColumn("outcome", outcome).where("outcome is not null").withColumn("id", id_).select("path", "action", "at", "source", "outcome", "id")

    # where an id was, and until when; arrivals at one path in turn are one stay
    stays = new.where("id is not null").select("id", "path", "at").unionByName(index.select("id", "path", F.lit(float("-inf")).alias("at")))
    turn = Window.partitionBy("id").orderBy("at", "path")
    stays = stays.withColumn("change", ~F.lag("path").over(turn).eqNullSafe(F.col("path"))).where("change")
    stays = stays.withColumn("until", F.coalesce(F.lead("at").over(turn), F.lit(float("inf"))))
    gone = rows.where("action = 'stale'")
    at_risk = gone.where("not there").join(stays.select("id", "path", F.col("at").alias("since"), "until"), "path").where("since <= at and at < until")
    hit = at_risk.groupBy("path", "at").agg(F.min("id").alias("id"))
    gone = gone.join(hit, ["path", "at"], "left").select("path", "action", "at", "source", F.when(F.col("id").isNull(), "kept").otherwise("stale").alias("outcome"), "id")
    return new.unionByName(gone)


def changed(index: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the index that outcomes change: the last arrival or staleness of an id counts, at equal times the staleness."""
    last = F.struct(F.col("at"), (F.col("outcome") == "stale").alias("stale"), F.col("path"), F.when(F.col("outcome").isin("relinked", "done"), F.col("source")).alias("came"))
    new = found.where(F.col("outcome").isin(*ARRIVED, "stale")).groupBy("id").agg(F.max(last).alias("_new"))
    put = {c: F.col(f"_new.{c}") for c in ("path", "stale", "came", "at")}
    both = index.join(new, "id")
    return both.select(*[put[c].alias(c) if c in put else F.col(c) for c in index.columns])


def followed(index: DataFrame, events: DataFrame, resolve=None, debounce: float = DEBOUNCE, grace: float = GRACE, kinds: list[str] | None = None) -> DataFrame:
    """The outcomes of a closed table of events (path, dst_path, op, ts) in one batch."""
    return outcomes(index, resolved(settled_moves(events, debounce, grace), resolve), kinds)


def pass_over(spark: SparkSession, table: str, listing: DataFrame, period: int, now: float, resolve=None, partitions: int = 64) -> None:
    """A pass over the index: rows whose path isn't in ``listing`` (path) are relinked by content or stale; its counts are kept.

    Only files at paths that aren't indexed are hashed, and none where nothing is missing. Of a content the first path
    goes to all of its rows. A pass that was lost is finished with what it had found.
    """
    at, batch = f"{table}/found/of={period}", -1 - period
    if not keyed.committed(spark, table, batch):
        index = keyed.read(spark, table)
        paths = listing.select("path").distinct()
        gone = index.where("not stale").join(paths, "path", "left_anti").select("id", "hash")
        found = gone.select("id", F.lit(None).cast("string").alias("new_path"))
        if not gone.isEmpty():
            free = resolved(paths.join(index.select("path"), "path", "left_anti"), resolve)
            first = free.where("hash is not null").groupBy("hash").agg(F.min("path").alias("new_path"))
            found = gone.join(first, "hash", "left").select("id", "new_path")
        put = {"path": F.coalesce("new_path", "path"), "stale": F.col("new_path").isNull(), "at": F.lit(float(now)), "came": F.lit(None).cast("string")}
        rows = index.join(found, "id").select(*[put[c].alias(c) if c in put else F.col(c) for c in index.columns])
        rows.write.mode("overwrite").parquet(at)
        keyed.upsert_batch(table, spark.read.schema(rows.schema).parquet(at), "id", "at", batch, partitions, None)
    # what was written counts, also where a pass was lost after its upsert
    counts = spark.read.parquet(at).agg(F.count("*"), F.count(F.when(~F.col("stale"), 1)), F.count(F.when(F.col("stale"), 1))).first()
    spark.createDataFrame([(period, *counts)], PASS).coalesce(1).write.mode("overwrite").json(f"{table}/passes/of={period}")


def passes(spark: SparkSession, table: str) -> DataFrame:
    """(period, missing, resolved, unresolved) of the passes so far; the first, of the start, looked at nothing."""
    try:
        return spark.read.schema(PASS).json(f"{table}/passes").select("period", "missing", "resolved", "unresolved")
    except AnalysisException:  # none yet
        return spark.createDataFrame([], PASS)


def totals(spark: SparkSession, table: str) -> DataFrame:
    """(outcome, files) over all batches; a batch that comes again counts once."""
    return spark.read.parquet(f"{table}/outcomes").groupBy("outcome").agg(F.count("*").alias("files"))


def apply_batch(spark: SparkSession, table: str, rows: DataFrame, batch: int, resolve=None, kinds: list[str] | None = None, partitions: int = 64) -> None:
    """Apply settled rows (path, action, at, source) to the stored index. Outcomes are written before the index changes, and
    a batch that comes again goes on from them, so that its rows don't meet an index that they have changed."""
    at = f"{table}/outcomes/batch={batch}"
    if not keyed.committed(spark, f"{table}/followed", batch):
        hashed = f"{table}/hashed/batch={batch}"  # files are read once
        resolved(rows, resolve).write.mode("overwrite").parquet(hashed)
        outcomes(keyed.read(spark, table), spark.read.parquet(hashed), kinds).write.mode("overwrite").parquet(at)
        keyed.say(spark, f"{table}/followed", batch)
    keyed.upsert_batch(table, changed(keyed.read(spark, table), spark.read.parquet(at)), "id", "at", batch + 1, partitions, None)


def create(table: str, index: DataFrame, partitions: int = 64) -> None:
    """Store an index (id, path, hash and any other columns) to be followed."""
    rows = index.select("*", F.lit(False).alias("stale"), F.lit(None).cast("string").alias("came"), F.lit(0.0).alias("at"))
    keyed.upsert_batch(table, rows, "id", "at", 0, partitions, None)


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, listing=None, every: float = 3600.0, resolve=None, kinds: list[str] | None = None,
           debounce: float = DEBOUNCE, grace: float = GRACE, lateness: str = "1 second", live: bool = True, partitions: int = 64, clock=time.time):
    """Follow a folder of event files (JSON lines of path, dst_path, op, ts) into the stored index ``table``.

    ``live`` looks for files every 200 milliseconds, and a tick a second moves the watermark, so that what is due settles in a
    quiet folder too; else what is there is worked off and the stream ends. ``listing`` (a function that gives the present
    paths as a DataFrame) is asked once in each period of ``every`` seconds (60 at least). Periods are those of the clock
    and the last one is stored, so that a restart repeats none, and makes up in one pass for what passed in between. A
    ``telemetry.Counters`` listener gets what settled in every batch, under the name settled.
    """
    if every < 60:
        raise ValueError("every: at least 60 seconds")
    rows = ends(spark.readStream.schema(EVENT).json(folder))
    if live:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        null = F.lit(None).cast("string")
        rows = rows.unionByName(ticks.select(F.lit("").alias("path"), F.lit("tick").alias("op"), null.alias("source"), F.col("timestamp").alias("ts")))

    def step(df: DataFrame, batch: int) -> None:
        df = df.persist()
        if not df.isEmpty():
            apply_batch(spark, table, df, batch, resolve, kinds, partitions)
        df.unpersist()
        if listing is None:
            return
        now = clock()
        period, last = int(now // every), passes(spark, table).agg(F.max("period")).first()[0]
        if last is None:
            spark.createDataFrame([(period, 0, 0, 0)], PASS).coalesce(1).write.mode("overwrite").json(f"{table}/passes/of={period}")
        elif period > last:
            pass_over(spark, table, listing(), period, now, resolve, partitions)

    writer = watched(settle_moves(rows, debounce, grace, lateness), "settled", ("move", "ingest", "stale")).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="200 milliseconds") if live else writer.trigger(availableNow=True)).start()
