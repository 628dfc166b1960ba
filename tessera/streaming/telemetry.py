"""Progress of ingest as observed metrics, of batches and of running streams, and a file sink for telemetry events."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ACTIONS = ("new", "duplicate", "relink", "failed")
COUNT = "batch long, name string, counter string, value long"


def counted(rows: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """``rows`` (with action) observed: how many were ingested, skipped, relinked and failed; no extra pass."""
    seen = Observation(name)
    return rows.observe(seen, *_counts(ACTIONS)), seen


def _counts(actions: tuple[str, ...]) -> list:
    return [F.count(F.lit(1)).alias("rows"), *(F.count(F.when(F.col("action") == a, 1)).alias(a) for a in actions)]


def watched(rows: DataFrame, name: str = "ingest", actions: tuple[str, ...] = ACTIONS) -> DataFrame:
    """A stream of rows (with action) whose counts a ``Counters`` listener gets with every batch; no extra pass.

    A batch is counted as it is computed: a handler that reads it twice persists it first.
    """
    return rows.observe(name, *_counts(actions))


class Counters(StreamingQueryListener):
    """Writes the observed metrics of running queries as they finish a batch (``spark.streams.addListener``).

    A batch has a folder of its own number, so that one that is run again after a loss counts once. Counts of a batch whose
    driver is lost between its commit and its report aren't written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [(p.batchId, name, counter, int(value)) for name, row in p.observedMetrics.items() for counter, value in row.asDict().items() if value is not None]
        if rows:
            self.spark.createDataFrame(rows, COUNT).coalesce(1).write.mode("overwrite").json(f"{self.path}/query={p.id}/of={p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def counter_totals(spark: SparkSession, path: str, query: str | None = None) -> DataFrame:
    """(name, counter, value) over all batches that ``Counters`` wrote, of one query (by its id) or of all."""
    try:
        rows = spark.read.schema(f"{COUNT}, query string, of long").json(path)
    except AnalysisException:  # nothing is written yet
        rows = spark.createDataFrame([], f"{COUNT}, query string, of long")
    return (rows.where(F.col("query") == query) if query else rows).groupBy("name", "counter").agg(F.sum("value").alias("value"))


def emit(events: DataFrame, path: str, checkpoint: str):
    """A stream of telemetry (ts, run_id, command, event, payload) written as JSON lines.

    A batch is written to a folder of its own number, which a replay of the batch writes anew.
    """
    write = lambda df, batch: df.write.mode("overwrite").json(f"{path}/batch={batch}")
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def relay(events: DataFrame, send, dropped: str, checkpoint: str, most: int = 256):
    """A stream of telemetry passed on to ``send`` (a function of a DataFrame and a batch number), ``most`` events a batch.

    What is over is dropped, oldest first kept, and counted in the table ``dropped``; the sender never holds up the stream's source.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        send(df.orderBy("ts").limit(most), number)
        df.agg(F.lit(number).alias("batch"), F.greatest(F.count("*") - most, F.lit(0)).alias("dropped")).write.mode("overwrite").json(f"{dropped}/batch={number}")
        df.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
