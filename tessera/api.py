"""The verbs of the engine as plain functions over DataFrames; everything else is reached through these."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.models import query_vector
from tessera.functions.text import label_cleanup
from tessera.operators.analytics import cluster_items, cluster_sizes, collection_filter, kmeans, page, timeline, timeline_stats  # noqa: F401
from tessera.operators.evalkit import case_metrics, gates, mode_metrics, with_similarity  # noqa: F401
from tessera.operators.ingest import counters, dedup, fs_diff, note_vectors, pending_notes, progress, reembed_images, reembed_targets, relinked, replace, upsert, upsert_into  # noqa: F401
from tessera.plans.chat import reply as chat  # noqa: F401
from tessera.plans.search import Index
from tessera.plans.search import batch as search_batch  # noqa: F401
from tessera.plans.search import build as build_index  # noqa: F401
from tessera.plans.search import compared as compare  # noqa: F401
from tessera.plans.search import explain, forced, log_search, run, search, store, stored  # noqa: F401
from tessera.sources.media import cached, frames, text_blocks, transcripts  # noqa: F401
from tessera.sources.tables import excluded, read_cases, read_thresholds, scan_files, scan_hashes, scan_notes, scan_report  # noqa: F401
from tessera.streaming.file_events import reconcile, relinked_moves, settle_stream, watch  # noqa: F401
from tessera.streaming.following import follow, followed, passes, totals  # noqa: F401
from tessera.streaming.following import create as follow_table  # noqa: F401
from tessera.streaming.telemetry import Counters, counter_totals, emit, relay, watched  # noqa: F401


def by_ids(rows: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """Rows of a short list of ids; the list is pushed to the scan."""
    return rows.where(F.col(key).isin(ids))


def presented(rows: DataFrame, least: float, limit: int, source=None) -> DataFrame:
    """Results at a least score (and of one source), best first, scores to four places."""
    if source is not None:
        rows = rows.where(F.col("source") == source)
    return rows.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(limit).withColumn("score", F.round("score", 4))


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, and new ones with keys that aren't there yet."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").dropDuplicates([key]))


def toggle(rows: DataFrame, key: str, value, flag: str) -> DataFrame:
    return rows.withColumn(flag, F.when(F.col(key) == value, ~F.col(flag)).otherwise(F.col(flag)))


COLLECTIONS = "id string, name string, query string, filters string, is_dynamic boolean, created_at timestamp, last_accessed timestamp"


def collection_create(rows: DataFrame, name: str, query: str, filters: dict | None = None) -> DataFrame:
    """The collections with a new one, or with another query for the one of this name."""
    new = rows.sparkSession.range(1).select(F.expr("uuid()").alias("id"), F.lit(name).alias("name"), F.lit(query).alias("query"), F.lit(json.dumps(filters or {})).alias("filters"), F.lit(True).alias("is_dynamic"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("last_accessed"))
    return rows.where(F.col("name") != name).unionByName(new)


def collection_list(rows: DataFrame) -> DataFrame:
    return rows.orderBy("name")


def collection_delete(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("name") != name)


def collection_eval(rows: DataFrame, name: str, items: DataFrame, ts: str | None = "created_at") -> DataFrame:
    """The items of a saved collection; none if there is no such one."""
    saved = rows.where(F.col("name") == name).select("query").first()
    if saved is None:
        return items.limit(0)
    return items.where(collection_filter(saved["query"], "tags", ts, [c for c in ("caption", "summary", "ocr_structured") if c in items.columns], "category"))


def paths_add(rows: DataFrame, path: str) -> DataFrame:
    """Watched or excluded paths (path, enabled) with one more; one that is there stays as it is."""
    return insert_or_ignore(rows, rows.sparkSession.createDataFrame([(path, True)], "path string, enabled boolean"), "path")


def paths_remove(rows: DataFrame, path: str) -> DataFrame:
    return rows.where(F.col("path") != path)


def paths_list(rows: DataFrame, enabled: bool | None = None) -> DataFrame:
    return (rows if enabled is None else rows.where(F.col("enabled") == enabled)).orderBy("path")


def rescan(spark, paths: DataFrame, indexed: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """What a pass over all enabled paths finds: new, duplicate and relinked files, by content; paths are few by meaning."""
    targets = [r["path"] for r in paths_list(paths, True).collect()]
    found = [scan_hashes(spark, t) for t in targets]
    if not found:
        return dedup(indexed.select("hash", "path").limit(0), indexed)
    files = reduce(DataFrame.unionByName, found).distinct().where(~excluded(F.col("path"), exclude or []))
    return dedup(files.select(F.col("sha256_hash").alias("hash"), "path"), indexed)


def evaluate(index: Index, cases: DataFrame, embedder: str, modes: tuple[str, ...] = ("clip", "text", "hybrid"), k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Runs (mode, case_id, rank, id, score) of labelled cases (id, query, relevant_image_ids) in every forced mode, and the
    metrics by mode. A fixture has a few dozen cases; each is a search of its own."""
    runs = []
    for case in cases.select("id", "query").collect():
        vector = list(query_vector(embedder, case["query"]))
        for mode in modes:
            rows = forced(index, case["query"], vector, mode, k)
            runs.append(rows.select(F.lit(mode).alias("mode"), F.lit(case["id"]).alias("case_id"), "rank", F.col("id").cast("string").alias("id"), "score"))
    every = reduce(DataFrame.unionByName, runs)
    relevant = cases.select(F.col("id").alias("case_id"), F.explode("relevant_image_ids").alias("id"))
    return every, mode_metrics(with_similarity(case_metrics(every, relevant), every))


def cluster_labels(clusters: DataFrame, items: DataFrame, assignments: DataFrame, label: Callable[[Column], Column], most: int = 5) -> DataFrame:
    """Clusters with a label made of the captions of their ``most`` innermost items; ``label`` is a model as a Column builder."""
    near = assignments.withColumn("nth", F.row_number().over(Window.partitionBy("cluster_id").orderBy("distance", "item_id"))).where(F.col("nth") <= most)
    texts = near.join(items.select(F.col("id").alias("item_id"), "caption"), "item_id").groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "caption"))), lambda x: x["caption"]).alias("captions"))
    return clusters.join(texts.select(F.col("cluster_id").alias("id"), label_cleanup(label(F.col("captions"))).alias("topic_label")), "id", "left")


def attach_segments(rows: DataFrame, segments: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Each result with the last of its segments, or none."""
    last = segments.groupBy(key).agg(F.max_by(F.struct(*[c for c in segments.columns if c != key]), order).alias("last"))
    return rows.join(last.select(key, "last.*"), key, "left")


def top_two(rows: DataFrame) -> DataFrame:
    """The pair of best results of each list that has two."""
    pair = rows.where("rank <= 2").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("id"))).alias("second"))
    return pair.where("second is not null")


def context_lens(rings: dict[str, DataFrame], order: dict[str, list[Column]]) -> DataFrame:
    """(ring, id, place) of several rings of neighbours; each ring is a short list."""
    parts = [df.withColumn("place", F.row_number().over(Window.orderBy(*order[name])).cast("long")).select(F.lit(name).alias("ring"), "id", "place") for name, df in rings.items()]
    return reduce(DataFrame.unionByName, parts)


def log_activity(spark, path: str, kind: str, details: dict) -> None:
    """Append one activity to the log."""
    row = spark.range(1).select(F.lit(kind).alias("type"), F.to_json(F.create_map(*[F.lit(str(x)) for kv in details.items() for x in kv]) if details else F.create_map()).alias("details"), F.current_timestamp().alias("timestamp"))
    row.write.mode("append").parquet(path)
