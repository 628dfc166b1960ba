"""Retrieval quality: precision, recall and hit rate at k, and regression gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_metrics(runs: DataFrame, relevant: DataFrame, p_at: int = 5, r_at: int = 10) -> DataFrame:
    """(mode, case_id, precision, recall, hit) of runs (mode, case_id, rank, id); precision divides by k.

    A case counts in every mode, also where a mode found nothing.
    """
    good = relevant.select("case_id", "id", F.lit(1).alias("good"))
    hits = runs.where(F.col("rank") <= max(p_at, r_at)).join(good, ["case_id", "id"]).groupBy("mode", "case_id").agg(
        F.sum((F.col("rank") <= p_at).cast("long")).alias("top"), F.sum((F.col("rank") <= r_at).cast("long")).alias("found")
    )
    cases = relevant.groupBy("case_id").agg(F.count("*").alias("n"))
    every = cases.crossJoin(F.broadcast(runs.select("mode").distinct()))  # a handful of modes
    rows = every.join(hits, ["mode", "case_id"], "left").na.fill(0, ["top", "found"])
    return rows.select("mode", "case_id", (F.col("top") / p_at).alias("precision"), (F.col("found") / F.col("n")).alias("recall"), (F.col("found") > 0).cast("long").alias("hit"))


def mode_metrics(cases: DataFrame) -> DataFrame:
    """Means by mode to four places; the average similarity too, where cases have one."""
    more = [F.round(F.avg("similarity"), 4).alias("similarity")] if "similarity" in cases.columns else []
    return cases.groupBy("mode").agg(
        F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("hit"), 4).alias("hit_rate"), F.sum(1 - F.col("hit")).cast("long").alias("failed"), F.count("*").alias("cases"), *more
    )


def with_similarity(cases: DataFrame, runs: DataFrame, at: int = 5) -> DataFrame:
    """``cases`` with the mean score of each list's first ``at`` results; 0 for an empty list."""
    mean = runs.where(F.col("rank") <= at).groupBy("mode", "case_id").agg(F.avg("score").alias("similarity"))
    return cases.join(mean, ["mode", "case_id"], "left").na.fill(0.0, ["similarity"])


def gates(metrics: DataFrame, floors: DataFrame, most_failed: dict[str, int] | None = None, least_cases: int = 0) -> DataFrame:
    """(mode, failures): what falls short of floors (mode, metric, floor); modes with too many failed cases or too few cases fail too."""
    long = metrics.unpivot(["mode"], ["precision", "recall", "hit_rate"], "metric", "value")
    short = long.join(F.broadcast(floors), ["mode", "metric"]).where("value < floor").select("mode", "metric")
    for mode, most in (most_failed or {}).items():
        own = metrics.where(F.col("mode") == mode)
        short = short.unionByName(own.where(F.col("failed") > most).select("mode", F.lit("failed_cases").alias("metric")))
        if least_cases:
            short = short.unionByName(own.where(F.col("cases") < least_cases).select("mode", F.lit("too_few_cases").alias("metric")))
    return short.groupBy("mode").agg(F.array_join(F.array_sort(F.collect_list("metric")), ",").alias("failures"))
