"""The corpus pipeline: quality classifier, toxicity, near-dedup, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents, and further ones as they are.

Nulls: a null text is an empty one to every stage; it weighs 0, isn't toxic, is no copy, stays null when masked, and
packs as the end id alone. A null doc_id is judged like any other, is no copy, and stays null. Repeated rows of one
doc_id fare alike until near_dedup, which keeps one of them; rows of one doc_id with unlike texts are judged apart. Ties
go as each operator says. Very long texts are read whole. An empty table gives an empty result at every stage, and
further columns with any names pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import importance, neardup, packing, pii, toxicity
from tessera.llm.common import release, shared_dir, table, tables_written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    return importance.sample(docs, table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored toxic go."""
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id; a row goes by its id and its text."""
    return neardup.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds; n_chars follows the text."""
    return pii.mask(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, with their sequences and offsets."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality_classifier), ("toxicity", toxic), ("near_dedup", near_dedup), ("pii", private), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written in the shared folder and read again.

    What a stage wrote for itself, and its input, go as soon as its result is stored.
    """
    docs = table(spark, sf_dir, "documents")
    folder, last = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", None
    for number, (name, stage) in enumerate(STAGES):
        before = tables_written()
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{number}-{name}")
            release(spark, before, last)
            docs, last = spark.read.parquet(path), path
    return docs
