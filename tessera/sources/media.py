"""Shapes of what media decoders give: frames of videos, transcripts, recognised text; and a cache keyed by content.

Decoders and models stay outside; a caller passes their output, or a function that makes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X

RECOGNISED = "array<struct<text:string,confidence:double,x:double,y:double,w:double,h:double>>"
SEGMENTS = "array<struct<start:double,end:double,text:string>>"


def cached(rows: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], key: str = "hash") -> DataFrame:
    """What ``compute`` makes of the rows, by content hash: known results are read from ``path``, new ones made and appended."""
    spark: SparkSession = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    asked = rows.dropDuplicates([key])
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        asked = asked.join(spark.read.parquet(path).select(key), key, "left_anti")
    compute(asked).write.mode("append").parquet(path)
    return rows.select(key).distinct().join(spark.read.parquet(path), key)


def frames(videos: DataFrame, fps: float = 0.5) -> DataFrame:
    """(video_id, frame, at): the times, in seconds, at which frames of videos (video_id, duration) are taken."""
    last = F.greatest(F.ceil(F.col("duration") * fps).cast("int") - 1, F.lit(0))
    return videos.where("duration > 0").select("video_id", F.explode(F.sequence(F.lit(0), last)).alias("frame")).withColumn("at", F.col("frame") / F.lit(fps))


def transcripts(rows: DataFrame, raw: str = "transcript") -> DataFrame:
    """(video_id, segment, start, end, text) of JSON transcripts; segments without text go."""
    parts = rows.select("video_id", F.posexplode(F.from_json(raw, SEGMENTS)).alias("segment", "s"))
    return parts.select("video_id", "segment", "s.start", "s.end", F.trim("s.text").alias("text")).where("text <> ''")


def text_blocks(rows: DataFrame, raw: str = "recognised") -> DataFrame:
    """``rows`` (width, height) with blocks (type, text, bbox, confidence) and their mean confidence.

    Recognisers give boxes as shares of the picture from its lower left corner; blocks have pixels from the upper left.
    """
    width, height = F.col("width"), F.col("height")
    known = F.filter(F.transform(F.from_json(raw, RECOGNISED), lambda b: b.withField("text", F.trim(b["text"]))), lambda b: b["text"] != "")

    def block(b: Column) -> Column:
        box = F.array(b["x"] * width, (1 - (b["y"] + b["h"])) * height, (b["x"] + b["w"]) * width, (1 - b["y"]) * height)
        return F.struct(X.block_type(b["text"]).alias("type"), b["text"].alias("text"), F.transform(box, lambda v: F.round(v, 2)).alias("bbox"), F.round(F.coalesce(b["confidence"], F.lit(0.0)), 4).alias("confidence"))

    return rows.withColumn("blocks", F.coalesce(F.transform(known, block), F.array())).withColumn("confidence", mean_confidence(F.coalesce(known, F.array())))


def mean_confidence(blocks: Column) -> Column:
    """Mean confidence of blocks to four places; 0 without any."""
    total = F.aggregate(blocks, F.lit(0.0), lambda a, b: a + F.coalesce(b["confidence"], F.lit(0.0)))
    return F.when(F.size(blocks) > 0, F.round(total / F.size(blocks), 4)).otherwise(0.0)
