"""Readers: engine tables, notes, file listings, query fixtures; and the canonical views over them."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed extension lists by media kind.
MEDIA = {
    "image": [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff", ".heic"],
    "video": [".mp4", ".mov", ".avi", ".mkv", ".webm"],
    "audio": [".mp3", ".wav", ".m4a", ".aac"],
}


READ = 1 << 20  # bytes of a file in memory at a time
WHOLE = 64 << 20  # bytes up to which a file is one value

_own: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Where the setting is unset, as in tests, a temporary folder takes its place until the driver ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tessera-kept-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        folder = _own[0]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what comes later reads it and doesn't plan it again."""
    path = shared_path(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-text items: parts as (id, caption, summary, tags, category, path)."""
    part = load(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("caption"),
        F.concat_ws(" ", "p_brand", "p_type").alias("summary"),
        F.array("p_brand", "p_type").alias("tags"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("/media/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"),
        "p_size",
        "p_retailprice",
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def media_kind(path: Column) -> Column:
    """image, video, audio or other, by extension."""
    ext = extension(path)
    return reduce(lambda acc, kind: acc.when(ext.isin(MEDIA[kind]), kind), MEDIA, F.when(F.lit(False), "")).otherwise("other")


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for the whole string."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c in "*?":
            out += ".*" if c == "*" else "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += "\\" + c if c in r"\.^$+{}()|[]" else c
        i += 1
    return f"(?s)^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches the whole path or its last part."""
    name = F.element_at(F.split(path, "/"), -1)
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(p)) | name.rlike(glob_regex(p)) for p in patterns], F.lit(False))


def scan_files(spark: SparkSession, folder: str, kinds: list[str] | None = None, exclude: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """Path, size, modification time and media kind of files, sorted by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    rows = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), media_kind(F.col("path")).alias("kind"))
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    return rows.where(~excluded(F.col("path"), exclude or [])).orderBy("path")


def _digest(path: str | None) -> str | None:
    if path is None:
        return None
    plain = re.sub("^file:/+", "/", path)
    try:
        system, at = fs.FileSystem.from_uri(path) if "://" in plain else (fs.LocalFileSystem(), plain)
        digest = hashlib.sha256()
        with system.open_input_stream(at) as stream:
            while block := stream.read(READ):
                digest.update(block)
    except FileNotFoundError:
        return None
    return digest.hexdigest()


@F.pandas_udf(T.StringType())
def content_hash(paths: pd.Series) -> pd.Series:
    """SHA-256 of the content of files (paths or URIs that tasks can open), read in blocks: a file of any size takes READ bytes. Null for no file."""
    return paths.map(_digest)


def scan_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Path and SHA-256 of the content of files. Files over WHOLE bytes are read in blocks, the others as values of the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    small = files.where(F.col("length") <= WHOLE).select("path", F.sha2("content", 256).alias("sha256_hash"))
    return small.unionByName(files.where(F.col("length") > WHOLE).select("path", content_hash("path").alias("sha256_hash")))


def scan_notes(spark: SparkSession, folder: str, skip: tuple[str, ...] = (".git", ".obsidian", "node_modules", ".trash"), limit: int | None = None) -> DataFrame:
    """Markdown files whole, sorted by path, without those under a skipped folder."""
    notes = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder)
    notes = notes.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.sha2("value", 256).alias("hash"))
    notes = notes.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip)))).orderBy("path")
    return notes.limit(limit) if limit else notes


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON fixture ({"cases": [...]})."""
    return spark.read.json(path, multiLine=True, schema="cases array<struct<id:string,query:string,relevant_image_ids:array<string>,notes:string>>").select(F.explode("cases").alias("c")).select("c.*")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(mode, metric, floor) of a JSON fixture of floors by mode ({"modes": {mode: {metric: floor}}} or without "modes")."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    inner = F.coalesce(F.from_json(F.element_at("m", "modes"), "map<string,string>"), F.col("m"))
    by = raw.select(F.explode(inner).alias("mode", "floors")).select("mode", F.from_json("floors", "map<string,double>").alias("f"))
    floors = by.where("f is not null").select("mode", F.explode("f").alias("metric", "floor"))
    return floors.withColumn("metric", F.regexp_replace(F.regexp_replace("metric", "^min_", ""), "_at_[0-9]+$|@[0-9]+$", ""))


def scan_report(spark: SparkSession, paths: list[str], exclude: list[str] | None = None) -> DataFrame:
    """(target, path, kind, status): the files of each target, a file or a folder: ok, unsupported or excluded; missing targets too."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found, gone = [], []
    for target in paths:
        at = hadoop.Path(target)
        (found if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else gone).append(target)
    schema = "target string, path string, kind string, status string"
    out = spark.createDataFrame([(t, t, None, "missing") for t in gone], schema)
    for target in found:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target).select("path", media_kind(F.col("path")).alias("kind"))
        status = F.when(excluded(F.col("path"), exclude or []), "excluded").when(F.col("kind") == "other", "unsupported").otherwise("ok")
        out = out.unionByName(files.select(F.lit(target).alias("target"), "path", "kind", status.alias("status")))
    return out.orderBy("target", "path")
