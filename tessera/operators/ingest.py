"""Ingest and maintenance as set operations on tables: deduplication, upserts, staleness, re-embedding, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dedup(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates (hash, path) as new, duplicate (known at this path) or relink (known elsewhere).

    Of candidates with one hash the first path is the one that counts as new. Hashes are reduced to their first path,
    and a known path is found by (hash, path), so that no task holds all copies of one file.
    """
    known = existing.groupBy("hash").agg(F.min("path").alias("known_path"))
    first = candidates.groupBy("hash").agg(F.min("path").alias("first_path"))
    here = existing.select("hash", "path", F.lit(True).alias("here")).distinct()
    # the same path twice in one run: the first row is new, the others are duplicates
    again = candidates.groupBy("hash", "path").agg(F.count("*").alias("times"))
    rows = again.join(here, ["hash", "path"], "left").join(known, "hash", "left").join(first, "hash")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    fresh = F.when((F.col("path") == F.col("first_path")) & (F.col("nth") == 1), "new").otherwise("duplicate")
    action = F.when(F.col("known_path").isNull(), fresh).when(F.col("here"), "duplicate").otherwise("relink")
    return rows.select("hash", "path", "known_path", action.alias("action"))


#: The key and the version of each stored table.
TABLES = {"images": ("id", "updated_at"), "videos": ("video_id", "updated_at"), "segments": ("segment_id", "updated_at"), "clusters": ("id", "updated_at"), "assignments": ("item_id", "assigned_at"), "collections": ("id", "last_accessed")}


def upsert_into(table: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """``upsert`` by the key and version of one of TABLES; creation times are kept where the table has them."""
    key, version = TABLES[table]
    return upsert(old, new, key, version, "created_at" if "created_at" in old.columns else None)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str, created: str | None = "created_at") -> DataFrame:
    """The latest row of each key; the earliest creation time stays. One shuffle on the key, with partial aggregates."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("row"), *([F.min(created).alias("first")] if created else []))
    out = latest.select(key, "row.*", *(["first"] if created else []))
    return out.withColumn(created, F.col("first")).drop("first") if created else out


def replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete and add: old rows without the new keys, and the new rows."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def version_mismatch(current: dict[str, object]) -> Column:
    """Whether any stored version differs from the current one; null counts as different."""
    return reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.lit(v)) for c, v in current.items()])


def fs_diff(rows: DataFrame, listing: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(id, path, reasons): what the listing says against stored inode, size and mtime; a stored 0 isn't checked."""
    seen = listing.select("path", F.col("inode").alias("i"), F.col("size").alias("s"), F.col("mtime").alias("m"), F.lit(True).alias("here"))
    j = rows.join(seen, "path", "left")
    reasons = F.concat_ws(
        ",",
        F.when(F.col("here").isNull(), "missing"),
        F.when((F.col("inode") != 0) & (F.col("inode") != F.col("i")), "inode"),
        F.when((F.col("size") != 0) & (F.col("size") != F.col("s")), "size"),
        F.when((F.col("mtime") != 0) & (F.abs(F.col("mtime") - F.col("m")) > tolerance), "mtime"),
    )
    return j.select("id", "path", reasons.alias("reasons")).where("reasons <> ''")


def reembed_targets(rows: DataFrame, payload: Column, stored_hash: str, versions: dict[str, object], stale: str = "is_stale") -> DataFrame:
    """Rows whose text vector must be made again, and why."""
    why = F.when(F.col(stale), "stale").when(version_mismatch(versions), "version").when(~F.sha2(payload, 256).eqNullSafe(F.col(stored_hash)), "payload")
    return rows.withColumn("why", why).where("why is not null")


def reembed_images(rows: DataFrame, listing: DataFrame, versions: dict[str, object], stale: str = "is_stale") -> DataFrame:
    """Rows whose image vector must be made again, and why; files (path, hash) that are gone can't be embedded."""
    here = listing.select("path", F.col("hash").alias("found_hash"))
    why = F.when(F.col(stale), "stale").when(version_mismatch(versions), "version").when(~F.col("clip_content_hash").eqNullSafe(F.col("found_hash")), "content")
    return rows.join(here, "path").withColumn("why", why).where("why is not null").drop("found_hash")


def pending_notes(notes: DataFrame, manifest: DataFrame, model: str) -> DataFrame:
    """Notes (path, hash) that the manifest doesn't have for this model and hash."""
    return notes.join(manifest.where(F.col("embed_model") == model), ["path", "hash"], "left_anti")


def note_vectors(old: DataFrame | None, new: DataFrame, key: str = "path", vector: str = "embedding") -> DataFrame:
    """The vector table after new vectors came: old ones of another width are dropped, those of the same keys replaced."""
    if old is None:
        return new
    width = new.select(F.max(F.size(vector))).first()[0]
    if width is None:
        return old
    return replace(old.where(F.size(vector) == width), new, key)


def batches(rows: DataFrame, size: int, group: str, *order: str, slices: int = 64) -> DataFrame:
    """``batch``: number of each row's micro-batch within its group, in order of ``order``.

    Rows are numbered by slices of the order (by quantiles of its first column over all rows) to which the counts of
    earlier slices are added, so that a group of any size is spread over as many tasks.
    """
    marks = rows.select(F.percentile_approx(order[0], [i / slices for i in range(1, slices)])).first()[0] or []
    part = reduce(lambda a, b: a + b, [(F.col(order[0]) > F.lit(m)).cast("int") for m in dict.fromkeys(marks)], F.lit(0))
    sliced = rows.withColumn("slice_", part)
    counts = sliced.groupBy(group, "slice_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(group).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.row_number().over(Window.partitionBy(group, "slice_").orderBy(*order)) + F.col("before_")
    numbered = sliced.join(counts.select(group, "slice_", before.alias("before_")), [group, "slice_"])
    return numbered.withColumn("batch", F.floor((n - 1) / size)).drop("slice_", "before_")


def progress(rows: DataFrame, every: int, run: str, order: str) -> DataFrame:
    """(run, done, new, duplicate, relink, failed): the counters of each run (rows with action) after every ``every`` rows."""
    count = lambda a: F.count(F.when(F.col("action") == a, 1)).alias(a)
    kinds = ("new", "duplicate", "relink", "failed")
    by = batches(rows, every, run, order).groupBy(run, "batch").agg(F.count("*").alias("done"), *map(count, kinds))
    so_far = Window.partitionBy(run).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return by.select(run, *[F.sum(c).over(so_far).alias(c) for c in ("done", *kinds)])


def counters(parts: list[DataFrame]) -> DataFrame:
    """One row of counters of an ingest of several media kinds; each part has rows with action, and counts add up."""
    count = lambda a: F.count(F.when(F.col("action") == a, 1)).alias(name[a])
    name = {"new": "ingested", "duplicate": "skipped", "relink": "relinked", "failed": "failed"}
    return reduce(DataFrame.unionByName, [p.select("action") for p in parts]).agg(*map(count, name))


def relinked(missing: DataFrame, found: DataFrame) -> DataFrame:
    """(id, old_path, new_path): missing rows whose content stands at another path; the first path wins."""
    first = found.groupBy("hash").agg(F.min("path").alias("new_path"))
    return missing.join(first, "hash").where("path <> new_path").select("id", F.col("path").alias("old_path"), "new_path")


def path_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added and removed watch paths."""
    added = after.join(before, "path", "left_anti").select("path", F.lit("added").alias("change"))
    return added.unionByName(before.join(after, "path", "left_anti").select("path", F.lit("removed").alias("change")))
