"""Registered queries: ingest, maintenance, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ingest as G
from tessera.sources.tables import excluded, load
from tessera.streaming import file_events as W
from tessera.streaming import following as L

from .registry import query

_DOCS = "c AS (SELECT doc_id, md5(text) AS hash, '/in/' || doc_id AS path FROM documents), x AS (SELECT hash, '/in/' || min(doc_id) AS path FROM (SELECT doc_id, md5(text) AS hash FROM documents WHERE doc_id % 3 = 0) GROUP BY hash)"


def _dedup(spark, sf) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("hash"), F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"))
    known = d.where("doc_id % 3 = 0").groupBy("hash").agg(F.min("doc_id").alias("i")).select("hash", F.concat(F.lit("/in/"), F.col("i").cast("string")).alias("path"))
    return G.dedup(d.select("hash", "path"), known)


@query(f"WITH {_DOCS}, r AS (SELECT c.path AS path, x.path AS known, row_number() OVER (PARTITION BY c.hash ORDER BY c.path) AS nth FROM c LEFT JOIN x USING (hash)) SELECT path, CASE WHEN known IS NULL THEN CASE WHEN nth = 1 THEN 'new' ELSE 'duplicate' END WHEN known = path THEN 'duplicate' ELSE 'relink' END AS action FROM r")
def dedup_actions(spark: SparkSession, sf: str) -> DataFrame:
    return _dedup(spark, sf).select("path", "action")


@query(f"WITH {_DOCS} SELECT c.path AS path, x.path AS known_path FROM c JOIN x USING (hash) WHERE c.path <> x.path")
def dedup_relink(spark: SparkSession, sf: str) -> DataFrame:
    return _dedup(spark, sf).where("action = 'relink'").select("path", "known_path")


@query("SELECT user_id, max(event_id) AS event_id, min(ts) AS created_at, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", "event_id", F.col("ts").alias("created_at"), "event_type")
    return G.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id").select("user_id", "event_id", "created_at", "event_type")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_brand END AS brand FROM part")
def vector_replace(spark: SparkSession, sf: str) -> DataFrame:
    old = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return G.replace(old, old.where("id % 5 = 0").withColumn("brand", F.lit("new")), "id")


@query("SELECT p_partkey AS id FROM part WHERE p_brand <> 'Brand#1' OR p_size <> 5")
def stale_versions(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").where(G.version_mismatch({"p_brand": "Brand#1", "p_size": 5})).select(F.col("p_partkey").alias("id"))


@query("SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'missing' END, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 = 0 AND o_custkey <> 0 THEN 'size' END) AS reasons FROM orders WHERE o_orderkey % 11 = 0 OR (o_orderkey % 7 = 0 AND o_custkey <> 0)")
def fs_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("path"), F.lit(0).alias("inode"), F.col("o_custkey").alias("size"), F.lit(1.0).alias("mtime"))
    listing = rows.where("id % 11 <> 0").select("path", F.lit(3).alias("inode"), F.when(F.col("id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.lit(1.005).alias("mtime"))
    return G.fs_diff(rows, listing).select("id", "reasons")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'stale' WHEN lang <> 'en' THEN 'version' ELSE 'payload' END AS why FROM documents WHERE doc_id % 10 = 0 OR lang <> 'en' OR doc_id % 4 = 0")
def reembed_targets(spark: SparkSession, sf: str) -> DataFrame:
    stored = F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.sha2("text", 256))
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", stored.alias("h"), (F.col("doc_id") % 10 == 0).alias("is_stale"))
    return G.reembed_targets(rows, F.col("text"), "h", {"lang": "en"}).select("id", "why")


@query("SELECT page_id AS id FROM pages WHERE page_id % 3 <> 0")
def manifest_skip(spark: SparkSession, sf: str) -> DataFrame:
    notes = load(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("hash"))
    manifest = notes.where("id % 3 = 0").select("path", "hash", F.lit("m").alias("embed_model")).unionByName(notes.where("id % 3 = 1").select("path", "hash", F.lit("other").alias("embed_model")))
    return G.pending_notes(notes, manifest, "m").select("id")


@query(r"SELECT page_id AS id, regexp_matches(url, 'example[.]net/') OR regexp_matches(regexp_extract(url, '[^/]*$'), '^[0-9][0-9].') AS excluded FROM pages")
def exclude_glob(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select(F.col("page_id").alias("id"), excluded(F.col("url"), ["*example.net/*", "[0-9][0-9]?*"]).alias("excluded"))


@query("SELECT event_id AS id, floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 24)::BIGINT AS batch FROM events")
def micro_batches(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    return G.batches(e, 24, "event_type", "id").select("id", F.col("batch").cast("long").alias("batch"))


@query("WITH h AS (SELECT doc_id, md5(text) AS hash FROM documents), f AS (SELECT hash, min(doc_id) AS n FROM h WHERE doc_id % 2 = 0 GROUP BY hash) SELECT doc_id AS id, '/new/' || f.n AS new_path FROM h JOIN f USING (hash) WHERE doc_id % 2 = 1")
def relink_missing(spark: SparkSession, sf: str) -> DataFrame:
    h = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"))
    missing = h.where("id % 2 = 1").withColumn("path", F.concat(F.lit("/old/"), F.col("id").cast("string")))
    first = h.where("id % 2 = 0").groupBy("hash").agg(F.min("id").alias("n")).select("hash", F.concat(F.lit("/new/"), F.col("n").cast("string")).alias("path"))
    return G.relinked(missing, first).select("id", "new_path")


@query("SELECT s_suppkey::VARCHAR AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'added' ELSE 'removed' END AS change FROM supplier WHERE s_suppkey % 6 NOT IN (0, 3)")
def watch_diff(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), "s_suppkey")
    before, after = s.where("s_suppkey % 2 = 1 OR s_suppkey % 3 = 0"), s.where("s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
    return G.path_changes(before.select("path"), after.select("path"))


@query(f"WITH {_DOCS}, r AS (SELECT c.path AS path, x.path AS known, row_number() OVER (PARTITION BY c.hash ORDER BY c.path) AS nth FROM c LEFT JOIN x USING (hash)), a AS (SELECT CASE WHEN known IS NULL THEN CASE WHEN nth = 1 THEN 'new' ELSE 'duplicate' END WHEN known = path THEN 'duplicate' ELSE 'relink' END AS action FROM r) SELECT (count(*) FILTER (action = 'new'))::BIGINT AS ingested, (count(*) FILTER (action = 'duplicate'))::BIGINT AS skipped, (count(*) FILTER (action = 'relink'))::BIGINT AS relinked, (SELECT count(*) FROM events WHERE event_type = 'error')::BIGINT AS failed FROM a")
def ingest_counters(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of an ingest of two kinds, which add up."""
    failed = load(spark, sf, "events").where("event_type = 'error'").select(F.lit("failed").alias("action"))
    return G.counters([_dedup(spark, sf), failed])


_ACTIONS = "CASE event_type WHEN 'click' THEN 'new' WHEN 'view' THEN 'duplicate' WHEN 'error' THEN 'failed' ELSE 'relink' END"


@query(f"WITH e AS (SELECT user_id % 7 AS run, {_ACTIONS} AS action, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) AS n FROM events), c AS (SELECT run, floor((n - 1) / 100) AS b, count(*) AS done, count(*) FILTER (action = 'new') AS new, count(*) FILTER (action = 'failed') AS failed FROM e GROUP BY 1, 2) SELECT run, (sum(done) OVER w)::BIGINT AS done, (sum(new) OVER w)::BIGINT AS new, (sum(failed) OVER w)::BIGINT AS failed FROM c WINDOW w AS (PARTITION BY run ORDER BY b)")
def progress_every(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of each run after every hundred rows."""
    e = load(spark, sf, "events").select((F.col("user_id") % 7).alias("run"), "event_id", F.expr(_ACTIONS).alias("action"))
    return G.progress(e, 100, "run", "event_id").select("run", "done", "new", "failed")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'stale' WHEN lang <> 'en' THEN 'version' ELSE 'content' END AS why FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 10 = 0 OR lang <> 'en' OR doc_id % 4 = 0)")
def reembed_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images whose vector must be made again; those whose file is gone can't be."""
    own = F.col("doc_id").cast("string")
    d = load(spark, sf, "documents").select("doc_id", "lang", own.alias("path"), F.sha2("text", 256).alias("hash"))
    rows = d.select(F.col("doc_id").alias("id"), "path", "lang", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("hash")).alias("clip_content_hash"), (F.col("doc_id") % 10 == 0).alias("is_stale"))
    return G.reembed_images(rows, d.where("doc_id % 7 <> 0").select("path", "hash"), {"lang": "en"}).select("id", "why")


@query("SELECT p_partkey AS id, 'a' || p_partkey AS old_path, 'c' || p_partkey AS new_path FROM part WHERE p_partkey % 4 = 0")
def moves_relinked(spark: SparkSession, sf: str) -> DataFrame:
    """Moves of indexed files to paths that aren't: the last target of each; moves of other files, and onto indexed ones, are split."""
    part = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("n"))
    path = lambda lead: F.concat(F.lit(lead), "n")
    indexed = part.where("id % 2 = 0").select("id", path("a").alias("path"))
    taken = part.select((F.col("id") + 10_000_000).alias("id"), path("t").alias("path"))
    moved = lambda rows, to, at: rows.select(path("a").alias("path"), path(to).alias("dst_path"), F.lit("moved").alias("op"), F.timestamp_seconds(F.lit(at)).alias("ts"))
    events = moved(part.where("id % 4 < 2"), "b", 1).unionByName(moved(part.where("id % 4 < 2"), "c", 2)).unionByName(moved(part.where("id % 4 = 2"), "t", 3))
    return W.relinked_moves(events, indexed.unionByName(taken))[0]


_EVENTS = "e AS (SELECT 'p' || (user_id % 40) AS path, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'created' END AS op, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events WHERE event_type IN ('error', 'signup')), n AS (SELECT *, t + CASE WHEN op = 'created' THEN 600 ELSE 3600 END AS due, lead(t) OVER (PARTITION BY path ORDER BY t, CASE WHEN op = 'created' THEN 0 ELSE 1 END) AS nxt FROM e)"
_SETTLED = f"WITH {_EVENTS} SELECT path, CASE WHEN op = 'created' THEN 'ingest' ELSE 'stale' END AS action, round(due, 3) AS \"at\" FROM n WHERE nxt IS NULL OR nxt >= due"


def _events(spark, sf) -> DataFrame:
    e = load(spark, sf, "events").where("event_type in ('error', 'signup')")
    return e.select(F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("path"), F.when(F.col("event_type") == "error", "deleted").otherwise("created").alias("op"), F.col("ts").cast("timestamp").alias("ts"))


@query(_SETTLED)
def grace_delete_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select("path", "op", W.seconds(F.col("ts")).alias("t"))
    return W.settled(rows, 600, 3600).select("path", "action", F.round("at", 3).alias("at"))


@query("WITH h AS (SELECT doc_id, md5(text) AS hash FROM documents), f AS (SELECT hash, min('/new/' || doc_id) AS p FROM h WHERE doc_id % 5 = 1 GROUP BY hash) SELECT doc_id AS id, CASE WHEN f.p IS NULL THEN 'stale' ELSE 'relink' END AS action FROM h LEFT JOIN f USING (hash) WHERE doc_id % 5 = 0")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    h = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"))
    own = F.concat(F.lit("/old/"), F.col("id").cast("string"))
    indexed = h.where("id % 5 <> 1").withColumn("path", own)
    listing = h.where("id % 5 > 1").select(own.alias("path"), "hash").unionByName(h.where("id % 5 = 1").select(F.concat(F.lit("/new/"), F.col("id").cast("string")).alias("path"), "hash"))
    return W.reconcile(indexed, listing).select("id", "action")


_FOLLOWED = """
WITH d AS (SELECT doc_id, doc_id % 5 AS what, 10.0::DOUBLE * doc_id AS t, md5(text) AS hash FROM documents),
x AS (SELECT hash, min(doc_id) AS known FROM d WHERE doc_id % 4 <> 3 AND hash IS NOT NULL GROUP BY hash),
e AS (SELECT d.*, x.known, coalesce(x.known = d.doc_id, false) AS own FROM d LEFT JOIN x USING (hash)),
fresh AS (SELECT known, t + 1.2 AS "at" FROM e WHERE known IS NOT NULL AND (what IN (2, 3) OR (what = 0 AND NOT own) OR (what = 4 AND NOT own))),
away AS (SELECT known, min("at") AS left_at FROM (SELECT * FROM fresh UNION ALL SELECT doc_id, t FROM e WHERE what = 0 AND own) GROUP BY known),
r AS (
  SELECT '/new/' || doc_id AS path, 'move' AS action, t AS "at", 'relinked' AS outcome, doc_id AS id FROM e WHERE what = 0 AND own AND hash IS NOT NULL
  UNION ALL
  SELECT CASE WHEN what = 4 THEN '/old/' ELSE '/new/' END || e.doc_id, 'ingest', t + 1.2,
    CASE WHEN hash IS NULL THEN 'missing' WHEN what = 0 AND own THEN 'done' WHEN what = 4 AND own AND (left_at IS NULL OR left_at > t + 1.2) THEN 'relinked' WHEN e.known IS NOT NULL THEN 'matched' ELSE 'unknown' END, e.known
  FROM e LEFT JOIN away ON away.known = e.known WHERE what <> 1
  UNION ALL
  SELECT '/old/' || e.doc_id, 'stale', t + CASE WHEN what = 2 THEN 7 ELSE 5 END,
    CASE WHEN own AND (left_at IS NULL OR left_at > t + CASE WHEN what = 2 THEN 7 ELSE 5 END) THEN 'stale' ELSE 'kept' END,
    CASE WHEN own AND (left_at IS NULL OR left_at > t + CASE WHEN what = 2 THEN 7 ELSE 5 END) THEN e.doc_id END
  FROM e LEFT JOIN away ON away.known = e.known WHERE what <= 2
)
SELECT path, action, round("at", 3) AS "at", outcome, id FROM r
"""


@query(_FOLLOWED)
def files_followed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is a file that is moved, deleted, copied and then deleted, new, or written again, in turn of ids; the
    least id of a content is indexed, of three in four."""
    d = load(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 5).alias("what"), F.col("doc_id").cast("double").alias("n"), F.md5("text").alias("hash"))
    old, new = (F.concat(F.lit(at), F.col("doc_id").cast("string")) for at in ("/old/", "/new/"))
    index = d.where("doc_id % 4 <> 3 and hash is not null").groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    index = index.select(F.col("doc_id").alias("id"), old.alias("path"), "hash", F.lit(False).alias("stale"), F.lit(None).cast("string").alias("came"))
    event = lambda path, dst, op, t: F.struct(path.alias("path"), dst.alias("dst_path"), F.lit(op).alias("op"), t.alias("t"))
    none, t = F.lit(None).cast("string"), 10 * F.col("n")
    happens = (
        F.when(F.col("what") == 0, F.array(event(old, new, "moved", t)))
        .when(F.col("what") == 1, F.array(event(old, none, "deleted", t)))
        .when(F.col("what") == 2, F.array(event(new, none, "created", t), event(old, none, "deleted", t + 2)))
        .when(F.col("what") == 3, F.array(event(new, none, "created", t)))
        .otherwise(F.array(event(old, none, "created", t)))
    )
    events = d.select(F.explode(happens).alias("e")).select("e.path", "e.dst_path", "e.op", F.timestamp_seconds("e.t").alias("ts"))
    there = d.where("what <> 1").select(F.when(F.col("what") == 4, old).otherwise(new).alias("path"), "hash")
    rows = L.settled_moves(events).join(there, "path", "left")
    return L.outcomes(index, rows).select("path", "action", F.round("at", 3).alias("at"), "outcome", "id")
