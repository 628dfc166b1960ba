"""Registered queries: timelines, collections, clusters, rings, entity memory, joins, conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.operators import conversation as C
from tessera.operators import evalkit as E
from tessera.sources.tables import catalogue, load

from .registry import query


def _orders(spark, sf, unit, limit=500) -> DataFrame:
    rows = load(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").cast("string").alias("path"))
    return A.timeline(rows, "ts", unit, "path", limit)


def _timeline_sql(fmt: str, table: str = "orders", ts: str = "o_orderdate", path: str = "o_orderkey", limit: int = 500, where: str = "true") -> str:
    return f"SELECT strftime({ts}, '{fmt}') AS bucket, count(*)::BIGINT AS n, min({ts}) AS first_ts, max({ts}) AS last_ts, min({path}::VARCHAR) AS sample FROM {table} WHERE {where} GROUP BY 1 ORDER BY 1 DESC LIMIT {limit}"


@query(_timeline_sql("%Y"))
def timeline_year(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf, "year")


@query(_timeline_sql("%Y-%m"))
def timeline_month(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf, "month")


@query(_timeline_sql("%Y-%m-%d", limit=2000))
def timeline_day(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf, "day", 5000)


@query(_timeline_sql("%Y-%m", "lineitem", "l_shipdate", "l_orderkey"))
def timeline_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_orderkey").cast("string").alias("path"))
    return A.timeline(rows, "ts", "month", "path")


@query(_timeline_sql("%Y", where="lower(o_orderpriority) LIKE '%urg_nt%' OR lower(o_orderstatus) LIKE '%urg_nt%'"))
def timeline_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").where(A.text_filter("URG_NT", "o_orderpriority", "o_orderstatus"))
    return A.timeline(rows.select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").cast("string").alias("path")), "ts", "year", "path")


@query(f"WITH b AS ({_timeline_sql('%Y-%m')}) SELECT count(*)::BIGINT AS buckets, sum(n)::BIGINT AS total, max(n)::BIGINT AS largest, round(avg(n), 3) AS average, (SELECT min(bucket) FROM b WHERE n = (SELECT max(n) FROM b)) AS peak FROM b")
def timeline_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.timeline_stats(_orders(spark, sf, "month"))


def _collection(spark, sf, text) -> DataFrame:
    return catalogue(spark, sf).where(A.collection_filter(text, "tags", None, ["caption", "summary"], "category")).select("id", "caption")


@query("SELECT p_partkey AS id, p_name AS caption FROM part WHERE contains(lower(p_brand || ',' || p_type), 'brand#1')")
def collection_tag(spark: SparkSession, sf: str) -> DataFrame:
    return _collection(spark, sf, "tag:Brand#1 foo:ignored")


@query("SELECT p_partkey AS id, p_name AS caption FROM part WHERE lower(p_type) = 'economy' AND lower(p_name) LIKE '%re%'")
def collection_category(spark: SparkSession, sf: str) -> DataFrame:
    return _collection(spark, sf, "cat:economy Re")


@query("SELECT p_partkey AS id, p_name AS caption FROM part WHERE lower(p_name) LIKE '%w_dget%' OR lower(p_brand || ' ' || p_type) LIKE '%w_dget%'")
def collection_text(spark: SparkSession, sf: str) -> DataFrame:
    return _collection(spark, sf, "text:w_dget")


@query("SELECT o_orderkey AS id FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-03'")
def collection_date(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.array("o_orderstatus").alias("tags"), F.col("o_orderpriority").alias("c"))
    return rows.where(A.collection_filter("date:1996-03", "tags", "ts", ["c", "c"], "c")).select("id")


_CENTRES = "v AS (SELECT vec_id, label, embedding FROM embeddings), x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM v), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i), dist AS (SELECT vec_id AS item_id, x.label AS cluster_id, sqrt(sum((x.x - m.m) * (x.x - m.m))) AS distance FROM x JOIN m ON x.label = m.label AND x.i = m.i GROUP BY vec_id, x.label)"


def _assigned(spark, sf) -> DataFrame:
    v = load(spark, sf, "embeddings")
    rows = A.distances(v, A.centroids(v, "label"), "label")
    return rows.select(F.col("vec_id").alias("item_id"), F.col("label").alias("cluster_id"), F.round("distance", 9).alias("distance"))


@query(f"WITH {_CENTRES} SELECT item_id, cluster_id, round(round(distance, 9), 6) AS distance FROM dist")
def vector_l2_to_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf).select("item_id", "cluster_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_CENTRES}, d AS (SELECT item_id, cluster_id, round(distance, 9) AS distance FROM dist), c AS (SELECT unnest(range(12))::INT AS id), s AS (SELECT cluster_id, count(*) AS n, arg_min(item_id, (distance, item_id)) AS sample FROM d GROUP BY cluster_id) SELECT c.id AS id, coalesce(n, 0)::BIGINT AS item_count, sample FROM c LEFT JOIN s ON c.id = s.cluster_id")
def cluster_list(spark: SparkSession, sf: str) -> DataFrame:
    clusters = spark.range(12).select(F.col("id").cast("int").alias("id"))
    return A.cluster_sizes(clusters, _assigned(spark, sf), 0).select("id", "item_count", "sample")


@query(f"WITH {_CENTRES} SELECT item_id AS id, round(round(distance, 9), 6) AS distance FROM dist WHERE cluster_id = 3 ORDER BY round(dist.distance, 9), item_id LIMIT 25")
def cluster_items(spark: SparkSession, sf: str) -> DataFrame:
    items = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return A.cluster_items(_assigned(spark, sf), items, 3, 25).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_CENTRES} SELECT cluster_id, arg_min(item_id, (round(distance, 9), item_id)) AS nearest, round(min(round(distance, 9)), 6) AS distance FROM dist GROUP BY cluster_id")
def cluster_nearest_member(spark: SparkSession, sf: str) -> DataFrame:
    d = _assigned(spark, sf)
    return d.groupBy("cluster_id").agg(F.min_by("item_id", F.struct("distance", "item_id")).alias("nearest"), F.round(F.min("distance"), 6).alias("distance"))


@query()
def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    placed, _ = A.kmeans(load(spark, sf, "embeddings"), 10, "vec_id")
    return placed.groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 4).alias("mean_distance"))


@query("WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT v.id AS id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score FROM v q, v WHERE q.id = 11 AND v.id <> 11) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 12")
def ring_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return A.ring_similarity(load(spark, sf, "embeddings"), 11, 12, "vec_id").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_CENTRES} SELECT item_id AS id, round(round(distance, 9), 6) AS distance FROM dist WHERE cluster_id = (SELECT label FROM embeddings WHERE vec_id = 11) AND item_id <> 11 ORDER BY round(dist.distance, 9), item_id LIMIT 8")
def ring_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return A.ring_cluster(_assigned(spark, sf), 11, 8).select("id", F.round("distance", 6).alias("distance"))


@query(
    """WITH r AS (SELECT event_id AS id, ts, event_type || ' ' || props AS t FROM events), c AS (SELECT * FROM r WHERE id <> 5 AND (lower(t) LIKE '%click%' OR lower(t) LIKE '%7%') ORDER BY ts DESC, id LIMIT 60)
    SELECT id, ((CASE WHEN contains(lower(t), 'click') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(t), '7') THEN 1 ELSE 0 END))::BIGINT AS overlap FROM c ORDER BY 2 DESC, id LIMIT 10"""
)
def ring_entity(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", "event_type", "props")
    return A.ring_terms(rows, 5, ["click", "7"], "ts", ["event_type", "props"], 10).select("id", "overlap")


@query("WITH t AS (SELECT ts AS own FROM events WHERE event_id = 100), d AS (SELECT event_id AS id, abs(epoch_us(ts) - epoch_us(own)) / 86400000000.0::DOUBLE AS days FROM events, t WHERE event_id <> 100) SELECT id, round(days, 4) AS days, round(days * 24, 2) AS hours FROM d ORDER BY d.days, id LIMIT 10")
def ring_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select(F.col("event_id").alias("id"), "ts")
    return A.ring_time(rows, 100, "ts", 10).drop("micros")


@query(
    """WITH l AS (SELECT user_id, event_id AS id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT user_id, event_id AS id, ts FROM events WHERE event_type = 'error'),
    p AS (SELECT l.user_id, l.id AS id, r.id AS other, abs(epoch_us(l.ts) - epoch_us(r.ts)) / 86400000000.0::DOUBLE AS days FROM l JOIN r USING (user_id)) SELECT user_id, id, arg_min(other, (days, other)) AS other, round(min(days), 6) AS days FROM p GROUP BY user_id, id"""
)
def nearest_time_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), "ts", "event_type")
    left, right = (rows.where(F.col("event_type") == k).drop("event_type") for k in ("signup", "error"))
    return A.nearest_in_time(left, right, "user_id").drop("nth")


@query(
    """WITH l AS (SELECT user_id, event_id AS id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT user_id, event_id AS id, ts FROM events WHERE event_type = 'error'),
    p AS (SELECT l.user_id, l.id AS id, r.id AS other, abs(epoch_us(l.ts) - epoch_us(r.ts)) / 86400000000.0::DOUBLE AS days FROM l JOIN r USING (user_id)), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY days, other)::BIGINT AS nth FROM p) SELECT user_id, id, other, round(days, 6) AS days, nth FROM n WHERE nth <= 3"""
)
def nearest_time_three(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest in time of every row, on both sides."""
    rows = load(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), "ts", "event_type")
    left, right = (rows.where(F.col("event_type") == k).drop("event_type") for k in ("signup", "error"))
    return A.nearest_in_time(left, right, "user_id", 3)


@query(
    """WITH s AS (SELECT user_id AS key, epoch_us(ts) / 1000000.0::DOUBLE AS a, epoch_us(ts) / 1000000.0::DOUBLE + 7200 AS b, event_id AS seg FROM events WHERE event_type = 'signup'), p AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events WHERE event_type = 'view')
    SELECT p.key AS key, p.id AS id, arg_min(s.seg, (s.a, s.seg)) AS seg FROM p LEFT JOIN s ON p.key = s.key AND p.t BETWEEN s.a AND s.b GROUP BY p.key, p.id"""
)
def segment_interval_first(spark: SparkSession, sf: str) -> DataFrame:
    """Views with the first two-hour segment, opened by a signup of the same user, that holds them."""
    e = load(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_type")
    segments = e.where("event_type = 'signup'").select("key", F.col("t").alias("start"), (F.col("t") + 7200).alias("end"), F.col("id").alias("seg"))
    return A.first_interval(e.where("event_type = 'view'").select("key", "id", "t"), segments, 7200).select("key", "id", "seg")


@query("SELECT o_orderkey AS id, o_orderdate AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40 OFFSET 80")
def catalog_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"))
    return A.page(rows, 40, 80, F.desc("created"), F.desc("id"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def existence_semi(spark: SparkSession, sf: str) -> DataFrame:
    listing = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id")).join(listing, "id", "left_semi")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def existence_anti(spark: SparkSession, sf: str) -> DataFrame:
    listing = load(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(listing, "id", "left_anti")


@query("SELECT doc_id AS id, lang, quality FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' ORDER BY doc_id LIMIT 50")
def attach_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").where("lang = 'en'").select("doc_id", "lang")
    return rows.join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id").orderBy("doc_id").limit(50).select(F.col("doc_id").alias("id"), "lang", "quality")


def _graph(spark, sf):
    """Suppliers as images, nations as entities, regions as mentions."""
    s, n, r = (load(spark, sf, t) for t in ("supplier", "nation", "region"))
    images = s.select(F.col("s_suppkey").alias("image_id"), "s_nationkey")
    e = images.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("image_id", F.col("n_name").alias("label"), F.lit(0.5).alias("confidence"), F.col("n_regionkey").alias("rk"))
    m = e.join(r, F.col("rk") == F.col("r_regionkey")).select("image_id", F.col("r_name").alias("mention"))
    a = s.select(F.col("s_suppkey").alias("image_id"), F.lit("balance").alias("key"), F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit").alias("value"), F.lit(0.9).alias("confidence"))
    a = a.unionByName(a.withColumn("value", F.lit("unsure")).withColumn("confidence", F.lit(0.2)).where("image_id % 2 = 0"))
    return images.select("image_id"), e.drop("rk"), a, m


@query("SELECT s_suppkey AS image_id, n_name AS entity, CASE WHEN s_suppkey % 2 = 0 THEN 'unsure' WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS balance, r_name AS mention FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def entity_memory(spark: SparkSession, sf: str) -> DataFrame:
    images, e, a, m = _graph(spark, sf)
    rows = A.entity_memory(images, e, a, m)
    return rows.select("image_id", F.get("entities", F.lit(0)).alias("entity"), F.col("attributes")["balance"].alias("balance"), F.get("mentions", F.lit(0)).alias("mention"))


@query("SELECT l_orderkey AS image_id, l_linenumber AS n, CASE WHEN l_suppkey % 2 = 0 THEN (l_suppkey % 10)::BIGINT END AS subject_id FROM lineitem")
def relation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The entity that the subject of every relation names."""
    return _relations(load(spark, sf, "lineitem"))


TASK = 1_000_000  # relations that a task joins, about


def _relations(li: DataFrame) -> DataFrame:
    entities = li.select(F.col("l_orderkey").alias("image_id")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8), F.lit(2))))
    entities = entities.select("image_id", F.concat(F.lit("E"), F.col("k").cast("string")).alias("label"), F.col("k").cast("long").alias("entity_id"))
    rel = li.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("e"), (F.col("l_suppkey") % 10).cast("string")).alias("subject"), F.lit("none").alias("object"))
    parts = -(-li.count() // TASK)  # of a scan's footers
    return A.relations_resolved(rel, entities, parts if parts > int(li.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None).select("image_id", "n", "subject_id")


BIAS = "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), c AS (SELECT user_id, event_type AS category, count(*) AS n FROM r WHERE rn <= 10 GROUP BY ALL), b AS (SELECT *, 1 + 0.5::DOUBLE * n / sum(n) OVER (PARTITION BY user_id) AS bias FROM c)"


def _bias(spark, sf) -> DataFrame:
    return A.topic_bias(load(spark, sf, "events").withColumnRenamed("event_type", "category"))


@query(f"WITH {BIAS} SELECT user_id, category, n::BIGINT AS n, round(bias, 6) AS bias FROM b WHERE n >= 3")
def topic_bias(spark: SparkSession, sf: str) -> DataFrame:
    return _bias(spark, sf).select("user_id", "category", "n", F.round("bias", 6).alias("bias"))


@query(f"WITH {BIAS} SELECT user_id, CASE WHEN bool_or(category IN ('purchase', 'error')) THEN 0.15::DOUBLE WHEN bool_or(category = 'view') THEN -0.10::DOUBLE ELSE 0::DOUBLE END AS adjust FROM b WHERE n >= 3 GROUP BY user_id")
def routing_adjust(spark: SparkSession, sf: str) -> DataFrame:
    return A.routing_adjust(_bias(spark, sf), ["purchase", "error"], ["view"])


@query("SELECT user_id, event_id, rn::BIGINT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10")
def recent_activity(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return load(spark, sf, "events").withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 10").select("user_id", "event_id", "rn")


@query("SELECT conv_id, turn, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS back FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') WHERE back <= 8")
def history_last8(spark: SparkSession, sf: str) -> DataFrame:
    return C.history(load(spark, sf, "conversations")).select("conv_id", "turn", "back")


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_turn(spark: SparkSession, sf: str) -> DataFrame:
    return C.last_user_turn(load(spark, sf, "conversations")).select("conv_id", "turn", "text")


@query(r"SELECT conv_id, turn, len(list_intersect(regexp_split_to_array(lower(text), '[\s,;.?!]+'), ['that', 'this', 'it', 'those', 'these', 'above', 'below', 'he', 'she', 'they'])) > 0 AS follow_up FROM conversations")
def follow_up(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select("conv_id", "turn", C.is_follow_up(F.col("text")).alias("follow_up"))


@query(
    r"""WITH b AS (SELECT conv_id AS id, turn AS pos, text, CASE WHEN (conv_id + turn) % 4 = 0 THEN 0.5 ELSE 0.8 END AS c FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY id, text ORDER BY pos) AS nth FROM b WHERE c >= 0.6 AND len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) > 0 AND (len(list_intersect(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ['the', 'de'])) > 0 OR regexp_matches(text, '[0-9]'))),
    u AS (SELECT id, pos, sum(length(text)) OVER (PARTITION BY id ORDER BY pos)::BIGINT AS used FROM k WHERE nth = 1) SELECT * FROM u WHERE used <= 3000"""
)
def ocr_budget(spark: SparkSession, sf: str) -> DataFrame:
    b = load(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), "text", F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, 0.5).otherwise(0.8).alias("confidence"))
    return C.ocr_budget(b, ["the", "de"]).select("id", "pos", "used")


_LISTS = "l AS (SELECT user_id AS query_id, event_id AS id, value / 100 AS score, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::BIGINT AS rank FROM events)"


def _lists(spark, sf) -> DataFrame:
    from tessera.operators.ranking import ranked

    return ranked(load(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), (F.col("value") / 100).alias("score"), "event_type"))


@query(f"WITH {_LISTS}, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM l) SELECT query_id, id FROM m WHERE CASE WHEN top >= 0.9 THEN score >= 0.9 ELSE rank <= 3 END")
def gate_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return C.gate(_lists(spark, sf), 0.9).select("query_id", "id")


@query(f"WITH {_LISTS}, o AS (SELECT *, (contains(event_type, 'sign'))::BIGINT AS overlap FROM l), m AS (SELECT *, max(overlap) OVER (PARTITION BY query_id) AS top FROM o) SELECT query_id, id, overlap FROM m WHERE overlap > 0 OR top = 0")
def lexical_enforce(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lists(spark, sf)
    return C.lexical_enforce(rows, C.term_overlap(["sign"], F.col("event_type"))).select("query_id", "id", "overlap")


@query(
    r"""WITH t AS (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations), w AS (SELECT conv_id, turn, answer, context, list_filter(list_distinct(regexp_split_to_array(lower(answer), '[^\p{L}\p{N}_]+')), lambda x: x NOT IN ('a', 'an', 'the', 'is', 'of', 'in')) AS a,
    list_distinct(regexp_split_to_array(lower(context), '[^\p{L}\p{N}_]+')) AS c FROM t WHERE context IS NOT NULL), s AS (SELECT conv_id, turn, len(list_intersect(a, c)) / len(a)::DOUBLE AS s, len(list_filter(list_distinct(regexp_extract_all(answer, '[0-9]+')), lambda x: NOT list_contains(regexp_extract_all(context, '[0-9]+'), x))) AS miss FROM w WHERE len(a) > 0)
    SELECT conv_id, turn, round(CASE WHEN miss > 0 THEN s * 0.5 ELSE s END, 6) AS grounding FROM s"""
)
def grounding_score(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    t = load(spark, sf, "conversations").withColumn("context", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("context is not null")
    return t.select("conv_id", "turn", F.round(C.grounding(F.col("text"), F.col("context")), 6).alias("grounding"))


@query(f"WITH {_LISTS}, o AS (SELECT *, (event_type = 'click')::BIGINT AS overlap FROM l), m AS (SELECT *, max(overlap) OVER (PARTITION BY query_id) AS a, max(score) OVER (PARTITION BY query_id) AS best FROM o), f AS (SELECT * FROM m WHERE CASE WHEN a = 1 THEN overlap = 1 ELSE best >= 0.72 END), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN a = 1 THEN overlap ELSE 0 END DESC, score DESC, id)::BIGINT AS place FROM f) SELECT query_id, id, place, CASE WHEN a = 1 THEN 'explicit' ELSE 'semantic' END AS mode FROM p WHERE place <= 2")
def fallback_top2(spark: SparkSession, sf: str) -> DataFrame:
    return C.fallback(_lists(spark, sf), ["click"], F.col("event_type")).select("query_id", "id", "place", "mode")


@query(
    r"""WITH a AS (SELECT conv_id AS id, arg_max(text, turn) AS answer FROM conversations GROUP BY conv_id), n AS (SELECT DISTINCT id, unnest(list_concat(regexp_extract_all(answer, '\d+(?:\.\d+)?'), list_filter(regexp_extract_all(answer, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{2,}')))) AS needle FROM a)
    SELECT n.id AS id, needle, min(turn) AS pos FROM n JOIN conversations c ON c.conv_id = n.id AND contains(c.text, needle) GROUP BY n.id, needle"""
)
def region_highlight(spark: SparkSession, sf: str) -> DataFrame:
    """The first turn that holds each number or name of a conversation's last one."""
    c = load(spark, sf, "conversations")
    answers = c.groupBy(F.col("conv_id").alias("id")).agg(F.max_by("text", "turn").alias("answer"))
    return C.region_highlight(answers, c.select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), "text"))


def _measured(pairs: DataFrame) -> DataFrame:
    """Metrics of two modes: in order of id, and the same five ranks further down."""
    from pyspark.sql.window import Window

    up = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("id"))).withColumn("mode", F.lit("up"))
    runs = up.unionByName(up.withColumn("rank", F.col("rank") + 5).withColumn("mode", F.lit("far")))
    return E.case_metrics(runs, pairs)


WORD, KEYS = r"(?U)\w+", 3


def _contained(spark, sf) -> DataFrame:
    """(case_id, id): the benchmark passages and the documents whose text contains the whole passage.

    Candidates hold the KEYS longest inner words of a passage, which stand whole in any text that contains it. Passages
    of two words or fewer have none and are compared with every document.
    """
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    passages = load(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("passage"))
    words = F.regexp_extract_all("passage", F.lit(WORD), F.lit(0))
    inner = F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    longest = F.transform(F.slice(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, KEYS), lambda x: x["w"])
    keyed = passages.withColumn("keys", longest)
    asked = keyed.select("case_id", F.size("keys").alias("asked"), F.explode("keys").alias("word")).distinct()
    held = docs.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word")).distinct()
    likely = held.join(asked, "word").groupBy("case_id", "id", "asked").agg(F.count("*").alias("n")).where("n = asked").select("case_id", "id")
    found = likely.join(keyed.where("size(keys) > 0"), "case_id").join(docs, "id").where(F.col("text").contains(F.col("passage")))
    short = docs.join(F.broadcast(keyed.where("size(keys) = 0")), F.col("text").contains(F.col("passage")))
    return found.select("case_id", "id").unionByName(short.select("case_id", "id")).distinct()


_PASSAGES = "p AS (SELECT DISTINCT item_id AS case_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), runs AS (SELECT 'up' AS mode, case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY id) AS rank FROM p UNION ALL SELECT 'far', case_id, id, 5 + row_number() OVER (PARTITION BY case_id ORDER BY id) FROM p), x AS (SELECT mode, case_id, count(*) FILTER (rank <= 5) AS top, count(*) FILTER (rank <= 10) AS found, count(*) AS n FROM runs GROUP BY mode, case_id), cm AS (SELECT mode, case_id, top / 5.0::DOUBLE AS precision, found / n::DOUBLE AS recall, (found > 0)::BIGINT AS hit FROM x)"


@query(f"WITH {_PASSAGES} SELECT mode, case_id, round(precision, 6) AS precision, round(recall, 6) AS recall, hit FROM cm")
def eval_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = _measured(_contained(spark, sf))
    return rows.select("mode", "case_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "hit")


@query(f"WITH {_PASSAGES} SELECT mode, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(hit), 4) AS hit_rate, sum(1 - hit)::BIGINT AS failed, count(*)::BIGINT AS cases FROM cm GROUP BY mode")
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.mode_metrics(_measured(_contained(spark, sf)))


@query(f"WITH {_PASSAGES}, m AS (SELECT mode, round(avg(precision), 4) AS p, sum(1 - hit) AS f, count(*) AS n FROM cm GROUP BY mode) SELECT mode, concat_ws(',', CASE WHEN mode = 'far' AND f > 1 THEN 'failed_cases' END, CASE WHEN p < 0.1 THEN 'precision' END, CASE WHEN mode = 'far' AND n < 1000000 THEN 'too_few_cases' END) AS failures FROM m WHERE p < 0.1 OR mode = 'far'")
def eval_gate(spark: SparkSession, sf: str) -> DataFrame:
    floors = spark.createDataFrame([("up", "precision", 0.1), ("far", "precision", 0.1), ("up", "recall", 0.0)], "mode string, metric string, floor double")
    return E.gates(E.mode_metrics(_measured(_contained(spark, sf))), floors, {"far": 1}, 1_000_000)
