"""Registered queries: lookups, listings, logs, result lists, context rings, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import api
from tessera.functions import text as X
from tessera.operators import analytics as A
from tessera.operators import conversation as C
from tessera.operators import keyword as K
from tessera.operators import ranking as R
from tessera.operators.conversation import CHAT_STOPWORDS
from tessera.sources.tables import catalogue, load

from .intent import ACTIVITY_TERMS, AGE_TERMS, CLOTHING_TERMS, COLOR_TERMS, CUE_TERMS, PATTERN_TERMS, RELATION_WORDS, STOPWORDS, terms_column
from .registry import query


@query("SELECT p_partkey AS id, p_name AS caption FROM part WHERE p_partkey IN (3, 5, 8, 1000000)")
def lookup_ids(spark: SparkSession, sf: str) -> DataFrame:
    return api.by_ids(catalogue(spark, sf), [3, 5, 8, 1_000_000]).select("id", "caption")


@query("SELECT doc_id AS id FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 3)")
def lookup_hash(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    return d.where(F.col("hash") == d.where("id = 3").first()["hash"]).select("id")


@query("SELECT o_orderkey AS id, o_orderdate AS created FROM orders ORDER BY o_orderdate, o_orderkey")
def catalogue_by_creation(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created")).orderBy("created", "id")


@query("SELECT (SELECT count(*) FROM part)::BIGINT AS items, (SELECT count(*) FROM embeddings)::BIGINT AS vectors, (SELECT count(DISTINCT label) FROM embeddings)::BIGINT AS clusters")
def catalogue_counts(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "embeddings").agg(F.count("*").alias("vectors"), F.countDistinct("label").alias("clusters"))
    return catalogue(spark, sf).agg(F.count("*").alias("items")).crossJoin(v)  # one row each


@query("SELECT event_id AS id, round(value / 100, 4) AS score FROM events WHERE value / 100 >= 0.35 ORDER BY value DESC, event_id LIMIT 10")
def results_min_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("value") / 100).alias("score"))
    return api.presented(rows, 0.35, 10)


@query("SELECT DISTINCT p_brand AS pattern, p_brand <> (SELECT max(p_brand) FROM part) AS enabled FROM part UNION ALL SELECT DISTINCT p_type, false FROM part WHERE p_type NOT IN (SELECT p_brand FROM part)")
def exclusions_toggle(spark: SparkSession, sf: str) -> DataFrame:
    """All brands as exclusions; brands and types are inserted or ignored, then the last brand is toggled."""
    part = load(spark, sf, "part")
    named = lambda c, on: part.select(F.col(c).alias("pattern"), F.lit(on).alias("enabled")).distinct()
    rows = api.insert_or_ignore(named("p_brand", True), named("p_brand", False).unionByName(named("p_type", False)), "pattern")
    return api.toggle(rows, "pattern", part.agg(F.max("p_brand")).first()[0], "enabled")


@query("WITH s AS (SELECT l_orderkey AS id, max(l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, o_orderstatus AS status, (n)::INT AS segment FROM orders LEFT JOIN s ON o_orderkey = s.id")
def video_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Results with the segment rows of their video; of several the last wins."""
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    segments = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("segment"))
    return api.attach_segments(rows, segments, "segment")


@query("SELECT l_orderkey AS id, round(max(l_discount), 6) AS evidence, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey")
def relation_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.best_evidence(load(spark, sf, "lineitem"), "l_orderkey", "l_discount")
    return rows.select(F.col("l_orderkey").alias("id"), F.round("evidence", 6).alias("evidence"), "n")


@query("SELECT s_suppkey AS image_id, lower(n_name) AS label, 2::BIGINT AS n, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS first FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def attributes_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Attribute rows gathered under the label of their entity, whatever its case; those of other labels go."""
    s, n = load(spark, sf, "supplier"), load(spark, sf, "nation")
    named = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("image_id"), "n_name", "s_acctbal")
    kinds = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("Balance", F.when(F.col("s_acctbal") < 0, "Debt").otherwise("Credit")), ("size", F.lit("small")), ("", F.lit("x")))])
    attributes = named.select("image_id", F.lower("n_name").alias("label"), F.explode(kinds).alias("k"), F.lit(0.5).alias("confidence")).select("image_id", "label", "k.key", "k.value", "confidence")
    attributes = attributes.unionByName(attributes.withColumn("label", F.lit("nobody")))
    rows = A.attributes_by_label(named.select("image_id", F.col("n_name").alias("label")), attributes)
    return rows.select("image_id", "label", F.size("attributes").cast("long").alias("n"), F.col("attributes")[0]["value"].alias("first"))


@query("WITH l AS (SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) SELECT a.query_id AS query_id, a.id AS first, b.id AS second FROM l a JOIN l b ON a.query_id = b.query_id AND a.rank = 1 AND b.rank = 2")
def compare_top2(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.ranked(load(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score")))
    return api.top_two(rows)


_RINGS = """v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT 'similar' AS ring, v.id AS id, row_number() OVER (ORDER BY list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) DESC, v.id) AS place FROM v q, v WHERE q.id = 11 AND v.id <> 11),
    t AS (SELECT 'time' AS ring, event_id AS id, row_number() OVER (ORDER BY abs(epoch_us(ts) - (SELECT epoch_us(ts) FROM events WHERE event_id = 11)), event_id) AS place FROM events WHERE event_id <> 11),
    c AS (SELECT 'cluster' AS ring, id, row_number() OVER (ORDER BY id % 10, id) AS place FROM v WHERE label = (SELECT label FROM v WHERE id = 11) AND id <> 11),
    e0 AS (SELECT event_id AS id, lower(event_type || ' ' || props) AS x FROM events WHERE event_id <> 11 AND (lower(event_type || ' ' || props) LIKE '%click%' OR lower(event_type || ' ' || props) LIKE '%7%') ORDER BY ts DESC, event_id LIMIT 60),
    e AS (SELECT 'entity' AS ring, id, row_number() OVER (ORDER BY contains(x, 'click')::INT + contains(x, '7')::INT DESC, id) AS place FROM e0)"""


@query(f"WITH {_RINGS} SELECT ring, id, place::BIGINT AS place FROM (SELECT * FROM s UNION ALL SELECT * FROM t UNION ALL SELECT * FROM c UNION ALL SELECT * FROM e) WHERE place <= 6")
def context_lens(spark: SparkSession, sf: str) -> DataFrame:
    """The four rings around one item, with the name of the ring."""
    e = load(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", "event_type", "props")
    v = load(spark, sf, "embeddings")
    assigned = v.select(F.col("vec_id").alias("item_id"), F.col("label").alias("cluster_id"), (F.col("vec_id") % 10).alias("distance"))
    rings = {"similar": A.ring_similarity(v, 11, 6, "vec_id"), "cluster": A.ring_cluster(assigned, 11, 6), "entity": A.ring_terms(e, 11, ["click", "7"], "ts", ["event_type", "props"], 6), "time": A.ring_time(e, 11, "ts", 6)}
    order = {"similar": [F.desc("score"), F.col("id")], "cluster": [F.col("distance"), F.col("id")], "entity": [F.desc("overlap"), F.col("id")], "time": [F.col("micros"), F.col("id")]}
    return api.context_lens(rings, order)


@query("SELECT conv_id, turn, trim(text) <> '' AND (trim(text) IN ('', '{', '}', '[', ']') OR starts_with(trim(text), '{\"')) AS malformed FROM conversations")
def malformed_text(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select("conv_id", "turn", X.malformed(F.col("text")).alias("malformed"))


_ASKED = "CASE p_partkey % 3 WHEN 0 THEN 'Show the old ' || p_name WHEN 1 THEN p_name || ' next to a woman holding a checkered shirt' ELSE upper(p_name) || ' of what colour' END"


@query(
    f"""WITH q AS (SELECT p_partkey AS id, {_ASKED} AS text FROM part), t AS (SELECT id, text, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM q), k AS (SELECT *, {sorted(COLOR_TERMS | PATTERN_TERMS | CLOTHING_TERMS | ACTIVITY_TERMS | AGE_TERMS)} AS own FROM t),
    x AS (SELECT id, text, w, list_distinct(list_concat(list_concat(list_intersect(w, own), list_intersect(w, {sorted(CUE_TERMS)})), list_concat(CASE WHEN list_contains(w, 'old') THEN ['elderly', 'senior', 'aged'] ELSE [] END, CASE WHEN list_contains(w, 'checkered') THEN ['check', 'checked', 'plaid'] ELSE [] END))) AS a FROM k)
    SELECT id, array_to_string(list_sort(a), ',') AS attributes, array_to_string(list_sort(list_filter(w, lambda y: NOT list_contains(a, y) AND NOT list_contains({sorted(STOPWORDS | RELATION_WORDS)}, y))), ',') AS retrieval, CASE id % 3 WHEN 1 THEN 'holding,next_to' ELSE '' END AS relations FROM x"""
)
def intent_terms_batch(spark: SparkSession, sf: str) -> DataFrame:
    """What a table of queries asks for: attribute and retrieval terms and relations."""
    asked = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(_ASKED).alias("text"))
    joined = {k: F.array_join(F.array_sort(c), ",") for k, c in terms_column(F.col("text")).items()}
    return asked.select("id", joined["attribute_terms"].alias("attributes"), joined["retrieval_terms"].alias("retrieval"), joined["relation_terms"].alias("relations"))


@query("SELECT conv_id, turn, regexp_matches(lower(text), '\\b(compare|vs|versus|difference|similar|like)\\b') AS comparison FROM conversations")
def comparison_queries(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select("conv_id", "turn", C.is_comparison(F.col("text")).alias("comparison"))


@query(
    f"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 3 AND NOT list_contains({CHAT_STOPWORDS}, x))) AS t, text FROM conversations), f AS (SELECT conv_id, turn, min(i) AS i, x FROM (SELECT conv_id, turn, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 3 AND NOT list_contains({CHAT_STOPWORDS}, x)) AS a FROM conversations)) GROUP BY conv_id, turn, x),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM f) SELECT w.conv_id AS conv_id, w.turn AS turn, coalesce(string_agg(r.x, ',' ORDER BY r.i), '') AS terms FROM w LEFT JOIN r ON r.conv_id = w.conv_id AND r.turn = w.turn AND r.n <= 8 GROUP BY w.conv_id, w.turn"""
)
def chat_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The first eight terms of every turn; none of these texts holds a word that stands for others."""
    return load(spark, sf, "conversations").select("conv_id", "turn", F.array_join(C.chat_terms(F.col("text")), ",").alias("terms"))


@query(
    f"""WITH s AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 3 AND NOT list_contains({CHAT_STOPWORDS}, x)) AS all_, regexp_extract_all(lower(before), '[a-z0-9_]+') AS w FROM s WHERE before IS NOT NULL),
    d AS (SELECT conv_id, turn, w, x, min(i) AS i FROM (SELECT conv_id, turn, w, unnest(all_) AS x, generate_subscripts(all_, 1) AS i FROM t) GROUP BY conv_id, turn, w, x), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM d), m AS (SELECT conv_id, turn, avg(list_contains(w, x)::INT) AS s FROM r WHERE n <= 8 GROUP BY conv_id, turn)
    SELECT t.conv_id AS conv_id, t.turn AS turn, round(coalesce(m.s, 0), 6) AS score FROM t LEFT JOIN m ON m.conv_id = t.conv_id AND m.turn = t.turn"""
)
def retrieval_match(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each turn's terms that the turn before holds."""
    t = load(spark, sf, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return t.select("conv_id", "turn", F.round(C.match_score(C.chat_terms(F.col("text")), F.array("before")), 6).alias("score"))


@query("SELECT event_id AS id, 1.0::DOUBLE AS lexical FROM events WHERE value >= 0 UNION ALL SELECT -event_id - 1, round(1 / (1 + value), 6) FROM events WHERE value >= 0")
def lexical_score(spark: SparkSession, sf: str) -> DataFrame:
    """The lexical score of a bm25 of either sign: less is better, and what is under zero is the best there is."""
    e = load(spark, sf, "events").where("value >= 0")
    rows = e.select(F.col("event_id").alias("id"), (-F.col("value")).alias("bm25")).unionByName(e.select((-F.col("event_id") - 1).alias("id"), F.col("value").alias("bm25")))
    return rows.select("id", K.lexical_score(F.col("bm25")).alias("lexical"))


@query("SELECT p_partkey % 3 AS source, p_partkey AS id, round(p_size / 50::DOUBLE, 4) AS score FROM part WHERE p_partkey % 3 = 0 AND p_size / 50::DOUBLE >= 0.35 ORDER BY p_size / 50::DOUBLE DESC, p_partkey LIMIT 10")
def results_of_source(spark: SparkSession, sf: str) -> DataFrame:
    """Results of one source at a least score, the first ten."""
    rows = catalogue(spark, sf).select((F.col("id") % 3).alias("source"), "id", (F.col("p_size") / 50).alias("score"))
    return api.presented(rows, 0.35, 10, source=0)
