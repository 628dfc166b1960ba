"""Registered queries: text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.sources.media import text_blocks
from tessera.sources.tables import load, media_kind

from .intent import OCR_WORDS, VISUAL_WORDS, route_column
from .likeness import likeness_sql, soundex_sql
from .registry import query


@query(r"SELECT doc_id AS id, len(list_distinct(regexp_extract_all(lower(trim(text)), '[\p{L}\p{N}_]+')))::BIGINT AS n, regexp_extract_all(lower(trim(text)), '[\p{L}\p{N}_]+')[1] AS first FROM documents")
def tokens_distinct(spark: SparkSession, sf: str) -> DataFrame:
    t = X.unicode_tokens(F.col("text"))
    return load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.size(t).cast("long").alias("n"), F.get(t, F.lit(0)).alias("first"))


@query("SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[a-z0-9_]+'))::BIGINT AS n FROM documents")
def tokens_ascii(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.size(X.ascii_tokens(F.col("text"))).cast("long").alias("n"))


_LCS = """WITH RECURSIVE w AS (SELECT DISTINCT p_name AS a FROM part), p AS (SELECT a, 'red widgit' AS b, length(a) AS n, length('red widgit') AS m FROM w),
    r(a, b, n, m, i, j, above, cur) AS (SELECT a, b, n, m, 1::BIGINT, 1::BIGINT, list_transform(range(m + 1), lambda x: 0::BIGINT), [0::BIGINT] FROM p UNION ALL
    SELECT a, b, n, m, CASE WHEN j = m THEN i + 1 ELSE i END, CASE WHEN j = m THEN 1 ELSE j + 1 END, CASE WHEN j = m THEN list_append(cur, v) ELSE above END, CASE WHEN j = m THEN [0::BIGINT] ELSE list_append(cur, v) END
    FROM (SELECT *, CASE WHEN substring(a, i, 1) = substring(b, j, 1) THEN above[j] + 1 ELSE greatest(above[j + 1], cur[len(cur)]) END AS v FROM r WHERE i <= n))
    SELECT a, round(2.0::DOUBLE * above[m + 1] / (n + m), 6) AS ratio FROM r WHERE i = n + 1"""


@query(_LCS)
def indel_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """The likeness of every distinct part name to a misspelt one."""
    return load(spark, sf, "part").select(F.col("p_name").alias("a")).distinct().select("a", F.round(X.indel_ratio(F.col("a"), F.lit("red widgit")), 6).alias("ratio"))


_PART_WORDS = "w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)"


@query(f"WITH {_PART_WORDS} SELECT w AS word, {soundex_sql('w')} AS code FROM w")
def soundex_variant(spark: SparkSession, sf: str) -> DataFrame:
    words = load(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select("word", X.soundex_variant(F.col("word")).alias("code"))


@query(f"WITH RECURSIVE {_PART_WORDS}, asked AS (SELECT 'widgit' AS t), {likeness_sql()} SELECT w AS word, round(likeness, 6) AS likeness FROM alike")
def pair_similarity(spark: SparkSession, sf: str) -> DataFrame:
    words = load(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select("word", F.round(X.pair_similarity(F.col("word"), F.lit("widgit")), 6).alias("likeness"))


@query(
    r"""WITH f AS (SELECT doc_id AS id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{2,}')) AS n FROM documents), e AS (SELECT id, unnest(n) AS w, generate_subscripts(n, 1) AS i FROM f),
    u AS (SELECT id, lower(w) AS k, min(i) AS i FROM e GROUP BY id, lower(w)), r AS (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM u) SELECT f.id AS id, count(r.k)::BIGINT AS n, coalesce(string_agg(r.k, ',' ORDER BY r.r), '') AS names FROM f LEFT JOIN r ON r.id = f.id AND r.r <= 12 GROUP BY f.id"""
)
def name_mentions(spark: SparkSession, sf: str) -> DataFrame:
    n = X.names(F.col("text"))
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), n.alias("names"))
    return rows.select("id", F.size("names").cast("long").alias("n"), F.lower(F.array_join("names", ",")).alias("names"))


@query("SELECT event_id AS id, coalesce(TRY_CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events")
def json_number(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select(F.col("event_id").alias("id"), F.coalesce(X.json_number(F.col("props"), "k"), F.lit(-1)).alias("k"))


@query("""SELECT event_id AS id, event_type AS caption, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'ok' END AS summary FROM events""")
def json_recover(spark: SparkSession, sf: str) -> DataFrame:
    """Captions and summaries recovered from JSON that is cut off before its closing brace."""
    broken = F.concat(F.lit('{"caption": "'), "event_type", F.lit('", "tags": ['))
    rows = load(spark, sf, "events").select(F.col("event_id").alias("id"), broken.alias("c"), F.when(F.col("event_id") % 2 == 0, "{").otherwise("ok").alias("s"))
    caption, summary = X.repaired(F.col("c"), F.col("s"))
    return rows.select("id", caption.alias("caption"), summary.alias("summary"))


@query("SELECT p_partkey AS id, CASE p_partkey % 2 WHEN 0 THEN 2 ELSE 3 END::BIGINT AS n, CASE p_partkey % 2 WHEN 0 THEN p_brand ELSE 'a' END AS first FROM part")
def tags_parse(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.array("p_brand", "p_type"))).otherwise("a, b,, c")
    t = X.tags(raw)
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.size(t).cast("long").alias("n"), F.get(t, F.lit(0)).alias("first"))


@query(
    r"""WITH b AS (SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN '- ' || event_type WHEN 1 THEN '12. ' || event_type WHEN 2 THEN 'a | b' WHEN 3 THEN upper(event_type) WHEN 4 THEN event_type || ':' WHEN 5 THEN 'n 1  x 2 y' ELSE event_type || ' and more' END AS t FROM events)
    SELECT id, CASE WHEN regexp_matches(t, '^([-*]|\d+[.)])\s+') THEN 'list' WHEN contains(t, '|') THEN 'table' WHEN regexp_matches(t, '\b\d+\b.*\b\d+\b') AND contains(t, '  ') THEN 'table' WHEN (upper(t) = t AND lower(t) <> t) OR ends_with(t, ':') THEN 'title' ELSE 'text' END AS kind FROM b"""
)
def block_type(spark: SparkSession, sf: str) -> DataFrame:
    k, e = F.col("event_id") % 7, F.col("event_type")
    t = F.when(k == 0, F.concat(F.lit("- "), e)).when(k == 1, F.concat(F.lit("12. "), e)).when(k == 2, "a | b").when(k == 3, F.upper(e)).when(k == 4, F.concat(e, F.lit(":"))).when(k == 5, "n 1  x 2 y").otherwise(F.concat(e, F.lit(" and more")))
    return load(spark, sf, "events").select(F.col("event_id").alias("id"), X.block_type(t).alias("kind"))


@query("SELECT doc_id AS id, sha256(trim(lang) || chr(10) || trim(source)) AS payload_hash FROM documents")
def payload_hash(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2(X.payload(F.col("lang"), F.lit("  "), F.col("source")), 256).alias("payload_hash"))


@query("SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_brand || '/' || p_name || ':v1.'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')[1:64] AS slug FROM part")
def slug(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.slug(F.concat("p_brand", F.lit("/"), "p_name", F.lit(":v1."))).alias("slug"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def time_keys(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("o_orderdate")
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.time_key(ts, "year").alias("y"), X.time_key(ts, "month").alias("m"), X.time_key(ts, "day").alias("d"))


@query("SELECT doc_id AS id, 'search_query: ' || trim(lang) AS q, 'passage: ' || trim(lang) AS p, trim(lang) AS plain FROM documents")
def model_input(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit(" "), "lang", F.lit(" "))
    return load(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.model_input("nomic-embed-text:v1", t, True).alias("q"), X.model_input("e5-base", t, False).alias("p"), X.model_input("other", t, True).alias("plain"))


@query("""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '["''\\n]+', ' ', 'g'), ' +', ' ', 'g'))[1:50] AS label FROM conversations""")
def label_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select("conv_id", "turn", X.label_cleanup(F.col("text")).alias("label"))


# Paragraphs are folded one after the other: what is written, and what is still open.
_CHUNKS = r"""WITH RECURSIVE d AS (SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\s*\n'), lambda p: trim(p, E' \n\t\r\x0b\x0c')), lambda p: p <> '') AS ps FROM documents),
    r(id, ps, i, done, open) AS (SELECT id, ps, 0::BIGINT, []::VARCHAR[], '' FROM d WHERE len(ps) > 0 UNION ALL
    SELECT id, ps, i + 1, CASE WHEN length(ps[i + 1]) > 1400 THEN list_concat(CASE WHEN open <> '' THEN list_append(done, open) ELSE done END, list_filter(list_transform(range(greatest(0, ceil((length(ps[i + 1]) - 1400) / 1200.0))::BIGINT + 1), lambda n: trim(ps[i + 1][n * 1200 + 1 : n * 1200 + 1400], E' \n\t\r\x0b\x0c')), lambda w: w <> ''))
    WHEN open = '' OR length(open) + 2 + length(ps[i + 1]) <= 1400 THEN done ELSE list_append(done, open) END,
    CASE WHEN length(ps[i + 1]) > 1400 THEN '' WHEN open = '' THEN ps[i + 1] WHEN length(open) + 2 + length(ps[i + 1]) <= 1400 THEN open || chr(10) || chr(10) || ps[i + 1] ELSE ps[i + 1] END FROM r WHERE i < len(ps)),
    e AS (SELECT id, CASE WHEN open <> '' THEN list_append(done, open) ELSE done END AS cs FROM r WHERE i = len(ps)), u AS (SELECT id, unnest(cs) AS c, generate_subscripts(cs, 1) AS n FROM e) SELECT id, n::BIGINT AS chunk, length(c)::BIGINT AS size FROM u"""


@query(_CHUNKS)
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of every document, paragraphs packed."""
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.posexplode(X.chunks(F.col("text"))).alias("i", "c"))
    return rows.select("id", (F.col("i") + 1).cast("long").alias("chunk"), F.length("c").cast("long").alias("size"))


@query(_CHUNKS.replace("text, chr(13) || chr(10), chr(10)", "replace(text, '. ', '.' || chr(10) || chr(10)), chr(13) || chr(10), chr(10)"))
def chunks_of_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a paragraph for every sentence, so that many are packed."""
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.posexplode(X.chunks(F.replace("text", F.lit(". "), F.lit(".\n\n")))).alias("i", "c"))
    return rows.select("id", (F.col("i") + 1).cast("long").alias("chunk"), F.length("c").cast("long").alias("size"))


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'other' END AS kind FROM events")
def media_partition(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    path = F.concat(F.lit("/in/"), F.col("event_id").cast("string"), F.when(k == 0, ".JPG").when(k == 1, ".mp4").when(k == 2, ".wav").otherwise(".txt"))
    return load(spark, sf, "events").select(F.col("event_id").alias("id"), media_kind(path).alias("kind"))


@query(f"SELECT conv_id, turn, CASE WHEN t AND NOT v THEN 'text' WHEN v AND NOT t THEN 'clip' ELSE 'hybrid' END AS route FROM (SELECT conv_id, turn, len(list_filter({OCR_WORDS}, lambda w: contains(lower(text), w))) > 0 AS t, len(list_filter({VISUAL_WORDS}, lambda w: contains(lower(text), w))) > 0 AS v FROM conversations)")
def router(spark: SparkSession, sf: str) -> DataFrame:
    """The keyword router over a table of queries."""
    return load(spark, sf, "conversations").select("conv_id", "turn", route_column(F.col("text")).alias("route"))


_RAW = "CASE p_partkey % 4 WHEN 0 THEN 'x {\"caption\": \"' || p_name || '\", \"summary\": \"' || p_type || '\", \"tags\": [\"' || p_brand || '\", \" B \"]} y' WHEN 1 THEN '\"caption\": \"' || p_name || '\", \"tags\": [\"' || p_brand || '\"], {' WHEN 2 THEN p_name || ',' || chr(10) || '{' || chr(10) || p_type ELSE '' END"


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 3 THEN 'image with identifiable visual content' ELSE p_name END AS caption, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_name WHEN 2 THEN p_type ELSE 'image with identifiable visual content' END AS summary,
    CASE p_partkey % 4 WHEN 0 THEN lower(p_brand) || ',b' WHEN 1 THEN lower(p_brand) WHEN 2 THEN coalesce(nullif(array_to_string(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 3), ','), ''), 'image') ELSE 'image' END AS tags FROM part"""
)
def answers_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a model as whole JSON, as fragments of it, as lines and empty, with their defaults and limits."""
    answer = X.capped(X.parsed(F.expr(_RAW.replace("chr(10)", "char(10)"))))
    rows = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), answer.alias("a"))
    return rows.select("id", "a.caption", "a.summary", F.array_join("a.tags", ",").alias("tags"))


@query("SELECT conv_id, turn, 0.5::DOUBLE AS confidence, 0::BIGINT AS left_, 75::BIGINT AS top FROM conversations WHERE trim(text) <> ''")
def recognised_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Recognised texts as blocks: boxes in pixels from the upper left, mean confidence."""
    box = lambda c: F.struct(F.col("text").alias("text"), F.lit(c).alias("confidence"), F.lit(0.0).alias("x"), F.lit(0.125).alias("y"), F.lit(0.5).alias("w"), F.lit(0.125).alias("h"))
    rows = load(spark, sf, "conversations").where(F.trim("text") != "").select("conv_id", "turn", F.lit(200).alias("width"), F.lit(100).alias("height"), F.to_json(F.array(box(0.25), box(0.75))).alias("recognised"))
    b = text_blocks(rows)
    return b.select("conv_id", "turn", "confidence", F.col("blocks")[0]["bbox"][0].cast("long").alias("left_"), F.col("blocks")[0]["bbox"][1].cast("long").alias("top"))
