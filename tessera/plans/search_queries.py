"""Registered queries: keyword, vector, fusion, rerank, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import blocks as BL
from tessera.operators import cells as CE
from tessera.operators import keyword as K
from tessera.operators import ranking as R
from tessera.operators import spelling as SP
from tessera.sources.tables import catalogue, kept, load, shared_path

from . import search as S
from .likeness import fuzzy_sql, likeness_sql
from .registry import query
from .search_sql import search_sql

# SQL over part names that several statements share.
TOKENS = r"toks AS (SELECT p_partkey AS id, regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+') AS t FROM part), post AS (SELECT term, id, count(*) AS tf, max(dl) AS dl FROM (SELECT id, unnest(t) AS term, len(t) AS dl FROM toks) GROUP BY term, id), stats AS (SELECT count(*) AS nd, avg(len(t)) AS avgdl FROM toks)"


def _bm25_sql(conditions: list[str]) -> str:
    tests = " UNION ALL ".join(f"SELECT id, {i} AS q, tf, dl FROM post WHERE {c}" for i, c in enumerate(conditions))
    return (
        f"{TOKENS}, hit AS ({tests}), per AS (SELECT id, q, sum(tf) AS f, max(dl) AS dl FROM hit GROUP BY id, q), dfs AS (SELECT q, count(*) AS n FROM per GROUP BY q), "
        f"scored AS (SELECT id, -sum(greatest(ln((nd - n + 0.5) / (n + 0.5)), 1e-6::DOUBLE) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25, count(*) AS c FROM per JOIN dfs USING (q) CROSS JOIN stats GROUP BY id HAVING count(*) = {len(conditions)})"
    )


def _tokens(spark, sf):
    return K.tokenised(catalogue(spark, sf), "id", "caption")


@query(f"WITH {_bm25_sql(["term = 'red'", "starts_with(term, 'widget')"])} SELECT id, round(bm25, 6) AS bm25 FROM scored ORDER BY scored.bm25, id LIMIT 50")
def kw_bm25_prefix(spark: SparkSession, sf: str) -> DataFrame:
    t = _tokens(spark, sf)
    return K.bm25(K.postings(t), K.corpus_stats(t), K.query_terms("red widget")).orderBy("bm25", "id").limit(50).select("id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {_bm25_sql(["term = 'old'", "starts_with(term, 'ring')"])} SELECT id, round(bm25, 6) AS bm25 FROM scored ORDER BY scored.bm25, id LIMIT 50")
def kw_bm25_and(spark: SparkSession, sf: str) -> DataFrame:
    t = _tokens(spark, sf)
    return K.bm25(K.postings(t), K.corpus_stats(t), K.query_terms("OLD, ring!")).orderBy("bm25", "id").limit(50).select("id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {TOKENS} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term")
def kw_term_df(spark: SparkSession, sf: str) -> DataFrame:
    return K.term_df(K.postings(_tokens(spark, sf)))


@query(r"SELECT count(*)::BIGINT AS n_docs, round(avg(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))), 6) AS avgdl FROM documents")
def kw_doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    return K.corpus_stats(K.tokenised(load(spark, sf, "documents"), "doc_id", "text")).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_bm25_sql(["starts_with(CASE term WHEN 'large' THEN 'larg' ELSE term END, 'larg')", "starts_with(term, 'rod')"])} SELECT id, round(bm25, 6) AS bm25 FROM scored ORDER BY scored.bm25, id LIMIT 50")
def kw_bm25_porter(spark: SparkSession, sf: str) -> DataFrame:
    """Stems on both sides: the words of parts are their own stems but for large, which loses its e."""
    t = _tokens(spark, sf)
    terms = [(K.stem_word(w), p) for w, p in K.query_terms("Larges, rods")]
    return K.bm25(K.postings(t, stem=True), K.corpus_stats(t), terms).orderBy("bm25", "id").limit(50).select("id", F.round("bm25", 6).alias("bm25"))


@query(
    r"""WITH toks AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents), post AS (SELECT term, id, count(*) AS tf, max(dl) AS dl FROM (SELECT id, unnest(t) AS term, len(t) AS dl FROM toks) GROUP BY term, id),
    stats AS (SELECT count(*) AS nd, avg(len(t)) AS avgdl FROM toks), asked AS (SELECT query_id, len(list_distinct(ts)) AS asked, unnest(list_distinct(ts)) AS term FROM (SELECT item_id AS query_id, regexp_extract_all(lower(trim(text)), '[\p{L}\p{N}_]+') AS ts FROM benchmark)),
    dfs AS (SELECT term, count(*) AS n FROM post GROUP BY term),
    scored AS (SELECT query_id, id, sum(greatest(ln((nd - n + 0.5) / (n + 0.5)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score, count(*) AS c, max(asked) AS a FROM asked JOIN post USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY query_id, id)
    SELECT query_id, id, round(score, 6) AS score FROM scored WHERE c = a"""
)
def kw_bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All benchmark passages as queries: the documents that hold all words of a passage."""
    return _searched(spark, sf, _passage_words())


def _passage_words():
    return F.regexp_extract_all(F.lower(F.trim("text")), F.lit(r"(?U)\w+"), F.lit(0))


def _searched(spark, sf, terms) -> DataFrame:
    t = K.tokenised(load(spark, sf, "documents"), "doc_id", "text")
    asked = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), terms.alias("terms"))
    return K.bm25_batch(K.postings(t), K.corpus_stats(t), asked).select("query_id", "id", F.round(-F.col("bm25"), 6).alias("score"))


@query(
    r"""WITH toks AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents), post AS (SELECT term, id, count(*) AS tf, max(dl) AS dl FROM (SELECT id, unnest(t) AS term, len(t) AS dl FROM toks) GROUP BY term, id), stats AS (SELECT count(*) AS nd, avg(len(t)) AS avgdl FROM toks),
    """
    + _bm25_sql(["term = 'the'", "starts_with(term, 'ther')", "starts_with(term, 'tion')"]).split("FROM toks), ", 1)[1]
    + " SELECT id, round(bm25, 6) AS bm25 FROM scored ORDER BY round(scored.bm25, 9), id LIMIT 50"
)
def kw_top_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The whole texts of documents stored in blocks, and the best of one word and two prefixes from the blocks that can hold them."""
    BL.write(K.tokenised(load(spark, sf, "documents"), "doc_id", "text"), path := shared_path(spark, "blocks"), 16)
    best = BL.best(BL.read(spark, path), K.query_terms("the ther tion"), 50)
    return best.orderBy(F.round("bm25", 9), "id").limit(50).select("id", F.round("bm25", 6).alias("bm25"))


def _half(spark, sf, first: bool) -> DataFrame:
    """The two indexes: dimensions 1-32 stand for images, 33-64 for texts."""
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1 if first else 33, 32).alias("embedding"))


def _asked(rows: DataFrame, n: int = 100) -> DataFrame:
    """The stated query set: every row whose id is divisible by ``n``."""
    return rows.where(F.col("id") % n == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


def _cos_sql(span: str) -> str:
    e = f"list_transform(embedding[{span}], lambda x: x::DOUBLE)"
    return f"v AS (SELECT vec_id AS id, {e} AS e FROM embeddings), knn AS (SELECT q.id AS query_id, v.id AS id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score FROM v q, v WHERE q.id % 100 = 0)"


_TOP = "SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank FROM knn) WHERE rank <= 10"


@query(f"WITH {_cos_sql('1:32')} {_TOP}")
def knn_clip(spark: SparkSession, sf: str) -> DataFrame:
    v = _half(spark, sf, True)
    return R.knn_batch(v, _asked(v), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_cos_sql('33:64')} {_TOP}")
def knn_text(spark: SparkSession, sf: str) -> DataFrame:
    v = _half(spark, sf, False)
    return R.knn_batch(v, _asked(v), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_cos_sql('1:64')} {_TOP}")
def knn_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth vector as a query of a stored index of cells: the ten nearest of all vectors, whole."""
    v = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    CE.write(v, path := shared_path(spark, "cells"), files=16)
    return CE.nearest(CE.read(spark, path), _asked(v), 10, kept).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT v.id AS id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score FROM v q, v WHERE q.id = 7 ORDER BY list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) DESC, v.id LIMIT 20")
def knn_literal(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    own = rows.where("id = 7").first()
    return R.knn(rows, list(own["embedding"]), 20).select("id", F.round("score", 6).alias("score"))


@query("WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round((e[1] / sqrt(list_dot_product(e, e))), 6) AS first FROM v")
def vector_unit_norm(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.element_at(V.unit(F.col("embedding")), 1), 6).alias("first"))


def _lists(spark, sf):
    a, b = _half(spark, sf, True), _half(spark, sf, False)
    return R.knn_batch(a, _asked(a), 20), R.knn_batch(b, _asked(b), 20)


def _lists_sql() -> str:
    parts = []
    for name, span in (("a", "1:32"), ("b", "33:64")):
        parts.append(
            f"v{name} AS (SELECT vec_id AS id, list_transform(embedding[{span}], lambda x: x::DOUBLE) AS e FROM embeddings), k{name} AS (SELECT q.id AS query_id, v.id AS id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score FROM v{name} q, v{name} v WHERE q.id % 100 = 0), "
            f"l{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank FROM k{name}) WHERE rank <= 20)"
        )
    return ", ".join(parts)


_NORM = "n{0} AS (SELECT query_id, id, greatest(0, score) / CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN max(score) OVER (PARTITION BY query_id) ELSE 1 END AS s FROM l{0})"
WEIGHTED = f"{_lists_sql()}, {_NORM.format('a')}, {_NORM.format('b')}, f AS (SELECT coalesce(na.query_id, nb.query_id) AS query_id, coalesce(na.id, nb.id) AS id, 0.6::DOUBLE * coalesce(na.s, 0) + 0.4::DOUBLE * coalesce(nb.s, 0) AS score FROM na FULL JOIN nb ON na.query_id = nb.query_id AND na.id = nb.id)"
RRF = f"{_lists_sql()}, f AS (SELECT coalesce(la.query_id, lb.query_id) AS query_id, coalesce(la.id, lb.id) AS id, la.rank AS left_rank, lb.rank AS right_rank, coalesce(0.62::DOUBLE / (60 + la.rank), 0) + coalesce(0.38::DOUBLE / (60 + lb.rank), 0) AS score FROM la FULL JOIN lb ON la.query_id = lb.query_id AND la.id = lb.id)"


@query(f"WITH {WEIGHTED} SELECT query_id, id, round(score, 6) AS score FROM f")
def fuse_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return R.fuse_weighted(*_lists(spark, sf)).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"WITH {RRF} SELECT query_id, id, left_rank, right_rank, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, least(coalesce(left_rank, 999), coalesce(right_rank, 999)), id)::BIGINT AS rank FROM f")
def fuse_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return R.fuse_rrf(*_lists(spark, sf)).select("query_id", "id", "left_rank", "right_rank", F.round("score", 9).alias("score"), "rank")


@query("WITH l AS (SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS s FROM events), f AS (SELECT *, 0.5::DOUBLE / (1 + r) + 0.5::DOUBLE / (1 + s) AS score FROM l) SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, least(r, s), id)::BIGINT AS rank FROM f")
def fuse_rrf_ties(spark: SparkSession, sf: str) -> DataFrame:
    """The events of each user in order and in opposite order: every event ties with its counterpart, and the smaller id comes first."""
    e = load(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"))
    a, b = R.ranked(e.withColumn("score", -F.col("id").cast("double"))), R.ranked(e.withColumn("score", F.col("id").cast("double")))
    return R.fuse_rrf(a, b, 1.0, 0.5, 0.5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("WITH l AS (SELECT user_id AS query_id, event_id AS id, value AS score FROM events) SELECT query_id, id, round(greatest(0, score) / CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN max(score) OVER (PARTITION BY query_id) ELSE 1 END, 6) AS norm FROM l")
def score_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score"))
    return R.normalised(rows).select("query_id", "id", F.round("norm", 6).alias("norm"))


def _hybrid_lists(spark, sf):
    t = _tokens(spark, sf)
    hits = K.bm25(K.postings(t), K.corpus_stats(t), K.query_terms("red widget")).select(F.lit(0).alias("query_id"), "id", (-F.col("bm25")).alias("score"))
    rows = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    vector = list(rows.where("id = 7").first()["embedding"])
    return R.ranked(hits, 40), R.ranked(R.knn(rows, vector, 40).withColumn("query_id", F.lit(0)))


@query(
    f"""WITH {_bm25_sql(["term = 'red'", "starts_with(term, 'widget')"])}, kw AS (SELECT id, row_number() OVER (ORDER BY bm25, id) AS r FROM scored QUALIFY r <= 40),
    v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), sim AS (SELECT v.id AS id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS s FROM v q, v WHERE q.id = 7),
    sem AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM sim QUALIFY r <= 40), f AS (SELECT coalesce(kw.id, sem.id) AS id, kw.r AS a, sem.r AS b, coalesce(0.62::DOUBLE / (60 + kw.r), 0) + coalesce(0.38::DOUBLE / (60 + sem.r), 0) AS score FROM kw FULL JOIN sem ON kw.id = sem.id),
    top AS (SELECT *, row_number() OVER (ORDER BY score DESC, least(coalesce(a, 999), coalesce(b, 999)), id)::BIGINT AS rank FROM f)
    SELECT rank, id, p_name AS caption, round(score, 9) AS score FROM top JOIN part ON p_partkey = id WHERE rank <= 20"""
)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword and vector ranks fused, with metadata attached: the flagship."""
    fused = R.fuse_rrf(*_hybrid_lists(spark, sf)).where("rank <= 20").select("id", "rank", "score")
    return catalogue(spark, sf).select("id", "caption").join(F.broadcast(fused), "id").select("rank", "id", "caption", F.round("score", 9).alias("score"))


_SIM = "list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)))"


def _near_sql(name: str, span: str, depth: int) -> str:
    e = f"list_transform(embedding[{span}], lambda x: x::DOUBLE)"
    return f"v{name} AS (SELECT vec_id AS id, {e} AS e FROM embeddings), {name} AS (SELECT v.id AS id, {_SIM} AS score, row_number() OVER (ORDER BY {_SIM} DESC, v.id) AS rank FROM v{name} q, v{name} v WHERE q.id = 7 QUALIFY rank <= {depth})"


def _hybrid_sql(depth: int, w_clip: float, w_text: float) -> str:
    norm = lambda n: f"n{n} AS (SELECT id, score, greatest(0, score) / CASE WHEN max(score) OVER () > 0 THEN max(score) OVER () ELSE 1 END AS s FROM {n})"
    both = f"found AS (SELECT id, score, coalesce(text_score, 0) AS text_score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT coalesce(nclip.id, ntext.id) AS id, {w_clip}::DOUBLE * coalesce(nclip.s, 0) + {w_text}::DOUBLE * coalesce(ntext.s, 0) AS score, round(ntext.score, 6) AS text_score FROM nclip FULL JOIN ntext ON nclip.id = ntext.id))"
    return f"{_near_sql('clip', '1:32', depth)}, {_near_sql('text', '33:64', depth)}, {norm('clip')}, {norm('text')}, {both}"


def _index(spark, sf, scorer: str | None = None) -> tuple[S.Index, dict]:
    """Parts with the two halves of the vectors as image and text index, and the halves of vector 7."""
    clip, text = _half(spark, sf, True), _half(spark, sf, False)
    own = load(spark, sf, "embeddings").where("vec_id = 7").first()["embedding"]
    return S.build(catalogue(spark, sf), clip, text, scorer), {"clip": list(own[:32]), "text": list(own[32:])}


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("rank", "id", "caption", "score", *[F.round(c, 6).alias(c) for c in ("semantic_overlap", "attribute_score", "presence_score")])


_KEYWORDS = _bm25_sql(["term = 'red'", "starts_with(term, 'widget')"])


@query(search_sql(f"{_near_sql('text', '33:64', 40)}, found AS (SELECT * FROM text)", "red widgit", 10, ("widget",)))
def search_auto(spark: SparkSession, sf: str) -> DataFrame:
    """The whole search plan of a misspelt query: no keyword hits, so vectors, then every rerank with the correction."""
    index, own = _index(spark, sf)
    return _shown(S.search(index, "red widgit", own["text"], 10))


@query(search_sql(f"{_KEYWORDS}, found AS (SELECT id, 1.0::DOUBLE AS score, row_number() OVER (ORDER BY bm25, id) AS rank FROM scored QUALIFY rank <= 10)", "red widget", 10))
def search_keyword(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(S.search(_index(spark, sf)[0], "red widget", None, 10, "keyword"))


@query(search_sql(f"{_KEYWORDS}, kw AS (SELECT id, row_number() OVER (ORDER BY bm25, id) AS r FROM scored QUALIFY r <= 40), {_near_sql('text', '33:64', 40)}, found AS (SELECT *, row_number() OVER (ORDER BY score DESC, least(coalesce(a, 999), coalesce(b, 999)), id) AS rank FROM (SELECT coalesce(kw.id, text.id) AS id, kw.r AS a, text.rank AS b, coalesce(0.62::DOUBLE / (60 + kw.r), 0) + coalesce(0.38::DOUBLE / (60 + text.rank), 0) AS score FROM kw FULL JOIN text ON kw.id = text.id))", "red widget", 10, cross_depth=20))
def search_fused(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords and vectors by reciprocal ranks, and the cross rerank of the first twenty by the stand-in scorer."""
    index, own = _index(spark, sf, "overlap")
    return _shown(S.search(index, "red widget", own["text"], 10))


@query(search_sql(f"{_near_sql('clip', '1:32', 20)}, found AS (SELECT * FROM clip)", "red widget poster", 10))
def search_semantic_clip(spark: SparkSession, sf: str) -> DataFrame:
    """A query whose words ask for pictures goes to the image vectors."""
    index, own = _index(spark, sf)
    return _shown(S.search(index, "red widget poster", own["clip"], 10, "semantic"))


@query(search_sql(f"{_near_sql('text', '33:64', 20)}, found AS (SELECT * FROM text)", "red widget invoice", 10))
def search_semantic_text(spark: SparkSession, sf: str) -> DataFrame:
    """A query whose words ask for texts goes to the text vectors."""
    index, own = _index(spark, sf)
    return _shown(S.search(index, "red widget invoice", own["text"], 10, "semantic"))


def _same_width(spark, sf) -> tuple[S.Index, list[float]]:
    """Both indexes searched by one vector, the text half."""
    index, own = _index(spark, sf)
    return index, own["text"]


def _one_vector_sql(depth: int, w_clip: float, w_text: float) -> str:
    """The hybrid candidates where the text half of vector 7 searches both indexes."""
    sql = _hybrid_sql(depth, w_clip, w_text)
    own = "q7 AS (SELECT vec_id AS id, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id = 7), "
    return own + sql.replace("FROM vclip q, vclip v", "FROM q7 q, vclip v")


@query(search_sql(_one_vector_sql(20, 0.45, 0.55), "red widget", 10, hybrid=True))
def search_semantic_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Both vector indexes, normalised and summed by the weights of the query's kind."""
    index, own = _same_width(spark, sf)
    return _shown(S.search(index, "red widget", own, 10, "semantic"))


@query(f"WITH {_near_sql('clip', '1:32', 10)} SELECT p_partkey AS id, p_name AS caption, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, rank)::BIGINT AS rank FROM clip JOIN part ON p_partkey = id")
def search_image(spark: SparkSession, sf: str) -> DataFrame:
    """Search by an image's vector: the image index, and the penalty."""
    index, own = _index(spark, sf)
    return S.search(index, "", image=own["clip"], k=10).select("rank", "id", "caption", "score")


def _first(sql: str, k: int) -> str:
    """Candidates cut to the first k that have an item, before any rerank."""
    return sql.replace("found AS (", "every AS (", 1) + f", found AS (SELECT * FROM every WHERE id IN (SELECT p_partkey FROM part) QUALIFY row_number() OVER (ORDER BY round(score, 6) DESC, rank) <= {k})"


@query(search_sql(_first(f"{_near_sql('clip', '1:32', 15)}, found AS (SELECT * FROM clip)", 10), "red widget", None))
def forced_clip(spark: SparkSession, sf: str) -> DataFrame:
    index, own = _index(spark, sf)
    return _shown(S.forced(index, "red widget", own["clip"], "clip", 10))


@query(search_sql(_first(f"{_near_sql('text', '33:64', 15)}, found AS (SELECT * FROM text)", 10), "red widget", None))
def forced_text(spark: SparkSession, sf: str) -> DataFrame:
    index, own = _index(spark, sf)
    return _shown(S.forced(index, "red widget", own["text"], "text", 10))


@query(search_sql(_first(_one_vector_sql(20, 0.45, 0.55), 10), "red widget", None, hybrid=True))
def forced_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    index, own = _same_width(spark, sf)
    return _shown(S.forced(index, "red widget", own, "hybrid", 10))


@query(
    f"""WITH {TOKENS}, asked AS (SELECT id AS query_id, len(list_distinct(t)) AS asked, unnest(list_distinct(t)) AS term FROM toks WHERE id % 100 = 0), dfs AS (SELECT term, count(*) AS n FROM post GROUP BY term),
    s AS (SELECT query_id, id, sum(greatest(ln((nd - n + 0.5) / (n + 0.5)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score, count(*) AS c, max(asked) AS a FROM asked JOIN post USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY query_id, id HAVING count(*) = max(asked))
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s.score, 9) DESC, id)::BIGINT AS rank FROM s QUALIFY rank <= 10"""
)
def search_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The caption of every hundredth part as a query."""
    index = S.build(catalogue(spark, sf))
    asked = catalogue(spark, sf).where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), F.col("caption").alias("text"))
    return S.batch(index, asked, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_FUZZY = "red widgit".split()
_PART_LIST = "l AS (SELECT p_partkey AS id, 1 / (1 + p_size::DOUBLE) AS score FROM part), b AS (SELECT p_partkey AS id, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part), w AS (SELECT DISTINCT w FROM b)"


@query(
    f"""WITH RECURSIVE {_PART_LIST}, asked AS (SELECT unnest(['red', 'widgit']) AS t), {likeness_sql()}, {fuzzy_sql('fuzz', _FUZZY, 0.84, 'b')},
    v AS (SELECT l.id AS id, coalesce(fuzzy, 0) AS fuzzy, least(1, greatest(0, score / max(score) OVER ())) AS norm FROM l LEFT JOIN fuzz ON fuzz.id = l.id), g AS (SELECT *, 0.85::DOUBLE * (0.85::DOUBLE * norm + 0.15::DOUBLE * norm) + 0.15::DOUBLE * fuzzy AS s FROM v),
    h AS (SELECT id, fuzzy, round(CASE WHEN max(fuzzy) OVER () >= 0.3 AND fuzzy = 0 THEN s * (0.85::DOUBLE + 0.15::DOUBLE * norm) ELSE s END, 6) AS s FROM g)
    SELECT row_number() OVER (ORDER BY s DESC, h.fuzzy DESC, id)::BIGINT AS rank, id, s AS score, round(fuzzy, 6) AS fuzzy FROM h QUALIFY rank <= 100"""
)
def fuzzy_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalogue(spark, sf).select(F.lit(0).alias("query_id"), "id", "caption", (1.0 / (1 + F.col("p_size"))).alias("score"))
    return R.fuzzy_rank(rows, _FUZZY, F.col("caption"), typos=True, apart=True).where("rank <= 100").select("rank", "id", F.round("score", 6).alias("score"), F.round("fuzzy", 6).alias("fuzzy"))


@query(
    f"""WITH RECURSIVE b AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part), w AS (SELECT w FROM b WHERE length(w) >= 3), asked AS (SELECT unnest(['widgit', 'yelow', 'gadgte']) AS t), {likeness_sql()}
    SELECT t AS term, arg_min(w, (-ratio, w)) AS correction, round(max(ratio), 6) AS ratio FROM alike WHERE t <> w AND ratio >= 0.8 GROUP BY t"""
)
def fuzzy_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections of terms of five letters or more."""
    vocab = R.vocabulary(catalogue(spark, sf), F.col("caption"))
    return R.corrections(vocab, ["widgit", "smal", "yelow", "gadgte"]).select("term", "correction", F.round("ratio", 6).alias("ratio"))


@query(
    f"""WITH RECURSIVE b AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part), w AS (SELECT w FROM b WHERE length(w) >= 3), asked AS (SELECT DISTINCT left(w, i::INT - 1) || substr(w, i::INT + 1) AS t FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM b) WHERE length(w) > 5), {likeness_sql()}
    SELECT t AS term, arg_min(w, (-ratio, w)) AS correction, round(max(ratio), 6) AS ratio FROM alike WHERE t <> w AND ratio >= 0.8 GROUP BY t"""
)
def corrections_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of six letters or more of all parts with each of its letters left out in turn, and what it is taken for."""
    words = catalogue(spark, sf).select(F.explode(F.split(F.lower("caption"), " ")).alias("token")).distinct()
    typos = words.where(F.length("token") > 5).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.concat(F.col("token").substr(F.lit(1), i - 1), F.col("token").substr(i + 1, F.length("token"))))).alias("term"))
    return SP.corrections(typos, words).select("term", "correction", F.round("ratio", 6).alias("ratio"))


@query(r"SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(trim(p_name)), '[\p{L}\p{N}_]+'))) AS token FROM part) WHERE length(token) >= 3 GROUP BY token ORDER BY count(*) DESC, token LIMIT 4000")
def fuzzy_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return R.vocabulary(catalogue(spark, sf), F.col("caption"))


@query(
    f"""WITH RECURSIVE {_PART_LIST}, asked AS (SELECT unnest(['red', 'widget']) AS t), {likeness_sql()}, {fuzzy_sql('o', ['widget', 'red'], 0.84, 'b')}, {fuzzy_sql('a', ['red'], 0.84, 'b')}, {fuzzy_sql('c', ['red'], 0.88, 'b')},
    x AS (SELECT l.id AS id, score / max(score) OVER () AS vs, coalesce(o.fuzzy, 0) AS so, least(1, coalesce(a.fuzzy, 0) + 0.2::DOUBLE * coalesce(c.fuzzy, 0)) AS ats, (l.id IN (SELECT id FROM b WHERE w = 'widget'))::INT AS ps FROM l LEFT JOIN o ON o.id = l.id LEFT JOIN a ON a.id = l.id LEFT JOIN c ON c.id = l.id),
    f AS (SELECT *, round((0.58::DOUBLE * vs + 0.42::DOUBLE * so + 0.2::DOUBLE * ats + 0.1::DOUBLE * ps) * CASE WHEN ps < 0.5 THEN 0.4::DOUBLE ELSE 1 END, 6) AS s FROM x) SELECT row_number() OVER (ORDER BY s DESC, id)::BIGINT AS rank, id, s AS score, round(ats, 6) AS attribute_score, ps::DOUBLE AS presence_score FROM f QUALIFY rank <= 100"""
)
def intent_rank(spark: SparkSession, sf: str) -> DataFrame:
    from .intent import parse

    rows = catalogue(spark, sf).select(F.lit(0).alias("query_id"), "id", "caption", "summary", (1.0 / (1 + F.col("p_size"))).alias("score"))
    intent = parse("red widget")
    return R.intent_rank(rows, intent, F.concat_ws(" ", "caption", "summary"), w_retrieval=0.58, presence_required=True, apart=True).where("rank <= 100").select("rank", "id", "score", F.round("attribute_score", 6).alias("attribute_score"), F.round("presence_score", 6).alias("presence_score"))


@query(
    """WITH r AS (SELECT event_id AS id, value AS score, CASE event_id % 5 WHEN 0 THEN '{' WHEN 1 THEN '{"caption": "x' WHEN 2 THEN '' ELSE event_type END AS caption, CASE event_id % 3 WHEN 0 THEN '[' ELSE event_type END AS summary FROM events),
    b AS (SELECT *, trim(caption) IN ('', '{', '}', '[', ']') OR starts_with(trim(caption), '{"') AS bc, trim(summary) IN ('', '{', '}', '[', ']') AS bs FROM r) SELECT id, round(score * CASE WHEN bc THEN 0.55::DOUBLE ELSE 1 END * CASE WHEN bs THEN 0.70::DOUBLE ELSE 1 END, 6) AS score FROM b"""
)
def quality_penalty(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    kind = F.col("event_id") % 5
    caption = F.when(kind == 0, "{").when(kind == 1, '{"caption": "x').when(kind == 2, "").otherwise(F.col("event_type"))
    rows = e.select(F.col("event_id").alias("id"), F.col("value").alias("score"), caption.alias("caption"), F.when(F.col("event_id") % 3 == 0, "[").otherwise(F.col("event_type")).alias("summary"))
    return R.quality_penalty(rows).select("id", F.round("score", 6).alias("score"))


_USER_LISTS = "l AS (SELECT user_id AS query_id, event_id AS id, least(1, value / 100) AS score, row_number() OVER (PARTITION BY user_id ORDER BY least(1, value / 100) DESC, event_id)::BIGINT AS rank FROM events)"


def _user_lists(spark, sf) -> DataFrame:
    rows = load(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"), "event_type")
    return R.ranked(rows)


@query(
    f"""WITH {_USER_LISTS}, c AS (SELECT l.*, count(*) OVER (PARTITION BY query_id) AS n FROM l), x AS (SELECT *, CASE WHEN rank <= 6 AND n >= 2 THEN 1 / (1 + exp(-((id % 7) - 3.0::DOUBLE))) END AS cross_ FROM c),
    y AS (SELECT query_id, id, rank AS was, cross_, score AS base, CASE WHEN cross_ IS NULL THEN score ELSE 0.58::DOUBLE * score + 0.42::DOUBLE * cross_ END AS score FROM x)
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY cross_ IS NULL, CASE WHEN cross_ IS NOT NULL THEN -score END, cross_ DESC, base DESC, was)::BIGINT AS rank FROM y"""
)
def cross_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Head-only fusion with a stub scorer's logit."""
    return R.cross_rerank(_user_lists(spark, sf), (F.col("id") % 7 - 3).cast("double"), 6).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


CONFIDENCE = f"""{_USER_LISTS}, t AS (SELECT query_id, coalesce(max(CASE WHEN rank = 1 THEN score END), 0) AS top1, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS top2, count(*) AS n FROM l GROUP BY query_id),
    c AS (SELECT query_id, greatest(0, least(1, top1)) AS top1, CASE WHEN n > 1 THEN greatest(0, least(1, top1 - top2)) ELSE top1 END AS margin FROM t), d AS (SELECT *, 0.45::DOUBLE * top1 + 0.25::DOUBLE * margin AS confidence FROM c)"""


@query(f"WITH {CONFIDENCE} SELECT query_id, round(confidence, 6) AS confidence, round(margin, 6) AS margin, CASE WHEN confidence >= 0.70 THEN 'high' WHEN confidence < 0.46 THEN 'low' ELSE 'medium' END AS band, CASE WHEN confidence < 0.46 THEN concat_ws(',', 'weak_lexical_support', CASE WHEN top1 < 0.6 THEN 'low_top1_score' END, CASE WHEN margin < 0.08 THEN 'weak_top2_margin' END) ELSE '' END AS abstain_reason FROM d")
def confidence_batch(spark: SparkSession, sf: str) -> DataFrame:
    return R.confidence(_user_lists(spark, sf)).select("query_id", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), "band", "abstain_reason")


@query(f"WITH {CONFIDENCE}, g AS (SELECT *, query_id % 3 <> 0 AS has FROM d) SELECT query_id, CASE WHEN NOT has THEN 'no_constraints' WHEN confidence < 0.46 THEN 'below_abstain_threshold' WHEN confidence >= 0.70 THEN 'above_verify_threshold' ELSE 'medium_confidence' END AS verify_reason, has AND confidence >= 0.46 AND confidence < 0.70 AS verify FROM g")
def verify_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.confidence(_user_lists(spark, sf)).withColumn("has_constraints", F.col("query_id") % 3 != 0)
    return R.verify_gate(rows).select("query_id", "verify_reason", "verify")


@query(f"WITH {_USER_LISTS}, v AS (SELECT *, CASE id % 4 WHEN 0 THEN 1.20::DOUBLE WHEN 1 THEN 0.35::DOUBLE ELSE 1 END AS f FROM l WHERE rank <= 10) SELECT query_id, id, round(score * f, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score * f DESC, id)::BIGINT AS rank FROM v")
def verify_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    rows = _user_lists(spark, sf).where("rank <= 10").drop("event_type")
    verdicts = rows.where(F.col("id") % 4 < 2).select("query_id", "id", (F.col("id") % 4 == 0).alias("ok"))
    return R.apply_verdicts(rows, verdicts).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_USER_LISTS}, m AS (SELECT query_id, rank, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS margin, score FROM l) SELECT query_id, round(coalesce(margin, score), 6) AS margin FROM m WHERE rank = 1")
def top2_margin(spark: SparkSession, sf: str) -> DataFrame:
    c = R.confidence(_user_lists(spark, sf))
    return c.select("query_id", F.round("margin", 6).alias("margin"))


@query(
    f"""WITH {_USER_LISTS}, t AS (SELECT query_id, list(lower(event_type)) AS x FROM l JOIN events ON event_id = id WHERE rank <= 3 GROUP BY query_id)
    SELECT query_id, round(((CASE WHEN len(list_filter(x, lambda y: contains(y, 'click'))) > 0 THEN 1 ELSE 0 END) + (CASE WHEN len(list_filter(x, lambda y: contains(y, 'err'))) > 0 THEN 1 ELSE 0 END)) / 2::DOUBLE, 6) AS lexical_support FROM t"""
)
def lexical_support(spark: SparkSession, sf: str) -> DataFrame:
    rows = _user_lists(spark, sf)
    terms = rows.select("query_id").distinct().withColumn("terms", F.array(F.lit("click"), F.lit("err")))
    return R.lexical_support(rows, terms, F.col("event_type")).select("query_id", F.round("lexical_support", 6).alias("lexical_support"))
