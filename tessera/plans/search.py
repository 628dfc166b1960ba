"""Search plans: one DataFrame for a query, composed of stages; early actions read bounded lists alone.

Stages: candidates by keywords, vectors or both; metadata; quality penalty; cross rerank of the head; fuzzy rerank with
corrections of misspelt words; intent rerank; confidence; verification.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import models as M
from tessera.functions import text as X
from tessera.operators import blocks as BL
from tessera.operators import keyword as K
from tessera.operators import ranking as R

from . import intent as I

HARD_CUTOFF, FALLBACK = 150, 3
CROSS_WEIGHT = 0.42
#: Weights of the fuzzy rerank (semantic, fuzzy) and of retrieval in the intent rerank, by kind of query.
FUZZY = {"generic": (0.93, 0.07), "attribute": (0.90, 0.10)}
RETRIEVAL = {"generic": 0.72, "attribute": 0.58}
#: Fixed words that say nothing of a query's subject.
EMPTY_WORDS = frozenset("the and for with what when where which show image images photo photos find does is are was were have has had tell please can could would should".split())


@dataclass
class Index:
    """What a search reads: items (id, caption, summary, tags, ...), postings (in blocks, if they are stored so), statistics and vectors by model."""

    items: DataFrame
    postings: DataFrame
    stats: DataFrame
    clip: DataFrame | None = None
    text: DataFrame | None = None
    scorer: str | None = None
    blocks: BL.Blocks | None = None
    people: bool = True  # whether items may show persons; queries of others never require one

    def body(self) -> Column:
        more = [c for c in ("ocr_structured",) if c in self.items.columns]
        return F.concat_ws(" ", "caption", "summary", *more, F.array_join("tags", " "))


@dataclass
class Answer:
    """Rows of results with their component scores, how they were found, and one row of confidence."""

    rows: DataFrame
    route: str
    reason: str
    intent: I.Intent
    policy: I.Policy
    confidence: DataFrame


def build(items: DataFrame, clip: DataFrame | None = None, text: DataFrame | None = None, scorer: str | None = None) -> Index:
    """An index over a table, computed by each search; ``store`` and ``stored`` keep it."""
    tokens = K.tokenised(items, "id", "caption")
    return Index(items, K.postings(tokens), K.corpus_stats(tokens), clip, text, scorer)


def store(items: DataFrame, name: str, buckets: int = 64, blocks: str | None = None, files: int = 64) -> None:
    """Write postings (bucketed by term), statistics and normalised items as tables; texts are brought to NFKC here, once.

    With a path ``blocks`` the postings go there in blocks with their best impacts, in files by ranges of terms, and not in buckets.
    """
    plain = items.withColumns({c: X.nfkc(F.col(c)) for c in ("caption", "summary")})
    plain.write.mode("overwrite").saveAsTable(f"{name}_items")
    tokens = K.tokenised(items.sparkSession.table(f"{name}_items"), "id", "caption")
    if blocks:
        BL.write(tokens, blocks, files)
    else:
        K.write_index(tokens, f"{name}_postings", buckets)
    K.corpus_stats(tokens).write.mode("overwrite").saveAsTable(f"{name}_stats")


def stored(spark: SparkSession, name: str, clip: DataFrame | None = None, text: DataFrame | None = None, scorer: str | None = None, blocks: str | None = None) -> Index:
    """The index that ``store`` wrote: a search tokenises nothing and counts nothing again."""
    held = BL.read(spark, blocks) if blocks else None
    postings = held.flat() if held else K.read_index(spark, f"{name}_postings")
    return Index(spark.table(f"{name}_items"), postings, spark.table(f"{name}_stats"), clip, text, scorer, held)


def keyword(index: Index, query: str, k: int) -> DataFrame:
    """(query_id, id, score, rank) by BM25, ties to the latest update, then the id; the score is the lexical one."""
    terms = K.query_terms(query)
    hits = BL.best(index.blocks, terms, k) if index.blocks else K.bm25(index.postings, index.stats, terms)
    order = [F.col("bm25")]
    if "updated_at" in index.items.columns:
        hits = hits.join(index.items.select("id", "updated_at"), "id", "left")
        order.append(F.desc_nulls_last("updated_at"))
    best = hits.orderBy(*order, "id").limit(k).withColumn("query_id", F.lit(0))
    by = Window.partitionBy("query_id").orderBy(*order, "id")
    return best.select("query_id", "id", K.lexical_score(F.col("bm25")).alias("score"), F.row_number().over(by).cast("long").alias("rank"))


def vector(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    return R.ranked(R.knn(rows, query, k).withColumn("query_id", F.lit(0)))


def projected(items: DataFrame) -> DataFrame:
    """Items as results show them: captions and summaries repaired, tags as a list."""
    caption, summary = X.repaired(F.col("caption"), F.col("summary"))
    listed = {"tags": X.tags(F.col("tags"))} if items.schema["tags"].dataType.typeName() == "string" else {}
    return items.withColumns({"caption": caption, "summary": summary, **listed})


def attach(index: Index, rows: DataFrame) -> DataFrame:
    """Results with their items' columns, scores to six places; ids without an item go."""
    return projected(index.items.join(F.broadcast(rows.withColumn("score", F.round("score", 6))), "id"))  # a result list of 200 rows at most


def local(rows: DataFrame, most: int = 1000) -> DataFrame:
    """A list of results, computed now and held by the plan itself, so that no later stage reads the index again.

    Lists are cut to some 200 rows before they come here; a longer one than ``most`` is left as it is.
    """
    held = rows.limit(most + 1).collect()
    return rows.sparkSession.createDataFrame(held, rows.schema) if len(held) <= most else rows


def corrected(rows: DataFrame, intent: I.Intent, body: Column) -> list[str]:
    """Words of the candidates that misspelt words of the query stand for; the list of candidates is bounded."""
    long = [t for t in intent.tokens if len(t) >= 5]
    if not long:
        return []
    found = {r["term"]: r["correction"] for r in R.corrections(R.vocabulary(rows, body), long).collect()}
    return I.distinct(found.get(t) for t in long)


def rerank(index: Index, rows: DataFrame, query: str, intent: I.Intent, policy: I.Policy) -> DataFrame:
    """The fuzzy rerank, the earlier and the present rerank by intent, with the weights of the query's kind."""
    more = corrected(rows, intent, index.body())
    alpha, beta = FUZZY.get(policy.query_type, (0.8, 0.2))
    hybrid = "source" in rows.columns and rows.select("source").limit(1).collect() == [("hybrid",)]
    # every term is held against the words of the list once
    terms = I.distinct([*intent.tokens, *more])
    every = [t for t in I.distinct([*terms, *intent.retrieval_terms, *intent.attribute_terms, *intent.relation_terms]) if len(t) >= 2]
    names = {t: f"like_{i}" for i, t in enumerate(every)}
    rows = local(rows.withColumns({names[t]: R.likeness(t, index.body()) for t in every})) if every else rows
    known = {t: F.col(name) for t, name in names.items()}
    rows = R.fuzzy_rank(rows, terms, index.body(), alpha=alpha, beta=beta, typos=bool(more), hybrid=hybrid, known=known)
    rows = R.compatibility_rank(rows, intent, index.body(), known=known)
    return R.intent_rank(rows, intent, index.body(), w_retrieval=RETRIEVAL.get(policy.query_type, 0.60), penalty=policy.penalty, presence_required=policy.presence_required, known=known).drop(*names.values())


def confidence(index: Index, rows: DataFrame, query: str) -> DataFrame:
    """One row: composite confidence, band and abstention of a ranked list."""
    terms = I.distinct(w for w in re.findall("[a-z0-9_]+", query.lower()) if len(w) > 2 and w not in EMPTY_WORDS)
    one = rows.sparkSession.range(1).select(F.lit(0).alias("query_id"), (F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")).alias("terms"))
    return R.confidence(rows, R.lexical_support(rows, one, index.body()))


def _query_vector(index: Index, intent: I.Intent, query: str, given, embedder: str | None):
    if given is not None or embedder is None:
        return given
    return list(M.query_vector(embedder, " ".join(intent.retrieval_terms) or query))


def _hybrid(index: Index, vector_query, depth: int, policy: I.Policy) -> DataFrame:
    """Image and text vectors fused by the policy's weights; both component scores stay."""
    clip, text = vector(index.clip, vector_query, depth), vector(index.text, vector_query, depth)
    fused = R.fuse_weighted(clip, text, policy.w_clip, policy.w_text)
    own = lambda rows, name: rows.select("query_id", "id", F.round("score", 6).alias(name))
    return fused.select("query_id", "id", "score", "rank").join(own(clip, "clip_score"), ["query_id", "id"], "left").join(own(text, "text_score"), ["query_id", "id"], "left").na.fill(0.0, ["clip_score", "text_score"]).withColumn("source", F.lit("hybrid"))


def run(
    index: Index,
    query: str,
    vector_query: list[float] | None = None,
    k: int = 10,
    mode: str = "auto",
    image: list[float] | None = None,
    strategy: str = "hybrid",
    fallback: int = FALLBACK,
    embedder: str | None = None,
    verdicts: DataFrame | None = None,
) -> Answer:
    """A search with everything that was decided on the way.

    Modes: keyword; semantic (routed to image vectors, text vectors or both by the query's words); auto, which by
    strategy hybrid takes vectors if there are no keyword hits, keywords alone over HARD_CUTOFF hits and else both by
    reciprocal ranks, and by strategy legacy takes keywords over ``fallback`` hits and else vectors. ``image`` searches
    by an image's vector. ``verdicts`` (query_id, id, ok) are what a verifier said of the top rows; they count if the
    gate lets them.
    """
    if mode not in ("auto", "keyword", "semantic") or strategy not in ("hybrid", "legacy"):
        raise ValueError("mode is auto, keyword or semantic; strategy is hybrid or legacy")
    if image is not None and mode == "keyword":
        raise ValueError("keywords don't search by an image")
    if not query and image is None:
        raise ValueError("a query or an image is needed")
    intent = I.parse(query, index.people)
    policy = I.policy(intent)
    depth, deep = I.candidate_depth(k), I.policy_depth(k, policy.multiplier)
    vector_query = _query_vector(index, intent, query, vector_query, embedder)
    no_text = vector_query is None or index.text is None
    hits = 0
    if image is not None:
        found, route, reason = vector(index.clip, image, k), "clip", "image input"
    elif mode == "keyword" or (mode == "auto" and no_text):
        found, route, reason = keyword(index, query, k), "keyword", "keyword search"
        hits = k
    elif mode == "semantic":
        route = I.route(query)
        route = "text" if index.clip is None else route
        reason = "words of the query"
        found = _hybrid(index, vector_query, deep, policy) if route == "hybrid" else vector(index.clip if route == "clip" else index.text, vector_query, deep)
    else:
        listed = local(keyword(index, query, depth))
        hits = listed.count()
        over = hits > (fallback if strategy == "legacy" else HARD_CUTOFF)
        if over:
            found, route, reason = listed.where(F.col("rank") <= k), "keyword", f"{hits} keyword hits"
        elif hits == 0 or strategy == "legacy":
            found, route, reason = vector(index.text, vector_query, depth if strategy == "hybrid" else deep), "keyword+semantic_fallback", f"{hits} keyword hits"
        else:
            found = R.fuse_rrf(listed, vector(index.text, vector_query, depth)).select("query_id", "id", "score", "rank")
            route, reason = "keyword+semantic_hybrid", f"{hits} keyword hits"
    rows = local(R.reranked(R.quality_penalty(attach(index, found))))
    if query and index.scorer and image is None:
        n = rows.count()  # a result list
        pre = Window.partitionBy("query_id")
        rows = rows.withColumn("pre_top1", F.max(F.when(F.col("rank") == 1, F.col("score"))).over(pre))
        rows = R.cross_rerank(rows, M.logit(index.scorer, query, index.body()), I.rerank_depth(k, len(intent.tokens), hits, n), CROSS_WEIGHT)
        rows = rows.withColumn("pre_top1", F.when(F.max(F.col("cross").isNotNull()).over(pre), F.col("pre_top1")))
    if query:
        rows = rerank(index, rows, query, intent, policy)
    sure = confidence(index, rows, query)
    if verdicts is not None:
        gate = R.verify_gate(sure.withColumn("has_constraints", F.lit(intent.has_constraints))).where("verify").select("query_id")
        rows = R.apply_verdicts(rows, verdicts.join(F.broadcast(gate), "query_id", "left_semi"))
    return Answer(rows.where(F.col("rank") <= k), route, reason, intent, policy, sure)


def search(index: Index, query: str, vector_query: list[float] | None = None, k: int = 10, mode: str = "auto", image: list[float] | None = None, **more) -> DataFrame:
    """Ranked results of a text or image query; see ``run``."""
    return run(index, query, vector_query, k, mode, image, **more).rows


def forced(index: Index, query: str, vector_query: list[float], mode: str, k: int = 10) -> DataFrame:
    """Search by image vectors (clip), text vectors (text) or both (hybrid), without cross rerank or verification, for evaluation."""
    intent = I.parse(query, index.people)
    policy = I.policy(intent)
    deep = max(k, math.ceil(k * policy.multiplier))
    if mode == "hybrid":
        found = _hybrid(index, vector_query, max(20, deep), policy)
    elif mode in ("clip", "text"):
        found = vector(index.clip if mode == "clip" else index.text, vector_query, deep)
    else:
        raise ValueError("mode is clip, text or hybrid")
    rows = R.reranked(attach(index, found)).where(F.col("rank") <= k)  # the first k that have an item
    return rerank(index, local(R.reranked(R.quality_penalty(rows))), query, intent, policy)


def explain(index: Index, query: str, vector_query: list[float] | None = None) -> DataFrame:
    """The first five results with all component scores; nothing is logged."""
    return search(index, query, vector_query, 5)


def compared(index: Index, query: str, vector_query: list[float] | None = None) -> tuple[DataFrame, str]:
    """The two best results, side by side, and the text that a model is asked to compare them by."""
    rows = search(index, query, vector_query, 2)
    sides = rows.orderBy("rank").select("caption", "summary").limit(2).collect()
    prompt = "\n".join(f"{name}: {r['caption']}. {r['summary']}" for name, r in zip("AB", sides))
    return rows, prompt


def batch(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """Keyword search of a table of queries (query_id, text), without branches.

    Queries of the same words, in whatever order, are searched once, and each gets the list of all.
    """
    terms = queries.select("query_id", F.array_sort(X.unicode_tokens(F.col("text"))).alias("terms"))
    asked = terms.groupBy("terms").agg(F.min("query_id").alias("first"))
    hits = K.bm25_batch(index.postings, index.stats, asked.select(F.col("first").alias("query_id"), "terms"))
    lists = R.ranked(hits.select("query_id", "id", (-F.col("bm25")).alias("score")), k)
    own = terms.join(asked, "terms").select("query_id", "first")
    return own.join(lists.withColumnRenamed("query_id", "first"), "first").select("query_id", "id", "score", "rank")


def log_search(rows: DataFrame, query: str, routing: str, path: str) -> None:
    """Append one row to the search log."""
    entry = rows.agg(F.lit(query).alias("query"), F.lit(routing).alias("routing"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")).alias("result_ids"), F.current_timestamp().alias("timestamp"))
    entry.write.mode("append").parquet(path)
