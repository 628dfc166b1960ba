"""Search for a table of queries in one plan.

Kind, policy, route and depths of a query are columns; its candidates, reranks and confidence are joins and windows by query.
Nothing is decided on the driver for a query, and what queries have in common is done once: a term's postings, a pair of
words' likeness. A few tables are kept on the way (what was understood, keyword lists, vector lists, candidates, results), so many
whatever the number of queries. The results are those of ``search`` for each query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import models as M
from tessera.functions import text as X
from tessera.operators import keyword as K
from tessera.operators import ranking as R
from tessera.sources.tables import kept

from . import intent as I
from .search import CROSS_WEIGHT, EMPTY_WORDS, FALLBACK, FUZZY, HARD_CUTOFF, RETRIEVAL, Index, projected

VOCABULARY = 4000  # words of a result list that misspelt ones are held against


def by_query():
    return Window.partitionBy("query_id")


@dataclass
class Answers:
    """Ranked rows (query_id, rank, id, ...); and one row a query: what was understood, how it was searched, and its confidence."""

    rows: DataFrame
    queries: DataFrame
    confidence: DataFrame


def planned(queries: DataFrame, k: int, people: bool = True) -> DataFrame:
    """Queries (query_id, text, vector) with what is understood of them, their policies and their depths."""
    rows = I.policies(I.understood(queries, people=people))
    deep = F.greatest(F.lit(20 if k < 20 else k), F.ceil(k * F.col("multiplier"))).cast("int")
    weight = lambda table, other: F.coalesce(*[F.when(F.col("kind") == n, v) for n, v in table.items()], F.lit(other))
    return rows.withColumns({"depth": F.lit(I.candidate_depth(k)), "deep": deep, "alpha": weight({n: v[0] for n, v in FUZZY.items()}, 0.8), "beta": weight({n: v[1] for n, v in FUZZY.items()}, 0.2), "w_retrieval": weight(RETRIEVAL, 0.60)})


def keywords(index: Index, queries: DataFrame, depth: int) -> DataFrame:
    """(query_id, id, score, rank): the first ``depth`` of each query by BM25, latest update and id.

    Queries of the same words, in whatever order, are searched once, and each gets the list of all.
    """
    terms = queries.select("query_id", K.table_terms("text").alias("terms"))
    asked = terms.groupBy("terms").agg(F.min("query_id").alias("first"))
    hits = K.bm25_table(index.postings, index.stats, asked.select(F.col("first").alias("query_id"), F.array_join("terms", " ").alias("text")), kept)
    order = [F.col("bm25")]
    if "updated_at" in index.items.columns:
        hits = hits.join(index.items.select("id", "updated_at"), "id", "left")
        order.append(F.desc_nulls_last("updated_at"))
    best = hits.withColumn("rank", F.row_number().over(by_query().orderBy(*order, "id")).cast("long")).where(F.col("rank") <= depth)
    best = best.select(F.col("query_id").alias("first"), "id", K.lexical_score(F.col("bm25")).alias("score"), "rank")
    return terms.join(asked, "terms").select("query_id", "first").join(best, "first").select("query_id", "id", "score", "rank")


def nearest(vectors: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    asked = queries.where("vector is not null").select("query_id", F.col("vector").alias("query"))
    return R.knn_batch(vectors, asked, depth).select("query_id", "id", "score", "rank")


def _fused(index: Index, rows: DataFrame, k: int) -> DataFrame:
    """Candidates of queries that ask image and text vectors, by the weights of their policies."""
    most = I.policy_depth(k, 2.0)
    lists = [nearest(v, rows, most).join(rows.select("query_id", "deep", "w_clip", "w_text"), "query_id").where("rank <= deep") for v in (index.clip, index.text)]
    a, b = (R.normalised(x).select("query_id", "id", "w_clip", "w_text", F.col("norm").alias(n), F.round("score", 6).alias(f"{n}_score")) for x, n in zip(lists, ("clip", "text")))
    both = a.join(b, ["query_id", "id", "w_clip", "w_text"], "full_outer").na.fill(0.0, ["clip", "text", "clip_score", "text_score"])
    return R.ranked(both.withColumn("score", F.col("w_clip") * F.col("clip") + F.col("w_text") * F.col("text"))).select("query_id", "id", "score", "rank", "clip_score", "text_score")


def candidates(index: Index, queries: DataFrame, k: int, mode: str, strategy: str, fallback: int) -> tuple[DataFrame, DataFrame]:
    """Candidates (query_id, id, score, rank, clip_score, text_score) and the queries with route and hits; branches are filters by query."""
    none = {"clip_score": F.lit(None).cast("double"), "text_score": F.lit(None).cast("double")}
    if mode == "semantic":
        route = F.when(F.lit(index.clip is None), "text").otherwise(F.col("route"))
        queries = queries.withColumns({"how": route, "hits": F.lit(0).cast("long")})
        parts = []
        for name, vectors in (("clip", index.clip), ("text", index.text)):
            if vectors is not None:
                own = queries.where(F.col("how") == name)
                found = nearest(vectors, own, I.policy_depth(k, 2.0)).join(own.select("query_id", "deep"), "query_id").where("rank <= deep").drop("deep")
                parts.append(found.withColumns(none))
        if index.clip is not None:
            parts.append(_fused(index, queries.where("how = 'hybrid'"), k))
        return _union(parts), queries
    depth = I.candidate_depth(k)
    listed = kept(keywords(index, queries, max(depth, k)))
    alone = F.col("vector").isNull() if index.text is not None else F.lit(True)
    alone = F.lit(True) if mode == "keyword" else alone
    hits = listed.where(F.col("rank") <= depth).groupBy("query_id").agg(F.count("*").alias("hits"))
    queries = queries.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    over = F.col("hits") > (fallback if strategy == "legacy" else HARD_CUTOFF)
    vectors_alone = F.col("hits") == 0 if strategy == "hybrid" else F.lit(True)
    how = F.when(alone | over, "keyword").when(vectors_alone, "keyword+semantic_fallback").otherwise("keyword+semantic_hybrid")
    queries = kept(queries.withColumn("how", how).withColumn("hits", F.when(alone, F.lit(k).cast("long")).otherwise(F.col("hits"))))
    mine = lambda name: queries.where(F.col("how") == name)
    own = lambda rows, name: rows.join(mine(name).select("query_id"), "query_id", "left_semi")
    parts = [own(listed, "keyword").where(F.col("rank") <= k).withColumns(none)]
    if mode == "auto" and index.text is not None:
        near = kept(nearest(index.text, queries.where("how <> 'keyword'"), max(depth, I.policy_depth(k, 2.0))))
        cut = mine("keyword+semantic_fallback").select("query_id", (F.lit(depth) if strategy == "hybrid" else F.col("deep")).alias("most"))
        parts.append(near.join(cut, "query_id").where("rank <= most").drop("most").withColumns(none))
        if strategy == "hybrid":
            name = "keyword+semantic_hybrid"
            fused = R.fuse_rrf(own(listed, name).where(F.col("rank") <= depth), own(near, name).where(F.col("rank") <= depth))
            parts.append(fused.select("query_id", "id", "score", "rank").withColumns(none))
    return _union(parts), queries


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _alike(pairs: DataFrame, ratio, least: float, also: Column) -> DataFrame:
    """``pairs`` (term, word) with their ``like``, each pair of words computed once, where it reaches ``least``; lengths that rule that out, unless ``also``, aren't compared."""
    close = 2.0 * F.least(F.length("term"), F.length("word")) / (F.length("term") + F.length("word")) >= least
    return pairs.distinct().where(close | also).withColumn("like", ratio(F.col("term"), F.col("word"))).where(F.col("like") >= least)


def corrections(words: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, more): words of each query's candidates (query_id, id, word) that its terms of five letters or more may stand for."""
    counts = words.where(F.length("word") >= 3).groupBy("query_id", "word").agg(F.count("*").alias("n"))
    known = counts.withColumn("place", F.row_number().over(by_query().orderBy(F.desc("n"), "word"))).where(F.col("place") <= VOCABULARY).select("query_id", "word")
    long = queries.select("query_id", F.posexplode("tokens").alias("at", "term")).where(F.length("term") >= 5)
    pairs = long.join(known, "query_id").where("term <> word")
    likes = _alike(pairs.select("term", "word"), X.indel_ratio, 0.80, F.lit(False))
    best = pairs.join(likes, ["term", "word"]).groupBy("query_id", "at").agg(F.min_by("word", F.struct(-F.col("like"), F.col("word"))).alias("to"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "to"))), lambda s: s["to"])
    return best.groupBy("query_id").agg(F.array_distinct(in_order).alias("more"))


def likenesses(words: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, like): for each candidate a map of the query's terms to their best likeness to one of its words."""
    every = F.array_distinct(F.concat("terms", "retrieval_terms", "attribute_terms", "relation_terms"))
    wanted = queries.select("query_id", F.explode(F.filter(every, lambda t: F.length(t) >= 2)).alias("term"))
    own = words.where(F.length("word") >= 2)
    pairs = own.select("query_id", "word").distinct().join(wanted, "query_id").select("term", "word")
    likes = _alike(pairs, X.pair_similarity, R.LIKE, F.substring("term", 1, 1) == F.substring("word", 1, 1))
    best = own.join(likes, "word").join(wanted, ["query_id", "term"]).groupBy("query_id", "id", "term").agg(F.max("like").alias("like"))
    return best.groupBy("query_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("term", "like"))).alias("like"))


def _fuzzy(terms: str | Column, threshold: float = R.LIKE) -> Column:
    """``ranking.fuzzy_score`` where terms are a column and likenesses a map."""
    asked = F.filter(F.array_distinct(terms), lambda t: F.length(t) >= 2)
    like = lambda t: F.coalesce(F.col("like")[t], F.lit(0.0))
    total = F.aggregate(asked, F.lit(0.0), lambda s, t: s + F.when(like(t) >= threshold, like(t)).otherwise(0.0))
    return F.when(F.size(asked) > 0, total / F.size(asked)).otherwise(0.0)


def fuzzy_rank(rows: DataFrame) -> DataFrame:
    """``ranking.fuzzy_rank`` with weights, terms and corrections by query."""
    typos, fused = F.size("more") > 0, F.col("text_score").isNotNull()
    alpha = F.when(typos, F.col("alpha")).otherwise(F.greatest(F.col("alpha"), F.lit(0.9)))
    beta = F.when(typos, F.col("beta")).otherwise(F.least(F.col("beta"), 1 - alpha))
    top = F.max("score").over(by_query())
    rows = rows.withColumns({"fuzzy": _fuzzy("terms"), "vector_": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / F.when(top > 0, top).otherwise(1.0)))})
    support = F.when(F.coalesce(F.col("text_score"), F.lit(0.0)) != 0, F.col("text_score")).otherwise(F.col("vector_"))
    a, b = F.when(fused, 0.3).otherwise(0.85), F.when(fused, 0.7).otherwise(0.15)
    final = alpha * (a * F.col("vector_") + b * support) + beta * F.col("fuzzy")
    final = F.when(typos & (F.max("fuzzy").over(by_query()) >= 0.30) & (F.col("fuzzy") == 0), final * (0.85 + 0.15 * support)).otherwise(final)
    return R.reranked(rows.withColumn("score", F.round(final, 6)), F.desc("fuzzy"))


def intent_rank(rows: DataFrame, body: Column, w_retrieval: Column, w_attribute: float, w_relation: float, penalty: Column, boosts: tuple, required: Column) -> DataFrame:
    """``ranking.intent_rank`` with intents and weights by query."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    top = F.max("score").over(by_query())
    attribute = _fuzzy("attribute_terms")
    for boost, terms, threshold in zip(boosts, ("colors", "patterns", "activity_terms"), (0.88, 0.88, 0.84)):
        attribute = attribute + boost * _fuzzy(terms, threshold)
    named = F.col("named")
    synonyms = F.create_map(*[x for w, also in R.SYNONYMS.items() for x in (F.lit(w), F.array(F.lit(w), *map(F.lit, also)))])
    hit = lambda t: F.arrays_overlap(named, F.coalesce(synonyms[t], F.array(t))).cast("double")
    asked = F.size("presence_terms") > 0
    presence = F.when(asked, F.aggregate("presence_terms", F.lit(0.0), lambda s, t: s + hit(t)) / F.size("presence_terms")).otherwise(F.when(required, 0.0).otherwise(1.0))
    person = F.arrays_overlap(named, F.array(*map(F.lit, R.PERSON)))
    presence = F.when(~F.col("require_person"), presence).when(person, F.greatest(presence, F.lit(1.0))).otherwise(F.least(presence, F.lit(0.25)))
    relation = F.when(F.size("relation_terms") > 0, _fuzzy("relation_terms", 0.90)).otherwise(0.0)
    rows = rows.withColumn("named", F.array_distinct(X.ascii_tokens(body)))
    rows = rows.withColumns({"vector_similarity": clamp(F.col("score") / F.when(top > 0, top).otherwise(1.0)), "attribute_score": clamp(attribute), "relation_score": relation, "presence_score": presence, "semantic_overlap": _fuzzy(F.concat("retrieval_terms", "attribute_terms", "relation_terms"))})
    final = w_retrieval * F.col("vector_similarity") + (1 - w_retrieval) * F.col("semantic_overlap") + w_attribute * F.col("attribute_score") + w_relation * F.col("relation_score") + 0.5 * w_attribute * F.col("presence_score")
    both = (F.size("attribute_terms") > 0) & (F.size("retrieval_terms") > 0)
    cut = F.when(both, F.greatest(penalty, F.lit(0.60))).otherwise(penalty)
    final = F.when(required & asked & (F.col("presence_score") < 0.5), final * F.greatest(F.lit(0.0), 1 - cut)).otherwise(final)
    return R.reranked(rows.drop("named").withColumn("score", F.round(final, 6)))


UNDERSTOOD = ["tokens", "colors", "patterns", "activity_terms", "attribute_terms", "relation_terms", "retrieval_terms", "presence_terms", "require_person", "has_constraints", "presence_required", "penalty", "alpha", "beta", "w_retrieval"]


def reranked(index: Index, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The fuzzy rerank and both reranks by intent, of all queries at once."""
    body = index.body()
    words = rows.select("query_id", "id", F.explode(X.unicode_tokens(body)).alias("word"))
    own = queries.select("query_id", *UNDERSTOOD).join(corrections(words, queries), "query_id", "left")
    own = own.withColumn("more", F.coalesce("more", F.array().cast("array<string>"))).withColumn("terms", F.array_distinct(F.concat("tokens", "more")))
    own = kept(own)
    rows = rows.join(own, "query_id").join(likenesses(words, own), ["query_id", "id"], "left").withColumn("like", F.coalesce("like", F.create_map().cast("map<string,double>")))
    rows = fuzzy_rank(rows)
    held = rows.withColumns({"before": F.col("score"), "was_": F.col("rank")})
    earlier = intent_rank(held, body, F.lit(0.74), 0.26, 0.20, F.lit(0.40), (0.14, 0.14, 0.12), F.lit(True))
    # lists without constraints stay as the fuzzy rerank left them
    earlier = earlier.withColumns({"score": F.when(F.col("has_constraints"), F.col("score")).otherwise(F.col("before")), "rank": F.when(F.col("has_constraints"), F.col("rank")).otherwise(F.col("was_"))})
    last = intent_rank(earlier.drop("before", "was_"), body, F.col("w_retrieval"), 0.2, 0.2, F.col("penalty"), (0.20, 0.20, 0.12), F.col("presence_required"))
    return last.drop(*UNDERSTOOD, "more", "terms", "like", "vector_")


def run(index: Index, queries: DataFrame, k: int = 10, mode: str = "auto", strategy: str = "hybrid", fallback: int = FALLBACK, verdicts: DataFrame | None = None) -> Answers:
    """Ranked results of a table of queries (query_id, text, and vector if vectors are searched), as ``search.run`` finds them for each.

    A query without a vector is searched by keywords; one without results has no rows. ``verdicts`` (query_id, id, ok) count
    where the gate lets them.
    """
    if mode not in ("auto", "keyword", "semantic") or strategy not in ("hybrid", "legacy"):
        raise ValueError("mode is auto, keyword or semantic; strategy is hybrid or legacy")
    if "vector" not in queries.columns:
        queries = queries.withColumn("vector", F.lit(None).cast("array<double>"))
    found, queries = candidates(index, kept(planned(queries.select("query_id", "text", "vector"), k, index.people)), k, mode, strategy, fallback)
    rows = projected(index.items.join(found.withColumn("score", F.round("score", 6)), "id"))
    rows = kept(R.reranked(R.quality_penalty(rows)))
    if index.scorer:
        short, long = I.rerank_depth(k, 0, 0, 1 << 30), I.rerank_depth(k, 9, 0, 1 << 30)
        own = queries.select("query_id", F.col("text").alias("asked_text"), F.size("tokens").alias("n_tokens"), "hits")
        depth = F.when(F.col("n_tokens") > 8, long).otherwise(short)
        depth = F.when(F.col("hits") > 80, F.least(depth, F.lit(20))).otherwise(depth)
        rows = rows.join(own, "query_id").withColumns({"pre_top1": F.max(F.when(F.col("rank") == 1, F.col("score"))).over(by_query()), "depth": depth})
        rows = R.cross_rerank(rows, M.logit(index.scorer, F.col("asked_text"), index.body()), F.col("depth"), CROSS_WEIGHT)
        rows = rows.withColumn("pre_top1", F.when(F.max(F.col("cross").isNotNull()).over(by_query()), F.col("pre_top1"))).drop("asked_text", "n_tokens", "hits", "depth")
    rows = kept(reranked(index, rows, queries))
    said = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(EMPTY_WORDS))))
    sure = R.confidence(rows, R.lexical_support(rows, queries.select("query_id", said.alias("terms")), index.body()))
    if verdicts is not None:
        gate = R.verify_gate(sure.join(queries.select("query_id", "has_constraints"), "query_id")).where("verify").select("query_id")
        rows = R.apply_verdicts(rows, verdicts.join(gate, "query_id", "left_semi"))
    return Answers(rows.where(F.col("rank") <= k), queries, sure)


def search(index: Index, queries: DataFrame, k: int = 10, mode: str = "auto", **more) -> DataFrame:
    """Ranked results (query_id, rank, id, ...) of a table of queries; see ``run``."""
    return run(index, queries, k, mode, **more).rows
