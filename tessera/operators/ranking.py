"""Vector search, fusion and reranking of result lists.

A list is a DataFrame (query_id, id, score) with or without rank; every window is partitioned by query_id, so a
table of queries is served like one. Ties always fall to the smaller id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as X
from tessera.functions import vectors as V

from . import nearest as N

QUERY = "query_id"


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Exact cosine neighbours of one literal vector: a scan and a top-k, without a shuffle of the vectors."""
    rows = vectors.select(F.col(key).alias("id"), V.cosine(F.col(vector), V.literal(query)).alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, slice_: int = 1 << 14, block: int = 2048) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest of every query vector (query_id, query).

    A stated set of queries against all vectors: slices of the vectors meet blocks of the queries, each pair of them in a
    task by matrix products, and gives k a query. Rows without a whole vector of the queries' length are scanned apart.
    """
    dims = queries.agg(F.count("*").alias("n"), F.max(F.size("query")).alias("width")).first()
    whole = lambda c: F.coalesce((F.size(c) == F.lit(dims["width"])) & ~F.exists(c, lambda x: x.isNull()), F.lit(False))
    odd = lambda df, c: df.agg(F.count("*"), F.count(F.when(~whole(c), 1))).first()
    if not dims["n"] or dims["width"] is None or dims["width"] < 1:
        return _scanned(vectors, queries, k)
    n, odd_vectors = odd(vectors, "embedding")
    odd_queries = odd(queries, "query")[1]
    slices, blocks = max(1, -(-n // slice_)), max(1, -(-dims["n"] // block))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cut = vectors.where(whole("embedding")).select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), each(blocks).alias("block"))
    asked = queries.where(whole("query")).select(QUERY, "query", each(slices).alias("slice"), F.pmod(F.xxhash64(QUERY), F.lit(blocks)).cast("int").alias("block"))
    found = [N.grouped(cut, asked, ["slice", "block"], k)]
    if odd_vectors:
        found.append(_scanned(vectors.where(~whole("embedding")), queries, k).drop("rank"))
    if odd_queries:
        found.append(_scanned(vectors.where(whole("embedding")), queries.where(~whole("query")), k).drop("rank"))
    return ranked(reduce(DataFrame.unionByName, found), k)


def _scanned(vectors: DataFrame, queries: DataFrame, k: int, block: int = 256, most: int = 4096) -> DataFrame:
    """``knn_batch`` by a scan for each ``most`` queries, in blocks: a block of queries is one row, which each vector meets once."""
    blocks = max(1, -(-queries.count() // block))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64(QUERY), F.lit(blocks)))
    found = []
    for first in range(0, blocks, max(1, most // block)):
        some = numbered.where(F.col("block").between(first, first + max(1, most // block) - 1))
        asked = some.groupBy("block").agg(F.collect_list(F.struct(QUERY, "query")).alias("asked"))
        pairs = vectors.crossJoin(F.broadcast(asked)).select("id", "embedding", F.explode("asked").alias("q"))
        scored = pairs.select(F.col(f"q.{QUERY}").alias(QUERY), "id", V.cosine(F.col("embedding"), F.col("q.query")).alias("score"))
        found.append(ranked(scored, k))
    return reduce(DataFrame.unionByName, found)


def ranked(rows: DataFrame, k: int | None = None, *more: Column) -> DataFrame:
    by = Window.partitionBy(QUERY).orderBy(F.desc("score"), *more, "id")
    out = rows.withColumn("rank", F.row_number().over(by).cast("long"))
    return out.where(F.col("rank") <= k) if k else out


def normalised(rows: DataFrame) -> DataFrame:
    """``norm``: scores from 0 by the list's greatest; lists without a positive score are all 0."""
    top = F.max("score").over(Window.partitionBy(QUERY))
    return rows.withColumn("norm", F.greatest(F.lit(0.0), F.col("score")) / F.when(top > 0, top).otherwise(1.0))


def fuse_weighted(left: DataFrame, right: DataFrame, w_left: float = 0.6, w_right: float = 0.4) -> DataFrame:
    """Weighted sum of two normalised lists; an id that one lacks has 0 there."""
    a = normalised(left).select(QUERY, "id", F.col("norm").alias("a"))
    b = normalised(right).select(QUERY, "id", F.col("norm").alias("b"))
    both = a.join(b, [QUERY, "id"], "full_outer").na.fill(0.0, ["a", "b"])
    return ranked(both.withColumn("score", w_left * F.col("a") + w_right * F.col("b")))


def fuse_rrf(left: DataFrame, right: DataFrame, k: float = 60.0, w_left: float = 0.62, w_right: float = 0.38) -> DataFrame:
    """Weighted reciprocal ranks; an absent rank is null and gives nothing; ties by best rank, then id."""
    if w_left + w_right <= 0:
        w_left, w_right = 0.62, 0.38
    total = w_left + w_right
    first = lambda rows, name: rows.groupBy(QUERY, "id").agg(F.min("rank").alias(f"{name}_rank"), F.max("score").alias(f"{name}_score"))
    both = first(left, "left").join(first(right, "right"), [QUERY, "id"], "full_outer").na.fill(0.0, ["left_score", "right_score"])
    part = lambda w, r: F.coalesce(w / total / (k + F.col(r)), F.lit(0.0))
    both = both.withColumn("score", part(w_left, "left_rank") + part(w_right, "right_rank"))
    return ranked(both, None, F.least("left_rank", "right_rank"))


def quality_penalty(rows: DataFrame) -> DataFrame:
    """Scores times 0.55 for a malformed caption and 0.70 for a malformed summary."""
    factor = F.when(X.malformed(F.col("caption")), 0.55).otherwise(1.0) * F.when(X.malformed(F.col("summary")), 0.70).otherwise(1.0)
    return rows.withColumn("score", F.col("score") * factor)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))


def cross_rerank(rows: DataFrame, logit: Column, depth: int | Column, weight: float = 0.42) -> DataFrame:
    """The first ``depth`` of each list (a column, where lists differ in it) get (1 - w) * score + w * sigmoid(logit); the rest stand behind them as they were.

    A list for which the scorer fails (a null logit in its head) keeps its scores and its order.
    """
    whole = Window.partitionBy(QUERY)
    size = F.count("*").over(whole)
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    head = (F.col("rank") <= depth) & (size >= 2) & (depth >= 2) & F.lit(weight > 0)
    rows = rows.withColumn("base", F.col("score")).withColumn("logit", F.when(head, logit))
    failed = F.max(F.when(head & F.col("logit").isNull(), 1).otherwise(0)).over(whole)
    rows = rows.withColumn("cross", F.when((failed == 0) & F.col("logit").isNotNull(), sigmoid(F.col("logit")))).drop("logit")
    rows = rows.withColumn("score", F.when(F.col("cross").isNotNull(), (1 - weight) * F.col("base") + weight * F.col("cross")).otherwise(F.col("base")))
    order = Window.partitionBy(QUERY).orderBy(F.col("cross").isNull(), F.when(F.col("cross").isNotNull(), -F.col("score")), F.desc("cross"), F.when(F.col("cross").isNotNull(), -F.col("base")), "rank")
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


LIKE = 0.84  # the least likeness that any score counts


def likeness(term: str, text: Column, least: float = LIKE) -> Column:
    """The best likeness of a term to a word of ``text``; 0 under ``least``."""
    words = F.filter(X.unicode_tokens(text), lambda w: F.length(w) >= 2)
    # a word whose length alone rules out the threshold is not compared
    near = F.filter(words, lambda w: (2.0 * F.least(F.length(w), F.lit(len(term))) / (F.length(w) + len(term)) >= least) | (F.substring(w, 1, 1) == term[0]))
    top = F.coalesce(F.array_max(F.transform(near, lambda w: X.pair_similarity(F.lit(term), w))), F.lit(0.0))
    return F.when(F.array_contains(words, term), 1.0).when(top >= least, top).otherwise(0.0)


def fuzzy_score(terms: list[str], text: Column, threshold: float = LIKE, known: dict[str, Column] | None = None) -> Column:
    """Mean over the terms of their best likeness to a word of ``text``, where that reaches the threshold.

    ``known`` has the likeness of terms (at LIKE or less) where it is computed already.
    """
    asked = [t for t in dict.fromkeys(terms) if len(t) >= 2]
    if not asked:
        return F.lit(0.0)

    def best(term: str) -> Column:
        if known and term in known and threshold >= LIKE:
            return F.when(known[term] >= threshold, known[term]).otherwise(0.0)
        return likeness(term, text, threshold)

    return reduce(lambda a, b: a + b, map(best, asked)) / len(asked)


def _likenesses(rows: DataFrame, terms: list[str], text: Column) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` with the likeness of each term to their text, computed once for each different text; and the columns by term."""
    names = {t: f"like_{i}_" for i, t in enumerate(t for t in dict.fromkeys(terms) if len(t) >= 2)}
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.select(text.alias("text_")).distinct().repartition(parts, "text_")  # few bytes, much work
    texts = texts.withColumns({n: likeness(t, F.col("text_")) for t, n in names.items()}) if names else texts
    return rows.withColumn("text_", text).join(texts, "text_", "left"), {t: F.coalesce(n, F.lit(0.0)) for t, n in names.items()}


def vocabulary(rows: DataFrame, text: Column, most: int = 4000) -> DataFrame:
    """(token, n) of words of three letters or more by the number of rows that hold them."""
    words = rows.select(F.explode(F.filter(X.unicode_tokens(text), lambda w: F.length(w) >= 3)).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(most)


def corrections(vocab: DataFrame, terms: list[str], threshold: float = 0.84) -> DataFrame:
    """(term, correction, ratio): the likeliest other word for each term of five letters or more."""
    long = [t for t in terms if len(t) >= 5]
    asked = vocab.select(F.explode(F.array(*map(F.lit, long)) if long else F.array().cast("array<string>")).alias("term"), "token")
    rows = asked.where("token <> term").withColumn("ratio", X.indel_ratio(F.col("term"), F.col("token"))).where(F.col("ratio") >= min(0.80, threshold))
    return rows.groupBy("term").agg(F.min_by("token", F.struct(-F.col("ratio"), F.col("token"))).alias("correction"), F.max("ratio").alias("ratio"))


def _greatest(rows: DataFrame, value: str, name: str, apart: bool) -> DataFrame:
    """``rows`` with the greatest ``value`` of their list as ``name``: by a window, or ``apart`` by an aggregate where a list is too long for one task."""
    if not apart:
        return rows.withColumn(name, F.max(value).over(Window.partitionBy(QUERY)))
    best = rows.groupBy(F.col(QUERY).alias("list_")).agg(F.max(value).alias(name))
    return rows.join(best, F.col(QUERY).eqNullSafe(F.col("list_"))).drop("list_")


def fuzzy_rank(rows: DataFrame, terms: list[str], text: Column, alpha: float = 0.85, beta: float = 0.15, threshold: float = 0.84, least: float = 0.0, typos: bool = False, hybrid: bool = False, known: dict[str, Column] | None = None, apart: bool = False) -> DataFrame:
    """Semantic and fuzzy likeness combined: the typo-tolerant rerank. ``apart`` is for lists of any length, see ``_greatest``."""
    if not typos:
        alpha = max(alpha, 0.9)
        beta = min(beta, 1 - alpha)
    rows, top = _greatest(rows, "score", "top_", apart), F.col("top_")
    vector = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / F.when(top > 0, top).otherwise(1.0)))
    support = F.when(F.coalesce(F.col("text_score"), F.lit(0.0)) != 0, F.col("text_score")).otherwise(F.col("vector")) if "text_score" in rows.columns else F.col("vector")
    rows = rows.withColumn("fuzzy", fuzzy_score(terms, text, threshold, known)).withColumn("vector", vector)
    a, b = (0.3, 0.7) if hybrid else (0.85, 0.15)
    final = alpha * (a * F.col("vector") + b * support) + beta * F.col("fuzzy")
    final = F.when(final < least, final * 0.95).otherwise(final)
    if typos:
        rows, most = _greatest(rows, "fuzzy", "most_", apart), F.col("most_")
        final = F.when((most >= 0.30) & (F.col("fuzzy") == 0), final * (0.85 + 0.15 * support)).otherwise(final)
    return reranked(rows.withColumn("score", F.round(final, 6)).drop("top_", "most_"), F.desc("fuzzy"))


def reranked(rows: DataFrame, *more: Column) -> DataFrame:
    """Ranked anew by score; ties stay as they were, where the rows have ranks."""
    if "rank" not in rows.columns:
        return ranked(rows, None, *more)
    return ranked(rows.withColumnRenamed("rank", "was"), None, *more, F.col("was")).drop("was")


#: Fixed synonyms and person words of presence checks.
SYNONYMS = {"car": ["suv", "vehicle", "automobile", "sedan", "hatchback"], "bike": ["bicycle", "motorcycle", "cycle"]}
PERSON = ["person", "people", "man", "men", "woman", "women", "couple", "boy", "girl", "male", "female"]


def intent_rank(rows: DataFrame, intent, text: Column, entity_tokens: Column | None = None, evidence: Column | None = None, w_retrieval: float = 0.6, w_attribute: float = 0.2, w_relation: float = 0.2, penalty: float = 0.35, boosts: tuple = (0.20, 0.20, 0.12), presence_required: bool = False, known: dict[str, Column] | None = None, apart: bool = False) -> DataFrame:
    """Rerank by what the query asks for: overlap, attributes (colour, pattern and activity boosts), relations, presence. ``apart`` is for lists of any length, see ``_greatest``."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    own = rows.columns
    if apart and known is None:
        rows, known = _likenesses(rows, [*intent.retrieval_terms, *intent.attribute_terms, *intent.relation_terms, *intent.colors, *intent.patterns, *intent.activity_terms], text)
    rows, top = _greatest(rows, "score", "top_", apart), F.col("top_")
    words = F.array_distinct(X.ascii_tokens(text))
    named = F.array_union(words, entity_tokens) if entity_tokens is not None else words
    attribute = fuzzy_score(intent.attribute_terms, text, known=known)
    for boost, terms, threshold in zip(boosts, (intent.colors, intent.patterns, intent.activity_terms), (0.88, 0.88, 0.84)):
        if terms:
            attribute = attribute + boost * fuzzy_score(terms, text, threshold, known)
    relation = F.lit(0.0)
    if intent.relation_terms:
        relation = fuzzy_score(intent.relation_terms, text, 0.90, known)
        if evidence is not None:
            relation = F.greatest(relation, F.coalesce(F.array_max(evidence), F.lit(0.0)))
    if intent.presence_terms:
        hits = [F.arrays_overlap(named, F.array(*map(F.lit, [t, *SYNONYMS.get(t, [])]))).cast("double") for t in intent.presence_terms]
        presence = reduce(lambda a, b: a + b, hits) / len(hits)
    else:
        presence = F.lit(0.0 if presence_required else 1.0)
    if intent.require_person:
        person = F.arrays_overlap(named, F.array(*map(F.lit, PERSON)))
        presence = F.when(person, F.greatest(presence, F.lit(1.0))).otherwise(F.least(presence, F.lit(0.25)))
    rows = rows.withColumns({"vector_similarity": clamp(F.col("score") / F.when(top > 0, top).otherwise(1.0)), "attribute_score": clamp(attribute), "relation_score": relation, "presence_score": presence})
    rows = rows.withColumn("semantic_overlap", fuzzy_score([*intent.retrieval_terms, *intent.attribute_terms, *intent.relation_terms], text, known=known))
    final = w_retrieval * F.col("vector_similarity") + (1 - w_retrieval) * F.col("semantic_overlap") + w_attribute * F.col("attribute_score") + w_relation * F.col("relation_score") + 0.5 * w_attribute * F.col("presence_score")
    if presence_required and intent.presence_terms:
        cut = max(penalty, 0.60) if intent.attribute_terms and intent.retrieval_terms else penalty
        final = F.when(F.col("presence_score") < 0.5, final * max(0.0, 1 - cut)).otherwise(final)
    spent = [c for c in rows.columns if c.endswith("_") and c not in own]
    return reranked(rows.withColumn("score", F.round(final, 6)).drop(*spent))


def compatibility_rank(rows: DataFrame, intent, text: Column, w_appearance: float = 0.14, w_activity: float = 0.12, missing: float = 0.40, known: dict[str, Column] | None = None) -> DataFrame:
    """An earlier rerank by intent, with weights of its own; lists without constraints stay as they are."""
    if not intent.has_constraints:
        return rows
    both = w_appearance + w_activity
    return intent_rank(rows, intent, text, w_retrieval=max(0.45, 1 - both), w_attribute=both, w_relation=0.20, penalty=missing, boosts=(w_appearance, w_appearance, w_activity), presence_required=True, known=known)


WEIGHTS = (0.45, 0.25, 0.20, 0.10)


def confidence(rows: DataFrame, lexical: DataFrame | None = None, abstain: float = 0.46, verify: float = 0.70) -> DataFrame:
    """One row per list: composite confidence, band, and why to abstain.

    ``lexical`` (query_id, lexical_support) is joined if given. ``pre_top1`` is the best score before reranking,
    where the lists carry it.
    """
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    by = rows.groupBy(QUERY).agg(
        clamp(F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("score"))), F.lit(0.0))).alias("top1"),
        clamp(F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0))).alias("top2"),
        F.count("*").alias("n"),
        *([F.max("pre_top1").alias("pre")] if "pre_top1" in rows.columns else [F.lit(None).cast("double").alias("pre")]),
    )
    by = by.join(lexical, QUERY, "left") if lexical is not None else by.withColumn("lexical_support", F.lit(0.0))
    by = by.withColumn("lexical_support", F.coalesce("lexical_support", F.lit(0.0)))
    by = by.withColumn("margin", F.when(F.col("n") > 1, clamp(F.col("top1") - F.col("top2"))).otherwise(F.col("top1")))
    by = by.withColumn("gain", F.when(F.col("pre").isNotNull(), clamp(F.col("top1") - F.greatest(F.lit(0.0), F.col("pre")))).otherwise(0.0))
    parts = zip(WEIGHTS, ("top1", "margin", "lexical_support", "gain"))
    by = by.withColumn("confidence", clamp(reduce(lambda a, b: a + b, [w * F.col(c) for w, c in parts])))
    low = F.col("confidence") < abstain
    reasons = F.concat_ws(",", F.when(F.col("lexical_support") < 0.20, "weak_lexical_support"), F.when(F.col("top1") < 0.60, "low_top1_score"), F.when(F.col("margin") < 0.08, "weak_top2_margin"))
    return by.withColumn("band", F.when(F.col("confidence") >= max(verify, abstain), "high").when(low, "low").otherwise("medium")).withColumn(
        "abstain_reason", F.when(low, F.when(reasons == "", "low_confidence").otherwise(reasons)).otherwise("")
    )


def lexical_support(rows: DataFrame, terms: DataFrame, text: Column) -> DataFrame:
    """(query_id, lexical_support): share of each query's terms that stand in one of its first three rows."""
    top = rows.where("rank <= 3").groupBy(QUERY).agg(F.collect_list(F.lower(text)).alias("texts"))
    found = F.filter("terms", lambda t: F.exists("texts", lambda x: x.contains(t)))
    return top.join(terms, QUERY).select(QUERY, F.when(F.size("terms") > 0, F.size(found) / F.size("terms")).otherwise(0.0).alias("lexical_support"))


def verify_gate(rows: DataFrame, enabled: bool = True, abstain: float = 0.46, verify: float = 0.70) -> DataFrame:
    """Whether a list with confidence and has_constraints goes to a verifier, and why."""
    high = max(verify, abstain)
    reason = (
        F.when(~F.lit(enabled), "disabled").when(~F.col("has_constraints"), "no_constraints").when(F.col("confidence") < abstain, "below_abstain_threshold").when(F.col("confidence") >= high, "above_verify_threshold").otherwise("medium_confidence")
    )
    return rows.withColumn("verify_reason", reason).withColumn("verify", reason == "medium_confidence")


def apply_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Scores times 1.20 where a verdict (query_id, id, ok) confirms and 0.35 where it rejects; ranked anew."""
    factor = F.when(F.col("ok"), 1.20).when(~F.col("ok"), 0.35).otherwise(1.0)
    return reranked(rows.join(verdicts, [QUERY, "id"], "left").withColumn("score", F.round(F.col("score") * factor, 6)).drop("ok"))
