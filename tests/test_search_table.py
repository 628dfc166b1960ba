"""Search over a table of queries against single searches, and what is understood against the driver's parser."""

import pytest

from tessera.functions import models as M
from tessera.operators import keyword as K
from tessera.plans import intent as I
from tessera.plans import search as S
from tessera.plans import search_table as T

QUERIES = [
    "red widget", "red widgit", "Who is Anna Smith in the photo", "man wearing white shirt and old woman", "old people", "invoice total", "poster of design", "", "  Large ring, bolt ", "a checkered plaid shirt near the bolt",
    "blue gizmo with a large old ring and a cold plate", "color", "Photo people John", " ﬁne ring", "dogs cats", "eating in front of car", "Bob", "age pattern", None,
]
ITEMS = [(1, "red widget", "a small thing"), (2, "red ring with old bolt", "ring"), (3, "blue widget near a car", "{"), (4, "old man wearing a white shirt", "person at lunch"), (5, "widgets and rings", "many"), (6, "cold plate", "for dinner"), (7, "invoice of a widget", "total 12"), (8, "poster design", "layout")]


@pytest.mark.parametrize("settings", [{}, {"adaptive": False}, {"fallback": 0.75, "penalty": 0.5, "swing": 0.1}])
def test_understood_as_on_the_driver(spark, settings):
    df = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, text string")
    for r in I.policies(I.understood(df), **settings).collect():
        intent = I.parse(QUERIES[r["query_id"]])
        policy = I.policy(intent, **settings)
        for f in "tokens retrieval_terms attribute_terms relation_terms presence_terms colors patterns activity_terms name_terms require_person require_presence query_type has_constraints".split():
            assert r[f] == getattr(intent, f), (intent.raw, f)
        assert r["certainty"] == pytest.approx(intent.certainty) and r["route"] == I.route(intent.raw)
        assert [r[f] for f in "kind gate multiplier lexical presence_required penalty w_clip w_text".split()] == [getattr(policy, f) for f in "query_type gate multiplier lexical presence_required penalty w_clip w_text".split()]


@pytest.fixture(scope="module")
def index(spark):
    items = spark.createDataFrame([(i, c, s, ["x"], f"2024-01-0{1 + i % 3}") for i, c, s in ITEMS], "id long, caption string, summary string, tags array<string>, updated_at string")
    vectors = lambda k: spark.createDataFrame([(i, [float((i * k + j) % 5) + 0.1 for j in range(4)]) for i, _, _ in ITEMS], "id long, embedding array<double>")
    return S.build(items, vectors(2), vectors(3), None)


def shown(rows):
    names = [c for c in ("id", "rank", "score", "fuzzy", "semantic_overlap", "attribute_score", "relation_score", "presence_score", "cross", "pre_top1", "text_score") if c in rows.columns]
    return [[round(x, 6) if isinstance(x, float) else x for x in (r[c] for c in names)] for r in sorted(rows.collect(), key=lambda r: r["rank"])]


@pytest.mark.parametrize("mode,strategy,scorer", [("auto", "hybrid", "overlap"), ("auto", "legacy", None), ("semantic", "hybrid", None), ("keyword", "hybrid", "overlap")])
def test_equal_to_single_searches(spark, index, mode, strategy, scorer):
    one = S.Index(index.items, index.postings, index.stats, index.clip, index.text, scorer)
    texts = {"hybrid": ["red widgit", "old man wearing a shirt", "widget"], "legacy": ["red widget", "poster"]}[strategy]
    texts = {"semantic": ["invoice", "poster", "red shirt"], "keyword": ["old man wearing a shirt"]}.get(mode, texts)
    vector = lambda i: None if i == 2 and mode != "semantic" else [1.0, 0.5 * i, 2.0, 0.0]
    df = spark.createDataFrame([(i, t, vector(i)) for i, t in enumerate(texts)], "query_id int, text string, vector array<double>")
    answers = T.run(one, df, 3, mode, strategy)
    for i, text in enumerate(texts):
        want = S.run(one, text, vector(i), 3, mode, strategy=strategy)
        assert shown(answers.rows.where(f"query_id = {i}").select(*[c for c in want.rows.columns if c in answers.rows.columns])) == shown(want.rows), text
        sure, own = want.confidence.first(), answers.confidence.where(f"query_id = {i}").first()
        if sure is not None:
            assert own["confidence"] == pytest.approx(sure["confidence"]) and (own["band"], own["abstain_reason"]) == (sure["band"], sure["abstain_reason"])
        if mode != "semantic":
            assert answers.queries.where(f"query_id = {i}").first()["how"] == want.route


def test_verdicts_count_where_the_gate_lets_them(spark, index):
    df = spark.createDataFrame([(0, "old man wearing shirt", [1.0, 1.0, 1.0, 1.0]), (1, "widget", [1.0, 1.0, 1.0, 1.0])], "query_id int, text string, vector array<double>")
    verdicts = spark.createDataFrame([(q, i, False) for q in (0, 1) for i in range(1, 9)], "query_id int, id long, ok boolean")
    plain = {(r["query_id"], r["id"]): r["score"] for r in T.search(index, df, 3).collect()}
    judged = T.run(index, df, 3, verdicts=verdicts)
    gate = {r["query_id"] for r in judged.confidence.collect() if r["band"] == "medium" and r["query_id"] == 0}
    for r in judged.rows.collect():
        if (r["query_id"], r["id"]) in plain:
            assert r["score"] == pytest.approx(plain[r["query_id"], r["id"]] * (0.35 if r["query_id"] in gate else 1), abs=2e-6)


def test_keywords_without_queries_or_hits(spark, index):
    df = spark.createDataFrame([(0, "nothing here"), (1, ""), (2, None)], "query_id int, text string")
    assert T.search(index, df, 5).count() == 0 and T.search(index, df.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        T.search(index, df, mode="other")


def test_prefixes_of_many_queries(spark, index):
    texts = ["widget", "wid", "ring old", "red red", "widgets rings", "wearing shirt white"]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got = {(r["query_id"], r["id"]): r["bm25"] for r in K.bm25_table(index.postings, index.stats, df).collect()}
    want = {(i, r["id"]): r["bm25"] for i, t in enumerate(texts) for r in K.bm25(index.postings, index.stats, K.query_terms(t)).collect()}
    assert got == pytest.approx(want) and want


def test_pair_scorers_take_columns(spark):
    M.register_pair_scorer("lengths", lambda: lambda query, texts: [float(len(query) + len(t)) for t in texts])
    M.register_pair_scorer("fails", lambda: lambda query, texts: 1 / 0)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("ab", "x"), ("abc", "yy"), ("ab", None)], "q string, t string")
    rows = df.select(M.logit("lengths", F.col("q"), F.col("t")).alias("a"), M.logit("fails", F.col("q"), F.col("t")).alias("b")).collect()
    assert [r["a"] for r in rows] == [3.0, 5.0, 2.0] and [r["b"] for r in rows] == [None] * 3
