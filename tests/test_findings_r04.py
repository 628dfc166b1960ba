"""Small cases of the findings of round 4."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import keyword as K
from tessera.plans import search as S
from tessera.plans import search_table as T


def moved(df):
    """Rows that the shuffles of a plan wrote."""
    df.collect()
    nodes, n = [df._jdf.queryExecution().executedPlan().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            n += node.metrics().apply("shuffleRecordsWritten").value()
        below = node.children()
        nodes += [node.plan()] if name.endswith("QueryStageExec") else [below.apply(i) for i in range(below.size())]
    return n


def indexed(spark, names):
    return S.build(spark.createDataFrame(list(enumerate(names)), "id long, caption string").selectExpr("*", "'' as summary", "array('') as tags"))


def test_items_of_a_rarest_term_that_lack_the_others_are_not_shuffled(spark):
    """420 queries of different words, 95 items or more for each one's rarest, of which some five hold both words; and terms that are prefixes, or are asked alone or in vain."""
    index = indexed(spark, [f"aaaa{i % 20}x bb{i % 21}" for i in range(2000)])
    texts = [f"aaaa{i}x bb{j}" for i in range(20) for j in range(21)] + ["aaaa1", "bb2", "bb", "aaaa3x bb4 none", "bb5 AAAA7x bb5", ""]
    queries = spark.createDataFrame([*enumerate(texts), (1000, None)], "query_id int, text string")
    rows = K.bm25_table(index.postings, index.stats, queries)
    got = {}
    for r in rows.collect():
        got.setdefault(r["query_id"], {})[r["id"]] = r["bm25"]
    assert sum(len(v) for q, v in got.items() if q < 420) == 2000 and not {422, 423, 425, 1000} & set(got)
    for q in (0, 31, 420, 421, 424):
        assert got[q] == pytest.approx({r["id"]: r["bm25"] for r in K.bm25(index.postings, index.stats, K.query_terms(texts[q])).collect()})
    for size in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(size, "-1")  # as tables too large for a broadcast are joined
    try:
        assert moved(K.bm25_table(index.postings, index.stats, queries)) < 40_000
    finally:
        for size in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(size)


def test_queries_of_the_same_words_share_one_list(spark, monkeypatch):
    index = indexed(spark, ["red ring", "ring red", "blue ring", "red"] * 50)
    queries = index.items.selectExpr("id as query_id", "upper(caption) as text").unionByName(spark.createDataFrame([(900, ""), (901, "-")], "query_id long, text string"))
    seen, table = [], K.bm25_table
    monkeypatch.setattr(K, "bm25_table", lambda index, stats, queries, *a: seen.append(queries.where("text <> ''").count()) or table(index, stats, queries, *a))
    lists = {}
    for r in T.keywords(index, queries, 3).collect():
        lists.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert seen == [3] and sorted(lists) == list(range(200))
    assert sorted(lists[1]) == sorted(lists[40]) == [(1, 0, 1.0), (2, 1, 1.0), (3, 4, 1.0)] and [i for _, i, _ in sorted(lists[2])] == [2, 6, 10]


def test_terms_too_many_for_every_task_are_joined(spark):
    index = indexed(spark, [f"red ring{i % 7} {'blue' if i % 3 else 'cold'}" for i in range(50)])
    queries = spark.createDataFrame([(i, f"ring{i % 7} {w}") for i, w in enumerate(["red", "blue", "cold", "re", "ring"] * 3)], "query_id int, text string")
    sent, joined = (K.bm25_table(index.postings, index.stats, queries, most=m) for m in (1000, 0))
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, joined.collect())) and sent.agg(F.count("*")).first()[0] > 0
