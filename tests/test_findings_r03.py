"""Small cases of the findings of round 3."""

import random

from pyspark.sql import functions as F

from tessera.llm import common, grams, quality_rules
from tessera.operators import keyword as K
from tessera.operators import ranking as R
from tessera.plans import intent as I
from tessera.plans import registry
from tessera.plans import search as S


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_time_ring_is_placed_by_exact_times(spark, tmp_path):
    """Events whose distances in time are equal when rounded to ten-thousandths of a day."""
    at = {11: 100.0, 1: 103.0, 2: 99.0, 3: 102.0, 4: 98.9, 5: 101.5, 6: 100.2, 7: 96.0}
    events = spark.createDataFrame([(i, s, "view", "{}") for i, s in at.items()], "event_id long, s double, event_type string, props string")
    events.selectExpr("event_id", "timestamp_millis(cast(s * 1000 as long)) as ts", "event_type", "props").write.parquet(f"{tmp_path}/events.parquet")
    put(spark, tmp_path, "embeddings", [(11, 0, [1.0, 0.0])], "vec_id long, label int, embedding array<float>")
    rows = registry.queries()["context_lens"](spark, str(tmp_path)).where("ring = 'time'").collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["place"])] == [6, 2, 4, 5, 3, 1]


def test_names_of_things_ask_for_no_person(spark, tmp_path):
    """An old thing among things: its age is an attribute, and nothing requires a person."""
    names = {0: "old anvil", 1: "red ring", 2: "old bolt", 3: "hot anvil"}
    put(spark, tmp_path, "part", [(i, n, "Brand", "TYPE", 1, 1.0) for i, n in names.items()], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    put(spark, tmp_path, "embeddings", [(i, [0.1 * (i + j % 3) + 0.1 for j in range(64)]) for i in names], "vec_id long, embedding array<float>")
    first = registry.queries()["search_table"](spark, str(tmp_path)).where("rank = 1").first()
    assert (first["id"], first["presence_score"]) == (0, 1.0)
    assert I.parse("old anvil").require_person and not I.parse("old anvil", people=False).require_person


def test_all_trusted_rows_are_counted(spark):
    """More trusted rows than the 20,000 that models once were fitted on, ids that repeat, and labels without a document."""
    docs = spark.range(50_000).selectExpr("id as doc_id", "concat('text', id % 97) as text").unionByName(spark.createDataFrame([(3, "tt"), (None, "none")], "doc_id long, text string"))
    target = spark.range(0, 60_000, 2).selectExpr("id as doc_id").unionByName(spark.createDataFrame([(3,), (3,), (None,)], "doc_id long"))
    assert common.among(docs, target, "text", "doc_id").groupBy().count().first()[0] == 25_002
    labels = target.selectExpr("doc_id", "1 as quality")
    for rows in (common.among(docs, quality_rules.trusted_ids(labels), "text", "doc_id"), docs.join(labels.distinct(), "doc_id", "left_semi").selectExpr("doc_id as key", "text")):
        assert rows.selectExpr("sum(xxhash64(key, text) % 1000003)").first()[0] == docs.where("doc_id % 2 = 0 or doc_id = 3").selectExpr("sum(xxhash64(doc_id, text) % 1000003)").first()[0]
    own, raw = grams.multinomials(docs, quality_rules.trusted_ids(labels), "text", "doc_id", False)
    assert own.sum() == sum(len(f"text{i % 97}") - 3 for i in range(0, 50_000, 2)) + 2 and raw.sum() == sum(len(f"text{i % 97}") - 3 for i in range(50_000)) + 1


def test_products_give_what_the_scan_gives(spark):
    """Copies, near ties, rows without a length, a whole or any vector, and groups of few rows: the same rows, scores and ranks."""
    draw = random.Random(3)
    rows = [(i, [float(draw.randint(-2, 2)) / 3 for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)] + [(400, [0.0] * 6), (401, None), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (403, [float("nan")] * 6), (404, [1.0, 2.0]), (405, [1e-200] * 6), (406, [1e160] * 6)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = vectors.where("id % 20 = 7 or id >= 400").selectExpr("id as query_id", "embedding as query")
    for k in (1, 5, 90):
        shown = lambda df: sorted(((r["query_id"], r["rank"], r["id"], repr(r["score"])) for r in df.collect()), key=repr)
        assert shown(R.knn_batch(vectors, queries, k, slice_=100, block=10)) == shown(R._scanned(vectors, queries, k))


def test_queries_of_the_same_words_are_searched_once(spark):
    names = ["red ring", "ring red", "blue ring", "red"] * 50
    items = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, caption string")
    asked = items.selectExpr("id as query_id", "caption as text")
    seen = []
    bm25 = K.bm25_batch
    try:
        K.bm25_batch = lambda index, stats, queries, *a: seen.append(queries.count()) or bm25(index, stats, queries, *a)
        rows = S.batch(S.build(items.selectExpr("*", "'' as summary", "array('') as tags")), asked, 3).collect()
    finally:
        K.bm25_batch = bm25
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    assert seen == [3] and len(by) == 200 and sorted(by[1]) == sorted(by[40]) == [(1, 0), (2, 1), (3, 4)] and sorted(by[2])[0] == (1, 2)


def test_long_lists_are_ranked_without_a_window_over_all(spark):
    rows = spark.createDataFrame([(i % 2, i, f"red widget {i % 5}" if i % 3 else None, 1.0 / (1 + i % 7)) for i in range(60)], "query_id int, id int, caption string, score double")
    intent = I.parse("red widget")
    near = R.intent_rank(rows, intent, F.col("caption"), presence_required=True)
    apart = R.intent_rank(rows, intent, F.col("caption"), presence_required=True, apart=True)
    assert apart.columns == near.columns and sorted(map(tuple, apart.collect()), key=repr) == sorted(map(tuple, near.collect()), key=repr)
    typos = [R.fuzzy_rank(rows, ["red", "widgit"], F.col("caption"), typos=True, apart=a) for a in (True, False)]
    assert typos[0].columns == typos[1].columns and sorted(map(tuple, typos[0].collect()), key=repr) == sorted(map(tuple, typos[1].collect()), key=repr)


def test_texts_that_no_trusted_row_asks_for_are_not_shuffled(spark):
    """Ids few enough for a broadcast and too many for one: the texts that move are the trusted ones and a few that share their places."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat(cast(id as string), 20) as text")
    target = spark.range(0, 20_000, 100).selectExpr("id as doc_id").unionByName(spark.createDataFrame([(100,), (None,)], "doc_id long"))
    for most in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            rows = common.among(docs, target, "text", "doc_id")
            assert sorted(r["key"] for r in rows.collect()) == list(range(0, 20_000, 100))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        found = rows._jdf.queryExecution().executedPlan().executedPlan().plan().collectLeaves()
        stages = [found.apply(i) for i in range(found.size())]
        moved = [s.plan().metrics().apply("shuffleRecordsWritten").value() for s in stages if "ShuffleQueryStage" in s.getClass().getName() and "text" in s.output().toString()]
        assert len(moved) == 1 and 200 <= moved[0] < 300


def test_large_joins_of_relations_have_partitions_by_their_rows(spark, tmp_path, monkeypatch):
    """One task of a join gets some TASK relations, whatever the session's number of partitions is; the rows are the same."""
    from tessera.plans import analytics_queries as Q

    put(spark, tmp_path, "lineitem", [(i, j, i + j) for i in range(400) for j in (1, 2)], "l_orderkey long, l_linenumber int, l_suppkey long")
    monkeypatch.setattr(Q, "TASK", 50, raising=False)
    rows = registry.queries()["relation_lookup"](spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [(i, j, (i + j) % 10 if (i + j) % 2 == 0 else None) for i in range(400) for j in (1, 2)]
    assert ", 16), REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString()
