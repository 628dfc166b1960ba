"""Queries that once read a cut of their tables or texts."""

from tessera.plans import registry


def test_queries_over_every_row(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("orders", [(i, "O") for i in range(1, 61)], "o_orderkey long, o_orderstatus string")
    put("lineitem", [(i, j, i + j) for i in range(1, 61) for j in (1, 2)], "l_orderkey long, l_linenumber int, l_suppkey long")
    put("documents", [(1, "a b\n\nc d"), (2, "x" * 1000 + "\n \n" + "y" * 1000), (3, "one")], "doc_id long, text string")

    def got(name):
        return sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect()))

    assert got("relation_lookup") == [(i, j, (i + j) % 10 if (i + j) % 2 == 0 else None) for i in range(1, 61) for j in (1, 2)]
    assert got("video_attach") == [(i, "O", 2) for i in range(1, 61)]
    assert got("chunks") == [(1, 1, 8), (2, 1, 1000), (2, 2, 1000), (3, 1, 3)]


PASSAGE = "one two three four five six seven eight nine"


def _passages(spark, folder):
    lead = "same lead " * 8
    docs = [(1, lead + PASSAGE + ", end"), (2, lead + PASSAGE[:27]), (3, "x" + PASSAGE), (4, "nine eight seven six five four three two one"), (5, "ok no"), (6, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, PASSAGE), (8, "ok no"), (9, "absent from all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_search_for_whole_passages(spark, tmp_path):
    rows = registry.queries()["kw_bm25_batch"](spark, _passages(spark, tmp_path)).collect()
    assert sorted((r["query_id"], r["id"]) for r in rows) == [(7, 1), (7, 4), (8, 5)]


def test_cases_of_whole_passages(spark, tmp_path):
    rows = registry.queries()["eval_cases"](spark, _passages(spark, tmp_path)).collect()
    assert {(r["case_id"], r["precision"]) for r in rows if r["mode"] == "up"} == {(7, 0.4), (8, 0.2)}
