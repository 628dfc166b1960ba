"""Behaviours of the engine on tiny frames: the edge cases that queries on the test tables don't pin."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import analytics as A
from tessera.operators import conversation as C
from tessera.operators import evalkit as E
from tessera.operators import ingest as G
from tessera.operators import keyword as K
from tessera.operators import ranking as R
from tessera.plans import intent as I
from tessera.plans import search as S
from tessera.sources import tables as T


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("token,code", [("Ashcraft", "A226"), ("Robert", "R163"), ("Tymczak", "T522"), ("Pfister", "P236"), ("jwellery", "J460"), ("jewelry", "J460"), ("a1", ""), ("", "")])
def test_soundex(spark, token, code):
    assert one(spark, X.soundex_variant(F.col("t")), t=token) == code


@pytest.mark.parametrize("a,b,ratio", [("jwellery", "jewelry", 0.8), ("abc", "abc", 1.0), ("", "", 1.0), ("a", "", 0.0), ("kitten", "sitting", 8 / 13)])
def test_indel(spark, a, b, ratio):
    assert one(spark, X.indel_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(ratio)


def test_phonetic_branch(spark):
    assert one(spark, X.pair_similarity(F.col("a"), F.col("b")), a="jwellery", b="jewelry") == pytest.approx(0.86)
    assert one(spark, X.pair_similarity(F.col("a"), F.col("b")), a="check", b="couch") < 0.84


def test_names(spark):
    assert one(spark, X.names(F.col("t")), t="Ann met Bob and ANN, ann and Bob Lee") == ["Ann", "Bob", "Lee"]


def test_chunks(spark):
    text = "aa\r\n\r\nbb\n\n" + "c" * 25 + "\n\ndd\n\n\n ee"
    got = one(spark, X.chunks(F.col("t"), 10, 3), t=text)
    assert got == ["aa\n\nbb", "c" * 10, "c" * 10, "c" * 10, "c" * 4, "dd\n\nee"]
    assert one(spark, X.chunks(F.col("t"), 10, 3), t="") == []


def test_repair(spark):
    c, s = X.repaired(F.col("c"), F.col("s"))
    assert one(spark, c, c="{", s='{"caption": "A cat", "tags": [') == "A cat"
    assert one(spark, s, c="{", s='{"caption": "A cat", "tags": [') == "A cat"


def test_stemmer():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "hopefulness": "hope", "adjustment": "adjust", "controlling": "control", "probate": "probat", "students": "student", "sky": "sky", "university": "univers"}
    assert {w: K.stem_word(w) for w in pairs} == pairs


def test_bm25_stemmed(spark):
    items = spark.createDataFrame([(1, "two students read"), (2, "a quixotic student"), (3, "nothing here")], "id int, caption string")
    t = K.tokenised(items, "id", "caption")
    hits = K.bm25(K.postings(t, stem=True), K.corpus_stats(t), [("student", True)]).collect()
    assert {r["id"] for r in hits} == {1, 2} and all(r["bm25"] <= 0 for r in hits)
    assert K.bm25(K.postings(t), K.corpus_stats(t), []).count() == 0
    assert K.query_terms("Red cat, RED houses!") == [("red", False), ("cat", False), ("houses", True)]


def ranked(spark, rows):
    return R.ranked(spark.createDataFrame([(0, i, s) for i, s in rows], "query_id int, id string, score double"))


def test_rrf_order(spark):
    kw, sem = ranked(spark, [("a", 0.9), ("b", 0.8)]), ranked(spark, [("b", 0.95), ("c", 0.6)])
    rows = R.fuse_rrf(kw, sem, 60, 0.6, 0.4).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["b", "a", "c"]
    assert rows[1]["right_rank"] is None and rows[1]["right_score"] == 0.0


def test_normalised_without_positive_scores(spark):
    assert [r["norm"] for r in R.normalised(ranked(spark, [("a", 0.0), ("b", -1.0)])).collect()] == [0.0, 0.0]


def test_cross_rerank(spark):
    rows = ranked(spark, [("a", 0.90), ("b", 0.40), ("c", 0.30), ("d", 0.2)])
    logit = F.when(F.col("id") == "b", 3.0).otherwise(-2.5)
    got = R.cross_rerank(rows, logit, 3, 0.5).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "a", "c", "d"] and got[3]["cross"] is None
    same = R.cross_rerank(rows, logit, 1).orderBy("rank").collect()
    assert [r["id"] for r in same] == ["a", "b", "c", "d"]


@pytest.mark.parametrize("scores,lexical,band", [((0.92, 0.40), 1.0, "high"), ((0.70, 0.58), 1.0, "medium"), ((0.44, 0.42), 0.0, "low")])
def test_confidence_bands(spark, scores, lexical, band):
    support = spark.createDataFrame([(0, lexical)], "query_id int, lexical_support double")
    got = R.confidence(ranked(spark, list(zip("ab", scores))), support).first()
    assert got["band"] == band and (got["abstain_reason"] != "") == (band == "low")


def test_intent():
    i = I.parse("old man wearing a checkered shirt, dinner")
    assert i.query_type == "constrained" and i.require_person and i.relation_terms == ["wearing", "eating"][:1]
    assert "plaid" in i.attribute_terms and "senior" in i.attribute_terms
    assert I.parse("show Ravi at home").query_type == "identity"
    assert I.parse("sunset beach").query_type == "generic" and not I.parse("sunset beach").has_constraints
    p = I.policy(I.parse("red car"))
    assert p.query_type == "constrained" or p.presence_required
    assert I.policy(I.parse("x"), adaptive=False).gate == 0.6
    assert I.route("total on the invoice") == "text" and I.route("similar poster") == "clip" and I.route("cat") == "hybrid"
    assert (I.candidate_depth(5), I.candidate_depth(30), I.candidate_depth(99)) == (40, 120, 200)
    assert I.rerank_depth(10, 9, 0, 100) == 14 and I.rerank_depth(30, 3, 81, 100) == 20 and I.rerank_depth(5, 1, 0, 3) == 3


def test_intent_rank_needs_presence(spark):
    rows = spark.createDataFrame([(0, 1, 0.9, "red wall"), (0, 2, 0.6, "a red sedan parked")], "query_id int, id int, score double, caption string")
    got = R.intent_rank(rows, I.parse("red car"), F.col("caption"), presence_required=True).orderBy("rank").collect()
    assert got[0]["id"] == 2 and got[1]["presence_score"] == 0


def test_search_modes(spark):
    items = spark.createDataFrame([(i, c, "", ["t"]) for i, c in enumerate(["red car", "blue car", "green tree", "red tree"])], "id int, caption string, summary string, tags array<string>")
    vectors = spark.createDataFrame([(i, [1.0 if j == i else 0.1 for j in range(4)]) for i in range(4)], "id int, embedding array<float>")
    index = S.build(items, vectors, vectors)
    asked = [0.1, 0.1, 1.0, 0.1]
    assert S.search(index, "zebra", asked, 2).orderBy("rank").first()["id"] == 2  # no keyword hit: vectors
    assert S.search(index, "red car", asked, 2, mode="keyword").orderBy("rank").first()["id"] == 0
    assert {r["id"] for r in S.search(index, "tree", asked, 4).collect()} >= {2, 3}
    assert S.search(index, "", asked, 1, image=asked).first()["id"] == 2


def test_collections_and_filters(spark):
    rows = spark.createDataFrame([(1, "Red Car", ["Trip"], "cars"), (2, "tree", ["home"], "nature")], "id int, caption string, tags array<string>, category string")
    ids = lambda q: [r["id"] for r in rows.where(A.collection_filter(q, "tags", None, ["caption", "caption"], "category")).collect()]
    assert ids("tag:trip red") == [1] and ids("category:nature") == [2] and ids("nope:x") == [1, 2] and ids("tag:trip cat:nature") == []


def test_empty_clusters(spark):
    c = spark.createDataFrame([(1,), (2,)], "id int")
    a = spark.createDataFrame([(7, 1, 0.5), (8, 1, 0.5)], "item_id int, cluster_id int, distance double")
    got = {r["id"]: (r["item_count"], r["sample"]) for r in A.cluster_sizes(c, a, 0).collect()}
    assert got == {1: (2, 7), 2: (0, None)} and A.cluster_sizes(c, a, 1).count() == 1


def test_attribute_map(spark):
    rows = spark.createDataFrame([(1, "k", "low", 0.1), (1, "k", "high", 0.9)], "image_id int, key string, value string, confidence double")
    assert A.attribute_map(rows).first()["attributes"] == {"k": "low"}
    assert A.attribute_map(rows, highest=True).first()["attributes"] == {"k": "high"}


def test_upsert_keeps_creation(spark):
    schema = "id int, v int, created_at int, extra string"
    old, new = spark.createDataFrame([(1, 1, 10, "x"), (2, 1, 20, "y")], schema), spark.createDataFrame([(1, 2, 99, "z")], schema)
    got = {r["id"]: (r["v"], r["created_at"], r["extra"]) for r in G.upsert(old, new, "id", "v").collect()}
    assert got == {1: (2, 10, "z"), 2: (1, 20, "y")}


def test_batches(spark):
    rows = spark.range(5).withColumn("g", F.lit(1))
    assert sorted(r["batch"] for r in G.batches(rows, 2, "g", "id").collect()) == [0, 0, 1, 1, 2]


def test_ocr_budget_stops_at_the_first_overflow(spark):
    blocks = [(1, 0, "cat " + "x" * 20, 0.9), (1, 1, "cat " + "y" * 30, 0.9), (1, 2, "cat", 0.9), (1, 3, "cat", 0.5), (1, 4, "dog", 0.9), (1, 5, "9", 0.9)]
    df = spark.createDataFrame(blocks, "id int, pos int, text string, confidence double")
    assert [r["pos"] for r in C.ocr_budget(df, ["cat"], budget=40).collect()] == [0]
    assert sorted(r["pos"] for r in C.ocr_budget(df, ["cat"], budget=400).collect()) == [0, 1, 2, 5]


def test_grounding(spark):
    g = lambda a, c: one(spark, C.grounding(F.col("a"), F.col("c")), a=a, c=c)
    assert g("the red car", "a red car") == 1.0 and g("red 5", "red 7") == 0.25 and g("Not found in retrieved images", "x") == 0.0


def test_precision_divides_by_k(spark):
    runs = spark.createDataFrame([("m", 1, 1, 5)], "mode string, case_id int, rank int, id int")
    relevant = spark.createDataFrame([(1, 5), (2, 6)], "case_id int, id int")
    got = {r["case_id"]: (r["precision"], r["recall"], r["hit"]) for r in E.case_metrics(runs, relevant).collect()}
    assert got == {1: (0.2, 1.0, 1), 2: (0.0, 0.0, 0)}


def test_vectors(spark):
    assert one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, V.similarity(F.lit(None).cast("double"))) == 0.0 and one(spark, V.similarity(F.lit(3.0))) == -1.0


def test_knn_batch_matches_single(spark):
    vectors = spark.createDataFrame([(i, [float((i * 7 + j * 3) % 11) for j in range(6)]) for i in range(80)], "id int, embedding array<float>")
    asked = vectors.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    got = [(r["id"], round(r["score"], 9)) for r in R.knn_batch(vectors, asked, 5, block=3).where("query_id = 20").orderBy("rank").collect()]
    own = vectors.where("id = 20").first()["embedding"]
    assert got == [(r["id"], round(r["score"], 9)) for r in R.knn(vectors, own, 5).collect()]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "x.JPG").write_bytes(b"1")
    (tmp_path / "a" / "tmp_y.png").write_bytes(b"2")
    (tmp_path / "a" / "n.md").write_text("# Note")
    (tmp_path / ".git" / "m.md").write_text("no")
    files = T.scan_files(spark, str(tmp_path), ["image"], ["tmp_*"]).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in files] == ["x.JPG"]
    assert [r["text"] for r in T.scan_notes(spark, str(tmp_path)).collect()] == ["# Note"]
    (tmp_path / "cases.json").write_text('{"cases": [{"id": "c1", "query": "q", "relevant_image_ids": ["i"]}]}')
    assert T.read_cases(spark, str(tmp_path / "cases.json")).first()["relevant_image_ids"] == ["i"]


def test_index_table(spark):
    items = spark.createDataFrame([(1, "red car"), (2, "red tree")], "id int, caption string")
    K.write_index(K.tokenised(items, "id", "caption"), "postings_test", 4)
    t = spark.table("postings_test")
    assert t.where("term = 'red'").count() == 2
    spark.sql("DROP TABLE postings_test")
