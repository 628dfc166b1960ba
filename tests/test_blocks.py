"""The index in blocks against plain BM25 over all postings, and what a search opens of it."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks as BL
from tessera.operators import keyword as K
from tessera.plans import search as S

STEMS = ["ring", "rings", "ringed", "widget", "widgets", "wide", "red", "reddish", "cold", "colder", "coldest", "bolt", "x1", "été"]


def corpus(spark, n=400, seed=3):
    draw = random.Random(seed)
    rows = [(i, [draw.choice(STEMS[: draw.randint(1, len(STEMS))]) for _ in range(draw.choice([0, 1, 2, 2, 5, 40]))]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, tokens array<string>")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    tokens = corpus(spark).cache()
    path = str(tmp_path_factory.mktemp("blocks"))
    BL.write(tokens, path, files=6, size=16)
    return tokens, BL.read(spark, path)


def top(rows, k):
    """Rows to the k-th score, ties with it included, scores to nine places."""
    found = sorted((round(r["bm25"], 9), r["id"]) for r in rows.collect())
    return [f for f in found if f[0] <= found[min(k, len(found)) - 1][0]]


@pytest.mark.parametrize("k", [1, 7])
@pytest.mark.parametrize("text", ["ring", "red", "widg", "cold red", "ringed wide red", "rings ring", "x1", "absent", "red absent", "t"])
def test_equal_to_all_postings(stored, text, k):
    tokens, index = stored
    terms = K.query_terms(text)
    want = top(K.bm25(K.postings(tokens), K.corpus_stats(tokens), terms), k)
    assert top(BL.best(index, terms, k), k) == want
    assert bool(want) == (text not in ("absent", "red absent", "t"))


def leaves(plan):
    return [plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())]


def scanned(df):
    """(files, rows) of the scan of a plan without a shuffle."""
    df.collect()
    (scan,) = leaves(df._jdf.queryExecution().executedPlan())
    if not scan.metrics().contains("numFiles"):  # no range holds the term, and nothing is left to scan
        return 0, 0
    return scan.metrics().apply("numFiles").value(), scan.metrics().apply("numOutputRows").value()


def test_a_prefix_opens_the_files_of_its_range(spark, tmp_path):
    words = [f"{a}{b}{c}word{i % 7}" for i, (a, b, c) in enumerate((a, b, c) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh")]
    tokens = spark.createDataFrame([(i, [w, words[(i * 31) % 512]]) for i, w in enumerate(words)], "id long, tokens array<string>")
    BL.write(tokens, str(tmp_path), files=32)
    index = BL.read(spark, str(tmp_path))
    assert index.ranges.count() == 32
    files, rows = scanned(BL.rows_of(index, K.query_terms("cdaword")))
    assert files <= 2 and 0 < rows <= 64
    assert len(BL.best(index, K.query_terms("cdaw"), 5).collect()) >= 1
    files, _ = scanned(BL.rows_of(index, K.query_terms("zzzz")))
    assert files == 0


def test_blocks_that_cannot_reach_the_kth_score_are_left_out(spark, tmp_path):
    # twenty short items score most; two thousand long ones hold the word once among eighty
    rows = [(i, ["ring"]) for i in range(20)] + [(i, ["ring"] + ["filler"] * (79 + i % 3)) for i in range(20, 2020)] + [(i, ["other"]) for i in range(2020, 6000)]
    tokens = spark.createDataFrame(rows, "id long, tokens array<string>")
    BL.write(tokens, str(tmp_path), files=4, size=16)
    index = BL.read(spark, str(tmp_path))
    terms = K.query_terms("ring")
    assert index.postings.where("term = 'ring'").count() > 60
    found = BL.best(index, terms, 10)
    assert top(found, 10) == top(K.bm25(K.postings(tokens), K.corpus_stats(tokens), terms), 10)
    assert found.count() == 20  # all ties, and no long item was scored
    assert {r["id"] for r in found.collect()} == set(range(20))


def test_long_prefixes_and_awkward_rows(spark, tmp_path):
    long = "a" * 40
    rows = [(1, [long, long + "b"]), (2, [long + "c"] * 3), (3, []), (4, None), (5, ["y" * 100_000])]
    tokens = spark.createDataFrame(rows, "id long, tokens array<string>")
    BL.write(tokens, f"{tmp_path}/a", files=2)
    index = BL.read(spark, f"{tmp_path}/a")
    for text in (long, "a" * 16, "a" * 17, "yyyy", "y" * 100_000):
        assert top(BL.best(index, K.query_terms(text), 3), 3) == top(K.bm25(K.postings(tokens), K.corpus_stats(tokens), K.query_terms(text)), 3) != []
    assert BL.best(index, [], 3).count() == 0 and BL.best(index, K.query_terms("yyyy"), 0).count() == 0
    with pytest.raises(ValueError):
        BL.write(tokens.union(tokens), f"{tmp_path}/b")
    BL.write(tokens.limit(0), f"{tmp_path}/c", files=2)
    assert BL.best(BL.read(spark, f"{tmp_path}/c"), K.query_terms("aaaa"), 3).count() == 0


def test_search_over_a_stored_index_in_blocks(spark, tmp_path):
    rows = [(1, "red widget", "s", ["a"], "2024-01-01"), (2, "red widgets", "s", ["a"], "2024-01-03"), (3, "old red ring", "s", ["a"], "2024-01-02"), (4, "widget", "s", ["a"], "2024-01-02")]
    items = spark.createDataFrame(rows, "id long, caption string, summary string, tags array<string>, updated_at string")
    S.store(items, "blocks_test", blocks=f"{tmp_path}/x", files=3)
    try:
        index = S.stored(spark, "blocks_test", blocks=f"{tmp_path}/x")
        for text in ("red widget", "red", "widg", "ring old", "none"):
            shown = lambda i: [(r["rank"], r["id"], r["score"]) for r in S.search(i, text, mode="keyword", k=2).orderBy("rank").collect()]  # noqa: E731, B023
            assert shown(index) == shown(S.build(items)), text
    finally:
        for t in ("items", "stats"):
            spark.sql(f"DROP TABLE IF EXISTS blocks_test_{t}")


def test_texts_are_tokenised_once_and_large_ranges_have_many_tasks(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def split(text):
        seen.add(1)
        return text.split() + [None]

    texts = [(i, " ".join(random.Random(i).choices(STEMS, k=1 + i % 9))) for i in range(300)]
    tokens = spark.createDataFrame(texts, "id long, text string").select("id", F.udf(split, "array<string>")("text").alias("tokens"))
    monkeypatch.setattr(BL, "SORTED", 100)
    BL.write(tokens, str(tmp_path), files=2, size=16)
    assert seen.value == 300
    index = BL.read(spark, str(tmp_path))
    assert index.ranges.count() == 2 and not (tmp_path / "words").exists()
    held = K.postings(tokens).where("term is not null")
    assert sorted(map(tuple, index.flat().collect())) == sorted(map(tuple, held.collect()))
    assert index.postings.groupBy("term", "block").count().where("count > 1").count() == 0
    starts = {(w[:n], i) for i, t in texts for w in t.split() for n in range(4, len(w) + 1)}
    assert {(r["start"], r["n"]) for r in index.prefixes.collect()} == {(s, sum(1 for x in starts if x[0] == s)) for s, _ in starts}
    for text in ("ring", "cold", "wide widg"):
        assert top(BL.best(index, K.query_terms(text), 5), 5) == top(K.bm25(held, K.corpus_stats(tokens), K.query_terms(text)), 5)
