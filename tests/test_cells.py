"""Neighbours from cells against the scan of all vectors."""

import random

import pytest

from tessera.operators import cells as C
from tessera.operators import ranking as R

SCHEMA = "id long, embedding array<double>"


def clustered(spark, n=600, seed=5):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x * (1 + i % 3) + draw.gauss(0, 0.1) for x in centres[i % 12]]) for i in range(n)]
    rows += [(n, [0.0] * 8), (n + 1, None), (n + 2, rows[4][1]), (n + 3, rows[4][1]), (n + 4, [-x for x in rows[4][1]]), (4, rows[4][1])]
    return spark.createDataFrame(rows, SCHEMA)


def same(got, want):
    shown = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert shown(got) == shown(want)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    vectors = clustered(spark).cache()
    path = str(tmp_path_factory.mktemp("cells"))
    C.write(vectors, path, cells=12, files=5)
    return vectors, C.read(spark, path)


@pytest.mark.parametrize("k", [1, 10, 700])
def test_equal_to_the_scan(spark, stored, k):
    vectors, index = stored
    asked = vectors.where("id % 60 = 0 and embedding is not null").selectExpr("id as query_id", "embedding as query")
    asked = asked.unionByName(spark.createDataFrame([(-1, [0.0] * 8), (-2, [5.0] * 8)], "query_id long, query array<double>"))
    known = vectors.where("embedding is not null")
    same(C.nearest(index, asked, k), R.knn_batch(known, asked, k))


def test_what_cannot_be_near_is_left_out(stored):
    vectors, index = stored
    asked = vectors.where("id % 60 = 5").selectExpr("id as query_id", "embedding as query")
    assert C.share(index, asked, 5).first()["share"] < 0.3
    far = C.pairs_left(index, asked, 5).join(index.vectors.where("cell = -1"), "unit").count()
    assert far == 0  # 0 is less than the fifth score


def test_full_shells_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "SIZE", 50)
    monkeypatch.setattr(C, "BLOCK", 3)
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(400)] + [(400 + i, [1.0, i / 50]) for i in range(100)], SCHEMA)
    C.write(vectors, str(tmp_path), cells=3, files=4)
    index = C.read(spark, str(tmp_path))
    assert index.units.agg({"n": "max"}).first()[0] < 100
    asked = vectors.where("id % 40 = 3").selectExpr("id as query_id", "embedding as query")
    same(C.nearest(index, asked, 7), R.knn_batch(vectors, asked, 7))


def test_tables_without_vectors(spark, tmp_path):
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query array<double>")
    C.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a", files=2)
    assert C.nearest(C.read(spark, f"{tmp_path}/a"), asked, 3).count() == 0
    C.write(spark.createDataFrame([(7, [0.0, 0.0])], SCHEMA), f"{tmp_path}/b", files=2)
    assert [(r["id"], r["score"]) for r in C.nearest(C.read(spark, f"{tmp_path}/b"), asked, 3).collect()] == [(7, 0.0)]
    assert C.nearest(C.read(spark, f"{tmp_path}/b"), asked.limit(0), 3).count() == 0
