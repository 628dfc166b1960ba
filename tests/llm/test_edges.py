"""Awkward rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, html_main, importance, media_ts, neardup, packing, pii, quality_rules, secret_scan, toxicity

from .helpers import AWKWARD, clashing, docs, labels


@pytest.fixture(scope="module")
def forest(spark):
    words = secret_scan.Words()
    return secret_scan.train(secret_scan.sample_findings(spark, 600), words), words


def operators(spark, forest):
    known = labels(spark)
    return {
        "toxicity": lambda d: toxicity.toxicity(d, known),
        "packing": lambda d: packing.pack_documents(d),
        "neardup": lambda d: neardup.near_duplicates(d, width=3, percent=85),
        "quality_rules": lambda d: quality_rules.quality_rules(d, known),
        "secret_scan": lambda d: secret_scan.scan(d, *forest),
        "html": lambda d: html_main.main_text(d, "doc_id", "source", "text"),
        "pii": lambda d: pii.pii(d),
        "media": lambda d: media_ts.media_digest(d),
        "importance": lambda d: importance.resample(d, known),
        "bpe": lambda d: bpe.round_trip_digest(d),
    }


NAMES = "toxicity packing neardup quality_rules secret_scan html pii media importance bpe".split()


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, forest, name):
    op = operators(spark, forest)[name]
    plain = sorted(map(repr, op(docs(spark)).collect()))
    assert len(plain) >= len(AWKWARD)
    again = sorted(map(repr, map(tuple, op(clashing(docs(spark))).collect())))
    assert again == sorted(map(repr, map(tuple, op(docs(spark)).collect())))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, forest, name):
    assert operators(spark, forest)[name](docs(spark, [])).count() == 0


def test_what_awkward_rows_give(spark, forest):
    """The stated results for null, empty, wordless, long and repeated rows and a null id."""
    ops = operators(spark, forest)
    by = {name: [(r["page_id" if name == "html" else "doc_id"], r) for r in ops[name](docs(spark)).collect()] for name in ("toxicity", "quality_rules", "secret_scan", "html", "importance", "pii", "media", "bpe", "neardup")}
    one = {name: dict(rows) for name, rows in by.items()}
    for name, rows in by.items():
        assert len(rows) == len(AWKWARD), name
        twice = [tuple(r) for i, r in rows if i == 6]
        assert len(twice) == 2 and twice[0] == twice[1], name  # repeated rows get equal results
    for i in (1, 2):  # null and empty text
        assert one["toxicity"][i]["n_hits"] == 0 and one["toxicity"][i]["predicted"] == 0
        assert one["quality_rules"][i]["base_failed"] and one["quality_rules"][i]["llr"] == 0 and not one["quality_rules"][i]["kept"]
        assert one["secret_scan"][i]["n_candidates"] == 0 and one["secret_scan"][i]["spans"] == ""
        assert one["html"][i]["text"] == "" and one["html"][i]["n_chars"] == 0
        assert one["importance"][i]["log_weight"] == 0
        assert one["pii"][i]["spans"] == "" and one["pii"][i]["n_email"] == 0
        assert one["media"][i]["n_bytes"] == 0 and one["media"][i]["payload_bytes"] == 64
        assert one["bpe"][i]["n_tokens"] == 0
        assert one["neardup"][i]["n_shingles"] == 0 and one["neardup"][i]["kept"] and one["neardup"][i]["component_id"] == i
    assert one["toxicity"][None]["held_out"] is None and one["neardup"][None]["component_id"] is None
    assert one["secret_scan"][8]["n_secrets"] == 1 and one["pii"][7]["n_card"] == 1
    assert one["quality_rules"][5]["n_repeat_words"] == 30_000 and one["media"][5]["n_bytes"] == 150_000 and one["neardup"][5]["n_shingles"] == 1


def test_no_labels(spark):
    none = labels(spark, [])
    rows = toxicity.toxicity(docs(spark), none).collect()
    assert all(0 <= r["score"] < 0.7 and r["predicted"] == 0 for r in rows)
    assert all(r["kept"] for r in importance.resample(docs(spark), none).collect())
    assert {r["llr"] for r in quality_rules.quality_rules(docs(spark), none).collect()} == {0.0}


def test_filters_keep_columns(spark):
    d = clashing(docs(spark))
    known = labels(spark)
    assert importance.sample(d, known).columns == d.columns
    assert toxicity.score(d, toxicity.fit(d, known), keep=True).columns == d.columns
    masked = pii.mask(d)
    assert masked.columns == d.columns and masked.count() == len(AWKWARD)
    assert masked.where(F.col("doc_id") == 1).first()["text"] is None


def test_release(spark):
    from tessera.llm import common

    common.release(spark)
    t = common.written(docs(spark), "t")
    assert t.count() == len(AWKWARD) and common.release(spark) == 1
    assert not spark._jvm.org.apache.hadoop.fs.Path(t.inputFiles()[0]).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(t.inputFiles()[0]))
