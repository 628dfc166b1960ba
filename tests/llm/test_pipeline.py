"""The pipeline against its stages done plainly, on a small corpus."""

import random

import corpus_pipeline as P

from .helpers import DOCS, base_spans, clashing, docs, labels, near_classes


def corpus():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    text = lambda n=80: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, text()) for i in range(60)]
    rows += [(100 + i, " ".join(f"{w}%%%" for w in text(60).split())) for i in range(12)]
    rows += [(200 + i, text(40) + " you stupid moron worthless idiot " + text(40) + " moron idiot stupid") for i in range(24)]
    rows += [(300, rows[0][1]), (301, rows[1][1] + " end"), (302, rows[2][1] + " write to me@mail.example.com")]
    known = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(12)] + [(200 + i, 1, 1) for i in range(20)]
    return rows, known


def test_stages(spark, tmp_path):
    rows, known = corpus()
    sf = str(tmp_path)
    docs(spark, rows).write.parquet(f"{sf}/documents.parquet")
    labels(spark, known).write.parquet(f"{sf}/labels.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for name, stage in P.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.dtypes == spark.createDataFrame([], DOCS).dtypes, name
        d.write.parquet(f"{sf}/{name}")
        d = spark.read.parquet(f"{sf}/{name}")
        kept.append({r["doc_id"]: r["text"] for r in d.collect()})
    first, second, third, fourth = kept
    assert set(first) == {i for i, _ in rows if not 100 <= i < 200}
    assert set(second) == {i for i in first if not 200 <= i < 300}
    assert set(third) == {i for i, (_, c) in near_classes(list(second.items()), 5, 80).items() if i == c}
    assert set(fourth) == set(third) and not any(base_spans(t) for t in fourth.values())
    packed = P.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == set(fourth)


def put(spark, sf, rows, known, more=lambda d: d):
    more(docs(spark, rows)).write.parquet(f"{sf}/documents.parquet")
    labels(spark, known).write.parquet(f"{sf}/labels.parquet")


def test_awkward_rows_through_all_stages(spark, tmp_path):
    """Nulls, repeats, rows of one id and clashing columns: the stated results of every stage."""
    rows, known = corpus()
    text, other = rows[5][1], " ".join(reversed(rows[6][1].split()))
    mailed = " ".join(reversed(rows[8][1].split()))
    rows = [*rows, (None, text), (None, None), (400, None), (400, None), (401, ""), (5, other), (402, text), (402, other + " indeed"), (403, " \n"), (404, rows[7][1]), (7, rows[7][1]), (405, mailed + " some.one@mail.example.com")]
    put(spark, str(tmp_path), rows, known, clashing)
    d, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = d.columns
    for name, stage in P.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == columns, name
        d.write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=repr)
    blank = [(None, None), (400, None), (400, None), (401, ""), (403, " \n")]
    for name in kept:
        assert [x for x in kept[name] if not (x[1] or "").strip()] == sorted(blank, key=repr), name
    near = kept["near_dedup"]
    assert (None, text) in near and (5, text) in near and (402, text) not in near
    assert (5, other) in near and (402, other + " indeed") not in near  # rows of one id go by their texts
    assert sum(x[0] == 7 for x in near) == 1 and 404 not in [x[0] for x in near]  # one repeat stays
    assert (405, mailed + " [EMAIL]") in kept["pii"]
    packed = [(r["doc_id"], r["length"]) for r in P.STAGES[-1][1](spark, d, str(tmp_path)).collect()]
    assert sorted(x for x, n in packed if n == 1 and x) == [400, 400, 401, 403] and len(packed) == len(kept["pii"])


def test_empty_documents(spark, tmp_path):
    put(spark, str(tmp_path), [], [(1, 1, 0), (2, 0, 1)])
    assert P.run(spark, str(tmp_path)).count() == 0


def test_run_leaves_what_its_result_reads(spark, tmp_path):
    """Stages' own tables and inputs go once their result is stored."""
    from tessera.llm import common

    common.release(spark)
    rows, known = corpus()
    put(spark, str(tmp_path), rows, known)
    out = P.run(spark, str(tmp_path))
    assert common.tables_written() == 1  # the pieces, which the result reads
    assert out.count() > 0
