"""Stages of search and chat, models, collections, media shapes and sinks, on tiny frames."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import models as M
from tessera.functions import text as X
from tessera.operators import analytics as A
from tessera.operators import conversation as C
from tessera.operators import evalkit as E
from tessera.operators import ingest as G
from tessera.operators import ranking as R
from tessera.plans import chat, intent
from tessera.plans import search as S
from tessera.sources import media, tables
from tessera.streaming import file_events as W
from tessera.streaming import telemetry

ITEMS = [
    (1, "a red car on a road", "street", ["car", "red"], "2024-01-01"),
    (2, "a red bird", "garden", ["bird"], "2024-01-03"),
    (3, "a blue car", "garage", ["car"], "2024-01-02"),
    (4, "{", "{", [], "2024-01-05"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "id long, caption string, summary string, tags array<string>, updated_at string")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [0.9, 0.1])], "id long, embedding array<double>")


def ids(df, order="rank"):
    return [r["id"] for r in df.orderBy(order).collect()]


def test_every_word_must_be_there_and_ties_go_to_the_latest(spark, items):
    twins = items.unionByName(items.withColumn("id", F.col("id") + 10).withColumn("updated_at", F.lit("2025-01-01")))
    index = S.build(twins)
    rows = S.keyword(index, "red bird", 5)
    assert ids(rows) == [12, 2] and {r["score"] for r in rows.collect()} == {1.0}


def test_modes(items, vectors):
    index = S.build(items, vectors, vectors)
    assert ids(S.search(index, "red car", mode="keyword"))[0] == 1
    assert S.run(index, "red car", [1.0, 0.0]).route == "keyword+semantic_hybrid"
    assert S.run(index, "zebra", [0.0, 1.0]).route == "keyword+semantic_fallback"
    legacy = S.run(index, "car", [0.0, 1.0], strategy="legacy", fallback=1)
    assert legacy.route == "keyword" and set(ids(legacy.rows)) == {1, 3}
    assert S.run(index, "car", [0.0, 1.0], strategy="legacy").route == "keyword+semantic_fallback"
    image = S.run(index, "", image=[0.9, 0.1], k=2)
    assert image.route == "clip" and ids(image.rows) == [1, 4]  # 4 is nearest, but malformed
    assert len(ids(S.forced(index, "red car", [1.0, 0.0], "hybrid", 3))) == 3
    for wrong in ({"mode": "other"}, {"mode": "keyword", "image": [1.0, 0.0]}, {"strategy": "other"}):
        with pytest.raises(ValueError):
            S.run(index, "car", [1.0, 0.0], **wrong)
    with pytest.raises(ValueError):
        S.run(index, "")


def test_stored_index_gives_the_same(spark, items, vectors, tmp_path):
    plain = items.withColumn("caption", F.when(F.col("id") == 3, "a blue ｃａｒ").otherwise(F.col("caption")))
    S.store(plain, "stages_test", 4)
    try:
        index = S.stored(spark, "stages_test", vectors, vectors)
        assert [(r["id"], r["score"]) for r in S.search(index, "red car", mode="keyword").collect()] == [(r["id"], r["score"]) for r in S.search(S.build(items), "red car", mode="keyword").collect()]
        assert set(ids(S.search(index, "car", mode="keyword"))) == {1, 3}
        plan = spark.sql("EXPLAIN FORMATTED SELECT term, count(*) FROM stages_test_postings WHERE term = 'car' GROUP BY term").first()[0]
        assert "SelectedBucketsCount: 1 out of 4" in plan and "EqualTo(term,car)" in plan and "Exchange" not in plan
    finally:
        for t in ("items", "postings", "stats"):
            spark.sql(f"DROP TABLE IF EXISTS stages_test_{t}")


def test_verification_counts_only_behind_the_gate(spark, items, vectors):
    index = S.build(items, vectors, vectors)
    verdicts = spark.createDataFrame([(0, 1, False), (0, 2, True)], "query_id int, id long, ok boolean")
    sure = S.run(index, "red car", [1.0, 0.0], verdicts=verdicts)
    band = sure.confidence.first()["band"]
    before = {r["id"]: r["score"] for r in S.search(index, "red car", [1.0, 0.0]).collect()}
    after = {r["id"]: r["score"] for r in sure.rows.collect()}
    assert after[1] == pytest.approx(before[1] * (0.35 if band == "medium" else 1))
    vague = S.run(index, "garden", [1.0, 0.0], verdicts=verdicts)  # no constraints
    assert {r["id"]: r["score"] for r in vague.rows.collect()} == {r["id"]: r["score"] for r in S.search(index, "garden", [1.0, 0.0]).collect()}


def test_a_failing_scorer_leaves_the_order(spark, items):
    rows = R.ranked(spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.4), (0, 3, 0.3)], "query_id int, id long, score double")).join(items.select("id", "caption"), "id")

    def broken():
        def score(query, texts):
            raise RuntimeError("no model")

        return score

    M.register_pair_scorer("broken", broken)
    M.register_pair_scorer("length", lambda: lambda query, texts: [float(len(t)) for t in texts])
    M.register_pair_scorer("short", lambda: lambda query, texts: [1.0])
    for name in ("broken", "short"):
        out = R.cross_rerank(rows, M.logit(name, "q", F.col("caption")), 3)
        assert ids(out) == [1, 2, 3] and all(r["cross"] is None and r["score"] == r["base"] for r in out.collect())
    out = R.cross_rerank(rows, M.logit("length", "q", F.col("caption")), 2).collect()
    assert [r["cross"] is None for r in sorted(out, key=lambda r: r["rank"])] == [False, False, True]
    assert R.cross_rerank(rows, M.logit("overlap", "red bird", F.col("caption")), 3, 0.9).orderBy("rank").first()["id"] == 2


def test_embedders_are_loaded_once_and_queries_cached(spark):
    calls = []

    def load():
        def model(texts):
            calls.append(list(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return model

    M.register_embedder("e5-toy", load)
    assert M.query_vector("e5-toy", "abc") == (10.0, 1.0) and M.query_vector("e5-toy", "abc") == (10.0, 1.0)
    assert calls == [["query: abc"]]
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string").select("id", M.embed("e5-toy", F.col("t")).alias("v")).orderBy("id").collect()
    assert [list(r["v"]) for r in rows] == [[11.0, 1.0], [0.0, 1.0]]


def test_earlier_rerank_needs_constraints(spark, items):
    rows = R.ranked(items.select(F.lit(0).alias("query_id"), "id", "caption", F.lit(0.5).alias("score")))
    assert R.compatibility_rank(rows, intent.parse("garden"), F.col("caption")) is rows
    assert ids(R.compatibility_rank(rows, intent.parse("red car"), F.col("caption")))[0] == 1


def test_kinds_of_queries():
    kinds = {q: (i.query_type, round(i.certainty, 2)) for q in ("Find Anna", "car and tree", "red shirt", "tree", "a b c d e", "Anna in red", "") for i in [intent.parse(q)]}
    assert kinds == {"Find Anna": ("identity", 0.9), "car and tree": ("constrained", 0.88), "red shirt": ("attribute", 0.68), "tree": ("generic", 0.7), "a b c d e": ("generic", 0.58), "Anna in red": ("identity", 0.78), "": ("generic", 0.7)}
    assert intent.parse("The photos").query_type == "identity" and intent.parse("The photos").certainty == 0.72


def test_nearest_in_time_for_any_k(spark):
    stamp = F.timestamp_seconds(F.col("s"))
    left = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 0.0), ("b", 3, 5.0), (None, 4, 5.0)], "by string, id long, s double").select("by", "id", stamp.alias("ts"))
    right = spark.createDataFrame([("a", i, float(s)) for i, s in ((10, 100), (11, 99), (12, 101), (13, 250), (14, 101), (15, 99), (16, -400))], "by string, id long, s double").select("by", "id", stamp.alias("ts"))
    for k in (1, 2, 4, 9):
        for span in (1.0, 60.0, 86_400.0):
            got = {}
            for r in A.nearest_in_time(left, right, "by", k, span).orderBy("id", "nth").collect():
                got.setdefault(r["id"], []).append(r["other"])
            assert got == {1: [10, 11, 12, 14, 15, 13, 16][:k], 2: [11, 15, 10, 12, 14, 13, 16][:k]}, (k, span)


def test_long_intervals_stand_in_few_buckets(spark):
    intervals = spark.createDataFrame([("a", 0.0, 1e7, "long"), ("a", 50.0, 60.0, "short"), ("a", 55.0, 55.0, "point"), ("a", 9.0, 1.0, "turned")], "key string, start double, end double, seg string")
    points = spark.createDataFrame([("a", 1, 55.0), ("a", 2, 9_999_999.0), ("a", 3, 1e7 + 1), ("b", 4, 55.0)], "key string, id int, t double")
    got = {r["id"]: r["seg"] for r in A.first_interval(points, intervals, 10.0).collect()}
    assert got == {1: "long", 2: "long", 3: None, 4: None}
    assert {r["seg"] for r in A.first_interval(points, intervals.limit(0), 10.0).collect()} == {None}


def test_batches_of_any_group(spark):
    rows = spark.createDataFrame([("x" if i % 5 else "y", i) for i in range(100)], "g string, id int")
    got = {(r["g"], r["id"]): r["batch"] for r in G.batches(rows, 7, "g", "id", slices=6).collect()}
    for g in "xy":
        own = sorted(i for h, i in got if h == g)
        assert [got[g, i] for i in own] == [n // 7 for n in range(len(own))]


def test_dedup_of_repeats(spark):
    new = spark.createDataFrame([("h", "b"), ("h", "a"), ("h", "a"), ("k", "c"), ("k", "d"), ("k", "c")], "hash string, path string")
    old = spark.createDataFrame([("k", "c"), ("k", "z")], "hash string, path string")
    got = sorted((r["hash"], r["path"], r["action"]) for r in G.dedup(new, old).collect())
    assert got == [("h", "a", "duplicate"), ("h", "a", "new"), ("h", "b", "duplicate"), ("k", "c", "duplicate"), ("k", "c", "duplicate"), ("k", "d", "relink")]


def test_note_vectors_of_another_width_go(spark):
    old = spark.createDataFrame([("a", [1.0]), ("b", [1.0])], "path string, embedding array<double>")
    new = spark.createDataFrame([("a", [1.0, 2.0])], "path string, embedding array<double>")
    assert {r["path"] for r in G.note_vectors(old, new).collect()} == {"a"}
    assert {r["path"] for r in G.note_vectors(old, old.where("path = 'a'")).collect()} == {"a", "b"} and G.note_vectors(None, new) is new


def test_upserts_by_table(spark):
    old = spark.createDataFrame([("v", 1, "x")], "video_id string, updated_at int, title string")
    new = old.withColumn("updated_at", F.lit(2)).withColumn("title", F.lit("y"))
    assert [tuple(r) for r in G.upsert_into("videos", old, new).select("video_id", "updated_at", "title").collect()] == [("v", 2, "y")]


def test_gates_of_failed_cases(spark):
    metrics = spark.createDataFrame([("text", 0.5, 0.5, 0.5, 8, 20), ("clip", 0.5, 0.5, 0.5, 0, 3)], "mode string, precision double, recall double, hit_rate double, failed long, cases long")
    floors = spark.createDataFrame([("text", "recall", 0.9)], "mode string, metric string, floor double")
    got = {r["mode"]: r["failures"] for r in E.gates(metrics, floors, {"text": 7, "clip": 7}, 20).collect()}
    assert got == {"text": "failed_cases,recall", "clip": "too_few_cases"}


def test_thresholds_and_scan_report(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"modes": {"text": {"precision_at_5": 0.06, "hit_rate@10": 0.45}}, "note": "x"}))
    assert {tuple(r) for r in tables.read_thresholds(spark, str(tmp_path / "t.json")).collect()} == {("text", "precision", 0.06), ("text", "hit_rate", 0.45)}
    for name in ("a.jpg", "b.txt", "tmp_c.png"):
        (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"x")
    rows = tables.scan_report(spark, [str(tmp_path / "in"), str(tmp_path / "none")], ["tmp_*"]).collect()
    assert [r["status"] for r in rows] == ["ok", "unsupported", "excluded", "missing"]


def test_media_shapes(spark, tmp_path):
    videos = spark.createDataFrame([("v", 5.0), ("w", 0.5), ("x", 0.0)], "video_id string, duration double")
    assert [(r["video_id"], r["frame"], r["at"]) for r in media.frames(videos).orderBy("video_id", "frame").collect()] == [("v", 0, 0.0), ("v", 1, 2.0), ("v", 2, 4.0), ("w", 0, 0.0)]
    raw = json.dumps([{"start": 0, "end": 1, "text": " hi "}, {"start": 1, "end": 2, "text": " "}])
    said = media.transcripts(spark.createDataFrame([("v", raw)], "video_id string, transcript string")).collect()
    assert [(r["segment"], r["start"], r["text"]) for r in said] == [(0, 0.0, "hi")]
    blank = spark.createDataFrame([(10, 10, None), (10, 10, "[]")], "width int, height int, recognised string")
    assert [(r["blocks"], r["confidence"]) for r in media.text_blocks(blank).collect()] == [([], 0.0)] * 2
    made = []

    def compute(rows):
        made.append(rows.count())
        return rows.select("hash", F.upper("hash").alias("out"))

    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "hash string")
    assert {r["out"] for r in media.cached(rows, str(tmp_path / "cache"), compute).collect()} == {"A", "B"}
    assert {r["out"] for r in media.cached(rows, str(tmp_path / "cache"), compute).collect()} == {"A", "B"} and made == [2, 0]


def test_parsed_answers(spark):
    raws = ['{"caption": "c", "summary": "s", "tags": "X; y|z"}', 'x {"caption": 3} y', '"summary": "only \\"this\\"", "tags": ["A", 2', "one line here", None]
    rows = spark.createDataFrame([(r,) for r in raws], "raw string").select(X.parsed(F.col("raw")).alias("a")).select("a.*").collect()
    assert rows[0] == Row(caption="c", summary="s", category="Other", tags=["x", "y", "z"])
    assert rows[1]["caption"] == "3" and rows[2]["summary"] == 'only "this"' and rows[2]["tags"] == []
    assert rows[3] == Row(caption="one line here", summary="one line here", category="Other", tags=["line", "here"]) and rows[4]["caption"] == ""
    assert spark.range(1).select(X.names(F.lit("Anna met Anna and Bob in ROME")).alias("n")).first()["n"] == ["Anna", "Bob"]
    assert spark.range(1).select(X.nfkc(F.lit("ｃａｒ ﬁne")).alias("n")).first()["n"] == "car fine"


def test_chat_text(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(C.chat_terms(F.lit("Show me the jewelry, code"))) == ["jewelry", "jewellery", "ornament", "ornaments", "necklace", "bracelet", "ring", "earring"]
    assert one(C.spelt(F.lit("Jwellery or jewels"))) == "jewelry or jewels"
    assert one(C.expanded(F.lit(" my code "))) == "my code\nrelated terms: xml, css, html, json, yaml, python, java, programming" and one(C.expanded(F.lit("tree"))) == "tree"
    assert one(C.match_score(F.array(F.lit("car"), F.lit("sky")), F.array(F.lit("a car")))) == 0.5
    assert [r["token"] for r in C.answer_tokens(spark.createDataFrame([(1, "two words")], "id int, answer string")).orderBy("n").collect()] == ["two ", "words "]
    typed = spark.createDataFrame([(1, 0.0, "ca"), (1, 1.0, "car"), (1, 1.1, "cars"), (1, 5.0, "cars "), (1, 9.0, "bus")], "user_id int, s double, text string").select("user_id", F.timestamp_seconds("s").alias("ts"), "text")
    assert [r["text"] for r in C.debounced(typed).orderBy("ts").collect()] == ["cars", "bus"]


def test_chat(spark, items, vectors):
    index = S.build(items, vectors, vectors)
    low = chat.reply(index, "nothing of the kind whatsoever", lambda p: "x", vector_query=[0.0, -1.0])
    assert low.mode == "abstained" and low.confidence == "Low" and low.grounded == 0
    prompts = []

    def model(prompt):
        prompts.append(prompt)
        return "a red car road street"

    good = chat.reply(index, "red car", model, vector_query=[1.0, 0.0])
    assert good.mode == "model" and good.confidence == "High" and good.grounded > 0.7 and len(good.sources) <= 3 and "a red car on a road" in prompts[0]
    fell = chat.reply(index, "red car", None, vector_query=[1.0, 0.0])
    assert fell.mode == "explicit" and fell.answer.startswith("Found retrieved images related to 'red car':\n- 1")
    focus = chat.reply(index, "red car", lambda p: "some bird", vector_query=[1.0, 0.0], attached=2)
    assert focus.mode == "focus" and [r["id"] for r in focus.sources] == [2] and focus.grounded == 0.75
    near = chat.reply(index, "compare with similar ones", None, image=[0.8, 0.6], attached=2)
    assert near.mode == "neighbours" and 2 not in [r["id"] for r in near.sources]
    turns = spark.createDataFrame([(1, 1, "user", "red car"), (1, 2, "assistant", "yes")], "conv_id int, turn int, role string, text string")
    blocks = spark.createDataFrame([(1, 0, "Plate 4711 car", 0.9), (1, 1, "Plate 4711 car", 0.9), (1, 2, "dim 7", 0.1)], "id long, pos int, text string, confidence double")
    back = chat.reply(index, "red car this", lambda p: "Plate 4711 on a red car", vector_query=[1.0, 0.0], turns=turns, blocks=blocks)
    assert {r["needle"] for r in back.regions} == {"4711", "Plate"}


def test_collections_and_paths(spark, items):
    none = spark.createDataFrame([], api.COLLECTIONS)
    rows = api.collection_create(api.collection_create(api.collection_create(none, "b", "red"), "a", "tag:car"), "b", "blue")
    assert [(r["name"], r["query"]) for r in api.collection_list(rows).collect()] == [("a", "tag:car"), ("b", "blue")]
    wide = items.withColumn("category", F.lit("x"))
    assert {r["id"] for r in api.collection_eval(rows, "a", wide, "updated_at").collect()} == {1, 3}
    assert api.collection_eval(rows, "none", wide).count() == 0 and api.collection_list(api.collection_delete(rows, "a")).count() == 1
    paths = api.paths_add(api.paths_add(spark.createDataFrame([], "path string, enabled boolean"), "/b"), "/a")
    paths = api.toggle(api.paths_add(paths, "/b"), "path", "/b", "enabled")
    assert [r["path"] for r in api.paths_list(paths).collect()] == ["/a", "/b"] and [r["path"] for r in api.paths_list(paths, True).collect()] == ["/a"]
    assert api.paths_remove(paths, "/a").count() == 1


def test_rescan_and_labels(spark, tmp_path, items):
    (tmp_path / "a.jpg").write_bytes(b"one")
    (tmp_path / "b.jpg").write_bytes(b"one")
    paths = spark.createDataFrame([(str(tmp_path), True)], "path string, enabled boolean")
    found = api.rescan(spark, paths, spark.createDataFrame([], "hash string, path string"))
    assert sorted(r["action"] for r in found.collect()) == ["duplicate", "new"]
    clusters = spark.createDataFrame([(0,), (1,)], "id int")
    placed = spark.createDataFrame([(1, 0, 0.2), (3, 0, 0.1)], "item_id long, cluster_id int, distance double")
    labels = api.cluster_labels(clusters, items, placed, lambda captions: F.concat(F.lit('"'), F.array_join(captions, ", ")))
    assert {r["id"]: r["topic_label"] for r in labels.collect()} == {0: "a blue car, a red car on a road", 1: None}


def test_moves_resolvers_and_sinks(spark, tmp_path):
    events = [("a", "b", "moved", 1), ("x", None, "created", 2)]
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"path": p, "dst_path": d, "op": o, "ts": f"2024-01-01T00:00:{s:02d}Z"}) for p, d, o, s in [*events, ("z", None, "created", 50)]))
    seen = []
    q = W.watch(spark, str(folder), lambda df, n: seen.extend(tuple(r)[:2] for r in df.collect()), str(tmp_path / "ck"), live=False)
    q.awaitTermination(60)
    (folder / "2.json").write_text(json.dumps({"path": "z2", "dst_path": None, "op": "created", "ts": "2024-01-01T00:01:40Z"}))
    W.watch(spark, str(folder), lambda df, n: seen.extend(tuple(r)[:2] for r in df.collect()), str(tmp_path / "ck"), live=False).awaitTermination(60)
    assert {("a", "stale"), ("b", "ingest"), ("x", "ingest")} <= set(seen)
    hashed = W.resolved(spark.createDataFrame([("p",)], "path string"), lambda p: p.upper()).first()
    assert hashed["hash"] == "P"
    log = spark.readStream.schema("ts timestamp, event string").json(str(folder))
    sent = []
    telemetry.relay(log.select("ts", F.lit("e").alias("event")), lambda df, n: sent.append(df.count()), str(tmp_path / "dropped"), str(tmp_path / "ck2"), 2).trigger(availableNow=True).start().awaitTermination(60)
    assert sent == [2] and spark.read.json(str(tmp_path / "dropped")).agg(F.sum("dropped")).first()[0] == 2
    for _ in range(2):  # a replay writes the batch anew
        telemetry.emit(log, str(tmp_path / "sink"), str(tmp_path / f"ck3{_}")).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.read.json(str(tmp_path / "sink")).count() == 4


def test_logs_and_explain(spark, tmp_path, items, vectors):
    index = S.build(items, vectors, vectors)
    rows = S.explain(index, "red car", [1.0, 0.0])
    assert rows.count() <= 5 and {"fuzzy", "semantic_overlap", "attribute_score", "relation_score", "presence_score"} <= set(rows.columns)
    for _ in range(2):
        S.log_search(rows, "red car", "auto", str(tmp_path / "searches"))
    logged = spark.read.parquet(str(tmp_path / "searches")).collect()
    assert len(logged) == 2 and logged[0]["result_ids"] == [str(i) for i in ids(rows)] and logged[0]["routing"] == "auto"
    api.log_activity(spark, str(tmp_path / "activity"), "search", {"query": "red car"})
    api.log_activity(spark, str(tmp_path / "activity"), "open", {})
    assert {r["type"]: json.loads(r["details"]) for r in spark.read.parquet(str(tmp_path / "activity")).collect()} == {"search": {"query": "red car"}, "open": {}}


def test_compare_and_counters(spark, items, vectors):
    rows, prompt = S.compared(S.build(items, vectors, vectors), "red car", [1.0, 0.0])
    assert rows.count() == 2 and prompt.startswith("A: a red car on a road. street\nB: ")
    parts = [spark.createDataFrame([(a,) for a in x], "action string") for x in (["new", "new", "failed"], ["duplicate", "relink", "new"])]
    assert tuple(G.counters(parts).first()) == (3, 1, 1, 1)
    runs = spark.createDataFrame([("text", "a", 1, "x", 0.5), ("text", "a", 2, "y", 0.25), ("text", "a", 9, "z", 0.0)], "mode string, case_id string, rank int, id string, score double")
    cases = E.with_similarity(E.case_metrics(runs, spark.createDataFrame([("a", "x"), ("b", "q")], "case_id string, id string")), runs)
    assert {r["case_id"]: r["similarity"] for r in cases.collect()} == {"a": 0.375, "b": 0.0} and E.mode_metrics(cases).first()["similarity"] == 0.1875


def test_evaluation_of_modes(spark, items, vectors):
    M.register_embedder("axes", lambda: lambda texts: [[1.0, 0.0] if "red" in t else [0.0, 1.0] for t in texts])
    index = S.build(items, vectors, vectors.select("id", F.reverse("embedding").alias("embedding")))
    cases = spark.createDataFrame([("c1", "red car", ["1"]), ("c2", "blue car", ["3"])], "id string, query string, relevant_image_ids array<string>")
    runs, metrics = api.evaluate(index, cases, "axes", ("clip", "text"), 2)
    got = {r["mode"]: (r["recall"], r["hit_rate"], r["failed"], r["cases"]) for r in metrics.collect()}
    assert got == {"clip": (1.0, 1.0, 0, 2), "text": (0.0, 0.0, 2, 2)} and runs.where("rank = 1 and mode = 'clip' and case_id = 'c2'").first()["id"] == "3"


def test_kmeans_is_a_fixed_point(spark):
    """Every vector is nearest to its own centre, every centre is the mean of its vectors, and separate groups are found."""
    rows = [(i, [10.0 * (i % 3) + (i % 5) / 10, 5.0 * (i % 3) - (i % 7) / 10]) for i in range(60)]
    placed, centres = A.kmeans(spark.createDataFrame(rows, "id long, embedding array<double>"), 3)
    at, mean = {r["id"]: (r["cluster_id"], r["distance"]) for r in placed.collect()}, {r["cluster_id"]: list(r["centroid"]) for r in centres.collect()}
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    for i, v in rows:
        assert min(mean, key=lambda c: apart(v, mean[c])) == at[i][0] and at[i][1] == pytest.approx(apart(v, mean[at[i][0]]))
        assert at[i][0] == at[i % 3][0]
    for c, m in mean.items():
        own = [v for i, v in rows if at[i][0] == c]
        assert m == pytest.approx([sum(x) / len(own) for x in zip(*own)])
