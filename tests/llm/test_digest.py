"""Quantile summaries: bounds, sizes and answers against sorted values, in trees of merges; the report against plain counting."""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tessera.llm import digest

CLICKS = "click_id long, client_id long, value double"
LINES = "item_id long, vendor_id long"
ITEMS = "item_id long, brand string, price double"


def values(kind, n, rng):
    if kind == "ties":
        return rng.integers(0, 40, n)
    if kind == "one heavy":
        return np.where(rng.random(n) < 0.9, 5000, rng.integers(0, 10_000, n))
    if kind == "light beside heavy":
        return np.concatenate([np.full(n - 1500, 10**6), rng.choice(10**6, 1500, replace=False)])
    if kind == "tail":
        return np.floor(rng.pareto(0.7, n) * 100)
    return rng.integers(0, 10**7, n)


def summary(spark, x, keys=("g",), parts=1):
    rows = sorted(Counter(x.tolist()).items())
    frame = spark.createDataFrame([("k", float(v), c) for v, c in rows], "g string, x double, c long").repartition(parts)
    return digest.summarised(frame, list(keys))


@pytest.mark.parametrize("kind", ["ties", "one heavy", "light beside heavy", "tail", "spread"])
@pytest.mark.parametrize("parts,fan", [(1, 256), (7, 256), (9, 2)])
def test_answers_within_one_percent(spark, monkeypatch, kind, parts, fan):
    monkeypatch.setattr(digest, "FAN", fan)
    x = np.sort(values(kind, 20_000, np.random.default_rng(len(kind))))
    s = summary(spark, x, parts=parts)
    points = s.orderBy("low").toPandas()
    distinct = len(np.unique(x))
    assert min(20, distinct) <= len(points) <= min(len(x), digest.LIMIT) and set(points["n"]) == {len(x)}
    assert points["low"].isin(x).all() and points["high"].isin(x).all() and (points["low"].to_numpy()[1:] > points["high"].to_numpy()[:-1]).all()
    upto = np.searchsorted(x, points["high"], "right")
    assert (points["least"].cumsum() <= upto).all() and (upto <= points["most"].cumsum()).all()
    below = np.searchsorted(x, points["low"])
    assert (points["least"].cumsum() - points["least"] <= below).all() and (below <= points["most"].cumsum() - points["most"]).all()
    rows = digest.quantiles(s, ["g"], 20).orderBy("i").toPandas()
    assert rows["target"].tolist() == [-(-i * len(x) // 20) for i in range(1, 20)]
    assert rows["answer"].is_monotonic_increasing and rows["answer"].isin(x).all()
    under, to = np.searchsorted(x, rows["answer"]), np.searchsorted(x, rows["answer"], "right")
    error = np.maximum(0, np.maximum(under + 1 - rows["target"], rows["target"] - to))
    assert (100 * error <= len(x)).all()
    if distinct <= digest.EXACT:
        assert error.max() == 0 and len(points) == distinct


def test_heavy_values_are_exact_atoms(spark):
    x = values("one heavy", 30_000, np.random.default_rng(2))
    row = summary(spark, x).where("low = 5000").first()
    assert row["low"] == row["high"] == 5000 and row["least"] == row["most"] == (x == 5000).sum()


def test_limit_holds_where_bounds_are_wide():
    rng = np.random.default_rng(4)
    least = rng.integers(0, 3, 40_000)
    most = least[rng.permutation(40_000)]
    assert 20 <= len(digest.centroids(np.arange(40_000.0), least, most)) <= digest.LIMIT


@pytest.mark.parametrize("span", [10, 2**15, 2**31])
def test_exact_ranks(spark, span):
    rng = np.random.default_rng(span)
    x = rng.integers(-span, span, 3000)
    rows = [(g, int(v), c) for g, part in (("a", x[:2980]), ("b", x[2980:2990])) for v, c in Counter(part.tolist()).items()]
    got = digest.ranks(spark.createDataFrame(rows, "g string, x long, c long"), ["g"], 20).toPandas()
    own = np.sort(x[:2980])
    assert set(got["g"]) == {"a"} and len(got) == len(np.unique(own)) and set(got["n"]) == {2980}
    assert (got["below"] == np.searchsorted(own, got["x"])).all()


def plain(clicks, lines, items):
    price = {i: (b, p) for i, b, p in items}
    rows = [("value", str(c), i, v) for i, c, v in {r[0]: r for r in clicks if r[0] is not None}.values() if c is not None and v is not None]
    rows += [("price", price[i][0], v, price[i][1]) for i, v in lines if i in price and None not in price[i] and v is not None]
    groups = {}
    for stream, grp, key, money in rows:
        batch = zlib.crc32(str(key).encode()) % 16
        for b in (batch, -1):
            groups.setdefault((stream, grp, b), []).append(int(np.floor(100 * money + 0.5)) + 1000 * batch)
    return {k: np.sort(v) for k, v in groups.items() if len(v) >= 20}


def check(report, groups):
    assert len(report) == 19 * len(groups)
    for r in report.itertuples():
        x = groups[r.stream, r.grp, r.batch]
        target = -(-r.i * len(x) // 20)
        assert (r.n, r.target, r.exact_x) == (len(x), target, x[target - 1])
        assert (r.n_below, r.n_upto) == (np.searchsorted(x, r.answer), np.searchsorted(x, r.answer, "right"))
        assert r.rank_error == max(0, r.n_below + 1 - target, target - r.n_upto) and r.within == (1000 * r.rank_error <= 10 * r.n) and r.within
        assert min(20, len(set(x))) <= r.points <= min(len(x), 2000)
    assert all(g.sort_values("i")["answer"].is_monotonic_increasing for _, g in report.groupby(["stream", "grp", "batch"]))


def test_registered_query_over_the_given_tables(spark):
    from tessera.llm.queries import QUERIES

    base = "/root/testdata/sf0.01"
    read = lambda t, *c: [tuple(None if pd.isna(v) else v for v in r) for r in spark.read.parquet(f"{base}/{t}.parquet").select(*c).collect()]
    groups = plain(read("clicks", "click_id", "client_id", "value"), read("sale_lines", "item_id", "vendor_id"), read("items", "item_id", "brand", "price"))
    check(QUERIES["op13_quantile_summaries"](spark, base).toPandas(), groups)


def test_awkward_rows(spark):
    clicks = [(i, 1, 3.5 * (i % 4)) for i in range(60)] + [(5, 1, 3.5), (None, 1, 2.0), (61, None, 2.0), (62, 1, None), (63, 1, -7.25)]
    lines = [(1, v) for v in range(40)] * 2 + [(None, 3), (2, 3), (9, 4), (1, None)]
    items = [(1, "B", 4.125), (2, None, 3.0), (3, "C", None)]
    frames = [spark.createDataFrame(r, s) for r, s in ((clicks, CLICKS), (lines, LINES), (items, ITEMS))]
    groups = plain(clicks, lines, items)
    check(digest.quantile_report(*frames).toPandas(), groups)
    more = [f.selectExpr("*", "1 as x", "2 as c", "3 as batch", "4 as stream", "5 as low", "6 as n") for f in frames]
    check(digest.quantile_report(*more).toPandas(), groups)
    assert digest.quantile_report(*(f.limit(0) for f in frames)).count() == 0


def test_null_keys_and_values(spark):
    rows = [("a", 1.0, 2), (None, 2.0, 3), (None, 4.0, 1), ("a", None, 5), ("a", float("nan"), 5)]
    got = digest.quantiles(digest.summarised(spark.createDataFrame(rows, "g string, x double, c long"), ["g"]), ["g"], 4)
    assert sorted((str(r["g"]), r["i"], r["answer"]) for r in got.collect()) == [("None", 1, 2.0), ("None", 2, 2.0), ("None", 3, 2.0), ("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 1.0)]
