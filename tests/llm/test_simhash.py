"""SimHash fingerprints against whole-number counting, components against all pairs, thresholds against the pigeonhole."""

import itertools
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import neardup, simhash
from tessera.llm.common import written

from .helpers import AWKWARD, clashing, docs


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_classes(prints, distance):
    """The smallest member of its class for each of distinct fingerprints, by all pairs."""
    u = np.array(sorted(set(prints)), np.uint64)
    parent = list(range(len(u)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= distance):
            a, b = sorted((root(i), root(i + 1 + int(j))))
            parent[b] = a
    return {int(v): int(u[root(i)]) for i, v in enumerate(u)}


def expected(rows):
    prints = {(i, t): plain_fingerprint(t) for i, t in rows}
    classes = plain_classes([p for (i, _), p in prints.items() if i is not None], 2)
    low = {}
    for (i, _), p in prints.items():
        if i is not None:
            low[classes[p]] = min(low.get(classes[p], i), i)
    return sorted((str(i), f"{p:016x}", str(None if i is None else low[classes[p]])) for i, t in rows for p in [prints[i, t]])


def got(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_query_over_the_given_table(spark, sf):
    from tessera.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    result = QUERIES["op12_simhash_near_dedup"](spark, f"/root/testdata/{sf}")
    assert got(result) == expected(rows)


def test_awkward_rows(spark):
    assert got(simhash.simhash_classes(docs(spark))) == expected(AWKWARD)
    assert got(simhash.simhash_classes(clashing(docs(spark)).selectExpr("*", "1 as fp", "2 as part", "3 as value"))) == expected(AWKWARD)
    assert simhash.simhash_classes(docs(spark, [])).count() == 0


def test_wordless_texts_link_with_fingerprints_near_zero(spark):
    r = {x["doc_id"]: x for x in simhash.simhash_classes(docs(spark, [(5, ""), (3, None), (9, " \t"), (4, "word")])).collect()}
    assert r[5]["component_id"] == r[3]["component_id"] == r[9]["component_id"] == 3 and r[4]["component_id"] == 4
    assert r[5]["fingerprint"] == "0" * 16


def test_long_text_in_runs(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "RUN", 7)
    assert simhash.fingerprint(text, 3) == whole == simhash._signed(plain_fingerprint(text))


def crowd(seed, balls=2, each=250, flips=6, others=300):
    rng = np.random.default_rng(seed)
    out = [int(v) for v in rng.integers(0, 2**64, others, np.uint64)]
    for centre in out[:balls]:
        for _ in range(each):
            v = centre
            for bit in rng.choice(64, rng.integers(0, flips), replace=False):
                v ^= 1 << int(bit)
            out.append(v)
    return sorted(set(out))


@pytest.mark.parametrize("distance,parts,hot", [(2, None, 64), (2, 2, 64), (2, 4, 4), (2, None, 1), (1, None, 4), (1, 1, 64), (0, None, 4)])
def test_crowded_places_lose_no_link(spark, monkeypatch, distance, parts, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    prints = crowd(distance)
    frame = written(spark.createDataFrame([(simhash._signed(v),) for v in prints], "fp long"), "fps")
    links = written(simhash.links(frame, distance, parts), "links")
    pairs = [(r["x"], r["y"]) for r in links.collect()]
    assert all(0 < ((x ^ y) & (2**64 - 1)).bit_count() <= distance for x, y in pairs)
    comp = {r["v"]: r["c"] for r in neardup.components(links, "bigint").collect()}
    want, mine = {}, {}
    for v, c in plain_classes(prints, distance).items():
        want.setdefault(c, set()).add(v)
        mine.setdefault(comp.get(simhash._signed(v), simhash._signed(v)), set()).add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(0)
    cost = rng.random((50, 4, 3)) * 10
    cost[:, :, 0] = 0
    cost[3, :2, 1:] = np.inf
    chosen, price = simhash.allocate(cost, 3)
    for row in range(50):
        best = min(sum(cost[row, k, t] for k, t in enumerate(c)) for c in itertools.product(range(3), repeat=4) if sum(c) == 3)
        assert chosen[row].sum() == 3 and np.isclose(price[row], best)
        assert np.isclose(sum(cost[row, k, t] for k, t in enumerate(chosen[row])), best)


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (4000, 64))
    for k in range(1, 20):
        bits[:, 3 * k] = bits[:, 0] ^ (rng.random(4000) < 0.05)
    groups = simhash.parts_of((bits.T @ bits).astype(float), 4000, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert max(sum(b % 3 == 0 and b < 60 for b in g) for g in groups) == 20


def test_distance_is_bounded(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)
