"""SimHash near-dedup by the generalised pigeonhole principle.

1. Every text becomes a 64-bit fingerprint: a bit is 1 if it is set in over half of the XXH64 of its word shingles,
   repeats included. Equal fingerprints collapse to one.
2. Correlated bits are grouped into parts (co-occurrence counts over all fingerprints), so that what copies have in common
   crowds into few values of few parts.
3. Each fingerprint gets its own thresholds: with parts of thresholds t, -1 (not probed), 0 or 1, and a sum of (t + 1) of
   ``distance`` + 1, every fingerprint within ``distance`` agrees with it to t bits in one part at least. Dynamic
   programming over the parts takes the cheapest thresholds by estimated candidates: the exact count of a value for 0, and for
   1 also what the frequencies of its bits let expect of its neighbours. Parts are probed and candidates verified.
4. A fingerprint that no thresholds keep under HOT candidates, or whose probes meet a value of more than HOT, takes the exact way for
   crowded places: it lays itself and its 64 one-bit variants out as keys. Two such fingerprints have a key in common
   exactly if they differ in 2 bits or fewer, and at most 65 meet in a key. A link needs one light end, whose probes find the
   other, or two heavy ends, which meet. So work is linear in the number of fingerprints, and no link is lost.

Only the 64 x 64 co-occurrence counts and numbers of rows reach the driver. A row with null, empty or wordless text has
fingerprint zero and links like any other; a null doc_id is in no component (null); repeated rows are equal fingerprints;
rows of one doc_id with unlike texts are linked each by its own text; very long texts are hashed whole, in
runs of shingles; ties between ids go to the smallest; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .common import written
from .neardup import components

SEED, RUN = 42, 8192
HOT, PROBE = 64, 0.1  # candidates a fingerprint may have by probing; what a probe costs beside a candidate


def fingerprint(text: str | None, width: int) -> int:
    """The SimHash of a text as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, whole = (ends - sizes), b" ".join(words)
    count = max(1, len(words) - width + 1)
    starts, ends = starts[:count].tolist(), ends[len(words) - count :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, count, RUN):
        digests = b"".join([xxh64_digest(whole[s:e], SEED) for s, e in zip(starts[i : i + RUN], ends[i : i + RUN])])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """doc_id and fingerprint (long) of every row."""

    def run(batches):
        for b in batches:
            found = [fingerprint(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text]).mapInArrow(run, "doc_id long, fingerprint long")


def _bits(prints: np.ndarray) -> np.ndarray:
    """A row of 64 bits, the highest first, for each fingerprint."""
    return np.unpackbits(prints.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def co_occurrence(fps: DataFrame) -> np.ndarray:
    """How often each pair of bits is set together, over all fingerprints; single bits on the diagonal."""

    def run(batches):
        total = np.zeros((64, 64))
        for b in batches:
            bits = _bits(np.asarray(b.column(0))).astype(np.float64)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096, dtype=np.int32)), pa.array(total.ravel())], ["at", "n"])

    rows = fps.select("fp").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(4096)
    for r in rows:
        out[r["at"]] = r["n"]
    return out.reshape(64, 64)


def parts_of(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits (0 the highest) in ``parts`` groups of nearly equal size: each starts with the strongest pair left and takes the bit nearest to it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(p * (1 - p))
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.nan_to_num(np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        inner = corr[np.ix_(left, left)]
        i = int(inner.argmax()) // len(left)
        group = [left[i]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: (corr[b, group].sum(), -b)))
        left = [b for b in left if b not in group]
        out.append(sorted(group))
    return out


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def allocate(cost: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest thresholds plus one (0, 1 or 2 for each part, ``units`` in all) for each row of ``cost`` (rows, parts, 3), and their cost."""
    rows, parts, _ = cost.shape
    best = np.full((rows, units + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((rows, parts, units + 1), np.int8)
    for k in range(parts):
        tried = np.full((3, rows, units + 1), np.inf)
        for t in range(3):
            if t <= units:
                tried[t, :, t:] = best[:, : units + 1 - t] + cost[:, k, t, None]
        took[:, k] = tried.argmin(0)
        best = tried.min(0)
    chosen, left = np.zeros((rows, parts), np.int8), np.full(rows, units)
    for k in range(parts - 1, -1, -1):
        chosen[:, k] = took[np.arange(rows), k, left]
        left -= chosen[:, k]
    return chosen, best[:, units]


def _plans(counted: DataFrame, groups: list[list[int]], p: np.ndarray, n: int, distance: int) -> DataFrame:
    """fp, heavy and probes (part, value) of every fingerprint, from fp and counts (of its value in each part)."""
    masks = [sum(1 << (63 - b) for b in g) for g in groups]
    safe = np.clip(p, 1 / (n + 2), 1 - 1 / (n + 2))

    def run(batches):
        for b in batches:
            fps = np.asarray(b.column(0))
            counts = np.asarray(b.column(1).flatten(), np.float64).reshape(len(fps), len(groups))
            own = np.where(_bits(fps) == 1, safe, 1 - safe)
            cost = np.zeros((*counts.shape, 3))
            cost[..., 1] = np.where(counts > HOT, np.inf, counts + PROBE)
            for k, g in enumerate(groups):
                expected = n * own[:, g].prod(1) * ((1 - own[:, g]) / own[:, g]).sum(1)
                cost[:, k, 2] = cost[:, k, 1] + expected + PROBE * len(g)
            chosen, price = allocate(cost, distance + 1)
            heavy = ~(price <= HOT)
            probes = []
            for f, h, took in zip(fps.tolist(), heavy.tolist(), chosen.tolist()):
                values = []
                for k, t in enumerate([] if h else took):
                    if t:
                        values.append({"part": k, "value": _signed(f & masks[k])})
                    if t == 2:
                        values += [{"part": k, "value": _signed((f & masks[k]) ^ (1 << (63 - bit)))} for bit in groups[k]]
                probes.append(values)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(heavy), pa.array(probes, pa.list_(pa.struct([("part", pa.int32()), ("value", pa.int64())])))], ["fp", "heavy", "probes"])

    return counted.mapInArrow(run, "fp long, heavy boolean, probes array<struct<part:int,value:long>>")


def _met(heavy: DataFrame, distance: int) -> DataFrame:
    """Links between the fingerprints ``heavy`` (fp) that differ in ``distance`` bits or fewer, by the keys they have in common."""
    flips = F.array(*[F.lit(_signed(1 << k)) for k in range(64)])
    keys = heavy.select("fp", F.explode(F.concat(F.array("fp"), F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m)))).alias("key"))
    if distance == 1:  # only one that is the key itself is near enough to the others
        keys = keys.join(heavy.select(F.col("fp").alias("key")), "key", "left_semi").withColumn("first", F.col("key"))
        return keys.where("fp <> first").select(F.least("fp", "first").alias("x"), F.greatest("fp", "first").alias("y"))
    first = keys.groupBy("key").agg(F.collect_list("fp").alias("met"))  # 65 at most
    met = first.where(F.size("met") > 1).select(F.explode("met").alias("y"), F.array_min("met").alias("x"))
    return met.where("x < y").select("x", "y")


def links(fps: DataFrame, distance: int = 2, parts: int | None = None) -> DataFrame:
    """Pairs (x < y) of written distinct ``fps`` (fp) that differ in 1 to ``distance`` bits (2 at most): enough of them to connect all.

    As many parts as thresholds need, or fewer, so that a part is longer than the logarithm of the number of fingerprints.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    n = fps.count()
    if parts is None:
        parts = max(1, (distance + 2) // 2, min(distance + 1, 64 // max(1, n.bit_length())))
    together = co_occurrence(fps)
    groups, p = parts_of(together, n, parts), np.diag(together) / max(n, 1)
    masks = F.array(*[F.lit(_signed(sum(1 << (63 - b) for b in g))) for g in groups])
    rows = fps.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("part", "value"))
    values = written(rows.groupBy("part", "value").agg(F.count("*").alias("n")), "values")
    index = written(rows.join(values, ["part", "value"]), "index")
    counts = F.transform(F.array_sort(F.collect_list(F.struct("part", "n"))), lambda s: s["n"])
    plans = written(_plans(index.groupBy("fp").agg(counts.alias("counts")), groups, p, n, distance), "plans")

    probes = plans.where("not heavy").select("fp", F.inline("probes"))
    struck = written(probes.join(values.where(F.col("n") > HOT), ["part", "value"], "left_semi").select("fp").distinct(), "struck")
    found = probes.join(struck, "fp", "left_anti").join(index.where(F.col("n") <= HOT).select("part", "value", F.col("fp").alias("other")), ["part", "value"])
    near = found.where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance))
    probed = near.select(F.least("fp", "other").alias("x"), F.greatest("fp", "other").alias("y"))
    heavy = plans.where("heavy").select("fp").unionByName(struck)
    return probed.unionByName(_met(heavy, distance)).distinct()


def simhash_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id reachable over links) of every row."""
    prints = written(fingerprints(docs, text, key, width), "fingerprints")
    fps = written(prints.where("doc_id is not null").groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("rep")), "distinct")
    comps = components(written(links(fps, distance), "links"))
    named = comps.join(fps.select(F.col("fp").alias("v"), "rep"), "v")
    lowest = named.groupBy("c").agg(F.min("rep").alias("component"))
    linked = named.join(lowest, "c").select(F.col("v").alias("fp"), "component")
    of_print = written(fps.join(linked, "fp", "left").select(F.col("fp").alias("fingerprint"), F.coalesce("component", "rep").alias("component")), "components")
    out = prints.join(of_print, "fingerprint", "left")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return out.select("doc_id", hexed.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
