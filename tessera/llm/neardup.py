"""MinHash near-dedup with b-bit signatures.

1. Every text becomes its set of distinct word shingles (64-bit hashes), K minima, BANDS band keys and a packed
   signature of the low 2 bits of the minima. Equal sets collapse to one representative.
2. Representatives that share a band key are candidates. Buckets of up to SMALL give all their pairs. Larger ones
   give stars: each member with the bucket's consensus member (nearest to the majority signature of a bounded
   sample) and with LEADERS members taken by hash, so candidates stay linear in a bucket.
3. Candidates whose collision-corrected similarity, from bit counts of the signatures, could reach the threshold
   are confirmed on their full sets; confirmed links make connected components.
4. In large buckets that still hold several components, the members outside the main one are compared with all,
   block against block, by longer signatures; a pair is sent on from the first bucket that it shares, and confirmed
   on full sets. So no link waits on the choice of leaders.

Nothing but counts reaches the driver. A row with null, empty or wordless text has an empty set and links with
nothing; a null doc_id is in no component (null) and kept; repeated rows are equal sets; rows of one doc_id with
unlike texts are linked each by its own text; very long texts are shingled whole, one at a time; ties between ids go to
the smallest; an empty table gives an empty one; other columns aren't read, and pass through ``one_of_each``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import fresh, written

BANDS, ROWS = 28, 5
K = BANDS * ROWS
BITS = 2
LONG = 1024  # minima of the longer signatures
SMALL, LEADERS, BLOCK, CONSENSUS = 16, 1, 512, 64
_CHANCE = 1 / (1 << BITS)

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 2**31, K, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, K, np.uint64).astype(np.uint32)
_LONG_A = _rng.integers(0, 2**31, LONG, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_LONG_B = _rng.integers(0, 2**32, LONG, np.uint64).astype(np.uint32)
_ORDER = np.uint64(0x9E3779B97F4A7C15)
_BAND = _rng.integers(1, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; A-Z in lower case; all words if there are fewer.

    Each word is hashed by XXH64, and a shingle mixes the hashes of its words in their order.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for i in range(width):
        out = _mix(out * _ORDER + each[i : i + count])
    return np.unique(out)


def minima(hashes: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[i : i + 1024, None] * a + b).min(0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    return _mix((low.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def packed(low: np.ndarray) -> bytes:
    bits = low ^ (low >> np.uint32(15))
    return np.packbits(bits & 1).tobytes() + np.packbits(bits >> np.uint32(1) & 1).tobytes()


def unpacked(sigs: list[bytes]) -> np.ndarray:
    """Signatures as a uint8 matrix, a row for each."""
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)


def similarity(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Collision-corrected similarity of packed signatures of ``k`` minima, row by row."""
    x, half = a ^ b, (k + 7) // 8
    other = np.bitwise_count(x[..., :half] | x[..., half:]).sum(-1, dtype=np.int32)
    return ((1 - other / k) - _CHANCE) / (1 - _CHANCE)


def cut(percent: int, k: int = K) -> float:
    """The estimate that a pair at the threshold misses once in about 300,000 times (4.5 standard deviations)."""
    p = percent / 100 * (1 - _CHANCE) + _CHANCE
    return percent / 100 - 4.5 * (p * (1 - p) / k) ** 0.5 / (1 - _CHANCE)


def set_id(hashes: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        a, b = hashes.sum(dtype=np.uint64), _mix(hashes * np.uint64(0xFF51AFD7ED558CCD)).sum(dtype=np.uint64)
    return np.asarray([a, b], "<u8").tobytes() + len(hashes).to_bytes(4, "little")


def signatures(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n, sid, bands and sig of every row."""

    def run(batches):
        for b in batches:
            n, sids, bands, sigs = [], [], [], []
            for t in b.column(1):
                h = shingles(t.as_py(), width)
                n.append(len(h))
                sids.append(set_id(h))
                low = minima(h) if len(h) else None
                bands.append(None if low is None else band_keys(low))
                sigs.append(None if low is None else packed(low))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(sids, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "mark", "n", "sid", "bands", "sig"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text], F.xxhash64(docs[text]).alias("mark")).mapInArrow(run, "doc_id long, mark long, n long, sid binary, bands array<long>, sig binary")


def _sets(docs: DataFrame, wanted: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(sid, hashes) of the representatives in ``wanted`` (rep, sid)."""

    def run(batches):
        for b in batches:
            found = []
            for sid, t in zip(b.column(0).to_pylist(), b.column(1)):
                h = shingles(t.as_py(), width)
                found.append(h.tobytes() if set_id(h) == sid else None)
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["sid", "hashes"])
            yield out.filter(out.column(1).is_valid())

    own = docs.select(docs[key].cast("long").alias("rep"), docs[text].alias("text"))
    return own.join(wanted, "rep").select("sid", "text").mapInArrow(run, "sid binary, hashes binary").groupBy("sid").agg(F.first("hashes").alias("hashes"))


def _buckets(postings: DataFrame) -> DataFrame:
    """(bucket, sid, size) of the buckets with two members or more."""
    sizes = postings.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return postings.join(written(sizes, "sizes"), "bucket")


def _candidates(members: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (x < y) of written ``members`` (bucket, sid, size); and the members of large buckets."""
    listed = members.where(F.col("size") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list("sid")).alias("s"))
    listed = listed.select(F.explode(F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x, y))))")).alias("p"))
    pairs = listed.select("p.x", "p.y").distinct()
    large = members.where(F.col("size") > SMALL)
    if large.isEmpty():
        return pairs, large
    salts = [F.min_by("sid", F.xxhash64("sid", F.lit(i))).alias(f"l{i}") for i in range(LEADERS)]
    leaders = large.groupBy("bucket").agg(F.array(*salts).alias("by_hash"), F.max("size").alias("n"))
    shape = "bucket long, majority binary"

    def majority(key, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.stack([np.unpackbits(np.frombuffer(s, np.uint8)) for s in pdf["sig"]])
        return pd.DataFrame({"bucket": [key[0]], "majority": [np.packbits(2 * bits.sum(0) >= len(bits)).tobytes()]})

    leaders = written(leaders, "leaders")
    share = F.pmod(F.xxhash64("sid", F.lit("share")), F.col("n").cast("long")) < CONSENSUS
    sampled = large.join(leaders.select("bucket", "n"), "bucket").where(share).join(reps.select("sid", "sig"), "sid").select("bucket", "sig")
    consensus = written(sampled.groupBy("bucket").applyInPandas(majority, shape), "majority")
    near = large.join(reps.select("sid", "sig"), "sid").join(consensus, "bucket").select("bucket", "sid", "sig", "majority")

    def unlike(batches):
        for b in batches:
            own, most = (unpacked(b.column(i).to_pylist()) for i in (2, 3))
            far = np.bitwise_count(own ^ most).sum(1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(far, pa.int32())], ["bucket", "sid", "unlike"])

    central = near.mapInArrow(unlike, "bucket long, sid binary, unlike int").groupBy("bucket").agg(F.min_by("sid", F.struct("unlike", "sid")).alias("central"))
    heads = written(leaders.join(central, "bucket", "left").select("bucket", F.array_distinct(F.array_compact(F.concat("by_hash", F.array("central")))).alias("heads")), "heads")
    star = large.join(heads, "bucket").select("sid", F.explode("heads").alias("head")).where("sid <> head")
    star = star.select(F.least("sid", "head").alias("x"), F.greatest("sid", "head").alias("y"))
    return pairs.unionByName(star).distinct(), large


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The candidates that the signatures don't rule out."""
    least = cut(percent)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(similarity(*(unpacked(b.column(i).to_pylist()) for i in (2, 3))) >= least)).select(["x", "y"])

    sig = lambda side: reps.select(F.col("sid").alias(side), F.col("sig").alias(f"sig_{side}"))
    return pairs.join(sig("x"), "x").join(sig("y"), "y").select("x", "y", "sig_x", "sig_y").mapInArrow(run, "x binary, y binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, big = sorted((len(x), len(y)))
                if 100 * small < percent * big:
                    keep.append(False)
                    continue
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.filter(pa.array(keep, pa.bool_())).select(["x", "y"])

    side = lambda s: sets.select(F.col("sid").alias(s), F.col("hashes").alias(f"set_{s}"))
    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "set_x", "set_y").mapInArrow(run, "x binary, y binary")


def components(links: DataFrame, vertex: str = "binary") -> DataFrame:
    """(v, c): the smallest vertex reachable from each vertex of written ``links`` (x, y); minima and pointer jumps."""
    both = written(links.select(F.col("x").alias("v"), F.col("y").alias("w")).union(links.select("y", "x")), "edges")
    labels = written(both.groupBy("v").agg(F.min(F.least("v", "w")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "c"), "w").groupBy("v").agg(F.min("c").alias("near"))
        low = written(labels.join(near, "v").select("v", F.least("c", "near").alias("l"), F.col("c").alias("was")), "labels")
        jump = low.select(F.col("v").alias("l"), F.col("l").alias("to"))
        after = written(low.join(jump, "l").select("v", F.least("l", "to").alias("c"), "was"), "labels")
        if after.where("c <> was").isEmpty():
            return after.select("v", "c")
        labels = after.select("v", "c")


def _divided(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(bucket, sid, size, c, main) of the buckets whose members are in several components."""
    own = members.join(comps.select(F.col("v").alias("sid"), "c"), "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    own = written(own, "members")
    by = own.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    main = by.groupBy("bucket").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    return written(own.join(written(main.drop("parts"), "main"), "bucket"), "divided")


def _blocks(divided: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of unlike components in a bucket that the longer signatures don't rule out, block against block."""
    least = cut(percent, LONG)

    def longer(batches):
        for b in batches:
            sigs = [packed(minima(np.frombuffer(h.as_buffer(), np.uint64), _LONG_A, _LONG_B)) for h in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sigs, pa.binary())], ["sid", "buckets", "sig"])

    shared = divided.groupBy("sid").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))  # BANDS at most
    sigs = written(sets.join(shared, "sid").select("sid", "hashes", "buckets").mapInArrow(longer, "sid binary, buckets array<long>, sig binary"), "longer")
    block = F.pmod(F.xxhash64("sid"), F.ceil(F.col("size") / BLOCK).cast("long"))
    rows = written(divided.join(sigs, "sid").select("bucket", block.alias("block"), "main", "c", "sid", "sig", "buckets"), "blocks")
    pack = F.collect_list(F.struct("sid", "sig", "c", "buckets"))
    every = written(rows.groupBy("bucket", "block").agg(pack.alias("rows")), "blocks")
    asked = written(rows.where("c <> main").groupBy("bucket", F.col("block").alias("of")).agg(pack.alias("asked")), "asked")
    # each asked block goes to each block of its bucket, by the number of that block: pairs of blocks are spread like blocks
    many = every.groupBy("bucket").agg(F.max("block").alias("last"))
    asked = asked.join(many, "bucket").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))

    def run(batches):
        for b in batches:
            for bucket, some, all_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                x, y = (unpacked([r["sig"] for r in z]) for z in (some, all_))
                found = set()
                for i, one in enumerate(some):
                    for j in np.flatnonzero(similarity(x[i], y, LONG) >= least):
                        other = all_[j]
                        if other["c"] != one["c"] and min(set(one["buckets"]) & set(other["buckets"])) == bucket:
                            found.add(tuple(sorted((one["sid"], other["sid"]))))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], ["x", "y"])

    return asked.join(every, ["bucket", "block"]).select("bucket", "asked", "rows").mapInArrow(run, "x binary, y binary").distinct()


def _judged(docs: DataFrame, text: str, key: str, width: int, percent: int) -> DataFrame:
    """doc_id, mark, group (of near copies; null without words), n_shingles and component_id of every row."""
    sigs = written(signatures(docs, text, key, width), "signatures")
    reps = sigs.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = written(reps, "representatives")
    members = written(_buckets(reps.select("sid", F.explode("bands").alias("bucket"))), "members")
    active = members.select("sid").distinct().join(reps.select("sid", "rep"), "sid")
    sets = written(_sets(docs, active, text, key, width), "sets")

    pairs, large = _candidates(members, reps)
    links = written(_confirmed(_likely(pairs, reps, percent), sets, percent), "links")
    comps = components(links)
    if not large.isEmpty():
        divided = _divided(large, comps)
        if not divided.isEmpty():
            found = written(_confirmed(_blocks(divided, sets, percent), sets, percent), "links")
            comps = components(written(links.unionByName(found), "links"))

    named = comps.join(reps.select(F.col("sid").alias("v"), "rep"), "v")
    lowest = written(named.groupBy("c").agg(F.min("rep").alias("component")), "lowest")
    linked = comps.join(lowest, "c").select(F.col("v").alias("sid"), "c", "component")
    of_rep = written(reps.select("sid", "rep").join(linked, "sid", "left").select("sid", F.coalesce("c", "sid").alias("group"), F.coalesce("component", "rep").alias("component")), "components")
    out = sigs.select("doc_id", "mark", F.col("n").alias("n_shingles"), "sid").join(of_rep, "sid", "left")
    return out.select("doc_id", "mark", "group", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, of every row."""
    out = _judged(docs, text, key, width, percent).drop("mark", "group")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, of each group of near copies one: that of the smallest doc_id, of rows of that id the one of the least hash of the text.

    Rows go by id and text, so a text that shares its id with a copy of another stays; of repeated rows one stays.
    Rows without an id or without words are in no group and all stay.
    """
    own, mark, least = F.col(f"`{key}`").cast("long"), fresh(docs, "mark"), fresh(docs, "component_id")
    first = _judged(docs, text, key, width, percent).where("n_shingles > 0 and doc_id = component_id")
    chosen = first.groupBy("group").agg(F.first("component_id").alias(least), F.min("mark").alias(mark)).drop("group")
    grouped = F.coalesce(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & own.isNotNull()
    rows = docs.where(grouped).withColumns({mark: F.xxhash64(f"`{text}`"), least: own}).dropDuplicates([least, mark])
    return rows.join(written(chosen, "chosen"), [least, mark], "left_semi").select(*docs.columns).unionByName(docs.where(~grouped))
