"""Hashed n-gram multinomials over whole Arrow text columns.

Two families share one bucket space: byte 4-grams, and 3-grams of coarse word shapes (length class, case, symbols,
whether the word repeats the one before). Model weights are fixed-point integers, so that a document's sum is
exact and doesn't depend on the batch it is scored in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
BUCKETS = 1 << BITS
SCALE = 1 << 12  # fixed-point units of one nat
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!=_{}[]\\^~@/+"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - BITS)


def byte_grams(data: np.ndarray) -> np.ndarray:
    """The bucket of the 4-gram that starts at each byte but the last three."""
    if len(data) < 4:
        return np.zeros(0, np.uint32)
    b = data.astype(np.uint32)
    h = b[:-3] * np.uint32(0x85EBCA6B)
    h += b[1:-2] * np.uint32(0xC2B2AE35)
    h += b[2:-1] * np.uint32(0x27D4EB2F)
    h += b[3:] * np.uint32(0x165667B1)
    return _mix(h)


def word_shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and shape class (under 256) of each word of each row; no word reaches over the end of its row."""
    space = _SPACE[data]
    first, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    first[offsets] = True
    last[offsets - 1] = True  # of an empty row in front: the spare last place
    behind, ahead = np.concatenate(([True], space[:-1])), np.concatenate((space[1:], [True]))
    starts, ends = np.flatnonzero(~space & (behind | first[:-1])), np.flatnonzero(~space & (ahead | last[:-1])) + 1
    if not len(starts):
        return starts, np.zeros(0, np.uint32)
    size = ends - starts
    total = lambda flag: np.add.reduceat(flag, starts) if len(starts) else flag
    symbols = total((_SYMBOL[data]).astype(np.int32))
    upper = total((_UPPER[data]).astype(np.int32))
    digits = total(((data >= 48) & (data <= 57)).astype(np.int32))
    weight = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    weight ^= weight >> np.uint64(29)
    inside = np.arange(len(data), dtype=np.uint64)
    step = np.repeat(starts.astype(np.uint64), np.diff(np.append(starts, len(data))))
    lead = np.zeros(starts[0], np.uint64)
    place = inside - np.concatenate((lead, step))
    mixed = weight * (place * np.uint64(2) + np.uint64(0xD6E8FEB86659FD93))
    mixed[space] = 0
    word = np.add.reduceat(mixed, starts)
    same = np.zeros(len(word), bool)
    row = np.searchsorted(offsets, starts, "right")
    same[1:] = (word[1:] == word[:-1]) & (size[1:] == size[:-1]) & (row[1:] == row[:-1])
    shape = np.minimum(np.log2(size + 1).astype(np.uint32), 7)
    shape |= (symbols > 0).astype(np.uint32) << 3
    shape |= ((upper > 1) & (2 * upper > size)).astype(np.uint32) << 4
    shape |= (2 * symbols > size).astype(np.uint32) << 5
    shape |= (digits > 0).astype(np.uint32) << 6
    shape |= same.astype(np.uint32) << 7
    return starts, shape


def grams(data: np.ndarray, offsets: np.ndarray, shapes: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram of a text column; none crosses from one row to the next."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    b = byte_grams(data)
    row = np.repeat(np.arange(rows, dtype=np.int32), sizes)
    keep = row[: len(b)] == row[3:] if len(b) else np.zeros(0, bool)
    bucket, of = b[keep], row[: len(b)][keep]
    if shapes and len(data):
        starts, shape = word_shapes(data, offsets)
        if len(starts) > 2:
            h = shape[:-2] * np.uint32(0x85EBCA6B) + shape[1:-1] * np.uint32(0xC2B2AE35) + shape[2:] * np.uint32(0x27D4EB2F) + np.uint32(0x5BD1E995)
            w = row[starts]
            same = w[:-2] == w[2:]
            bucket, of = np.concatenate((bucket, _mix(h)[same])), np.concatenate((of, w[:-2][same]))
    return bucket, of


def multinomials(docs: DataFrame, target: DataFrame, text: str, key: str, shapes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over the target rows (those of the doc_ids of ``target``) and over all rows.

    Every row of ``docs`` and every target row is counted. A task sends at most one row per bucket; the driver gets BUCKETS rows.
    """
    from .common import among, let_go, slices, text_buffer

    def run(batches):
        let_go()
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for i, j in slices(b.column(1)):
                data, offsets = text_buffer(b.column(1).slice(i, j - i))
                counts += np.bincount(grams(data, offsets, shapes)[0], minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["bucket", "n"])

    counted = lambda rows: rows.mapInArrow(run, "bucket int, n long")
    none = F.lit(0).cast("long")
    every = counted(docs.select(docs[key].cast("long"), docs[text])).select("bucket", none.alias("own"), F.col("n").alias("raw"))
    counts = every.unionByName(counted(among(docs, target, text, key)).select("bucket", F.col("n").alias("own"), none.alias("raw")))
    own, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("own"), F.sum("raw")).collect():
        own[r[0]], raw[r[0]] = r[1], r[2]
    return own, raw


def log_ratio(own: np.ndarray, raw: np.ndarray, alpha: float) -> np.ndarray:
    """Fixed-point log(p_target / p_raw) per bucket with add-alpha smoothing; zeros where there is no target."""
    if not own.sum():
        return np.zeros(BUCKETS, np.int64)
    p = np.log((own + alpha) / (own.sum() + alpha * BUCKETS)) - np.log((raw + alpha) / (raw.sum() + alpha * BUCKETS))
    return np.rint(p * SCALE).astype(np.int64)


def sums(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, shapes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Exact integer sum of the weights and number of n-grams, per row."""
    bucket, row = grams(data, offsets, shapes)
    rows = len(offsets) - 1
    n = np.bincount(row, minlength=rows)
    w = weights[bucket]
    # bincount adds doubles: exact below 2**53
    return np.bincount(row, weights=w, minlength=rows).astype(np.int64), n


def mean(total: int, n: int) -> float:
    return total / n / SCALE if n else 0.0


def gumbel(uniform: float) -> float:
    return -math.log(-math.log(uniform))
