"""Quality classifier: importance resampling.

Weight of a document: the log ratio of two hashed n-gram generative models, one fitted on all target
rows, one on every raw row, of a passage of PASSAGE n-grams of its kind (the mean of the document's n-grams and PRIOR
more of weight 0, times PASSAGE), so that neither length nor a few n-grams decide. Rows are sampled without
replacement by Gumbel top-k: the k largest of weight + noise, the noise standard Gumbel and drawn from a hash of the
doc_id, so that rows are drawn with the odds their weights say. k is a parameter; where it isn't given it is the
number of rows whose weight is FLOOR or more, that is, whose passage is at most exp(-FLOOR) times likelier under the
raw model than under the target one. Which rows these k are is up to the draw.

Null and empty texts weigh 0; rows tied with the k-th key are all kept; repeated rows share their noise and so
their fate; null doc_ids share one noise; without target rows every weight is 0 and every row is kept; an empty table
gives an empty one; very long texts are read whole, one at a time; other columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams as G
from .common import let_go, slices, text_buffer, written

PASSAGE = 16
PRIOR = 32
FLOOR = -4.0  # nats
ALPHA = 1.0
UNITS = 1 << 20  # fixed-point units of a key
SEED = "tessera"
KEYS = "doc_id long, log_weight double, sample_key long"


def noise(doc_id: int | None, seed: str = SEED) -> float:
    h = int.from_bytes(hashlib.blake2b(f"{seed}:{doc_id}".encode(), digest_size=8).digest(), "little")
    return G.gumbel((h + 0.5) / 2**64)


def fit(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """Log ratio of target and raw model by bucket, from the target rows and all rows."""
    return G.log_ratio(*G.multinomials(docs, target, text, key, shapes=True), ALPHA)


def weights_and_keys(ids: pa.Array, texts: pa.Array, model: np.ndarray, seed: str = SEED) -> tuple[list[float], list[int]]:
    """The log weight and the fixed-point sampling key of every row of a batch."""
    weights: list[float] = []
    for i, j in slices(texts):
        total, n = G.sums(*text_buffer(texts.slice(i, j - i)), model, shapes=True)
        weights += (PASSAGE * total / (n + PRIOR) / G.SCALE).tolist()
    return weights, [round((w + noise(x, seed)) * UNITS) for w, x in zip(weights, ids.to_pylist())]


def keyed(docs: DataFrame, model, text: str = "text", key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """doc_id, log_weight and sample_key of every row; ``model`` is the broadcast of ``fit``."""

    def run(batches):
        let_go()
        for b in batches:
            weights, keys = weights_and_keys(b.column(0), b.column(1), model.value, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weights, pa.float64()), pa.array(keys, pa.int64())], [x.split()[0] for x in KEYS.split(", ")])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text]).mapInArrow(run, KEYS)


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 1 << 14) -> int | None:
    """The k-th largest value of a long column, exactly, by histograms of at most ``bins`` rows each."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return None
    left = k
    while low < high:
        width = (high - low) // bins + 1
        counts = rows.where(F.col(column).between(low, high)).groupBy(F.expr(f"({column} - {low}L) div {width}L").alias("bin")).count().collect()
        for b, n in sorted(((r[0], r[1]) for r in counts), reverse=True):
            if left <= n:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            left -= n
        else:
            return low
    return low


def _drawn(docs: DataFrame, labels: DataFrame, k: int | None, text: str, key: str, floor: float, seed: str):
    """The broadcast model, the written keys of all rows and the least key that is kept (None: no row is)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where("quality = 1").select("doc_id"), text, key))
    keys = written(keyed(docs, model, text, key, seed), "importance")
    if k is None:
        k = keys.where(F.col("log_weight") >= floor).count()
    return model, keys, kth_largest(keys, "sample_key", k)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, text: str = "text", key: str = "doc_id", floor: float = FLOOR, seed: str = SEED) -> DataFrame:
    """doc_id, log_weight, sample_key and kept of every row."""
    _, keys, cut = _drawn(docs, labels, k, text, key, floor, seed)
    return keys.withColumn("kept", F.col("sample_key") >= F.lit(cut) if cut is not None else F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, k: int | None = None, text: str = "text", key: str = "doc_id", floor: float = FLOOR, seed: str = SEED) -> DataFrame:
    """The sampled rows alone, with the columns of ``docs``; their keys are computed again, so that no text is written twice."""
    model, _, cut = _drawn(docs, labels, k, text, key, floor, seed)
    ids, texts = docs.columns.index(key), docs.columns.index(text)

    def run(batches):
        let_go()
        for b in batches:
            keys = weights_and_keys(b.column(ids), b.column(texts), model.value, seed)[1]
            yield b.filter(pa.array([cut is not None and x >= cut for x in keys], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
