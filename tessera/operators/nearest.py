"""The k best of groups of vectors against groups of queries, by matrix products in tasks of known size.

A product of unit vectors leaves the few pairs that can be among a query's k best, but for SLACK; these are scored as
``vectors.cosine`` scores them, in the same order of operations, so that scores and ties are those of the scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

QUERY = "query_id"
SLACK = 1e-9  # by which a product of unit vectors may be off
ROWS, ASKED = 4096, 512  # vectors and queries of one product
USUAL = 1e-100, 1e100  # lengths within which a product is near; others are always scored


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of equal length as rows of doubles."""
    n = len(lists)
    flat = pc.list_flatten(lists).combine_chunks() if n else pa.array([], pa.float64())
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)
    if n and (len(values) % n or pc.count_distinct(pc.list_value_length(lists)).as_py() != 1):
        raise ValueError("vectors of several lengths")
    return values.reshape(n, -1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The dot products of columns of ``a`` and ``b``, summed dimension by dimension as the engine sums them."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b):
        out += x * y
    return out


def _units(rows: np.ndarray, norm: np.ndarray) -> np.ndarray:
    near = (norm >= USUAL[0]) & (norm <= USUAL[1])
    out = rows / np.where(near, norm, 1.0)[:, None]
    out[~near & ~(norm == 0)] = np.nan
    return out


def best(vectors: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k best of each query; ties to the earlier vector, as vectors come in the order of their ids."""
    v, q = np.ascontiguousarray(vectors.T), np.ascontiguousarray(queries.T)
    with np.errstate(all="ignore"):
        v_norm, q_norm = np.sqrt(_dots(v, v)), np.sqrt(_dots(q, q))
        v_unit, q_unit = _units(vectors, v_norm), _units(queries, q_norm)
        found = []
        for a in range(0, len(queries), ASKED):
            asked = q_unit[a : a + ASKED]
            n = len(asked)
            least = np.full(n, -np.inf)
            at, to, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for b in range(0, len(vectors), ROWS):
                near = asked @ v_unit[b : b + ROWS].T
                if not b and near.shape[1] > k:
                    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
                i, j = np.nonzero(~(near < (least - SLACK)[:, None]))
                j += b
                size = v_norm[j] * q_norm[i + a]
                own = np.zeros(len(i))
                for x, y in zip(v, q):
                    own += x[j] * y[i + a]
                own = np.where(size > 0, own / np.where(size > 0, size, 1.0), np.where(np.isnan(size), own / size, 0.0))
                at, to, score = np.concatenate((at, i)), np.concatenate((to, j)), np.concatenate((score, own))
                order = np.lexsort((to, -np.where(np.isnan(score), np.inf, score), at))  # no number stands above all, as in the engine
                place = np.arange(len(order)) - np.searchsorted(at[order], at[order])
                order = order[place < k]
                at, to, score = at[order], to[order], score[order]
                full = np.flatnonzero(np.bincount(at, minlength=n) == k)
                last = np.searchsorted(at, full, "right") - 1
                least[full] = np.where(np.isnan(score[last]), np.inf, score[last])
            found.append((at + a, to, score))
    return tuple(np.concatenate([f[x] for f in found]) if found else np.zeros(0, int) for x in range(3))


def grouped(vectors: DataFrame, queries: DataFrame, by: list[str], k: int) -> DataFrame:
    """(query_id, id, score): the k best of every query (query_id, query) in each group of vectors (id, embedding) of the same ``by``.

    A group of either side is one task's at a time, so that callers cut both into groups of known size.
    """
    schema = T.StructType([T.StructField(QUERY, queries.schema[QUERY].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left, sort_keys=[("id", "ascending")], null_placement="at_start"))
        i, j, score = best(_matrix(left["embedding"]), _matrix(right["query"]), k) if len(left) and len(right) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({QUERY: right[QUERY].take(pa.array(i)), "id": left["id"].take(pa.array(j)), "score": pa.array(score, pa.float64())})

    a, b = vectors.select("id", "embedding", *by), queries.select(QUERY, "query", *by)
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(run, schema)
