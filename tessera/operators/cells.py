"""Exact cosine neighbours from a stored index of cells: what the triangle inequality rules out is not read.

Vectors of length 1 lie in cells around centroids, and in a cell in shells by their distance from its centroid. A query
is at a known distance from the centroid, so that a shell's vectors are at least the difference away; shells that are
farther than the k-th neighbour found so far can't hold a nearer one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vectors as V

from .nearest import grouped
from .ranking import QUERY, ranked

FIT = 100_000  # vectors that centroids are fitted on, at most about; every vector is stored
CELLS = 64  # cells at most
WIDTH = 0.05  # of a shell, in distance; two vectors of length 1 are at most 2 apart
SIZE = 4096  # vectors of a unit, about; fuller shells are cut by a hash of the id
SLACK = 1e-7  # by which distances may be off
BLOCK = 2048  # queries that meet a unit in one group, about
NOWHERE = -1  # the cell of vectors without a length, which every query scores 0


@dataclass
class Cells:
    """vectors (id, embedding, unit), units (unit, cell, low, high, n) and the centroids by cell."""

    vectors: DataFrame
    units: DataFrame
    centroids: dict[int, list[float]]


def _nearest(centroids: np.ndarray):
    """struct(cell, distance) of unit vectors; a matrix product, for which there is no function in the engine."""

    @F.pandas_udf("cell int, distance double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, centroids.shape[1]))
            cell = np.argmax(x @ centroids.T - (centroids**2).sum(1) / 2, axis=1) if len(x) else np.zeros(0, int)
            yield pd.DataFrame({"cell": cell.astype("int32"), "distance": np.sqrt(((x - centroids[cell]) ** 2).sum(1))})

    return nearest


def write(vectors: DataFrame, path: str, cells: int = CELLS, files: int = 64, fit: int = FIT, seed: int = 1) -> None:
    """The index of (id, embedding) under ``path``. Null embeddings are left out; repeated ids are rows of their own."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding", V.norm(F.col("embedding")).alias("norm"))
    long = rows.where("norm > 0").select("id", "embedding", V.unit(F.col("embedding")).alias("at"))
    n = long.count()
    centres = np.zeros((0, 0))
    if n:
        some = long.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n // fit))) == 0) if n > fit else long
        model = KMeans(k=cells, seed=seed, maxIter=10).fit(some.select(array_to_vector("at").alias("features")))
        centres = np.array([c for c in model.clusterCenters()])
    listed = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(listed, "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    placed = rows.where("norm = 0").select("id", "embedding", F.lit(NOWHERE).alias("cell"), F.lit(0.0).alias("distance"))
    if n:
        placed = placed.unionByName(long.withColumn("near", _nearest(centres)("at")).select("id", "embedding", "near.cell", "near.distance"))
    placed = placed.withColumn("shell", F.floor(F.col("distance") / WIDTH))
    placed.write.mode("overwrite").parquet(f"{path}/placed")  # assigned once
    placed = spark.read.schema(placed.schema).parquet(f"{path}/placed")
    slices = placed.groupBy("cell", "shell").agg(F.ceil(F.count("*") / SIZE).alias("slices"))  # cells by 41 shells at most
    unit = F.col("cell").cast("long") * 2**40 + F.col("shell") * 2**32 + F.pmod(F.xxhash64("id"), "slices")
    kept = placed.join(F.broadcast(slices), ["cell", "shell"]).select("id", "embedding", "cell", "distance", unit.alias("unit"))
    kept.repartitionByRange(files, "unit").sortWithinPartitions("unit").write.mode("overwrite").parquet(f"{path}/vectors")
    held = spark.read.schema(kept.schema).parquet(f"{path}/vectors")
    held.groupBy("unit", "cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/units")


def read(spark: SparkSession, path: str) -> Cells:
    """The index that ``write`` wrote."""
    centroids = {r["cell"]: list(r["centroid"]) for r in spark.read.schema("cell int, centroid array<double>").parquet(f"{path}/centroids").collect()}  # CELLS rows
    return Cells(spark.read.parquet(f"{path}/vectors"), spark.read.schema("unit long, cell int, low double, high double, n long").parquet(f"{path}/units"), centroids)


def _apart(index: Cells, queries: DataFrame) -> DataFrame:
    """(query_id, unit, n, least): the least distance at which a unit may hold a vector. Queries without a length are near everything."""
    cells = queries.sparkSession.createDataFrame([(c, v) for c, v in index.centroids.items()] + [(NOWHERE, None)], "cell int, centroid array<double>")
    asked = queries.select(QUERY, V.unit(F.col("query")).alias("at"), (V.norm(F.col("query")) > 0).alias("long"))
    to = asked.crossJoin(F.broadcast(cells)).select(QUERY, "cell", "long", V.l2(F.col("at"), F.col("centroid")).alias("to"))  # CELLS rows at most
    least = F.greatest(F.col("to") - F.col("high"), F.col("low") - F.col("to"), F.lit(0.0))
    # a vector without a length scores 0, as one at a right angle does
    bound = F.when(~F.col("long"), 0.0).when(F.col("cell") == NOWHERE, F.lit(2.0**0.5)).otherwise(least)
    return to.join(index.units, "cell").select(QUERY, "unit", "n", bound.alias("least"))


def _scored(index: Cells, asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the k best in the units that are asked (query_id, unit) of each query."""
    sizes = asked.groupBy("unit").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64(QUERY), F.col("blocks")).alias("block")
    blocks = asked.join(sizes, "unit").join(queries.select(QUERY, "query"), QUERY).select(QUERY, "query", "unit", block)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    vectors = index.vectors.select("id", "embedding", "unit").join(sizes, "unit").select("id", "embedding", "unit", every)
    return ranked(grouped(vectors, blocks, ["unit", "block"], k), k)


def pairs_left(index: Cells, queries: DataFrame, k: int, keep=lambda df: df) -> DataFrame:
    """(query_id, unit, n): the units that the k nearest of a query may be in.

    The nearest units that hold k vectors are searched first, which gives a k-th score; units that are farther go.
    ``keep`` may store the distances, which are read twice.
    """
    apart = keep(_apart(index, queries))
    before = F.sum("n").over(Window.partitionBy(QUERY).orderBy("least", "unit").rowsBetween(Window.unboundedPreceding, -1))
    ahead = apart.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k)
    kth = _scored(index, ahead, queries, k).where(F.col("rank") == k).select(QUERY, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("reach"))
    return apart.join(kth, QUERY, "left").where(F.col("reach").isNull() | (F.col("least") <= F.col("reach") + SLACK)).select(QUERY, "unit", "n")


def nearest(index: Cells, queries: DataFrame, k: int, keep=lambda df: df) -> DataFrame:
    """(query_id, id, score, rank): what ``ranking.knn_batch`` gives, from the units that may hold it."""
    return _scored(index, pairs_left(index, queries, k, keep), queries, k)


def share(index: Cells, queries: DataFrame, k: int) -> DataFrame:
    """The share of all pairs of queries and vectors that is compared, for reports."""
    left = pairs_left(index, queries, k).agg(F.sum("n").alias("left"))
    every = index.units.agg(F.sum("n").alias("vectors")).crossJoin(queries.agg(F.count("*").alias("queries")))
    return left.crossJoin(every).select((F.col("left") / (F.col("vectors") * F.col("queries"))).alias("share"))
