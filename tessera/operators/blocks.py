"""A stored keyword index in blocks: terms in order, files of known ranges of terms, and the best impact of every block.

A row holds the postings of one term in one block of items, some thousands at most, and the most that any of them can
give to a score. Blocks are of items of like length, so that short items, which score most, stand together. The best k
of a query are found in the blocks whose maxima reach the k-th score; a prefix is a range of terms, and its files alone are opened.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add, and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyword import B, FLOOR, K1, _matches

SIZE = 4096  # items of a block, about
SORTED = 4_000_000  # postings that a task puts in order, about
LONGEST = 16  # letters of the prefixes that are counted when the index is written; longer ones are counted when they are asked
AHEAD = 8, 128  # blocks that are scored first, for the k-th score: so few that a scan takes them by name, and more if these lack k items
ITEM, POSTING, PREFIX = range(3)  # KINDS of the rows that a text gives
SLACK = 1 + 1e-9  # bounds and scores are summed in another order


@dataclass
class Blocks:
    """postings (term, block, n, top, items, range), ranges (range, first, last), prefixes (start, n), and the statistics of the corpus."""

    postings: DataFrame
    ranges: DataFrame
    prefixes: DataFrame
    n_docs: int
    avgdl: float

    def flat(self) -> DataFrame:
        """(term, id, tf, dl), as ``keyword.postings`` gives them."""
        return self.postings.select("term", F.inline("items"))


def _impact(tf, dl, avgdl):
    """Of columns, or of arrays in a task."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _counted(batches):
    """Rows of KINDS from (id, dl, tokens): every item, its distinct tokens with their numbers, and how many items of the batch hold a prefix."""
    for b in batches:
        n, lists = b.num_rows, b.column(2)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        held = coded.indices.is_valid().to_numpy(zero_copy_only=False)
        codes = coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[held]
        found, tf = _distinct(np.repeat(np.arange(n), sizes)[held], codes, len(coded.dictionary))
        row, codes = found
        of = pa.array(row)
        yield _rows(b.schema, ITEM, b.column(0), b.column(1), None, None)
        yield _rows(b.schema, POSTING, b.column(0).take(of), b.column(1).take(of), coded.dictionary.take(pa.array(codes)), pa.array(tf))
        lengths = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
        for size in range(4, LONGEST + 1):
            long = lengths[codes] >= size
            if not long.any():
                break
            row, codes = row[long], codes[long]
            starts = pc.utf8_slice_codeunits(coded.dictionary, 0, size).dictionary_encode()
            (_, of), _ = _distinct(row, starts.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], len(starts.dictionary))
            counts = np.bincount(of, minlength=len(starts.dictionary))
            at = np.flatnonzero(counts)
            yield _rows(b.schema, PREFIX, None, None, starts.dictionary.take(pa.array(at)), pa.array(counts[at]))


def _distinct(row: np.ndarray, code: np.ndarray, codes: int):
    """The distinct pairs of a row and a code, in order, and how often each stands."""
    pairs = np.sort(row * max(1, codes) + code)
    at = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
    return np.divmod(pairs[at], max(1, codes)), np.diff(np.append(at, len(pairs)))


def _rows(schema, kind: int, *columns) -> pa.RecordBatch:
    n = next(len(c) for c in columns if c is not None)
    kinds = schema.field(0).type, pa.int64(), pa.string(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.nulls(n, k) if c is None else c.cast(k) for c, k in zip(columns, kinds))], ["kind", "id", "dl", "term", "tf"])


def _gathered(avgdl: float):
    """(term, block, n, top, items) from postings in order of term and block; only the last block of a batch waits for the next."""

    def rows(b, starts):
        tf, dl = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        items = pa.StructArray.from_arrays([b.column(2), b.column(3), b.column(4)], ["id", "tf", "dl"])
        top = np.maximum.reduceat(_impact(tf, dl, avgdl), starts)
        ends = np.append(starts, b.num_rows)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items)
        at = pa.array(starts)
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.diff(ends), pa.int64()), pa.array(top), lists], ["term", "block", "n", "top", "items"])

    def run(batches):
        rest = None
        for b in batches:
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            if not b.num_rows:
                continue
            new = [pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False) for c in (b.column(0), b.column(1))]
            starts = np.append(0, np.flatnonzero(new[0] | new[1]) + 1)
            if len(starts) > 1:
                yield rows(b.slice(0, starts[-1]), starts[:-1])
            rest = b.slice(starts[-1])
        if rest is not None:
            yield rows(rest.take(pa.array(np.arange(rest.num_rows))), np.zeros(1, np.int64))

    return run


def write(tokens: DataFrame, path: str, files: int = 64, size: int = SIZE) -> None:
    """The index of (id, tokens) under ``path``. Ids are unique; repeated ones are refused. Items without a token are counted and hold nothing.

    Texts are tokenised once: ``path``/words has what they give while the index is written.
    """
    spark = tokens.sparkSession
    kind = tokens.schema["id"].dataType.simpleString()
    given = tokens.select("id", F.size("tokens").cast("long").alias("dl"), "tokens").mapInArrow(_counted, f"kind int, id {kind}, dl long, term string, tf long")
    given.write.mode("overwrite").parquet(f"{path}/words")
    of = lambda k: spark.read.schema(given.schema).parquet(f"{path}/words").where(F.col("kind") == k)
    if of(ITEM).groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("ids repeat")
    of(ITEM).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")
    tasks = -(-of(POSTING).count() // (files * SORTED)) or 1  # of a range
    average = spark.read.parquet(f"{path}/stats").first()["avgdl"]
    level = F.floor(4 * F.log2("dl")).alias("level")
    levels = of(ITEM).where("dl > 0").groupBy(level).agg(F.ceil(F.count("*") / size).alias("slices"))  # 125 rows at most: quarter powers of two
    block = F.col("level") * 2**32 + F.pmod(F.xxhash64("id"), "slices")
    per = of(POSTING).select("*", level).join(F.broadcast(levels), "level").select("term", block.alias("block"), "id", "tf", "dl")
    placed = per.repartitionByRange(files * tasks, "term", "block").sortWithinPartitions("term", "block")  # a block of a term is one task's
    blocks = placed.mapInArrow(_gathered(average), f"term string, block long, n long, top double, items array<struct<id: {kind}, tf: long, dl: long>>")
    ranged = blocks.withColumn("range", (F.spark_partition_id() / tasks).cast("int")).sortWithinPartitions("range", "term", "block")
    ranged.write.mode("overwrite").partitionBy("range").option("parquet.page.row.count.limit", 64).parquet(f"{path}/postings")
    spans = spark.read.schema(ranged.schema).parquet(f"{path}/postings").groupBy("range").agg(F.min("term").alias("first"), F.max("term").alias("last"))
    spans.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
    starts = of(PREFIX).groupBy(F.col("term").alias("start")).agg(F.sum("tf").alias("n"))
    starts.repartitionByRange(max(1, files // 8) * tasks, "start").sortWithinPartitions("start").write.mode("overwrite").parquet(f"{path}/prefixes")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/words")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, path: str) -> Blocks:
    """The index that ``write`` wrote."""
    stats = spark.read.parquet(f"{path}/stats").first()
    ranges = spark.read.parquet(f"{path}/ranges")
    if not ranges.limit(1).count():  # nothing was written, and a folder without files has no schema
        postings = spark.createDataFrame([], "term string, block long, n long, top double, items array<struct<id: long, tf: long, dl: long>>, range int")
    else:
        postings = spark.read.parquet(f"{path}/postings")
    return Blocks(postings, ranges, spark.read.parquet(f"{path}/prefixes"), stats["n_docs"], stats["avgdl"] or 0.0)


def rows_of(index: Blocks, terms: list[tuple[str, bool]]) -> DataFrame:
    """The rows of the index that hold terms of a query; files of other ranges are not opened.

    The numbers of the ranges come to the driver, which names the files of a scan in any case.
    """
    meets = [(F.col("last") >= t) & ((F.col("first") <= t) | (F.col("first").startswith(t) if prefix else F.lit(False))) for t, prefix in terms]
    ranges = [r["range"] for r in index.ranges.where(reduce(or_, meets)).select("range").collect()]
    return index.postings.where(F.col("range").isin(ranges)).where(reduce(or_, [_matches(*t) for t in terms]))


def _frequencies(index: Blocks, rows: DataFrame, terms: list[tuple[str, bool]]) -> list[int]:
    """The number of items that hold each term; one number for a term of the query."""
    one = lambda i, df, n: df.agg(F.lit(i).alias("q"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    found = []
    for i, (term, prefix) in enumerate(terms):
        if prefix and len(term) <= LONGEST:
            found.append(one(i, index.prefixes.where(F.col("start") == term), F.sum("n")))
        elif prefix:
            found.append(one(i, rows.where(_matches(term, prefix)).select(F.inline("items")).select("id").distinct(), F.count("*")))
        else:
            found.append(one(i, rows.where(_matches(term, prefix)), F.sum("n")))
    return [r["n"] for r in sorted(reduce(DataFrame.unionByName, found).collect(), key=lambda r: r["q"])]


def _scored(rows: DataFrame, terms: list[tuple[str, bool]], idf: list[float], avgdl: float) -> DataFrame:
    """(id, bm25) of the items that hold every term, by one grouping; terms are summed in the order of the query."""
    marks = [_matches(*t).alias(f"m{i}") for i, t in enumerate(terms)]
    flat = rows.select(*marks, F.inline("items"))
    per = flat.groupBy("id").agg(F.first("dl").alias("dl"), *[F.sum(F.when(F.col(f"m{i}"), F.col("tf"))).alias(f"f{i}") for i in range(len(terms))])
    held = per.where(reduce(and_, [F.col(f"f{i}").isNotNull() for i in range(len(terms))]))
    parts = [F.lit(w) * _impact(F.col(f"f{i}"), F.col("dl"), F.lit(avgdl)) for i, w in enumerate(idf)]
    return held.select("id", (-reduce(add, parts)).alias("bm25"))


def best(index: Blocks, terms: list[tuple[str, bool]], k: int) -> DataFrame:
    """(id, bm25) of the items that hold every term and score as the k-th best or more, ties with it included; less is better.

    A block's bound sums its terms' maxima (a prefix's is the sum over its terms, as an impact grows less than its
    frequency). A few blocks of the greatest bounds give a k-th score, and blocks that can't reach it are left out.
    """
    nothing = index.flat().select("id", F.lit(0.0).alias("bm25")).limit(0)
    if not terms or k < 1:
        return nothing
    rows = rows_of(index, terms)
    counts = _frequencies(index, rows, terms)
    if not all(counts):
        return nothing
    idf = [max(math.log((index.n_docs - n + 0.5) / (n + 0.5)), FLOOR) for n in counts]
    tops = rows.groupBy("block").agg(*[F.sum(F.when(_matches(*t), F.col("top"))).alias(f"t{i}") for i, t in enumerate(terms)])
    every = tops.where(reduce(and_, [F.col(f"t{i}").isNotNull() for i in range(len(terms))]))
    bounds = every.select("block", reduce(add, [w * F.least(F.col(f"t{i}"), F.lit(K1 + 1)) for i, w in enumerate(idf)]).alias("bound"))
    for some in AHEAD:
        ahead = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(some).collect()]
        first = _scored(rows.where(F.col("block").isin(ahead)), terms, idf, index.avgdl).orderBy("bm25").limit(k).collect()
        if len(first) == k or len(ahead) < some:
            break
    if len(first) < k:
        return _scored(rows, terms, idf, index.avgdl)
    least = -first[-1]["bm25"] / SLACK
    left = bounds.where(F.col("bound") * SLACK >= least)
    span = left.agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high")).first()
    if span["n"] <= AHEAD[0]:
        some = rows.where(F.col("block").isin([r["block"] for r in left.select("block").collect()]))
    else:
        some = rows.where(F.col("block").between(span["low"], span["high"])).join(left.select("block"), "block", "left_semi")
    return _scored(some, terms, idf, index.avgdl).where(F.col("bm25") <= -least)
