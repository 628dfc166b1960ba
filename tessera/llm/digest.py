"""Mergeable quantile summaries: a tie-aware merging digest.

A summary is a row for each point, in order: the least and the greatest value of a centroid (``low``, ``high``; equal
for an atom), and what it adds to two bounds. The sum of ``least`` up to a point is at most, that of ``most`` at least,
the number of rows not above its ``high``, and the same two sums bound the rows below the ``low`` of the next point.

* Merging is rank-bounded: every point lays its ``least`` at its high end and its ``most`` at its low end, and the sums
  over all summaries, value by value, are the bounds of the whole. Nothing else is assumed of a centroid.
* A run of up to EXACT values stays as it is, every value an atom. Beyond, neighbours are joined into centroids of at most
  n * CAP rows; a value that surely holds half of that is heavy and stays an exact atom; a centroid is split where the
  interval between its bounds would exceed BUDGET caps; and none takes more than a 256th of the values, so that
  light values beside heavy ones are kept apart. LIMIT points are the most.
* An answer is snapped to an end of a centroid, which is a value of the data, the one of the least possible error.

Each merge adds a cap to the error at most. Rows are counted by value before anything is sorted; each task summarises what it
holds of a group, and at most FAN summaries meet in one merge, in as many levels as the tasks need. So no task gets more of
a group than its share of distinct values or FAN summaries, and the driver gets nothing but the number of partitions.

Null and NaN values and rows without a batch are left out; a null in another key makes a group of its own; repeated rows count
as often as they stand; equal values are one atom or in one centroid; an empty table gives no summary. Other columns
aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of_id, table, written

EXACT, LIMIT, FAN, PARTS = 1000, 1900, 256, 256
CAP, BUDGET = 1 / 400, 2
BITS = 14  # exact ranks: at most 2 ** BITS values of a group meet in one sort


def _changes(col: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the row before; nulls are equal."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    differ = np.asarray(pc.fill_null(pc.not_equal(a, b), False), bool)
    return differ | (np.asarray(pc.is_null(a), bool) != np.asarray(pc.is_null(b), bool))


def starts_of(rows: pa.Table | pa.RecordBatch, keys: int) -> np.ndarray:
    """Where the runs of equal first ``keys`` columns start."""
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in range(keys):
        new[1:] |= _changes(rows.column(k))
    return np.flatnonzero(new)


def whole_runs(batches, keys: int):
    """Sorted batches, put together so that each has whole runs of equal keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cut = int(starts_of(b, keys)[-1])
        if held and not cut:  # the run may have begun before
            before = held[-1].slice(held[-1].num_rows - 1)
            if len(starts_of(pa.concat_batches([before, b.slice(0, 1)]), keys)) == 1:
                held.append(b)
                continue
        if held or cut:
            yield pa.concat_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.concat_batches(held)


def centroids(at: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Where the centroids start that hold distinct values with bounds ``least`` and ``most`` each."""
    a, b = np.concatenate([[0], np.cumsum(least)]), np.concatenate([[0], np.cumsum(most)])
    mid, cap, most_values = (a + b) / 2, a[-1] * CAP, -(-len(at) // PARTS)
    while True:
        heavy = np.append(np.flatnonzero(a[1:] - b[:-1] > cap / 2), len(at))
        ends = np.minimum(np.searchsorted(mid, mid + cap, "right"), np.searchsorted(b, a + BUDGET * cap, "right")) - 1
        ends = np.minimum(ends[:-1], np.arange(len(at)) + most_values)
        nearest = heavy[np.searchsorted(heavy, np.arange(len(at)))]
        ends = np.where(nearest == np.arange(len(at)), 0, np.minimum(ends, nearest))
        ends = np.maximum(ends, np.arange(1, len(at) + 1)).tolist()
        out, i = [], 0
        while i < len(at):
            out.append(i)
            i = ends[i]
        if len(out) <= LIMIT:
            return np.asarray(out)
        cap *= 1.5


def _compressed(keys: int):
    """Rows of (keys, at, least, most), sorted, become points (keys, low, high, least, most, n)."""

    def run(batches):
        for b in whole_runs(batches, keys):
            at, least, most = (np.asarray(b.column(keys + i)) for i in range(3))
            runs = starts_of(b, keys)
            new = np.zeros(len(at), bool)
            new[runs] = True
            new[1:] |= at[1:] != at[:-1]
            first = np.flatnonzero(new)  # values, each once
            least, most, at = np.add.reduceat(least, first), np.add.reduceat(most, first), at[first]
            runs = np.searchsorted(first, runs)
            sizes = np.diff(np.append(runs, len(at)))
            total = np.repeat(np.add.reduceat(least, runs), sizes)
            keep = np.ones(len(at), bool)
            for i in np.flatnonzero(sizes > EXACT):
                own = slice(runs[i], runs[i] + sizes[i])
                keep[own] = False
                keep[runs[i] + centroids(at[own], least[own], most[own])] = True
            chosen = np.flatnonzero(keep)
            high = at[np.append(chosen[1:], len(at)) - 1]
            points = [at[chosen], high, np.add.reduceat(least, chosen), np.add.reduceat(most, chosen), total[chosen]]
            rows = b.take(pa.array(first[chosen]))
            yield pa.RecordBatch.from_arrays([*rows.columns[:keys], *map(pa.array, points)], [*b.schema.names[:keys], "low", "high", "least", "most", "n"])

    return run


def _fields(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _points(rows: DataFrame, keys: list[str]) -> DataFrame:
    ordered = rows.select(*keys, "at", "least", "most").sortWithinPartitions(*keys, "at")
    return ordered.mapInArrow(_compressed(len(keys)), _fields(rows, keys) + "low double, high double, least long, most long, n long")


def merged(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """The summaries of each group of ``keys`` as one: FAN at most, as the callers see to."""
    same, none = F.col("low") == F.col("high"), F.lit(0).cast("long")
    ends = F.when(same, F.array(F.struct(F.col("low").alias("at"), "least", "most"))).otherwise(
        F.array(F.struct(F.col("low").alias("at"), none.alias("least"), "most"), F.struct(F.col("high").alias("at"), "least", none.alias("most")))
    )
    return _points(summaries.select(*keys, F.inline(ends)).repartition(*keys), keys)


def summarised(counts: DataFrame, keys: list[str], x: str = "x", count: str = "c") -> DataFrame:
    """A summary of every group of ``keys``, from rows of distinct (keys, x) with their counts."""
    own = F.col(count).cast("long")
    rows = counts.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(*keys, F.col(x).cast("double").alias("at"), own.alias("least"), own.alias("most"))
    parts = rows.rdd.getNumPartitions()
    leaves = _points(rows, keys).withColumn("part", F.spark_partition_id())
    while parts > FAN:
        leaves = merged(leaves.withColumn("part", F.floor(F.col("part") / FAN).cast("int")), [*keys, "part"])
        parts = -(-parts // FAN)
    return merged(leaves, keys)


def answer(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """For each target rank, the end of a centroid whose rank is surely nearest; in order of the targets."""
    a, b = np.cumsum(least), np.cumsum(most)
    before_a, before_b, atom = a - least, b - most, low == high
    over = np.stack([np.minimum(before_b + 1, b), np.where(atom, np.minimum(before_b + 1, b), b)], 1).ravel()
    upto = np.stack([np.where(atom, np.maximum(a, before_a + 1), before_a + 1), np.maximum(a, before_a + 1)], 1).ravel()
    worst = np.maximum(over[None, :] - targets[:, None], targets[:, None] - upto[None, :])
    return np.stack([low, high], 1).ravel()[np.maximum.accumulate(worst.argmin(1))]


def quantiles(summaries: DataFrame, keys: list[str], of: int, least_rows: int = 1) -> DataFrame:
    """keys, i (1 to of - 1), n, target (ceil(i * n / of)), points and answer of every summary of ``least_rows`` rows or more."""

    def run(batches):
        k = len(keys)
        for b in whole_runs(batches, k):
            runs = starts_of(b, k)
            ends = np.append(runs[1:], b.num_rows)
            low, high, least, most, n = (np.asarray(b.column(k + i)) for i in range(5))
            i = np.arange(1, of)
            targets = (i[None, :] * n[runs][:, None] + of - 1) // of
            found = [answer(low[s:e], high[s:e], least[s:e], most[s:e], t) for s, e, t in zip(runs, ends, targets)]
            rows = b.take(pa.array(np.repeat(runs, of - 1)))
            out = [np.tile(i, len(runs)).astype(np.int32), np.repeat(n[runs], of - 1), targets.ravel(), np.repeat(ends - runs, of - 1), np.concatenate(found)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:k], *map(pa.array, out)], [*b.schema.names[:k], "i", "n", "target", "points", "answer"])

    rows = summaries.where(F.col("n") >= least_rows).select(*keys, "low", "high", "least", "most", "n").repartition(*keys).sortWithinPartitions(*keys, "low")
    return rows.mapInArrow(run, _fields(summaries, keys) + "i int, n long, target long, points long, answer double")


def ranks(counts: DataFrame, keys: list[str], least_rows: int) -> DataFrame:
    """keys, x (long), c, below (rows of the group with a smaller x), n, of groups of ``least_rows`` rows or more.

    Counted by slices of 2 ** BITS values, slices of slices and so on, until a group has 2 ** BITS slices at most; the sums
    come down again by plain joins on group and slice. No group is sorted whole.
    """
    ends = counts.agg(F.min("x"), F.max("x")).first()
    low, high = (v or 0 for v in ends)
    levels = [counts.select(*keys, "x", "c")]
    while (high >> BITS * (len(levels) - 1)) - (low >> BITS * (len(levels) - 1)) >= 1 << BITS:
        levels.append(levels[-1].groupBy(*keys, F.shiftright("x", BITS).alias("x")).agg(F.sum("c").alias("c")))
    by = Window.partitionBy(*keys)
    top = levels.pop()
    out = top.withColumns({"n": F.sum("c").over(by), "below": F.sum("c").over(by.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")}).where(F.col("n") >= least_rows)
    while levels:
        rows, slices = levels.pop().withColumn("slice", F.shiftright("x", BITS)), out.select(*keys, F.col("x").alias("slice"), F.col("below").alias("before"), "n")
        on = rows.alias("r").join(slices.hint("merge"), [*keys, "slice"])
        within = Window.partitionBy(*keys, "slice").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        out = on.withColumn("below", F.col("before") + F.sum("c").over(within) - F.col("c")).drop("slice", "before")
    return out.select(*keys, "x", "c", "below", "n")


def streams(clicks: DataFrame, lines: DataFrame, items: DataFrame, batches: int = 16) -> DataFrame:
    """(stream, grp, batch, x, c): the two streams of the shop, counted by value. Rows without an id have no batch and are left out."""
    # rows of one click_id repeat one another; if they don't, the least client and the least value count
    once = clicks.where("click_id is not null").groupBy("click_id").agg(F.min("client_id").alias("client_id"), F.min("value").alias("value"))
    value = once.select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), F.col("click_id").alias("id"), F.col("value").alias("money"), F.lit(1).cast("long").alias("k"))
    # lines are counted by item and vendor first, so that a hot item is a few rows when it meets its price
    sold = lines.where("item_id is not null and vendor_id is not null").groupBy("item_id", "vendor_id").agg(F.count("*").alias("k"))
    priced = sold.join(items.select("item_id", "brand", "price").hint("merge"), "item_id")
    price = priced.select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), F.col("vendor_id").alias("id"), F.col("price").alias("money"), "k")
    rows = value.unionByName(price).where("grp is not null and money is not null and not isnan(money)")
    batch = (crc32_of_id(F.col("id")) % batches).cast("int")
    x = F.floor(100 * F.col("money") + 0.5).cast("long") + 1000 * batch
    return rows.select("stream", "grp", batch.alias("batch"), x.alias("x"), "k").groupBy("grp", "batch", "stream", "x").agg(F.sum("k").alias("c"))


def quantile_report(clicks: DataFrame, lines: DataFrame, items: DataFrame, of: int = 20, least_rows: int = 20) -> DataFrame:
    """Summaries of every batch, merged into the whole (batch -1), their answers, and the exact ranks of these."""
    keys = ["grp", "batch", "stream"]  # what tells rows apart first: sorts compare it first
    counts = written(streams(clicks, lines, items), "counts")
    parts = written(summarised(counts, keys), "summaries")
    whole = merged(parts, ["grp", "stream"]).withColumn("batch", F.lit(-1))
    answers = quantiles(parts, keys, of, least_rows).unionByName(quantiles(whole.select(*parts.columns), keys, of, least_rows))
    answers = answers.withColumn("answer", F.col("answer").cast("long")).drop("n", "target")

    every = counts.groupBy("grp", "stream", "x").agg(F.sum("c").alias("c")).withColumn("batch", F.lit(-1))
    exact = written(ranks(counts.unionByName(every), keys, least_rows), "ranks")
    i = F.explode(F.filter(F.sequence(F.lit(1), F.lit(of - 1)), lambda i: (F.ceil(i * F.col("n") / of) > F.col("below")) & (F.ceil(i * F.col("n") / of) <= F.col("below") + F.col("c"))))
    true = exact.select(*keys, "n", F.col("x").alias("exact_x"), i.alias("i")).withColumn("target", F.ceil(F.col("i") * F.col("n") / of))
    placed = answers.join(exact.select(*keys, F.col("x").alias("answer"), F.col("below").alias("n_below"), (F.col("below") + F.col("c")).alias("n_upto")).hint("merge"), [*keys, "answer"], "left")
    out = true.join(placed.hint("merge"), [*keys, "i"], "left")
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    out = out.withColumn("rank_error", error).withColumn("within", 1000 * F.col("rank_error") <= 10 * F.col("n"))
    return out.select("stream", "grp", "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within")


def shop_quantiles(spark, sf_dir: str) -> DataFrame:
    return quantile_report(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items"))
