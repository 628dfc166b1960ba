"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Texts become token pieces of at most LIMIT; only longer documents are cut. All pieces are packed together. What
best-fit decreasing does depends on the lengths alone, so it runs on the driver over the exact counts by length (LIMIT
rows at most): equal lengths are dealt in one step to bins of equal capacity, and bins of one history are kept as
runs of numbers. The outcome is that of one piece at a time. The plan, whose size depends on LIMIT and not on the
number of pieces, says where the pieces of a length go by their rank among them; ranks come from the pieces' place
in their task and the tasks' running counts.

A null text counts as empty and is the single end id; repeated rows are packed as often as they stand; pieces of one
length are interchangeable, and their order is that of the written pieces; an empty table gives an empty one; a very
long text is tokenised whole and cut; other columns aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SLICE, codec, default_path
from .common import slices, with_columns, written

LIMIT = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
PACKED = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


class Capacities:
    """Runs of open bins by remaining capacity, under a segment tree that counts them by range of capacity."""

    def __init__(self, limit: int):
        self.leaves = 1 << limit.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]

    def add(self, capacity: int, first: int, bins: int) -> None:
        if not capacity or not bins:
            return
        self.runs[capacity].append((first, bins))
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int, int] | None:
        """Remove and return (capacity, first bin, number of bins) of the tightest run with at least ``need``."""
        count, leaves = self.count, self.leaves
        node = need + leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - leaves
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, *self.runs[capacity].pop()


def best_fit(counts: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """The plan, rows (length, first rank, first bin, pieces to a bin, offset), from the number of pieces by length.

    Piece ``first + i`` of a length goes to bin ``bin + i // each`` at ``offset + i % each * length``.
    """
    open_, plan, opened = Capacities(limit), [], 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= limit:
            raise ValueError(f"a piece of {length} in sequences of {limit}")
        rank, left = 0, counts[length]
        while left:
            found = open_.take(length)
            if not found:
                found = limit, opened, -(-left // (limit // length))
                opened += found[2]
            capacity, first, bins = found
            each = capacity // length  # a bin is the tightest one until it is full
            full = min(bins, left // each)
            rest = 0 if full == bins else left % each
            plan.append((length, rank, first, each, limit - capacity))
            open_.add(capacity - each * length, first, full)
            if full < bins:
                open_.add(capacity - rest * length, first + full, 1)
                open_.add(capacity, first + full + 1, bins - full - 1)
            rank, left = rank + full * each + rest, left - full * each - rest
    return np.asarray(plan, np.int64).reshape(-1, 5)


def placed(plan: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of pieces by length and rank."""
    if not len(lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = lambda length, rank: (length << 48) + rank
    order = np.argsort(key(plan[:, 0], plan[:, 1]))
    row = plan[order[np.searchsorted(key(plan[:, 0], plan[:, 1])[order], key(lengths, ranks), "right") - 1]]
    nth, at = np.divmod(ranks - row[:, 1], row[:, 3])
    return row[:, 2] + nth, row[:, 4] + at * lengths


def pieces(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document; ``with_ids`` adds the token ids themselves.

    ``task`` and ``place`` number the pieces of each length: by task, and in the task. They hold for one run, so the
    table has to be written before it is read twice.
    """
    path = path or default_path("word_bpe_49k.json")
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches):
        c, task, seen = codec(path), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for b in batches:
            for i, j in slices(b.column(1), SLICE):
                ids, at = c.ids_of(b.column(1).slice(i, j - i))
                rows, own = [], []
                for doc, first, last in zip(b.column(0).slice(i, j - i).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    raw = ids[first:last].tobytes() + END_ID.to_bytes(4, "little")
                    for piece, start in enumerate(range(0, len(raw), 4 * limit)):
                        part = raw[start : start + 4 * limit]
                        rows.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part), task, int(seen[len(part) // 4])))
                        seen[len(part) // 4] += 1
                        if with_ids:
                            own.append(np.frombuffer(part, "<u4").astype(np.int32))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(own, pa.list_(pa.int32()))] if with_ids else arrays, [*names, "ids"] if with_ids else names)

    return df.select(df[key].cast("long"), df[text]).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def pack(parts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Sequence and offset of every row of a written table of pieces, in place of task and place."""
    counts = parts.groupBy("length", "task").agg(F.count("*").alias("n"))
    plan = best_fit({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, limit)
    sent = parts.sparkSession.sparkContext.broadcast(plan)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = parts.join(firsts, ["length", "task"]).withColumn("rank", F.col("before") + F.col("place")).drop("task", "place", "before")
    length, rank = (ranked.columns.index(c) for c in ("length", "rank"))

    def run(batches):
        for b in batches:
            bins, offsets = placed(sent.value, *(np.asarray(b.column(i), np.int64) for i in (length, rank)))
            yield with_columns(b, [("sequence_id", pa.array(bins)), ("offset", pa.array(offsets))])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)
    return ranked.mapInArrow(run, f"{shape}, sequence_id long, offset long").select(*PACKED, *[c for c in parts.columns if c == "ids"])


def pack_documents(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    return pack(written(pieces(df, path, text, key, limit), "pieces"), limit)


def sequences(df: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The packed token ids: sequence_id and ids, pieces joined in order of offset."""
    packed = pack(written(pieces(df, path, limit=limit, with_ids=True), "pieces"), limit)
    rows = packed.select("sequence_id", F.struct("offset", "ids").alias("part"))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["ids"])).alias("ids"))
