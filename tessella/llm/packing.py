"""Operator 6, best-fit packing: minimum bin slack with a bitset subset-sum over the lengths that are left."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import chunks, durable, id_and_text
from tessella.llm._tokens import ids_of

END = 2
CAPACITY = 1024


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is the largest that is at most `room`, as {length: times}."""
    reach, layers, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        layers.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4, ... of the length, and the rest: every number of times up to `left`
            take = min(step, left)
            reach |= reach << (take * length) & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        times = 0
        while not before >> total & 1:  # as few of the shorter lengths as can be
            total, times = total - length, times + 1
        if times:
            used[length] = times
    return used


@dataclass(frozen=True)
class Pattern:
    """`bins` sequences with the same lengths inside, in the order in which they lie there."""

    inside: tuple[tuple[int, int], ...]  # (length, times), longest first
    bins: int


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Bins for `counts` {length: number}. Each bin gets the longest item left and then the fullest combination that fits beside it.

    Equal bins are made at once, as long as the lengths last, so the work depends on the capacity and not on the number of items."""
    left = {k: n for k, n in counts.items() if n > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("a length is outside 1..capacity")
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fullest(left, capacity - longest) if longest < capacity else {}
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        bins = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
        out.append(Pattern(tuple(sorted(used.items(), reverse=True)), bins))
    return out


def segments(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, times in a bin, offset in the bin, first bin): where the items of a length go by their rank."""
    ranks: dict[int, int] = {}
    out, first_bin = [], 0
    for p in patterns:
        offset = 0
        for length, times in p.inside:
            start = ranks.get(length, 0)
            ranks[length] = start + times * p.bins
            out.append((length, start, ranks[length], times, offset, first_bin))
            offset += length * times
        first_bin += p.bins
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = "byte_bpe_50k", with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' ids with the end id, cut into pieces of `capacity`, of which the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(vocabulary).ids
        for batch in chunks(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text), np.array([end], "<u4")).astype("<u4", copy=False)
                n = len(ids)
                first = n % capacity or capacity
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    raw = ids[start : first if piece == 0 else start + capacity].tobytes()
                    rows.append((doc, piece, start, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(cols if with_ids else cols[:5], names if with_ids else names[:5])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def packed(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian unsigned 32-bit).

    The driver sees one count for each length (at most `capacity`). A piece's rank among those of its length is its rank inside its
    task plus the tasks before, so no length gathers in one place. Null and empty texts are one end id; repeated rows are packed
    again; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    rows = durable(pieces(docs, capacity, with_ids=with_ids, id_col=id_col, text_col=text_col).withColumn("task", F.spark_partition_id()))
    by_task = durable(rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(segments(minimum_bin_slack(counts, capacity)), "length long, lo long, hi long, times long, at long, bin long")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "task").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("own", F.row_number().over(inside) - 1).join(before, ["length", "task"]).withColumn("rank", F.col("own") + F.col("before"))
    fits = (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(F.broadcast(plan), fits)  # the plan's size follows the capacity, not the data
    within = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("bin") + F.floor(within / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + within % F.col("times") * ranked["length"]).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
