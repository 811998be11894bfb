"""Operator 4, LM scoring: stupid backoff from n-gram count tables partitioned by hash, joined back to the n-grams of each block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import durable, id_and_text, trimmed

ALPHA = 0.4
ORDER = 2
#: An n-gram of two or more words is in the table from so many occurrences.
MIN_COUNT = 2
BLOCK_BYTES = 16 << 20
#: Rows (n-gram, block) that a part of the count tables has about, and the most parts, as a power of two: beyond it parts grow, and spill.
PART_ROWS = 1 << 18
MOST_BITS = 16
#: A block's n-grams are sorted in slices by so many upper bits of their hashes, which are whole parts, and its words are scored in stretches: both bound memory.
SLICE_BITS = 3
STRETCH = 1 << 18
MICRO = 1_000_000
#: How n-grams go to their part; `here` has the numbers of the last ones in the list, the others are in the block once.
PIECES = {"high": "short", "mid": "short", "low": "int", "here": "int"}


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _planes(x: np.ndarray) -> bytes:
    """Integers as compressed bytes, all lowest ones first, then all second ones: the high ones are mostly alike."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


class Block:
    """The words of some documents as places in the block's vocabulary of word hashes."""

    def __init__(self, vocabulary: np.ndarray, places: np.ndarray, n_words: np.ndarray):
        self.words = vocabulary[places]
        self.n_words = n_words
        starts = np.cumsum(n_words) - n_words
        self.depth = np.arange(len(places), dtype=np.int32) - np.repeat(starts.astype(np.int32), n_words)  # of a word in its document

    def grams(self, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For n = 1..order and each slice of the hashes by their upper bits: n, the slice, where its n-grams end, their sorted distinct hashes, and each end's place among them."""
        full = self.words
        for n in range(1, order + 1):
            if n > 1:
                full = np.concatenate([np.zeros(1, np.uint64), _mix(full[:-1], self.words[1:])]) if len(full) else full
            of_slice = (full >> np.uint64(64 - SLICE_BITS)).astype(np.uint8)
            for k in range(1 << SLICE_BITS):
                ends = np.flatnonzero((self.depth >= n - 1) & (of_slice == k))
                distinct, back = np.unique(full[ends], return_inverse=True)
                yield n, k, ends, distinct, back


def _blocks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (ids, n_words, vocabulary, places), each of about so many bytes of text: a block never cuts a document."""
    digest = xxhash.xxh64_intdigest
    known: dict[bytes, int] = {}
    hashes: list[int] = []
    ids: list[int | None] = []
    counts: list[int] = []
    places: list[np.ndarray] = []
    held = 0

    def out() -> pa.RecordBatch:
        nonlocal held
        h, at = np.array(hashes, np.uint64), np.concatenate(places)
        order = np.argsort(-np.bincount(at, minlength=len(h)), kind="stable")  # frequent words have low places, whose high bytes are 0
        rank = np.empty(len(h), np.uint32)
        rank[order] = np.arange(len(h), dtype=np.uint32)
        at = rank[at]
        got = pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(counts, "<u4").tobytes()], pa.binary()), pa.array([_planes(h[order])], pa.binary()), pa.array([_planes(at.astype("<u4"))], pa.binary()), pa.array([len(at)], pa.int64()), pa.array([len(h)], pa.int64())],
            ["ids", "n_words", "vocabulary", "places", "total", "distinct"],
        )
        for x in (known, hashes, ids, counts, places):
            x.clear()
        held = 0
        return got

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_py().encode()
            words = raw.split()  # bytes.split knows ASCII white space only, as is wanted
            for w in set(words):
                if w not in known:
                    known[w] = len(hashes)
                    hashes.append(digest(w))
            places.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
            ids.append(doc)
            counts.append(len(words))
            held += len(raw) + 64
            if held >= most_bytes:
                yield out()
    if ids:
        yield out()
    trimmed()


def _open(row: dict) -> Block:
    return Block(_from_planes(row["vocabulary"], "<u8"), _from_planes(row["places"], "<u4"), np.frombuffer(row["n_words"], "<u4").astype(np.int64))


def _pieces(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers as their upper 16, next 16 and lower 32 bits: the upper ones hardly change in a list of a part, and vanish when it is compressed."""
    words = gram.view("<i2").reshape(-1, 4)
    return np.ascontiguousarray(words[:, 3]), np.ascontiguousarray(words[:, 2]), np.ascontiguousarray(gram.view("<i4").reshape(-1, 2)[:, 0])


def _counted(asked: DataFrame, parts: int, min_count: int) -> DataFrame:
    """The n-grams of the blocks as rows, each with its count over all blocks (0 below min_count), and back to a list for each block.

    One exchange, by part of the count tables: an n-gram is in one part, so its rows meet there, one for each block that has it, are
    summed, and the lists go back in the order of the n-grams."""
    each = asked.repartition(parts, "part").select("block", "n", "part", "high", "mid", "here", F.posexplode("low").alias("i", "low"), (F.size("low") - F.size("here")).alias("single"))
    upper = F.shiftleft(F.get("high", F.col("i")).cast("long"), 48)
    middle = F.shiftleft(F.get("mid", F.col("i")).cast("long").bitwiseAND(0xFFFF), 32)
    gram = upper.bitwiseOR(middle).bitwiseOR(F.col("low").cast("long").bitwiseAND(0xFFFFFFFF))
    each = each.select("block", "n", "part", gram.alias("gram"), F.coalesce(F.get("here", F.col("i") - F.col("single")), F.lit(1)).alias("here"))
    total = F.sum(F.col("here").cast("long")).over(Window.partitionBy("part", "n", "gram"))
    each = each.select("block", "n", "part", "gram", total.alias("total"))
    seen = F.when((F.col("n") > 1) & (F.col("total") < min_count), F.lit(0).cast("long")).otherwise(F.col("total"))
    lists = each.groupBy("block", "n", "part").agg(F.sort_array(F.collect_list(F.struct("gram", seen.alias("total")))).alias("x"))
    return lists.select("block", "n", "part", F.col("x.total").alias("counts"))


def _scored(block: Block, tables: dict[tuple[int, int], np.ndarray], order: int, total: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(micro-nats, whether the full order was backed off from) at each word."""
    n_words = len(block.words)
    micro, backed = np.zeros(n_words, np.int64), np.zeros(n_words, bool)
    counts = {n: np.zeros(n_words, np.int64) for n in range(1, order + 1)}
    for n, k, ends, _, back in block.grams(order):
        if len(ends):
            counts[n][ends] = tables[n, k][back]
    for at in range(0, n_words, STRETCH):
        depth = block.depth[at : at + STRETCH]
        score, done, misses = np.zeros(len(depth)), np.zeros(len(depth), bool), np.zeros(len(depth), np.int8)
        for n in range(order, 0, -1):
            ends = np.flatnonzero(~done & (depth >= n - 1))
            seen = counts[n][at + ends]
            hit, missed = ends[seen > 0], ends[seen == 0]
            below = counts[n - 1][at + hit - 1] if n > 1 else total
            score[hit] = np.log(seen[seen > 0] / below) + misses[hit] * np.log(alpha)
            done[hit] = True
            misses[missed] += 1
            backed[at + missed] = True
        micro[at : at + STRETCH] = np.rint(score * MICRO).astype(np.int64)
    return micro, backed


def lm_scores(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each input row: doc_id, n_words, n_backed_off (words whose longest n-gram isn't in the table), score_micro.

    score_micro sums, in millionths of a nat and each word's rounded, the log of the stupid-backoff score: count of the n-gram over
    that of its context, or alpha times the score of the n-gram without its first word; at the end the word's share of all words.
    A word with fewer words before it than the order asks for starts lower without alpha. The counts are those of all texts given.

    Each task turns its texts into blocks. A block's distinct n-grams become a row each, however often they occur in it; rows meet
    those of the other blocks in their part of the count tables, and the sums go back to the block, which adds them up by document. Null and empty texts have no words and score 0, repeated rows count each
    time, an empty table gives no rows, other columns are ignored."""
    kind = "ids array<long>, n_words binary, vocabulary binary, places binary, total long, distinct long"
    blocks = durable(id_and_text(docs, id_col, text_col).mapInArrow(lambda b: _blocks(b, block_bytes), kind).withColumn("block", F.monotonically_increasing_id()))
    size = blocks.agg(F.sum("distinct").alias("v"), F.sum("total").alias("w")).first()
    bits = min(MOST_BITS, max(3, int(4 * (size["v"] or 1) / PART_ROWS).bit_length()))  # a block's n-grams are some times its vocabulary

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 1 << (bits - SLICE_BITS)  # parts of a slice
        for batch in batches:
            for row in batch.to_pylist():
                block = _open(row)
                for n, k, _, distinct, back in block.grams(order):
                    part = (distinct >> np.uint64(64 - bits)).astype(np.int32) - k * width
                    here = np.bincount(back, minlength=len(distinct)).astype(np.int32)
                    often = here > 1  # most aren't, and need no number on their way
                    turn = np.argsort(2 * part + often, kind="stable")
                    sent = (distinct ^ np.uint64(1 << 63)).view(np.int64)[turn]  # as signed, in the same order
                    edges, known = (pa.array(np.concatenate([[0], np.cumsum(np.bincount(x, minlength=width))]).astype(np.int32)) for x in (part, part[often]))
                    lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in _pieces(sent)] + [pa.ListArray.from_arrays(known, pa.array(here[often]))]
                    of_block = [pa.array(np.full(width, x, kind)) for x, kind in ((row["block"], np.int64), (n, np.int32))]
                    parts = pa.array(np.arange(k * width, (k + 1) * width, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([*of_block, parts, *lists], ["block", "n", "part", *PIECES])
        trimmed()

    asked = blocks.mapInArrow(ask, ", ".join(["block long, n int, part int", *(f"{name} array<{kind}>" for name, kind in PIECES.items())]))
    answered = _counted(asked, 1 << bits, min_count)
    total = size["w"] or 0

    def score(block_rows: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        row = block_rows.iloc[0].to_dict()
        block = _open(row)
        tables = tables.sort_values(["n", "part"])
        found = {key: np.concatenate(list(mine)) for key, mine in tables["counts"].groupby([tables["n"], tables["part"] // (1 << (bits - SLICE_BITS))])}
        micro, backed = _scored(block, found, order, total, alpha)
        del tables, found
        trimmed()
        ends = np.cumsum(block.n_words)
        starts = ends - block.n_words
        of = lambda x: (c := np.concatenate([[0], np.cumsum(x, dtype=np.int64)]))[ends] - c[starts]
        return pd.DataFrame({"doc_id": pd.array(list(row["ids"]), "Int64"), "n_words": block.n_words, "n_backed_off": of(backed), "score_micro": of(micro)})

    scored = blocks.groupBy("block").cogroup(answered.groupBy("block"))
    return scored.applyInPandas(score, "doc_id long, n_words long, n_backed_off long, score_micro long")
