"""Operator 5, line dedup: winnowed line hashes are joined by position, matches grow both ways, and the later repeated runs go.

A source's own lines are of any length and have foreign text glued to them. So a line here is LINE words, from every word on: a
passage has the same lines wherever it stands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import chunks, durable, free_name, released, small_batches, trimmed
from tessella.llm._hashes import BASES, Runs, gram_hashes, mix, sliding, word_edges, word_hashes

#: A repeated run has at least so many words: over 50.
PASSAGE = 51
#: Words of a line. Each window of PASSAGE words has PASSAGE - LINE + 1 lines, and the least of their hashes is a fingerprint.
LINE = 24
BLOCK_BYTES = 4 << 20


class Block:
    """The words of some texts, their lines' hashes, and the least line of every window."""

    def __init__(self, raws: list[bytes], passage: int, line: int):
        raw = b"\n".join(raws)
        starts, ends = word_edges(raw)
        edges = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
        self.passage, self.line, self.width = passage, line, passage - line + 1
        self.hashes = word_hashes(raw, starts, ends)
        self.base, self.n = edges[:-1], np.diff(edges)
        self.lines = gram_hashes(self.hashes, line, BASES[0])
        at = np.arange(max(len(self.hashes) - passage + 1, 0))
        self.windows = at[at + passage <= np.repeat(edges[1:], self.n)[: len(at)]]
        self.least = sliding(self.lines, self.width, np.minimum)[self.windows] if len(at) else np.zeros(0, np.uint64)

    def fingerprints(self) -> np.ndarray:
        """The lines that are the least of some window: where the greatest of the least ones around is the line's own."""
        if not len(self.windows):
            return np.zeros(0, np.int64)
        around = np.zeros(len(self.lines) + self.width - 1, np.uint64)
        around[self.windows + self.width - 1] = self.least
        return np.flatnonzero(sliding(around, self.width, np.maximum) == self.lines)

    def surroundings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, words from the line's first to the last that a window around it can reach, key of all words that one can reach and the line's place in them)."""
        text = np.searchsorted(self.base, at, side="right") - 1
        lo = np.maximum(at - (self.width - 1), self.base[text])
        end = np.minimum(at + self.passage, self.base[text] + self.n[text])
        runs = Runs(mix(self.hashes + np.uint64(1)), BASES[1])
        return text, end - at, mix(runs.of(lo, end) + (at - lo).astype(np.uint64))

    def around(self, at: np.ndarray) -> np.ndarray:
        """The windows of which one of these lines is the least."""
        own = np.zeros(len(self.lines), bool)
        own[at] = True
        reach = np.concatenate([[0], np.cumsum(own)])
        near = np.flatnonzero(reach[self.windows + self.width] > reach[self.windows])
        first = self.windows[near]
        steps = np.arange(self.width)
        hit = [f[(own[i] & (self.lines[i] == h[:, None])).any(axis=1)] for f, h in _slices(first, self.least[near]) for i in [f[:, None] + steps]]
        return np.concatenate(hit) if hit else first

    def keys(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gram_hashes(self.hashes, self.passage, BASES[0])[first], gram_hashes(mix(self.hashes + np.uint64(1)), self.passage, BASES[1])[first]


def _slices(a: np.ndarray, b: np.ndarray, rows: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(a), rows):
        yield a[i : i + rows], b[i : i + rows]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(batches: Iterator[pa.RecordBatch], block_bytes: int, passage: int) -> Iterator[tuple[np.ndarray, list[bytes], pa.RecordBatch]]:
    """(rows, texts, batch) of the texts that can hold a passage."""
    for batch in chunks(batches, block_bytes):
        raws = batch.column(1).cast(pa.binary()).to_pylist()
        rows = [i for i, raw in enumerate(raws) if len(raw) >= 2 * passage - 1]
        if rows:
            yield np.array(rows), [raws[i] for i in rows], batch


PLACE = "id long, th long"


def line_hashes(text: DataFrame, passage: int, line: int, block_bytes: int) -> DataFrame:
    """Of (id, t): (h) for every fingerprint, its hash alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raws, _ in _texts(batches, block_bytes, passage):
            block = Block(raws, passage, line)
            yield pa.RecordBatch.from_arrays([_signed(block.lines[block.fingerprints()])], ["h"])

    return text.mapInArrow(run, "h long")


def fingerprints(text: DataFrame, passage: int, line: int, block_bytes: int) -> DataFrame:
    """Of (id, t): (h, s, id, th, at, n) for every fingerprint: its hash, the key of its surroundings as far as windows around it can
    reach, the text it is in, its first word, and how many words from there on they can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raws, batch in _texts(batches, block_bytes, passage):
            block = Block(raws, passage, line)
            at = block.fingerprints()
            of, n, s = block.surroundings(at)
            th = np.array([xxhash.xxh64_intdigest(r, 42) for r in raws], np.uint64)
            words = [pa.array(x.astype(np.int32)) for x in (at - block.base[of], n)]
            ids = batch.column(0).take(pa.array(rows[of]))
            yield pa.RecordBatch.from_arrays([_signed(block.lines[at]), _signed(s), ids, _signed(th[of]), *words], ["h", "s", "id", "th", "at", "n"])

    return text.mapInArrow(run, f"h long, s long, {PLACE}, at int, n int")


def window_keys(asked: DataFrame, passage: int, line: int, block_bytes: int) -> DataFrame:
    """Of (id, t, th, ats): (k1, k2, id, th, at) for every window of which a line that begins at one of `ats` is the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raws, batch in _texts(batches, block_bytes, passage):
            block = Block(raws, passage, line)
            ats = batch.column(3).take(pa.array(rows)).to_pylist()
            first = block.around(np.concatenate([np.array(x, np.int64) + b for x, b in zip(ats, block.base.tolist())]))
            of = np.searchsorted(block.base, first, side="right") - 1
            k1, k2 = block.keys(first)
            there = pa.array(rows[of])
            yield pa.RecordBatch.from_arrays([_signed(k1), _signed(k2), batch.column(0).take(there), batch.column(2).take(there), pa.array((first - block.base[of]).astype(np.int32))], ["k1", "k2", "id", "th", "at"])

    return asked.mapInArrow(run, f"k1 long, k2 long, {PLACE}, at int")


def _later(places: DataFrame, lo: Column, hi: Column, passage: int) -> DataFrame:
    """(id, th, lo, hi): the words that go, of all places but the first. If a place overlaps the first, only what lies beyond that.

    Few rows: ranges of a text that end near each other are one, as each is longer than that, however often the text's row is repeated."""
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    far = F.col("at") - F.col("first.at")
    beyond = F.when(same & (far < passage), lo + passage - far).otherwise(lo)
    ranges = places.where(~same | (far != 0)).select("id", "th", beyond.alias("lo"), hi.alias("hi"))
    near = F.when(F.col("hi") - F.col("lo") >= passage - 1, F.floor(F.col("hi") / passage)).otherwise(-1 - F.col("lo"))
    return ranges.groupBy("id", "th", near.alias("near")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("near")


def repeated_runs(docs: DataFrame, passage: int = PASSAGE, line: int = LINE, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, th, ranges), durable: for each text the ranges (first and last word) of its runs of `passage` words or more that occur earlier.

    Earlier means a smaller (id, hash of the text), or the same text further up; a null id is the least. th tells apart rows that
    share an id; identical rows are one text here.

    1. Fingerprints, and which of their hashes are at several places.
    2. Places with the same fingerprint and the same surroundings as far as a window reaches to both sides: the match grows to the
       whole of them in all places but the first. Each place meets the first one only, so a passage in a third of all texts costs a row a place.
    3. A fingerprint in several surroundings: of each, the first place's windows meet by their words, as far left and right as they agree.
    Fingerprints overlap, so neighbouring matches make up the whole run.

    Each step ends in a durable frame, and the files of the steps before go first: shuffles, and frames that no later step reads.
    Fingerprints are computed twice, for the count and for the join, rather than kept in between."""
    spark = docs.sparkSession
    small_batches(spark)

    def step(df: DataFrame) -> DataFrame:
        released(spark)
        return durable(df)

    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    often = step(line_hashes(text, passage, line, block_bytes).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"))
    met = step(fingerprints(text, passage, line, block_bytes).join(often, "h"))
    del often

    place = F.struct("id", "th", "at")
    classes = step(met.groupBy("h", "s").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")))
    copies = met.join(classes.where("c > 1").drop("c"), ["h", "s"])
    copied = step(_later(copies, F.greatest(F.col("at") - (passage - line), F.lit(0)), F.col("at") + F.col("n") - 1, passage))
    del met, copies

    several = step(classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"))
    asked = step(classes.join(several, "h").groupBy(F.col("first.id").alias("__id"), F.col("first.th").alias("__th")).agg(F.collect_set("first.at").alias("ats")))
    del classes, several
    asked = with_lists(text, asked, "id", "t", how="inner").select("id", "t", F.xxhash64("t").alias("th"), "ats")
    windows = step(window_keys(asked, passage, line, block_bytes))
    del asked
    firsts = step(windows.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    grown = step(_later(windows.join(firsts, ["k1", "k2"]), F.col("at"), F.col("at") + (passage - 1), passage))
    del windows, firsts

    order = Window.partitionBy("id", "th").orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = copied.unionByName(grown).withColumn("new", F.when(F.col("lo") <= reached + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    joined = each.groupBy("id", "th", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy("id", "th")
    out = step(joined.agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges")))
    del copied, grown, each, joined
    released(spark)
    return out


def with_lists(docs: DataFrame, lists: DataFrame, id_col: str, text_col: str, how: str = "left") -> DataFrame:
    """docs with the lists of (__id, __th, list), durable and unique. The texts move only if the lists are too many to go to the texts."""
    name = lists.columns[2]
    size = lists.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size(name)).alias("entries")).first()
    few = size["rows"] <= 200_000 and (size["entries"] or 0) <= 2_000_000
    hit = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__th"))
    return docs.join(F.broadcast(lists) if few else lists, hit, how).drop("__id", "__th")


def line_dedup(docs: DataFrame, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text", with_counts: bool = False, block_bytes: int = BLOCK_BYTES, line: int | None = None) -> DataFrame:
    """The input rows with their columns; the text without its runs of `passage` words or more that occur earlier, wherever they stand.
    with_counts adds n_removed (runs) and n_removed_words.

    A run goes with the white space behind each of its words. Every row stays: a text that occurs earlier as a whole becomes empty
    but for white space before its first word. Null texts stay null. Rows that share an id are ordered by a hash of their text;
    identical rows keep the same text. An empty table gives no rows."""
    line = line or min(LINE, max(1, passage // 2))
    ranges = repeated_runs(docs, passage, line, id_col, text_col, block_bytes).toDF("__id", "__th", "__ranges")
    joined = with_lists(docs, ranges, id_col, text_col)
    own = list(docs.columns)
    place = own.index(text_col)
    more = [free_name(c, own) for c in ("n_removed", "n_removed_words")] if with_counts else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.num_columns - 1)
            texts, runs, lost = batch.column(place), [0] * batch.num_rows, [0] * batch.num_rows
            hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)).tolist()
            if hit:
                out = texts.to_pylist()
                for i in hit:
                    raw, kept, at = out[i].encode(), [], 0
                    starts = [*word_edges(raw)[0].tolist(), len(raw)]
                    for r in found[i].as_py():
                        kept.append(raw[at : starts[r["lo"]]])
                        at = starts[r["hi"] + 1]
                        runs[i] += 1
                        lost[i] += r["hi"] - r["lo"] + 1
                    out[i] = b"".join([*kept, raw[at:]]).decode()
                texts = pa.array(out, texts.type)
            columns = [*batch.columns[:place], texts, *batch.columns[place + 1 : -1]]
            if more:
                columns += [pa.array(runs, pa.int64()), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*own, *more])
        trimmed()

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + "".join(f", `{c}` long" for c in more)
    return joined.mapInArrow(cut, kinds)
