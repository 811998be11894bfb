"""Near copies by similarity: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import chunks, durable, id_and_text, released, sized
from tessella.llm.components import components
from tessella.llm._hashes import BASES, gram_hashes, word_edges, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Shingles in so many texts of one batch are common, and come last in the order; the driver holds at most so many of them.
COMMON, MOST_COMMON = 3, 500_000


def shingles(raw: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words, ASCII letters lowered; a shorter text is one run."""
    raw = raw.lower()
    hashes = word_hashes(raw, *word_edges(raw))
    return np.unique(gram_hashes(hashes, min(k, len(hashes)), BASES[0])) if len(hashes) else hashes


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    for batch in batches:
        for part in chunks([batch]):
            yield part.column(0).to_pylist(), [shingles(t, k) for t in part.column(1).cast(pa.binary()).to_pylist()]


def _name(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def bits_of(found: np.ndarray) -> np.ndarray:
    """A text's shingles as bits at their hashes, two to four times as many bits as shingles: packed."""
    size = 2 << max(6, int(len(found) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(found & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def most_shared(n: int, x: np.ndarray, m: int, y: np.ndarray) -> int:
    """No more shingles than these can be in both texts: each bit that only one of them has is a shingle that the other lacks."""
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def common_shingles(text: DataFrame, k: int) -> np.ndarray:
    """The hashes of common shingles, the commonest last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, k):
            found, times = np.unique(np.concatenate(sets), return_counts=True)
            often = times >= COMMON
            yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(times[often])], ["h", "n"])

    counts = text.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(MOST_COMMON)
    return counts.toArrow().column("h").to_numpy()[::-1].view(np.uint64)


def similar_pairs(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, v) of doc_ids whose components are those of all pairs of texts with a similarity of `similarity` or more.

    Two such sets share one of their first n - ceil(similarity * n) + 1 shingles in any order that holds for all; the order here
    is by hash, common ones last. Most of these occur once in the corpus: they are counted first, and only those that come again
    meet their texts. Texts with equal sets are one. Texts are first held against the least of each shingle's holders, which joins a
    large group of copies by a row each; then holders of a shingle in different components are compared."""
    text = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    spark = docs.sparkSession
    common = common_shingles(text, k)
    order = np.argsort(common)
    known = spark.sparkContext.broadcast((common[order], order))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ranks = known.value
        for ids, sets in _sets(batches, k):
            rows = []
            for i, found in zip(ids, sets):
                if not len(found):
                    continue
                rank = np.full(len(found), -1)
                if len(names):
                    at = np.minimum(np.searchsorted(names, found), len(names) - 1)
                    rank = np.where(names[at] == found, ranks[at], -1)
                first = len(found) - ceil(similarity * len(found) - 1e-9) + 1
                rows.append((i, _name(found), len(found), found[np.argsort(rank, kind="stable")[:first]].view(np.int64), bits_of(found).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], ["doc_id", "s", "n", "prefix", "bits"])

    rows = durable(text.mapInArrow(prefixes, "doc_id long, s long, n long, prefix array<long>, bits binary"))
    known.destroy()
    nodes = durable(rows.groupBy("s").agg(F.min("doc_id").alias("first"), F.first("n").cast("int").alias("n")))
    each = rows.select("s", F.explode("prefix").alias("h"))
    often = durable(each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"))
    met = each.join(often, "h").distinct()
    held = durable(met.join(nodes.select("s", "n"), "s"))
    released(spark)
    least = held.groupBy("h").agg(F.min(F.struct("s", "n")).alias("x"), F.max("s").alias("top")).where("x.s < top")
    least = durable(least.select("h", F.col("x.s").alias("b"), F.col("x.n").alias("m")))
    near_size = F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m") - 1e-9

    def tested(pairs: DataFrame, texts: DataFrame, alike: Callable[[int, bytes, int, bytes], bool]) -> DataFrame:
        """The pairs (a, b) that are alike by (n, x) of texts (s, n, x)."""

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [alike(*x) for x in zip(*(c.to_pylist() for c in batch.columns[2:]))]
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        both = pairs.join(texts.toDF("a", "n", "x"), "a").join(texts.toDF("b", "m", "y"), "b").select("a", "b", "n", "x", "m", "y")
        return durable(both.mapInArrow(check, "a long, b long"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of (a, b), the pairs that are similar: by the bits of their shingles as far as these can tell, then by the shingles."""

        def texts_of(pairs: DataFrame) -> DataFrame:
            wanted = durable(pairs.select("a").union(pairs.select("b")).distinct().toDF("s"))
            return durable(nodes.join(sized(wanted), "s", "left_semi").select(F.col("first").alias("doc_id")))

        def by_bits(n: int, x: bytes, m: int, y: bytes) -> bool:
            return most_shared(n, np.frombuffer(x, np.uint8), m, np.frombuffer(y, np.uint8)) >= similarity / (1 + similarity) * (n + m) - 1e-6

        def by_shingles(n: int, x: bytes, m: int, y: bytes) -> bool:
            shared = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            return shared >= similarity * (n + m - shared) - 1e-9

        def all_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, sets in _sets(batches, k):
                sets = [x for x in sets if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["s", "n", "x"])

        pairs = durable(pairs)
        bits = durable(rows.join(sized(texts_of(pairs)), "doc_id", "left_semi").select("s", "n", "bits").dropDuplicates(["s"]))
        pairs = tested(pairs, bits, by_bits)
        sets = durable(text.join(sized(texts_of(pairs)), "doc_id", "left_semi").mapInArrow(all_sets, "s long, n long, x binary").dropDuplicates(["s"]))
        found = tested(pairs, sets, by_shingles)
        released(spark)
        return found

    held = durable(held.join(least, "h"))
    links = verified(held.where("s <> b").where(near_size).select(F.col("s").alias("a"), "b").distinct())
    roots = durable(components(links))
    placed = held.select("s", "n", "h").join(sized(roots).withColumnRenamed("id", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    mixed = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    placed = durable(placed.join(mixed, "h", "left_semi"))
    other = placed.select("h", F.col("s").alias("b"), F.col("n").alias("m"), F.col("root").alias("root_b"))
    rest = placed.join(other, "h").where(F.col("s") < F.col("b")).where(F.col("root") != F.col("root_b")).where(near_size)
    links = links.union(verified(rest.select(F.col("s").alias("a"), "b").distinct()))
    name = nodes.select("s", "first")
    by_id = links.join(name.toDF("a", "u"), "a").join(name.toDF("b", "v"), "b").select("u", "v")
    return by_id.union(rows.join(name, "s").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))).where("u <> v").distinct()


def linked_groups(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """groups (doc_id, component_id) with components joined where a pair (u, v) reaches from one to another."""
    own = groups.where("doc_id <> component_id").select("doc_id", "component_id").toDF("u", "v")
    roots = durable(components(own.union(pairs).distinct()))
    joined = groups.select("doc_id", "component_id").join(roots.toDF("component_id", "root"), "component_id", "left")
    return joined.select("doc_id", F.coalesce("root", "component_id").alias("component_id"))
