"""Operator 7, SimHash near-dedup: fingerprints linked by the generalised pigeonhole principle over groups of correlated bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import chunks, durable, id_and_text, sized
from tessella.llm.components import components
from tessella.llm.near_copies import linked_groups, similar_pairs

BITS = 64
SEED = 42
#: What a candidate pair costs beside a probe row: it is a row of the join, and it is verified.
PAIR_COST = 8.0


def fingerprint(raw: bytes, shingle: int = 4) -> int:
    """Of a UTF-8 text, as a signed 64-bit integer. bytes.lower and bytes.split know ASCII only, as is wanted."""
    words = raw.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 16)], stops[i : i + (1 << 16)])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fps = [fingerprint(t.encode(), shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


# ---- the plan: which bits stand together, and how many of them may differ -----------------------------------------------


def co_occurrence(fps: DataFrame) -> np.ndarray:
    """How often two bits are set together, over all fingerprints: 64 x 64 counts, summed by the tasks and then over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
            for i in range(0, len(raw), 1 << 16):
                bits = np.unpackbits(raw[i : i + (1 << 16)], axis=1).astype(np.float32)
                both += (bits.T @ bits).astype(np.int64)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both.reshape(-1))], ["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = r["n"]
    return out


def correlated_groups(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits (0 is the highest) in `parts` groups of about equal width; each bit joins the group that it correlates with most."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    linked = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(linked, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (linked[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: (linked[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def within(probabilities: np.ndarray, most: int) -> np.ndarray:
    """P(at most t of the bits differ) for t = 0..most, the bits taken as independent."""
    p = np.zeros(most + 2)
    p[0] = 1
    for q in probabilities:
        p[1:] = p[1:] * (1 - q) + p[:-1] * q
        p[0] *= 1 - q
    return np.cumsum(p[: most + 1])


def allocate(costs: list[np.ndarray], distance: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 (-1: the group isn't probed) with sum(t_i + 1) = distance + 1, of the least total cost.

    If all groups of a pair differ in more than t_i bits, the pair differs in at least sum(t_i + 1) bits; so no pair is missed."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * (distance + 1)
    for cost in costs:
        step: list[tuple[float, list[int]] | None] = [None] * (distance + 2)
        for spent, so_far in enumerate(best):
            if so_far is None:
                continue
            for more in range(distance + 2 - spent):
                total = so_far[0] + (cost[more - 1] if more else 0.0)
                if step[spent + more] is None or total < step[spent + more][0]:
                    step[spent + more] = (total, [*so_far[1], more - 1])
        best = step
    return best[distance + 1]


def probe_plan(both: np.ndarray, n: int, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the groups to probe, for the number of groups at which probes and estimated candidates cost least."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    found = None
    for parts in range(1, min(8, distance + 1) + 1):
        groups = correlated_groups(both, max(n, 1), parts)
        costs = []
        for group in groups:
            near = within(differ[group], distance)
            balls = np.cumsum([comb(len(group), k) for k in range(distance + 1)], dtype=float)
            costs.append(n * balls + PAIR_COST * n * n / 2 * near)
        cost, thresholds = allocate(costs, distance)
        if found is None or cost < found[0]:
            found = (cost, [(g, t) for g, t in zip(groups, thresholds) if t >= 0])
    return found[1]


def _mask(bits) -> int:
    m = sum(1 << (BITS - 1 - b) for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints that differ in at most `distance` bits. fps: distinct, column fp, durable."""
    spark = fps.sparkSession
    n = fps.count()
    plan = probe_plan(co_occurrence(fps), n, distance)
    probes, index = [], []
    for k, (bits, t) in enumerate(plan):
        flips = [_mask(c) for r in range(t + 1) for c in combinations(bits, r)]
        own = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        index.append(F.struct(F.lit(k).alias("k"), own.alias("v")))
        probes.append((k, own, flips))
    table = spark.createDataFrame([(k, flips) for k, _, flips in probes], "k int, flips array<long>")  # the plan: a few thousand numbers at most
    fps = fps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes a row, but each becomes dozens of probes
    held = fps.select(F.col("fp").alias("b"), F.explode(F.array(*index)).alias("x")).select("b", "x.k", "x.v")
    asked = fps.select(F.col("fp").alias("a"), F.explode(F.array(*index)).alias("x")).select("a", "x.k", "x.v").join(F.broadcast(table), "k")
    asked = asked.select("a", "k", F.explode(F.transform("flips", lambda f: F.col("v").bitwiseXOR(f))).alias("v"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return asked.join(held, ["k", "v"]).where(near).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Equal fingerprints meet before any link is looked for, so groups of copies cost one probe. Null and empty texts have
    fingerprint zero and are linked like any other; rows with a null doc_id link others, and have a null component_id only if no
    doc_id is reachable; repeated rows each get their row; an empty table gives no rows; other columns are ignored."""
    rows = durable(fingerprints(docs, shingle, id_col, text_col))
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = durable(components(links(distinct, distance)))
    # Durable, so that both joins are plain exchanges whose hot parts, a large component or a frequent fingerprint, the runtime plan splits.
    named = durable(distinct.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = durable(named.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = durable(named.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", similar: bool = False) -> DataFrame:
    """Of each group of linked rows one, with its columns: the least doc_id's; of several texts under it, one told by a hash.

    A row is known by its id and text together, so texts that share an id or have none are judged each by itself; null ids come
    last. Of rows with the same id and text, that whose columns come first as JSON stays.
    similar: groups are also linked by all pairs of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    key = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    keyed = docs.select(F.struct(*own).alias("row"), key.alias("k"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    groups = durable(simhash_groups(keyed, shingle, distance, "k", "text"))
    if similar:
        groups = durable(linked_groups(groups, durable(similar_pairs(keyed, id_col="k", text_col="text"))))
    rows = durable(keyed.groupBy("k", "id").agg(F.count(F.lit(1)).alias("n")))
    several = durable(groups.select(F.col("doc_id").alias("k"), "component_id").distinct().groupBy("component_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    members = durable(groups.select(F.col("doc_id").alias("k"), "component_id").distinct().join(several, "component_id").join(rows, "k").select("k", "id", "component_id"))
    first = durable(members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "k")).alias("first")))
    gone = durable(members.join(first, "component_id").where(F.col("k") != F.col("first.k")).select(F.col("k").alias("gone")).distinct())
    kept = keyed.join(sized(gone), F.col("k") == F.col("gone"), "left_anti")
    twice = durable(rows.where("n > 1").select(F.col("k").alias("twice")).distinct())
    if not twice.isEmpty():
        again = kept.join(sized(twice), F.col("k") == F.col("twice"), "left_semi").groupBy("k").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(sized(twice), F.col("k") == F.col("twice"), "left_anti").select("row").unionByName(again.select("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
