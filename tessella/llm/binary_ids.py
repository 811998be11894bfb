"""Operator 8, token-id output: frequency-ranked ids, byte-aligned variable lengths, control bytes apart, decoded by table lookup."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import chunks, durable, fresh_path, id_and_text
from tessella.llm._tokens import ids_of

END = 2
BLOCK_TOKENS = 1 << 20
#: The columns of the two files: a block's documents lie one after another; control and data are its coded ranks.
BLOCKS = "task long, block long, start long, doc_ids binary, null_ids binary, lengths binary, control binary, data binary"
RANKS = "rank long, id long, n long"

#: Of each control byte, the bytes of its four values (two bits each, the lowest first).
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes): each value in as few of 1 to 4 bytes as it needs, least significant first."""
    v = np.ascontiguousarray(values, dtype="<u4")
    n_bytes = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = n_bytes - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < n_bytes[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    n_bytes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    if len(n_bytes) < n or int(n_bytes.sum(dtype=np.int64)) != len(data):
        raise ValueError("control and data bytes disagree")
    ends = np.cumsum(n_bytes, dtype=np.int64)
    raw = np.frombuffer(data, np.uint8)
    at = ends - n_bytes
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        wide = np.flatnonzero(n_bytes > k)
        if not len(wide):
            break
        out[wide] |= raw[at[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenized(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end: int) -> DataFrame:
    """(doc_id, n, ids as compressed unsigned 16- or 32-bit), in ascending doc_id order over the partitions; kept."""
    wide = np.uint16 if max(ids_of(vocabulary).size, end + 1) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, press = ids_of(vocabulary).ids, zstandard.ZstdCompressor(level=1)
        for batch in chunks(batches):
            ids = [np.append(encode_text(t), np.array([end], "<u4")).astype(wide) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([press.compress(x.tobytes()) for x in ids], pa.binary())], ["doc_id", "n", "ids"])

    text = id_and_text(docs, id_col, text_col)
    # The hash only settles the order of rows that share an id.
    ordered = text.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return durable(ordered.mapInArrow(run, "doc_id long, n long, ids binary").withColumn("task", F.spark_partition_id()))


def _ids(packed: bytes, unpack, wide) -> np.ndarray:
    return np.frombuffer(unpack.decompress(packed), wide).astype(np.uint32)


def write_ids(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k", end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes `path`/blocks (a row for each block, files and rows in ascending doc_id order) and `path`/ranks (rank, id, n).

    The ranks count every id of every document: one row for each id of the vocabulary reaches the driver, and one total for each task."""
    spark = docs.sparkSession
    rows = _tokenized(docs, id_col, text_col, vocabulary, end)
    size = max(ids_of(vocabulary).size, end + 1)
    wide = np.uint16 if size <= 1 << 16 else np.uint32

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, n = zstandard.ZstdDecompressor(), np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                n += np.bincount(np.concatenate([np.frombuffer(unpack.decompress(x), wide) for x in batch.column(0).to_pylist()]), minlength=size)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n[found], pa.int64())], ["id", "n"])

    counted = rows.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = sorted(((-r["n"], r["id"]) for r in counted))
    spark.createDataFrame([(k, i, -n) for k, (n, i) in enumerate(order)] or [(0, end, 0)], RANKS).coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(size, np.uint32)
    rank[[i for _, i in order]] = np.arange(len(order), dtype=np.uint32)
    before, base = 0, {}
    for r in sorted(rows.groupBy("task").agg(F.sum("n").alias("n")).collect()):
        base[r["task"]] = before
        before += r["n"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, start, task, number = zstandard.ZstdDecompressor(), None, None, 0
        docs_in: list[int | None] = []
        ids_in: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal start, number, held
            n = np.array([len(x) for x in ids_in], "<u4")
            control, data = encode(rank[np.concatenate(ids_in)])
            known = [0 if d is None else d for d in docs_in]
            null = np.packbits([d is None for d in docs_in]).tobytes()
            got = pa.RecordBatch.from_pylist([{"task": task, "block": number, "start": start, "doc_ids": np.array(known, "<i8").tobytes(), "null_ids": null, "lengths": n.tobytes(), "control": control, "data": data}])
            start, number, held = start + int(n.sum()), number + 1, 0
            docs_in.clear()
            ids_in.clear()
            return got

        for batch in batches:
            for doc, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if start is None:
                    task, start = t, base[t]
                ids = _ids(x, unpack, wide)
                docs_in.append(doc)
                ids_in.append(ids)
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    yield out()
        if ids_in:
            yield out()

    rows.select("doc_id", "task", "ids").mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32 (and ids, little-endian unsigned 32-bit)."""
    table = spark.read.schema(RANKS).parquet(f"{path}/ranks").collect()  # one row for each id of the vocabulary
    ids = np.zeros(max([r["rank"] for r in table], default=0) + 1, "<u4")
    for r in table:
        ids[r["rank"]] = r["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, docs, null, lengths, control, data = (c[i].as_py() for c in batch.columns)
                n = np.frombuffer(lengths, "<u4").astype(np.int64)
                found = ids[decode(control, data, int(n.sum()))]
                ends = np.cumsum(n)
                doc = np.frombuffer(docs, "<i8")
                no = np.unpackbits(np.frombuffer(null, np.uint8), count=len(doc)).astype(bool)
                raw = [found[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]
                cols = [pa.array(doc, pa.int64(), mask=no), pa.array(start + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("start", "doc_ids", "null_ids", "lengths", "control", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def binary_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the documents' ids to `path` (by default a new place in the shared folder) and returns what reading the files back gives.

    Null and empty texts are one end id; null doc_ids come first; rows that share an id are ordered by a hash of their text; an
    empty table gives files without rows; other columns are ignored."""
    path = path or fresh_path(docs.sparkSession, "ids")
    write_ids(docs, path)
    return read_ids(docs.sparkSession, path)
