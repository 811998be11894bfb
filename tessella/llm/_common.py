"""What the operators share: the text model, reading a table, and durable intermediate results."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six characters.
SPACE_CLASS = "\\x20\\x09-\\x0D"
WORD = re.compile("[^\x20\x09-\x0d]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and all is on one machine, one of our own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


#: Durable results after which the cleaner is asked to look.
RELEASE_EVERY = 6
_kept = count(1)


def durable(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: lineage ends there, so a lost executor costs no recomputation.

    The files go when the cluster's cleaner finds that nothing refers to them any more, unless the cluster says that they stay. Now
    and then it is asked to look: a step of many small results would else keep all its shuffles, of a file or two for each task."""
    spark, key = df.sparkSession, "spark.cleaner.referenceTracking.cleanCheckpoints"
    shared_dir(spark)
    spark.sparkContext._jsc.sc().conf().setIfMissing(key, "true")  # read at each checkpoint
    if next(_kept) % RELEASE_EVERY == 0:
        released(spark)
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Lets the cluster's cleaner delete now what nothing refers to any more: shuffles and durable files of a pass that has ended."""
    gc.collect()
    spark._jvm.System.gc()


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def whole_text(column: str = "text") -> Column:
    """The text; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


#: Bytes of an Arrow batch on its way to a task's Python. Spark's own 64 MB, for each task and in several copies, is much for texts.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batches to BATCH_BYTES unless it has chosen a size itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "64MB", str(64 << 20)):
        spark.conf.set(key, BATCH_BYTES)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly two columns, whatever else the input has."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))


def trimmed() -> None:
    """Gives memory that a task's Python has freed back to the machine: workers live on, and wait beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most about so many bytes of text (column 1), so that long texts don't add up in memory."""
    for batch in batches:
        text = batch.column(1)
        n, start = batch.num_rows, 0
        if n == 0:
            continue
        if text.nbytes <= most_bytes:
            yield batch
            continue
        lengths = pa.compute.binary_length(text).to_pylist()
        size = 0
        for i, length in enumerate(lengths):
            if size and size + (length or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += length or 0
        yield batch.slice(start, n - start)
    trimmed()


def sized(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, marked for broadcast only if it is counted to hold at most so many rows; else Spark joins it by shuffle. For narrow durable frames."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it until no column is called so."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes a folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
