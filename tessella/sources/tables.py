"""Scans: JSON lines, JSON, CSV, folders, binary files, EXIF; and the sinks that write back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import plain_path

#: The truth file's fields, and how other tables head the columns that feed them.
TRUTH = T.StructType([T.StructField(f, T.StringType()) for f in ("file", "winery", "wine", "vintage", "region", "country", "appellation", "grapes", "source")])
IMAGES = "*.{jpg,jpeg,png,webp,JPG,JPEG,PNG,WEBP}"


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One record a line, blank lines skipped; a line that isn't JSON is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_or_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """By the first character: [ means one array over many lines."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1).alias("c")).limit(1).collect()
    whole = bool(first) and first[0]["c"] == "["
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", whole).json(path)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted cells with doubled quotes and line ends; heads trimmed; rows without any value dropped; an empty cell is an empty string."""
    df = spark.read.options(header=True, multiLine=True, quote='"', escape='"', nullValue="\0", emptyValue="", mode="PERMISSIVE").csv(path)
    df = df.toDF(*[c.strip() for c in df.columns]).na.fill("")
    full = F.lit(False)
    for c in df.columns:
        full = full | (F.col(f"`{c}`") != "")
    return df.where(full)


def images(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """(file, content) of the image files of a folder, in order of their names. Without content only the listing is read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).load(folder)
    return df.select(F.substring_index(plain_path(F.col("path")), "/", -1).alias("file"), *(["content"] if with_content else [])).orderBy("file")


def latest_name(names: DataFrame, column: str, prefix: str) -> DataFrame:
    """The greatest name of the prefix followed by a date."""
    shape = f"^{prefix}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}"
    return names.where(F.col(column).rlike(shape)).agg(F.max(column).alias("latest"))


def geocoded(replies: DataFrame, column: str) -> DataFrame:
    """city (the first of city, town, village, municipality, suburb, state) and country of a reply, and both as found, null if neither is there."""
    keys = ["city", "town", "village", "municipality", "suburb", "state"]
    a = F.from_json(column, "struct<address:struct<" + ",".join(f"{k}:string" for k in [*keys, "country"]) + ">>")["address"]
    some = lambda x: F.when(x != "", x)
    return replies.withColumns({"city": F.coalesce(*[some(a[k]) for k in keys]), "country": some(a["country"])}).withColumn("found", F.when(F.col("city").isNotNull() | F.col("country").isNotNull(), F.struct("city", "country")))


def option_or_default(chosen: list[str] | None, known: list[str], default: list[str], most: int) -> list[str]:
    """Settings: the known ones chosen, at most so many, else the default."""
    kept = [c for c in chosen or [] if c in known][:most]
    return kept or list(default)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def write_notes(notes: DataFrame, folder: str, path: str = "path", content: str = "content") -> int:
    """Notes as rows of (path, content), each a text file of its own under `folder` at its path; how many there are.

    The tasks write the files, in whatever store pyarrow reaches by the folder's address. Each is written under another name and then
    moved, so a task that runs again after a loss leaves the same files and no half of one. Of rows with one path the content that
    is last as text stays; rows without a path are left out."""
    rows = notes.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("path")).agg(F.max(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for at, text in zip(*(c.to_pylist() for c in batch.columns)):
                target = f"{root.rstrip('/')}/{at}"
                store.create_dir(target.rpartition("/")[0])
                other = f"{target}.{uuid.uuid4().hex}"
                with store.open_output_stream(other) as out:
                    out.write((text or "").encode())
                store.move(other, target)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_places(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(name, country, region) from a CSV file with these columns: a dictionary of places for label_fields, in the file's order.

    It goes to every task as one row, so it is meant for thousands of names, not for data; more than 100,000 are refused."""
    rows = spark.read.csv(path, header=True, schema="name string, country string, region string").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("a dictionary of more than 100,000 places isn't one")
    return [(r["name"], r["country"] or "", r["region"] or "") for r in rows if r["name"]]
