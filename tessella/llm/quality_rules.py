"""Operator 1, quality rules: host-level verdicts from document-level rule failures. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import SPACE_CLASS, durable, sized, whole_text

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(ordered: Column) -> Column:
    """Words under a window that occurs twice or more. ordered: (hash, position) of all windows, sorted, so equal hashes are neighbours."""
    found = F.filter(
        ordered,
        lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]),
    )
    return F.sort_array(F.transform(found, lambda x: x["p"]))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One narrow pass: (doc_id, host, the five measures, base_failed). A null text has no words, a null host is a host of its own."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), whole_text(text_col).alias("t"))
    df = df.select("doc_id", "host", "t", F.filter(F.split("t", f"[{SPACE_CLASS}]+"), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias("lines"))
    df = df.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", f"[{SPACE_CLASS}]+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("wh"),
    )
    # A window's hash chains the hashes of its words. Only texts that do repeat one go on to the sort.
    last = F.size("wh") - WINDOW
    windows = F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("wh", i + k) for k in range(WINDOW)])))
    df = df.select("*", windows.alias("g")).drop("wh")
    repeats = F.col("g").isNotNull() & (F.size(F.array_distinct("g")) < F.size("g"))
    df = df.select("*", F.when(repeats, F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).alias("ordered")).drop("g")
    df = df.select("*", _repeat_words(F.col("ordered")).alias("at")).drop("ordered")
    # Each window adds the words up to the next repeated window's start; the last adds all of its own.
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("at")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_verdicts(measures: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Per host: documents, failures, the failure rate shrunk by a beta prior, and whether the host is rejected.

    The prior is empirical: its mean and strength are the method-of-moments fit to the rates of all hosts, each weighted by its
    documents. One row for each host; the prior is one row. Where all hosts agree (or there is one host) the prior counts as
    the corpus' rate with the strength of 1000 documents; a host's own rate then still decides once it has as many."""
    hosts = measures.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(F.sum("n_docs").alias("d"), F.sum("n_failed").alias("f"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n_docs") * rate * rate).alias("s2"))
    total = total.select("d", "k", (F.col("f") / F.col("d")).alias("mean"), (F.col("s2") / F.col("d") - (F.col("f") / F.col("d")) ** 2).alias("var"))
    # Of the spread between hosts, take off what sampling alone gives: mean (1 - mean) over the mean host size.
    spread = F.col("mean") * (1 - F.col("mean"))
    between = F.col("var") - spread * F.col("k") / F.col("d")
    strength = F.when((between > 0) & (spread > between), F.least(spread / between - 1, F.lit(1000.0))).otherwise(F.lit(1000.0))
    prior = total.select((F.col("mean") * strength).alias("alpha"), ((1 - F.col("mean")) * strength).alias("beta"))
    out = hosts.crossJoin(F.broadcast(prior))  # one row, by the global aggregate
    shrunk = (F.col("n_failed") + F.col("alpha")) / (F.col("n_docs") + F.col("alpha") + F.col("beta"))
    return out.select("host", "n_docs", "n_failed", F.round(shrunk, 9).alias("host_rate")).withColumn("host_rejected", F.col("host_rate") > threshold)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", threshold: float = 0.75) -> DataFrame:
    """A row for each input row: doc_id, the measures, base_failed, kept, host_rate.

    kept: the document passes its own rules and its host isn't rejected, that is fewer than `threshold` of the host's documents
    fail by the shrunken rate: a host must be mostly junk before its clean documents go with it. Null and empty texts have no
    words and fail; repeated rows are each measured; an empty table gives no rows; other columns are ignored."""
    measures = durable(measured(docs, id_col, text_col, host_col))
    # Small rows without text. Hosts may be many or few and one may be hot: no hint, so that the runtime plan broadcasts the
    # verdicts if they are small and else splits the hot host's partition.
    verdicts = host_verdicts(measures, threshold).select(F.coalesce("host", F.lit("")).alias("hk"), F.col("host").isNull().alias("hn"), "host_rate", "host_rejected")
    left = measures.withColumn("hk", F.coalesce("host", F.lit(""))).withColumn("hn", F.col("host").isNull())
    out = left.join(verdicts, ["hk", "hn"], "left")
    return out.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host_rate")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", threshold: float = 0.75) -> DataFrame:
    """The input rows that quality_rules keeps, with their own columns. A row is known by its id, host and text: others of its id stay or go by themselves."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    key = F.xxhash64(F.col(id_col), F.lit(0), F.col(host_col).cast("string"), F.lit(1), F.col(text_col).cast("string"))
    keyed = docs.select(F.struct(*own).alias("row"), key.alias("k"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    rejected = durable(quality_rules(keyed, "k", "text", "host", threshold).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct())
    return keyed.join(sized(rejected), F.col("k") == F.col("gone"), "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
