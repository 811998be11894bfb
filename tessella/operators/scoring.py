"""Predictions against truth: cells compared, then counted by field, by row, by source and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.similarity import THRESHOLD, field_similarity

#: Truth's fields in their order: the prediction's name and how the two are compared.
FIELDS = {
    "winery": ("Winemaker", "name"), "wine": ("WineName", "name"), "vintage": ("Vintage", "year"), "region": ("Region", "name"),
    "country": ("Country", "name"), "appellation": ("Appelation", "name"), "grapes": ("Varieties", "list"),
}


def cells(rows: DataFrame, fields: dict[str, tuple[str, str]] = FIELDS, threshold: float = THRESHOLD, truth: str = "truth", pred: str = "pred", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """A row for each scored cell: the kept columns, pos, field, truth, found, sim, hit. One projection, no shuffle; unscored cells are left out."""
    of = lambda name, key: F.col(f"`{name}`.`{key}`").cast("string")
    each = [F.struct(F.lit(i).alias("pos"), F.lit(key).alias("field"), F.lit(kind).alias("kind"), of(truth, key).alias("truth"), of(pred, app).alias("found")) for i, (key, (app, kind)) in enumerate(fields.items())]
    kept = [k.split(".")[-1] for k in keep]
    filled = F.filter(F.array(*each), lambda c: F.coalesce(c["truth"], F.lit("")) != "")  # before anything is compared
    out = rows.select(*keep, F.explode(filled).alias("c")).select(*kept, "c.*")
    sim = None
    for kind in dict.fromkeys(k for _, k in fields.values()):
        mine = field_similarity(kind, F.col("truth"), F.col("found"))
        sim = F.when(F.col("kind") == kind, mine) if sim is None else sim.when(F.col("kind") == kind, mine)
    out = out.select(*kept, "pos", "field", "truth", "found", sim.alias("sim")).where("sim is not null")
    return out.withColumn("hit", F.col("sim") >= threshold)


def by_field(scored: DataFrame, fields: dict[str, tuple[str, str]] = FIELDS) -> DataFrame:
    """n, hits, acc and mean_sim for every field, those without truth too (null acc)."""
    spark = scored.sparkSession
    names = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "pos int, field string")
    sums = scored.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"), F.avg("sim").alias("mean_sim"))
    return names.join(F.broadcast(sums), "field", "left").select("pos", "field", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"), (F.col("hits") / F.col("n")).alias("acc"), "mean_sim")


def overall(scored: DataFrame) -> DataFrame:
    """Hits over scored cells, not the mean of the fields' means."""
    return scored.agg(F.count(F.lit(1)).alias("scored"), F.sum(F.col("hit").cast("long")).alias("hits")).withColumn("acc", F.when(F.col("scored") > 0, F.col("hits") / F.col("scored")))


def by_row(scored: DataFrame, key: str = "file") -> DataFrame:
    """n, hits, acc and the misses in the order of the fields."""
    miss = F.when(~F.col("hit"), F.struct("pos", F.concat(F.col("field"), F.lit(': "'), F.col("truth"), F.lit('" ≠ "'), F.coalesce("found", F.lit("")), F.lit('"')).alias("m")))
    out = scored.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"), F.sort_array(F.collect_list(miss)).alias("x"))
    return out.select(key, "n", "hits", (F.col("hits") / F.col("n")).alias("acc"), F.transform("x", lambda x: x["m"]).alias("misses"))


def worst(per_row: DataFrame, n: int = 10, then: str = "file") -> DataFrame:
    """The n least accurate rows; more misses first among equals, then by the given column."""
    return per_row.where("n > 0").orderBy("acc", F.desc(F.size("misses")), then).limit(n)


def by_source(scored: DataFrame, source: str = "source") -> DataFrame:
    """by_field's sums for each source; nothing where there is only one."""
    named = F.coalesce(F.when(F.col(source) != "", F.col(source)), F.lit("unspecified"))
    sums = scored.groupBy(named.alias("source"), "field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"), F.avg("sim").alias("mean_sim"))
    several = sums.agg((F.min("source") != F.max("source")).alias("several"))
    return sums.crossJoin(F.broadcast(several)).where("several").drop("several")


def percent(x: Column) -> Column:
    """Four places; a dash for null. Halves go up."""
    return F.when(x.isNull(), F.lit("   —")).otherwise(F.lpad(F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%")), 4, " "))


def label_counts(rows: DataFrame, truth: list[str]) -> tuple[int, int]:
    """(rows, labelled rows): a row is labelled if one of its truth columns holds more than white space."""
    held = F.lit(False)
    for c in truth:
        held = held | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(held, 1)).alias("k")).first()
    return found["n"], found["k"]


def table_text(fields: DataFrame, n_rows: int, n_labelled: int, label: str = "") -> DataFrame:
    """The report as one text: a heading, the totals and a line for each field that has truth. fields: by_field's seven rows."""
    line = F.concat(F.rpad("field", 12, " "), F.lit(" "), F.lpad(F.col("n").cast("string"), 3, " "), F.lit("  "), percent(F.col("acc")), F.lit("  "), percent(F.col("mean_sim")))
    lines = F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("pos", line.alias("line")))))
    rows = f"rows: {n_rows}" + ("" if n_rows == n_labelled else f" ({n_labelled} labelled)")
    total = F.sum("n")
    head = F.concat(F.lit(f"{rows}   scored fields: "), total.cast("string"), F.lit("   overall: "), percent(F.when(total > 0, F.sum("hits") / total)))
    return fields.agg(F.concat_ws("\n", *([F.lit(label)] if label else []), head, F.lit("field         n   acc   sim"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("report"))


def upper_median(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """By group, the value at place floor(n / 2), from 0, of the sorted ones: the upper of two middle values. Null values are left out.

    Counts by value meet in the window, not the rows themselves."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    up_to = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = counts.withColumn("__c", F.sum("__n").over(up_to)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    return at.where(F.col("__c") > F.floor(F.col("__all") / 2)).groupBy(*by).agg(F.min(value).alias("upper_median"))
