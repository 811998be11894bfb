"""Keyed tables and sets of rows: semi and anti joins, unions, replacing, upserts, retention, debouncing, layered values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import stem, title, trimmed


def present_then_unlabelled(labels: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Label rows whose file is there, and a row of the key alone for each file without a label."""
    return labels.join(files.select(key), key, "left_semi").unionByName(files.select(key).join(labels, key, "left_anti"), allowMissingColumns=True)


def last_by(rows: DataFrame, key: str | list[str], order: str | Column) -> DataFrame:
    """The row of the greatest order for each key, by partial aggregation: no sort of a key's rows."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return found.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def refreshed(runs: DataFrame, truth: DataFrame, key: str, column: str, order: str | None = None) -> DataFrame:
    """runs with the column as truth now has it, else as the run recorded it. Of several truth rows of a key the last in the
    order of `order` counts; without it, or among equals, the one whose value is greatest."""
    rank = F.struct(*([F.col(order)] if order else []), F.col(column))
    now = truth.groupBy(F.col(key).alias("__k")).agg(F.max_by(column, rank).alias("__now")).withColumn("__there", F.lit(True))
    out = runs.join(now, runs[key] == F.col("__k"), "left")
    return out.withColumn(column, F.when(F.col("__there"), F.col("__now")).otherwise(F.col(column))).drop("__k", "__now", "__there")


def exploded_ids(rows: DataFrame, ids: str, files: DataFrame, name: str) -> DataFrame:
    """A row for each id in a cell of several (; or |) whose stem is a present file's; of files with one stem, the last name."""
    each = rows.withColumn("__stem", F.explode(F.split(F.coalesce(F.col(ids).cast("string"), F.lit("")), "[;|]"))).withColumn("__stem", stem(F.col("__stem"))).where("__stem <> ''")
    there = files.groupBy(stem(F.col(name)).alias("__stem")).agg(F.max(name).alias("file"))
    return each.join(there, "__stem").drop("__stem")


def mapped_columns(columns: list[str], guesses: dict[str, list[str]], override: dict[str, str] | None = None) -> dict[str, str]:
    """field -> column: what the override says, then the first guess that is there (lower case, - and space as _; the last of equals)."""
    import re

    there = {re.sub(r"[\s-]+", "_", c.lower().strip()): c for c in columns}
    named = {f: c for c, f in (override or {}).items() if f in guesses}
    return {f: named.get(f) or next(there[g] for g in guesses[f] if g in there) for f in guesses if f in named or any(g in there for g in guesses[f])}


def replaced(existing: DataFrame, new: DataFrame, column: str, value) -> DataFrame:
    """existing without the rows of the value, and then the new ones."""
    return existing.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new, allowMissingColumns=True)


def upserted(existing: DataFrame, new: DataFrame, key: str, now: Column, order: str | None = None) -> DataFrame:
    """Records put by key: created is kept from the row that was there, updated is now, the title is composed anew. Of several new
    rows of a key the last in the order of `order` is put; without it, or among equals, the one that is last as JSON."""
    rank = F.struct(*([F.col(order)] if order else []), F.to_json(F.struct(*new.columns)))
    new = new.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*new.columns), rank).alias("__row")).select(*[F.col(f"__row.`{c}`").alias(c) for c in new.columns])
    old = existing.select(F.col(key).alias("__k"), F.col("created").alias("__c"))
    put = new.join(old, new[key] == F.col("__k"), "left").withColumn("created", F.coalesce("__c", now)).withColumn("updated", now).drop("__k", "__c")
    return existing.join(new.select(key), key, "left_anti").unionByName(put, allowMissingColumns=True)


def drafts(events: DataFrame, key: str, ts: str, payload: list[str], gone: Column | None = None) -> DataFrame:
    """The state that last-write-wins events leave: created at the first since the last end, updated at the last; ended keys are out."""
    rows = events.withColumn("__gone", F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False))
    ends = rows.where("__gone").groupBy(key).agg(F.max(ts).alias("__end"))
    live = rows.where("not __gone").join(ends, key, "left").where(F.col("__end").isNull() | (F.col(ts) > F.col("__end")))
    return live.groupBy(key).agg(F.min(ts).alias("created"), F.max(ts).alias("updated"), *[F.max_by(c, ts).alias(c) for c in payload])


def newest(rows: DataFrame, ts: str, then: str, n: int = 20, by: list[str] | None = None) -> DataFrame:
    """The n newest rows of each group, or of all. Spark keeps only n for each group and task before the exchange."""
    order = [F.desc(ts), F.desc(then)]
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def debounced(events: DataFrame, key: str, ts: str, payload: str, gap: str = "INTERVAL 400 MILLISECONDS") -> DataFrame:
    """One write for each burst: events of a key at most `gap` apart, with the payload of the last."""
    w = Window.partitionBy(key).orderBy(ts)
    starts = F.when(F.col(ts) > F.lag(ts).over(w) + F.expr(gap), 1).otherwise(0)
    bursts = events.withColumn("__s", starts).withColumn("__b", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return bursts.groupBy(key, "__b").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_events"), F.max_by(payload, ts).alias(payload)).drop("__b")


def filled(value: Column, *others: Column) -> Column:
    """The value, or where it is blank the first other that isn't."""
    full = lambda x: F.when(trimmed(x) != "", x)
    return F.coalesce(full(value), *map(full, others))


def layered(*layers: Column) -> Column:
    """The last layer that has a value."""
    return F.coalesce(*reversed(layers))


def swapped(rows: DataFrame, a: str, b: str, kind_a: str, kind_b: str) -> DataFrame:
    """The two columns exchanged wherever either can hold the other's value."""

    def holds(kind: str, value: Column) -> Column:
        v = F.coalesce(trimmed(value), F.lit(""))
        fits = {"select": F.lit(False), "text": F.lit(True), "textarea": F.lit(True), "number": (v == "") | v.try_cast("double").isNotNull(), "date": (v == "") | v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")}
        return fits[kind]

    can = holds(kind_b, F.col(a)) & holds(kind_a, F.col(b))
    return rows.withColumns({a: F.when(can, F.col(b)).otherwise(F.col(a)), b: F.when(can, F.col(a)).otherwise(F.col(b))})


def numbered(rows: DataFrame, base: str, order: list[str], taken: DataFrame | None = None, most: int = 999) -> DataFrame:
    """Each row's own name: base, "base 2", "base 3" and so on, in order, names in `taken` (column name) left out.

    The n-th row of a base takes the n-th free number. Taken names are matched as "base" or "base number"."""
    rank = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    out = rows.withColumn("__rank", rank)
    if taken is None:
        number = F.col("__rank")
    else:
        # Numbers of a base that are taken, in order: the n-th free number is n plus the taken ones that it has to pass.
        t = taken.select(F.col("name").alias("__n")).distinct()
        bare = t.select(F.col("__n").alias("__base"), F.lit(1).alias("__k"))
        tail = F.regexp_extract("__n", "^(.*) ([2-9]|[1-9][0-9]{1,2})$", 2)
        suffixed = t.where(tail != "").select(F.regexp_extract("__n", "^(.*) ([2-9]|[1-9][0-9]{1,2})$", 1).alias("__base"), tail.cast("int").alias("__k"))
        used = bare.union(suffixed).groupBy("__base").agg(F.sort_array(F.collect_set("__k")).alias("__used"))  # at most 999 numbers
        out = out.join(used, out[base] == F.col("__base"), "left")
        number = F.aggregate(F.coalesce("__used", F.array().cast("array<int>")), F.col("__rank"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    out = out.withColumn("number", number).withColumn("name", F.when(F.col("number") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit(" "), F.col("number").cast("string"))))
    over = F.when(F.col("number") > most, F.raise_error(F.lit("too many rows with that name"))).otherwise(F.col("name"))
    return out.withColumn("name", over).drop("__rank", "__base", "__used")


def missing(required: DataFrame, cached: DataFrame, key: str, order: str) -> DataFrame:
    """What isn't cached, in order of need."""
    return required.join(cached.select(key), key, "left_anti").orderBy(order)


def current(requests: DataFrame, answers: DataFrame, key: str, version: str) -> DataFrame:
    """Answers to a key's current version only: a late answer to an older one is dropped."""
    return requests.join(answers, [key, version], "left")


def cache_first(wanted: DataFrame, cache: DataFrame, source: DataFrame, key: str, value: str, network_first: bool = False) -> DataFrame:
    """The cached value, else the source's; network_first: the other way round."""
    c, s = cache.select(key, F.col(value).alias("__c")), source.select(key, F.col(value).alias("__s"))
    first, second = ("__s", "__c") if network_first else ("__c", "__s")
    return wanted.join(c, key, "left").join(s, key, "left").withColumn(value, F.coalesce(first, second)).drop("__c", "__s")


def titled(rows: DataFrame, *parts: str) -> DataFrame:
    return rows.withColumn("title", title(*map(F.col, parts)))


def shortfall(quota: Column, usage: Column, needed: Column, headroom: float = 1.15) -> Column:
    """How many bytes there are too few, with some room to spare; 0 if the quota isn't known."""
    short = needed * headroom - (quota - F.coalesce(usage, F.lit(0)))
    return F.when(quota.isNull() | (short <= 0), F.lit(0)).otherwise(F.ceil(short)).cast("long")
