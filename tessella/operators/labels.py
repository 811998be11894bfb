"""A label's recognised lines to its fields. One row a label, its lines an array: no step shuffles, and each claims lines that later ones skip."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.matching import find_in, gram_sets, let, tolerance_of
from tessella.functions.text import constants, contains, leftover, normalize, normalized, tidy, trimmed
from tessella.operators import classify as C
from tessella.operators import lexicon as lex

LINE = "struct<text:string,height:double,top:double,left:double,right:double,confidence:double>"
LINES = f"array<{LINE}>"
LINE_ARROW = pa.struct([("text", pa.string())] + [(f, pa.float64()) for f in ("height", "top", "left", "right", "confidence")])
OUT = ["Vintage", "Varieties", "Appelation", "Country", "Region", "Vineyard", "Type", "Winemaker", "WineName"]


# ---- the dictionary: one row ----------------------------------------------------------------------------------------


def dictionary(spark, places: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """The word tables as one row of arrays, longest name first. It is as large as the dictionary, so it can be broadcast."""

    def ranked(rows, schema):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord int, {schema}").withColumn("needle", normalize(F.col("name")))
        size = F.struct((-F.length("needle")).alias("l"), "ord")
        df = df.withColumns({"squashed": F.replace(F.col("needle"), F.lit(" "), F.lit("")), "k": F.size(F.split("needle", " "))})
        n = F.length("needle")
        df = df.withColumn("tol", F.when(n <= 5, tolerance_of(5)).when(n <= 9, tolerance_of(9)).otherwise(tolerance_of(10)))
        kept = [c for c in df.columns if c != "ord"]
        return df.agg(F.transform(F.sort_array(F.collect_list(F.struct(size.alias("s"), F.struct(*kept).alias("e")))), lambda x: x["e"]).alias("a"))

    p = ranked(places or lex.places(), "name string, country string, region string").toDF("places")
    c = ranked(lex.countries(), "name string, country string").toDF("countries")
    g = ranked(lex.grapes(), "name string, colour string").toDF("grapes")
    return p.crossJoin(c).crossJoin(g).withColumn("known", F.concat(F.transform("grapes", lambda e: e["needle"]), F.transform("countries", lambda e: e["needle"])))


# ---- lines ----------------------------------------------------------------------------------------------------------


def source_lines(text: Column, lines: Column) -> Column:
    """The boxed lines if there are any, else the text's lines without height, each as far down as its number; blank ones go."""
    num = lambda x: x.cast("double")
    plain = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda t, i: F.struct(trimmed(t).alias("text"), F.lit(0.0).alias("height"), num(i).alias("top"), num(F.lit(None)).alias("left"), num(F.lit(None)).alias("right"), num(F.lit(None)).alias("confidence")))
    return F.filter(F.when(F.size(F.coalesce(lines, F.array().cast(LINES))) > 0, lines.cast(LINES)).otherwise(plain), lambda x: trimmed(F.coalesce(x["text"], F.lit(""))) != "")


def _side_by_side(a: dict, b: dict) -> bool:
    if not a["height"] or not b["height"] or not 0.6 <= a["height"] / b["height"] <= 1.67:
        return False
    shared = min(a["top"] + a["height"], b["top"] + b["height"]) - max(a["top"], b["top"])
    apart = max(a["left"], b["left"]) - min(a["right"], b["right"])
    return shared >= 0.5 * min(a["height"], b["height"]) and apart < 2.5 * max(a["height"], b["height"])


def assembled_rows(lines: list[dict]) -> list[dict]:
    """Pieces of one printed row put together. A row grows from its first piece by one backward look over the rest, so the order counts."""
    if not any((x["right"] or 0) > (x["left"] or 0) for x in lines):
        return lines
    rows = [x for x in lines if x["apart"]]
    open_ = [x for x in lines if not x["apart"]]
    while open_:
        row, rest = [open_[0]], []
        for piece in reversed(open_[1:]):
            (row if any(_side_by_side(x, piece) for x in row) else rest).append(piece)
        open_ = rest[::-1]
        row.sort(key=lambda x: x["left"] or 0)
        rows.append({
            "text": " ".join(" ".join(x["text"] for x in row).split()), "height": max(x["height"] for x in row), "top": min(x["top"] for x in row),
            "left": min(x["left"] or 0 for x in row), "right": max(x["right"] or 0 for x in row), "confidence": min(x["confidence"] or 0 for x in row),
        })
    return sorted(rows, key=lambda x: x["top"])


def with_rows(df: DataFrame, column: str = "lines") -> DataFrame:
    """The column's pieces assembled; it wants them with a flag `apart`. Greedy and order-bound, so it runs over Arrow batches."""
    own = df.columns
    at = own.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [assembled_rows(x) for x in batch.column(at).to_pylist()]
            kept = [[{f.name: x[f.name] for f in LINE_ARROW} for x in rows] for rows in done]
            columns = list(batch.columns)
            columns[at] = pa.array(kept, pa.list_(LINE_ARROW))
            yield pa.RecordBatch.from_arrays(columns, own)

    kinds = ", ".join(f"`{c}` {LINES if c == column else t}" for c, t in df.dtypes)
    return df.mapInArrow(run, kinds)


def merged_lines(lines: Column, field_like) -> Column:
    """Wrapped lines joined to the one above: a fold that keeps the first one's place, so a third rarely joins. field_like: text -> Column."""
    marked = F.transform(lines, lambda x: F.struct(x.alias("x"), field_like(x["text"]).alias("own")))

    def step(out: Column, line: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        a, b = last["x"], line["x"]
        tall = (F.coalesce(a["height"], F.lit(0.0)) > 0) & (F.coalesce(b["height"], F.lit(0.0)) > 0)
        ratio, gap = a["height"] / b["height"], b["top"] - (a["top"] + a["height"])
        sure = (F.coalesce(a["confidence"], F.lit(100.0)) >= 50) & (F.coalesce(b["confidence"], F.lit(100.0)) >= 50)
        near = (ratio >= 0.7) & (ratio <= 1.43) & (gap >= -0.5 * a["height"]) & (gap < 0.5 * a["height"])
        joins = F.when(F.size(out) == 0, False).when(~tall | last["own"] | line["own"], False).otherwise(sure & near)
        text = F.concat(a["text"], F.lit(" "), b["text"])
        both = F.struct(F.struct(text.alias("text"), F.greatest(a["height"], b["height"]).alias("height"), *[a[f].alias(f) for f in ("top", "left", "right", "confidence")]).alias("x"), field_like(text).alias("own"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(out, F.array(line)))

    folded = F.transform(F.aggregate(marked, F.array().cast(f"array<struct<x:{LINE},own:boolean>>"), step), lambda m: m["x"])
    return F.when(F.exists(lines, lambda x: F.coalesce(x["height"], F.lit(0.0)) > 0), folded).otherwise(lines)


# ---- small helpers over the array of lines ----------------------------------------------------------------------------


def _numbered(lines: Column, make) -> Column:
    """make(line, number) for each; nulls dropped."""
    return F.filter(F.transform(lines, make), lambda x: x.isNotNull())


def _first(found: Column) -> Column:
    return F.get(found, 0)


def _tallest(lines: Column, claimed: Column, accept) -> Column:
    """The tallest accepted line that isn't claimed, the first of equals: a struct (up, i, text)."""
    make = lambda x, i: F.when(~F.array_contains(claimed, i) & accept(x), F.struct((-F.coalesce(x["height"], F.lit(0.0))).alias("up"), i.alias("i"), x["text"].alias("text")))
    return F.array_min(_numbered(lines, make))


def _with(lines: Column, test) -> Column:
    """Numbers of the lines that pass."""
    return _numbered(lines, lambda x, i: F.when(test(x), i))


def _holding(lines: Column, needles: Column) -> Column:
    return _with(lines, lambda x: F.exists(needles, lambda n: contains(x["norm"], n)))


# ---- the label ------------------------------------------------------------------------------------------------------


def label_fields(labels: DataFrame, year: int, places: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """A row for each label: its own columns without text and lines, the fields OUT (null where nothing was found) and filled, their names.

    labels: text (string) and lines (array of LINE; may be null or empty). year: the current one; a vintage is at most the next.
    Labels are independent rows; the dictionary is broadcast as one row; only the assembly of rows leaves the JVM, in Arrow batches."""
    own = [c for c in labels.columns if c not in ("text", "lines")]
    tables = F.broadcast(dictionary(labels.sparkSession, places))
    df = labels.select(*own, source_lines(F.col("text"), F.col("lines")).alias("lines"))
    apart = lambda x: C.is_junk(x["text"], x["confidence"]) | C.is_noise(x["text"])
    df = df.withColumn("lines", F.transform("lines", lambda x: F.struct(*[x[f.name].alias(f.name) for f in LINE_ARROW], apart(x).alias("apart"))))
    df = with_rows(df).crossJoin(tables)
    df = df.withColumn("lines", merged_lines(F.col("lines"), lambda t: C.is_field_like(t, F.col("places"), F.col("known"))))

    def featured(x: Column) -> Column:
        n = normalize(x["text"])
        return F.struct(*[x[f.name].alias(f.name) for f in LINE_ARROW], n.alias("norm"), C.is_noise(x["text"]).alias("noise"))

    df = df.withColumn("lines", F.transform("lines", featured))

    def judged(x: Column) -> Column:
        kept = [x[f.name].alias(f.name) for f in LINE_ARROW] + [x["norm"].alias("norm"), x["noise"].alias("noise")]
        more = {"namely": C.looks_like_name(x["text"], x["confidence"], x["noise"]), "place": C.is_place_only(x["norm"], F.col("places")), "tail": C.is_producer_tail(x["norm"]), "prose": C.is_prose(x["norm"]), "mark": x["text"].rlike(lex.pattern(lex.APPELLATION_MARKER))}
        return F.struct(*kept, *[v.alias(k) for k, v in more.items()])

    df = df.withColumn("lines", F.transform("lines", judged)).withColumn("full", F.array_join(F.transform("lines", lambda x: x["norm"]), " "))
    lines, full = F.col("lines"), F.col("full")
    df = df.withColumn("claimed", _with(lines, lambda x: x["noise"]))
    df = _vintage(df, year)
    df = _varieties(df)
    df = _appellation(df)
    # Country by its words if the place gave none.
    found = _first(F.filter("countries", lambda e: contains(full, e["needle"])))
    df = df.withColumn("by_word", F.when(F.coalesce(F.col("place.country"), F.lit("")) == "", found))
    df = df.withColumn("claimed", F.when(F.col("by_word").isNotNull(), F.concat("claimed", _holding(lines, F.array(F.col("by_word.needle"))))).otherwise(F.col("claimed")))
    df = df.withColumn("Country", F.coalesce(F.when(F.col("place.country") != "", F.col("place.country")), F.col("by_word.country"))).withColumn("Region", F.when(F.col("place.region") != "", F.col("place.region")))
    df = _vineyard(df)
    df = _type(df)
    df = _winemaker(df)
    df = _wine_name(df)
    return df.select(*own, *OUT, F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in OUT]), lambda c: c.isNotNull()).alias("filled"))


def _claim(df: DataFrame, *numbers: Column) -> DataFrame:
    return df.withColumn("claimed", F.concat("claimed", F.filter(F.array(*[n.cast("int") for n in numbers]), lambda i: i.isNotNull())))


def _vintage(df: DataFrame, year: int) -> DataFrame:
    """A year alone on its line, then the tallest, then the first; a year after a founding word is the estate's."""
    found = "([^ ]*) ?(?<![a-z0-9])((?:19|20)[0-9]{2})(?![a-z0-9])"

    def of(x: Column, i: Column) -> Column:
        years, before = F.regexp_extract_all(x["norm"], F.lit(found), F.lit(2)), F.regexp_extract_all(x["norm"], F.lit(found), F.lit(1))
        each = F.transform(years, lambda y, k: F.struct((x["norm"] != y).alias("shared"), (-F.coalesce(x["height"], F.lit(0.0))).alias("up"), i.alias("i"), k.alias("k"), y.alias("year"), F.get(before, k).alias("before")))
        return F.filter(each, lambda c: (c["year"].cast("int") <= year + 1) & ~F.array_contains(constants(lex.FOUNDING_WORDS), c["before"]))

    df = df.withColumn("v", F.array_min(F.flatten(F.transform("lines", of))))
    return _claim(df.withColumn("Vintage", F.col("v.year")), F.col("v.i"))


def _varieties(df: DataFrame) -> DataFrame:
    """Grapes by longest name first, none inside another's name; listed as printed. Words of a printed place aren't misread grapes."""
    named = F.flatten(F.transform(F.filter("places", lambda p: contains(F.col("full"), p["needle"])), lambda p: F.split(p["needle"], " ")))
    # Bound, not columns: a projection that is named once, inside a lambda, would be computed again for every grape.
    withheld, sets = F.concat(constants(lex.LOOKALIKES), named), gram_sets(F.split("full", " "), 3)
    hit = lambda g, s, w: F.struct(find_in(s, g, w).alias("at"), g["needle"].alias("needle"), g["name"].alias("name"), g["colour"].alias("colour"))
    hits = let(sets, lambda s: let(withheld, lambda w: F.filter(F.transform("grapes", lambda g: hit(g, s, w)), lambda h: h["at"] >= 0)))
    df = df.withColumn("hits", hits)
    none = F.array().cast("array<struct<at:int,needle:string,name:string,colour:string>>")
    df = df.withColumn("hits", F.aggregate("hits", none, lambda a, h: F.when(F.exists(a, lambda o: o["needle"].contains(h["needle"])), a).otherwise(F.concat(a, F.array(h)))))
    df = df.withColumn("hits", F.transform(F.sort_array(F.transform("hits", lambda h, i: F.struct(h["at"].alias("at"), i.alias("i"), h.alias("h")))), lambda s: s["h"]))
    needles = F.transform("hits", lambda h: h["needle"])
    df = df.withColumn("needles", needles)
    bare = lambda x: F.exists("needles", lambda n: contains(x["norm"], n)) & ~x["prose"] & ~x["noise"] & (leftover(x["norm"], F.col("needles"), constants(lex.DESCRIPTORS)) <= 2)
    df = df.withColumn("grape_line", _tallest(F.col("lines"), F.array().cast("array<int>"), bare))
    df = df.withColumn("claimed", F.concat("claimed", _holding(F.col("lines"), F.col("needles"))))
    return df.withColumn("Varieties", F.when(F.size("hits") > 0, F.array_join(F.transform("hits", lambda h: h["name"]), ", ")))


def _appellation(df: DataFrame) -> DataFrame:
    """On lines that announce one: the fuller name, the name, or what the formula captures; then anywhere; then with letters wrong."""
    lines = F.col("lines")
    where = lambda needle, test=lambda x: F.lit(True): _first(_with(lines, lambda x: test(x) & contains(x["norm"], needle)))
    result = lambda name, country, region, i: F.struct(name.alias("name"), country.alias("country"), region.alias("region"), i.cast("int").alias("i"))
    marks = lambda x: x["mark"]

    def hit(test) -> Column:
        e = _first(F.filter("places", lambda p: F.exists(lines, lambda x: test(x) & contains(x["norm"], p["needle"]))))
        return F.when(e.isNotNull(), result(e["name"], e["country"], e["region"], where(e["needle"], test)))

    def fuller(word: Column) -> Column:
        e = _first(F.filter("places", lambda p: (p["needle"] != word) & contains(p["needle"], word) & F.exists(lines, lambda x: contains(x["norm"], p["needle"]))))
        return F.when(e.isNotNull(), result(e["name"], e["country"], e["region"], where(e["needle"])))

    df = df.withColumn("declared", hit(marks))

    def formula(x: Column, i: Column) -> Column:
        french = F.regexp_extract(x["text"], lex.pattern(lex.DECLARED_FRENCH), 1)
        short = F.regexp_extract(x["text"], lex.pattern(lex.DECLARED_SHORT), 1)
        raw = F.when(french != "", F.struct(french.alias("raw"), F.lit(True).alias("french"), i.alias("i"))).when(F.length(trimmed(short)) > 2, F.struct(short.alias("raw"), F.lit(False).alias("french"), i.alias("i")))
        return F.when(marks(x), raw)

    df = df.withColumn("formula", _first(_numbered(lines, formula)))
    plain = F.when(F.col("formula").isNotNull(), result(tidy(F.col("formula.raw")), F.lit(""), F.lit(""), F.col("formula.i")))
    close = _first(_numbered(lines, lambda x, i: let(C.nearest_place(x["norm"], F.col("places")), lambda e: F.when(e.isNotNull(), F.struct(e.alias("e"), i.alias("i"))))))
    df = df.withColumn("close", close)
    fuzzy = F.when(F.col("close").isNotNull(), result(F.col("close.e.name"), F.col("close.e.country"), F.col("close.e.region"), F.col("close.i")))
    df = df.withColumn("word", F.coalesce(normalize(F.col("declared.name")), F.lit(""))).withColumn("spoken", F.when(F.col("formula.french"), normalize(F.col("formula.raw"))))
    place = F.when(F.col("declared").isNotNull(), F.coalesce(fuller(F.col("word")), F.col("declared"))).when(F.col("formula").isNotNull(), F.coalesce(F.when(F.col("spoken").isNotNull(), fuller(F.col("spoken"))), plain))
    df = df.withColumn("place", F.coalesce(place, hit(lambda x: F.lit(True)), fuzzy)).withColumn("Appelation", F.col("place.name"))
    line = F.get(lines, F.col("place.i"))
    alone = ~marks(line) & (leftover(line["norm"], F.array(normalize(F.col("place.name"))), constants(lex.DESCRIPTORS)) <= 1)
    df = df.withColumn("place_line", F.when(F.col("place").isNotNull() & alone, F.struct((-F.coalesce(line["height"], F.lit(0.0))).alias("up"), F.col("place.i").alias("i"), F.col("place.name").alias("text"))))
    return _claim(df, F.col("place.i"))


def _vineyard(df: DataFrame) -> DataFrame:
    captured = lambda x: F.coalesce(*[F.when(F.length(trimmed(c)) > 2, c) for c in (F.regexp_extract(x["text"], lex.pattern(p), 1) for p in lex.VINEYARD_PATTERNS)])
    found = _first(_numbered(F.col("lines"), lambda x, i: F.when(~F.array_contains("claimed", i) & captured(x).isNotNull(), F.struct(captured(x).alias("raw"), i.alias("i")))))
    df = df.withColumn("vine", found).withColumn("Vineyard", tidy(F.col("vine.raw")))
    return _claim(df, F.col("vine.i"))


def _type(df: DataFrame) -> DataFrame:
    """By the words, in the order of the types; else by the grapes, if they agree."""
    out = None
    for name, needles in lex.TYPE_WORDS.items():
        table = constants(map(normalized, needles))
        test = F.exists(table, lambda n: contains(F.col("full"), n))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    colours = F.array_distinct(F.transform("hits", lambda h: h["colour"]))
    return df.withColumn("Type", F.coalesce(out, F.when(F.size(colours) == 1, F.get(colours, 0))))


def _winemaker(df: DataFrame) -> DataFrame:
    """By a naming word, in the order of the lines; else the tallest line that could be a name."""
    lines, claimed = F.col("lines"), F.col("claimed")
    starts = constants(map(normalized, lex.PRODUCER_PREFIXES))
    ends = constants(map(normalized, lex.PRODUCER_SUFFIXES))

    def rule(x: Column, i: Column) -> Column:
        above = F.get(lines, i - 1)
        takes = (i > 0) & ~F.array_contains(claimed, i - 1) & above["namely"] & ~above["place"]
        result = lambda name, at, also: F.struct(name.alias("name"), at.cast("int").alias("i"), also.cast("int").alias("also"))
        none = F.lit(None)
        tail = F.when(F.coalesce(takes, F.lit(False)), result(F.concat(tidy(above["text"]), F.lit(" "), tidy(x["text"])), i - 1, i))
        single = ~x["norm"].contains(" ")
        owner = single & x["norm"].rlike("[a-z]'s?$") & (F.length(x["norm"]) >= 5)
        naming = ~single & (F.exists(starts, lambda p: x["norm"].startswith(F.concat(p, F.lit(" ")))) | F.exists(ends, lambda s: x["norm"].endswith(F.concat(F.lit(" "), s))))
        return F.when(F.array_contains(claimed, i), none).when(x["tail"], tail).when(owner | naming, result(tidy(x["text"]), i, none))

    df = df.withColumn("rule", _first(_numbered(lines, rule)))
    df = df.withColumn("tall", _tallest(lines, claimed, lambda x: x["namely"] & ~x["place"] & ~x["tail"]))
    df = df.withColumn("Winemaker", F.coalesce(F.col("rule.name"), tidy(F.col("tall.text"))))
    return _claim(df, F.coalesce("rule.i", "tall.i"), F.col("rule.also"))


def _wine_name(df: DataFrame) -> DataFrame:
    """A line that opens like a cuvée's name; else the grape's or place's own line if it is at least 0.8 as tall as the tallest left."""
    lines, claimed = F.col("lines"), F.col("claimed")
    cuvee = _first(_numbered(lines, lambda x, i: F.when(~F.array_contains(claimed, i) & C.opens_cuvee(x["text"]), x["text"])))
    df = df.withColumn("cuvee", cuvee).withColumn("left", _tallest(lines, claimed, lambda x: x["namely"]))
    # Heights are negated in `up`.
    backed = F.coalesce(F.when(F.col("grape_line").isNotNull(), F.struct(F.col("grape_line.up").alias("up"), tidy(F.col("grape_line.text")).alias("name"))), F.when(F.col("place_line").isNotNull(), F.struct(F.col("place_line.up").alias("up"), F.col("place_line.text").alias("name"))))
    df = df.withColumn("backed", backed)
    by_size = F.when(F.col("left").isNull(), F.col("backed.name")).when(F.col("backed").isNotNull() & (-F.col("backed.up") >= -F.col("left.up") * 0.8), F.col("backed.name")).otherwise(tidy(F.col("left.text")))
    return df.withColumn("WineName", F.coalesce(tidy(F.col("cuvee")), by_size))
