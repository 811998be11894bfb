"""Records as notes, parcels and files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import compose_name, percent_encoded, safe_name, trimmed, yaml_line


@dataclass(frozen=True)
class Field:
    key: str
    emit: str = "quoted"
    default: str = ""
    kind: str = "text"


#: A record's fields in the order of the note.
FIELDS = [
    Field("Winemaker"), Field("WineName"), Field("Vintage"), Field("Type"), Field("Varieties"), Field("Country"), Field("Region"),
    Field("Appelation"), Field("Vineyard"), Field("Style"), Field("Price", "bare", kind="number"), Field("PurchaseSource"), Field("PurchaseLink"),
    Field("PurchaseCountry"), Field("Stars", "bare", "--", "select"), Field("ValueForMoney", "bare", kind="number"), Field("Points", "bare", kind="number"),
    Field("Inventory", "bare", "0", "number"), Field("Buy", "bare", "0", "number"), Field("Buy date", "bare", kind="date"), Field("Drink date", "bare", kind="date"),
    Field("Drink coordinates"), Field("Drink city"), Field("Drink country"), Field("Drink venue"),
]
#: A note's headings and the line above the raw text.
TASTING, LABEL, BACK, FOOD = "Tasting note", "Label", "Back label", "Food"
RAW_TEXT = "Recognised label text, kept in case a field above needs correcting."
#: Characters that a parcel's photos share, in base64.
PARCEL_BUDGET = 800_000
PARCEL = "struct<v:int,note:struct<path:string,content:string>,files:array<struct<path:string,data:string>>>"


def _value(df: DataFrame, key: str) -> Column:
    return F.col(f"`{key}`") if key in df.columns else F.lit(None).cast("string")


def record_name(df: DataFrame) -> Column:
    return compose_name(*[_value(df, k) for k in ("Winemaker", "WineName", "Vintage")])


def frontmatter(df: DataFrame, kind: str = "Wine") -> Column:
    """All lines of a record, missing columns as blank."""
    lines = [yaml_line("fileClass", F.lit(kind), "literal"), yaml_line("Name", record_name(df), "quoted")]
    return F.concat_ws("\n", *lines, *[yaml_line(f.key, _value(df, f.key), f.emit, f.default) for f in FIELDS])


def file_names(base: Column) -> dict[str, Column]:
    return {"note": F.concat(base, F.lit(".md")), "label": F.concat(base, F.lit(".jpg")), "back": F.concat(base, F.lit(" - back.jpg")), "food": F.concat(base, F.lit(" - food.jpg"))}


def note(df: DataFrame, base: Column | None = None) -> Column:
    """The whole note: frontmatter, headings, embeds (columns has_back and has_food), and the raw text (ocrText) as a comment if there is any."""
    base = safe_name(record_name(df)) if base is None else base
    names = file_names(base)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in df.columns else F.lit(False)
    embed = lambda on, label, name: F.when(on, F.concat(F.lit(f"{label}:: ![["), name, F.lit("]]"))).otherwise(F.lit(f"{label}::"))
    parts = [
        F.lit("---"), frontmatter(df), F.lit("---"), F.lit(""), F.lit(f"## {TASTING}"), trimmed(F.coalesce(_value(df, "tastingNote"), F.lit(""))), F.lit(""),
        F.lit(f"## {LABEL}"), embed(F.lit(True), LABEL, names["label"]), F.lit(""),
        F.lit(f"## {BACK}"), embed(flag("has_back"), BACK, names["back"]), F.lit(""),
        F.lit(f"## {FOOD}"), embed(flag("has_food"), FOOD, names["food"]), F.lit(""),
    ]
    raw = trimmed(F.coalesce(_value(df, "ocrText"), F.lit("")))
    kept = F.concat(F.lit(f"\n%%\n{RAW_TEXT}\n\n"), raw, F.lit("\n%%\n"))
    return F.concat(F.concat_ws("\n", *parts), F.when(raw != "", kept).otherwise(F.lit("")))


def photo_budget(content: Column, n_photos: Column) -> Column:
    """Characters that each photo may take beside the note."""
    return F.when(n_photos > 0, F.floor((PARCEL_BUDGET - F.length(content)) / n_photos))


def parcel(path: Column, content: Column, files: Column) -> Column:
    """The JSON that another process unpacks. files: array<struct<path, data>>, data as a data URI."""
    return F.to_json(F.struct(F.lit(1).alias("v"), F.struct(path.alias("path"), content.alias("content")).alias("note"), files.alias("files")))


def data_uri(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def data_of(uri: Column) -> Column:
    """The bytes after the first comma."""
    return F.unbase64(F.regexp_replace(uri, "^[^,]*,", ""))


def macro_uri(vault: Column, choice: Column, scheme: str) -> Column:
    """The link that starts a macro of that choice in a vault, at the address that handles such links."""
    return F.concat(F.lit(f"{scheme}?vault="), percent_encoded(vault), F.lit("&choice="), percent_encoded(choice))


def unpacked(parcels: DataFrame, column: str, taken: DataFrame, order: str) -> DataFrame:
    """The files of each parcel: (order, seq, path, content, data); the note is the last of its parcel.

    Not a version-1 parcel: an error. One suffix (none, 2, 3 ...) for all files of a parcel, the first with which none of its
    paths is in `taken` (column path) or goes to an earlier parcel of the same name; embeds of renamed files are rewritten
    literally."""
    p = F.from_json(column, PARCEL)
    good = (F.col("p.v") == 1) & F.col("p.note").isNotNull()
    df = parcels.withColumn("p", p).withColumn("p", F.when(F.coalesce(good, F.lit(False)), F.col("p")).otherwise(F.raise_error(F.lit("nothing to unpack")).cast(PARCEL)))
    name = lambda x: F.substring_index(x, "/", -1)
    base = F.regexp_replace(name(F.col("p.note.path")), "\\.[^.]{2}$", "")
    files = F.coalesce("p.files", F.array().cast("array<struct<path:string,data:string>>"))
    df = df.select(order, "p", base.alias("base"), files.alias("files"), F.concat(F.transform(files, lambda f: f["path"]), F.array("p.note.path")).alias("paths"))
    # Which numbers of each base are taken by any of its paths: paths are matched by what stands before and after the number.
    wanted = df.select("base", F.explode("paths").alias("path")).distinct()
    used = wanted.select("base", "path", _prefix(F.col("path"), F.col("base")).alias("pre"), _suffix(F.col("path"), F.col("base")).alias("post"))
    folder = lambda x: F.regexp_extract(x, "^(.*/)?[^/]*$", 1)
    there = taken.select(F.col("path").alias("have")).withColumn("dir", folder(F.col("have")))
    hits = used.withColumn("dir", folder(F.col("path"))).join(there, "dir")
    number = F.regexp_extract(F.substr(F.col("have"), F.length("pre") + 1, F.length("have") - F.length("pre") - F.length("post")), "^ ([2-9]|[1-9][0-9]{1,2})$", 1)
    fits = F.col("have").startswith(F.col("pre")) & F.col("have").endswith(F.col("post")) & (F.length("have") >= F.length("pre") + F.length("post"))
    hits = hits.where(fits).withColumn("k", F.when(F.col("have") == F.col("path"), 1).otherwise(number.try_cast("int"))).where("k is not null")
    blocked = hits.groupBy("base").agg(F.sort_array(F.collect_set("k")).alias("used"))
    turn = F.row_number().over(Window.partitionBy("base").orderBy(order))
    df = df.withColumn("turn", turn).join(blocked, "base", "left")
    free = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.col("turn"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    df = df.withColumn("suffix", F.when(free == 1, F.lit("")).otherwise(F.concat(F.lit(" "), free.cast("string"))))
    renamed = lambda x: F.concat(_prefix(x, F.col("base")), F.col("suffix"), _suffix(x, F.col("base")))
    text = F.aggregate("files", F.col("p.note.content"), lambda c, f: F.replace(c, F.concat(F.lit("![["), name(f["path"]), F.lit("]]")), F.concat(F.lit("![["), name(renamed(f["path"])), F.lit("]]"))))
    photos = F.transform("files", lambda f, i: F.struct(i.alias("seq"), renamed(f["path"]).alias("path"), F.lit(None).cast("string").alias("content"), data_of(f["data"]).alias("data")))
    last = F.struct(F.size("files").alias("seq"), renamed(F.col("p.note.path")).alias("path"), text.alias("content"), F.lit(None).cast("binary").alias("data"))
    return df.select(order, F.explode(F.concat(photos, F.array(last))).alias("f")).select(order, "f.*")


def _prefix(path: Column, base: Column) -> Column:
    """The path up to and with the base in its last part."""
    name = F.substring_index(path, "/", -1)
    at = F.instr(name, base)
    return F.when(at > 0, F.substr(path, F.lit(1), F.length(path) - F.length(name) + at - 1 + F.length(base))).otherwise(path)


def _suffix(path: Column, base: Column) -> Column:
    return F.substr(path, F.length(_prefix(path, base)) + 1)


def folders(paths: Column) -> Column:
    """Every folder that the paths need, parents first, each once."""
    parts = lambda p: F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1)
    up = F.flatten(F.transform(paths, lambda p: F.transform(parts(p), lambda x, i: F.array_join(F.slice(parts(p), 1, i + 1), "/"))))
    return F.sort_array(F.array_distinct(up))
