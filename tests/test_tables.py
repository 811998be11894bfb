import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.operators import notes, scoring, tables


def truth_rows(spark):
    none = dict.fromkeys(["winery", "wine", "vintage", "region", "country", "appellation", "grapes", "source"])
    pred = dict.fromkeys(["Winemaker", "WineName", "Vintage", "Region", "Country", "Appelation", "Varieties"])
    rows = [
        ("a", {**none, "winery": "Château Margaux", "vintage": "2015", "source": "x"}, {**pred, "Winemaker": "Margaux", "Vintage": "2015 "}),
        ("b", {**none, "winery": "Ausone", "wine": "Grand", "region": "", "grapes": "Merlot, Syrah"}, {**pred, "Winemaker": "Latour", "Varieties": "syrah & merlot"}),
        ("c", none, pred),
    ]
    truth = "struct<" + ",".join(f"{k}:string" for k in none) + ">"
    return spark.createDataFrame(rows, f"file string, truth {truth}, pred struct<{','.join(f'{k}:string' for k in pred)}>")


def test_scores(spark):
    cells = scoring.cells(truth_rows(spark), keep=("file", "truth.source"))
    by = {r["field"]: r for r in scoring.by_field(cells).collect()}
    assert (by["winery"]["n"], by["winery"]["hits"]) == (2, 1)
    assert (by["vintage"]["hits"], by["region"]["n"], by["region"]["acc"], by["grapes"]["mean_sim"]) == (1, 0, None, 1.0)
    total = scoring.overall(cells).first()
    assert (total["scored"], total["hits"]) == (5, 3)
    rows = {r["file"]: r for r in scoring.by_row(cells).collect()}
    assert set(rows) == {"a", "b"} and rows["b"]["misses"] == ['winery: "Ausone" ≠ "Latour"', 'wine: "Grand" ≠ ""']
    assert [r["file"] for r in scoring.worst(scoring.by_row(cells), 1).collect()] == ["b"]
    assert {r["source"] for r in scoring.by_source(cells).collect()} == {"x", "unspecified"}
    assert scoring.by_source(cells.where("file = 'a'")).count() == 0
    report = scoring.table_text(scoring.by_field(cells), 3, 2, "run").first()["report"]
    assert report.split("\n")[:3] == ["run", "rows: 3 (2 labelled)   scored fields: 5   overall:  60%", "field         n   acc   sim"]
    assert "winery         2   50%" in report and "region" not in report


def test_truth_scored_against_itself_is_perfect(spark):
    same = truth_rows(spark).withColumn("pred", F.struct(*[F.col(f"truth.{k}").alias(app) for k, (app, _) in scoring.FIELDS.items()]))
    assert scoring.overall(scoring.cells(same)).first()["acc"] == 1.0


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 7), ("b", None)], "k string, v long")
    assert {r["k"]: r["upper_median"] for r in scoring.upper_median(df, "v", "k").collect()} == {"a": 3, "b": 7}


def test_upsert_keeps_created(spark):
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 2, "y")], "id string, created long, updated long, v string")
    new = spark.createDataFrame([("a", "z"), ("c", "w")], "id string, v string")
    got = {r["id"]: (r["created"], r["updated"], r["v"]) for r in tables.upserted(old, new, "id", F.lit(9).cast("long")).collect()}
    assert got == {"a": (1, 9, "z"), "b": (2, 2, "y"), "c": (9, 9, "w")}


def test_of_rows_with_one_key_the_last_counts(spark):
    old = spark.createDataFrame([("a", 1, 1, 0)], "id string, created long, updated long, v int")
    new = spark.createDataFrame([("a", 5, 1), ("a", 7, 3), ("a", 9, 2), ("b", 1, 1)], "id string, v int, seq int")
    got = tables.upserted(old, new, "id", F.lit(9).cast("long"), "seq")
    assert sorted((r["id"], r["created"], r["v"]) for r in got.collect()) == [("a", 1, 7), ("b", 9, 1)]
    runs = spark.createDataFrame([("x", 0), ("y", 0)], "k string, truth int")
    truth = spark.createDataFrame([("x", 4, 1), ("x", 2, 2), ("z", 1, 1)], "k string, truth int, line int")
    assert sorted(map(tuple, tables.refreshed(runs, truth, "k", "truth", "line").select("k", "truth").collect())) == [("x", 2), ("y", 0)]


def test_label_counts(spark):
    rows = spark.createDataFrame([("a", None), (" ", ""), (None, "b"), (None, None)], "winery string, wine string")
    assert scoring.label_counts(rows, ["winery", "wine"]) == (4, 2)
    assert scoring.label_counts(rows.where("wine = 'none'"), ["wine"]) == (0, 0)


def test_replaced_keeps_null_sources(spark):
    old = spark.createDataFrame([(1, "s"), (2, None), (3, "t")], "id long, source string")
    assert sorted(r["id"] for r in tables.replaced(old, spark.createDataFrame([(4, "s")], old.schema), "source", "s").collect()) == [2, 3, 4]


def test_exploded_ids(spark):
    rows = spark.createDataFrame([("x/1.jpg; 2|9", "A")], "ids string, name string").withColumn("ids", F.regexp_replace("ids", " ", ""))
    files = spark.createDataFrame([("1.jpg",), ("1.png",), ("2.jpg",)], "f string")
    assert sorted(r["file"] for r in tables.exploded_ids(rows, "ids", files, "f").collect()) == ["1.png", "2.jpg"]


def test_column_mapping():
    guesses = {"file": ["file", "image"], "wine": ["wine_name", "title"], "year": ["vintage"]}
    assert tables.mapped_columns(["Image", "Wine Name", "x"], guesses) == {"file": "Image", "wine": "Wine Name"}
    assert tables.mapped_columns(["Image", "Wine Name", "x"], guesses, {"x": "wine"}) == {"file": "Image", "wine": "x"}


def test_debounce_gap_is_exclusive(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0, "a"), (1, t0 + dt.timedelta(milliseconds=400), "b"), (1, t0 + dt.timedelta(milliseconds=801), "c")]
    got = tables.debounced(spark.createDataFrame(rows, "k long, ts timestamp, v string"), "k", "ts", "v").orderBy("first_ts").collect()
    assert [(r["n_events"], r["v"]) for r in got] == [(2, "b"), (1, "c")]


def test_numbering_skips_taken_names(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "B")], "id long, base string")
    taken = spark.createDataFrame([("A",), ("A 3",), ("Axe 2",)], "name string")
    assert [r["name"] for r in tables.numbered(rows, "base", ["id"], taken).orderBy("id").collect()] == ["A 2", "A 4", "A 5", "B"]
    with pytest.raises(Exception, match="too many"):
        tables.numbered(rows, "base", ["id"], most=2).collect()


def test_swap_needs_both_ways(spark):
    df = spark.createDataFrame([("12", "3"), ("abc", "3")], "a string, b string")
    got = tables.swapped(df, "a", "b", "text", "number").collect()
    assert [(r["a"], r["b"]) for r in got] == [("3", "12"), ("abc", "3")]


def test_late_answers_are_dropped(spark):
    req = spark.createDataFrame([(1, 2), (2, 1)], "id long, version long")
    ans = spark.createDataFrame([(1, 1, "old"), (2, 1, "new")], "id long, version long, city string")
    assert {r["id"]: r["city"] for r in tables.current(req, ans, "id", "version").collect()} == {1: None, 2: "new"}


def test_shortfall(spark):
    got = spark.createDataFrame([(1000, 100, 700), (1000, 500, 700), (None, 5, 7)], "q long, u long, n long").select(tables.shortfall(F.col("q"), F.col("u"), F.col("n")).alias("s")).collect()
    assert [r["s"] for r in got] == [0, 305, 0]


def test_note(spark):
    df = spark.createDataFrame([("Penfolds", "Bin 389", "2018", " lovely ", True, "RAW\n")], "Winemaker string, WineName string, Vintage string, tastingNote string, has_back boolean, ocrText string")
    lines = df.select(notes.note(df).alias("n")).first()["n"].split("\n")
    assert lines[:5] == ["---", "fileClass: Wine", 'Name: "Penfolds - Bin 389 - 2018"', 'Winemaker: "Penfolds"', 'WineName: "Bin 389"']
    assert lines.index("---", 1) == 28 and "Stars: --" in lines and "Inventory: 0" in lines and "Price:" in lines
    assert lines[29:] == [
        "", "## Tasting note", "lovely", "", "## Label", "Label:: ![[Penfolds - Bin 389 - 2018.jpg]]", "", "## Back label",
        "Back label:: ![[Penfolds - Bin 389 - 2018 - back.jpg]]", "", "## Food", "Food::", "", "%%",
        "Recognised label text, kept in case a field above needs correcting.", "", "RAW", "%%", "",
    ]


def test_parcels(spark):
    def parcel(i, base, folder="n/"):
        files = [(f"p/q/{base}.jpg", "data:image/jpeg;base64,aGk=")]
        return (i, folder + base + ".md", f"see ![[{base}.jpg]] $& ![[other.jpg]]", files)

    rows = [parcel(1, "X $1"), parcel(2, "X $1"), parcel(3, "Y")]
    df = spark.createDataFrame(rows, "id long, path string, content string, files array<struct<path:string,data:string>>")
    df = df.select("id", notes.parcel(F.col("path"), F.col("content"), F.col("files")).alias("json"))
    taken = spark.createDataFrame([("p/q/X $1.jpg",), ("n/Y 2.md",), ("n/Z.md",)], "path string")
    got = notes.unpacked(df, "json", taken, "id").orderBy("id", "seq").collect()
    assert [(r["id"], r["path"]) for r in got] == [(1, "p/q/X $1 2.jpg"), (1, "n/X $1 2.md"), (2, "p/q/X $1 3.jpg"), (2, "n/X $1 3.md"), (3, "p/q/Y.jpg"), (3, "n/Y.md")]
    assert bytes(got[0]["data"]) == b"hi" and got[1]["content"] == "see ![[X $1 2.jpg]] $& ![[other.jpg]]"
    with pytest.raises(Exception, match="nothing to unpack"):
        notes.unpacked(spark.createDataFrame([(1, '{"v":2}')], "id long, json string"), "json", taken, "id").collect()


def test_folders_parents_first(spark):
    assert spark.range(1).select(notes.folders(F.array(F.lit("a/b/c.md"), F.lit("a/d.jpg"), F.lit("e.md"))).alias("f")).first()["f"] == ["a", "a/b"]
