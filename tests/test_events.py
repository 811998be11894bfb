from pyspark.sql import functions as F

from tessella.operators import events


def test_screens(spark):
    steps = [("go", "home", None), ("go", "crop", None), ("go", "review", None), ("go", "review", None), ("go", "home", None), ("pop", None, 0), ("go", "saved", None), ("pop", None, 9), ("pop", None, -3), ("pop", None, 0)]
    df = spark.createDataFrame([(s, i, *x) for s in ("a", "b") for i, x in enumerate(steps)], "session string, seq long, kind string, screen string, depth int")
    got = events.screens(df.repartition(3)).where("session = 'b'").orderBy("seq").collect()
    assert [(r["action"], r["depth"], r["screen"]) for r in got] == [
        ("replace", 0, "home"), ("push", 1, "crop"), ("push", 2, "review"), ("render", 2, "review"), ("jump", 0, "home"),
        ("show", 0, "home"), ("push", 1, "saved"), ("none", 1, "saved"), ("show", 0, "home"), ("none", 0, "home"),
    ]


def test_release_points(spark):
    settled = [(1, 0, 10.0, 10.0), (1, 100, 50.0, 50.0), (1, 150, 51.0, 50.0), (1, 200, 54.0, 52.0)]
    moving = [(2, 0, 0.0, 0.0), (2, 100, 30.0, 0.0), (2, 200, 60.0, 0.0)]
    short = [(3, 0, 1.0, 1.0), (3, 10, 2.0, 2.0)]
    got = {r["drag"]: (r["x"], r["y"], r["corrected"]) for r in events.release_points(spark.createDataFrame(settled + moving + short, "drag int, t long, x double, y double")).collect()}
    assert got == {1: (50.0, 50.0, True), 2: (60.0, 0.0, False), 3: (2.0, 2.0, False)}


def test_stalls(spark):
    rows = [("a", 0, 5, False), ("a", 30_000, 5, True), ("b", 0, 1, False), ("b", 30_001, 1, True), ("c", 0, 9, False)]
    df = spark.createDataFrame(rows, "file string, t long, size long, done boolean")
    got = {r["file"]: (r["n_bytes"], r["stalled"]) for r in events.stalled(df, now=F.lit(40_000)).collect()}
    assert got == {"a": (10, False), "b": (2, True), "c": (9, True)}


def test_access_states(spark):
    got = events.access(spark.createDataFrame([(s,) for s in ("granted", "prompt", "denied", "unsupported", "none", "what")], "state string")).collect()
    assert [(r["dot"], r["button"]) for r in got] == [("ok", "pick"), ("warn", "reconnect"), ("err", "pick"), ("warn", None), ("warn", "pick"), ("warn", "pick")]


def test_languages(spark):
    df = spark.createDataFrame([(["kat", "xx", "fra", "eng", "deu"],), (["xx"],), (None,)], "c array<string>")
    got = df.select(events.active_languages(F.col("c")).alias("a")).select(events.pack_name(F.col("a")).alias("n"), F.round(events.pack_megabytes(F.col("a")), 1).alias("mb")).collect()
    assert [tuple(r) for r in got] == [("eng+fra+kat", 4.5), ("eng+fra", 3.5), ("eng+fra", 3.5)]


def test_ids_sort_by_time(spark):
    df = spark.createDataFrame([(1_700_000_000_000,), (1_700_000_000_001,)], "ms long").select("ms", events.new_id(F.col("ms")).alias("id"))
    ids = [r["id"] for r in df.orderBy("ms").collect()]
    assert ids == sorted(ids) and all(len(i) == 13 and i[0] == "d" for i in ids)


def test_folder_settings(spark):
    row = spark.range(1).select(events.folder_settings(F.lit(" / "), F.lit("a//b/"), "Notes", "Files").alias("f")).first()["f"]
    assert tuple(row) == ("Notes", "a/b")
