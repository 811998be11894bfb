import pytest
from pyspark.sql import functions as F

from tessella.functions.text import normalize
from tessella.operators import classify
from tessella.operators.labels import LINES, assembled_rows, label_fields

NOISE = ["13,5% vol", "750 ml", "CONTAINS SULFITES", "Mis en bouteille au château", "MIS EN BOUTEIT.T.E AU CHATEAU", "DICAZIONEGEOGANIATIN", "GOLD MEDAL 2019", "Grand Cru Classé"]
NAMES = ["Château Margaux", "Domaine Tempier", "The Prisoner", "Penfolds", "CHÂTEAU LA POMPE"]


def flags(spark, column, texts):
    return [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column.alias("v")).collect()]


def test_noise(spark):
    assert flags(spark, classify.is_noise(F.col("t")), NOISE) == [True] * len(NOISE)
    assert flags(spark, classify.is_noise(F.col("t")), NAMES) == [False] * len(NAMES)


def test_looks_like_name(spark):
    sure = F.lit(None).cast("double")
    assert flags(spark, classify.looks_like_name(F.col("t"), sure), NAMES) == [True] * len(NAMES)
    assert not any(flags(spark, classify.looks_like_name(F.col("t"), sure), ["VOL", "750 Mb", "12345 ab", "au", "DRY RED GEORGIAN WINE", "limited edition", "aged in the qvevri", "2015", *NOISE]))


def test_confidence_of_zero_does_not_speak_against_a_name(spark):
    at = lambda c: flags(spark, classify.looks_like_name(F.col("t"), F.lit(c)), ["Penfolds"])[0]
    assert (at(0.0), at(40.0), at(65.0)) == (True, False, True)


def test_edges_of_words_beyond_ascii(spark):
    """An accented letter ends a word, as ASCII rules have it."""
    assert flags(spark, classify.any_pattern(F.col("t"), [r"\bvol\b"]), ["é vol é", "evole", "évolé"]) == [True, False, True]


def test_prose(spark):
    texts = ["aged in the Qvevri", "The Prisoner", "ed oak. On the", "le vin de la maison est dans la cave"]
    assert flags(spark, classify.is_prose(normalize(F.col("t"))), texts) == [True, False, True, True]


def stack(*items, gap=30.0):
    out, top = [], 0.0
    for text, height in items:
        out.append((text, float(height), top, None, None, None))
        top += height + gap
    return out


def lines_of(*texts):
    return stack(*[(t, 20) for t in texts])


VINTAGES = [(["2015"], "2015"), (["EST. 1885", "2014"], "2014"), (["Since 1749"], None), (["2099"], None), (["1650"], None), (["Cuvée 2012", "2013"], "2013")]
GRAPES = [(["Syrah Grenache"], "Syrah, Grenache"), (["Gewurztrarniner"], "Gewürztraminer"), (["Joseph Mellot"], None), (["Cabernet Sauvignon"], "Cabernet Sauvignon"), (["Syrahs"], None), (["TARANTINO"], None)]
WRAPPED = [("Long wrapped", 50.0, 100.0, None, None, None), ("name here", 44.0, 156.0, None, None, None), ("2011", 52.0, 220.0, None, None, None)]
LABELS = {
    "whole": stack(("CHÂTEAU LA POMPE", 60), ("SAINT-ESTÈPHE", 30), ("APPELLATION SAINT-ESTÈPHE CONTRÔLÉE", 20), ("2015", 40), ("13% vol", 12)),
    "text": "Ridge Vineyards\nZinfandel\nSonoma Coast\n2018\nCalifornia", "empty": "", "nothing": None,
    **{f"vintage {i}": lines_of(*x) for i, (x, _) in enumerate(VINTAGES)}, **{f"grapes {i}": lines_of(*x) for i, (x, _) in enumerate(GRAPES)},
    "longer": lines_of("Chianti Classico"), "fuller": stack(("MOULIS-EN-MÉDOC", 40), ("Appellation Moulis Contrôlée", 12)),
    "declared": stack(("Saint-Julien", 60), ("Appellation Margaux Contrôlée", 12)), "unlisted": lines_of("Appellation Foobar Contrôlée"),
    "baja": lines_of("Baja California"), "squashed": lines_of("BRUNELLOMONTALCIN"),
    "red": lines_of("vino rosso"), "sparkling": lines_of("Blanc de Blancs Brut"), "mixed": lines_of("Merlot", "Chardonnay"),
    "prefix": stack(("Big Words Here", 90), ("Domaine Tempier", 30)), "bin": stack(("Lindeman's", 30), ("Bin 25", 20)),
    "tail": stack(("Stag Leap", 60), ("Vineyard and Cellars", 20)), "grape name": stack(("Rkatsiteli", 60), ("Tbilvino Winery", 30)), "wrapped": WRAPPED,
}


@pytest.fixture(scope="module")
def labels(spark):
    """All labels read at once, by name."""
    rows = [(k, v, None) if v is None or isinstance(v, str) else (k, None, v) for k, v in LABELS.items()]
    df = spark.createDataFrame(rows, f"name string, text string, lines {LINES}").repartition(4)
    return {r["name"]: r.asDict() for r in label_fields(df, 2026).collect()}


def test_a_whole_label(labels):
    got = labels["whole"]
    assert (got["Vintage"], got["Appelation"], got["Country"], got["Region"], got["Winemaker"]) == ("2015", "Saint-Estèphe", "France", "Bordeaux", "CHÂTEAU LA POMPE")


def test_plain_text_and_nothing(labels):
    got = labels["text"]
    assert (got["Winemaker"], got["WineName"], got["Varieties"], got["Vintage"], got["Country"], got["Type"]) == ("Ridge Vineyards", "Zinfandel", "Zinfandel", "2018", "USA", "Red")
    assert labels["empty"]["filled"] == [] == labels["nothing"]["filled"]


def test_vintages(labels):
    assert [labels[f"vintage {i}"]["Vintage"] for i in range(len(VINTAGES))] == [y for _, y in VINTAGES]


def test_varieties(labels):
    assert [labels[f"grapes {i}"]["Varieties"] for i in range(len(GRAPES))] == [g for _, g in GRAPES]


def test_places(labels):
    assert labels["longer"]["Appelation"] == "Chianti Classico"
    assert (labels["fuller"]["Appelation"], labels["fuller"]["Region"]) == ("Moulis-en-Médoc", "Bordeaux")
    assert labels["declared"]["Appelation"] == "Margaux" and labels["unlisted"]["Appelation"] == "Foobar"
    assert labels["baja"]["Country"] == "Mexico" and labels["squashed"]["Appelation"] == "Brunello di Montalcino"


def test_types(labels):
    assert [labels[k]["Type"] for k in ("red", "sparkling", "mixed")] == ["Red", "Sparkling", None]


def test_names(labels):
    assert (labels["prefix"]["Winemaker"], labels["prefix"]["WineName"]) == ("Domaine Tempier", "Big Words Here")
    assert labels["bin"]["WineName"] == "Bin 25" and labels["grape name"]["WineName"] == "Rkatsiteli"
    assert labels["tail"]["Winemaker"] == "Stag Leap Vineyard and Cellars"


def test_wrapped_lines(labels):
    assert (labels["wrapped"]["Winemaker"], labels["wrapped"]["Vintage"]) == ("Long wrapped name here", "2011")


def piece(text, top, left, right, height=50.0, confidence=90.0, apart=False):
    return {"text": text, "height": height, "top": top, "left": left, "right": right, "confidence": confidence, "apart": apart}


def test_pieces_of_a_row():
    row = assembled_rows([piece("ERDE", 102.0, 110.0, 200.0, confidence=81.0), piece("SHAV", 100.0, 0.0, 100.0, confidence=89.0)])
    assert [(r["text"], r["confidence"], r["left"], r["right"]) for r in row] == [("SHAV ERDE", 81.0, 0.0, 200.0)]
    assert len(assembled_rows([piece("A", 0.0, 0.0, 100.0), piece("B", 70.0, 0.0, 100.0)])) == 2
    assert len(assembled_rows([piece("A", 0.0, 0.0, 100.0), piece("B", 0.0, 840.0, 900.0)])) == 2
    assert [r["text"] for r in assembled_rows([piece("name", 0.0, 0.0, 100.0, confidence=99.0), piece("88", 0.0, 110.0, 130.0, confidence=49.0, apart=True)])] == ["88", "name"]


def test_results_do_not_depend_on_the_partitions(spark):
    rows = [(i, None, stack((f"Domaine No{i} Estate", 30), ("Merlot", 20), (str(1990 + i), 20))) for i in range(12)]
    df = spark.createDataFrame(rows, f"id int, text string, lines {LINES}")
    a, b = label_fields(df.coalesce(1), 2026).collect(), label_fields(df.repartition(5), 2026).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
