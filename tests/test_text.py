import pytest
from pyspark.sql import functions as F

from tessella.functions import matching, similarity, text


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, folded",
    [("CHÂTEAU  Saint-Estèphe!", "chateau saint estephe"), ("Nero d’Avola", "nero d'avola"), ("é", "e"), ("Straße Øl", "stra e l"), (None, ""), ("漢字", ""), ("Ångström", "angstrom"), ("ộ", "o")],
)
def test_normalize(spark, raw, folded):
    assert one(spark, text.normalize("x"), x=raw) == folded


def test_whole_word_containment(spark):
    assert one(spark, text.contains(F.col("x"), "chianti"), x="chianti classico")
    assert not one(spark, text.contains(F.col("x"), "chianti"), x="chiantis")


def test_split_list(spark):
    assert one(spark, text.split_list("x"), x="Merlot, Syrah / Grenache and Mourvèdre; & Sand") == ["merlot", "syrah", "grenache", "mourvedre", "sand"]


def test_tidy(spark):
    assert one(spark, text.tidy("x"), x=" – Domaine   X., ") == "Domaine X"


def test_leftover_keeps_one_of_adjacent_repeats(spark):
    out = lambda x: text.leftover(F.lit(x), F.array(F.lit("saperavi")), F.array(F.lit("dry")))
    assert one(spark, out("blend saperavi dry")) == 1
    assert one(spark, out("saperavi")) == 0
    assert one(spark, out("saperavi saperavi")) == 1  # they share a space, so one stays


@pytest.mark.parametrize(
    "parts, name",
    [(("Penfolds", "Bin 389", "2018"), "Penfolds - Bin 389 - 2018"), (("Penfolds", " ", "2018"), "Penfolds - 2018"), ((None, None, None), "")],
)
def test_compose_name(spark, parts, name):
    assert one(spark, text.compose_name("a", "b", "c"), a=parts[0], b=parts[1], c=parts[2]) == name


@pytest.mark.parametrize("name, safe", [('A/B: "C"?', "A B C"), ("..hidden", "hidden"), ("end. .", "end"), ("", "Untitled wine"), ("x" * 200, "x" * 120)])
def test_safe_name(spark, name, safe):
    assert one(spark, text.safe_name("x"), x=name) == safe


def test_ascii_name_drops_what_has_no_letter_underneath(spark):
    assert one(spark, text.ascii_name("x"), x="Größe Château") == "Groe Chateau"


def test_yaml_lines(spark):
    assert one(spark, text.yaml_line("K", F.col("x"), "quoted"), x='a "b" \\c') == 'K: "a \\"b\\" \\\\c"'
    assert one(spark, text.yaml_line("K", F.col("x"), "bare"), x="12.5") == "K: 12.5"
    assert one(spark, text.yaml_line("K", F.col("x"), "bare", "--"), x=" ") == "K: --"
    assert one(spark, text.yaml_line("K", F.col("x"), "quoted"), x=None) == "K:"


@pytest.mark.parametrize("n, label", [(None, "—"), (-1, "—"), (999, "999 B"), (1500, "2 kB"), (1_234_567, "1.2 MB"), (12_600_000, "13 MB")])
def test_size_label(spark, n, label):
    assert one(spark, text.size_label(F.col("n").cast("long")), n=n) == label


@pytest.mark.parametrize("s, label", [(10, "just now"), (60, "1 min ago"), (600, "10 mins ago"), (3600, "1 hour ago"), (86400, "yesterday"), (260000, "3 days ago")])
def test_age_label(spark, s, label):
    assert one(spark, text.age_label(F.col("s")), s=s) == label


def test_folder_and_encoding(spark):
    assert one(spark, text.folder("x"), x="/ a // b /") == "a/b"
    assert one(spark, text.percent_encoded("x"), x="a b!('é')*") == "a%20b!('%C3%A9')*"


def test_cleaned_and_stem(spark):
    assert [one(spark, text.cleaned("x"), x=v) for v in (" NaN ", "null", "N.V.", "", " ok ")] == [None, None, None, None, "ok"]
    assert one(spark, text.stem("x"), x="a/b.c.JPG") == "b.c"


@pytest.mark.parametrize(
    "truth, found, sim",
    [("Ausone", "Château Ausone", 0.6), ("Château Margaux", "CHATEAU MARGAUX", 1.0), ("X", "", 0.0), ("", "X", None), ("Tez", "Tezi Winery", 0.0)],
)
def test_name_similarity(spark, truth, found, sim):
    assert one(spark, similarity.name_similarity("a", "b"), a=truth, b=found) == sim


def test_list_similarity_ignores_order(spark):
    assert one(spark, similarity.list_similarity("a", "b"), a="Merlot, Syrah", b="syrah and merlot") == 1.0
    assert round(one(spark, similarity.list_similarity("a", "b"), a="Merlot, Syrah, Grenache", b="Syrah; Merlot"), 6) == 0.666667


def test_jaccard(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, similarity.jaccard(arr("a", "b"), arr("b", "a", "a"))) == 1.0
    assert one(spark, similarity.jaccard(arr("a"), arr("b"))) == 0.0
    assert one(spark, similarity.jaccard(arr(), arr())) == 1.0


@pytest.mark.parametrize(
    "words, needle, at",
    [("a merlot b", "merlot", 1), ("a merlol b", "merlot", 1), ("gewurztrarniner", "gewurztraminer", 0), ("a syrahs", "syrah", -1), ("pinot nolr x", "pinot noir", 0), ("", "merlot", -1)],
)
def test_find_phrase(spark, words, needle, at):
    assert one(spark, matching.find_phrase(text.words(F.col("x")), needle), x=words) == at


def test_a_near_phrase_further_up_wins_over_an_exact_one(spark):
    assert one(spark, matching.find_phrase(text.words(F.col("x")), "merlot"), x="merlol merlot") == 0
    assert one(spark, matching.find_phrase(text.words(F.col("x")), "merlot", withheld=F.array(F.lit("merlol"))), x="merlol merlot") == 1


def test_holds_any_word_equals_brute_force(spark):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rnd, words = random.Random(5), ["bottled", "sulfites"]
    texts = []
    for _ in range(150):
        w = list(rnd.choice(words))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice("abxyz")
        texts.append("".join(rnd.choice("abcdels") for _ in range(rnd.randint(0, 6))) + "".join(w) + "".join(rnd.choice("tbs") for _ in range(rnd.randint(0, 5))))
    got = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(matching.holds_any_word(F.col("t"), words).alias("v")).collect()]
    want = [any(distance(t[i : i + k], w) <= 2 for w in words for i in range(len(t)) for k in range(len(w) - 2, len(w) + 3) if i + k <= len(t)) for t in texts]
    assert got == want
