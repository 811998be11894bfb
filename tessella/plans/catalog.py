"""The queries over the reference's operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import geometry, similarity, text
from tessella.functions.matching import find_in, gram_sets, holds_any_word, phrase_table
from tessella.operators import classify, notes, scoring, tables, vision

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def on(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: f(Tables(spark, folder))


# SQL for a normalised text and its words.
NORM = "trim(regexp_replace(lower(replace(replace(replace(strip_accents({0}), '’', ''''), '`', ''''), '´', '''')), '[^a-z0-9'']+', ' ', 'g'))"
WORDS = "list_filter(string_split({0}, ' '), lambda x: x <> '')"
SQL_WORDS = lambda column: WORDS.format(NORM.format(column))
STOP_SQL = "['" + "', '".join(classify.lex.STOPWORDS) + "']"
PROSE_SQL = "['" + "', '".join(classify.lex.PROSE_WORDS) + "']"
DESCRIPTOR_SQL = "['" + "', '".join(classify.lex.DESCRIPTORS) + "']"


@query("normalize_text", f"SELECT doc_id, md5({NORM.format('text')}) AS folded FROM documents")
@on
def _(t):
    return t.documents.select("doc_id", F.md5(text.normalize("text")).alias("folded"))


@query(
    "token_stats",
    f"""SELECT lang, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, max(n) AS longest, CAST(sum(d) AS BIGINT) AS n_distinct
    FROM (SELECT lang, len(w) AS n, len(list_distinct(w)) AS d FROM (SELECT lang, {SQL_WORDS('text')} AS w FROM documents)) GROUP BY lang""",
)
@on
def _(t):
    d = t.documents.select("lang", text.tokens("text").alias("w")).select("lang", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("d"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"), F.sum("d").alias("n_distinct"))


LINES_SQL = f"""SELECT doc_id, pos, line, {SQL_WORDS('line')} AS w FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"""


def _lines(t) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query(
    "line_classify",
    f"""SELECT doc_id, pos, regexp_matches(line, '^\\s*(19|20)[0-9][0-9]\\s*$') AS is_year,
    len(w) > 0 AND len(list_filter(w, lambda x: NOT list_contains({DESCRIPTOR_SQL}, x))) = 0 AS is_descriptor,
    len(list_filter(w, lambda x: list_contains({PROSE_SQL}, x))) > 0 OR list_contains(w[2:], 'the') OR (len(w) >= 8 AND len(list_filter(w, lambda x: list_contains({STOP_SQL}, x))) >= 2) AS is_prose,
    regexp_matches(lower(strip_accents(line)), 'licen[cs]ed?|rights reserved') AS is_licence
    FROM ({LINES_SQL})""",
)
@on
def _(t):
    d = _lines(t).withColumn("n", text.normalize("line"))
    return d.select("doc_id", "pos", classify.is_year(F.col("line")).alias("is_year"), classify.is_descriptor(F.col("n")).alias("is_descriptor"), classify.is_prose(F.col("n")).alias("is_prose"), F.lower(text.fold("line")).rlike("licen[cs]ed?|rights reserved").alias("is_licence"))


@query(
    "prose_density",
    f"""SELECT lang, source, count(*) AS n_docs, round(avg(s / n), 6) AS density FROM (
    SELECT lang, source, len(w) AS n, CAST(len(list_filter(w, lambda x: list_contains({STOP_SQL}, x))) AS DOUBLE) AS s
    FROM (SELECT lang, source, {SQL_WORDS('text')} AS w FROM documents)) WHERE n > 0 GROUP BY lang, source""",
)
@on
def _(t):
    d = t.documents.select("lang", "source", text.tokens("text").alias("w"))
    d = d.select("lang", "source", F.size("w").alias("n"), F.size(F.filter("w", lambda x: x.isin(classify.lex.STOPWORDS))).alias("s")).where("n > 0")
    return d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("density"))


@query(
    "digit_year_extract",
    """SELECT o_orderkey, regexp_extract(CAST(o_orderdate AS VARCHAR), '([0-9]{4})', 1) AS digits, len(regexp_extract_all(CAST(o_orderdate AS VARCHAR), '(19|20)[0-9][0-9]')) AS n_years FROM orders""",
)
@on
def _(t):
    day = F.col("o_orderdate").cast("string")
    return t.orders.select("o_orderkey", text.digits(day).alias("digits"), F.size(F.regexp_extract_all(day, F.lit("(?:19|20)[0-9]{2}"), F.lit(0))).cast("long").alias("n_years"))


COLOURS = ["almond", "antique", "azure", "blue", "brown", "green", "red", "steel", "green antique"]


@query(
    "phrase_dictionary_match",
    f"""SELECT p_partkey, p_name, needle FROM (SELECT p_partkey, p_name, needle, row_number() OVER (PARTITION BY p_partkey ORDER BY length(needle) DESC, ord) AS r
    FROM part, (SELECT unnest({COLOURS!r}) AS needle, unnest(range({len(COLOURS)})) AS ord) d
    WHERE contains(' ' || {NORM.format('p_name')} || ' ', ' ' || needle || ' ')) WHERE r = 1""",
)
@on
def _(t):
    """The longest dictionary phrase in a name: runs of words joined to the dictionary by equality, then the best one by aggregation."""
    spark = t.part.sparkSession
    words = spark.createDataFrame([(c, i, c.count(" ")) for i, c in enumerate(COLOURS)], "needle string, ord int, k int")
    runs = t.part.select("p_partkey", "p_name", F.explode(F.array_distinct(F.flatten(gram_sets(text.tokens("p_name"), 2)))).alias("needle"))
    hit = runs.join(F.broadcast(words), "needle")
    return hit.groupBy("p_partkey", "p_name").agg(F.min_by("needle", F.struct(-F.length("needle"), "ord")).alias("needle"))


FUZZY = ["widgets", "gizmos", "smaler", "gear", "blue bolts"]


@query(
    "fuzzy_part_words",
    f"""SELECT p_partkey, needle, min(pos) AS pos FROM (
    SELECT p_partkey, unnest({SQL_WORDS('p_name')}) AS w, unnest(range(len({SQL_WORDS('p_name')}))) AS pos FROM part) p,
    (SELECT unnest({FUZZY!r}) AS needle) d
    WHERE w = needle OR (length(needle) > 5 AND abs(length(w) - length(needle)) <= CASE WHEN length(needle) <= 9 THEN 1 ELSE 2 END
      AND levenshtein(w, needle) <= CASE WHEN length(needle) <= 9 THEN 1 ELSE 2 END) GROUP BY p_partkey, needle""",
)
@on
def _(t):
    d = t.part.select("p_partkey", gram_sets(text.tokens("p_name"), 1).alias("sets"), F.explode(phrase_table(FUZZY)).alias("e"))
    return d.select("p_partkey", "e.needle", find_in(F.col("sets"), F.col("e")).cast("long").alias("pos")).where("pos >= 0")


@query(
    "fuzzy_substring",
    f"""SELECT p_partkey, length(s) >= 5 AND len(list_filter(range(1, length(s) + 1), lambda i: len(list_filter([5, 6, 7, 8, 9], lambda k:
    i + k - 1 <= length(s) AND levenshtein(substr(s, i, k), 'bluegir') <= 2)) > 0)) > 0 AS holds FROM (SELECT p_partkey, replace({NORM.format('p_name')}, ' ', '') AS s FROM part)""",
)
@on
def _(t):
    return t.part.select("p_partkey", holds_any_word(text.squash(text.normalize("p_name")), ["bluegir"]).alias("holds"))


@query(
    "token_jaccard_pairs",
    f"""WITH b AS (SELECT item_id, list_distinct({SQL_WORDS('text')}) AS bw FROM benchmark),
    d AS (SELECT doc_id, list_distinct({SQL_WORDS('text')}) AS dw FROM documents),
    bi AS (SELECT item_id, bw, unnest(bw) AS w FROM b), di AS (SELECT doc_id, unnest(dw) AS w FROM d),
    s AS (SELECT item_id, doc_id, count(*) AS n FROM bi JOIN di USING (w) WHERE length(bi.w) >= 9 GROUP BY item_id, doc_id)
    SELECT s.item_id, s.doc_id, round(CAST(len(list_intersect(bw, dw)) AS DOUBLE) / (len(bw) + len(dw) - len(list_intersect(bw, dw))), 6) AS sim
    FROM s JOIN b USING (item_id) JOIN d USING (doc_id) WHERE n >= 3""",
)
@on
def _(t):
    """Benchmark items against documents that share three long words; the words are the blocks, so the join is one of equality."""
    b = t.benchmark.select("item_id", F.array_distinct(text.tokens("text")).alias("bw"))
    d = t.documents.select("doc_id", F.array_distinct(text.tokens("text")).alias("dw"))
    bi = b.select("item_id", F.explode("bw").alias("w")).where(F.length("w") >= 9)
    di = d.select("doc_id", F.explode("dw").alias("w")).where(F.length("w") >= 9)
    pairs = di.join(bi, "w").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return pairs.join(b, "item_id").join(d, "doc_id").select("item_id", "doc_id", F.round(similarity.jaccard(F.col("bw"), F.col("dw")), 6).alias("sim"))


def similar_sets(b: DataFrame, d: DataFrame) -> DataFrame:
    """(item_id, doc_id, sim) of all pairs of word sets (bw, dw) with a Jaccard similarity of 0.4 or more.

    Two such sets share one of the first n - ceil(0.4 n) + 1 words of each, by their count in the items: words in no item come first
    and block nothing, so of the m words of a set that are in items the first m - ceil(0.4 n) + 1 are its blocks."""
    often = b.select(F.explode("bw").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))

    def blocks(sets: DataFrame, key: str, words: str) -> DataFrame:
        each = sets.select(key, F.size(words).alias("n"), F.explode(words).alias("w")).join(often, "w")
        ranked = each.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("x"))
        first = F.size("x") - F.ceil(2 * F.col("n") / 5).cast("int") + 1
        return ranked.where(first > 0).select(key, F.explode(F.slice("x", F.lit(1), first)).alias("x")).select(key, "x.w")

    pairs = blocks(d, "doc_id", "dw").join(blocks(b, "item_id", "bw"), "w").select("item_id", "doc_id").distinct()
    sim = similarity.jaccard(F.col("bw"), F.col("dw"))
    return pairs.join(b, "item_id").join(d, "doc_id").where(sim >= 0.4).select("item_id", "doc_id", F.round(sim, 6).alias("sim"))


@query(
    "token_jaccard_join",
    f"""WITH b AS (SELECT item_id, list_distinct({SQL_WORDS('text')}) AS bw FROM benchmark),
    d AS (SELECT doc_id, list_distinct({SQL_WORDS('text')}) AS dw FROM documents),
    bi AS (SELECT item_id, len(bw) AS nb, unnest(bw) AS w FROM b), di AS (SELECT doc_id, len(dw) AS nd, unnest(dw) AS w FROM d),
    s AS (SELECT item_id, doc_id, count(*) AS n, any_value(nb) AS nb, any_value(nd) AS nd FROM bi JOIN di USING (w) GROUP BY item_id, doc_id)
    SELECT item_id, doc_id, round(CAST(n AS DOUBLE) / (nb + nd - n), 6) AS sim FROM s WHERE 5 * n >= 2 * (nb + nd - n)""",
)
@on
def _(t):
    """All benchmark items and documents of similarity 0.4 or more, whatever the length of their words."""
    b = t.benchmark.select("item_id", F.array_distinct(text.tokens("text")).alias("bw"))
    d = t.documents.select("doc_id", F.array_distinct(text.tokens("text")).alias("dw"))
    return similar_sets(b, d)


SPLIT_SQL = "list_filter(list_transform(regexp_split_to_array({0}, '[,;/&]|\\b[aA][nN][dD]\\b'), lambda x: " + NORM.format("x") + "), lambda x: x <> '')"


@query(
    "list_similarity",
    f"""WITH c AS (SELECT conv_id, turn, {SPLIT_SQL.format('text')} AS w FROM conversations)
    SELECT a.conv_id, a.turn, CASE WHEN len(a.w) = 0 THEN NULL WHEN len(b.w) = 0 THEN 0.0 ELSE round(CAST(len(list_intersect(list_distinct(a.w), list_distinct(b.w))) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))), 6) END AS sim
    FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
@on
def _(t):
    c = t.conversations
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(similarity.list_similarity("text", "next"), 6).alias("sim"))


# Truth and prediction from the tables: a customer's nation and a guess made of its name and segment.
PRED_SQL = """SELECT c.c_custkey AS file, n.n_name AS country, c.c_mktsegment AS winery, CAST(1990 + c.c_custkey % 30 AS VARCHAR) AS vintage,
    CASE WHEN c.c_custkey % 3 = 0 THEN n.n_name || ' Estate' WHEN c.c_custkey % 3 = 1 THEN '' ELSE r.r_name END AS p_country,
    CASE WHEN c.c_custkey % 2 = 0 THEN 'The ' || c.c_mktsegment ELSE c.c_name END AS p_winery, CAST(1990 + c.c_custkey % 20 AS VARCHAR) || ' bottling' AS p_vintage,
    r.r_name AS source FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""
SIM_SQL = f"""SELECT file, source, field, truth, found, CASE WHEN field = 'vintage' THEN CASE WHEN substr(truth, 1, 4) = substr(found, 1, 4) THEN 1.0 ELSE 0.0 END
    WHEN len(f) = 0 THEN 0.0 WHEN len(list_filter(short, lambda x: length(x) >= 3)) > 0 AND len(list_filter(short, lambda x: NOT list_contains(long, x))) = 0 THEN greatest(j, 0.6) ELSE j END AS sim
    FROM (SELECT *, CASE WHEN len(t) <= len(f) THEN t ELSE f END AS short, CASE WHEN len(t) <= len(f) THEN f ELSE t END AS long,
      CAST(len(list_intersect(list_distinct(t), list_distinct(f))) AS DOUBLE) / len(list_distinct(list_concat(t, f))) AS j
      FROM (SELECT file, source, field, truth, found, {SQL_WORDS('truth')} AS t, {SQL_WORDS('found')} AS f FROM (
        SELECT file, source, 'winery' AS field, winery AS truth, p_winery AS found FROM ({PRED_SQL}) UNION ALL
        SELECT file, source, 'vintage', vintage, p_vintage FROM ({PRED_SQL}) UNION ALL SELECT file, source, 'country', country, p_country FROM ({PRED_SQL}))))"""


def _predictions(t) -> DataFrame:
    geo = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 nations at every size
    c = t.customer.join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    year = lambda m: (F.lit(1990) + k % m).cast("string")
    none = [F.lit(None).cast("string").alias(x) for x in ("wine", "region", "appellation", "grapes")]
    blank = [F.lit(None).cast("string").alias(x) for x in ("WineName", "Region", "Appelation", "Varieties")]
    country = F.when(k % 3 == 0, F.concat("n_name", F.lit(" Estate"))).when(k % 3 == 1, F.lit("")).otherwise(F.col("r_name"))
    winery = F.when(k % 2 == 0, F.concat(F.lit("The "), "c_mktsegment")).otherwise(F.col("c_name"))
    truth = F.struct(F.col("c_mktsegment").alias("winery"), year(30).alias("vintage"), F.col("n_name").alias("country"), *none)
    pred = F.struct(winery.alias("Winemaker"), F.concat(year(20), F.lit(" bottling")).alias("Vintage"), country.alias("Country"), *blank)
    return c.select(k.alias("file"), F.col("r_name").alias("source"), truth.alias("truth"), pred.alias("pred"))


@query(
    "field_score",
    f"""SELECT f.field, f.pos, coalesce(s.n, 0) AS n, coalesce(s.hits, 0) AS hits, round(CAST(s.hits AS DOUBLE) / s.n, 6) AS acc, round(s.mean_sim, 6) AS mean_sim
    FROM (SELECT unnest({list(scoring.FIELDS)!r}) AS field, unnest(range(7)) AS pos) f LEFT JOIN
    (SELECT field, count(*) AS n, CAST(sum(CASE WHEN sim >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS hits, avg(sim) AS mean_sim FROM ({SIM_SQL}) GROUP BY field) s ON f.field = s.field""",
)
@on
def _(t):
    out = scoring.by_field(scoring.cells(_predictions(t)))
    return out.select("field", F.col("pos").cast("long").alias("pos"), "n", "hits", F.round("acc", 6).alias("acc"), F.round("mean_sim", 6).alias("mean_sim"))


@query("overall_score", f"SELECT count(*) AS scored, CAST(sum(CASE WHEN sim >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(CAST(sum(CASE WHEN sim >= 0.6 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS acc FROM ({SIM_SQL})")
@on
def _(t):
    return scoring.overall(scoring.cells(_predictions(t))).withColumn("acc", F.round("acc", 6))


@query(
    "score_by_source",
    f"""SELECT source, field, count(*) AS n, CAST(sum(CASE WHEN sim >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(sim), 6) AS mean_sim FROM ({SIM_SQL}) GROUP BY source, field""",
)
@on
def _(t):
    return scoring.by_source(scoring.cells(_predictions(t), keep=("file", "source"))).withColumn("mean_sim", F.round("mean_sim", 6))


@query(
    "row_score",
    f"""SELECT file, count(*) AS n, CAST(sum(CASE WHEN sim >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS hits, coalesce(string_agg(CASE WHEN sim < 0.6 THEN field || ': "' || truth || '" ≠ "' || found || '"' END, ' | ' ORDER BY CASE field WHEN 'winery' THEN 0 WHEN 'vintage' THEN 2 ELSE 4 END), '') AS misses FROM ({SIM_SQL}) GROUP BY file""",
)
@on
def _(t):
    return scoring.by_row(scoring.cells(_predictions(t))).select("file", "n", "hits", F.array_join("misses", " | ").alias("misses"))


@query(
    "worst_n",
    f"""SELECT file, n, hits FROM (SELECT file, count(*) AS n, CAST(sum(CASE WHEN sim >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM ({SIM_SQL}) GROUP BY file) ORDER BY CAST(hits AS DOUBLE) / n, n - hits DESC, file LIMIT 10""",
)
@on
def _(t):
    return scoring.worst(scoring.by_row(scoring.cells(_predictions(t)))).select("file", "n", "hits")


@query("upper_median", "SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS upper_median FROM events GROUP BY event_type")
@on
def _(t):
    return scoring.upper_median(t.events, "value", "event_type")


@query("label_counts", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE trim(coalesce(lang, '')) <> '' OR n_chars > 500) AS n_labelled FROM documents")
@on
def _(t):
    found = scoring.label_counts(t.documents.select("lang", F.when(F.col("n_chars") > 500, "long").alias("long")), ["lang", "long"])
    return t.documents.sparkSession.createDataFrame([found], "n_rows long, n_labelled long")


@query(
    "put_by_key",
    """WITH p AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS v FROM orders GROUP BY o_custkey), e AS (SELECT * FROM customer WHERE c_custkey % 2 = 0)
    SELECT c_custkey AS id, CAST(c_custkey AS BIGINT) AS created, CAST(1 AS BIGINT) AS updated, 'old' AS v FROM e WHERE c_custkey NOT IN (SELECT o_custkey FROM p)
    UNION ALL SELECT o_custkey, CAST(coalesce(c_custkey, 0) AS BIGINT), CAST(0 AS BIGINT), v FROM p LEFT JOIN e ON o_custkey = c_custkey""",
)
@on
def _(t):
    old = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("long").alias("created"), F.lit(1).cast("long").alias("updated"), F.lit("old").alias("v"))
    new = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("v"), "o_orderkey")
    return tables.upserted(old, new, "id", F.lit(0).cast("long"), "o_orderkey").select("id", "created", "updated", "v")


@query(
    "truth_last_wins",
    """SELECT c_custkey, coalesce(v, c_mktsegment) AS truth FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
@on
def _(t):
    runs = t.customer.select("c_custkey", F.col("c_mktsegment").alias("truth"))
    truth = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("truth"), "o_orderkey")
    return tables.refreshed(runs, truth, "c_custkey", "truth", "o_orderkey")


@query(
    "mad_tolerance",
    """SELECT event_type, round(m, 6) AS paper, round(least(60, greatest(28, 4 * median(abs(value - m)))), 6) AS tolerance FROM (SELECT event_type, value, median(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type, m""",
)
@on
def _(t):
    e = t.events
    mid = e.groupBy("event_type").agg(F.median("value").alias("m"))
    off = e.join(mid, "event_type").groupBy("event_type", "m").agg(F.median(F.abs(F.col("value") - F.col("m"))).alias("s"))
    return off.select("event_type", F.round("m", 6).alias("paper"), F.round(F.least(F.lit(60.0), F.greatest(F.lit(28.0), 4 * F.col("s"))), 6).alias("tolerance"))


@query(
    "histogram_percentile",
    """WITH h AS (SELECT event_type, CAST(least(255, greatest(0, floor(value))) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2),
    c AS (SELECT event_type, bin, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS up, sum(n) OVER (PARTITION BY event_type) AS total FROM h)
    SELECT event_type, min(CASE WHEN up >= 0.02 * total THEN bin END) AS low, min(CASE WHEN up >= 0.98 * total THEN bin END) AS high FROM c GROUP BY event_type""",
)
@on
def _(t):
    """256 bins: the window sees bins, never rows."""
    bins = t.events.groupBy("event_type", F.least(F.lit(255), F.greatest(F.lit(0), F.floor("value"))).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("event_type")
    c = bins.select("event_type", "bin", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("up"), F.sum("n").over(w).alias("total"))
    at = lambda share: F.min(F.when(F.col("up") >= share * F.col("total"), F.col("bin")))
    return c.groupBy("event_type").agg(at(0.02).alias("low"), at(0.98).alias("high"))


@query(
    "truth_refresh",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE CAST(d.n_chars > 1000 AS INT) END AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
@on
def _(t):
    runs = t.documents.select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("quality"))
    return tables.refreshed(runs, t.labels, "doc_id", "quality")


@query(
    "semi_anti_union",
    "SELECT l.doc_id, l.quality, l.toxic FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
@on
def _(t):
    return tables.present_then_unlabelled(t.labels, t.documents, "doc_id")


@query("replace_by_source", "SELECT doc_id, source, lang FROM documents WHERE source <> 'src3' UNION ALL SELECT doc_id + 1000000, 'src3', 'xx' FROM documents WHERE source = 'src3' AND lang = 'en'")
@on
def _(t):
    d = t.documents.select("doc_id", "source", "lang")
    new = d.where("source = 'src3' AND lang = 'en'").select((F.col("doc_id") + 1000000).alias("doc_id"), "source", F.lit("xx").alias("lang"))
    return tables.replaced(d, new, "source", "src3")


@query(
    "explode_link",
    """WITH i AS (SELECT page_id, regexp_replace(regexp_extract(x, '[^/]*$'), '\\.[a-zA-Z0-9]+$', '') AS stem FROM (SELECT page_id, unnest(string_split(url, '?')) AS x FROM pages)),
    f AS (SELECT regexp_replace(regexp_extract(string_split(url, '?')[1], '[^/]*$'), '\\.[a-zA-Z0-9]+$', '') AS stem, max(string_split(url, '?')[1]) AS file FROM pages GROUP BY 1)
    SELECT page_id, f.file FROM i JOIN f USING (stem) WHERE stem <> ''""",
)
@on
def _(t):
    rows = t.pages.select("page_id", F.replace(F.col("url"), F.lit("?"), F.lit(";")).alias("ids"))
    files = t.pages.select(F.substring_index("url", "?", 1).alias("name"))
    return tables.exploded_ids(rows, "ids", files, "name").select("page_id", "file")


@query(
    "upsert_last_write",
    """SELECT user_id, min(ts) AS created, max(ts) AS updated, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY user_id""",
)
@on
def _(t):
    return tables.drafts(t.events, "user_id", "ts", ["event_type", "value"])


@query(
    "drafts_until_purchase",
    """WITH e AS (SELECT user_id, max(ts) AS done FROM events WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT ev.user_id, min(ts) AS created, max(ts) AS updated, arg_max(value, ts) AS value FROM events ev LEFT JOIN e ON ev.user_id = e.user_id
    WHERE event_type <> 'purchase' AND (done IS NULL OR ts > done) GROUP BY ev.user_id""",
)
@on
def _(t):
    return tables.drafts(t.events, "user_id", "ts", ["value"], gone=F.col("event_type") == "purchase")


@query("retention_ring", "SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
@on
def _(t):
    return tables.newest(t.events.select("user_id", "event_id", "ts"), "ts", "event_id", 20, ["user_id"])


@query(
    "debounce_sessions",
    """WITH s AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events),
    b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM s)
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events, arg_max(value, ts) AS value FROM b GROUP BY user_id, burst""",
)
@on
def _(t):
    return tables.debounced(t.events, "user_id", "ts", "value", "INTERVAL 6 HOURS")


@query(
    "fill_if_empty",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN n_name ELSE c_mktsegment END AS filled, CASE WHEN c_custkey % 5 = 0 THEN n_name WHEN c_custkey % 2 = 0 THEN c_name ELSE 'none' END AS layered
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
@on
def _(t):
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations at every size
    k = F.col("c_custkey")
    front = F.when(k % 4 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", tables.filled(front, F.col("n_name")).alias("filled"), tables.layered(F.lit("none"), F.when(k % 2 == 0, F.col("c_name")), F.when(k % 5 == 0, F.col("n_name"))).alias("layered"))


@query(
    "safe_filename",
    """SELECT p_partkey, concat_ws(' - ', nullif(trim(p_brand), ''), nullif(trim(p_name), ''), CAST(p_size AS VARCHAR)) AS name,
    left(concat_ws(' - ', nullif(trim(p_brand), ''), nullif(trim(p_name), ''), CAST(p_size AS VARCHAR)), 120) AS file,
    concat_ws(' — ', nullif(trim(p_name), ''), nullif(trim(p_type), '')) AS title FROM part""",
)
@on
def _(t):
    name = text.compose_name("p_brand", "p_name", F.col("p_size"))
    return t.part.select("p_partkey", name.alias("name"), text.safe_name(name).alias("file"), text.title("p_name", "p_type").alias("title"))


@query(
    "frontmatter",
    """SELECT c_custkey, 'Winemaker: "' || replace(replace(c_name, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' || chr(10) || 'Points: ' || CAST(c_nationkey AS VARCHAR) || chr(10) || 'Stars: --' || chr(10) || 'Style:' AS lines FROM customer""",
)
@on
def _(t):
    lines = [text.yaml_line("Winemaker", F.col("c_name"), "quoted"), text.yaml_line("Points", F.col("c_nationkey"), "bare"), text.yaml_line("Stars", F.lit(" "), "bare", "--"), text.yaml_line("Style", F.lit(None).cast("string"), "quoted")]
    return t.customer.select("c_custkey", F.concat_ws("\n", *lines).alias("lines"))


@query(
    "unique_suffix",
    """SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || ' ' || n END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""",
)
@on
def _(t):
    return tables.numbered(t.part.select("p_partkey", "p_name"), "p_name", ["p_partkey"], most=1_000_000_000).select("p_partkey", "name")


@query(
    "parcel_roundtrip",
    """SELECT conv_id, turn, 'notes/' || role || '.md' AS path, text AS content, length(text) AS n_bytes, CAST(floor((800000 - length(text)) / 2) AS BIGINT) AS budget FROM conversations""",
)
@on
def _(t):
    c = t.conversations
    path = F.concat(F.lit("notes/"), "role", F.lit(".md"))
    files = F.array(F.struct(F.concat(path, F.lit(".jpg")).alias("path"), notes.data_uri(F.encode("text", "UTF-8")).alias("data")))
    p = c.select("conv_id", "turn", F.length("text").alias("n"), notes.photo_budget(F.col("text"), F.lit(2)).alias("budget"), F.from_json(notes.parcel(path, F.col("text"), files), notes.PARCEL).alias("p"))
    back = F.decode(notes.data_of(F.get("p.files", 0)["data"]), "UTF-8")
    return p.select("conv_id", "turn", "p.note.path", "p.note.content", F.length(back).cast("long").alias("n_bytes"), F.col("budget").cast("long").alias("budget"))


@query("uri_encode", "SELECT page_id, 'x://q?vault=' || url_encode(url) || '&choice=' || url_encode('a b') AS uri FROM pages")
@on
def _(t):
    return t.pages.select("page_id", notes.macro_uri(F.col("url"), F.lit("a b"), "x://q").alias("uri"))


@query(
    "size_bucket",
    """SELECT doc_id, CASE WHEN b >= 1e7 THEN CAST(CAST(floor(b / 1e6 + 0.5) AS BIGINT) AS VARCHAR) || ' MB' WHEN b >= 1e6 THEN printf('%.1f', b / 1e6) || ' MB' WHEN b >= 1e3 THEN CAST(CAST(floor(b / 1e3 + 0.5) AS BIGINT) AS VARCHAR) || ' kB' ELSE CAST(n_chars * 37 AS VARCHAR) || ' B' END AS label,
    CAST(CASE WHEN n_chars * 1.15 > 2000 THEN ceil(round(n_chars * 1.15, 6) - 2000) ELSE 0 END AS BIGINT) AS short FROM (SELECT doc_id, n_chars, CAST(n_chars * 37 AS DOUBLE) AS b FROM documents)""",
)
@on
def _(t):
    need = F.round(F.col("n_chars") * 1.15, 6)
    return t.documents.select("doc_id", text.size_label(F.col("n_chars") * 37).alias("label"), tables.shortfall(F.lit(5000), F.lit(3000), need, 1.0).alias("short"))


@query(
    "wrap_angle_fit",
    """WITH p AS (SELECT vec_id, embedding[1] * 10 AS b1, embedding[2] * 10 AS b2 FROM embeddings), q AS (SELECT vec_id, 1 - ((b1 + b2) / 150.0) * 3.5 AS c FROM p)
    SELECT vec_id, round(CASE WHEN c >= 1 THEN pi() / 3 WHEN c <= -1 THEN pi() ELSE greatest(pi() / 3, least(pi(), 2 * acos(c))) END, 5) AS wrap FROM q""",
)
@on
def _(t):
    e = lambda i: F.get("embedding", i).cast("double") * 10
    pt = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), y.cast("double").alias("y"))
    top, low = F.lit(0.0), F.lit(150.0)
    six = F.array(pt(0, top), pt(50, top - e(0)), pt(100, top), pt(100, low), pt(50, low + e(1)), pt(0, low))
    return t.embeddings.select("vec_id", F.round(geometry.wrap_angle(six), 5).alias("wrap"))


@query("least_squares_line", "SELECT event_type, round(regr_slope(value, x), 8) AS beta, round(regr_intercept(value, x), 6) AS alpha FROM (SELECT event_type, value, CAST(event_id % 1000 AS DOUBLE) / 1000 AS x FROM events) GROUP BY event_type")
@on
def _(t):
    x = (F.col("event_id") % 1000).cast("double") / 1000
    return t.events.groupBy("event_type").agg(F.round(F.regr_slope("value", x), 8).alias("beta"), F.round(F.regr_intercept("value", x), 6).alias("alpha"))


@query("argmax_mask", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best FROM embeddings")
@on
def _(t):
    return t.embeddings.select("vec_id", geometry.best_of(F.col("embedding")).alias("best"))


@query(
    "run_collapse",
    """WITH r AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS starts FROM conversations)
    SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS path, count(*) AS n_runs FROM r WHERE starts = 1 GROUP BY conv_id""",
)
@on
def _(t):
    """Repeats in a row count once, as in reading a sequence of classes: a conversation is one group, kept together by its id."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    c = t.conversations.groupBy("conv_id").agg(F.transform(turns, lambda x: x["role"]).alias("r"))
    runs = F.filter("r", lambda x, i: (i == 0) | (F.get("r", i - 1) != x))
    return c.select("conv_id", F.array_join(runs, ">").alias("path"), F.size(runs).cast("long").alias("n_runs"))


@query("input_sizes", "SELECT vec_id, CAST(greatest(32, floor((800 + vec_id) * least(1, 960.0 / greatest(800 + vec_id, 600)) / 32 + 0.5) * 32) AS INT) AS width, CAST(greatest(16, least(1280, floor((vec_id + 1) / 7.0 * 48 + 0.5))) AS INT) AS rec FROM embeddings")
@on
def _(t):
    w = F.col("vec_id") + 800
    return t.embeddings.select("vec_id", geometry.detector_size(w, F.lit(600)).getField("width").alias("width"), geometry.recogniser_width(F.col("vec_id") + 1, F.lit(7)).alias("rec"))


@query(
    "locality_json",
    """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN r_name END AS city, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS country FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
@on
def _(t):
    from tessella.sources.tables import geocoded

    n = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions at every size
    k = F.col("n_nationkey")
    address = F.struct(F.when(k % 3 == 0, F.col("n_name")).otherwise(F.lit("")).alias("city"), F.when(k % 3 == 1, F.col("r_name")).alias("village"), F.when(k % 2 == 0, F.col("n_name")).alias("country"))
    return geocoded(n.withColumn("reply", F.to_json(F.struct(address.alias("address")))), "reply").select("n_nationkey", "city", "country")


@query("missing_assets", "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
@on
def _(t):
    cached = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return tables.missing(t.part.select("p_partkey", "p_brand"), cached, "p_partkey", "p_partkey")


@query("field_swap", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '12' ELSE o_orderpriority END AS note, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '12' END AS points FROM orders")
@on
def _(t):
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority")).alias("note"), F.lit("12").alias("points"))
    return tables.swapped(o, "note", "points", "text", "number")


@query(
    "cache_lookup",
    """SELECT o.o_orderkey, coalesce(CASE WHEN c.c_custkey % 2 = 0 THEN c.c_name END, c.c_mktsegment) AS v FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
)
@on
def _(t):
    c = t.customer
    wanted = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"))
    return tables.cache_first(wanted, c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")), "k", "v").select("o_orderkey", "v")


@query("fold_names", "SELECT doc_id, md5(CASE WHEN a = '' THEN 'Untitled wine' ELSE a END) AS ascii FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(text), '[^\\x20-\\x7e]', '', 'g'), ' +', ' ', 'g')) AS a FROM documents)")
@on
def _(t):
    return t.documents.select("doc_id", F.md5(text.ascii_name("text")).alias("ascii"))


@query("convex_hulls")
@on
def _(t):
    """Rows only: the hull and the smallest rectangle of each vector taken as 32 points."""
    import numpy as np
    import pyarrow as pa

    def measure(v):
        h = vision.hull(np.asarray(v, float).reshape(-1, 2))
        _, _, w, t_, _ = vision.smallest_rectangle(h)
        return {"n": len(h), "area": round(w * t_, 6)}

    out = vision.per_row(t.embeddings.select("vec_id", "embedding"), ["embedding"], "hull", "struct<n:long,area:double>", measure, pa.struct([("n", pa.int64()), ("area", pa.float64())]))
    return out.select("vec_id", "hull.n", "hull.area")


@query("plane_components")
@on
def _(t):
    """Rows only: 4-connected parts of each vector's 8 x 8 plane above its mean."""
    import numpy as np
    import pyarrow as pa

    def count(v):
        p = np.asarray(v, float).reshape(8, 8)
        return int(vision.components(p >= p.mean()).max(initial=0))

    return vision.per_row(t.embeddings.select("vec_id", "embedding"), ["embedding"], "n", "long", count, pa.int64()).select("vec_id", "n")


@query("label_extract")
@on
def _(t):
    """Rows only: each part read as a label of plain lines."""
    from tessella.operators.labels import LINES, label_fields

    year = F.concat(F.lit("Vintage "), (F.lit(1990) + F.col("p_partkey") % 40).cast("string"))
    lines = F.concat_ws("\n", "p_brand", "p_name", "p_type", year)
    labels = t.part.select("p_partkey", lines.alias("text"), F.lit(None).cast(LINES).alias("lines"))
    cores = labels.sparkSession.sparkContext.defaultParallelism
    # A label is a millisecond's work on a hundred bytes: a table in one small file is dealt to all cores first.
    return label_fields(labels if labels.rdd.getNumPartitions() >= cores else labels.repartition(cores), 2026)


NOISE_SQL = "(?i)" + "|".join(f"(?:{p})" for p in classify.lex.NOISE_PATTERNS).replace("'", "''")


@query("line_noise", f"SELECT doc_id, pos, regexp_matches(line, '{NOISE_SQL}') AS noise FROM ({LINES_SQL})")
@on
def _(t):
    return _lines(t).select("doc_id", "pos", classify.is_noise(F.col("line"), fuzzy=False).alias("noise"))


def _record(t) -> DataFrame:
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations at every size
    k = F.col("c_custkey")
    return c.select(
        "c_custkey", F.col("c_name").alias("Winemaker"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("WineName"), (F.lit(1990) + k % 30).cast("string").alias("Vintage"),
        F.col("n_name").alias("Country"), F.when(k % 3 == 0, F.lit('say "hi" \\')).alias("Style"), F.when(k % 5 == 0, F.col("c_nationkey").cast("string")).alias("Points"),
        (k % 2 == 0).alias("has_back"), F.when(k % 4 == 0, F.lit(" raw text\n")).alias("ocrText"), F.lit(" fine ").alias("tastingNote"),
    )


def _note_sql() -> str:
    """The note of _record, line by line."""
    name = "concat_ws(' - ', c_name, CASE WHEN k % 2 = 0 THEN c_mktsegment END, CAST(1990 + k % 30 AS VARCHAR))"
    given = {
        "Winemaker": "'\"' || c_name || '\"'", "WineName": "CASE WHEN k % 2 = 0 THEN '\"' || c_mktsegment || '\"' END", "Vintage": "'\"' || CAST(1990 + k % 30 AS VARCHAR) || '\"'",
        "Country": "'\"' || n_name || '\"'", "Style": "CASE WHEN k % 3 = 0 THEN '\"say ' || chr(92) || '\"hi' || chr(92) || '\" ' || chr(92) || chr(92) || '\"' END",
        "Points": "CASE WHEN k % 5 = 0 THEN CAST(c_nationkey AS VARCHAR) END",
    }
    lines = ["'---'", "'fileClass: Wine'", f"'Name: \"' || {name} || '\"'"]
    for f in notes.FIELDS:
        value = given.get(f.key, f"'{f.default}'" if f.default else "NULL")
        lines.append(f"coalesce('{f.key}: ' || {value}, '{f.key}:')")
    lines += ["'---'", "''", "'## Tasting note'", "'fine'", "''", "'## Label'", f"'Label:: ![[' || {name} || '.jpg]]'", "''", "'## Back label'"]
    lines += [f"CASE WHEN k % 2 = 0 THEN 'Back label:: ![[' || {name} || ' - back.jpg]]' ELSE 'Back label::' END", "''", "'## Food'", "'Food::'", "''"]
    tail = "CASE WHEN k % 4 = 0 THEN chr(10) || '%%' || chr(10) || 'Recognised label text, kept in case a field above needs correcting.' || chr(10) || chr(10) || 'raw text' || chr(10) || '%%' || chr(10) ELSE '' END"
    return f"SELECT k AS c_custkey, md5(concat_ws(chr(10), {', '.join(lines)}) || {tail}) AS note FROM (SELECT c_custkey AS k, * FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("note_render", _note_sql())
@on
def _(t):
    r = _record(t)
    return r.select("c_custkey", F.md5(notes.note(r)).alias("note"))


@query(
    "parcel_unpack",
    """WITH n AS (SELECT p_partkey, p_name || CASE WHEN r = 1 THEN '' ELSE ' ' || r END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part))
    SELECT p_partkey, 0 AS seq, 'img/' || name || '.jpg' AS path, NULL AS content FROM n UNION ALL SELECT p_partkey, 1, 'notes/' || name || '.md', 'see ![[' || name || '.jpg]]' FROM n""",
)
@on
def _(t):
    files = F.array(F.struct(F.concat(F.lit("img/"), "p_name", F.lit(".jpg")).alias("path"), notes.data_uri(F.encode("p_brand", "UTF-8")).alias("data")))
    json = notes.parcel(F.concat(F.lit("notes/"), "p_name", F.lit(".md")), F.concat(F.lit("see ![["), "p_name", F.lit(".jpg]]")), files)
    parcels = t.part.select("p_partkey", json.alias("json"))
    none = t.region.where("r_regionkey < 0").select(F.col("r_name").alias("path"))
    return notes.unpacked(parcels, "json", none, "p_partkey").select("p_partkey", "seq", "path", "content")


@query("late_results", "SELECT o.o_orderkey, CASE WHEN o.o_custkey % 2 = 0 THEN c.c_name END AS answer FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
@on
def _(t):
    """Answers that name an older version of their request don't arrive."""
    requests = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.lit(2).alias("version"))
    answers = t.customer.select(F.col("c_custkey").alias("k"), (F.lit(1) + (F.col("c_custkey") % 2 == 0).cast("int")).alias("version"), F.col("c_name").alias("answer"))
    return tables.current(requests, answers, "k", "version").select("o_orderkey", "answer")


@query("coordinates", "SELECT vec_id, printf('%.5f, %.5f', CAST(vec_id AS DOUBLE) / 8, -CAST(vec_id AS DOUBLE) / 16) AS place FROM embeddings")
@on
def _(t):
    v = F.col("vec_id").cast("double")
    return t.embeddings.select("vec_id", text.coordinates(v / 8, -v / 16).alias("place"))


@query(
    "age_labels",
    """WITH a AS (SELECT event_id, s, CAST(floor(s / 60 + 0.5) AS BIGINT) AS m FROM (SELECT event_id, CAST(event_id * 37 AS DOUBLE) AS s FROM events)), b AS (SELECT *, CAST(floor(m / 60.0 + 0.5) AS BIGINT) AS h FROM a), c AS (SELECT *, CAST(floor(h / 24.0 + 0.5) AS BIGINT) AS d FROM b)
    SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN m < 60 THEN m || ' min' || CASE WHEN m = 1 THEN '' ELSE 's' END || ' ago' WHEN h < 24 THEN h || ' hour' || CASE WHEN h = 1 THEN '' ELSE 's' END || ' ago' WHEN d = 1 THEN 'yesterday' ELSE d || ' days ago' END AS age FROM c""",
)
@on
def _(t):
    return t.events.select("event_id", text.age_label(F.col("event_id") * 37).alias("age"))


@query(
    "stalled_transfers",
    """WITH g AS (SELECT user_id, value, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
    SELECT user_id, count(*) AS n_bytes, coalesce(max(gap) > INTERVAL 24 HOUR, false) AS stalled FROM g GROUP BY user_id""",
)
@on
def _(t):
    from tessella.operators.events import stalled

    chunks = t.events.select(F.col("user_id").alias("file"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.lit(1).alias("size"), F.lit(True).alias("done"))
    return stalled(chunks, patience=24 * 3600 * 1_000_000).select(F.col("file").alias("user_id"), "n_bytes", "stalled")


@query("access_states", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'warn' WHEN 2 THEN 'err' ELSE 'warn' END AS dot, CASE n_nationkey % 5 WHEN 1 THEN 'reconnect' WHEN 3 THEN NULL ELSE 'pick' END AS button FROM nation")
@on
def _(t):
    from tessella.operators.events import access

    k = F.col("n_nationkey") % 5
    state = F.when(k == 0, "granted").when(k == 1, "prompt").when(k == 2, "denied").when(k == 3, "unsupported").otherwise("what")
    return access(t.nation.withColumn("state", state)).select("n_nationkey", "dot", "button")


@query("language_packs", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'eng+fra+kat' WHEN 1 THEN 'eng+fra' ELSE 'spa+deu' END AS packs, CAST(CASE n_nationkey % 3 WHEN 0 THEN 4.5 WHEN 1 THEN 3.5 ELSE 3.3 END AS DOUBLE) AS mb FROM nation")
@on
def _(t):
    from tessella.operators.events import active_languages, pack_megabytes, pack_name

    k = F.col("n_nationkey") % 3
    chosen = F.when(k == 0, F.array(*map(F.lit, ["kat", "xx", "fra", "eng", "deu"]))).when(k == 1, F.array(F.lit("xx"))).otherwise(F.array(F.lit("deu"), F.lit("spa")))
    d = t.nation.select("n_nationkey", active_languages(chosen).alias("a"))
    return d.select("n_nationkey", pack_name(F.col("a")).alias("packs"), F.round(pack_megabytes(F.col("a")), 1).alias("mb"))


@query(
    "score_rollup",
    f"""SELECT coalesce(source, 'all') AS source, coalesce(field, 'all') AS field, count(*) AS n, CAST(sum(CASE WHEN sim >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS hits
    FROM ({SIM_SQL}) GROUP BY GROUPING SETS ((source, field), (field), ())""",
)
@on
def _(t):
    """By source and field, by field and overall in one pass over the cells."""
    c = scoring.cells(_predictions(t), keep=("file", "source"))
    sets = c.groupingSets([["source", "field"], ["field"], []], "source", "field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))
    return sets.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("field", F.lit("all")).alias("field"), "n", "hits")


@query("screen_flow")
@on
def _(t):
    """Rows only: each user's events as visits to screens."""
    from tessella.operators.events import screens

    e = t.events.select(F.col("user_id").alias("session"), F.row_number().over(_by_time()).cast("long").alias("seq"), F.when(F.col("event_type") == "logout", F.lit("pop")).otherwise(F.lit("go")).alias("kind"), F.col("event_type").alias("screen"), F.lit(0).alias("depth"))
    return screens(e)


def _by_time():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("row_bands")
@on
def _(t):
    """Rows only: each vector as 16 boxes in reading order."""
    import pyarrow as pa

    def order(v):
        boxes = [{"corners": [{"x": v[4 * i], "y": v[4 * i + 1]}], "h": abs(v[4 * i + 2]) + 0.01, "i": i} for i in range(16)]
        return [b["i"] for b in vision.in_reading_order(boxes)]

    return vision.per_row(t.embeddings.select("vec_id", "embedding"), ["embedding"], "ord", "array<long>", order, pa.list_(pa.int64())).select("vec_id", F.array_join(F.transform("ord", lambda x: x.cast("string")), ",").alias("reading"))
