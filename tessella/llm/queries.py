"""The queries of the ten operators, each over its whole table, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import durable, n_words_of, table, whole_text
from tessella.llm.binary_ids import binary_ids
from tessella.llm.line_dedup import line_dedup
from tessella.llm.lm_scores import lm_scores
from tessella.llm.media_columns import media_columns
from tessella.llm.mixing import mixed
from tessella.llm.packing import packed
from tessella.llm.quality_rules import quality_rules
from tessella.llm.secret_scan import secret_digest
from tessella.llm.simhash import simhash_groups
from tessella.llm.token_counts import token_counts


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words_of(whole_text()).alias("n_tokens"))
    return mixed(durable(docs), tokens_col="n_tokens").select("doc_id", "source", "n_tokens", F.round("mix.weight", 6).alias("weight"), F.round("mix.epochs", 6).alias("epochs"), "mix.pass", "mix.block", "mix.place")


QUERIES = {
    "op1_quality_rules": lambda spark, sf_dir: quality_rules(table(spark, sf_dir, "documents")),
    "op2_token_counts": lambda spark, sf_dir: token_counts(table(spark, sf_dir, "documents")),
    "op3_secret_scans": lambda spark, sf_dir: secret_digest(table(spark, sf_dir, "documents")),
    "op4_lm_scores": lambda spark, sf_dir: lm_scores(table(spark, sf_dir, "documents")),
    "op5_line_dedup": lambda spark, sf_dir: line_dedup(table(spark, sf_dir, "documents"), with_counts=True).select("doc_id", "text", "n_removed", "n_removed_words"),
    "op6_best_fit_packing": lambda spark, sf_dir: packed(table(spark, sf_dir, "documents")),
    "op7_simhash": lambda spark, sf_dir: simhash_groups(table(spark, sf_dir, "documents")),
    "op8_binary_ids": lambda spark, sf_dir: binary_ids(table(spark, sf_dir, "documents")),
    "op9_media_columns": lambda spark, sf_dir: media_columns(table(spark, sf_dir, "documents")),
    "op10_source_mixing": _mixed,
}

#: The words of a text.
WORDS_SQL = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP1_SQL = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS_SQL} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(len(w) - 4)) AS p, unnest(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS win FROM t WHERE len(w) >= 5),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
v AS (SELECT doc_id, CAST(sum(least(5, coalesce(nxt - p, 5))) AS BIGINT) AS n FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM r) GROUP BY doc_id),
m AS (SELECT t.doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words
    FROM t LEFT JOIN v ON t.doc_id = v.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS d, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS DOUBLE) AS f FROM b GROUP BY source),
s AS (SELECT sum(d) AS dd, sum(f) / sum(d) AS mean, count(*) AS k, sum(d * (f / d) * (f / d)) / sum(d) - (sum(f) / sum(d)) * (sum(f) / sum(d)) AS var FROM h),
p AS (SELECT mean, CASE WHEN var - mean * (1 - mean) * k / dd > 0 AND mean * (1 - mean) > var - mean * (1 - mean) * k / dd
    THEN least(mean * (1 - mean) / (var - mean * (1 - mean) * k / dd) - 1, 1000.0) ELSE 1000.0 END AS strength FROM s),
q AS (SELECT source, round((f + mean * strength) / (d + strength), 9) AS host_rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rate > 0.75 AS kept, host_rate
FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source"""

OP4_SQL = f"""
WITH w AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS p FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)),
x AS (SELECT doc_id, p, w, lag(w) OVER (PARTITION BY doc_id ORDER BY p) AS v FROM w),
u AS (SELECT w, count(*) AS n FROM w GROUP BY w), b AS (SELECT v, w, count(*) AS n FROM x WHERE p > 0 GROUP BY v, w), t AS (SELECT count(*) AS n FROM w),
s AS (SELECT doc_id, CASE WHEN p > 0 AND b.n < 2 THEN 1 ELSE 0 END AS miss, CASE WHEN p > 0 AND b.n >= 2 THEN ln(CAST(b.n AS DOUBLE) / c.n)
    WHEN p > 0 THEN ln(CAST(u.n AS DOUBLE) / t.n) + ln(0.4) ELSE ln(CAST(u.n AS DOUBLE) / t.n) END AS s
    FROM x JOIN u ON x.w = u.w CROSS JOIN t LEFT JOIN b ON x.v = b.v AND x.w = b.w LEFT JOIN u c ON x.v = c.w),
g AS (SELECT doc_id, count(*) AS n_words, CAST(sum(miss) AS BIGINT) AS n_backed_off, CAST(sum(CAST(round(s * 1000000) AS BIGINT)) AS BIGINT) AS score_micro FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backed_off, 0) AS n_backed_off, coalesce(score_micro, 0) AS score_micro FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""

# The exponent that the bisection finds has a closed form here, as the smallest source is repeated most.
OP10_SQL = f"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL}) AS n FROM documents),
s AS (SELECT source, CAST(sum(n) AS DOUBLE) AS tokens FROM d GROUP BY source),
e AS (SELECT CASE WHEN min(tokens) = max(tokens) THEN 0.0 ELSE greatest(0.0, 1 + ln(1.25) / (ln(min(tokens)) - ln(max(tokens)))) END AS a, max(tokens) AS top FROM s WHERE tokens > 0),
z AS (SELECT sum(power(tokens, a)) AS z, greatest(50000, floor((SELECT sum(tokens) FROM s) / 100000)) AS size FROM s, e WHERE tokens > 0),
w AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN power(tokens, a) / z.z ELSE 0 END AS weight, CASE WHEN tokens > 0 THEN power(tokens / top, a - 1) ELSE 1.0 END AS epochs, greatest(1, ceil(tokens / size)) AS k FROM s, e, z),
f AS (SELECT source, tokens, weight, k, CASE WHEN abs(epochs - round(epochs)) < 1e-9 THEN round(epochs) ELSE epochs END AS epochs FROM w),
r AS (SELECT doc_id, d.source, n, tokens, weight, epochs, CAST(CAST('0x' || substr(md5('7:' || doc_id), 1, 8) AS BIGINT) % CAST(k AS BIGINT) AS BIGINT) AS block FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
b AS (SELECT source, block, sum(n) AS size, any_value(tokens) AS tokens, any_value(epochs) AS epochs FROM r GROUP BY source, block),
p AS (SELECT *, unnest(range(greatest(1, CAST(ceil(epochs) AS BIGINT)))) AS pass FROM b),
o AS (SELECT source, block, pass, size, epochs, CASE WHEN epochs >= pass + 1 THEN tokens ELSE (epochs - pass) * tokens END AS quota,
    row_number() OVER (PARTITION BY source, pass ORDER BY md5('7:' || pass || ':' || block), block) AS place,
    sum(size) OVER (PARTITION BY source, pass ORDER BY md5('7:' || pass || ':' || block), block ROWS UNBOUNDED PRECEDING) - size AS bef FROM p),
i AS (SELECT source, block, pass, place, pass + 1 <= epochs OR bef + size <= quota AS whole, quota - bef AS room FROM o WHERE pass + 1 <= epochs OR bef + size <= quota OR bef < quota),
j AS (SELECT doc_id, r.source, r.n, weight, epochs, r.block, pass, place, whole, room,
    sum(r.n) OVER (PARTITION BY r.source, pass, r.block ORDER BY md5('7:' || pass || ':' || doc_id), doc_id, r.n ROWS UNBOUNDED PRECEDING) - r.n AS used
    FROM r JOIN i ON r.source IS NOT DISTINCT FROM i.source AND r.block = i.block)
SELECT doc_id, source, n AS n_tokens, round(weight, 6) AS weight, round(epochs, 6) AS epochs, CAST(pass AS INTEGER) AS pass, block, CAST(place AS INTEGER) AS place FROM j WHERE whole OR used + n <= room"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op4_lm_scores": OP4_SQL, "op10_source_mixing": OP10_SQL}
