"""What a line of a label is: boilerplate, a year, a description, advertising, prose, wreckage or perhaps a name. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.matching import find_in, gram_sets, holds_any_word, let, phrase_table
from tessella.functions.text import constants, contains, leftover, normalize, trimmed, words
from tessella.operators import lexicon as lex


def any_pattern(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches. Those that begin at a word's edge begin with a word's character, so one look back serves them all."""
    heads = [p[2:] for p in patterns if p.startswith(r"\b")]
    rest = [p for p in patterns if not p.startswith(r"\b")]
    parts = [f"(?<![A-Za-z0-9_])(?:{'|'.join(heads)})"] if heads else []
    return text.rlike(lex.pattern("|".join([*parts, *(f"(?:{p})" for p in rest)])))


def is_noise(text: Column, fuzzy: bool = True) -> Column:
    """Boilerplate: by pattern on the raw text; then, cheapest first, nearly one of the phrases, or with one of the long words run together."""
    exact = any_pattern(text, lex.NOISE_PATTERNS)
    if not fuzzy:
        return exact
    table = phrase_table(lex.NOISE_PHRASES, lambda n: max(1, n // 4))
    phrase = lambda w: let(gram_sets(w, 4), lambda sets: F.exists(table, lambda p: find_in(sets, p) >= 0))
    long_word = lambda w: let(F.array_join(w, ""), lambda j: F.when(F.length(j) >= 8, holds_any_word(j, lex.NOISE_WORDS)).otherwise(False))
    return F.when(exact, True).otherwise(let(words(normalize(text)), lambda w: phrase(w) | long_word(w)))


def is_year(text: Column) -> Column:
    return text.rlike("(?U)^\\s*(19|20)[0-9]{2}\\s*$")


def is_descriptor(normal: Column) -> Column:
    """Every word describes a bottle."""
    w = words(normal)
    return (F.size(w) > 0) & F.forall(w, lambda x: F.array_contains(constants(lex.DESCRIPTORS), x))


def is_marketing(text: Column) -> Column:
    return any_pattern(trimmed(text), lex.MARKETING_PATTERNS)


def is_prose(normal: Column) -> Column:
    """A function word anywhere, "the" except in front, or eight words and more with two stop words."""
    w = words(normal)
    telling = F.exists(F.transform(w, lambda x, i: x.isin(lex.PROSE_WORDS) | ((x == "the") & (i > 0))), lambda x: x)
    return telling | ((F.size(w) >= 8) & (F.size(F.filter(w, lambda x: x.isin(lex.STOPWORDS))) >= 2))


def is_junk(text: Column, confidence: Column) -> Column:
    """Figures and punctuation, a volume, or two letters at most read with little confidence (missing: full)."""
    letters = F.length(F.regexp_replace(normalize(text), "[^a-z]", ""))
    t = trimmed(text)
    return t.rlike(lex.pattern(r"^[\d\s.,%-]+$")) | t.rlike(lex.pattern(r"^\d{2,4}\s?(ml|cl|l)$")) | ((F.coalesce(confidence, F.lit(100.0)) < 50) & (letters <= 2))


def opens_cuvee(text: Column) -> Column:
    return trimmed(text).rlike(lex.pattern(lex.CUVEE_PREFIX))


def is_producer_tail(normal: Column) -> Column:
    """Only words that producers' names end with, and glue."""
    w, ends = words(normal), list(dict.fromkeys(x for s in lex.PRODUCER_SUFFIXES for x in s.split()))
    return F.exists(w, lambda x: F.array_contains(constants(ends), x)) & F.forall(w, lambda x: F.array_contains(constants(ends + lex.TAIL_GLUE), x))


def looks_like_name(text: Column, confidence: Column, noise: Column | None = None) -> Column:
    """Could be somebody's name. Confidence under 65 speaks against it, unless it is 0; missing is full."""
    sure = F.coalesce(confidence, F.lit(100.0))

    def judge(normal: Column, w: Column) -> Column:
        letters, figures = F.length(F.regexp_replace(normal, "[^a-z]", "")), F.length(F.regexp_replace(normal, "[^0-9]", ""))
        stray = (F.size(w) == 1) & ((F.length(F.get(w, 0)) < 4) | F.array_contains(constants(lex.STRAY_WORDS), F.get(w, 0)))
        against = (normal == "") | ((sure != 0) & (sure < 65)) | (letters < 4) | (figures > letters) | stray | is_year(text) | is_descriptor(normal) | is_prose(normal) | is_marketing(text)
        return F.when(against, False).when(is_noise(text) if noise is None else noise, False).otherwise(F.exists(w, lambda x: F.length(x) >= 3))

    return let(normalize(text), lambda n: let(words(n), lambda w: judge(n, w)))


def longest_in(normal: Column, entries: Column) -> Column:
    """The first of the entries (structs with a needle, longest first) that the text holds as whole words."""
    return F.get(F.filter(entries, lambda e: contains(normal, e["needle"])), 0)


def nearest_place(normal: Column, entries: Column) -> Column:
    """For one long word: the first entry whose squashed name of ten letters or more is within 15 % of its length in edits."""
    close = lambda e: (
        (F.length(e["squashed"]) >= 10)
        & (F.abs(F.length(e["squashed"]) - F.length(normal)) <= F.floor(F.length(e["squashed"]) * 0.15))
        & (F.levenshtein(normal, e["squashed"]) <= F.floor(F.length(e["squashed"]) * 0.15))
    )
    return F.when(~normal.contains(" ") & (F.length(normal) >= 10), F.get(F.filter(entries, close), 0))


def is_place_only(normal: Column, entries: Column) -> Column:
    """A place with at most one word beside it that isn't a descriptor."""
    alone = lambda found: leftover(normal, F.array(found["needle"]), constants(lex.DESCRIPTORS)) <= 1
    return let(longest_in(normal, entries), lambda found: F.when(found.isNotNull(), alone(found)).otherwise(nearest_place(normal, entries).isNotNull()))


def is_field_like(text: Column, places: Column, names: Column, noise: Column | None = None) -> Column:
    """Already a field of its own, so it never continues another line. names: needles of grapes and countries."""

    def judge(normal: Column) -> Column:
        plain = is_year(text) | is_descriptor(normal) | is_marketing(text) | is_prose(normal) | opens_cuvee(text)
        known = F.exists(names, lambda n: contains(normal, n)) | longest_in(normal, places).isNotNull() | nearest_place(normal, places).isNotNull()
        return F.when(plain, True).when(known, True).otherwise(is_noise(text) if noise is None else noise)

    return let(normalize(text), judge)
