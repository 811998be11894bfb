"""Exact and approximate phrase search, as columns over arrays of words."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import constants


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use names it: inside lambdas nothing else keeps it."""
    return F.get(F.transform(F.array(value), use), 0)


def grams(words: Column, k: int) -> Column:
    """All runs of k words, joined by a space, in order."""
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, k), " "))).otherwise(F.array().cast("array<string>"))


def tolerance_of(length: int) -> int:
    """Edits that a phrase of this length may have."""
    return 0 if length <= 5 else 1 if length <= 9 else 2


def near(window: Column, needle: str, tolerance: int) -> Column:
    """Within so many edits; lengths are compared first, and the distance stops early."""
    if not tolerance:
        return window == needle
    close = F.abs(F.length(window) - len(needle)) <= tolerance
    return F.when(close, F.levenshtein(window, F.lit(needle), tolerance) >= 0).otherwise(False)


def find_phrase(words: Column, needle: str, tolerance: int | None = None, withheld: Column | None = None) -> Column:
    """The place of the first run of words that is the needle or near it, from 0; -1 if there is none.

    One pass: a near run further up comes before an exact one further down. Runs in `withheld` match only exactly."""
    tolerance = tolerance_of(len(needle)) if tolerance is None else tolerance

    def fits(w: Column) -> Column:
        loose = near(w, needle, tolerance)
        if withheld is not None:
            loose = loose & ~F.array_contains(withheld, w)
        return (w == needle) | loose

    return (F.array_position(F.transform(grams(words, needle.count(" ") + 1), fits), F.lit(True)) - 1).cast("int")


def phrase_table(phrases: list[str], tolerance=tolerance_of) -> Column:
    """Phrases as a literal array of structs (needle, k words, tol) for find_in."""
    rows = [{"needle": p, "k": p.count(" ") + 1, "tol": tolerance(len(p))} for p in phrases]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<needle:string,k:int,tol:int>>")


def gram_sets(words: Column, most: int) -> Column:
    """Element k - 1 holds the runs of k words."""
    return F.array(*[grams(words, k) for k in range(1, most + 1)])


def find_in(sets: Column, entry: Column, withheld: Column | None = None) -> Column:
    """find_phrase for an entry of a phrase table: -1, or the place in gram_sets' runs."""

    def fits(w: Column) -> Column:
        close = (entry["tol"] > 0) & (F.abs(F.length(w) - F.length(entry["needle"])) <= entry["tol"])
        if withheld is not None:
            close = close & ~F.array_contains(withheld, w)
        return F.when(w == entry["needle"], True).when(close, F.levenshtein(w, entry["needle"]) <= entry["tol"]).otherwise(False)

    return (F.array_position(F.transform(F.get(sets, entry["k"] - 1), fits), F.lit(True)) - 1).cast("int")


def holds_any_word(squashed: Column, words: list[str], tolerance: int = 2) -> Column:
    """Whether some stretch of the text, about as long as one of the words, is within so many edits of it."""
    return let(squashed, lambda s: _holds_any_word(s, words, tolerance))


def _holds_any_word(squashed: Column, words: list[str], tolerance: int) -> Column:
    table = constants(words)
    spare = F.array(*map(F.lit, range(-tolerance, tolerance + 1)))

    def holds(word: Column) -> Column:
        def at(i: Column) -> Column:
            fits = lambda d: F.when(i + F.length(word) + d - 1 <= F.length(squashed), F.levenshtein(F.substring(squashed, i, F.length(word) + d), word, tolerance) >= 0).otherwise(False)
            return F.exists(spare, fits)

        return F.exists(F.sequence(F.lit(1), F.greatest(F.length(squashed), F.lit(1))), at)

    def could(word: Column) -> Column:
        """So many edits leave one of tolerance + 1 pieces of the word as it is."""
        step = F.floor(F.length(word) / (tolerance + 1)).cast("int")
        return F.exists(F.sequence(F.lit(0), F.lit(tolerance)), lambda i: squashed.contains(F.substring(word, i * step + 1, step)))

    return F.exists(table, lambda w: F.when((F.length(squashed) + tolerance >= F.length(w)) & could(w), holds(w)).otherwise(False))
