"""Set similarities of texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import digits, split_list, tokens, trimmed

#: A similarity counts as a hit from here; it is also what containment is worth.
THRESHOLD = 0.6


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def name_similarity(truth: Column | str, found: Column | str) -> Column:
    """Jaccard of the word sets; at least THRESHOLD where all words of the shorter are in the longer and one of them has three letters.

    Null without words in the truth, 0 without words in what was found. "Shorter" counts repeated words."""
    t, f = tokens(truth), tokens(found)
    inside = lambda short, long: F.exists(short, lambda w: F.length(w) >= 3) & F.forall(short, lambda w: F.array_contains(long, w))
    contained = F.when(F.size(t) <= F.size(f), inside(t, f)).otherwise(inside(f, t))
    plain = jaccard(t, f)
    return F.when(F.size(t) == 0, F.lit(None)).when(F.size(f) == 0, F.lit(0.0)).when(contained, F.greatest(plain, F.lit(THRESHOLD))).otherwise(plain)


def list_similarity(truth: Column | str, found: Column | str) -> Column:
    """Jaccard of two printed lists' items, in any order; null and 0 as for names."""
    t, f = split_list(truth), split_list(found)
    return F.when(F.size(t) == 0, F.lit(None)).when(F.size(f) == 0, F.lit(0.0)).otherwise(jaccard(t, f))


def field_similarity(kind: str, truth: Column, found: Column) -> Column:
    """kind: year (the first four digits agree), list or name. Null where there is no truth to score."""
    if kind == "year":
        sim = F.when((digits(truth) != "") & (digits(truth) == digits(found)), 1.0).otherwise(0.0)
    else:
        sim = list_similarity(truth, found) if kind == "list" else name_similarity(truth, found)
    return F.when(truth.isNull() | (trimmed(truth) == ""), F.lit(None)).otherwise(sim)
