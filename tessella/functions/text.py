"""Text as columns: folding, tokens, tidying, names for files, YAML lines. Built-in expressions only."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks that end a word in a list, the characters trimmed off a fragment, those a file name can't hold.
LIST_SEPARATORS = "[,;/&]|(?i:(?<![A-Za-z0-9_])and(?![A-Za-z0-9_]))"
TRIMMED = "[\\s,.·•–—-]"
ILLEGAL_IN_NAMES = '[<>:"/\\\\|?*\\x00-\\x1f]'
MOST_NAME = 120
FALLBACK_NAME = "Untitled wine"


@lru_cache(maxsize=1)
def folding() -> tuple[str, str]:
    """Every character of the basic plane whose canonical decomposition is one ASCII character and combining marks, and that character."""
    pairs = []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and ord(base) < 0x80 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def _text(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(text: Column | str) -> Column:
    """The text without accents; characters that aren't ASCII underneath stay. A text that is all ASCII is left as it is, which is
    told by its bytes being as many as its characters."""
    text = _text(text)
    folded = F.regexp_replace(F.translate(text, *folding()), "[\\u0300-\\u036f]", "")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(folded)


def normalize(text: Column | str) -> Column:
    """Lower-case ASCII words, apostrophes kept, one space between; null is empty."""
    plain = F.translate(fold(F.coalesce(_text(text), F.lit(""))), "’`´", "'''")
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9']+", " "))


def normalized(text: str) -> str:
    """normalize of a constant, on the driver."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub("[^a-z0-9']+", " ", plain.translate(dict.fromkeys(map(ord, "’`´"), "'")).lower()).strip()


def constants(values) -> Column:
    """An array of fixed texts, made in one call and folded to a literal by the optimizer."""
    return F.split(F.lit("\x1f".join(dict.fromkeys(values))), "\x1f")


def contains(normal: Column, needle: Column | str) -> Column:
    """Whether whole words of a normalised text are the needle's."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.concat(F.lit(" "), normal, F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" ")))


def words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def tokens(text: Column | str) -> Column:
    return words(normalize(text))


def split_list(text: Column | str) -> Column:
    """The normalised items of a printed list, empty ones dropped."""
    parts = F.transform(F.split(F.coalesce(_text(text), F.lit("")), LIST_SEPARATORS), normalize)
    return F.filter(parts, lambda p: p != "")


def digits(text: Column | str) -> Column:
    """The first four digits in a row, else empty."""
    return F.regexp_extract(F.coalesce(_text(text).cast("string"), F.lit("")), "([0-9]{4})", 1)


def tidy(text: Column | str) -> Column:
    """One space for white space, without separators at the ends."""
    spaced = F.regexp_replace(_text(text), "(?U)\\s+", " ")
    return F.trim(F.regexp_replace(spaced, f"(?U)^{TRIMMED}+|{TRIMMED}+$", ""))


def squash(normal: Column) -> Column:
    return F.replace(normal, F.lit(" "), F.lit(""))


def leftover(normal: Column, needles: Column, descriptors: Column) -> Column:
    """How many words are neither part of a needle (an array of phrases) nor a descriptor."""
    rest = F.aggregate(needles, F.concat(F.lit(" "), normal, F.lit(" ")), lambda acc, n: F.replace(acc, F.concat(F.lit(" "), n, F.lit(" ")), F.lit(" ")))
    return F.size(F.filter(F.split(rest, " "), lambda w: (w != "") & ~F.array_contains(descriptors, w)))


def trimmed(text: Column) -> Column:
    """Without white space, of any kind, at the ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def _part(x: Column | str) -> Column:
    trimmed_ = trimmed(_text(x).cast("string"))
    return F.when(trimmed_ != "", trimmed_)


def compose_name(*parts: Column | str, by: str = " - ") -> Column:
    """The parts that aren't blank."""
    return F.concat_ws(by, *map(_part, parts))


def title(*parts: Column | str, placeholder: str = "Untitled bottle") -> Column:
    name = compose_name(*parts, by=" — ")
    return F.when(name != "", name).otherwise(F.lit(placeholder))


def safe_name(name: Column | str) -> Column:
    """A name that a file system takes: no path characters, no dot in front, none behind, at most MOST_NAME long."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(_text(name), ILLEGAL_IN_NAMES, " "), "(?U)\\s+", " "))
    clean = F.regexp_replace(F.regexp_replace(clean, "^\\.+", ""), "[. ]+$", "")
    clean = F.trim(F.substring(clean, 1, MOST_NAME))
    return F.when(clean != "", clean).otherwise(F.lit(FALLBACK_NAME))


def ascii_name(name: Column | str) -> Column:
    """The same in ASCII; what has no ASCII letter underneath is dropped."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(fold(name), "[^\\x20-\\x7e]", ""), "\\s+", " "))
    return F.when(clean != "", clean).otherwise(F.lit(FALLBACK_NAME))


def yaml_quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def yaml_line(key: str, value: Column | None, emit: str, default: str = "") -> Column:
    """`key: value` as the emit rule wants it (literal, quoted or bare); the default for blank, else the key alone."""
    if emit == "literal":
        return F.concat(F.lit(f"{key}: "), value)
    trimmed = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    kept = F.when(trimmed != "", trimmed).otherwise(F.lit(default))
    shown = yaml_quoted(kept) if emit == "quoted" else kept
    return F.when(kept == "", F.lit(f"{key}:")).otherwise(F.concat(F.lit(f"{key}: "), shown))


def folder(path: Column | str) -> Column:
    """A folder's path without blank parts."""
    return F.array_join(F.filter(F.transform(F.split(_text(path), "/"), lambda p: F.trim(p)), lambda p: p != ""), "/")


def percent_encoded(text: Column | str) -> Column:
    """As a URI component: a space is %20, and !'()* stay as they are."""
    out = F.replace(F.url_encode(_text(text)), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def size_label(n_bytes: Column) -> Column:
    """Bytes as a person reads them: B, whole kB, MB with a decimal below ten; a dash for what isn't a size."""
    x = n_bytes.cast("double")
    mega = F.when(x >= 1e7, F.format_string("%d MB", F.floor(x / 1e6 + 0.5))).otherwise(F.format_string("%.1f MB", x / 1e6))
    return (
        F.when(x.isNull() | (x < 0) | F.isnan(x) | (x == float("inf")), F.lit("—"))
        .when(x >= 1e6, mega)
        .when(x >= 1e3, F.format_string("%d kB", F.floor(x / 1e3 + 0.5)))
        .otherwise(F.concat(n_bytes.cast("string"), F.lit(" B")))
    )


def age_label(seconds: Column) -> Column:
    """How long ago, roughly."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    minutes, hours, days = F.floor(s / 60 + 0.5), F.floor(F.floor(s / 60 + 0.5) / 60 + 0.5), F.floor(F.floor(F.floor(s / 60 + 0.5) / 60 + 0.5) / 24 + 0.5)
    plural = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(s < 60, F.lit("just now")).when(minutes < 60, plural(minutes, "min")).when(hours < 24, plural(hours, "hour")).when(days == 1, F.lit("yesterday")).otherwise(plural(days, "day"))


def coordinates(lat: Column, lon: Column) -> Column:
    return F.format_string("%.5f, %.5f", lat, lon)


def stem(name: Column | str) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.substring_index(_text(name), "/", -1), "(?i)\\.[a-z0-9]+$", "")


def cleaned(value: Column | str) -> Column:
    """A table's cell, trimmed; the usual ways to write nothing are null."""
    kept = trimmed(_text(value).cast("string"))
    return F.when((kept == "") | F.lower(kept).isin("nan", "null") | (kept == "N.V."), F.lit(None)).otherwise(kept)


def plain_path(uri: Column) -> Column:
    """A file's path as its name is, however the source that lists it writes URIs."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
