"""Operator 3, secret scans: Boolean trigram queries from the rules, an inverted index over each block, verified candidates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as op
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import chunks, id_and_text


@dataclass(frozen=True)
class Rule:
    """pattern: matches are leftmost and don't overlap; those that `keep` refuses are dropped and their text stays consumed."""

    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = lambda m: True
    flags: int = re.ASCII


def _long(group: int, least: int) -> Callable[[re.Match], bool]:
    return lambda m: m.end(group) - m.start(group) >= least


#: The three base kinds in their order, then public credential formats that the scan adds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _long(2, 12), re.ASCII | re.IGNORECASE),
    Rule("access", "AKIA[A-Z0-9]+", _long(0, 18)),
    Rule("hex", "[0-9a-f]{16,}"),
)
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", "(?:sk|rk)_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", "-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
)

# ---- Boolean queries -------------------------------------------------------------------------------------------------
# A query is True (any text may match), a trigram, ("and", queries) or ("or", queries). What a regex node says of its matches:
# either `exact`, the finite set of its (folded) strings, or prefixes and suffixes of them beside the query.

MOST = 64  # strings in a set before it is turned into a query


def _all(*queries):
    flat = {p for q in queries for p in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q])} - {True}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _any(*queries):
    flat = {p for q in queries for p in (q[1] if isinstance(q, tuple) and q[0] == "or" else [q])}
    return True if True in flat or not flat else next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _of_string(s: str):
    return _all(*(s[i : i + 3] for i in range(len(s) - 2))) if len(s) >= 3 else True


def _of_set(strings: set[str]):
    return _any(*(_of_string(s) for s in strings)) if strings else True


@dataclass(frozen=True)
class _Says:
    exact: frozenset | None
    prefix: frozenset
    suffix: frozenset
    query: object

    @staticmethod
    def strings(found: set[str]) -> _Says:
        return _Says(frozenset(found), frozenset(found), frozenset(found), True)


ANYTHING = _Says(None, frozenset({""}), frozenset({""}), True)
EMPTY = _Says.strings({""})


def _inexact(x: _Says) -> _Says:
    """Without the exact set, which goes into the query; prefixes and suffixes keep what a trigram over a seam can need."""
    if x.exact is None:
        return x
    return _Says(None, frozenset(s[:2] for s in x.exact), frozenset(s[-2:] for s in x.exact), _of_set(set(x.exact)))


def _then(a: _Says, b: _Says) -> _Says:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return _Says.strings({x + y for x in a.exact for y in b.exact})
    seam = True
    if len(a.suffix) * len(b.prefix) <= MOST:
        seam = _of_set({x[-2:] + y[:2] for x in a.suffix for y in b.prefix})
    # What stands exactly on one side lengthens the other side's edge.
    prefix = frozenset((x + y)[:8] for x in a.exact for y in b.prefix) if a.exact is not None and len(a.exact) * len(b.prefix) <= MOST else None
    suffix = frozenset((x + y)[-8:] for x in a.suffix for y in b.exact) if b.exact is not None and len(a.suffix) * len(b.exact) <= MOST else None
    query = _all(a.query if a.exact is None else _of_set(set(a.exact)), b.query if b.exact is None else _of_set(set(b.exact)), seam)
    if prefix is not None:
        query = _all(query, _of_set(set(prefix)))
    if suffix is not None:
        query = _all(query, _of_set(set(suffix)))
    edge = lambda own, kept: own if own is not None else kept
    return _Says(None, edge(prefix, a.prefix if len(a.prefix) <= MOST else frozenset({""})), edge(suffix, b.suffix if len(b.suffix) <= MOST else frozenset({""})), query)


def _or(a: _Says, b: _Says) -> _Says:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST:
        return _Says.strings(set(a.exact | b.exact))
    a, b = _inexact(a), _inexact(b)
    return _Says(None, a.prefix | b.prefix, a.suffix | b.suffix, _any(a.query, b.query))


def _characters(items) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MOST:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 12 else None


def _says(nodes) -> _Says:
    out = EMPTY
    for kind, value in nodes:
        if kind is op.LITERAL:
            x = _Says.strings({chr(value).lower()})
        elif kind is op.IN:
            found = _characters(value)
            x = _Says.strings(found) if found else ANYTHING
        elif kind is op.SUBPATTERN:
            x = _says(value[3])
        elif kind is op.BRANCH:
            x = _says(value[1][0])
            for y in value[1][1:]:
                x = _or(x, _says(y))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = value
            once = _says(inner)
            if least == 0:
                x = _or(EMPTY, once) if most == 1 else ANYTHING
            else:
                x = once
                for _ in range(min(least, 16) - 1):
                    x = _then(x, once)
                if most != least or least > 16:
                    x = _then(_inexact(x), ANYTHING)
        elif kind is op.AT:
            x = EMPTY
        else:
            x = ANYTHING
        out = _then(out, x)
    return out


def trigram_query(rule: Rule):
    """The Boolean query over lower-case trigrams that every text with a match satisfies; True if the rule has no mandatory trigram."""
    return _inexact(_says(_parser.parse(rule.pattern, rule.flags))).query


def trigrams_in(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_in(q) for q in query[1]))


def candidates(query, postings: dict[str, set[int]], everything: set[int]) -> set[int]:
    if query is True:
        return everything
    if isinstance(query, str):
        return postings[query]
    found = [candidates(q, postings, everything) for q in query[1]]
    return set.intersection(*sorted(found, key=len)) if query[0] == "and" else set.union(*found)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r)) for r in rules]
        self.wanted = sorted(set().union(*(trigrams_in(q) for _, _, q in self.rules)))

    def index(self, texts: list[str]) -> dict[str, set[int]]:
        """Postings, for the trigrams that any rule asks for, over a block of texts (numbered by place)."""
        folded = [t.lower() for t in texts]
        return {g: {i for i, t in enumerate(folded) if g in t} for g in self.wanted}

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int, str]]]:
        """Per text its spans as (start, place of the kind, end, kind), in order."""
        found: list[list[tuple[int, int, int, str]]] = [[] for _ in texts]
        postings, everything = self.index(texts), set(range(len(texts)))
        for place, (rule, pattern, query) in enumerate(self.rules):
            for i in candidates(query, postings, everything):
                found[i] += [(m.start(), place, m.end(), rule.kind) for m in pattern.finditer(texts[i]) if rule.keep(m)]
        return [sorted(x) for x in found]


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner(BASE + ADDED)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: doc_id and spans, an array of (kind, start, end), in code points, end exclusive, by start then kind.

    Each task indexes its own texts block by block; there is no shuffle. Null and empty texts have no spans, repeated rows are
    scanned again, an empty table gives no rows, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in chunks(batches):
            found = _scanner().scan(batch.column(1).to_pylist())
            spans = pa.array([[{"kind": k, "start": s, "end": e} for s, _, e, k in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "*") -> DataFrame:
    """doc_id and the text with every span overwritten, character for character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column(1).to_pylist()
            out = []
            for text, spans in zip(texts, _scanner().scan(texts)):
                for start, _, end, _ in spans:
                    text = text[:start] + by * (end - start) + text[end:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The digest of secret_spans: counts and the hash of the base kinds, and all spans as a string."""
    names = [r.kind for r in BASE]
    of = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(names))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return secret_spans(docs).select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(of(base), 256).alias("base_sha256"), of(F.col("spans")).alias("spans"))

