"""Operators that look at the corpus as a whole: 4, 5, 7, 10."""

import collections
import itertools
import math
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import _common, _hashes, components, line_dedup, lm_scores, mixing, simhash
from tessella.llm import near_copies as near_copies_module

rnd = random.Random(11)
VOCABULARY = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]


def prose(r, n):
    out = []
    while len(out) < n:
        k = min(n - len(out), r.randint(4, 14))
        out += [r.choice(VOCABULARY) for _ in range(k)]
        out[-1] += r.choice([". ", ".\n", "? ", "\n"])
    return " ".join(out).replace("  ", " ").replace("\n ", "\n")


# ---- 4 ----------------------------------------------------------------------------------------------------------------


def lm_brute(texts, order, min_count, alpha):
    words = {k: (t or "").encode().split() for k, t in texts.items()}
    counts = [collections.Counter(tuple(w[i : i + n]) for w in words.values() for i in range(len(w) - n + 1)) for n in range(order + 1)]
    total = sum(counts[1].values())
    out = {}
    for k, w in words.items():
        score = backed = 0
        for i in range(len(w)):
            misses, n = 0, min(order, i + 1)
            while n > 1 and counts[n][tuple(w[i - n + 1 : i + 1])] < min_count:
                n, misses = n - 1, misses + 1
            below = counts[n - 1][tuple(w[i - n + 1 : i])] if n > 1 else total
            score += round((math.log(counts[n][tuple(w[i - n + 1 : i + 1])] / below) + misses * math.log(alpha)) * 1e6)
            backed += misses > 0
        out[k] = (len(w), backed, score)
    return out


@pytest.mark.parametrize("order, min_count, block", [(2, 2, 16 << 20), (3, 2, 3000), (2, 1, 500), (1, 2, 3000)])
def test_scores_equal_brute_force(docs_of, texts, order, min_count, block):
    given = dict(enumerate([None, "", "a", "a a a a", "b c", "b c", "x" * 50_000, *list(texts.values())[:60]]))
    got = lm_scores.lm_scores(docs_of(list(given.items())), order, min_count, block_bytes=block).collect()
    want = lm_brute(given, order, min_count, 0.4)
    assert {r["doc_id"] for r in got} == set(given) and len(got) == len(given)
    for r in got:
        n, backed, score = want[r["doc_id"]]
        assert (r["n_words"], r["n_backed_off"]) == (n, backed) and abs(r["score_micro"] - score) <= 3


# ---- 5 ----------------------------------------------------------------------------------------------------------------


def words_deduped(texts, least=51):
    """The words of each text without the runs of `least` that occur at a smaller (id, place), by trying all runs."""
    words, seen, out = {k: re.findall("[^\x20\x09-\x0d]+", t or "") for k, t in texts.items()}, {}, {}
    for k, w in sorted(words.items()):
        gone = set()
        for i in range(len(w) - least + 1):
            run = tuple(w[i : i + least])
            k0, i0 = seen.setdefault(run, (k, i))
            if (k0, i0) != (k, i):
                gone |= set(range(i if k0 != k else max(i, i0 + least), i + least))
        out[k] = [x for i, x in enumerate(w) if i not in gone]
    return out


def dedup_cases():
    """Texts with repeats of all kinds, and one of their passages."""
    r = random.Random(3)
    plain = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n))
    passage, other = prose(r, 70), prose(r, 55)
    texts = [prose(r, r.randint(0, 200)) for _ in range(25)]
    texts += [prose(r, 60) + "\n" + passage + "\n" + prose(r, 30) for _ in range(8)]
    texts += [prose(r, 20) + " " + passage + other, other, passage + "\n" + passage, "", None, "  \n\n", "word " * 300, "same line here. " * 40, texts[3], texts[3]]
    texts += ["All rights reserved.\n" + prose(r, 80) for _ in range(10)]
    for n in (50, 51, 52, 53, 60, 75, 97):  # between foreign words on both sides, with and without sentences
        for make in (plain, prose):
            held = make(n) if make is plain else make(r, n).strip()
            texts += [f"{plain(r.randint(0, 28))} x{n} {held} y{n} {plain(r.randint(0, 28))}" for _ in range(3)]
    # A line of 40 words in many surroundings, inside a longer passage of two of them.
    line = plain(40)
    wide = f"{plain(30)} {line} {plain(30)}"
    texts += [f"{plain(60)} {line} {plain(60)}" for _ in range(12)] + [f"{plain(9)} {wide} {plain(9)}" for _ in range(2)]
    return dict(enumerate(texts)), passage


def check_dedup(rows, given, least=51):
    want = words_deduped(given, least)
    assert len(rows) == len(given)
    for x in rows:
        text, before = x["text"], given[x["doc_id"]]
        assert (text is None) == (before is None)
        assert (text or "").split() == want[x["doc_id"]], x["doc_id"]
        assert x["n_removed_words"] == len((before or "").split()) - len(want[x["doc_id"]]) and (x["n_removed"] > 0) == (x["n_removed_words"] > 0)
        if not x["n_removed"]:
            assert text == before


@pytest.mark.parametrize("block", [8 << 20, 1500])
def test_line_dedup_equals_brute_force(docs_of, block):
    given, passage = dedup_cases()
    out = line_dedup.line_dedup(docs_of(list(given.items())), block_bytes=block, with_counts=True).collect()
    check_dedup(out, given)
    got = {r["doc_id"]: r["text"] for r in out}
    # The passage stays where it is first, and nowhere else; short common lines stay everywhere.
    line = re.split(r"(?<=[.?]) |\n", passage)[2]
    assert sum(line in (t or "") for t in got.values()) == 1
    assert sum("All rights reserved." in (t or "") for t in got.values()) == 10


@pytest.mark.parametrize("least, line, letters", [(6, 3, 2), (5, 2, 3), (9, 4, 2), (4, 4, 3), (7, 1, 2)])
def test_line_dedup_of_few_words_equals_brute_force(docs_of, least, line, letters):
    """Texts of two or three words, so that runs overlap themselves and each other in all ways."""
    r = random.Random(least)
    given = {k: " ".join(r.choice("abc"[:letters]) * 3 for _ in range(r.randint(0, 60))) for k in range(40)}
    given |= {40: "aaa " * 50, 41: "aaa bbb " * 30, 42: "aaa " * 50, 43: given[7], 44: None}
    check_dedup(line_dedup.line_dedup(docs_of(list(given.items())), least, line=line, with_counts=True, block_bytes=700).collect(), given, least)


def test_line_dedup_of_rows_that_share_an_id(docs_of):
    r = random.Random(4)
    one, two = prose(r, 80), prose(r, 90)
    given = [(1, one), (1, one), (1, two), (None, two), (None, None), (2, one + two)]
    got = collections.Counter((x["doc_id"], (x["text"] or "").strip()) for x in line_dedup.line_dedup(docs_of(given)).collect())
    # A null id is the least; identical rows are one text, and both stay.
    assert got == {(1, one.strip()): 2, (1, ""): 1, (None, two.strip()): 1, (None, ""): 1, (2, ""): 1}


def test_line_dedup_keeps_no_files_of_finished_steps(spark, docs_of, monkeypatch):
    """When a step begins, no shuffle is left but those of the step before, and of the durable frames only what a later step reads."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {int(x) for x in re.findall(r"shuffle_(\d+)_\d+", blocks.getAllFiles().mkString(" "))}
    _common.shared_dir(spark)
    frames = lambda: {x.name for x in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).iterdir()}
    real, found, earlier, last = line_dedup.durable, [], frames(), [max(shuffles(), default=-1)]
    monkeypatch.setattr(_common, "_kept", itertools.count(1))

    def durable(df):
        old = lambda: ({x for x in shuffles() if last[0] < x <= last[max(0, len(last) - 2)]}, frames() - earlier)
        until = time.time() + 5  # files go in the background
        while time.time() < until and (old()[0] or len(old()[1]) > 4):
            time.sleep(0.1)
        found.append(tuple(map(len, old())))
        out = real(df)
        last.append(max(shuffles(), default=-1))
        return out

    monkeypatch.setattr(line_dedup, "durable", durable)
    line_dedup.repeated_runs(docs_of(list(dedup_cases()[0].items())))
    assert len(found) > 5 and all(n == 0 and kept <= 4 for n, kept in found), found


def test_planted_passages_are_caught_in_whole_documents(docs_of, texts):
    """Passages of 51 words and more put into documents of the table with foreign text before and behind: all of them go but the first."""
    r = random.Random(51)
    hosts = sorted(k for k, t in texts.items() if len(t.split()) > 120)[:60]
    given, planted = {k: texts[k] for k in hosts}, []
    r.shuffle(hosts)
    for n, some in enumerate(zip(hosts[::3], hosts[1::3], hosts[2::3])):
        passage = " ".join(f"p{n}{r.choice(VOCABULARY)}" for _ in range(51 + n))
        planted.append(passage)
        for k in some:
            w = given[k].split(" ")
            at = r.randrange(1, len(w))
            given[k] = " ".join([*w[:at], f"u{k}", passage, f"v{k}", *w[at:]])
    out = line_dedup.line_dedup(docs_of(list(given.items())), with_counts=True).collect()
    check_dedup(out, given)
    assert all(sum(p.split()[25] in (x["text"] or "").split() for x in out) == 1 for p in planted)


def test_clean_documents_are_left_alone(docs_of):
    r = random.Random(8)
    given = {k: prose(r, 120) for k in range(40)}
    assert {x["doc_id"]: x["text"] for x in line_dedup.line_dedup(docs_of(list(given.items()))).collect()} == given


def test_winnowing_guarantee():
    """Every window holds a fingerprint, and each fingerprint is the least line of a window around it."""
    r = random.Random(2)
    raws = [" ".join(r.choice("abcdef") for _ in range(n)).encode() for n in (0, 3, 9, 10, 200, 77)]
    block = line_dedup.Block(raws, 10, 4)
    at = set(block.fingerprints().tolist())
    ends = np.cumsum([len(x.split()) for x in raws])
    seen = set()
    for s, e in zip(ends - [len(x.split()) for x in raws], ends):
        for w in range(s, e - 9):
            lines = {i: block.lines[i] for i in range(w, w + 7)}
            best = {i for i, h in lines.items() if h == min(lines.values())}
            assert best <= at
            seen |= best
    assert seen == at


def test_word_hashes_in_pieces(monkeypatch):
    raw = b"ab cd  ef " + b"z" * 70_000 + b" ab\tcd " + b"q" * 40_000 + b" ef"
    edges = _hashes.word_edges(raw)
    whole = _hashes.word_hashes(raw, *edges)
    monkeypatch.setattr(_hashes, "PIECE", 64)
    assert (whole == _hashes.word_hashes(raw, *edges)).all()
    words = raw.split()
    assert len(set(whole.tolist())) == len(set(words)) and all((words[i] == words[j]) == (whole[i] == whole[j]) for i in range(len(words)) for j in range(len(words)))


# ---- 7 ----------------------------------------------------------------------------------------------------------------


def brute_one_of_each(given, shingle=5):
    """The least id of each group of texts linked by four bits or by five-word shingles at 0.8, by trying all pairs that share a shingle."""
    sets, by = {}, collections.defaultdict(list)
    for k, t in given.items():
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for x in sets[k]:
            by[x].append(k)
    root = brute_groups({k: brute_fingerprint(t, shingle) for k, t in given.items()})
    pairs = {(a, b) for many in by.values() for a in many for b in many if a < b}
    pairs = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in [*pairs, *root.items()]:
            least = min(root[a], root[b])
            changed |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    return sorted(k for k, g in root.items() if k == g)


def test_near_copies_at_a_similarity_of_0_8_go(docs_of):
    """Against all pairs: a copy with some words changed is far beyond four bits, and goes all the same."""
    r = random.Random(31)
    given = {}
    for k in range(12):
        words = [r.choice(VOCABULARY) for _ in range(r.randint(60, 200))]
        given[10 * k] = " ".join(words)
        for j, changes in enumerate((1, 2, 3, 4, 6)):
            some = list(words)
            for at in r.sample(range(len(words)), changes):
                some[at] = f"new{k}{j}{at}"
            given[10 * k + j + 1] = " ".join(some)
    given |= {500: "", 501: "a b", 502: "A  b", 503: None}
    want = brute_one_of_each(given, 4)
    got = sorted(x["doc_id"] for x in simhash.one_of_each(docs_of(list(given.items())), similar=True).collect())
    assert got == want
    assert len(got) < len([x for x in simhash.one_of_each(docs_of(list(given.items()))).collect()])


def test_bits_never_rule_out_what_is_shared():
    r = np.random.default_rng(6)
    for _ in range(300):
        shared, a, b = (r.integers(0, 1 << 63, r.integers(0, k), np.uint64) for k in (400, 90, 90))
        x, y = np.unique(np.append(shared, a)), np.unique(np.append(shared, b))
        if len(x) and len(y):
            most = near_copies_module.most_shared(len(x), near_copies_module.bits_of(x), len(y), near_copies_module.bits_of(y))
            assert len(np.intersect1d(x, y)) <= most <= min(len(x), len(y))
    assert near_copies_module.most_shared(300, near_copies_module.bits_of(r.integers(0, 1 << 63, 300, np.uint64)), 300, near_copies_module.bits_of(r.integers(0, 1 << 63, 300, np.uint64))) < 150


def brute_fingerprint(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if shingles and 2 * ones[b] > len(shingles))


def brute_groups(prints, distance=4):
    """component of each id: prints {id: fingerprint}."""
    root = {k: k for k in prints}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in ids}


def near_copies(r):
    base = prose(r, 300).split(" ")
    out = []
    for _ in range(12):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(VOCABULARY)
        out.append(" ".join(w))
    return out


def test_groups_equal_brute_force(docs_of, texts):
    r = random.Random(5)
    given = ["", None, " ", "One", "one", "ONE two", "é É", "a b c d", "a b c d e", *near_copies(r), *near_copies(r), *texts.values()]
    given = {3 * k + 1: t for k, t in enumerate(given)}
    got = {x["doc_id"]: x for x in simhash.simhash_groups(docs_of(list(given.items()))).collect()}
    prints = {k: brute_fingerprint(t) for k, t in given.items()}
    assert {k: x["fingerprint"] for k, x in got.items()} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {k: x["component_id"] for k, x in got.items()} == brute_groups(prints)


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 6])
def test_no_link_is_missed(spark, distance):
    """Clustered and correlated fingerprints, compared pair by pair."""
    r = random.Random(distance)
    seeds = [r.getrandbits(64) & 0x0F0F0F0F00FF00FF for _ in range(12)]
    prints = {s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for s in seeds for _ in range(25)} | {0, (1 << 64) - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {(x["a"], x["b"]) for x in simhash.links(df, distance).collect()}
    assert got == {tuple(sorted((signed(a), signed(b)))) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= distance}


def test_thresholds_of_the_general_pigeonhole():
    cost = [np.array([1.0, 5.0, 20.0]), np.array([2.0, 4.0, 30.0]), np.array([9.0, 90.0, 900.0])]
    best, t = simhash.allocate(cost, 2)
    assert sum(x + 1 for x in t) == 3 and best == 5.0 and t == [0, 1, -1]


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, 5000 + k) for k in range(1, 200)]
    root = {}

    def top(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        if a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {x["id"]: x["root"] for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: top(k) for k in root}


def test_one_of_each(docs_of):
    r = random.Random(7)
    one, two = near_copies(r)[0], prose(r, 200)
    given = [(9, one), (4, one), (4, one), (7, two), (None, two), (8, ""), (2, None), (3, prose(r, 100))]
    got = simhash.one_of_each(docs_of(given).withColumn("fp", F.lit("clash")))
    assert sorted(x["doc_id"] for x in got.collect()) == [2, 3, 4, 7] and "fp" in got.columns
    # Texts that share an id or have none are judged each by itself; of equal rows always the same one stays.
    three, four = prose(r, 90), prose(r, 91)
    given = [(1, one, "b"), (1, one, "a"), (1, two, "c"), (None, three, "d"), (None, four, "e"), (None, two, "f")]
    for parts in (1, 5):
        got = simhash.one_of_each(docs_of(given, parts), similar=True).collect()
        assert sorted((x["doc_id"] or 0, x["source"]) for x in got) == [(0, "d"), (0, "e"), (1, "a"), (1, "c")]


# ---- 10 ---------------------------------------------------------------------------------------------------------------


def sources(spark, tokens):
    return spark.createDataFrame([(s, 1, t) for s, t in tokens.items()], "src string, n_docs long, tokens long")


def test_exponent_for_repeats(spark):
    t = sources(spark, {"a": 1000, "b": 100, "c": 50})
    a = mixing.exponent(t, most_repeats=1.5)
    assert a == pytest.approx(1 + math.log(1.5) / math.log(50 / 1000), abs=1e-9)
    w = {x["src"]: x["epochs"] for x in mixing.target_weights(t, a).collect()}
    assert w["a"] == 1.0 and w["c"] == pytest.approx(1.5) and w["c"] <= 1.5 + 1e-9
    assert mixing.exponent(t, most_repeats=1e9) == 0.0
    assert mixing.exponent(sources(spark, {"a": 7}), most_repeats=1.1) == 0.0
    assert mixing.exponent(sources(spark, {"a": 0}), most_repeats=1.1) == 1.0


def test_exponent_for_entropy(spark):
    t = sources(spark, {"a": 1000, "b": 100, "c": 50})
    a = mixing.exponent(t, None, entropy=0.9)
    w = np.array([1000, 100, 50]) ** a
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9, abs=1e-8)
    assert mixing.exponent(t, None, entropy=5.0) == 0.0 and mixing.exponent(t, None, entropy=0.1) == 1.0


def corpus():
    return [(k, prose(random.Random(k), 20 + k % 90), "hot" if k % 3 else f"s{k % 9}") for k in range(900)]


def test_mixing_meets_its_weights_and_loses_nothing(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_BLOCK", 500)  # many blocks
    given = corpus()
    out = mixing.mixed(docs_of(given), most_repeats=2.5).select("*", "mix.*").collect()
    n = {k: len(t.split()) for k, t, _ in given}
    assert collections.Counter(r["doc_id"] for r in out if r["pass"] == 0) == collections.Counter(list(n))
    by, seen = collections.defaultdict(int), collections.Counter()
    for r in out:
        assert r["tokens"] == n[r["doc_id"]]
        by[r["source"]] += r["tokens"]
        seen[r["doc_id"], r["pass"]] += 1
    assert set(seen.values()) == {1}
    own = collections.defaultdict(int)
    for k, _, s in given:
        own[s] += n[k]
    weight = {r["source"]: (r["weight"], r["epochs"]) for r in out}
    for s, (_, epochs) in weight.items():
        assert epochs * own[s] - 110 <= by[s] <= epochs * own[s] + 1e-6  # short by less than a document
        assert max(r["pass"] for r in out if r["source"] == s) <= math.ceil(epochs) - 1
    assert sum(w for w, _ in weight.values()) == pytest.approx(1)
    # A pass goes through its blocks in the order of their places, one after another.
    for s in weight:
        for p in range(3):
            places = {(r["block"], r["place"]) for r in out if r["source"] == s and r["pass"] == p}
            assert len({b for b, _ in places}) == len(places) == len({q for _, q in places})


def test_a_budget_below_the_corpus_takes_part_of_it(docs_of):
    given = corpus()
    total = sum(len(t.split()) for _, t, _ in given)
    out = mixing.mixed(docs_of(given), most_repeats=None, entropy=1.3, budget=total / 2).select("mix.*").collect()
    assert 0.45 * total < sum(r["tokens"] for r in out) <= total / 2


def test_mixing_is_native_and_the_same_for_any_partitions(docs_of):
    given = corpus()
    a, b = (mixing.mixed(docs_of(given, parts=p)) for p in (1, 7))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert not re.search("Python|Pandas|Arrow", a._jdf.queryExecution().toString())


# ---- all --------------------------------------------------------------------------------------------------------------

ALL = {"scores": lm_scores.lm_scores, "lines": line_dedup.line_dedup, "groups": simhash.simhash_groups, "one": simhash.one_of_each, "mixed": mixing.mixed}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(docs_of, name):
    assert ALL[name](docs_of([(1, "x")]).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("name", ALL)
def test_nulls_repeats_and_clashing_names(docs_of, name):
    long = prose(random.Random(1), 80)
    df = docs_of([(None, None, None), (None, long, "s"), (5, long, "s"), (5, long, "s"), (5, "other", None), (6, None, "s"), (7, "z" * 150_000, "s")])
    for c in ("id", "th", "fp", "block", "n", "mix", "row", "src", "key", "ranges", "turn", "n_removed", "first"):
        df = df.withColumn(c, F.lit("clash"))
    got = collections.Counter(r["doc_id"] for r in ALL[name](df).collect())
    if name == "one":  # the null-text rows are one group of 6, the copies one of 5; the other text under 5 is its own
        assert got == {5: 2, 6: 1, 7: 1}
    elif name == "mixed":
        assert set(got) == {None, 5, 6, 7} and got[None] >= 2 and got[5] >= 3
    else:
        assert got == {None: 2, 5: 3, 6: 1, 7: 1}


def test_added_columns_step_aside_for_those_there(docs_of):
    df = docs_of(["a b c"]).withColumn("n_removed", F.lit("mine")).withColumn("mix", F.lit("mine"))
    assert line_dedup.line_dedup(df, with_counts=True).first()["n_removed"] == "mine"
    assert mixing.mixed(df).first()["mix"] == "mine"
