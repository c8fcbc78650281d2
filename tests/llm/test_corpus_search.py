"""Source divergence, suffix removal and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.llm import divergence, lexical, suffixes

from .conftest import BASE, LONG, TEXTS

ROWS = [*TEXTS, TEXTS[12]]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# divergence


def diverging(rows, least, top):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    count, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        groups = sorted({r[1] for r in rows if r[0] == lang})

        def share(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 1000000000 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: share(count[lang, s]) for s in groups}
        q = share(sum((count[lang, s] for s in groups), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, value, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [128, 2])
def test_divergence(spark, block):
    rand = random.Random(3)
    words = ["the", "The", "über", "漢字", "a", "extraordinarily", "extraordinary", "extraordinarilyso", "don't", "ét", "x1y", "zz" * 40, "zz" * 40 + "a"]
    rows = [(rand.choice(["en", "de", None, ""]), rand.choice(["s1", "s2", "s3", "é", None]), " ".join(rand.choices(words, k=rand.randrange(30)))) for _ in range(120)]
    rows += [("fr", "lonely", "only here"), ("fr", "silent", None), ("fr", "empty", ""), ("en", "s1", " ".join(["the"] * 5000)), *rows[:3]]
    kind = "lang string, source string, text string"
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], kind + ", term long, item string, n long").repartition(3)
    got = sorted(map(tuple, divergence.source_divergence(df, 4, 3, block, 5).collect()))
    assert got == diverging(rows, 4, 3)
    assert divergence.source_divergence(df.where("false")).count() == 0


def test_long_texts_are_sorted_in_parts(spark):
    rows = [("en", f"s{i % 2}", t) for i, t in enumerate([LONG, BASE, LONG.upper(), "w" * 3000 + " w", BASE])]
    df = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    got = {(r.lang, r.source, r.term): (r.n, r.d_lang) for r in divergence.term_counts(df, 1, 1000).collect()}
    want, holders = Counter(), Counter()
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        want.update((lang, source, t) for t in terms)
        holders.update(set(terms))
    assert got == {k: (n, holders[k[2]]) for k, n in want.items()}


@given(st.lists(st.text(st.sampled_from("abéZ -"), max_size=40), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_pointers_sort_by_term(texts):
    w = divergence.Words(pa.array(texts, pa.large_string()), space=divergence.BETWEEN)
    p = divergence.Pointers(divergence.LOWER[w.data], w.start, w.end)
    order, lead = p.sort()
    terms = [t.encode() for t in p.terms(order).to_pylist()]
    assert terms == sorted(t.encode() for text in texts for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))
    assert lead.tolist() == [i == 0 or terms[i] != terms[i - 1] for i in range(len(terms))]


# suffixes


def removed(rows, length):
    """(doc_id, bytes, spans, hash) of each row, by brute force."""
    docs = [(math.inf if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in docs:
        for i in range(len(t) - length + 1):
            least[t[i : i + length]] = min(d, least.get(t[i : i + length], math.inf))
    out = []
    for (d, t), (name, _) in zip(docs, rows, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = [(m.start(), m.end() - m.start()) for m in re.finditer(b"\1+", bytes(gone))]
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((name, len(t), tuple(spans), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


#: A family of near copies, a passage in many documents, periodic texts.
FAMILY = [(100 + i, " ".join("edit" if (i * 7 + j) % 41 == 3 else w for j, w in enumerate((BASE + " and then " + BASE[::-1]).split()))) for i in range(25)]
SHARED = [(200 + i, f"start {i} of a text. " + BASE[:130] + f" end {i * i} of it") for i in range(25)]
PERIODIC = [(300 + i, "ab" * (60 + i)) for i in range(4)] + [(310, "\0" * 90), (311, "\0" * 120), (300, "ab" * 70)]


@pytest.mark.parametrize("hot, known, shard", [(1 << 16, 4_000_000, 2 << 20), (1, 4_000_000, 2000), (1 << 16, 0, 2000), (3, 0, 1), (2, 150, 500)])
def test_suffixes(spark, hot, known, shard):
    rows = [*ROWS, *FAMILY, *SHARED, *PERIODIC]
    df = spark.createDataFrame([(d, t, 1, b"x", [1], 5) for d, t in rows], "doc_id long, text string, seed long, bytes binary, spans array<int>, h long").repartition(5)
    out = suffixes.deduplicate(df, hot=hot, known=known, shard=shard).collect()
    got = sorted(((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), r.sha, bytes(r.kept)) for r in out), key=repr)
    assert got == removed(rows, 50)
    assert suffixes.digest(df.where("false")).count() == 0


def test_digest_of_suffixes(spark):
    df = spark.createDataFrame([(2, BASE), (1, BASE), (3, "#" + BASE[:60] + "%" + BASE[100:170])], "doc_id long, text string")
    n = len(BASE)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.digest(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {1: (n, 0, 0, hashlib.sha256(BASE.encode()).hexdigest()), 2: (n, n, 1, empty), 3: (132, 130, 2, hashlib.sha256(b"#%").hexdigest())}


@given(st.data(), st.sampled_from([9, 16, 24, 25, 50, 73]))
@settings(max_examples=120, deadline=None)
def test_difference_cover_by_brute_force(data, length):
    letters = data.draw(st.sampled_from(["a", "ab", "abcdefgh", "\0a"]))
    base = data.draw(st.text(st.sampled_from(letters), min_size=20, max_size=200)).encode()
    cuts = data.draw(st.lists(st.tuples(st.integers(0, 199), st.integers(1, 200), st.integers(0, 4), st.text(st.sampled_from(letters), max_size=9)), min_size=1, max_size=9))
    strings, docs = [base[a : a + n] + more.encode() for a, n, _, more in cuts], np.array([d for _, _, d, _ in cuts])
    least = {}
    for s, d in zip(strings, docs.tolist(), strict=True):
        for i in range(len(s) - length + 1):
            least[s[i : i + length]] = min(d, least.get(s[i : i + length], 9))
    want = {(k, i) for k, (s, d) in enumerate(zip(strings, docs.tolist(), strict=True)) for i in range(len(s) - length + 1) if least[s[i : i + length]] < d}
    end = np.cumsum([len(s) for s in strings])
    start = end - [len(s) for s in strings]
    places, of = suffixes.repeats(np.frombuffer(b"".join(strings), np.uint8), start, end, docs, length)
    assert {(k, p - start[k]) for p, k in zip(places.tolist(), of.tolist(), strict=True)} == want


# ranked search


def ranked(rows, items, top):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    docs = [(d, Counter(words(t))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    df = Counter(t for _, c in docs for t in c)
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    out = []
    for item, text in items:
        scores = []
        for d, c in docs:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            scores += [(-score, d is None, d)] if score > 0 else []
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("top, pairs, leaf", [(20, 50_000, 48), (3, 10, 2)])
def test_search(spark, monkeypatch, top, pairs, leaf):
    monkeypatch.setattr(lexical, "CHUNK", 7)
    rand = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["über", "漢字", "Ünit", "long" * 9, "long" * 9 + "er"]
    rows = [*ROWS, *[(1000 + i, " ".join(rand.choices(words, k=rand.randrange(1, 60)))) for i in range(120)], (5000, None), (None, "w1 w2 w3")]
    items = [(0, BASE[:60]), (1, "w1 W2 w3 w3"), (2, ""), (3, None), (4, "nowhere"), (1, "longlong über 漢字 " + "long" * 9), (None, "w7"), (7, " ".join(words))]
    df = spark.createDataFrame([(d, t, 1, [2], 3) for d, t in rows], "doc_id long, text string, score long, t array<int>, item long").repartition(3)
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id long")
    got = sorted(map(tuple, lexical.search(df, asked, top, pairs).collect()), key=repr)
    assert got == ranked(rows, items, top)
    assert lexical.search(df.where("false"), asked).count() == 0 == lexical.search(df, asked.where("false")).count()


@given(st.integers(0, 2**32 - 1), st.integers(1, 300), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_bounds_hold_and_prune(seed, n, leaf):
    rand = np.random.default_rng(seed)
    size = 30
    x = rand.integers(0, 10**10, (n, size)) * (rand.random((n, size)) < 0.3)
    x[np.arange(n), rand.integers(0, size, n)] = 10**10
    if n > 5:
        x[1:4] = x[0]
    row, col = np.nonzero(x)
    rows = lexical.Rows(np.searchsorted(row, np.arange(n + 1)), col, x[row, col])
    query = rand.integers(1, 4, size) * (rand.random(size) < 0.4)
    query[0] += 1
    at = np.flatnonzero(query)
    tree = lexical.BallTree(rows, size, (np.array([0, len(at)]), at, query[at]), leaf)
    bounds = tree.bounds[:, 0]
    assert sorted(i for m, _ in tree.leaves.values() for i in m.tolist()) == list(range(n))

    def members(node):
        return tree.leaves[node][0].tolist() if tree.below[node] is None else [i for c in tree.below[node] for i in members(c)]

    for node in range(len(bounds)):
        assert (x[members(node)] @ query).max() <= bounds[node]
    best = []
    tree.search(bounds, query, best, list(range(n)), 5)
    assert sorted(best, reverse=True) == sorted(((int(s), -i) for i, s in enumerate(x @ query) if s > 0), reverse=True)[:5]


def test_far_groups_are_not_scored():
    rand = np.random.default_rng(1)
    x = np.zeros((1000, 10), np.int64)
    for g in range(10):
        x[g * 100 : g * 100 + 100, g] = 10**9 + rand.integers(0, 10**7, 100)
    row, col = np.nonzero(x)
    tree = lexical.BallTree(lexical.Rows(np.searchsorted(row, np.arange(1001)), col, x[row, col]), 10, (np.array([0, 1]), np.array([3]), np.array([1])), 20)
    bounds = tree.bounds[:, 0]
    best = []
    scored = tree.search(bounds, np.eye(10, dtype=np.int64)[3], best, list(range(1000)), 5)
    assert len(best) == 5 and scored <= 150
