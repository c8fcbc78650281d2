"""Each operator against brute force on a small hostile table, and on an empty one."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavemill.llm import decontam, html, neardup, packing, pii, quality, sharding, substring, toxicity, urls

from wavemill.llm._spread import written

from .conftest import BASE, TEXTS

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [*TEXTS, TEXTS[12]]


def rows(df):
    return [tuple(r) for r in df.collect()]


# packing


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=60, deadline=None)
def test_plan_gives_each_item_one_gapless_place(lengths):
    bins, placed = {}, Counter()
    for length, rank, n, first, each, offset in packing.plan(list(Counter(lengths).items()), 64):
        for j in range(n):
            bins.setdefault(first + j // each, []).append((offset + j % each * length, length))
            placed[length, rank + j] += 1
    assert placed == Counter((x, i) for x, n in Counter(lengths).items() for i in range(n))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    if lengths:
        assert len(bins) <= 11 * -(-sum(lengths) // 64) / 9 + 2


def test_packing(spark, docs, none):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    out = packing.pack_documents(docs, VOCABULARY).toPandas()
    want = Counter()
    for d, t in ROWS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 4096):
            want[d, p // 4096, p, len(ids[p : p + 4096]), zlib.crc32(np.array(ids[p : p + 4096], "<u4").tobytes())] += 1
    got = Counter((None if d != d else int(d), *r) for d, *r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert got == want
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.cumsum(s["length"]) - s["length"]).all() and s["length"].sum() <= 4096
    assert packing.pack_documents(none, VOCABULARY).count() == 0


def test_sequences_hold_the_ids_of_their_pieces(spark, docs):
    cuts = packing.cut(packing.tokenise(docs.where("doc_id in (0, 7, 10)").select("doc_id", "text"), VOCABULARY), 64).drop("text")
    packed = written(packing.pack(written(cuts, "t-cuts"), ["doc_id", "piece"], 64), "t-packed")
    whole = {r.sequence_id: bytes(r.ids) for r in packing.assemble(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_encoder_equals_the_tokenizer():
    import pyarrow as pa

    tokenizer, encoder = Tokenizer.from_file(VOCABULARY), packing._Encoder(VOCABULARY)
    for text in ["A<|endoftext|>b", "İ ÇA'S don't x'll'd", "≮a b<\u0338c a\u0301,b", "\x02 a \x02b", "１２ ab12cd", "\x85 \x1c!\xa0x", "🙂ok🙂, ok!🙂", "a'b 'S !'s x's's", "ΟΔΟΣ, σ"]:
        assert encoder(pa.array([text], pa.large_string()))[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


# sharding


def test_sharding(docs, none):
    out = sharding.digest(docs, 4).toPandas()
    assert len(out) == len(ROWS) and set(out["law"]) == {"bytes"}
    text = dict(TEXTS)
    of = {None if d != d else int(d): (s, c, h) for d, s, c, h in out[["doc_id", "size", "text_crc32", "shard"]].itertuples(index=False)}
    for d, (size, crc, _) in of.items():
        raw = (text[d] or "").encode()
        assert (size, crc) == (len(raw) + 8, zlib.crc32(raw))
    assert of[0][2] == of[1][2] and of[4][2] == of[5][2]
    for _, s in out.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    assert sharding.digest(none, 4).count() == 0


@given(st.lists(st.tuples(st.integers(1, 500), st.integers(1, 40)), min_size=1, max_size=30, unique_by=lambda x: x[0]), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_shard_plan_places_every_group_and_is_even(classes, shards):
    plan = sharding.plan([(size, size * n, n) for size, n in classes], shards)
    placed, load = Counter(), Counter()
    for name, first, n, shard in plan:
        assert 0 <= shard < shards
        placed.update((name, first + i) for i in range(n))
        load[shard] += name * n
    assert placed == Counter((s, i) for s, n in classes for i in range(n))
    assert max(load.values()) <= sum(s * n for s, n in classes) / shards + max(s for s, _ in classes) + 1


# near duplicates


def _sets():
    out = {}
    for d, t in TEXTS:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        out[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def test_near_duplicates(docs, none):
    sets = _sets()
    reach = {d: d for d in sets}
    while True:
        new = {a: min([reach[a], *(reach[b] for b in sets if None not in (a, b) and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))]) if a is not None else None for a in sets}
        if new == reach:
            break
        reach = new
    got = Counter(rows(neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")))
    assert got == Counter((d, len(sets[d]), reach[d], d == reach[d]) for d, _ in ROWS)
    assert neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("times", [1, 2])
def test_across_components_of_a_large_family(spark, times):
    """Copies of one text with many edits: most pairs are near the limit, and stars alone miss some. Rows that repeat change nothing."""
    import random

    rand = random.Random(4)
    base = [f"w{rand.randrange(10**6)}" for _ in range(70)]
    texts = []
    for i in range(160):
        w = list(base if i % 4 or not texts else texts[rand.randrange(len(texts))].split())
        for _ in range(rand.randrange(4)):
            w[rand.randrange(len(w))] = f"z{rand.randrange(40)}"
        texts.append(" ".join(w))
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(66)) for t in texts]
    reach = list(range(len(texts)))
    for _ in range(20):
        for a in range(len(sets)):
            for b in range(len(sets)):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    reach[a] = reach[b] = min(reach[a], reach[b])
    got = dict(rows(neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)) * times, "doc_id long, text string")).select("doc_id", "component_id")))
    assert [got[i] for i in range(len(texts))] == reach


def test_sets_of_repeated_rows_are_one(spark):
    from wavemill.llm._spread import one_each

    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (1, "a")], "uid long, x string")
    assert sorted(rows(one_each(twice, ["uid"], "t-one"))) == [(1, "a"), (2, "b")]


# toxicity


def test_toxicity_learns_words_from_document_labels(spark):
    import random

    rand = random.Random(2)
    texts = []
    for i in range(500):
        words = [f"w{rand.randrange(300)}" for _ in range(60)]
        if i % 5 == 0:
            words[rand.randrange(60)] = rand.choice(["vile", "nasty"])
        texts.append((i, " ".join(w + "." * (j % 9 == 8) for j, w in enumerate(words))))
    docs = spark.createDataFrame([*texts, (500, None), (501, ""), (502, "Vile!")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.digest(docs, labels).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert sum(out[i].predicted == (i % 5 == 0) for i in range(500) if out[i].held_out) >= 0.97 * sum(out[i].held_out for i in range(500))
    assert out[500].score == 0 and out[501].score == 0 and out[502].predicted == 1
    assert all(0 <= r.score <= 1 for r in out.values())
    bad = next(out[i] for i in range(0, 500, 5) if out[i].predicted)
    assert any(re.search("vile|nasty", texts[bad.doc_id][1][s.start : s.end]) for s in bad.offending)


def test_toxicity_is_the_noisy_or_of_sentences(docs):
    """Each score, and the offending sentences, from the model's weights by plain arithmetic."""
    import math

    weight = lambda part: zlib.crc32(part.encode()[::-1]) % 200 / 100 - 1.1
    parts = lambda w: {"=" + w, *("^" + w[:k] for k in (3, 4, 5) if len(w) >= k), *(["$" + w[-4:]] if len(w) >= 4 else [])}
    words = {w for _, t in ROWS for w in re.findall(r"\w+", (t or "").lower())}
    weights = {zlib.crc32(p.encode()) % toxicity.BUCKETS: weight(p) for w in words for p in parts(w)}
    got = {}
    for r in toxicity.score(docs, {"weights": weights, "bias": -1.5, "floor": 0.0}).collect():
        got.setdefault(r.doc_id, []).append((r.toxicity, [(x.start, x.end) for x in r.offending]))
    for d, t in ROWS:
        none, spans = 1.0, []
        for m in re.finditer(r"[^.!?\n]+", t or ""):
            z = -1.5 + sum(weights[f] for w in re.findall(r"\w+", m.group()) for f in {zlib.crc32(p.encode()) % toxicity.BUCKETS for p in parts(w.lower())})
            p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            none *= 1 - p
            spans += [m.span()] if z >= 0 else []
        assert all(abs(score - (1 - none)) < 1e-9 and found == spans for score, found in got[d]), d
    assert len(got) == len({d for d, _ in ROWS})


def test_toxicity_without_labels_or_rows(docs, none, labels):
    assert {r.score for r in toxicity.digest(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.digest(docs, labels).count() == len(ROWS)
    assert toxicity.digest(none, labels).count() == 0


# substring dedup


@pytest.mark.parametrize("length,seed", [(35, 8), (6, 3)])
def test_substring_dedup(docs, none, length, seed):
    words = [(d, WORD.findall(t or "")) for d, t in ROWS]
    seen = Counter(tuple(w[i : i + length]) for _, w in words for i in range(len(w) - length + 1))
    want = Counter()
    for d, w in words:
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        want[d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    assert Counter(rows(substring.digest(docs, length, seed))) == want
    assert substring.digest(none, length, seed).count() == 0


def test_substring_dedup_of_families(spark):
    """Passages shared in part, at text borders, within one text, and across factor boundaries."""
    import random

    rand = random.Random(8)
    word = lambda: f"v{rand.randrange(60)}"
    passages = [[word() for _ in range(rand.randrange(20, 120))] for _ in range(6)]
    texts = []
    for i in range(120):
        w = []
        for _ in range(rand.randrange(1, 5)):
            x = rand.choice(passages)
            lo = rand.randrange(len(x) // 2) if rand.random() < 0.5 else 0
            w += [f"u{i}.{rand.randrange(10**6)}" for _ in range(rand.randrange(4))] + x[lo : rand.randrange(lo + 1, len(x) + 1) if rand.random() < 0.6 else len(x)]
        texts.append((i, " ".join(w)))
    texts += [(1000, "a b " * 60), (1001, "a " * 200), (1002, "a b " * 20), *texts[:2], (1003, texts[0][1])]
    words = [(d, t.split()) for d, t in texts]
    seen = Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    want = Counter()
    for d, w in words:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert Counter(rows(substring.digest(docs))) == want
    _, _, cut = substring.repeated(docs, whole=True)
    some = 0
    for r in cut.collect():
        for f, g in zip(r.factors, r.factors[1:], strict=False):
            assert f["first"] < g["first"] and f["first"] + f["n_words"] < g["first"] + g["n_words"]
        some += sum(f["n_words"] >= 35 for f in r.factors)
        assert all(f["n_words"] >= 35 for f in r.factors)
    assert some > 60


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.integers(0, 2), st.integers(0, 2)), max_size=12))
@settings(max_examples=400, deadline=None)
def test_parse_is_greedy(given_):
    matches = [(a, a + n, source, a + shift) for a, n, source, shift in given_]
    cover: dict[tuple[int, int], set] = {}
    for a, b, source, at in matches:
        cover.setdefault((source, at - a), set()).update(range(a, b))
    runs = []  # maximal runs of one source and distance; those that touch are one match
    for (source, shift), place in cover.items():
        for a in place:
            if a - 1 not in place:
                b = a
                while b in place:
                    b += 1
                runs.append((a, b, source, a + shift))
    want, i = [], 0
    while i < 60:
        over = [r for r in runs if r[0] <= i < r[1]]
        if over:
            end = max(r[1] for r in over)
            want.append((end, min(r[0] for r in over if r[1] == end)))
            i = end
        else:
            i += 1
    assert [(b, a) for a, b, *_ in substring.parse(matches)] == want


# quality


def test_quality(docs, none, labels):
    def base(t):
        w = WORD.findall(t)
        g = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)
        return *n, n[0] < 50 or 100 * n[4] > 50 * n[0]

    got = rows(quality.digest(docs, labels).select("doc_id", *quality.COUNTS, "base_failed"))
    assert Counter(got) == Counter((d, *base(t or "")) for d, t in ROWS)
    unlabelled = rows(quality.digest(docs, labels.where("false")).select("base_failed", "kept"))
    assert all(kept != failed for failed, kept in unlabelled)
    assert quality.digest(none, labels).count() == 0


def test_documents_that_repeat_count_once_in_a_fit(spark):
    texts = [(i, " ".join(f"w{(i * 7 + j * j) % 90}" + ("" if i % 2 else " #") for j in range(80))) for i in range(200)]
    once = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)] * 2, "doc_id long, quality int, toxic int")
    many = once.union(once).union(once).union(once)
    one, four = quality.fit(once, labels, sample=200), quality.fit(many, labels, sample=200)
    assert all(np.array_equal(one[k], four[k]) for k in one) and len(one["feature"]) > 0
    kept = {r.doc_id: r.kept for r in quality.judge(many, four).collect()}
    assert kept == {i: i % 2 == 1 for i in range(200)}
    assert toxicity.fit(once, labels, sample=200) == toxicity.fit(many, labels, sample=200)


def test_trees_are_right_and_monotone():
    rand = np.random.default_rng(0)
    x = rand.random((3000, 4))
    y = ((x[:, 0] < 0.5) & (x[:, 2] > 0.3)).astype(float)
    model = quality.boost(x, y, falling=(0,))
    assert ((quality.score(model, x) >= 0.5) == y).mean() > 0.99
    low, high = x.copy(), x.copy()
    high[:, 0] = np.minimum(1, low[:, 0] + rand.random(3000))
    assert (quality.score(model, high) <= quality.score(model, low) + 1e-12).all()


# pages


def test_html():
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">menu</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>One  <b>bold</b>&nbsp;word<p>Two<br>lines<div class="ad">buy</div><form>mail <input></form><p>3 &lt; 4
    <!-- <p>hidden</p> --></article><aside>side</aside><section id="comments"><p>nice!</p></section><footer>&copy; us</footer>"""
    assert html.main_text(page) == "Head & line\nOne bold word\nTwo lines\n3 < 4"
    text = "A long enough paragraph of text that tells a story without any links, so that its window surges over the limit."
    assert html.main_text(f"<div><a href=x>home</a> <a href=y>news</a></div><div>{text}</div><div>{text}</div><div><a href=z>more of this</a></div>") == f"{text}\n{text}"
    parts = "<div class=menu>a b c</div><div class='post-content'><h1>H</h1><p>Short.</p><div class='share'>share it</div></div><div class=sidebar>" + text + "</div>"
    assert html.main_text(parts) == "H\nShort."
    assert [html.main_text(x) for x in (None, "", "<p>", "<<<>>> &", "<nav>only</nav>")][:3] == ["", "", ""]
    assert html.main_text("<article>" + "<p>x</p>" * 5000 + "</article>") == "\n".join(["x"] * 5000)


def test_html_surge_and_dive():
    text = "A long enough paragraph of text that tells a story without any links, so that its window surges over the limit."
    div = lambda *x: "".join(f"<div>{y}</div>" for y in x)
    plain = div("Title", "By Jo", "<b>3 May</b>", text, text, "<a href=x>a source in full</a>", text)
    want = f"Title\nBy Jo\n3 May\n{text}\n{text}\na source in full\n{text}"
    menu, more = div("<a href=x>home</a>", "<a href=y>news</a>"), div("<a href=z>more of this</a>")
    assert html.main_text(menu + plain + more) == want
    assert html.main_text(f"{menu}<article>{plain}</article>{div('Short remark')}{more}") == want
    assert html.main_text(f"<article class=card>Teaser</article>{menu}{plain}{more}") == want  # marked, but too short to surge
    assert html.main_text(f"<main> </main>{menu}{plain}") == want
    assert html.main_text(menu + plain + "<div class=ad>x</div>" * 4 + div("The end.")) == want + "\nThe end."


@given(st.lists(st.tuples(st.integers(0, 60), st.booleans(), st.booleans()), max_size=40))
@settings(max_examples=300, deadline=None)
def test_line_blocks_by_brute_force(given_):
    lines = [("x" * n, inside, n * link) for n, inside, link in given_]
    weigh = lambda line: (html.MARKED if line[1] else 1) * max(0, len(line[0]) - 2 * line[2])
    side = [0] + [sum(a[1] != b[1] for a, b in zip(lines[:i], lines[1 : i + 1], strict=False)) for i in range(1, len(lines))]
    weight = [weigh(x) for x in lines]
    window = [sum(weight[j] for j in range(i, min(i + 3, len(lines))) if side[j] == side[i]) for i in range(len(lines))]
    least, most = sorted((html.SURGE, max(window, default=0) / 2))
    want = set()
    for i, x in enumerate(lines):
        if window[i] > (most if any(y[1] for y in lines) and not x[1] else least):
            first, end = i, i
            while first and side[first - 1] == side[i] and weight[first - 1]:
                first -= 1
            while not weight[first]:
                first += 1
            while end < len(lines) and side[end] == side[i] and window[end]:
                end += 1
            want |= set(range(first, end))
    assert html.kept_lines(lines) == sorted(want)


def test_surge_and_dive_drop_what_no_mark_names():
    text = "A long enough paragraph of text that tells a story without any links, so that its window surges over the limit."
    menu = "".join(f"<div><a href=x{i}>page {i}</a></div>" for i in range(6))
    lines = html.lines_of(f"{menu}<div>{text}</div><div>{text}</div>{menu}")
    assert not any(off or inside for _, off, inside, _ in lines)
    assert [lines[i][0] for i in html.kept_lines([(t, m, n) for t, _, m, n in lines])] == [text, text]
    marked = html.lines_of(f"<article>{menu}<p>{text}<p>{text}{menu}</article>")  # in a marked part too
    assert [marked[i][0] for i in html.kept_lines([(t, m, n) for t, _, m, n in marked])] == [text, text]


def test_broken_pages_take_linear_time():
    import time

    n = 1 << 20
    pages = ["<a " * (n // 3), '<a "x" ' * (n // 7), '<a "x>" ' * (n // 8), "<a<a" * (n // 4), "<" * n, "<!" * (n // 2), "<!--" * (n // 4), "<div>" * (n // 10) + "</section>" * (n // 20)]
    pages += ["<li><div>" + "<form>" * (n // 12) + "</li>" * (n // 12), "<div>" * (n // 12) + "</b>" * (n // 12), "<a " + "a= " * (n // 3) + ">", "<a b='" * (n // 6) + ">", "<script>" * (n // 8), "<p>x" * (n // 4)]
    began = time.process_time()
    html.main_text(pages[0])
    assert time.process_time() - began < 1
    for page in pages[1:]:
        html.main_text(page)
    assert time.process_time() - began < 60
    assert html.main_text("<p>x" * 3) == "x\nx\nx" and html.main_text("<p>a&#" + "9" * 5000 + ";b&#" + "0" * 5000 + "65;</p><!-- c") == "a\ufffdbA"
    assert html.main_text('<p>one<p class="a>two<p>three</p>') == "one\ntwo\nthree"


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<article>é</article>", "t", 5), (2, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long")
    assert sorted(rows(html.digest(df))) == [(1, "u", "é", 1), (2, None, "", 0)]
    assert html.digest(df.where("false")).count() == 0


# personal data

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _base(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@given(st.text("a@.-+ 014(é)", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert [s[:3] for s in pii.spans_of(text) if s[0] in PATTERNS] == _base(text)


def test_pii(docs, none):
    got = {r.doc_id: r for r in pii.digest(docs).collect()}
    for d, t in TEXTS:
        base = _base(t or "")
        assert tuple(got[d][f"n_{k}"] for k in PATTERNS) == tuple(sum(s[0] == k for s in base) for k in PATTERNS)
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert [len(r.scores) for r in got.values()] == [len(r.spans.split(",")) if r.spans else 0 for r in got.values()]
    assert {s.split(":")[0] for s in got[16].spans.split(",")} == {"email", "card", "ip", "phone", "iban", "secret"}
    clean = {r.doc_id: r.text for r in pii.redact(docs).select("doc_id", "text").collect()}
    assert "<EMAIL>" in clean[16] and "4111" not in clean[16] and clean[4] is None and clean[0] == BASE
    assert pii.digest(none).count() == 0


def test_spans_that_a_greedy_run_or_a_gate_would_hide():
    found = lambda x: [(k, x[a:b]) for k, a, b, _ in pii.spans_of(x) if k in ("iban", "secret")]
    de, gb = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    for text in (de, f"{de} I said", f"{de} 2024", f"{de} BIC x", f"AB12 {de} OK", f"{de} A VERY LONG CRY IN CAPITALS WITHOUT END"):
        assert found(text) == [("iban", de)], text
    assert found(f"{de} {gb} {de}") == [("iban", de), ("iban", gb), ("iban", de)]
    assert found(f"x{de}") == found(f"{de}x") == found(de[:-1]) == found("DE88" + de[4:]) == []
    assert found("password = correcthorsebatterystaple") == [("secret", "correcthorsebatterystaple")]
    assert pii.redacted(f"password: correcthorsebatterystaple, to {de} NOW") == "password: <SECRET>, to <IBAN> NOW"


def test_context_words_decide(spark):
    kinds = lambda x: [k for k, *_ in pii.spans_of(x)], lambda x: pii.redacted(x)
    de = "DE89370400440532013000"
    for clean, other, kind in (
        (f"pay to {de} today", f"an example: {de} today", "iban"),
        ("password = correcthorsebatterystaple", "placeholder password = correcthorsebatterystaple", "secret"),
        ("social security 123-45-6789", "item 123-45-6789", "ssn"),
        ("call 555-123-4567 now", "item 555-123-4567 now", "local_phone"),
    ):
        assert kinds[0](clean) == kinds[0](other) == [kind]
        assert f"<{kind.upper()}>" in kinds[1](clean) and kinds[1](other) == other
        df = spark.createDataFrame([(1, clean), (2, other)], "doc_id long, text string")
        assert {r.doc_id: (r.spans.split(":")[0], len(r.scores)) for r in pii.digest(df).collect()} == {1: (kind, 1), 2: ("", 0)}
    assert [pii.spans_of(f"{de} {x}")[0][:3] for x in ("PLEASE", "AND 12", "X")] == [("iban", 0, 22)] * 3
    assert pii.spans_of("DE89 3704 0044 0532 0130 00 AND")[0][:3] == ("iban", 0, 27)
    assert pii.redacted("call x 555-123-4567 order") == "call x 555-123-4567 order" and pii.spans_of("ZZ89" + "1" * 100_000)[:1] == []


# URLs


def test_urls(spark):
    given_ = ["http://A.Example.com/en/x?y#z", "https://www.example.com/en/", "x://free-bets.shop.example.org/a", "http://n.net/es/1", "http://n.net/es", "nothing", None, "", "http://", "://h.com", "http://h.com/"]
    df = spark.createDataFrame(list(enumerate(given_)), "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r.page_id: tuple(r)[1:] for r in urls.digest(df).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[2][2:] == (None, "allow") and got[3][2:] == ("net/es/", "block") and got[4][2:] == (None, "allow")
    assert [got[i] for i in (5, 6, 7, 8)] == [("", "", None, "allow")] * 4
    assert got[9] == ("h.com", "", None, "allow") and got[10] == ("h.com", "/", "com/", "allow")
    assert urls.digest(df.where("false")).count() == 0


@pytest.mark.parametrize("most", [0, 16 << 20])
def test_variants_of_a_listed_url(spark, monkeypatch, most):
    """Both forms of the filter's join; other schemes, ports, slashes and queries; a hot host; a host of 200 KB."""
    monkeypatch.setattr(urls, "BROADCAST_BYTES", most)
    bad = ["http://a.org/p//1?x=1&ref=9", "https://www.a.org:443/p/1/", "x://u@a.org./p/1#t", "ftp://a.org/p/1", "http://casino-win.org/", "http://x.y.casino-win.org/deep"]
    good = ["http://a.org/p/2", "http://a.org/p", "http://b.a.org/p/1", "http://a.org/q#?ref=1", "http://win.org/", "http://" + "a." * 100_000 + "org/"]
    long = "http://" + "a." * 100_000 + "casino-win.org/"
    many = [f"http://hot.org/{i % 7}" for i in range(2000)] + ["http://hot.org/3?ref=x"] * 2
    df = spark.createDataFrame(list(enumerate([*bad, *good, long, *many])), "page_id long, url string").repartition(6)
    got = {r.page_id: r.verdict for r in urls.digest(df).collect()}
    assert len(got) == len(bad) + len(good) + 1 + len(many)
    assert [got[i] for i in range(len(bad) + len(good) + 1)] == ["block"] * len(bad) + ["allow"] * len(good) + ["block"]
    for i, u in enumerate(many, len(bad) + len(good) + 1):
        assert got[i] == ("block" if "/3" in u else "allow")
    some = spark.createDataFrame([("http://a.org/1",), ("http://a.org/1",), (None,)], "url string")
    out = urls.filter_urls(some.withColumn("rule", F.lit(5)), spark.createDataFrame([], "key string"))
    assert [r.verdict for r in out.collect()] == ["allow"] * 3 and sorted(out.columns) == ["rule", "url", "url_host", "url_path", "verdict"]


def test_bloom_passes_every_listed_key_and_the_join_removes_the_rest(spark):
    listed = spark.range(0, 4000, 2).select(F.concat(F.lit("k"), "id").alias("key"))
    keys = spark.range(6000).select("id", F.concat(F.lit("k"), "id").alias("key"))
    assert sorted(r.id for r in urls.hits(keys, listed).collect()) == list(range(0, 4000, 2))
    table, blocks = urls.bloom(listed, 2000)
    marked = keys.select("id", *urls._place(F.col("key"), blocks)).join(table, "_block")
    passed = marked.where(" and ".join(f"_f{w} & _w{w} = _w{w}" for w in range(4))).count()
    assert 2000 <= passed < 2000 + 0.02 * 4000


# decontamination


def test_leaks(spark, docs, none):
    import random

    rand = random.Random(6)
    word = lambda: "".join(rand.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rand.randrange(12, 50)))) for i in range(30)]
    noise = lambda n: " ".join(word() for _ in range(n))
    texts = [(i, f"{noise(60)} {t} {noise(70)}") for i, t in items]
    texts += [(100 + i, f"{noise(30)} {' '.join(w if j % 6 else word() for j, w in enumerate(t.upper().split()))}, {noise(9)}") for i, t in items]
    texts += [(200 + i, noise(150)) for i in range(60)] + [(300, None), (301, ""), (302, " ".join(items[0][1].split()[:3]))]
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    got = set(rows(decontam.digest(spark.createDataFrame(texts, "doc_id long, text string"), bench).select("doc_id", "item_id")))
    assert got == {(i, i) for i in range(30)} | {(100 + i, i) for i in range(30)}
    assert decontam.digest(none, bench).count() == 0
    assert decontam.digest(docs, bench.where("false")).count() == 0
    assert decontam.digest(docs, spark.createDataFrame([(1, BASE), (2, "x"), (3, " ")], "item_id long, text string")).where("doc_id = 0 and item_id = 1 or doc_id = 12 and item_id = 2").count() == 3
    clash = decontam.find_leaks(docs.withColumn("leaks", F.lit(1)), decontam.fit(docs, bench))
    assert clash.columns == [*docs.columns, "leaks"] and clash.count() == len(ROWS)


def test_leaks_of_items_with_a_repeated_id_or_none(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    bench = spark.createDataFrame([(1, a), (1, b), (None, c), (1, a)], "item_id long, text string")
    texts = spark.createDataFrame([(0, f"one {a} end"), (1, f"one {b} end"), (2, c), (3, f"{a} {b}"), (4, "one end")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.digest(texts, bench).collect()) == [(0, 1), (1, 1), (2, None), (3, 1), (3, 1)]


def test_leaks_in_part_paraphrased_and_with_a_short_answer(spark):
    import random

    rand = random.Random(4)
    word = lambda: "".join(rand.choice("klmnopqrst") for _ in range(5))
    noise = lambda n: [word() for _ in range(n)]
    items = [noise(100) for _ in range(20)] + [noise(40) for _ in range(20)]
    asked = [[*noise(20), "so?", word()] for _ in range(10)]
    bench = [(i, " ".join(x)) for i, x in enumerate([*items, *asked])]
    quoted = [(i, [*noise(30 + i), *x[33 + i : 57 + i], *noise(40)]) for i, x in enumerate(items[:20])]
    changed = [(20 + i, [*noise(33 + i), *(w if j * 5 % 8 < 5 else word() for j, w in enumerate(x)), *noise(40)]) for i, x in enumerate(items[20:])]
    short = [(40 + i, [*noise(30 + i), *(w if j % 2 or j > 19 else word() for j, w in enumerate(x)), *noise(40)]) for i, x in enumerate(asked)]
    none = [(100 + i, [*noise(40), *x[:9], *noise(40)]) for i, x in enumerate(items)]
    texts = spark.createDataFrame([(i, " ".join(x)) for i, x in [*quoted, *changed, *short, *none]], "doc_id long, text string")
    got = decontam.digest(texts, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(50)]


def test_leaks_against_all_pairs(spark, monkeypatch):
    """Paraphrases that keep 40 to 100 of 100 words: the search finds what a check of every window against every item confirms."""
    import random

    import pyarrow as pa

    rand = random.Random(11)
    words = [f"{a}{b}" for a in ("ab", "cor", "de", "fi", "lu", "mo", "ren", "tal") for b in ("na", "ter", "so", "ving", "le", "ra", "tis", "un", "wer")]
    common = lambda n: [rand.choice(words[:20]) if rand.random() < 0.4 else rand.choice(words) + rand.choice(words) for _ in range(n)]
    items = [[*common(rand.randrange(12, 45)), *(["done?", *common(rand.randrange(1, 6))] if i % 2 else [])] for i in range(30)]
    texts = []
    for share in (0.4, 0.5, 0.6, 0.7, 0.85, 1.0):
        for i, x in enumerate(items):
            last = x.index("done?") if i % 2 else len(x)
            kept = [w if rand.random() < share or j > last else rand.choice(words) for j, w in enumerate(x) if rand.random() < 0.95 or j > last]
            texts.append(" ".join([*common(rand.randrange(60)), *kept, *common(rand.randrange(60))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    monkeypatch.setattr(decontam, "SLICE", 7)
    found = Counter(rows(decontam.digest(docs, bench).select("doc_id", "item_id")))
    h = lambda x: decontam._hashes(decontam.Words(pa.array([x], pa.large_string()))).tolist()
    want = Counter()
    for d, t in enumerate(texts):
        all_ = h(t)
        for i, x in enumerate(items):
            item, answer = h(" ".join(x)), h(decontam._answer(" ".join(x)))
            for s in range(0, len(all_), decontam.STEP):
                near = all_[max(0, s - len(item)) : s + 24 + len(item)]
                share = decontam.common(item, near) / len(item)
                said = answer and any(near[j : j + len(answer)] == answer for j in range(len(near)))
                quoted = max(decontam.common(item[a : a + 24], all_[max(0, s - 12) : s + 36]) for a in range(0, max(1, len(item) - 12), 12))
                if share >= 0.6 or said and share >= (0.4 if len(answer) >= 4 else 0.5) or quoted >= 18:
                    want[d, i] = 1
                    break
    assert not found - want and sum((found & want).values()) >= 0.95 * sum(want.values()) and len(want) > 120


def test_latent_space_is_that_of_the_exact_decomposition(spark):
    rand = np.random.default_rng(1)
    a = rand.random((40, 12)) @ rand.random((12, 30))
    table = written(spark.createDataFrame([(list(range(30)), r.tolist()) for r in a], "bucket array<long>, value array<double>"), "t-latent")
    v = decontam.latent(table, np.arange(30), 5)
    exact = np.linalg.svd(a)[2][:5].T
    assert np.linalg.svd(v.T @ exact)[1][:3].min() > 0.95


def test_latent_space_takes_little_memory_of_the_driver(spark):
    """One matrix of BUCKETS rows and what is returned, at most a few MB besides: no copies in doubles, whatever the machine."""
    import tracemalloc

    rand = np.random.default_rng(8)
    rows = [(sorted({*range(i * 512, i * 512 + 512), *rand.integers(0, 2000, 40).tolist()}),) for i in range(128)]
    table = written(spark.createDataFrame(rows, "bucket array<long>").selectExpr("bucket", "transform(bucket, x -> 1D / (1 + x % 7)) as value"), "t-wide")
    tracemalloc.start()
    v = decontam.latent(table, np.arange(decontam.BUCKETS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(v.T @ v, np.eye(decontam.DIMENSIONS), atol=1e-3)
    assert peak < 3 * 4 * decontam.BUCKETS * (decontam.DIMENSIONS + decontam.MORE)


def test_columns_become_orthonormal_in_place():
    rand = np.random.default_rng(4)
    full = (rand.standard_normal((5000, 12)) @ np.diag(10.0 ** -np.linspace(0, 4, 12)) @ rand.standard_normal((12, 12))).astype(np.float32)
    q, m = np.linalg.qr(full.astype(float))[0], full.copy()
    decontam._orthonormal(m)
    assert np.allclose(m.T @ m, np.eye(12), atol=1e-4) and np.linalg.svd(q.T @ m)[1].min() > 0.99
    less = np.tile(full[:, :3], 2)
    decontam._orthonormal(less)
    assert np.allclose(np.linalg.eigvalsh(less.T @ less), [0, 0, 0, 1, 1, 1], atol=1e-3)
    none = np.zeros((7, 2), np.float32)
    decontam._orthonormal(none)
    assert not none.any()


def test_latent_space_is_fitted_on_all_passages(spark):
    """More passages than a sample of 10,000, copies, short tails and texts without words: each different one is a row, no word is left out for rarity in a sample."""
    import pyarrow as pa

    rand = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rand.integers(0, 5003, 41 * 24 + i % 24)) for i in range(270)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:40], texts[0].upper(), None, "", " "])), "doc_id long, text string").repartition(5)
    buckets = [(decontam._hashes(decontam.Words(pa.array([x], pa.large_string()))) % np.uint64(decontam.BUCKETS)).tolist() for x in texts]
    want = {tuple(sorted(x[a : a + 24])) for x in buckets for a in range(0, len(x), 24)}
    weight, passages = decontam.survey(docs)
    assert passages.count() == len(want) > 11_000
    found = [tuple(np.frombuffer(r.words, "<u2").tolist()) for r in passages.collect()]
    assert set(found) == want
    n = Counter(b for x in want for b in set(x))
    assert {r.b for r in decontam._often(passages).collect()} == {b for b, k in n.items() if k >= decontam.LEAST_PASSAGES}
    rows = decontam._weighed(weight)(pa.RecordBatch.from_arrays([pa.array([np.array(x, "<u2").tobytes() for x in found[:300]], pa.binary()), pa.array(np.full(300, 2.0))], ["words", "scale"]).slice(7))
    matrix = np.zeros((293, decontam.BUCKETS))
    for i, x in enumerate(found[7:300]):
        np.add.at(matrix[i], list(x), weight[list(x)])
        matrix[i] *= 2 / np.linalg.norm(matrix[i])
    got = np.zeros_like(matrix)
    got[rows[0], rows[1]] = rows[2]
    assert np.allclose(got, matrix)
    dense = np.random.default_rng(2).random((decontam.BUCKETS, 5)).astype(np.float32)
    for a, b, m in ((rows[0], rows[1], matrix), (rows[1], rows[0], matrix.T), (np.zeros(293, int), np.arange(293), np.ones((1, 293)))):
        out = np.zeros((len(m), 5), np.float32)
        decontam._add_product(out, a, b, m[a, b], dense[: m.shape[1]])
        assert np.allclose(out, m @ dense[: m.shape[1]], atol=1e-3)


def test_texts_are_lower_cased_in_tasks(spark):
    """As Spark's lower does, which took a good part of the JVM's time when it went over all texts twice: characters that become two, a last sigma, nulls, bytes that are no UTF-8."""
    import pyarrow as pa

    texts = ["ΟΔΟΣ ΣΑΣ, ΑΣ", "İZMİR and I", "GRÖẞE Ǆ ЖИЗНЬ Ⅷ Ａ", None, "", "x", "ÀÉÎÕÜ ÑANDÚ"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [r.t for r in table.select("doc_id", F.lower("text").alias("t")).orderBy("doc_id").collect()]
    for some in ([k] for k in range(len(texts))):
        assert decontam._lower(pa.array([texts[k] for k in some], pa.large_string())).to_pylist() == [want[k] for k in some]
    assert decontam._lower(pa.array(texts)).to_pylist() == want
    odd = pa.array([b"A\xffB", b"CD"]).cast(pa.large_binary())
    assert decontam._lower(pa.Array.from_buffers(pa.large_string(), 2, odd.buffers())).to_pylist() == ["a\ufffdb", "cd"]
    item = "ΟΔΟΣ ΣΑΣ İZMİR GRÖẞE ÑANDÚ " + " ".join(f"W{i}" for i in range(20))
    docs = spark.createDataFrame([(0, f"before {item} after"), (1, f"before {item.lower()} after"), (2, "before and after")], "doc_id long, text string")
    found = decontam.digest(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert sorted(rows(found.select("doc_id", "item_id", "common"))) == [(0, 5, 1.0), (1, 5, 1.0)]
    assert "lower(" not in found._jdf.queryExecution().toString()


@given(st.lists(st.text(alphabet="ab.,;!?(#'", min_size=1, max_size=12), max_size=9))
@settings(max_examples=200, deadline=None)
def test_marks_at_the_ends_of_words(texts):
    import pyarrow as pa

    def bare(x):
        begin, end = 0, len(x)
        for _ in range(4):
            end -= end - 1 > begin and x[end - 1] not in "ab"
            begin += end - 1 > begin and x[begin] not in "ab"
        return x[begin:end]

    h = lambda found: decontam.Words(pa.array([" ".join(found)], pa.large_string()))
    assert decontam._hashes(h(texts)).tolist() == h([bare(x) for x in texts]).hashes().tolist()


@given(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.lists(st.integers(0, 4), max_size=12))
@settings(max_examples=200, deadline=None)
def test_common_subsequence(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert decontam.common(a, b) == table[-1, -1]
