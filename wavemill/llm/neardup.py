"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ._spread import hot_keys, one_each, salted_join, written
from ._words import U, Words, mix, pieces

SHINGLE, BANDS, ROWS = 5, 24, 3
#: Links have 100 * intersection >= LEAST * union.
LEAST = 75

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BINS = BANDS * ROWS
_PROBES = mix(np.arange(_BINS * 4096, dtype=U), 17).reshape(4096, _BINS) % U(_BINS)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, by text and then in order, and the text of each.

    A text with fewer than k words has its whole word sequence as its one shingle; one without words has none.
    """
    w = Words(texts)
    h = w.hashes(_LOWER)
    g, at = w.grams(h, k, 1)
    doc = w.doc[at]
    for n in range(1, k):
        few = np.flatnonzero(w.count == n)
        if len(few):
            x, first = w.grams(h, n, 100 + n)
            g = np.concatenate([g, x[np.searchsorted(first, w.first[few])]])
            doc = np.concatenate([doc, few])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[fresh], doc[fresh]


def band_keys(g: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """A row of BANDS keys for each text (meaningless for one without shingles).

    One permutation: a shingle's bin is its hash's place among _BINS equal ranges, a bin's value its
    least hash. An empty bin takes the value of the first non-empty bin on a probe sequence of its own
    (optimal densification), the same for all texts.
    """
    bin_ = (((g >> U(32)) * U(_BINS)) >> U(32)).astype(np.int64)
    lead = np.ones(len(g), bool)
    lead[1:] = (bin_[1:] != bin_[:-1]) | (doc[1:] != doc[:-1])
    value, full = np.zeros((docs, _BINS), U), np.zeros((docs, _BINS), bool)
    value[doc[lead], bin_[lead]], full[doc[lead], bin_[lead]] = g[lead], True
    some = full.any(1)
    row, col = np.nonzero(~full & some[:, None])
    out = value.copy()
    for probe in _PROBES:
        if not len(row):
            break
        from_ = probe[col].astype(np.int64)
        hit = full[row, from_]
        out[row[hit], col[hit]] = value[row[hit], from_[hit]]
        row, col = row[~hit], col[~hit]
    keys = np.zeros((docs, BANDS), U)
    for r in range(ROWS):
        keys = mix(keys + out[:, r::ROWS], r) * U(0x9E3779B97F4A7C15)
    return mix(keys + np.arange(BANDS, dtype=U), 9)


def _sums(x: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    upto = np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])
    at = np.searchsorted(doc, np.arange(docs + 1))
    return upto[at[1:]] - upto[at[:-1]]


_SKETCH = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _sketch():
    """struct of a text: size of its set, 128 bits of the set, its band keys."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for piece in pieces(texts):
            docs = len(piece)
            g, doc = shingle_sets(piece)
            n = np.bincount(doc, minlength=docs)
            k = [_sums(mix(g, s), doc, docs).view(np.int64) for s in (21, 22)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(docs + 1) * BANDS, pa.int32()), pa.array(band_keys(g, doc, docs).view(np.int64).ravel()))
            out.append(pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), *map(pa.array, k), flat], _SKETCH.names))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))]))

    return F.arrow_udf(run, _SKETCH)


def _set():
    """struct of a text: 128 bits of its set, and the set in order as little-endian 64-bit bytes."""
    kind = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("set", T.BinaryType())])

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for piece in pieces(texts):
            docs = len(piece)
            g, doc = shingle_sets(piece)
            k = [pa.array(_sums(mix(g, s), doc, docs).view(np.int64)) for s in (21, 22)]
            at = np.searchsorted(doc, np.arange(docs + 1)) * 8
            raw = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(g.astype("<u8").tobytes())])
            out.append(pa.StructArray.from_arrays([*k, raw], kind.names))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("set", pa.binary())]))

    return F.arrow_udf(run, kind)


def _overlap(rest: bool):
    """struct of two sets: their sizes, the size of the intersection and, with ``rest``, what the first has alone."""
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("na", "nb", "inter")] + [T.StructField("rest", T.ArrayType(T.LongType()))])

    def run(one: pa.Array, two: pa.Array) -> pa.Array:
        sizes, alone = [], []
        for x, y in zip(one, two, strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
            both = np.isin(a, b, assume_unique=True)
            sizes.append((len(a), len(b), int(both.sum())))
            alone.append(a[~both] if rest else a[:0])
        n = np.array(sizes, np.int64).reshape(-1, 3)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in alone])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(alone) if alone else np.zeros(0, np.int64)))
        return pa.StructArray.from_arrays([*map(pa.array, n.T), lists], kind.names)

    return F.arrow_udf(run, kind)


def _is_link(na="na", nb="nb", inter="inter"):
    return 100 * F.col(inter) >= LEAST * (F.col(na) + F.col(nb) - F.col(inter))


def _compared(edges: DataFrame, sets: DataFrame, rest: bool, name: str) -> DataFrame:
    """``edges`` (a, b) with na, nb, inter and rest, from whole sets. Many edges may share their b."""
    edges = written(edges, name + "-edges")
    hot = hot_keys(edges.groupBy("b").count(), ["b"], "count", edges.count())
    near = edges.join(sets.select(F.col("uid").alias("a"), F.col("set").alias("_a")), "a")
    both = salted_join(near, sets.select(F.col("uid").alias("b"), F.col("set").alias("_b")), ["b"], hot, F.col("a"))
    return written(both.withColumn("o", _overlap(rest)(F.col("_a"), F.col("_b"))).select("a", "b", "o.*"), name)


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """uid and label, the least uid reachable, of every uid in ``links`` (a, b).

    Each round takes the least label of the neighbours, then the label's own label, so a path shrinks by half
    or so; every round is a written table, and only whether any label changed reaches the driver.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), name + "-links")
    busy = written(hot_keys(both.groupBy("b").count(), ["b"], "count", both.count()), name + "-busy")
    labels = written(both.select(F.col("a").alias("uid"), F.col("a").alias("old")).distinct().withColumn("label", F.col("uid")), name)
    while True:
        now = labels.select("uid", F.col("label").alias("old"))
        least = salted_join(both, now.select(F.col("uid").alias("b"), "old"), ["b"], busy, F.col("a")).groupBy("a").agg(F.min("old").alias("_least"))
        step = now.join(least.withColumnRenamed("a", "uid"), "uid").select("uid", "old", F.least("old", "_least").alias("_to"))
        step = written(step, name + "-step")
        hot = hot_keys(step.groupBy("_to").count(), ["_to"], "count", step.count())
        jumped = salted_join(step, now.select(F.col("uid").alias("_to"), F.col("old").alias("_jump")), ["_to"], hot, F.col("uid"))
        labels = written(jumped.select("uid", "old", F.least("_to", "_jump").alias("label")), name)
        if labels.where("old <> label").isEmpty():
            return labels.select("uid", "label")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (see components) after more ``links`` (a, b).

    Only links between different labels change anything, so components are sought among labels, not among all links again.
    """
    links = written(links.select("a", "b"), "more-links")
    of = labels.select("uid", "label")
    here = links.join(of.select(F.col("uid").alias("a"), F.col("label").alias("_la")), "a", "left")
    hot = hot_keys(links.groupBy("b").count(), ["b"], "count", links.count())
    here = salted_join(here, of.select(F.col("uid").alias("b"), F.col("label").alias("_lb")), ["b"], hot, F.col("a"), "left")
    between = here.select(F.coalesce("_la", "a").alias("a"), F.coalesce("_lb", "b").alias("b")).where("a <> b").distinct()
    up = components(between, "merged")
    every = written(of.union(up.select("uid", F.col("uid").alias("label")).join(of, "uid", "left_anti")), "merging")
    hot = hot_keys(every.groupBy("label").count(), ["label"], "count", every.count())
    moved = salted_join(every, up.select(F.col("uid").alias("label"), F.col("label").alias("_up")), ["label"], hot, F.col("uid"), "left")
    return written(moved.select("uid", F.coalesce("_up", "label").alias("label")), "labels")


def _centres(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) to a second hub of each star whose members are in several components: one for each other member.

    It is the member that is likeliest to share much with the others: what it shares with the first hub, and of its
    shingles beside those the share of members that have them.
    """
    of = labels.select("uid", "label")
    m = found.join(of.select(F.col("uid").alias("a"), F.col("label").alias("_l")), "a", "left").withColumn("la", F.coalesce("_l", "a"))
    mixed = m.groupBy("b").agg(F.min("la").alias("lo"), F.max("la").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("b", "n")
    mixed = written(mixed, "mixed-hubs")
    m = written(salted_join(m, mixed, ["b"], hot_keys(mixed, ["b"], "n", found.count()), F.col("a")).select("a", "b", "inter", "rest", "n"), "mixed")
    posts = m.select("a", "b", F.explode("rest").alias("s"))
    common = posts.groupBy("b", "s").count().where("count > 1")
    near = posts.join(common, ["b", "s"]).groupBy("a", "b").agg(F.sum("count").alias("far"))
    scored = m.select("a", "b", "inter", "n").join(near, ["a", "b"], "left").withColumn("score", F.col("inter") + F.coalesce("far", F.lit(0)) / F.col("n"))
    best = scored.groupBy("b").agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("c"))
    edges = m.select("a", "b").join(best, "b").where("a <> c").select("a", F.col("c").alias("b")).distinct()
    both = found.select("a", "b").union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.join(both, ["a", "b"], "left_anti")


def _across(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) that may be links between components although a star has shown neither.

    ``found``: compared star edges (a: member, b: hub). With hub C, |A & B| is at most min(|A & C|, |B & C|)
    plus what A and B share outside C, and a link needs 3/7 of |A| + |B|. A pair in different components has
    at least one that isn't linked with C. So it shares a shingle outside C that stands in
    more than one component (lists by hub and shingle), or one of them is smaller than C
    and both have nearly all in C. Lists with the same members count once, and a member leaves its longest lists, as far as
    a link with the list's smallest set, or one of three quarters of the member's, has to share more shingles than they stand for. A pair that meets under several hubs is sought under
    one where it can: the nearest hub of the one or else of the other. These are conditions that any link meets:
    no pair that could be one is left out.
    """
    mine = found.groupBy("a").agg(F.collect_set("b").alias("hubs"), F.max_by("b", F.struct("inter", -F.col("b"))).alias("near"))
    of = labels.select(F.col("uid"), "label")
    m = found.join(of.select(F.col("uid").alias("a"), F.col("label").alias("_la")), "a", "left").join(of.select(F.col("uid").alias("b"), F.col("label").alias("_lb")), "b", "left")
    m = m.withColumns({"la": F.coalesce("_la", "a"), "lb": F.coalesce("_lb", "b")})
    mixed = m.groupBy("b").agg(F.min(F.least("la", "lb")).alias("lo"), F.max(F.greatest("la", "lb")).alias("hi"), F.min("na").alias("least_n"), F.count("*").alias("n")).where("lo <> hi").select("b", "least_n", "n")
    mixed = written(mixed, "mixed-hubs")
    m = written(salted_join(m, mixed.drop("n"), ["b"], hot_keys(mixed, ["b"], "n", found.count()), F.col("a")).join(mine, "a").select("a", F.col("b").alias("hub"), "la", "na", "nb", "inter", "rest", "least_n", "hubs", "near", (~_is_link()).alias("out")), "members")

    def here(b: str):
        """Whether a pair is sought under this hub; hubs of a member are BANDS at most."""
        swap = F.col("a") > F.col(b)
        one, other = F.when(swap, F.col("hubs_b")).otherwise(F.col("hubs")), F.when(swap, F.col("hubs")).otherwise(F.col("hubs_b"))
        first_near, second_near = F.when(swap, F.col("near_b")).otherwise(F.col("near")), F.when(swap, F.col("near")).otherwise(F.col("near_b"))
        second, first_ = F.greatest("a", b), F.least("a", b)
        under_first = F.array_contains(other, first_near) | (second == first_near)
        under_second = F.array_contains(one, second_near) | (first_ == second_near)
        return F.when(under_first, F.col("hub") == first_near).when(under_second, F.col("hub") == second_near).otherwise(True)

    posts = m.select("hub", "a", "la", "na", F.explode("rest").alias("s"))
    lists = posts.groupBy("hub", "s").agg(F.min("la").alias("lo"), F.max("la").alias("hi"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("a")).alias("h"), F.min("na").alias("least")).where("lo <> hi").select("hub", "s", "c", "h", "least")
    lead = lists.groupBy("hub", "c", "h").agg(F.min("s").alias("s"), F.count("*").alias("lead")).select("hub", "s", "lead")
    lists = written(lists.select("hub", "s", "c", "least").join(lead, ["hub", "s"], "left"), "lists")
    inside = written(posts.join(lists, ["hub", "s"]).select("hub", "s", "a", "lead", "c", "least"), "postings")
    able = inside.groupBy("hub", "a").agg(F.count("*").alias("g")).join(m.drop("rest"), ["hub", "a"]).where("4 * (inter + g) >= 3 * na")
    x = inside.where("lead is not null").join(able.select("hub", "a", "la", "na", "inter", "g", "out", "hubs", "near"), ["hub", "a"])
    # the longest lists of a member, so many that a link must share more than they stand for, aren't needed: the shortest list that a pair shares is another one
    longest = F.sum("lead").over(W.partitionBy("hub", "a").orderBy(F.desc("c"), F.desc("s")).rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("_sum", longest).where(7 * (F.col("_sum") + F.col("inter")) >= 3 * (F.col("na") + F.greatest(F.ceil(0.75 * F.col("na")), "least"))).drop("_sum", "lead", "c", "least")
    x = written(x, "able")
    y = x.select("hub", "s", F.col("a").alias("b"), F.col("la").alias("lb"), F.col("na").alias("nb"), F.col("inter").alias("ib"), F.col("g").alias("gb"), F.col("hubs").alias("hubs_b"), F.col("near").alias("near_b"))
    fits = (F.col("la") != F.col("lb")) & (4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb"))
    share = 7 * (F.least("inter", "ib") + F.least("g", "gb")) >= 3 * (F.col("na") + F.col("nb"))
    first = x.where("out").join(y, ["hub", "s"]).where(fits & share & here("b")).select("a", "b")
    small = m.where("na < nb").select("hub", F.col("a").alias("b"), F.col("la").alias("lb"), F.col("na").alias("n2"), F.col("inter").alias("ib"), F.col("hubs").alias("hubs_b"), F.col("near").alias("near_b"))
    wide = m.where("out and 7 * inter - 3 * na >= 3 * least_n").select("hub", "a", "la", "na", "inter", "hubs", "near")
    fits2 = (F.col("la") != F.col("lb")) & (7 * F.least("inter", "ib") >= 3 * (F.col("na") + F.col("n2"))) & (4 * F.least("na", "n2") >= 3 * F.greatest("na", "n2"))
    second = wide.join(small, "hub").where(fits2 & here("b")).select("a", "b")
    pairs = first.union(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tested = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(tested, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_shingles, component_id, kept.

    Equal sets are one class from the start, so copies cost one row. A class's BANDS keys of ROWS values each make
    two classes with similarity 0.75 share no bucket once in 500,000 times. In a bucket the class that falls into the most and
    largest buckets is the hub and the others are compared with it alone; where that leaves several components,
    with a second, more central hub (see _centres); what such stars can't settle is found by _across. Links are confirmed on whole sets. Texts without words (null, empty, white space) have an
    empty set and are linked with nothing. component_id is the least doc_id reachable; rows that repeat
    share it. A null doc_id counts as its own component if nothing else is reachable. Very long texts are one row like any other: their
    sets are worked on one at a time. An empty table gives an empty one. Other columns don't pass.
    """
    docs = docs.select("doc_id", "text")
    sketched = written(docs.withColumn("k", _sketch()(F.col("text"))).select("doc_id", "k.*"), "sketches")
    classes = sketched.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("uid", F.monotonically_increasing_id()), "classes")
    total = max(1, classes.count())
    rows = classes.select("uid", F.explode("bands").alias("band"))
    again = written(rows.groupBy("band").count().where("count >= 2"), "buckets")
    crowded = hot_keys(again, ["band"], "count", total)
    members = written(salted_join(rows, again, ["band"], crowded, F.col("uid")), "bucketed")
    known = members.groupBy("uid").agg(F.sum(F.log("count")).alias("pull"))
    wanted = known.join(classes.select("uid", "rep", "k1", "k2"), "uid")
    texts = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.rep)).withColumn("z", _set()(F.col("text")))
    sets = one_each(texts.where("z.k1 = k1 and z.k2 = k2").select("uid", "z.set"), ["uid"], "sets")
    hubs = members.join(known, "uid").groupBy("band").agg(F.max_by("uid", F.struct("pull", -F.col("uid"))).alias("b"))
    edges = salted_join(members.select("band", F.col("uid").alias("a")), hubs, ["band"], crowded, F.col("a")).where("a <> b").select("a", "b").distinct()
    found = _compared(edges, sets, True, "stars")
    labels = components(found.where(_is_link()))
    second = _compared(_centres(found, labels), sets, True, "centres")
    if not second.isEmpty():
        found = written(found.union(second), "stars")
        labels = _merged(labels, second.where(_is_link()))
    more = _compared(_across(found, labels), sets, False, "across").where(_is_link()).select("a", "b")
    if not more.isEmpty():
        labels = _merged(labels, more)
    of = classes.select("uid", "k1", "k2", "rep", "copies").join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    of = written(of.select("uid", "k1", "k2", "rep", "copies", "label"), "labelled")
    least = written(of.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), "least")
    home = salted_join(of, least.drop("n"), ["label"], hot_keys(least, ["label"], "n", total), F.col("uid"))
    home = written(home.select("k1", "k2", "copies", "component_id"), "components")
    some = salted_join(sketched.where("n_shingles > 0").drop("bands"), home.drop("copies"), ["k1", "k2"], hot_keys(home, ["k1", "k2"], "copies", sketched.count()), F.struct("doc_id"))
    none = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.select("doc_id", "n_shingles", "component_id").union(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The same in DuckDB.
SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, md5(array_to_string(ws[i:i + 4], ' ')) as h from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.h = y.h and x.doc_id <> y.doc_id group by all) p
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
reach(a, b) as (select doc_id, doc_id from w union select r.a, e.b from reach r join e on e.a = r.b),
least_ as (select a, min(b) as b from reach group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, b as component_id, w.doc_id = b as kept
from w left join n using (doc_id) join least_ on a = w.doc_id
"""
