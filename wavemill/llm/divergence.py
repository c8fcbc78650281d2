"""How far the sources of a language differ in their words, by sorting pointers to the starts of words.

A slice of texts is one Arrow buffer of bytes. Pointers to its word starts are sorted by the words they
point at with a multikey quicksort on slices of eight bytes: all pointers by their first slice, then only
those within runs that are equal so far by the next one. Equal runs give occurrences and documents
of a word, by language and source. Runs of all slices are added up by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._spread import hot_keys, numbered, salted_join, written
from ._words import Words

#: Documents of a language that a kept term needs, terms that are listed for each group.
LEAST, TOP = 10, 10
#: Bytes of text whose pointers are sorted together; terms and sources that are compared in one task.
SLICE, TERMS, BLOCK = 12 << 20, 4096, 128

#: Bytes between terms: all of ASCII but letters.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: The n first bytes of a slice.
_FIRST = np.array([(1 << 64) - (1 << 8 * (8 - n)) for n in range(9)], np.uint64)

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])


class Pointers:
    """data: bytes, then eight zeros; start, end: of each pointer's term."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.end = np.concatenate([data, np.zeros(8, np.uint8)]), start, end
        self._slices = np.ndarray(len(self.data) - 7, ">u8", self.data, 0, (1,))

    def slices(self, which: np.ndarray, depth: int) -> np.ndarray:
        """The terms' bytes from ``depth`` on, eight at most, as one number that sorts as they do."""
        at, end = self.start[which] + depth, self.end[which]
        return self._slices[np.minimum(at, end)].astype(np.uint64) & _FIRST[np.clip(end - at, 0, 8)]

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Pointers by term (equal ones as they stood), and whether each begins a run of equal terms."""
        n = len(self.start)
        lead = np.ones(n, bool)
        if not n:
            return np.zeros(0, np.int64), lead
        key = self.slices(np.arange(n), 0)
        order = np.argsort(key, kind="stable")
        key = key[order]
        lead[1:] = key[1:] != key[:-1]
        live, depth = np.arange(n), 0
        while True:
            first = np.flatnonzero(lead[live])
            several = np.repeat(np.diff(np.append(first, len(live))) > 1, np.diff(np.append(first, len(live))))
            more = several & ((key & np.uint64(255)) != 0)  # a full slice: equal terms may still differ
            live = live[more]
            if not len(live):
                return order, lead
            depth += 8
            run = np.cumsum(lead[live])
            key = self.slices(order[live], depth)
            o = np.lexsort((key, run))
            order[live], key = order[live][o], key[o]
            lead[live[1:]] |= key[1:] != key[:-1]

    def terms(self, which: np.ndarray) -> pa.Array:
        size = self.end[which] - self.start[which]
        off = np.concatenate([[0], np.cumsum(size)])
        raw = self.data[np.repeat(self.start[which] - off[:-1], size) + np.arange(off[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])


def counted(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the texts by ``group``, which must not fall: term, group, occurrences, texts that hold it."""
    w = Words(texts, space=BETWEEN)
    p = Pointers(LOWER[w.data], w.start, w.end)
    order, lead = p.sort()
    doc = w.doc[order]
    of = group[doc]
    lead[1:] |= of[1:] != of[:-1]
    fresh = lead.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(lead)
    docs = np.add.reduceat(fresh, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    return p.terms(order[first]), of[first], np.diff(np.append(first, len(order))), docs


def _parts(text: pa.Array, most: int) -> Iterator[pa.Array]:
    """One text in parts of about ``most`` bytes that end between terms."""
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + 2]
    data = np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[1]]
    at = 0
    while at < len(data):
        to = min(len(data), at + most)
        while to < len(data) and not BETWEEN[data[to]]:
            to += 1
        ends = np.array([0, to - at], np.int64)
        yield pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[at:to].tobytes())])
        at = to


def _of_one(text: pa.Array, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """As counted, of one long text whose parts are sorted apart."""
    found = [counted(part, np.zeros(1, np.int64)) for part in _parts(text, most)]
    t = pa.table({"t": pa.concat_arrays([x[0] for x in found]), "n": np.concatenate([x[2] for x in found])}).group_by("t").aggregate([("n", "sum")])
    return t["t"].combine_chunks(), np.zeros(len(t), np.int64), t["n_sum"].to_numpy(), np.ones(len(t), np.int64)


def _partial(most: int):
    def some(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        mine = list(zip(t["lang"].to_pylist(), t["source"].to_pylist(), strict=True))
        names = sorted(set(mine))
        number = {x: i for i, x in enumerate(names)}
        group = np.array([number[x] for x in mine], np.int64)
        order = np.argsort(group, kind="stable")
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in t["text"].chunks]).take(pa.array(order))
        one = len(texts) == 1 and texts.nbytes > 2 * most
        term, of, n, d = _of_one(texts, most) if one else counted(texts, group[order])
        of = group[order][of] if one else of
        langs, sources = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
        for k in range(0, len(of), 1 << 16):
            s = slice(k, k + (1 << 16))
            yield pa.record_batch([langs.take(pa.array(of[s])), sources.take(pa.array(of[s])), term[s].cast(pa.string()), pa.array(n[s]), pa.array(d[s])], schema=_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            long = batch.column("text").cast(pa.large_string())
            off = np.frombuffer(long.buffers()[1], np.int64)[long.offset : long.offset + len(batch) + 1] if len(batch) else np.zeros(1, np.int64)
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(off, off[at] + most - size, "right")) - 1)
                mine = int(off[to] - off[at])
                if held and size + mine > most:
                    yield from some(held)
                    held, size = [], 0
                    continue
                held.append(batch.slice(at, to - at))
                size, at = size + mine, to
                if size >= most:
                    yield from some(held)
                    held, size = [], 0
        if held:
            yield from some(held)

    return run


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(docs: DataFrame, least: int = LEAST, most: int = SLICE) -> DataFrame:
    """lang, source, term, n and, of the term in the whole language, n_lang, d_lang and first: true at its least source. Terms in ``least`` documents of the language alone.

    Partial counts are dealt by language and term: what a source, a language and the threshold need meets there, with one shuffle.
    A slice gives a term once a group, so a term that all documents hold is as many rows as there are slices and groups.
    """
    kind = "lang string, source string, term string, n long, d long"
    found = _plain(docs).mapInArrow(_partial(most), kind).repartition("lang", "term")
    each = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    all_ = W.partitionBy("lang", "term")  # a row a source
    each = each.withColumns({"n_lang": F.sum("n").over(all_), "d_lang": F.sum("d").over(all_), "first": F.col("source") == F.min("source").over(all_)})
    return each.where(F.col("d_lang") >= least).select("lang", "source", "term", "n", "n_lang", "d_lang", "first")


def _share(n: str, total: str, terms: str = "v") -> Column:
    """Smoothed share of a term in billionths, plus one; decimals, so that no count is too large."""
    return F.expr(f"case when {terms} = 0 then 1L else 1 + cast((cast({n} as decimal(20, 0)) + 2) * 1000000000 div (cast({total} as decimal(20, 0)) + 2 * cast({terms} as decimal(20, 0))) as bigint) end")


def _far(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _block_pairs(rows: pa.Table, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over a shard's terms of f for each source of one block and each of another, with V * f of shares without occurrences from the first shard."""
    is_base = rows["term"].is_null().to_numpy()
    i, p, v, shard = (rows[c].to_numpy() for c in ("i", "p", "v", "shard"))
    a, b = rows["a"][0].as_py(), rows["b"][0].as_py()
    base = np.zeros(2 * block, np.int64)
    here = np.zeros(2 * block, bool)
    place = np.where(i // block == a, i - a * block, block + i - b * block)
    base[place[is_base]], here[place[is_base]] = p[is_base], True
    term = rows["term"].combine_chunks().dictionary_encode().indices.fill_null(0).to_numpy(zero_copy_only=False)[~is_base]
    seen = int(term.max()) + 1 if len(term) else 0
    shares = np.broadcast_to(base, (seen, 2 * block)).copy()
    shares[term, place[~is_base]] = p[~is_base]
    rest = (int(v[is_base][0]) if shard[0] == 0 else 0) - seen
    x = np.flatnonzero(here[:block])
    y = x if a == b else block + np.flatnonzero(here[block:])
    total = np.empty((len(x), len(y)), np.int64)
    other, other0 = np.ascontiguousarray(shares[:, y]), base[y]
    for k, at in enumerate(x):
        d = other - shares[:, at : at + 1]
        total[k] = (d * d // (other + shares[:, at : at + 1])).sum(0) + rest * ((other0 - base[at]) ** 2 // (other0 + base[at]))
    one, two = np.repeat(a * block + x, len(y)), np.tile(np.where(y < block, a * block + y, (b - 1) * block + y), len(x))
    apart = one != two
    return one[apart], two[apart], total.ravel()[apart]


def _compared(block: int):
    out = pa.schema([("lang", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("value", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        i, j, value = _block_pairs(rows, block)
        return pa.table([pa.repeat(rows["lang"][0], len(i)), i, j, value], schema=out)

    return run


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, terms: int = TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): see the parts ``pair`` and ``term`` below.

    ``pair``: of each source of a language every other one, by the divergence of their words; ``term``: of each source the ``top`` terms
    that it has more often than its language. Null lang, source and text count as empty; a group without terms has shares
    like any other, and a language without kept terms has pairs of value 0. Repeated rows count each. Very long texts are sorted in
    parts that end between terms. An empty table gives an empty one; other columns don't pass. Ties are ranked by item.
    Pairs are the result asked for, so their number is the square of a language's sources; terms are dealt over shards and sources over blocks.
    """
    counts = written(term_counts(docs, least), "counts")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), F.sum(F.col("first").cast("long")).alias("v"))
    sums = written(sums, "sums")
    of_lang = sums.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("total").alias("total_lang"))
    groups = written(_plain(docs).select("lang", "source").distinct(), "groups")
    every = numbered(groups, ["lang"], ["source"], "i", groups.count())
    every = every.join(sums.drop("v"), ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "rows", "v", "total_lang"])
    every = written(every.withColumn("p0", _share("0", "total")), "sources")
    hot = hot_keys(every, ["lang", "source"], "rows", max(1, counts.count()))
    shares = salted_join(counts, every.drop("rows", "p0"), ["lang", "source"], hot, F.col("term"))
    shares = written(shares.select("lang", "source", "term", "i", "v", _share("n", "total").alias("p"), _share("n_lang", "total_lang").alias("q")), "shares")

    shards = F.greatest(F.ceil(F.col("v") / terms), F.lit(1)).cast("int")
    its = F.floor(F.col("i") / block).cast("int")
    blocks = every.groupBy("lang").agg((F.floor(F.max("i") / block) + 1).cast("int").alias("blocks"))
    rows = shares.select("lang", "i", "v", "p", "term", F.pmod(F.xxhash64("term"), shards).cast("int").alias("shard"))
    base = every.select("lang", "i", "v", F.col("p0").alias("p"), F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    meets = F.array_distinct(F.concat(F.transform(other, lambda b: F.struct(its.alias("a"), b.alias("b"))), F.transform(other, lambda b: F.struct(b.alias("a"), its.alias("b")))))
    dealt = rows.union(base).join(blocks, "lang").withColumn("m", F.explode(meets)).select("lang", "i", "v", "p", "term", "shard", "m.a", "m.b")
    found = dealt.groupBy("lang", "shard", "a", "b").applyInArrow(_compared(block), "lang string, i long, j long, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    names = every.select("lang", "i", "source")
    pairs = found.join(names, ["lang", "i"]).join(names.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])

    def ranked(df: DataFrame, part: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))

    higher = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _far("p", "q").alias("value"))
    return ranked(pairs, "pair").union(ranked(higher, "term").where(F.col("rank") <= top))


#: The same in DuckDB.
SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
o as (select lang, source, r, unnest(ts) as term from d),
k as (select lang, term, count(*) as n_lang from o group by lang, term having count(distinct r) >= 10),
c as (select lang, source, term, count(*) as n from o join k using (lang, term) group by all),
l as (select lang, count(*) as v, sum(n_lang) as total_lang from k group by lang),
g as (select g.lang, g.source, coalesce(l.v, 0) as v, coalesce(total_lang, 0) as total_lang, coalesce(s.total, 0) as total
    from (select distinct lang, source from d) g left join l using (lang) left join (select lang, source, sum(n) as total from c group by all) s using (lang, source)),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) as p,
    1 + (1000000000::hugeint * (k.n_lang + 2)) // (g.total_lang + 2 * g.v) as q
    from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (
  select x.lang, x.source, 'pair' as part, y.source as item, cast(coalesce(value, 0) as bigint) as value
  from g x join g y on x.lang = y.lang and x.source <> y.source left join pairs on pairs.lang = x.lang and pairs.source = x.source and pairs.item = y.source
  union all
  select lang, source, 'term', term, cast((p - q) * (p - q) // (p + q) as bigint) from p where n > 0 and p > q)
select lang, source, part, item, value, cast(rank as int) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every) where part = 'pair' or rank <= 10
"""
