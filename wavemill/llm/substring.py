"""Removal of passages that occur elsewhere, by relative Lempel-Ziv parsing against indexed reference blocks.

Of LENGTH words, the SEED consecutive ones with the least hash are the window's seed, so equal windows have equal
seeds at equal places. The seeds of all documents are the index. Of each seed that occurs twice, one occurrence
gives a reference block: the words around it that windows with this seed can reach. Every other occurrence is matched
with that block, as far as the words agree to the left and right; matches with one source that go on in each
other are one. A document is then factored greedily: at the first word that no factor covers, the match that
covers it and reaches farthest is the next factor. Factors of LENGTH words or more are duplicate spans, of the document and of the source.

A block is one of many occurrences, so a match may end where another occurrence would go on. Hence the windows
at its boundaries, those with the seed that don't lie within the match, are looked up by fingerprint among
all such windows. This is complete: a window that two documents share lies within both matches, or within
neither, as otherwise the block would hold it for both; a window of the block itself that occurs elsewhere lies within the other's match.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spread import hot_keys, one_each, salted_join, written
from ._words import U, Words, mix, pieces

LENGTH, SEED = 35, 8
#: Bytes of a word's hash in a block; two different words agree once in 2**40.
_BYTES = 5
_POWER = np.concatenate([np.ones(1, U), np.multiply.accumulate(np.full(1 << 12, 0xD1342543DE82EF95, U))])


def _windows(w: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all places' seed-grams, the first words of all windows, the place of each window's seed."""
    h = w.hashes()
    g, at = w.grams(h, seed, 3)
    full = np.full(len(h), np.iinfo(np.uint64).max, U)
    full[at] = g
    n = len(h) - length + 1
    if n <= 0:
        return full, np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, span, grams = np.arange(len(h)), 1, length - seed + 1

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the lesser hashes; of equal ones the first place, as all of b are later."""
        return np.where(full[b] < full[a], b, a)

    while span * 2 <= grams:
        best = least(best[:-span], best[span:])
        span *= 2
    if span < grams:
        best = least(best[: len(best) - (grams - span)], best[grams - span :])
    first = np.flatnonzero(w.doc[:n] == w.doc[length - 1 :])
    return full, first, best[first]


def _joined(w: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of each text joined by one space: all bytes, and each text's first byte, and the end."""
    data, mask = w.data.copy(), np.zeros(len(w.data), bool)
    mask[np.repeat(w.start[keep], (w.end - w.start)[keep]) + _inside(w.end[keep] - w.start[keep])] = True
    at = np.flatnonzero(keep)
    later = at[1:][w.doc[at[1:]] == w.doc[at[:-1]]]  # not the first kept of its text
    data[w.start[later] - 1], mask[w.start[later] - 1] = 0x20, True
    upto = np.concatenate([[0], np.cumsum(mask)])
    return data[mask].tobytes(), upto[w.off]


def _inside(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _hashes(raw: bytes, off: np.ndarray) -> list[str]:
    view = memoryview(raw)
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def _lists(rows: np.ndarray, docs: int, values: pa.Array) -> pa.Array:
    """Values in order of their text as one list a text. rows: each value's text."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(docs + 1)), pa.int32()), values)


def _indexed(length: int, seed: int):
    """struct<n_words, plain, seeds> of a text: words, the hash of all of them joined, place and hash of its windows' seeds."""
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("plain", T.StringType()), T.StructField("seeds", T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("s", T.LongType())])))])

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for piece in pieces(texts):
            w = Words(piece)
            full, _, place = _windows(w, length, seed)
            place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
            rows = pa.StructArray.from_arrays([pa.array((place - w.first[w.doc[place]]).astype(np.int32)), pa.array(full[place].view(np.int64))], ["p", "s"])
            plain = _hashes(*_joined(w, np.ones(len(w.start), bool)))
            out.append(pa.StructArray.from_arrays([pa.array(w.count.astype(np.int64)), pa.array(plain), _lists(w.doc[place], len(piece), rows)], ["n_words", "plain", "seeds"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("n_words", pa.int64()), ("plain", pa.string()), ("seeds", pa.list_(pa.struct([("p", pa.int32()), ("s", pa.int64())])))]))

    return F.arrow_udf(run, kind)


def _blocks(length: int, seed: int):
    """Of a text and some places of its seeds: each with the first and last window that has it (counted from it) and the words around.

    The words are those of all windows that can have the seed, as _BYTES of their hashes each; zeros stand for words outside the text.
    """
    names = ["p", "a", "b", "s", "words"]
    item = T.StructType([T.StructField(n, t) for n, t in zip(names, [T.IntegerType()] * 3 + [T.LongType(), T.BinaryType()], strict=True)])
    before, wide = length - seed, 2 * length - seed

    def run(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out, done = [], 0
        for piece in pieces(texts, 1 << 19):
            mine = wanted.slice(done, len(piece))
            done += len(piece)
            w = Words(piece)
            full, first, place = _windows(w, length, seed)
            of = np.repeat(np.arange(len(piece)), mine.value_lengths().to_numpy(zero_copy_only=False))
            keep = np.isin(place, w.first[of] + mine.flatten().to_numpy())
            first, place = first[keep], place[keep]
            lead = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
            place, a, b = place[lead], first[lead], first[np.append(lead[1:], len(first)) - 1] if len(lead) else first
            doc = w.doc[place]
            at = place[:, None] + np.arange(-before, wide - before)
            inside = (at >= w.first[doc][:, None]) & (at < w.first[doc + 1][:, None])
            raw = w.hashes().view(np.uint8).reshape(-1, 8)[:, :_BYTES]
            words = raw[np.where(inside, at, 0)] * inside[:, :, None].astype(np.uint8) if len(place) else np.zeros(0, np.uint8)
            ends = np.arange(len(place) + 1, dtype=np.int32) * (wide * _BYTES)
            flat = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(words.tobytes())])
            numbers = [pa.array(x.astype(np.int32)) for x in (place - w.first[doc], a - place, b - place)]
            out.append(_lists(doc, len(piece), pa.StructArray.from_arrays([*numbers, pa.array(full[place].view(np.int64)), flat], names)))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("p", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("s", pa.int64()), ("words", pa.binary())])))

    return F.arrow_udf(run, T.ArrayType(item))


def _matched(length: int, seed: int):
    """Of the words around an occurrence, its windows a to b, and a block: how many words agree before the seed's place and from it, and the windows beyond the match with their fingerprints."""
    item = T.StructType([T.StructField("d", T.IntegerType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.IntegerType())])
    kind = T.StructType([T.StructField("l", T.IntegerType()), T.StructField("r", T.IntegerType()), T.StructField("beyond", T.ArrayType(item))])
    before, wide = length - seed, 2 * length - seed

    def words_of(raw: pa.Array) -> np.ndarray:
        n = len(raw)
        off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + n + 1]
        flat = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(n, wide, _BYTES)
        out = np.zeros((n, wide, 8), np.uint8)
        out[:, :, :_BYTES] = flat
        return out.view(U)[:, :, 0]

    def some(mine: pa.Array, block: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        x, a, b = words_of(mine), a.to_numpy(), b.to_numpy()
        same = (x == words_of(block)) & (x != 0)
        left = np.cumprod(same[:, :before][:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int32)
        right = np.cumprod(same[:, before:], axis=1, dtype=np.int8).sum(1, dtype=np.int32)
        d = np.arange(-before, 1)
        todo = (d >= a[:, None]) & (d <= b[:, None]) & ~((d >= -left[:, None]) & (d + length <= right[:, None]))
        rows = np.flatnonzero(todo.any(1))
        i, j = np.nonzero(todo[rows])
        two = []
        for s in (11, 12):
            total = np.zeros((len(rows), wide + 1), U)
            np.cumsum(mix(x[rows], s) * _POWER[:wide], axis=1, out=total[:, 1:])
            two.append(mix((total[i, j + length] - total[i, j]) * _POWER[wide - j]))
        found = pa.StructArray.from_arrays([pa.array(d[j].astype(np.int32)), pa.array(two[0].view(np.int64)), pa.array((two[1] >> U(32)).astype(np.uint32).view(np.int32))], ["d", "f1", "f2"])
        return pa.StructArray.from_arrays([pa.array(left), pa.array(right), _lists(rows[i], len(x), found)], kind.names)

    def run(mine: pa.Array, block: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        out = [some(*(c.slice(k, 4096) for c in (mine, block, a, b))) for k in range(0, len(mine), 4096)]
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("l", pa.int32()), ("r", pa.int32()), ("beyond", pa.list_(pa.struct([("d", pa.int32()), ("f1", pa.int64()), ("f2", pa.int32())])))]))

    return F.arrow_udf(run, kind)


def parse(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Greedy factors (from, to, source, source's word) from matches of that form.

    Matches that copy from one source at one distance and touch are one. At the first word that isn't covered but
    could be, the match that covers it and reaches farthest is taken; of those the one that begins first.
    """
    joined: list[list[int]] = []
    for a, b, source, at in sorted(matches, key=lambda m: (m[2], m[3] - m[0], m[0], m[1])):
        if joined and joined[-1][2] == source and joined[-1][3] - joined[-1][0] == at - a and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b, source, at])
    todo = sorted(joined, key=lambda m: (m[0], -m[1], m[2], m[3]))
    out: list[tuple[int, int, int, int]] = []
    done, k = 0, 0
    while k < len(todo):
        best = None
        done = max(done, todo[k][0])
        while k < len(todo) and todo[k][0] <= done:
            best = todo[k] if best is None or todo[k][1] > best[1] else best
            k += 1
        while best and best[1] > done:
            out.append(tuple(best))
            done, best = best[1], None
            while k < len(todo) and todo[k][0] <= done:
                best = todo[k] if best is None or todo[k][1] > best[1] else best
                k += 1
    return out


def _cut_out(length: int, whole: bool):
    """struct<n_removed, kept_sha256, kept, factors> of a text, its matches and its repeated boundary windows; the last two with ``whole`` alone."""
    factor = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("source", T.LongType()), T.StructField("source_first", T.IntegerType())])
    kind = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("factors", T.ArrayType(factor))])
    arrow = pa.list_(pa.struct([("first", pa.int32()), ("n_words", pa.int32()), ("source", pa.int64()), ("source_first", pa.int32())]))

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        removed, texts_kept, hashes, parsed, done = [], [], [], [], 0
        for piece in pieces(texts):
            w = Words(piece)
            step = np.zeros(len(w.start) + 1, np.int64)
            mine = spans.slice(done, len(piece))
            of = np.repeat(np.arange(len(piece)), mine.value_lengths().to_numpy(zero_copy_only=False))
            a, b, source, at = (x.fill_null(-1).to_numpy(zero_copy_only=False) for x in mine.flatten().flatten())
            window = source < 0
            np.add.at(step, w.first[of[window]] + a[window], 1)
            np.add.at(step, w.first[of[window]] + b[window], -1)
            found: list[list] = [[] for _ in range(len(piece))]
            for d, *m in zip(*(x[~window].tolist() for x in (of, a, b, source, at)), strict=True):
                found[d].append(m)
            for d, matches in enumerate(found):
                factors = parse(matches)
                for x, y, *_ in factors:
                    step[w.first[d] + x] += 1
                    step[w.first[d] + y] -= 1
                parsed.append([{"first": x, "n_words": y - x, "source": s, "source_first": z} for x, y, s, z in factors] if whole else [])
            done += len(piece)
            keep = np.cumsum(step[:-1]) == 0
            raw, off = _joined(w, keep)
            removed.append(np.bincount(w.doc[~keep], minlength=len(piece)))
            hashes += _hashes(raw, off)
            texts_kept += [raw[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)] if whole else [None] * len(piece)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(removed) if removed else [], pa.int64()), pa.array(hashes, pa.string()), pa.array(texts_kept, pa.string()), pa.array(parsed, arrow)], kind.names)

    return F.arrow_udf(run, kind)


def _text_key(text: Column) -> list[Column]:
    """128 bits of the text's md5, as two longs."""
    h = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return [F.conv(F.substring(h, a, 16), 16, -10).cast("long").alias(k) for k, a in (("k1", 1), ("k2", 17))]


KEY = ["k1", "k2"]


def repeated(docs: DataFrame, length: int = LENGTH, seed: int = SEED, key: str = "doc_id", whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The steps that all results share, as written tables.

    indexed: a row per document (key, k1, k2); texts: a row per different text (k1, k2, copies, n_words, plain, one:
    a document that has it); cut: a row (k1, k2, uid, n_removed, kept_sha256, kept, factors) per different text that has some repeated
    window and no copy. A factor's source is a uid of ``cut``, or of a text that nothing is cut from.
    """
    marked = docs.select(key, "text", *_text_key(F.col("text"))).withColumn("i", _indexed(length, seed)(F.col("text")))
    indexed = written(marked.select(key, *KEY, "i.n_words", "i.plain", "i.seeds"), "indexed")
    different = written(indexed.groupBy(*KEY).agg(F.count("*").alias("copies"), F.min(F.struct(key, "n_words", "plain", "seeds")).alias("one")).select(*KEY, "copies", "one.*"), "texts")
    total = max(1, different.count())
    seeds = different.select(*KEY, F.col(key).alias("_one"), F.explode("seeds").alias("x")).select(*KEY, "_one", "x.*").withColumn("o", F.xxhash64(*KEY, "p"))
    again = written(seeds.groupBy("s").agg(F.count("*").alias("n"), F.min("o").alias("block")).where("n >= 2"), "seeds")
    hot = hot_keys(again, ["s"], "n", total)
    found = salted_join(seeds, again.drop("n"), ["s"], hot, F.struct(*KEY, "p"))
    found = found.groupBy(*KEY, "_one").agg(F.collect_list(F.struct("p", "s", (F.col("o") == F.col("block")).alias("block"))).alias("seeds"))
    one = docs.select(F.col(key).alias("_one"), "text", *_text_key(F.col("text")))
    same = [one.k1 == found.k1, one.k2 == found.k2, one["_one"].eqNullSafe(found["_one"])]
    texts = one_each(one.join(found, same).select(found.k1, found.k2, "text", "seeds"), KEY, "repeating").withColumn("uid", F.xxhash64(*KEY))

    def around(block: bool) -> DataFrame:
        mine = texts.withColumn("seeds", F.filter("seeds", lambda x: x["block"] == block)).where(F.size("seeds") > 0)
        return mine.select("uid", F.explode(_blocks(length, seed)(F.col("text"), F.transform("seeds", lambda x: x["p"]))).alias("x")).select("uid", "x.*")

    blocks = written(around(True).select("s", F.col("uid").alias("source"), F.col("p").alias("source_p"), F.col("words").alias("block")), "blocks")
    both = salted_join(around(False), blocks, ["s"], hot, F.struct("uid", "p")).withColumn("m", _matched(length, seed)(F.col("words"), F.col("block"), F.col("a"), F.col("b")))
    matches = written(both.select("uid", "p", "source", "source_p", "m.*"), "matches")
    long = matches.where(F.col("l") + F.col("r") >= length)
    here = long.select("uid", (F.col("p") - F.col("l")).alias("a"), (F.col("p") + F.col("r")).alias("b"), "source", (F.col("source_p") - F.col("l")).alias("at"))
    there = long.groupBy(F.col("source").alias("uid"), (F.col("source_p") - F.col("l")).alias("a"), (F.col("source_p") + F.col("r")).alias("b")).agg(F.min(F.struct(F.col("uid").alias("source"), (F.col("p") - F.col("l")).alias("at"))).alias("m"))
    windows = written(matches.select("uid", "p", F.explode("beyond").alias("w")).select("uid", (F.col("p") + F.col("w.d")).alias("a"), "w.f1", "w.f2"), "windows")
    twice = written(windows.groupBy("f1", "f2").count().where("count >= 2"), "repeated")
    hits = salted_join(windows, twice.drop("count"), ["f1", "f2"], hot_keys(twice, ["f1", "f2"], "count", total), F.struct("uid", "a"))
    hits = hits.select("uid", "a", (F.col("a") + length).alias("b"), F.lit(None).cast("long").alias("source"), F.lit(None).cast("int").alias("at"))
    spans = here.union(there.select("uid", "a", "b", "m.*")).union(hits).groupBy("uid").agg(F.collect_list(F.struct("a", "b", "source", "at")).alias("spans"))
    cut = texts.select("uid", *KEY, "text").join(spans, "uid").withColumn("c", _cut_out(length, whole)(F.col("text"), F.col("spans"))).select("uid", *KEY, "c.*")
    return indexed.select(key, *KEY), different.select(*KEY, "copies", "n_words", "plain", F.col(key).alias("one")), cut


def digest(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``length`` words over it also starts anywhere else, in its own document too.
    Texts with copies go whole when they have that many words, as every window is in the copy; shorter
    texts, null and empty ones lose nothing. Copies are handled as one text from the start, so thousands
    of them cost one; rows that repeat count as copies. Very long texts are read whole, one at a time. An empty table gives an empty
    one; other columns don't pass.
    """
    docs = docs.select("doc_id", "text")
    indexed, texts, cut = repeated(docs, length, seed)
    gone = (F.col("copies") > 1) & (F.col("n_words") >= length)
    result = texts.join(cut.select(*KEY, "n_removed", "kept_sha256"), KEY, "left").select(
        *KEY,
        "copies",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "plain")).alias("kept_sha256"),
    )
    result = written(result, "results")
    return salted_join(indexed, result.drop("copies"), KEY, hot_keys(result, KEY, "copies", indexed.count()), F.struct("doc_id")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same in DuckDB, for LENGTH words.
SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (select doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35)),
twice as (select h from windows group by h having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as p from windows where h in (select h from twice)),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
kept as (select doc_id, array_to_string(list(word order by p), ' ') as text from words anti join gone using (doc_id, p) group by doc_id),
n as (select doc_id, count(*) as n_removed from gone group by doc_id)
select w.doc_id, len(ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join n using (doc_id) left join kept using (doc_id)
"""
