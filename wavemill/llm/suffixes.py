"""Removal of byte strings that an earlier document has, by sorting suffixes with a difference cover.

All suffixes of all texts are many times the input, so what can't repeat goes first. Of the
GRAM-byte strings in a window of LENGTH bytes the one with the least hash is the window's seed: equal windows have equal
seeds at equal places. Seeds are counted over all documents, and a seed that stands once settles all its windows. The windows of one
occurrence of a repeated seed, at most LENGTH - GRAM + 1 that follow each other, are a context. Equal contexts are one: that
of the least document stays, and what the others have goes. The contexts that are left meet by seed in shards.

A shard's suffixes are sorted by the difference-cover method. Its characters are words of eight bytes, and the place i is sampled if
i div 8 mod 3 is 1 or 2. Triples of characters at sampled places are sorted and named by rank; triples of names are named in turn,
until names order LENGTH bytes. The remaining suffixes are sorted by their first character and the name behind it, and
merged with the sampled ones. In the merged order equal prefixes of LENGTH bytes are neighbours; the least document of such a run keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spread import written
from ._words import _BYTE, U, _powers, mix

LENGTH, GRAM = 50, 16
#: Bytes of text that are worked on together, bytes of contexts in a shard, occurrences from which a seed's windows are dealt one by one.
SLICE, SHARD, HOT = 1 << 18, 1 << 20, 1 << 16
#: Repeated seeds that are broadcast at once at most, nine bytes each, and how often texts are read for it; beyond, seeds are joined.
KNOWN, ROUNDS = 8_000_000, 4
#: Bytes of text to a bucket of seeds.
BUCKET = 8 << 20
_AGAIN = mix(_BYTE, 5)
#: Stands for a null doc_id, which comes after all others.
_NO_ID = (1 << 63) - 1


class Seeds:
    """Of some texts (bytes, off): each seed's place and hash, and the first and last window that has it; all places count in ``data``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int, gram: int):
        self.data, self.off, self.length = data, off, length
        n = len(data)
        up, down = _powers(n + 1)
        self.total = np.zeros(n + 1, U)
        np.cumsum(_BYTE[data] * up[:n], out=self.total[1:])
        self.down = down
        windows = n - length + 1
        if windows <= 0:
            self.place = self.first = self.last = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U)
            return
        h = self.strings(np.arange(n - gram + 1), gram)
        best, span, grams = np.arange(len(h)), 1, length - gram + 1

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where(h[b] < h[a], b, a)

        while span * 2 <= grams:
            best = least(best[:-span], best[span:])
            span *= 2
        if span < grams:
            best = least(best[: len(best) - (grams - span)], best[grams - span :])
        inside = np.ones(windows, bool)  # not over the end of a text
        for end in off[1:-1]:
            inside[max(0, end - length + 1) : end] = False
        at = np.flatnonzero(inside)
        place = best[at]
        lead = np.ones(len(at), bool)
        lead[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(lead)
        self.place, self.first, self.last = place[first], at[first], at[np.append(first[1:], len(at)) - 1] if len(at) else at
        self.hash = h[self.place]

    def strings(self, at: np.ndarray, size: np.ndarray | int, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of the bytes from each place."""
        return mix((self.total[at + size] - self.total[at]) * self.down[at] + np.asarray(size).astype(U), seed)

    def strings_again(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Another hash, of other values for bytes: with the first one 128 bits."""
        total = np.zeros(len(self.total), U)
        np.cumsum(_AGAIN[self.data] * _powers(len(total))[0][: len(self.data)], out=total[1:])
        return mix((total[at + size] - total[at]) * self.down[at] + np.asarray(size).astype(U), 1)


def _runs(key: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by key (the first counts most), and where runs of equal keys begin."""
    order = np.lexsort(key[::-1])
    lead = np.ones(len(order), bool)
    if len(order):
        lead[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
    return order, lead


def _ranks(key: list[np.ndarray]) -> np.ndarray:
    """Names from 1 in order of the keys; equal keys have equal names."""
    order, lead = _runs(key)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lead)
    return out


class DifferenceCover:
    """The order of places in many short strings by their next ``depth`` bytes or more.

    ``data`` holds the strings one after another; a place beyond its string's end (``end`` of each string) counts as zeros.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, depth: int):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self._words = np.ndarray(len(self.data) - 7, ">u8", self.data, 0, (1,))
        self.start, self.end, self.depth = start, end, depth
        size = end - start
        self.string = np.repeat(np.arange(len(start)), size)
        self.inside = np.arange(len(data)) - start[self.string]
        self.names = self._named()

    def word(self, at: np.ndarray, string: np.ndarray) -> np.ndarray:
        """The character at each place: its next eight bytes, zeros beyond the string."""
        left = np.clip(self.end[string] - at, 0, 8)
        keep = np.where(left > 0, ~U(0) << ((U(8) - left.astype(U)) * U(8) & U(63)), U(0))
        return self._words[np.minimum(at, len(self.data) - 8)].astype(U) & keep

    def _named(self) -> np.ndarray:
        """Names of sampled places by rank of their triples, and of triples of names, until they order ``depth`` bytes; 0 elsewhere and beyond the end."""
        sampled = np.flatnonzero((self.inside >> 3) % 3 != 0)
        string, end = self.string[sampled], self.end[self.string[sampled]]
        names = np.zeros(len(self.data), np.int64)
        names[sampled] = _ranks([self.word(sampled + k, string) for k in (0, 8, 16)])
        covered = 24
        while covered < self.depth:
            following = [np.where(sampled + k < end, names[np.minimum(sampled + k, len(names) - 1)], 0) for k in (0, covered, 2 * covered)]
            if names.max() < 1 << 21:
                following = [following[0] << 42 | following[1] << 21 | following[2]]
            again = np.zeros(len(names), np.int64)
            again[sampled] = _ranks(following)
            names, covered = again, covered * 3
        return names

    def _name(self, at: np.ndarray, string: np.ndarray) -> np.ndarray:
        return np.where(at < self.end[string], self.names[np.minimum(at, len(self.names) - 1)], 0)

    def order(self, places: np.ndarray) -> np.ndarray:
        """``places`` in order of their suffixes: the sampled ones by name, the remaining ones merged with them."""
        string = self.string[places]
        kind = (self.inside[places] >> 3) % 3
        rest, one, two = (np.flatnonzero(kind == k) for k in range(3))
        sampled = np.concatenate([one, two])
        sampled = sampled[np.argsort(self.names[places[sampled]], kind="stable")]
        first, second = self.word(places, string), self.word(places + 8, string)
        behind, behind_two = self._name(places + 8, string), self._name(places + 16, string)
        rest = rest[np.lexsort((behind_two[rest], behind[rest], first[rest]))]
        before = np.zeros(len(places), np.int64)  # of each remaining suffix: sampled ones before it

        def merge(others: np.ndarray, key: list[np.ndarray]) -> None:
            both = np.concatenate([others, rest])
            order = np.lexsort([k[both] for k in key[::-1]])
            is_rest = order >= len(others)
            before[rest[order[is_rest] - len(others)]] += np.cumsum(~is_rest)[is_rest]

        merge(one, [first, behind])
        merge(two, [first, second, behind_two])
        at = before[rest] + np.arange(len(rest))
        out = np.empty(len(places), np.int64)
        taken = np.zeros(len(places), bool)
        taken[at] = True
        out[at], out[~taken] = rest, sampled
        return out

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the next ``depth`` bytes agree."""
        out = np.ones(len(a), bool)
        for k in [*range(0, self.depth - 8, 8), self.depth - 8]:
            live = np.flatnonzero(out)
            out[live] = self._words[a[live] + k] == self._words[b[live] + k]
        return out


def repeats(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next ``length`` bytes also stand in a string of a smaller ``doc``, and the string of each.

    Places in question are those with ``length`` bytes left in their string.
    """
    cover = DifferenceCover(data, start, end, length)
    places = np.flatnonzero(cover.inside + length <= (end - start)[cover.string])
    if not len(places):
        return places, places
    order = places[cover.order(places)]
    lead = np.ones(len(order), bool)
    lead[1:] = ~cover.same(order[1:], order[:-1])
    first = np.flatnonzero(lead)
    mine = doc[cover.string[order]]
    least = np.repeat(np.minimum.reduceat(mine, first), np.diff(np.append(first, len(order))))
    gone = np.sort(order[mine > least])
    return gone, cover.string[gone]


def _slices(batch: pa.RecordBatch, most: int, overlap: int | None = None) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Rows from and to, place in the text, bytes and offsets of their texts: about ``most`` bytes, one text at least.

    With ``overlap``, a longer text comes in parts that share so many bytes, each with its place.
    """
    texts = batch.column("text").cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        lo, hi = int(off[at]), int(off[to])
        if overlap is not None and hi - lo > most + overlap:
            for k in range(lo, hi - overlap, most):
                part = data[k : min(hi, k + most + overlap)]
                yield at, to, k - lo, part, np.array([0, len(part)])
        else:
            yield at, to, 0, data[lo:hi], off[at : to + 1] - lo
        at = to


def _lists(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """Bytes from each place as binaries."""
    off = np.concatenate([[0], np.cumsum(size)])
    raw = data[np.repeat(at - off[:-1], size) + np.arange(off[-1])]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def _counted(bits: int, length: int, gram: int):
    """Of a part of the documents the seeds, by bucket: those that stand once, those that stand more often and how often. A seed is its 40 + bits first bits, of which the bucket's are left out."""
    schema = pa.schema([("bucket", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])

    def five(x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5])

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = (key >> U(40)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        out = []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(key)], strict=True):
            k, c = key[a:b], n[a:b]
            out.append((int(bucket[a]), five(k[c == 1]).tobytes(), five(k[c > 1]).tobytes(), np.minimum(c[c > 1], (1 << 32) - 1).astype(np.uint32).tobytes()))
        return pa.record_batch([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, _, _, data, off in _slices(batch, SLICE, length - 1):
                h = Seeds(data, off, length, gram).hash >> U(24 - bits)
                if len(h):
                    held.append(h)
                    size += len(h)
                if size > 1 << 19:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _repeated(bucket: tuple, rows: pa.Table) -> pa.Table:
    """Seeds of one bucket that stand twice or more, and how often."""

    def keys(column: str) -> np.ndarray:
        raw = np.frombuffer(b"".join(rows[column].to_pylist()), np.uint8).reshape(-1, 5)
        out = np.zeros((len(raw), 8), np.uint8)
        out[:, :5] = raw
        return out.view(U)[:, 0]

    once, more = keys("once"), keys("more")
    n = np.concatenate([np.ones(len(once), np.int64), np.frombuffer(b"".join(rows["counts"].to_pylist()), np.uint32).astype(np.int64)])
    key, place = np.unique(np.concatenate([once, more]), return_inverse=True)
    total = np.bincount(place, n, len(key)).astype(np.int64)
    twice = total > 1
    full = key[twice] | U(bucket[0].as_py()) << U(40)
    return pa.table({"seed": full.view(np.int64), "n": total[twice]})


#: Contexts: seed, text (doc, h), place and bytes. Spans that go: any seed, text, place and size in one number, no bytes.
_FOUND = pa.schema([("seed", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])
_KIND = "seed long, doc long, h long, at long, bytes binary"


def _spans(doc: np.ndarray, h: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Rows of spans that go; those of one text that touch are one."""
    order = np.lexsort((at, h, doc))
    doc, h, at, end = doc[order], h[order], at[order], (at + size)[order]
    same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
    # spans of equal texts can stand twice; a running maximum joins all that touch, texts apart
    text = np.concatenate([[0], np.cumsum(~same)]) if len(doc) else np.zeros(0, np.int64)
    reach = np.maximum.accumulate(end + text * (1 << 40)) - text * (1 << 40) if len(doc) else end
    lead = np.ones(len(doc), bool)
    lead[1:] = ~same | (at[1:] > reach[:-1])
    first = np.flatnonzero(lead)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    columns = [doc[first], doc[first], h[first], at[first] << 32 | reach[last] - at[first]]
    return pa.record_batch([*map(pa.array, columns), pa.nulls(len(first), pa.binary())], schema=_FOUND)


def _classes(key: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each context the number of its class of equal ones, in order of the key, and the least doc of the class."""
    order, lead = _runs(key)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(lead) - 1
    least = np.minimum.reduceat(doc[order], np.flatnonzero(lead)) if len(order) else doc
    return number, least[number]


def _equal_contexts(seed: np.ndarray, raw: np.ndarray, off: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of contexts that have the seed and all bytes in common, told apart by 128 bits."""
    up, down = _powers(len(raw) + 1)
    key = [seed]
    for k, table in enumerate((_BYTE, _AGAIN)):
        total = np.zeros(len(raw) + 1, U)
        np.cumsum(table[raw] * up[: len(raw)], out=total[1:])
        key.append(mix((total[off[1:]] - total[off[:-1]]) * down[off[:-1]] + np.diff(off).astype(U), k))
    return _classes(key, doc)


def _contexts(known, bits: int, length: int, gram: int):
    """Contexts of repeated seeds, and spans that go as an equal context of a smaller doc stands in the same part of the documents.

    ``known`` has the seeds and whether each is hot; without it they come with the rows. Windows of hot seeds
    are contexts of their own, dealt by their own hash: so the many contexts of such a seed meet in no one task.
    """

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        seed, one, two, doc, h, at, size = (np.concatenate([x[k] for x in held]) for k in range(7))
        raw = np.concatenate([x[7] for x in held])
        off = np.concatenate([[0], np.cumsum(size)])
        _, least = _classes([seed, one, two], doc)
        gone = doc > least
        if gone.any():
            yield _spans(doc[gone], h[gone], at[gone], size[gone])
        keep = np.flatnonzero(~gone)
        for k in range(0, len(keep), 1 << 15):
            some = keep[k : k + (1 << 15)]
            yield pa.record_batch([*(pa.array(x[some]) for x in (seed.view(np.int64), doc, h, at)), _lists(raw, off[some], size[some])], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0
        for batch in batches:
            docs, hashes = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("h").to_numpy(zero_copy_only=False)
            for a, b, shift, data, off in _slices(batch, SLICE, length - 1):
                if known is None:
                    wanted = batch.column("wanted").slice(a, b - a).flatten()
                    keys, where = np.unique(wanted.field(0).to_numpy(zero_copy_only=False).view(U), return_index=True)
                    often = wanted.field(1).to_numpy(zero_copy_only=False)[where]
                else:
                    keys, often = known.value
                x = Seeds(data, off, length, gram)
                if not len(keys) or not len(x.hash):
                    continue
                key = x.hash >> U(24 - bits)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == key)
                many = often[at[hit]]
                few, lots = hit[~many], hit[many]
                n = (x.last - x.first + 1)[lots]
                one = np.repeat(x.first[lots] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                first = np.concatenate([x.first[few], one])
                size = np.concatenate([(x.last - x.first)[few] + length, np.full(len(one), length, np.int64)])
                seed = np.concatenate([key[few], x.strings(one, length, 77) >> U(24 - bits)])
                text = np.searchsorted(off, first, "right") - 1
                ends = np.concatenate([[0], np.cumsum(size)])
                raw = data[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
                held.append((seed, x.strings(first, size, 1), x.strings_again(first, size), docs[a + text], hashes[a + text], first - off[text] + shift, size, raw))
                total += len(raw)
                if total > 128 * SLICE:
                    yield from flush(held)
                    held, total = [], 0
        if held:
            yield from flush(held)

    return run


def _shards(length: int, most: int):
    """Of contexts in order of seed the spans that go; spans pass. Contexts of one seed are in one shard."""

    def shard(t: pa.Table) -> pa.RecordBatch:
        seed, doc, h, at = (t[c].to_numpy() for c in ("seed", "doc", "h", "at"))
        flat = t["bytes"].combine_chunks()
        flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
        off = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
        raw = np.frombuffer(flat.buffers()[2], np.uint8)[off[0] : off[-1]]
        off -= off[0]
        size = np.diff(off)
        number, least = _equal_contexts(seed, raw, off, doc)
        gone = doc > least
        out = [(doc[gone], h[gone], at[gone], size[gone])]
        # a class's first row speaks for it; a seed with one class is settled
        _, row = np.unique(number, return_index=True)
        several = np.zeros(len(row), bool)
        same = seed[row][1:] == seed[row][:-1]
        several[1:] |= same
        several[:-1] |= same
        row = row[several]
        if len(row):
            raw2 = raw[np.repeat(off[row] - (np.cumsum(size[row]) - size[row]), size[row]) + np.arange(size[row].sum())]
            ends = np.cumsum(size[row])
            place, string = repeats(raw2, ends - size[row], ends, least[row], length)
            inside = place - (ends - size[row])[string]
            lead = np.ones(len(place), bool)
            lead[1:] = (string[1:] != string[:-1]) | (inside[1:] != inside[:-1] + 1)
            first = np.flatnonzero(lead)
            last = np.append(first[1:], len(place)) - 1 if len(first) else first
            # every occurrence in the least document of the class
            of = number[row][string[first]]
            mine = np.flatnonzero(~gone)
            mine = mine[np.argsort(number[mine], kind="stable")]
            lo, hi = np.searchsorted(number[mine], of), np.searchsorted(number[mine], of, "right")
            which = mine[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())]
            run = np.repeat(np.arange(len(first)), hi - lo)
            out.append((doc[which], h[which], at[which] + inside[first][run], (inside[last] - inside[first])[run] + length))
        return _spans(*(np.concatenate([x[k] for x in out]) for k in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            none = batch.column("bytes").is_null()
            if none.true_count:
                yield batch.filter(none)
                batch = batch.filter(pa.compute.invert(none))
            if not len(batch):
                continue
            held.append(batch)
            size += batch.column("bytes").nbytes
            if size < most:
                continue
            t = pa.Table.from_batches(held)
            seed = t["seed"].to_numpy()
            to = int(np.searchsorted(seed, seed[-1]))
            if to:
                yield shard(t.slice(0, to))
                held = t.slice(to).combine_chunks().to_batches()
                size = sum(x.column("bytes").nbytes for x in held) if to < len(t) else 0
        if held:
            yield shard(pa.Table.from_batches(held))

    return run


_SPAN = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType())])
_CUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("kept", T.BinaryType()), T.StructField("sha", T.StringType())])


def _cut(whole: bool):
    """struct of a text and its spans: bytes, maximal spans that go, what is left (with ``whole``) and its hash."""

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        batch = pa.record_batch([texts], ["text"])
        for a, b, _, data, off in _slices(batch, SLICE):
            mine = spans.slice(a, b - a)
            n = mine.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, size = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in mine.flatten().flatten())
            base = np.repeat(off[:-1], n)
            step = np.zeros(len(data) + 1, np.int64)
            np.add.at(step, base + at, 1)
            np.add.at(step, base + at + size, -1)
            gone = np.cumsum(step[:-1]) > 0
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            edge[off[:-1][off[:-1] < len(data)]] |= gone[off[:-1][off[:-1] < len(data)]]
            first = np.flatnonzero(edge)
            stop = gone.copy()
            stop[:-1] &= ~gone[1:]
            tails = off[1:][off[1:] > 0] - 1
            stop[tails] |= gone[tails]
            last = np.flatnonzero(stop) + 1
            of = np.searchsorted(off, first, "right") - 1
            left = data[~gone].tobytes()
            upto = np.concatenate([[0], np.cumsum(~gone)])[off]
            cuts = np.searchsorted(of, np.arange(b - a + 1))
            for i in range(b - a):
                kept = left[upto[i] : upto[i + 1]]
                found = [{"at": int(x - off[i]), "size": int(y - x)} for x, y in zip(first[cuts[i] : cuts[i + 1]], last[cuts[i] : cuts[i + 1]], strict=True)]
                rows.append({"n_bytes": int(off[i + 1] - off[i]), "spans": found, "kept": kept if whole else None, "sha": hashlib.sha256(kept).hexdigest()})
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32())]))), ("kept", pa.binary()), ("sha", pa.string())]))

    return F.arrow_udf(run, _CUT)


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, whole: bool = True, hot: int = HOT, known: int = KNOWN, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, spans (at, size: maximal runs of bytes that go), kept (binary, null unless ``whole``) and sha, its SHA-256.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller doc_id. Documents that share a doc_id take nothing
    from each other; a null doc_id comes after all others. Null texts are empty; texts under ``length`` bytes lose nothing. Copies, however many, are equal contexts: one row each and part of the
    documents. Very long texts are read whole, one at a time. An empty table gives an empty one; other columns don't pass.
    Seeds are told apart by 40 bits and more, which only lets more be looked at; equal contexts by 128 bits.
    """
    alone = docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    h = F.lit(0).cast("long") if alone else F.xxhash64("text")  # tells apart texts that share a doc_id
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), h.alias("h"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("size")).first().size or 0
    bits = min(23, max(4, (max(1, size) // BUCKET).bit_length()))
    found = rows.select("text").mapInArrow(_counted(bits, length, gram), "bucket int, once binary, more binary, counts binary")
    seeds = written(found.groupBy("bucket").applyInArrow(_repeated, "seed long, n long"), "seeds")
    rounds = -(-seeds.count() // known) if known else ROUNDS + 1
    if rounds <= ROUNDS:
        around = None
        for k in range(max(1, rounds)):
            t = seeds.where(F.pmod("seed", F.lit(max(1, rounds))) == k).select("seed", (F.col("n") > hot).alias("hot")).toArrow()
            keys, often = t["seed"].to_numpy().view(U), t["hot"].to_numpy()
            order = np.argsort(keys)
            value = docs.sparkSession.sparkContext.broadcast((keys[order], often[order]))
            more = rows.select("doc", "h", "text").mapInArrow(_contexts(value, bits, length, gram), _KIND)
            around = more if around is None else around.union(more)
    else:
        every = rows.select("doc", "h", F.explode(_keys(bits, length, gram)(F.col("text"))).alias("seed"))
        asked = every.join(seeds, "seed").groupBy("doc", "h").agg(F.collect_list(F.struct("seed", (F.col("n") > hot).alias("hot"))).alias("wanted"))
        around = rows.join(asked, ["doc", "h"]).select("doc", "h", "text", "wanted").mapInArrow(_contexts(None, bits, length, gram), _KIND)
    # spans travel with the contexts, so that texts are read once and nothing is written between
    dealt = around.repartition("seed").sortWithinPartitions("seed").mapInArrow(_shards(length, shard), _KIND)
    span = F.struct(F.shiftright("at", 32).cast("int").alias("at"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("size"))
    spans = dealt.select("doc", "h", span.alias("x")).groupBy("doc", "h").agg(F.collect_list("x").alias("spans"))
    cut = rows.join(spans, ["doc", "h"], "left").withColumn("c", _cut(whole)(F.col("text"), F.coalesce("spans", F.array().cast(T.ArrayType(_SPAN)))))
    return cut.select("doc_id", "c.*")


def _keys(bits: int, length: int, gram: int):
    """Different seeds of a text."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for a, b, _, data, off in _slices(pa.record_batch([texts], ["text"]), SLICE):
            x = Seeds(data, off, length, gram)
            key = (x.hash >> U(24 - bits)).view(np.int64)
            cuts = np.searchsorted(np.searchsorted(off, x.place, "right") - 1, np.arange(b - a + 1))
            out += [np.unique(key[cuts[i] : cuts[i + 1]]) for i in range(b - a)]
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(run, T.ArrayType(T.LongType()))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; see deduplicate."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    return deduplicate(docs, whole=False).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))


#: The same in DuckDB.
SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
b as (select doc_id, k, substr(x, 200 * k + 1, 298) as y from (select doc_id, x, unnest(range(0, (len(x) // 2 + 99) // 100)) as k from d)),
w as (select doc_id, 100 * k + i as i, md5(substr(y, 2 * i + 1, 100)) as h from (select doc_id, k, y, unnest(range(0, least(100, len(y) // 2 - 49))) as i from b)),
least_ as (select h, min(doc_id) as least_id from w group by h having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from (select distinct doc_id, i from w join least_ using (h) where doc_id > least_id)),
runs as (select doc_id, min(p) as a, max(p) + 1 as b from (select doc_id, p, p - row_number() over (partition by doc_id order by p) as g from gone) group by doc_id, g),
pieces as (select doc_id, b - a as n, coalesce(lag(b) over (partition by doc_id order by a), 0) as c, a, b from runs),
kept as (select doc_id, sum(n) as n_removed, count(*) as n_spans, max(b) as b, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' order by a) as k from pieces join d using (doc_id) group by doc_id)
select doc_id, cast(len(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when k is null then x else k || substr(x, 2 * b + 1) end)) as kept_sha256
from d left join kept using (doc_id)
"""
