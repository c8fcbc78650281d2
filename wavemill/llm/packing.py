"""Best-fit packing of documents into token sequences, planned over the histogram of lengths."""

from __future__ import annotations

import os
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spread import numbered, written
from ._words import Words, pieces

SEQUENCE = 4096
END_ID = 1
_MARK = "\x02"  # put between words that are encoded together; words that hold it are encoded alone
_MOST_WORDS = 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: ASCII letters 1, marks but the apostrophe 2: the tokenizer's splitter always parts these two.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 2
_COLUMNS = "length long, rank_from long, n long, first_sequence long, per_sequence long, first_offset long"


class _Encoder:
    """Ids of white-space separated words, kept by 64-bit hash in sorted arrays (26 bytes a word or so).

    The tokenizer's normaliser and splitter never join what white space parts, nor a letter and a mark, and it
    lower-cases, so a text's ids are those of its lower-cased words and marks in turn. Texts with
    a special token's own characters are left whole between white space. At _MOST_WORDS the store starts anew, which
    bounds memory.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        mark = self._alone(_MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _alone(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        out: list = []
        for i in range(0, len(words), 256):
            group = words[i : i + 256]
            if self.mark is not None and not any(_MARK in w for w in group):
                ids = np.array(self._alone(f" {_MARK} ".join(group)), np.uint32)
                cuts = np.flatnonzero(ids == self.mark)
                if len(cuts) == len(group) - 1:
                    out += [x[j > 0 :] for j, x in enumerate(np.split(ids, cuts))]
                    continue
            out += [np.array(self._alone(w), np.uint32) for w in group]
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts, END_ID after each, and how many each has."""
        w = Words(texts, _KIND)
        if any(x in w.data.tobytes() for x in self.special):
            w = Words(texts)
        seen, one, inverse = np.unique(w.hashes(None if w.kind is None else _LOWER), return_index=True, return_inverse=True)
        if len(self.keys) + len(seen) > _MOST_WORDS:
            self._clear()
        at = np.searchsorted(self.keys, seen)
        new = np.flatnonzero(seen != self.keys[np.minimum(at, len(self.keys) - 1)]) if len(self.keys) else np.arange(len(seen))
        if len(new):
            raw, start, end = w.data.tobytes(), w.start[one[new]].tolist(), w.end[one[new]].tolist()
            ids = self._encode([raw[a:b].decode() for a, b in zip(start, end, strict=True)])
            n = np.array([len(x) for x in ids], np.int64)
            first = len(self.flat) + np.concatenate([[0], np.cumsum(n)[:-1]])
            self.flat = np.concatenate([self.flat, *ids])
            self.at, self.n = np.insert(self.at, at[new], first), np.insert(self.n, at[new], n)
            self.keys = np.insert(self.keys, at[new], seen[new])
            at = np.searchsorted(self.keys, seen)
        docs = len(texts)
        ends = w.first[1:] + np.arange(docs)  # where, among words and end marks, the marks stand
        is_end = np.zeros(len(inverse) + docs, bool)
        is_end[ends] = True
        n, source = np.ones(len(is_end), np.int64), np.zeros(len(is_end), np.int64)
        n[~is_end], source[~is_end] = self.n[at][inverse], self.at[at][inverse]
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        take = np.repeat(source - (upto - n), n) + np.arange(total)
        out = self.flat[take] if len(self.flat) else np.zeros(total, np.uint32)
        out[upto[ends] - 1] = END_ID
        return out, np.diff(np.concatenate([[0], upto[ends]]))


_ENCODERS: dict[str, _Encoder] = {}


def tokenise(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with each text's ids and END_ID as little-endian unsigned 32-bit bytes in ``out``.

    ``path`` is a tokenizers file, read by each worker once. Null and empty texts have END_ID alone.
    Other columns pass unchanged; ``out`` replaces a column of that name.
    """

    def encode(texts: pa.Array) -> pa.Array:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, _Encoder(path))
        parts, counts = [], []
        for piece in pieces(texts):
            ids, n = encoder(piece)
            parts.append(ids.astype("<u4").tobytes())
            counts.append(n)
        off = np.concatenate([[0], np.cumsum(np.concatenate(counts) * 4)]) if counts else np.zeros(1)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(b"".join(parts))])

    return df.withColumn(out, F.arrow_udf(encode, T.BinaryType())(F.col(text)))


def cut(df: DataFrame, size: int = SEQUENCE, ids: str = "ids") -> DataFrame:
    """A row per piece of at most ``size`` ids: piece, start, length, and ``ids`` of the piece alone."""
    n = (F.length(ids) / 4).cast("long")
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0))))
    part = F.substring(F.col(ids), F.col("piece") * (4 * size) + 1, F.lit(4 * size))
    return df.withColumn("piece", piece).withColumn(ids, part).withColumns({"start": (F.col("piece") * size).cast("long"), "length": (F.length(ids) / 4).cast("long")})


def plan(histogram: list[tuple[int, int]], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over (length, count) pairs: rows of _COLUMNS.

    Sequences with one history are kept as a run (first, how many) under what they have left. A
    length goes to the tightest run that has room; a sequence takes as many of the length as fit,
    since it only becomes tighter. What a run has left then falls under the length, so below
    half: a run is used at most log2(size) times, and a length makes at most three runs. So the
    plan has at most 3 * size * log2(size) rows (some 147,000 for 4096), whatever the documents.
    """
    left: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    rows, sequences = [], 0

    def keep(first: int, n: int, rest: int) -> None:
        if n and rest:
            if rest not in runs:
                insort(left, rest)
            runs.setdefault(rest, []).append((first, n))

    def fill(first: int, n: int, rest: int, length: int, rank: int, count: int) -> int:
        """Puts what it can of ``count`` more of ``length`` into the run; the next rank."""
        each = rest // length
        full, odd = min(n, count // each), 0
        if full < n:
            odd = count - full * each
        if taken := full * each + odd:
            rows.append((length, rank, taken, first, each, size - rest))
        keep(first, full, rest - each * length)
        if odd:
            keep(first + full, 1, rest - odd * length)
        keep(first + full + (odd > 0), n - full - (odd > 0), rest)
        return rank + taken

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count and (i := bisect_left(left, length)) < len(left):
            rest = left[i]
            first, n = runs[rest].pop()
            if not runs[rest]:
                del runs[rest], left[i]
            rank = fill(first, n, rest, length, rank, count - rank)
        if rank < count:
            n = -(-(count - rank) // (size // length))
            fill(sequences, n, size, length, rank, count - rank)
            sequences += n
    return rows


def pack(items: DataFrame, key: list[str], size: int = SEQUENCE, length: str = "length") -> DataFrame:
    """``items`` with sequence_id and offset: no sequence is over ``size``, offsets are gapless from 0.

    ``items`` should be a written table, as it is read three times. The histogram has at most
    ``size`` rows and the plan is bounded (see plan), so both may pass the driver; items take the
    plan's slots by their rank within their length. Lengths must be from 1 to ``size``: an item
    with another one, or null, is an error of the caller and gets no row. Rows that repeat a key
    each take a slot. An empty table gives an empty one.
    """
    spark = items.sparkSession
    histogram = [tuple(r) for r in items.groupBy(length).count().where(F.col(length).between(1, size)).collect()]
    slots = spark.createDataFrame(plan(histogram, size), _COLUMNS).withColumnRenamed("length", length)
    ranked = numbered(items.where(F.col(length).between(1, size)), [length], key, "_at", sum(n for _, n in histogram))
    inside = (F.col("_at") >= F.col("rank_from")) & (F.col("_at") < F.col("rank_from") + F.col("n"))
    placed = ranked.join(F.broadcast(slots.withColumnRenamed(length, "_length")), (F.col(length) == F.col("_length")) & inside)
    j, each = F.col("_at") - F.col("rank_from"), F.col("per_sequence")
    placed = placed.withColumns({"sequence_id": F.col("first_sequence") + F.floor(j / each), "offset": F.col("first_offset") + j % each * F.col(length)})
    return placed.select(*items.columns, "sequence_id", "offset")


def assemble(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """sequence_id and the ids of each sequence, from pieces that still carry theirs; a group has at most a sequence's ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", ids)))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p[ids])), "")).alias(ids))


def pack_documents(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the pieces of all documents and their places.

    A document is its ids and an end mark; only longer ones than ``size`` are cut. Null and empty texts are the end mark alone; very long
    texts are tokenised whole and cut into pieces; rows that repeat each take a place; equal lengths take the
    planned slots of their length by rank. An empty table gives an empty one; other columns don't pass.
    """
    cuts = cut(tokenise(docs.select("doc_id", "text"), path), size)
    table = written(cuts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(table, ["doc_id", "piece"], size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
