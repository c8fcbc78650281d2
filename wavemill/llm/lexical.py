"""Ranked lexical search: exact inner products by sparse ball trees.

A document is a sparse vector over the terms that items ask for: of each, its weight times its saturated
frequency, all integers. An item is the vector of its terms' repeats, so a score is an inner
product. Each task builds ball trees over its documents: nodes split by the farther of two distant
members, each with its centroid, its radius and its radius along each coordinate. No member of a node can score more for an item than
the centroid does plus the item's norm times the radius, nor more than the centroid does plus the radii along the item's own
coordinates, its terms: the lesser counts. The floats of these bounds are rounded up by more than they can err.
Subtrees are taken best bound first and dropped as soon as a bound is below the item's k-th score so far; leaves are scored in integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ._spread import written
from ._words import Words, pieces
from .divergence import LOWER, Pointers

TOP = 20
#: Pairs of item and term that are searched for, and broadcast, at once; more items go in further rounds.
PAIRS = 50_000
#: Documents and entries of one tree at most, documents of a leaf.
CHUNK, ENTRIES, LEAF = 16_384, 4_000_000, 8

#: Bytes between terms: all of ASCII but letters and digits.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_VECTOR = T.StructType([T.StructField("n", T.LongType()), T.StructField("t", T.ArrayType(T.IntegerType())), T.StructField("f", T.ArrayType(T.IntegerType()))])


def item_terms(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items as a written table (item, item_id), numbered, as rows may repeat an item_id, and their terms (item, term, k: repeats)."""
    rows = written(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), upper, lower), F.lit(_PATTERN), F.lit(0))
    return rows.select("item", "item_id"), written(rows.select("item", F.explode(found).alias("term")).groupBy("item", "term").agg(F.count("*").alias("k")), "item-terms")


class Vocabulary:
    """Terms by hash; a document's term is looked up by its hash and confirmed byte by byte."""

    def __init__(self, terms: list[str]):
        texts = pa.array(terms, pa.large_string())
        w = Words(texts, space=BETWEEN)
        h = w.hashes(LOWER)
        self.number = np.argsort(h, kind="stable")
        self.hashes = h[self.number]
        self.terms = Pointers(LOWER[w.data], w.start[self.number], w.end[self.number])

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The words that are in the vocabulary, and the number of each."""
        if not len(self.hashes) or not len(w.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = w.hashes(LOWER)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        at = at[hit]
        mine = Pointers(LOWER[w.data], w.start[hit], w.end[hit])
        good = mine.end - mine.start == self.terms.end[at] - self.terms.start[at]
        live, depth = np.flatnonzero(good), 0
        while len(live):
            same = mine.slices(live, depth) == self.terms.slices(at[live], depth)
            good[live[~same]] = False
            depth += 8
            live = live[same]
            live = live[mine.start[live] + depth < mine.end[live]]
        return hit[good], self.number[at[good]]


def _vectors(vocabulary, size: int):
    """struct of a text: n (terms with repeats), t and f (numbers of its wanted terms, and how often each occurs)."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for piece in pieces(texts):
            w = Words(piece, space=BETWEEN)
            hit, number = vocabulary.value.find(w)
            code, f = np.unique(w.doc[hit] * size + number, return_counts=True)
            ends = pa.array(np.searchsorted(code, np.arange(len(piece) + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (code % size, f)]
            out.append(pa.StructArray.from_arrays([pa.array(w.count.astype(np.int64)), *lists], _VECTOR.names))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("n", pa.int64()), ("t", pa.list_(pa.int32())), ("f", pa.list_(pa.int32()))]))

    return F.arrow_udf(run, _VECTOR)


def _holders(size: int):
    """Documents that hold each term, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        t = np.flatnonzero(total)
        yield pa.record_batch([pa.array(t.astype(np.int32)), pa.array(total[t])], ["t", "df"])

    return run


class Rows:
    """Sparse rows: those of ``ptr[i]`` to ``ptr[i + 1]`` of columns and values. No row is empty."""

    def __init__(self, ptr: np.ndarray, col: np.ndarray, val: np.ndarray):
        self.ptr, self.col, self.val = ptr, col, val

    def take(self, which: np.ndarray) -> Rows:
        size = np.diff(self.ptr)[which]
        ptr = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.ptr[which] - ptr[:-1], size) + np.arange(ptr[-1])
        return Rows(ptr, self.col[at], self.val[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.val * dense[self.col], self.ptr[:-1])

    def dense(self, i: int, size: int) -> np.ndarray:
        out = np.zeros(size, self.val.dtype)
        out[self.col[self.ptr[i] : self.ptr[i + 1]]] = self.val[self.ptr[i] : self.ptr[i + 1]]
        return out


class BallTree:
    """Nodes over rows of not negative integers: two children or the rows of a leaf, and what no member's inner product with a query exceeds.

    ``queries``: (ptr, col, k), sparse and none empty. Bounds are taken while the tree is built, so that no centroid is kept.
    """

    def __init__(self, rows: Rows, size: int, queries: tuple[np.ndarray, np.ndarray, np.ndarray], leaf: int = LEAF):
        self.size, self.queries = size, queries
        self.norm = np.sqrt(np.add.reduceat((queries[2] * queries[2]).astype(np.float64), queries[0][:-1]))
        self.below: list[tuple[int, int] | None] = []
        self.leaves: dict[int, tuple[np.ndarray, Rows]] = {}
        bounds: list[np.ndarray] = []
        n = len(rows.ptr) - 1
        todo = [(np.arange(n), rows, -1, 0)] if n else []
        while todo:
            members, mine, parent, side = todo.pop()
            node = len(bounds)
            if parent >= 0:
                pair = self.below[parent] or (-1, -1)
                self.below[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            self.below.append(None)
            far, bound = self._ball(mine)
            bounds.append(bound)
            if len(members) <= leaf:
                self.leaves[node] = (members, mine)
                continue
            left = self._split(mine, far)
            for s, part in enumerate((np.flatnonzero(left), np.flatnonzero(~left))):
                todo.append((members[part], mine.take(part), node, s))
        self.bounds = np.array(bounds) if bounds else np.zeros((0, len(self.norm)))

    def _ball(self, mine: Rows) -> tuple[int, np.ndarray]:
        """The member farthest from the centroid, and each query's bound. The radius is rounded up beyond what floats can err."""
        val = mine.val.astype(np.float64)
        c = np.bincount(mine.col, val, self.size) / (len(mine.ptr) - 1)
        norm = np.add.reduceat(val * val, mine.ptr[:-1])
        cc = float(c @ c)
        apart = norm - 2 * np.add.reduceat(val * c[mine.col], mine.ptr[:-1]) + cc + 1e-10 * (norm + cc)
        radius = math.sqrt(max(0.0, float(apart.max()))) * (1 + 1e-9)
        most = np.zeros(self.size)  # the centroid and the radius along each coordinate
        np.maximum.at(most, mine.col, val)
        ptr, col, k = self.queries
        ball = np.add.reduceat(k * c[col], ptr[:-1]) + self.norm * radius
        return int(apart.argmax()), np.minimum(ball, np.add.reduceat(k * most[col], ptr[:-1])) * (1 + 1e-9) + 1

    def _split(self, mine: Rows, far: int) -> np.ndarray:
        """Which members are nearer to ``far`` than to the one farthest from it; halves if one side would be small."""
        x = Rows(mine.ptr, mine.col, mine.val.astype(np.float64))
        norm = np.add.reduceat(x.val * x.val, x.ptr[:-1])
        to = x.dot(x.dense(far, self.size))
        other = int((norm - 2 * to).argmax())
        lean = (norm[far] - 2 * to) - (norm[other] - 2 * x.dot(x.dense(other, self.size)))
        left = lean < 0
        n = len(left)
        if min(left.sum(), n - left.sum()) * 10 < n:
            left = np.zeros(n, bool)
            left[np.argpartition(lean, n // 2)[: n // 2]] = True
        return left

    def search(self, bounds: np.ndarray, query: np.ndarray, best: list[tuple[int, int]], names: list[int], top: int) -> int:
        """Best-first; puts (score, -name) on the heap ``best`` of at most ``top``. Gives how many rows were scored."""
        todo = [(-bounds[0], 0)] if len(bounds) else []
        scored = 0
        while todo:
            bound, node = heapq.heappop(todo)
            if len(best) == top and -bound < best[0][0]:
                break
            if self.below[node]:
                for child in self.below[node]:
                    heapq.heappush(todo, (-bounds[child], child))
                continue
            members, rows = self.leaves[node]
            scores = rows.dot(query)
            scored += len(members)
            least = best[0][0] if len(best) == top else 1
            for i in np.flatnonzero(scores >= max(1, least)).tolist():
                found = (int(scores[i]), -names[members[i]])
                if len(best) < top:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return scored


#: Stands for a null doc_id, which comes after all others.
_NO_ID = (1 << 63) - 1


def _search(asked, weight: np.ndarray, top: int):
    """Rows (item, doc_id, score): of each task's documents those that may be among an item's ``top``."""
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, ptr, col, k = asked.value
        size = len(weight)
        best: list[list[tuple[int, int]]] = [[] for _ in item]
        query = np.zeros(size, np.int64)

        def chunk(held: list[tuple]) -> None:
            names = [x for h in held for x in h[0]]
            count, t, v = (np.concatenate([h[j] for h in held]) for j in (1, 2, 3))
            tree = BallTree(Rows(np.concatenate([[0], np.cumsum(count)]), t, v), size, (ptr, col, k))
            for q in range(len(item)):
                mine = slice(ptr[q], ptr[q + 1])
                query[col[mine]] = k[mine]
                tree.search(tree.bounds[:, q], query, best[q], names, top)
                query[col[mine]] = 0

        held: list[tuple] = []
        docs = entries = 0
        for batch in batches:
            for part in (batch.slice(a, 2048) for a in range(0, len(batch), 2048)):
                count = part.column("t").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                t, f = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "f"))
                m = np.repeat(part.column("m").to_numpy(zero_copy_only=False), count)
                value = weight[t] * (1_000_000_000 * f // (1000 * f + 12 * m))
                some = count > 0
                names = part.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)[some].tolist()
                held.append((names, count[some], t, value))
                docs, entries = docs + len(names), entries + len(t)
                if docs >= CHUNK or entries >= ENTRIES:
                    chunk(held)
                    held, docs, entries = [], 0, 0
        if docs:
            chunk(held)
        out = [(i, -d, s) for i, found in zip(item.tolist(), best, strict=True) for s, d in found]
        a = [pa.array([x[j] for x in out], pa.int64()) for j in range(3)]
        a[1] = pa.compute.if_else(pa.compute.equal(a[1], _NO_ID), pa.scalar(None, pa.int64()), a[1])
        yield pa.record_batch(a, schema=schema)

    return run


def _length(n: str, docs: int, total: int) -> Column:
    return F.expr(f"75 + cast((cast(25 * {n} as decimal(20, 0)) * {docs}) div {max(1, total)} as bigint)")


def _round(docs: DataFrame, asked: list, top: int) -> DataFrame:
    """(item, doc_id, score) of one round's items; ``asked``: rows (item, term, k)."""
    context = docs.sparkSession.sparkContext
    terms = sorted({r.term for r in asked})
    number = {t: i for i, t in enumerate(terms)}
    vocabulary = context.broadcast(Vocabulary(terms))
    vectors = written(docs.select("doc_id", _vectors(vocabulary, max(1, len(terms)))(F.col("text")).alias("x")).select("doc_id", "x.*").where("n > 0"), "vectors")
    all_ = vectors.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    df = np.zeros(len(terms), np.int64)
    for r in vectors.select("t").mapInArrow(_holders(len(terms)), "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        df[r.t] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * all_.docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    asked = sorted((r.item, number[r.term], r.k) for r in asked)
    item, first = np.unique([a[0] for a in asked], return_index=True)
    queries = context.broadcast((item, np.append(first, len(asked)), np.array([a[1] for a in asked]), np.array([a[2] for a in asked])))
    found = vectors.select("doc_id", _length("n", all_.docs, all_.total).alias("m"), "t", "f").mapInArrow(_search(queries, weight, top), "item long, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    out = written(found.withColumn("rank", rank).where(F.col("rank") <= top), "ranked")
    vocabulary.destroy()
    queries.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, top: int = TOP, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the ``top`` documents of highest score above 0.

    Every row of ``items`` is an item, also those that repeat an item_id. Rounds of about ``pairs`` item terms are broadcast, each searched in all
    documents; an item's terms stay together. Null and empty texts hold no term, so they are in no result and count in no
    total; rows that repeat count each, and very long texts are read whole. Equal scores go by doc_id, null last. An empty table of either kind
    gives an empty result. Other columns don't pass. What a task sends is at most ``top`` rows an item.
    """
    names, asked = item_terms(items)
    rounds = max(1, -(-asked.count() // pairs))
    docs = docs.select("doc_id", "text")
    found = None
    for k in range(rounds):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == k).collect()
        if mine:
            more = _round(docs, mine, top)
            found = more if found is None else found.union(more)
    if found is None:
        found = names.select("item", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).where("false")
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


#: The same in DuckDB.
SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
q as (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
a as (select count(*) as n_docs, sum(len(ts)) as total from d where len(ts) > 0),
m as (select doc_id, 75 + (25 * len(ts) * n_docs) // total as m from d, a where len(ts) > 0),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ts) as term from d) where term in (select term from q) group by all),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, a group by term, n_docs),
k as (select item_id, term, count(*) as k from q group by all),
s as (select item_id, doc_id, cast(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score from k join tf using (term) join w using (term) join m using (doc_id) group by all),
r as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 20
"""
