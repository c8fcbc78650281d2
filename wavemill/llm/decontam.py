"""Benchmark decontamination: latent semantic retrieval of passages, then common subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spread import numbered, written
from ._words import U, Words, pieces

#: Hash buckets of words (a number of two bytes); latent dimensions, those beyond them while they are sought, and power iterations.
BUCKETS, DIMENSIONS, MORE, POWERS = 1 << 16, 96, 8, 1
#: Different passages that a word must stand in to have a place in the latent space, unless the benchmark has it.
LEAST_PASSAGES = 3
#: Passages that a task multiplies, and least number of tasks: each sends a row for every word that it met.
PER_TASK, LEAST_TASKS = 1 << 20, 4
#: Items that are searched for at once at most, which bounds what is broadcast.
SLICE = 10_000
#: Words in half a passage: an item's passages have two halves and begin at every half; a text's windows are as long and begin at every STEP words.
HALF, STEP = 12, 6
#: Least cosine of a candidate; least share of an item's words in common order; the same with its answer, if that has so
#: many words, and with a shorter one; least words of one passage in common order that count as a quotation.
COSINE, COMMON, COMMON_ANSWER, ANSWER_WORDS, COMMON_SHORT, QUOTED = 0.18, 0.6, 0.4, 4, 0.5, 18
_BLOCK, _BITS = 1024, 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?\"'()[]*#$%&|<>")] = True


def _hashes(w: Words) -> np.ndarray:
    """Of each word, A-Z lower-cased, without marks at its ends (up to four on either side; a word of marks alone is one)."""
    start, end = w.start.copy(), w.end.copy()
    last, head = np.flatnonzero(_TRIM[w.data[end - 1]]), np.flatnonzero(_TRIM[w.data[start]])
    for _ in range(4):  # words without a mark are looked at once
        last = last[_TRIM[w.data[end[last] - 1]] & (end[last] - 1 > start[last])]
        end[last] -= 1
        head = head[_TRIM[w.data[start[head]]] & (end[head] - 1 > start[head])]
        start[head] += 1
    return w.spans(start, end, _LOWER)


def _lower(texts: pa.Array) -> pa.Array:
    """Texts in lower case. Arrow takes characters one at a time; texts in which İ becomes two, or a last Σ becomes ς, and bytes that are no UTF-8 are left to Python."""
    try:
        if not any(pc.any(pc.match_substring(texts, x)).as_py() for x in "İΣ"):
            return pc.utf8_lower(texts)
    except pa.ArrowInvalid:
        pass
    texts = pa.array([None if x is None else x.decode("utf-8", "replace").lower() for x in texts.cast(pa.large_binary()).to_pylist()], texts.type)
    return pc.utf8_lower(texts)  # letters that only Arrow knows


def _packed(w: Words, bucket: np.ndarray) -> pa.Array:
    """Each text's passages, of 2 * HALF words from its first one on (the last may be shorter): the words' buckets in order, two bytes each."""
    n = -(-w.count // (2 * HALF))
    passage = np.concatenate([[0], np.cumsum(n)])[w.doc] + (np.arange(len(bucket)) - w.first[w.doc]) // (2 * HALF)
    ends = np.searchsorted(passage, np.arange(n.sum() + 1))
    words = (np.sort(passage * BUCKETS + bucket) & (BUCKETS - 1)).astype("<u2")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(words)])


def _unpacked(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed passages: passage, bucket and number of each different word, in that order."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] // 2
    bucket, ends = np.frombuffer(words.buffers()[2], "<u2")[ends[0] : ends[-1]], ends - ends[0]
    new = np.append(True, bucket[1:] != bucket[:-1])
    new[ends[:-1][ends[:-1] < len(bucket)]] = True
    first = np.flatnonzero(new[: len(bucket)])
    return np.repeat(np.arange(len(words)), np.diff(ends))[first], bucket[first].astype(np.int64), np.diff(np.append(first, len(bucket)))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's texts: all passages, and in how many texts each bucket occurs (bucket -1 counts the texts)."""
    names = ["bucket", "n", "words"]
    counts, docs = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for piece in pieces(batch.column(0)):
            w = Words(_lower(piece))
            docs += len(piece)
            bucket = (_hashes(w) & U(BUCKETS - 1)).astype(np.int64)
            seen = np.sort(w.doc * BUCKETS + bucket)
            counts += np.bincount(seen[np.diff(seen, prepend=-1) > 0] & (BUCKETS - 1), minlength=BUCKETS)
            words = _packed(w, bucket)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.nulls(len(words), pa.int64()), words], names)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], docs)), pa.nulls(len(at) + 1, pa.binary())], names)


def survey(docs: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Inverse document frequency of each bucket over all documents (BUCKETS + 1 rows reach the driver), and all different passages, packed."""
    found = written(docs.select("text").mapInArrow(_survey, "bucket long, n long, words binary"), "survey")
    counts = found.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(BUCKETS + 1)
    n[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    n, total = n[:-1], n[-1]
    return np.log((total + 1) / (n + 1)) + 0.05, written(found.where("words is not null").select("words").distinct(), "different")


def _often(different: DataFrame) -> DataFrame:
    """Buckets that stand in LEAST_PASSAGES of the passages."""

    def count(batches):
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(_unpacked(batch.column(0))[1], minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["b", "n"])

    return different.mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PASSAGES).select("b")


def _steps(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's step of STEP words, each text's first step (and the end), each step's text."""
    n = -(-w.count // STEP)
    first = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(len(w.start)) - w.first[w.doc]
    return first[w.doc] + place // STEP, first, np.repeat(np.arange(len(n)), n)


def _passages(items: DataFrame, weight: np.ndarray) -> DataFrame:
    """row, first word, buckets, weights (unit length), length before that and packed words of each passage of each item, as a written table."""

    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for piece in pieces(texts):
            w = Words(piece)
            b = (_hashes(w) & U(BUCKETS - 1)).astype(np.int64)
            for d in range(len(piece)):
                words, rows = b[w.first[d] : w.first[d + 1]], []
                for a in range(0, max(1, len(words) - HALF), HALF):
                    at, n = np.unique(words[a : a + 2 * HALF], return_counts=True)
                    v = n * weight[at]
                    if len(at):
                        rows.append({"first": a, "bucket": at, "value": v / np.sqrt((v * v).sum()), "size": np.sqrt((v * v).sum()), "words": np.repeat(at, n).astype("<u2").tobytes()})
                out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("bucket", pa.list_(pa.int64())), ("value", pa.list_(pa.float64())), ("size", pa.float64()), ("words", pa.binary())])))

    kind = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("bucket", T.ArrayType(T.LongType())), T.StructField("value", T.ArrayType(T.DoubleType())), T.StructField("size", T.DoubleType()), T.StructField("words", T.BinaryType())]))
    return written(items.select("row", F.explode(F.arrow_udf(cut, kind)(F.col("text"))).alias("p")).select("row", "p.*"), "passages")


def _listed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, bucket and weight of the words of passages given as lists ``bucket`` and ``value``."""
    bucket, value = batch.column("bucket"), batch.column("value")
    return np.repeat(np.arange(len(bucket)), bucket.value_lengths().to_numpy()), bucket.flatten().to_numpy(), value.flatten().to_numpy()


def _weighed(weight: np.ndarray) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Reads packed ``words`` as _listed reads lists: TF-IDF vectors of length ``scale``."""

    def rows(batch):
        passage, bucket, n = _unpacked(batch.column("words"))
        v = n * weight[bucket]
        length = np.sqrt(np.bincount(passage, v * v, len(batch)))
        return passage, bucket, v / length[passage] * batch.column("scale").to_numpy()[passage]

    return rows


def _add_product(out: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, dense: np.ndarray) -> None:
    """Adds S ``dense`` to ``out``, S the sparse matrix of ``value`` at ``row`` and ``column`` (a place occurs once).

    Rows of many values are multiplied as dense ones, of the others those of equally many at once.
    """
    value = value.astype(np.float32)
    if (row[1:] < row[:-1]).any():
        order = np.argsort(row.astype(np.uint16) if len(out) <= 1 << 16 else row, kind="stable")
        row, column, value = row[order], column[order], value[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    n = np.diff(np.append(first, len(row)))
    full, block = np.flatnonzero(n >= 128), np.empty((64, len(dense)), np.float32)
    for k in range(0, len(full), 64):
        some = full[k : k + 64]
        block[:] = 0
        for i, (at, m) in enumerate(zip(first[some].tolist(), n[some].tolist(), strict=True)):
            block[i, column[at : at + m]] = value[at : at + m]
        out[row[first[some]]] += block[: len(some)] @ dense
    rest = np.flatnonzero(n < 128)
    rest = rest[np.argsort(n[rest], kind="stable")]
    bounds = np.searchsorted(n[rest], np.arange(1, 129))
    room = np.empty((4 * _BLOCK, dense.shape[1]), np.float32)
    for k, begin, end in zip(range(1, 128), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        for lo in range(begin, end, len(room) // k):
            start = first[rest[lo : min(end, lo + len(room) // k)]]
            at = (start[:, None] + np.arange(k)).ravel()
            part = room[: len(at)]
            np.take(dense, column[at], axis=0, out=part, mode="clip")
            out[row[start]] += (value[at].reshape(-1, 1, k) @ part.reshape(-1, k, part.shape[1]))[:, 0]


def _start(n: int, wide: int) -> np.ndarray:
    """Random directions, the same in every task."""
    out, rand = np.empty((n, wide), np.float32), np.random.default_rng(5)
    for lo in range(0, n, _BLOCK):
        out[lo : lo + _BLOCK] = rand.standard_normal((min(_BLOCK, n - lo), wide))
    return out


def _orthonormal(m: np.ndarray) -> None:
    """Makes the columns of ``m`` orthonormal in place, by blocks of rows; directions beyond its rank become 0."""
    for _ in range(2):  # the second time mends what rounding left
        gram = np.zeros((m.shape[1], m.shape[1]))
        for lo in range(0, len(m), _BLOCK):
            rows = m[lo : lo + _BLOCK].astype(np.float64)
            gram += rows.T @ rows
        value, turn = np.linalg.eigh(gram)
        least = 1e-11 * max(value[-1], 1e-300)
        turn *= np.where(value > least, 1 / np.sqrt(np.maximum(value, least)), 0)
        for lo in range(0, len(m), _BLOCK):
            m[lo : lo + _BLOCK] = m[lo : lo + _BLOCK].astype(np.float64) @ turn


def latent(passages: DataFrame, vocabulary: np.ndarray, dimensions: int = DIMENSIONS, rows: Callable = _listed) -> np.ndarray:
    """Randomised SVD of the passages' TF-IDF matrix A: right singular vectors, a row for each bucket of ``vocabulary``.

    ``rows`` gives passage, bucket and weight of the words in a batch of ``passages``. In each pass but the last the tasks
    multiply their rows, A'(A M), in the last one (A M)'(A M), and other tasks sum the results by blocks of rows; M has at most
    BUCKETS rows and dimensions + MORE columns, whatever the passages. The tasks make the first M, a random one; between passes
    the driver makes M orthonormal in place: beside it, it holds what came from the tasks, then blocks of rows.
    """
    wide = min(dimensions + MORE, len(vocabulary))
    place = np.full(BUCKETS, -1)
    place[vocabulary] = np.arange(len(vocabulary))
    n, spark = len(vocabulary), passages.sparkSession
    names = ["block", "row", "v"]

    def table(row: np.ndarray, values: np.ndarray) -> pa.Table:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * wide, pa.int32()), pa.array(values.astype(np.float32).ravel()))
        return pa.table([pa.array(row // 512), pa.array(row), lists], names)

    def total(parts: pa.Table) -> pa.Table:
        row, one = np.unique(parts["row"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(row), wide), np.float32)
        _add_product(sums, one, np.arange(len(one)), np.ones(len(one)), parts["v"].combine_chunks().flatten().to_numpy().reshape(-1, wide))
        return table(row, sums)

    def summed(m: np.ndarray | None, task: Callable, size: int) -> np.ndarray:
        shared = None if m is None else spark.sparkContext.broadcast(m)

        def multiplied(batches):
            dense = _start(n, wide) if shared is None else shared.value
            for batch in batches:
                passage, bucket, value = rows(batch)
                at = place[bucket]
                if at.min(initial=0) < 0:
                    passage, at, value = passage[at >= 0], at[at >= 0], value[at >= 0]
                product = np.zeros((len(batch), wide), np.float32)
                _add_product(product, passage, at, value, dense)
                yield passage, at, value, product

        kind = "block long, row long, v array<float>"
        sums = passages.mapInArrow(lambda batches: task(multiplied(batches)), kind).groupBy("block").applyInArrow(total, kind).toArrow()
        out = np.zeros((size, wide), np.float32)
        for part in sums.to_batches():
            out[part.column("row").to_numpy()] = part.column("v").flatten().to_numpy().reshape(-1, wide)
        if shared is not None:
            shared.destroy()
        return out

    def words(parts):
        out, used = np.zeros((n, wide), np.float32), np.zeros(n, bool)
        for passage, at, value, product in parts:
            _add_product(out, at, passage, value, product)
            used[at] = True
        met = np.flatnonzero(used)
        yield from table(met, out[met]).to_batches()

    def square(parts):
        out = np.zeros((wide, wide))
        for *_, product in parts:
            out += product.T @ product
        yield from table(np.arange(wide), out).to_batches()

    m = None
    for _ in range(POWERS):
        m = summed(m, words, n)
        _orthonormal(m)
    value, turn = np.linalg.eigh(summed(m, square, wide))
    return m @ turn[:, np.argsort(-value)[: min(dimensions, wide)]]


def common(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, by bits of the item (a row of the table in each step)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(item):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for x in words:
        m = row & masks.get(x, 0)
        row = (row + m | row - m) & full
    return len(item) - row.bit_count()


def _answer(text: str) -> str:
    """What follows an item's last line break, or else its last sentence."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return lines[-1]
    parts = [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x]
    return parts[-1] if len(parts) > 1 else ""


def fit(docs: DataFrame, items: DataFrame) -> list[dict]:
    """What find_leaks needs, for at most SLICE items each: projected words and passages, and the items' words.

    Frequencies cover all of ``docs``. The latent space is fitted on all different passages of documents and all of the
    benchmark's, both with the same weight, so that words that documents use alike come near each other. An item is a row of the
    benchmark: rows may share an item_id or have none, equal rows are one item, items without words are left out.
    An empty benchmark gives no model. What comes to the driver at once is bounded by BUCKETS and SLICE.
    """
    items = items.select("item_id", F.arrow_udf(_lower, T.StringType())("text").alias("text")).where("text is not null").distinct()
    items = written(items.withColumn("row", F.monotonically_increasing_id()), "items")
    n_items = items.count()
    if not n_items:
        return []
    items = numbered(items, [], ["row"], "number", n_items).select("item_id", "text", F.col("number").alias("row"))
    items = written(items.withColumn("slice", F.floor(F.col("row") / SLICE)), "items")
    weight, different = survey(docs)
    passages = _passages(items, weight)
    n_passages, n_different = passages.count(), different.count()
    scale = np.sqrt(max(1, n_different) / max(1, n_passages))
    tasks = max(LEAST_TASKS, -(-n_different // PER_TASK))
    both = different.select("words", F.lit(1.0).alias("scale")).union(passages.select("words", F.lit(float(scale)).alias("scale"))).coalesce(tasks)
    vocabulary = np.sort(_often(different.coalesce(tasks)).union(passages.select(F.explode("bucket").alias("b"))).distinct().toArrow()["b"].to_numpy())
    if not len(vocabulary) or not n_passages:
        return []
    basis = latent(both, vocabulary, rows=_weighed(weight))
    place = np.zeros(BUCKETS, np.int32)
    place[vocabulary] = np.arange(1, len(vocabulary) + 1)
    project = np.zeros((len(vocabulary) + 1, basis.shape[1]), np.float32)
    np.multiply(basis, weight[vocabulary][:, None], out=project[1:], casting="same_kind")
    squares = (weight * weight).astype(np.float32)
    models = []
    for k in range(-(-n_items // SLICE)):
        rows = items.where(F.col("slice") == k).orderBy("row").toArrow()
        table = passages.where((F.col("row") >= k * SLICE) & (F.col("row") < (k + 1) * SLICE)).orderBy("row", "first").toArrow().to_pandas()
        if not len(table):
            continue
        words, answers = [], []
        source = rows["text"].to_pandas()
        for texts, out in ((source, words), (source.map(_answer), answers)):
            for piece in pieces(pa.array(texts, pa.string())):
                w = Words(piece)
                h = _hashes(w)
                out += [h[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        vectors = np.stack([v @ basis[place[b] - 1] for b, v in zip(table["bucket"], table["value"], strict=True)])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in answers])])
        vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        item = table["row"].to_numpy() - k * SLICE
        n = np.array([len(x) for x in words])
        size = np.minimum(2 * HALF, n[item] - table["first"].to_numpy())
        mask = np.zeros((len(table), _BITS // 8), np.uint8)
        for i, b in enumerate(table["bucket"]):
            np.bitwise_or.at(mask[i], b % _BITS // 8, (1 << (b % 8)).astype(np.uint8))
        models.append({"place": place, "project": project, "squares": squares, "vectors": vectors, "item": item, "first": table["first"].to_numpy(), "mask": mask, "size": size, "items": rows["item_id"].to_pylist(), "words": words, "answers": answers, "answer": (np.array([x for y in answers for x in y], U) & U(BUCKETS - 1)).astype(np.int64), "ends": ends, "bucket": (np.array([x for y in words for x in y], U) & U(BUCKETS - 1)).astype(np.int64), "upto": np.concatenate([[0], np.cumsum(n)])})
    return models


_LEAK = T.StructType([T.StructField(n, t) for n, t in (("item_id", T.LongType()), ("first_word", T.IntegerType()), ("n_words", T.IntegerType()), ("cosine", T.DoubleType()), ("common", T.DoubleType()), ("answer", T.BooleanType()))])


def _least(item: list[int], answer: list[int], have: set[int]) -> float:
    """Fewest words in common order that can confirm an item where the words ``have`` stand."""
    least = min(COMMON * len(item), QUOTED)
    if answer and have.issuperset(answer):
        least = min(least, (COMMON_ANSWER if len(answer) >= ANSWER_WORDS else COMMON_SHORT) * len(item))
    return least - 1e-9


def _confirm(best: dict, model: dict, h: np.ndarray, words_at: np.ndarray, first: np.ndarray, doc: np.ndarray, at: np.ndarray, q: np.ndarray, cosines: np.ndarray) -> None:
    """Puts the best place of one item among the windows ``at`` of one text into ``best``; words that no order can confirm are passed over."""
    d, k = int(doc[at[0]]), int(model["item"][q[0]])
    item, answer = model["words"][k], model["answers"][k]
    begin, end = int(words_at[d]), int(words_at[d + 1])
    start = begin + (at - first[d]) * STEP
    have = set(h[max(begin, start[0] - len(item)) : min(end, start[-1] + 2 * HALF + len(item))].tolist())
    if not item or sum(x in have for x in item) < _least(item, answer, have):
        return
    last = -1
    for s, p, cosine in zip(start.tolist(), q.tolist(), cosines.tolist(), strict=True):
        if (d, k) in best and best[d, k]["common"] == 1.0:
            return
        lo, hi = max(begin, s - len(item)), min(end, s + 2 * HALF + len(item))
        if s != last:
            last, count, said = s, 0, False
            words = h[lo:hi].tolist()
            have = set(words)
            if sum(x in have for x in item) >= _least(item, answer, have):
                count = common(item, words)
                said = len(answer) > 0 and any(words[j : j + len(answer)] == answer for j, x in enumerate(words) if x == answer[0])
        share = count / len(item)
        found = share >= COMMON or said and share >= (COMMON_ANSWER if len(answer) >= ANSWER_WORDS else COMMON_SHORT)
        if not found and count >= QUOTED:
            part = model["first"][p]
            found = common(item[part : part + 2 * HALF], h[max(lo, s - HALF) : min(hi, s + 3 * HALF)].tolist()) >= QUOTED
        if found:
            old = best.get((d, k))
            if old is None or (share, cosine) > (old["common"], old["cosine"]):
                best[d, k] = {"item_id": model["items"][k], "first_word": lo - begin, "n_words": hi - lo, "cosine": cosine, "common": share, "answer": said}


def _leaks_of(piece: pa.Array, model: dict) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(piece))]
    w = Words(piece)
    if not len(w.start):
        return out
    h = _hashes(w)
    step, first, doc = _steps(w)
    bucket = (h & U(BUCKETS - 1)).astype(np.int64)
    row = model["place"][bucket]
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    places = bucket[order] * len(bucket) + order
    words = np.zeros((len(doc), STEP), np.int32)  # of each step; 0: no word, or one without a place
    words[step, (np.arange(len(row)) - w.first[w.doc]) % STEP] = row
    squares = np.bincount(step, model["squares"][bucket], len(doc) + 1)
    mask = np.unpackbits(model["mask"], bitorder="little")
    best: dict[tuple[int, int], dict] = {}
    for lo in range(0, len(doc), 8 * _BLOCK):  # ranges of steps, so that a very long text takes no more memory at once
        window, square = _windows(model["project"], words, squares, doc, lo, min(len(doc), lo + 8 * _BLOCK))
        least = COSINE * np.sqrt(square)
        some = np.flatnonzero(np.einsum("ij,ij->i", window, window) >= least * least)
        window, least, some = window[some], least[some].astype(np.float32), lo + some
        for a in range(0, len(model["vectors"]), _BLOCK):
            dot = window @ model["vectors"][a : a + _BLOCK].T
            i, q = np.divmod(np.flatnonzero(dot >= least[:, None]), dot.shape[1])
            cosines, at, q = COSINE * dot[i, q] / np.maximum(least[i], 1e-12), some[i], a + q
            said = _answered(model, bucket, w.first, doc[at], model["item"][q])
            enough = _shared(mask, w, bucket, first, doc, at, q) >= np.where(said, COMMON_ANSWER, COMMON) * model["size"][q] - STEP / 2
            cosines, at, q, said = cosines[enough], at[enough], q[enough], said[enough]
            if not len(at):
                continue
            order = np.lexsort((at, model["item"][q], doc[at]))
            cosines, at, q, said = cosines[order], at[order], q[order], said[order]
            k = model["item"][q]
            new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (doc[at[1:]] != doc[at[:-1]]) | (at[1:] - at[:-1] > 2 * HALF)]))
            ends = np.append(new[1:], len(at))
            may = _possible(model, w, places, first, doc, at[new], at[ends - 1], k[new], said[new])
            for c, e in zip(new[may].tolist(), ends[may].tolist(), strict=True):  # windows of a text that are near one item, and near each other
                _confirm(best, model, h, w.first, first, doc, at[c:e], q[c:e], cosines[c:e])
    for (d, _), leak in sorted(best.items()):
        out[d].append(leak)
    return out


def _windows(project: np.ndarray, words: np.ndarray, squares: np.ndarray, doc: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Latent vectors, and squared lengths before projection, of the windows that begin at the steps ``lo`` to ``hi``."""
    more = 2 * HALF // STEP
    end = min(len(doc), hi + more - 1)
    sums = np.zeros((end - lo + more, project.shape[1]), np.float32)
    room = np.empty((_BLOCK, project.shape[1]), np.float32)
    for a in range(lo, end, _BLOCK):
        n = min(_BLOCK, end - a)
        np.take(project, words[a : a + n, 0], axis=0, out=sums[a - lo : a - lo + n], mode="clip")
        for k in range(1, STEP):
            sums[a - lo : a - lo + n] += np.take(project, words[a : a + n, k], axis=0, out=room[:n], mode="clip")
    window, square = sums[: hi - lo].copy(), squares[lo:hi].copy()
    of = np.concatenate([doc[lo:end], np.full(more, -1)])
    for k in range(1, more):
        other = np.flatnonzero(of[k : k + hi - lo] != of[: hi - lo])  # few: the last windows of each text
        ended = window[other]
        window += sums[k : k + hi - lo]
        window[other] = ended
        part = np.concatenate([squares[lo:end], np.zeros(more)])[k : k + hi - lo]
        part[other] = 0
        square += part
    return window, square


def _possible(model: dict, w: Words, places: np.ndarray, first: np.ndarray, doc: np.ndarray, begin: np.ndarray, last: np.ndarray, items: np.ndarray, said: np.ndarray) -> np.ndarray:
    """Runs of windows, from step ``begin`` to step ``last``, around which enough of the item's words stand for _confirm, told apart by bucket.

    places: bucket * number of words + place of every word, in order. said: whether the answer's words stand in the text.
    """
    d, total = doc[begin], len(w.start)
    n = model["upto"][items + 1] - model["upto"][items]
    lo = np.maximum(w.first[d], w.first[d] + (begin - first[d]) * STEP - n)
    hi = np.minimum(w.first[d + 1], w.first[d] + (last - first[d]) * STEP + 2 * HALF + n)
    run = np.repeat(np.arange(len(items)), n)
    at = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + model["upto"][items][run]
    key = model["bucket"][at] * total
    found = np.append(places, BUCKETS * total)[np.searchsorted(places, key + lo[run])] < key + hi[run]
    share = np.where(said, np.where(np.diff(model["ends"])[items] >= ANSWER_WORDS, COMMON_ANSWER, COMMON_SHORT), COMMON)
    return np.bincount(run, found, len(items)) >= np.minimum(share * n, QUOTED) - 1e-9


def _shared(mask: np.ndarray, w: Words, bucket: np.ndarray, first: np.ndarray, doc: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words of each window stand in its passage too, at least: words are told apart by _BITS bits."""
    n = np.zeros(len(at), np.int32)
    start = w.first[doc[at]] + (at - first[doc[at]]) * STEP
    inside = w.first[doc[at] + 1] - start
    bit, row = np.append(bucket % _BITS, np.zeros(2 * HALF, np.int64)), q * _BITS
    for k in range(2 * HALF):
        n += mask[row + bit[start + k]] & (inside > k)
    return n


def _answered(model: dict, bucket: np.ndarray, first: np.ndarray, texts: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Whether all words of the item's answer stand in the text, if it has one. texts: in order."""
    ends = model["ends"]
    out = np.zeros(len(texts), bool)
    here = np.zeros(BUCKETS, bool)
    bounds = np.flatnonzero(np.diff(texts, prepend=-1, append=-1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        mine = bucket[first[texts[a]] : first[texts[a] + 1]]
        here[mine] = True
        upto = np.concatenate([[0], np.cumsum(here[model["answer"]])])
        n = upto[ends[1:]] - upto[ends[:-1]]
        out[a:b] = ((n == np.diff(ends)) & (n > 0))[items[a:b]]
        here[mine] = False
    return out


def _search(shared):
    """The leaks of a text among the items of one model."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [x for piece in pieces(texts) for x in _leaks_of(_lower(piece), shared.value)]
        return pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.bool_())])))

    return F.arrow_udf(run, T.ArrayType(_LEAK))


def find_leaks(docs: DataFrame, models: list[dict], text: str = "text", out: str = "leaks") -> DataFrame:
    """``docs`` with the benchmark items that each text holds, in ``out``: array<struct> of _LEAK.

    Every window of every text meets every passage of the items, in blocks, by the cosine of its TF-IDF vector with the passage's
    place in the latent space; candidates are confirmed if COMMON of the item's words stand in order around the window, or COMMON_ANSWER of
    them (COMMON_SHORT if it is short) and its answer word for word, or QUOTED words of one of its passages. An item is
    listed once a text, with its best place. Null and empty texts, and an empty benchmark, give empty lists; so does an empty table.
    Each row is searched alone, very long texts in blocks of windows; rows that repeat stay, other columns pass, ``out``
    replaces a column of that name. A benchmark of more than SLICE items takes a written table for each slice.
    """
    docs = docs.withColumn(out, F.array().cast(T.ArrayType(_LEAK)))
    for k, model in enumerate(models):
        found = _search(docs.sparkSession.sparkContext.broadcast(model))(F.col(text))
        docs = docs.withColumn(out, F.concat(out, found) if k else found)
        if k + 1 < len(models):
            docs = written(docs, "searched")
    return docs


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document and item that it holds: doc_id, item_id and the place. Rows that repeat are each searched."""
    docs = docs.select("doc_id", "text")
    return find_leaks(docs, fit(docs, items)).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")
