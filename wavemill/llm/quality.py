"""Quality rules: document statistics, judged by gradient-boosted trees that are scored as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._words import U, Words, mix, pieces

#: Counts that are returned, then features derived from them and from further counts.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks", "line_words")
#: Features whose growth may only lower the score.
FALLING = ("symbols", "dup_lines", "repeats")
#: Labelled rows that a fit takes at most: those whose doc_id has the least hash.
SAMPLE = 20_000

_SYMBOL, _UPPER, _DIGIT, _MARK, _POINT = (np.zeros(256, np.int8) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER[ord("A") : ord("Z") + 1] = 1
_DIGIT[ord("0") : ord("9") + 1] = 1
_MARK[list(b"!?.,;:")] = 1
_POINT[[b for b in range(256) if b & 0xC0 != 0x80]] = 1


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which elements have an equal one, and which are the first of theirs."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, first = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    twice[order[1:]], first[order[1:]] = same, ~same
    twice[order[:-1]] |= same
    return twice, first


def measure(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS and FEATURES of the texts of one piece, a row each."""
    w = Words(texts)
    docs = len(texts)

    def per_doc(table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(table[w.data], dtype=np.int64)])[w.off])

    def of_doc(at: np.ndarray) -> np.ndarray:
        return np.bincount(at, minlength=docs)

    h = w.hashes()
    grams, at = w.grams(h, 3)
    twice, _ = _repeated(mix(grams + w.doc[at].astype(U) * U(0x9E3779B97F4A7C15)))
    cover = np.zeros(len(h) + 4, np.int64)
    for k in range(3):
        cover[at[twice] + k] = 1
    _, fresh = _repeated(mix(h + w.doc.astype(U) * U(0x9E3779B97F4A7C15)))
    # lines: from each text's start or the byte after \n, up to \n or the text's end; those with a word count
    cut = np.flatnonzero(w.data == 10)
    start = np.unique(np.concatenate([w.off[:-1], cut + 1]))  # an empty text starts where the next one does
    line_doc = np.searchsorted(w.off, start, "right") - 1
    keep = line_doc < docs
    start, line_doc = start[keep], line_doc[keep]
    after = np.append(cut, len(w.data))[np.searchsorted(cut, start)]
    end = np.minimum(after, w.off[1:][line_doc])
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, line_doc = start[has], end[has], line_doc[has]
    _, new = _repeated(mix(w.spans(start, end) + line_doc.astype(U) * U(0x9E3779B97F4A7C15)))
    ink = per_doc(np.where(np.isin(np.arange(256), [0x20, *range(9, 14)]), 0, _POINT))
    n = w.count.astype(np.int64)
    counts = np.stack([n, ink, per_doc(_SYMBOL), of_doc(line_doc[~new]), of_doc(w.doc[cover[: len(h)] > 0])], 1)
    some, lines, inked = np.maximum(n, 1), np.maximum(of_doc(line_doc), 1), np.maximum(ink, 1)
    features = np.stack([np.log1p(n), ink / some, counts[:, 2] / some, counts[:, 3] / lines, counts[:, 4] / some, of_doc(w.doc[fresh]) / some, per_doc(_UPPER) / inked, per_doc(_DIGIT) / inked, per_doc(_MARK) / some, n / lines], 1)
    return counts, features


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 48, ridge: float = 2.0, falling: tuple[int, ...] = ()) -> dict[str, np.ndarray]:
    """Boosted trees for labels 0 and 1, as flat arrays of complete binary trees.

    Node i has children 2i+1 and 2i+2; a row goes right if its feature is over the threshold. For a
    feature in ``falling`` a split needs a right value no higher than the left one, and both sides'
    descendants stay on their side of the middle, so the score never rises with the feature.
    """
    nodes = 2 ** (depth + 1) - 1
    feature, threshold, value = np.zeros((trees, nodes), np.int32), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    mean = min(max(y.mean() if len(y) else 1.0, 1e-3), 1 - 1e-3)
    base = np.log(mean / (1 - mean))
    if len(y) and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        score = np.full(len(y), base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            bound = {0: (-np.inf, np.inf)}
            best = lambda a, b, lo, hi: np.clip(a / (b + ridge), lo, hi)
            gain = lambda v, a, b: v * a - 0.5 * v * v * (b + ridge)
            for node in range(nodes):
                rows = at == node
                lo, hi = bound.get(node, (-np.inf, np.inf))
                total_g, total_h = g[rows].sum(), h[rows].sum()
                value[t, node] = best(total_g, total_h, lo, hi)
                if node >= 2**depth - 1 or rows.sum() < 20:
                    continue
                top = (1e-6, -1, 0.0, 0.0, 0.0)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    left_g = np.cumsum(np.bincount(code[rows, j], g[rows], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(code[rows, j], h[rows], len(e) + 1))[:-1]
                    vl, vr = best(left_g, left_h, lo, hi), best(total_g - left_g, total_h - left_h, lo, hi)
                    more = gain(vl, left_g, left_h) + gain(vr, total_g - left_g, total_h - left_h) - gain(value[t, node], total_g, total_h)
                    more[(left_h < 1e-3) | (total_h - left_h < 1e-3) | ((vr > vl) & (j in falling))] = 0
                    k = int(more.argmax())
                    if more[k] > top[0]:
                        top = (more[k], j, e[k], vl[k], vr[k])
                if top[1] < 0:
                    continue
                feature[t, node], threshold[t, node] = top[1], top[2]
                middle = (top[3] + top[4]) / 2
                bound[2 * node + 1], bound[2 * node + 2] = ((middle, hi), (lo, middle)) if top[1] in falling else ((lo, hi), (lo, hi))
                at[rows] = 2 * node + 1 + (x[rows, top[1]] > top[2])
            for node in range(nodes):  # a row that stopped early keeps its node's value on the way down
                if node and np.isinf(threshold[t, (node - 1) // 2]):
                    value[t, node] = value[t, (node - 1) // 2]
            score += rate * value[t, at]
    return {"feature": feature, "threshold": threshold, "value": rate * value, "base": np.array(base), "depth": np.array(depth)}


def score(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), float(model["base"]))
    rows = np.arange(len(x))
    for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(int(model["depth"])):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        out += value[node]
    return 1 / (1 + np.exp(-out))


def _measured(model: dict | None):
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(f, T.DoubleType()) for f in FEATURES] + [T.StructField("score", T.DoubleType())])

    def run(texts: pa.Array) -> pa.Array:
        found = [measure(p) for p in pieces(texts)] or [(np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(FEATURES))))]
        counts, features = (np.concatenate(x) for x in zip(*found, strict=True))
        p = score(model, features) if model else np.zeros(len(features))
        return pa.StructArray.from_arrays([pa.array(c) for c in [*counts.T, *features.T, p]], kind.names)

    return F.arrow_udf(run, kind)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """A model of ``label`` from at most ``sample`` labelled documents, those with the least hash of doc_id.

    Null labels are left out; rows that repeat a doc_id and label are one, of the least measures. Without labels, or with labels all alike, the model is a constant that
    keeps what passes the base rules.
    """
    some = labels.select("doc_id", F.col(label).alias("_y")).where("doc_id is not null and _y is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(sample)
    measured = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("m", _measured(None)(F.col("text")))
    once = measured.groupBy("doc_id", "_y").agg(F.min(F.struct(*(F.col(f"m.{f}").alias(f) for f in FEATURES))).alias("m"))
    rows = once.select("_y", "m.*").toArrow().to_pandas().sort_values(["_y", *FEATURES])
    x, y = rows[list(FEATURES)].to_numpy(float), rows["_y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        x, y = x[:0], y[:0]
    return boost(x, y, falling=tuple(map(FEATURES.index, FALLING)))


def judge(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with COUNTS, quality_score, base_failed and kept.

    The base fails with under 50 words, or if over half of the words stand in three-word windows
    that the text has twice; then, or with a score under 0.5, a document isn't kept. Null and empty
    texts have no words and fail. Each row is judged alone, so rows that repeat are judged alike; very long texts are read whole, one at a time;
    an empty table gives an empty one. Other columns pass, columns of these names are replaced.
    """
    docs = docs.withColumn("_m", _measured(model)(F.col(text)))
    docs = docs.withColumns({c: F.col(f"_m.{c}") for c in COUNTS} | {"quality_score": F.col("_m.score")}).drop("_m")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return docs.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality_score") >= 0.5))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", *COUNTS, "base_failed", "kept", "quality_score")
