"""Toxicity by multiple-instance learning: sentences are scored, documents have the labels."""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spread import written

#: Labelled rows that a fit takes at most: those whose doc_id has the least hash.
SAMPLE = 20_000
#: Hash buckets of features, how many of them a model weighs at most, and the standard deviations by which these stand out.
BUCKETS, CHOSEN, LEAST_GAP = 1 << 18, 4096, 4.0
_SENTENCE, _WORD = re.compile(r"[^.!?\n]+"), re.compile(r"\w+")
_MOST_WORDS = 300_000


def features(word: str) -> set[int]:
    """Buckets of a lower-case word, its first three to five characters and its last four."""
    parts = {"=" + word, *("^" + word[:k] for k in (3, 4, 5) if len(word) >= k)}
    if len(word) >= 4:
        parts.add("$" + word[-4:])
    return {zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts}


class _Known(dict):
    """What a function gives for a word, kept for at most _MOST_WORDS words."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, word):
        if len(self) >= _MOST_WORDS:
            self.clear()
        self[word] = out = self.of(word)
        return out


def _all_features(texts: pa.Array) -> pa.Array:
    known = _Known(features)
    return pa.array([sorted(set(chain.from_iterable(map(known.__getitem__, set(_WORD.findall((t.as_py() or "").lower())))))) for t in texts], pa.list_(pa.int32()))


def train(bags: list[list[np.ndarray]], empty: np.ndarray, y: np.ndarray, size: int, rounds: int = 200, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of sentence scores from document labels.

    ``bags``: for each document the feature numbers of its sentences that have any; ``empty``: how
    many of its sentences have none. A document is toxic unless none of its sentences is: noisy-or,
    log(1 - P) = -sum softplus(z). Full-batch Adam on the mean log-likelihood.
    """
    sentences = [s for bag in bags for s in bag]
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    row = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    col = np.concatenate(sentences) if sentences else np.zeros(0, np.int64)
    w = np.zeros(size + 1)
    w[size] = -5.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        b = w[size]
        z = np.bincount(row, w[col], len(sentences)) + b
        none = np.bincount(doc, np.logaddexp(0, z), len(bags)) + empty * np.logaddexp(0, b)  # -log(1 - P)
        ratio = np.where(y > 0, 1 / np.maximum(np.expm1(np.minimum(none, 50)), 1e-6), -1.0)
        sig, sig0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        dz = ratio[doc] * sig
        g = np.bincount(col, dz[row], size + 1) / len(y) - ridge * w
        g[size] = (dz.sum() + (ratio * empty).sum() * sig0) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:size], float(w[size])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> dict:
    """A model of ``label`` from at most ``sample`` documents, labelled in ``labels``, with the least hash of doc_id.

    Features are ranked over the sample by Spark (a row per bucket comes to the driver, so
    BUCKETS at most); then sentences keep the chosen ones only. Rows that repeat a doc_id and label are one, of the least text, so
    ``sample`` bounds what comes to the driver. Null labels are left out; without labels, or
    with labels all alike, the model gives every document the labels' mean (0 without any).
    """
    some = labels.select("doc_id", F.col(label).alias("_y")).where("doc_id is not null and _y is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(sample)
    labelled = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = written(labelled.groupBy("doc_id", "_y").agg(F.min("text").alias("text")), "labelled")
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not n or n1 in (0, n):
        return {"weights": {}, "bias": -np.inf, "floor": n1 / n if n else 0.0}
    per = rows.select("_y", F.explode(F.arrow_udf(_all_features, T.ArrayType(T.IntegerType()))(F.col("text"))).alias("f")).groupBy("f").agg(F.count("*").alias("c"), F.sum("_y").alias("c1")).where("c >= 3").toArrow().to_pandas()
    p = n1 / n
    gap = (per["c1"] - p * per["c"]) / np.sqrt(p * (1 - p) * per["c"])
    per, gap = per[gap.abs() >= LEAST_GAP], gap[gap.abs() >= LEAST_GAP]
    chosen = per["f"].to_numpy()[np.lexsort((per["f"], -gap.abs()))][:CHOSEN]
    number = {int(f): i for i, f in enumerate(chosen)}

    def bag(texts: pa.Array) -> pa.Array:
        known = _Known(lambda word: [number[f] for f in features(word) if f in number])
        out = []
        for t in texts:
            parts = [sorted(set(chain.from_iterable(map(known.__getitem__, _WORD.findall(s))))) for s in _SENTENCE.findall((t.as_py() or "").lower())]
            out.append([x for x in parts if x] + [[len(parts) - sum(map(bool, parts))]])  # last: how many have none
        return pa.array(out, pa.list_(pa.list_(pa.int32())))

    found = rows.select("doc_id", "_y", F.arrow_udf(bag, T.ArrayType(T.ArrayType(T.IntegerType())))(F.col("text")).alias("b")).toArrow().to_pandas().sort_values(["doc_id", "_y"])
    bags = [[np.asarray(s, np.int64) for s in b[:-1]] for b in found["b"]]
    w, bias = train(bags, np.array([b[-1][0] for b in found["b"]], float), found["_y"].to_numpy(float), len(chosen))
    return {"weights": {int(f): float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-6}, "bias": bias, "floor": 0.0}


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with toxicity (0 to 1) and offending: spans of the sentences that are toxic by themselves.

    A sentence ends at ``.``, ``!``, ``?`` or a new line; spans count code points, end exclusive. Null and empty
    texts have no sentence: they score the model's floor (0 once trained). Each text is read whole
    and alone, also a very long one, so rows that repeat score alike; an empty table gives an empty one. Other columns pass, those two are replaced.
    """
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    weights, bias, floor = model["weights"], model["bias"], model["floor"]

    def run(texts: pa.Array) -> pa.Array:
        known = _Known(lambda word: sum(weights.get(f, 0.0) for f in features(word.lower())))
        scores, spans = [], []
        for t in texts:
            none, found, t = 0.0, [], t.as_py() or ""
            zs = [(m, bias + sum(map(known.__getitem__, _WORD.findall(m.group())))) for m in _SENTENCE.finditer(t)]
            if zs:
                z = np.array([x for _, x in zs])
                none = float(np.logaddexp(0, z).sum())
                found = [{"start": zs[i][0].start(), "end": zs[i][0].end(), "score": float(1 / (1 + np.exp(-z[i])))} for i in np.flatnonzero(z >= 0)]
            scores.append(max(floor, -float(np.expm1(-none))))
            spans.append(found)
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))], ["score", "spans"])

    return docs.withColumn("_t", F.arrow_udf(run, kind)(F.col(text))).withColumns({"toxicity": F.col("_t.score"), "offending": F.col("_t.spans")}).drop("_t")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, offending; the model sees no label of a held-out row."""
    docs = docs.select("doc_id", "text")
    out = score(docs, fit(docs, labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "offending")
