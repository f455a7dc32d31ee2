"""Toxicity by a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams (2 to 6 bytes, ASCII letters lower-cased) that don't reach over a space, each
present or not. A feature's scale is the logarithm of the ratio of its rates in toxic and other training texts; a text's
scaled features have length 1. On these a logistic regression is fitted, and its threshold is set where it does best on a
part of the training texts that a first fit leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.llm.common import annotate, named

ORDERS, BITS = (2, 6), 18
#: Labelled rows that a model is fitted to, at most, and the texts that a feature must be in.
SAMPLE, LEAST_TEXTS = 2500, 4
LOWER = np.arange(256, dtype=np.uint32)
LOWER[65:91] += 32
LOWER[[9, 10, 11, 12, 13]] = 32


class Model(NamedTuple):
    scales: np.ndarray  # by feature
    weights: np.ndarray  # by feature; they include the scales
    bias: float


class Features:
    """The distinct n-grams of texts as numbers under 2**BITS."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int64)

    def of(self, text: str | None) -> np.ndarray:
        data = LOWER[np.frombuffer((" " + (text or "") + " ").encode(), np.uint8)]
        low, high = ORDERS
        h, whole, space, found = data.copy(), None, data == 32, []
        for n in range(2, high + 1):
            size = len(data) - n + 1
            if size <= 0:
                break
            h = h[:size] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
            if n == 2:
                whole = ~(space[:-1] & space[1:])
            else:
                whole = whole[:size] & ~space[n - 2 : n - 2 + size]
            if n >= low:
                x = h[whole]
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                found.append(x >> np.uint32(32 - BITS))
        x = np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)
        order = np.arange(len(x))
        self.last[x] = order  # the last of equal ones stays
        return x[self.last[x] == order]


def ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == k] or [np.empty(0, np.int64)]), minlength=1 << BITS) for k in (0, 1)]
    rates = [(c + 1) / (np.sum(labels == k) + 2) for k, c in enumerate(counts)]
    return np.where(counts[0] + counts[1] >= LEAST_TEXTS, np.log(rates[1] / rates[0]), 0).astype(np.float32)


def lengths(rows: list[np.ndarray], scales: np.ndarray) -> np.ndarray:
    return np.array([np.sqrt(max(1e-9, float((scales[r] ** 2).sum()))) for r in rows], np.float32)


def regression(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 60, decay: float = 1e-4) -> Model:
    """Full-batch gradient descent with momentum; both labels weigh the same in total."""
    scales = ratios(rows, labels)
    rows = [r[scales[r] != 0] for r in rows]
    sizes = np.array([len(r) for r in rows])
    some = sizes > 0
    rows, y, sizes = [r for r, s in zip(rows, some) if s], labels[some], sizes[some]
    if not len(rows):
        return Model(scales, np.zeros_like(scales), 0.0)
    at = np.concatenate(rows).astype(np.int32)
    begins = np.cumsum(sizes) - sizes
    values = scales[at] / np.repeat(lengths(rows, scales), sizes)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(1 << BITS, np.float32), 0.0
    pull_w, pull_b = np.zeros_like(w), 0.0
    for _ in range(rounds):
        z = np.add.reduceat(values * w[at], begins) + b
        g = ((y - 1 / (1 + np.exp(-z))) * share).astype(np.float32)
        pull_w = 0.9 * pull_w + np.bincount(at, values * np.repeat(g, sizes), 1 << BITS).astype(np.float32) - decay * w
        pull_b = 0.9 * pull_b + float(g.sum())
        w, b = w + 20 * pull_w, b + 2 * pull_b
    return Model(scales, w * scales, b)


def raw(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    sums = np.array([float(model.weights[r].sum()) for r in rows])
    return sums / lengths(rows, model.scales) + model.bias


def fit(rows: list[np.ndarray], labels: np.ndarray, left_out: np.ndarray) -> Model:
    """A model of all rows, its bias moved to where F1 was best on the rows left out of a first fit."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 2.0 if labels.sum() else -2.0)
    move, inner, outer = 0.0, np.flatnonzero(~left_out), np.flatnonzero(left_out)
    if len(set(labels[inner].tolist())) == 2 and labels[outer].sum() >= 5:
        z = raw(regression([rows[i] for i in inner], labels[inner]), [rows[i] for i in outer])
        order = np.argsort(-z)
        hits = np.cumsum(labels[outer][order])
        best = int(np.argmax(2 * hits / (np.arange(1, len(z) + 1) + labels[outer].sum())))
        ranked = z[order]
        move = -(ranked[best] + ranked[min(best + 1, len(z) - 1)]) / 2
    model = regression(rows, labels)
    return model._replace(bias=model.bias + float(move))


def fold(column) -> F.Column:
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(5))


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from `sample` labelled documents at most (toxic 0 or 1) whose fold isn't 0, drawn by a hash of their ids.

    The ids drawn are broadcast and their texts' feature numbers reach the driver, under 2**BITS for each: both are bounded
    by sample. Of several texts of one id that with the least hash counts, so equal tables give equal models. Rows with
    nulls in id or label are left out; no labels, or one only, give a model that scores every text alike.
    """
    known = labels.where(F.col("toxic").isNotNull() & named(id_col).isNotNull() & (fold(named(id_col)) != 0))
    drawn = known.groupBy(named(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = drawn.withColumn("fold", fold(F.col("_id")).cast("int")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = df.select(named(id_col).alias("_id"), named(text_col).alias("_text")).join(F.broadcast(drawn), "_id")
    texts = texts.groupBy("_id", "toxic", "fold").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")).select("_text", "toxic", "fold", "_id")
    id_type = texts.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            rows = [features.of(t).astype("<i4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(rows, pa.binary()), *batch.columns[1:]], ["features", "toxic", "fold", "_id"])

    found = texts.mapInArrow(run, f"features binary, toxic int, fold int, _id {id_type}").toLocalIterator()
    rows = sorted(((r[3], np.frombuffer(r[0], "<i4"), r[1], r[2]) for r in found), key=lambda r: r[0])
    return fit([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64) == 1)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (1 from 0.5 on).

    A null text is scored as an empty one, a very long one whole. Rows are kept one for one; columns of df with these names,
    in whatever case, are replaced. One map, no shuffle; the model has a fixed size.
    """
    spread = df.sparkSession.sparkContext.broadcast(model)

    def make():
        held, features = spread.value, Features()

        def one(text: str | None) -> tuple:
            row = features.of(text)
            z = float(held.weights[row].sum()) / max(1e-9, float((held.scales[row] ** 2).sum())) ** 0.5 + held.bias
            p = 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))
            return float(p), int(p >= 0.5)

        return lambda texts: list(map(one, texts))

    return annotate(df, text_col, make, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def digest(scored: DataFrame) -> DataFrame:
    """doc_id, held_out (its fold is 0; a null id has none and is not held out), score and predicted."""
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
