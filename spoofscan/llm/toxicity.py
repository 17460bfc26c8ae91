"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own rate, and L1 keeps all but a few hundred of the 2^20 weights at zero, so the model is a
short list that goes to every task. Training takes a bounded sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts
from .learning import held_out, training_rows

#: Coordinates of the hashed features; labelled rows that training may use at most; passes over them.
DIMENSIONS, MOST_ROWS, PASSES = 1 << 20, 12_000, 12
#: FTRL-proximal: rate, smoothing of the rate, L1, L2. The bias starts at the log-odds of the positive rows.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 12.0, 0.0
THRESHOLD = 0.3
#: Words count by their first bytes too, so that compounds which training never saw share what their stems weigh.
STEMS = (4, 6, 8)
#: ASCII punctuation ends words.
_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def features(text: str) -> np.ndarray:
    """Coordinates of a text's words, their stems, bigrams, and skip-grams over one and two words; repeats included."""
    words = text.lower().encode().translate(_PUNCTUATION).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    parts = [h * _MIX[0]]
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append((h[:-gap] * _MIX[0] + h[gap:] * _MIX[gap]) * _MIX[0])
    for i, size in enumerate(STEMS):
        stems = np.fromiter((zlib.crc32(w[:size]) for w in words), np.uint64, len(words))
        parts.append(stems * _MIX[3] * np.uint64(2 * i + 3))
    return (np.concatenate(parts) >> np.uint64(44)).astype(np.int64)


class Ftrl:
    """State of each coordinate: z and the sum n of squared gradients; weights follow from them."""

    def __init__(self, size: int, bias: float) -> None:
        self.z, self.n, self.bias, self.bias_n = np.zeros(size), np.zeros(size), bias, 1.0

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -30, 30))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias_n += g * g
        self.bias -= 0.1 * g / np.sqrt(self.bias_n)


def fit(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) after PASSES passes in orders that a fixed seed gives."""
    positive = sum(y for _, y in rows)
    model = Ftrl(DIMENSIONS, float(np.log((positive + 1) / (len(rows) - positive + 1))))
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i])
    w = model.weights()
    at = np.flatnonzero(w)
    return at, w[at], model.bias


def _featurise(batches):
    for batch in batches:
        found = [np.unique(features(x)).astype(np.int32) for x in arrow_texts(batch)]
        yield pa.record_batch([batch.column("order"), batch.column("id"), pa.array(found, pa.list_(pa.int32())), batch.column("y")], names=["order", "id", "at", "y"])


def _train(batches):
    held = [pd.DataFrame(batch.to_pandas()) for batch in batches if batch.num_rows]
    if held:
        rows = pd.concat(held).sort_values(["order", "id"], kind="stable")
        at, w, bias = fit([(np.asarray(a, np.int64), int(y)) for a, y in zip(rows["at"], rows["y"], strict=True)])
        yield pa.record_batch([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*w.tolist(), bias])], names=["at", "weight"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, fold: int = 2, most: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of at most `most` labelled rows outside the held-out fold; of no rows, one that scores all texts 0.

    Features are made where the texts are read; the bounded sample of coordinates meets in one task. The weights that
    come back are at most DIMENSIONS.
    """
    rows = training_rows(docs, labels, label, folds, fold, most)
    rows = rows.mapInArrow(_featurise, f"order long, id {rows.schema['id'].dataType.simpleString()}, at array<int>, y int")
    found = rows.repartition(1).mapInArrow(_train, "at long, weight double").toPandas().sort_values("at")
    if not len(found):
        return np.empty(0, np.int64), np.empty(0), -30.0
    return found["at"].to_numpy()[1:], found["weight"].to_numpy()[1:], float(found["weight"].iloc[0])


def scorer(spark, model):
    """A function of a text column: the model's probability; features count once a text."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        at, weight, bias = sent.value
        dense = np.zeros(DIMENSIONS)
        dense[at] = weight
        sums = np.empty(len(text))
        for i, x in enumerate(text):
            own = features(x or "")
            own = np.unique(own[dense[own] != 0])
            sums[i] = dense[own].sum() + bias
        return pd.Series(1 / (1 + np.exp(-np.clip(sums, -30, 30))))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, held_out, score, predicted (1 if score >= threshold).

    A null text is scored as an empty one, which has the bias alone. Null and repeated keys are kept; a null key is not
    held out. Without usable labels all scores are nearly 0.
    """
    model = train(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels, folds=folds, fold=fold)
    score = scorer(docs.sparkSession, model)
    out = docs.select(F.col(key), held_out(F.col(key), folds, fold).alias("held_out"), score(F.coalesce(F.col(text), F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score is below `threshold`, with the columns of `docs`."""
    score = scorer(docs.sparkSession, train(docs, labels))
    return docs.filter(score(F.coalesce(F.col("text"), F.lit(""))) < threshold)
