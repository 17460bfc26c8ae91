"""Quality by a byte-level convolutional network in numpy.

Input channels are a text's bytes and, per position, whether its four bytes stood up to 24 bytes earlier. Learned
filters slide over chunks of 256 bytes that overlap by half; each filter's response is max-pooled in a chunk, and the
chunks' values, their mean and their maximum over the whole text, are combined into one probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import held_out, training_rows

#: Taps of a filter, filters, bytes between positions, positions in half a chunk, distances at which repeats count.
TAPS, FILTERS, STRIDE, HALF, REPEATS = 6, 16, 2, 64, range(2, 25)
#: Labelled rows that training may use at most; passes; rows a step; Adam's rate.
MOST_ROWS, PASSES, STEP_ROWS, RATE = 4_000, 5, 16, 0.02
THRESHOLD = 0.3
#: One symbol per byte value, and the same 256 again for bytes that repeat.
SYMBOLS = 512


def symbols(text: str) -> np.ndarray:
    """A text's bytes, each 256 higher where its four bytes stood at one of the distances REPEATS before.

    Spaces are appended so that the last filter position ends with the text.
    """
    data = text.encode()
    size = max(len(data), TAPS + STRIDE)
    data = np.frombuffer(data.ljust(size + (TAPS - size) % STRIDE, b" "), np.uint8)
    four = np.lib.stride_tricks.sliding_window_view(data, 4)
    four = np.ascontiguousarray(four).view(np.uint32)[:, 0]
    again = np.zeros(len(four), bool)
    for d in REPEATS:
        if len(four) > d:
            again[d:] |= four[d:] == four[:-d]
    out = data.astype(np.int32)
    out[: len(again)] += np.int32(256) * again
    return out


def pooled(table: np.ndarray, bias: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, FILTERS) maxima of the rectified responses, and the positions at which they stand."""
    n = (len(x) - TAPS) // STRIDE + 1
    y = np.repeat(bias[None], n, 0)
    for j in range(TAPS):
        y += table[j].take(x[j : j + STRIDE * n : STRIDE][:n], 0)
    halves = -(-n // HALF)
    if n < halves * HALF:
        y = np.concatenate([y, np.full((halves * HALF - n, FILTERS), -np.inf, y.dtype)])
    y = y.reshape(halves, HALF, FILTERS)
    at = y.argmax(1)
    top = np.take_along_axis(y, at[:, None], 1)[:, 0]
    at += HALF * np.arange(halves)[:, None]
    if halves > 1:  # a chunk is two halves; neighbours share one
        first = top[:-1] >= top[1:]
        at, top = np.where(first, at[:-1], at[1:]), np.maximum(top[:-1], top[1:])
    return np.maximum(top, 0), at


def probability(model: dict, text: str) -> float:
    top, _ = pooled(model["table"], model["bias"], symbols(text))
    a = top.mean(0) @ model["mean"] + top.max(0) @ model["max"] + model["base"][0]
    return float(1 / (1 + np.exp(-np.clip(a, -30, 30))))


class Adam:
    def __init__(self, model: dict) -> None:
        self.model, self.t = model, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in model.items()} for _ in range(2))

    def step(self, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            rate = RATE * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
            self.model[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def fit(rows: list[tuple[str, int]]) -> dict:
    """A network after PASSES passes of Adam, in orders that a fixed seed gives."""
    random = np.random.default_rng(11)
    draw = lambda *shape: (0.1 * random.standard_normal(shape)).astype(np.float32)
    good = sum(y for _, y in rows)
    model = {"table": draw(TAPS, SYMBOLS, FILTERS), "bias": np.full(FILTERS, 0.1, np.float32), "mean": draw(FILTERS), "max": draw(FILTERS), "base": np.array([np.log((good + 1) / (len(rows) - good + 1))], np.float32)}
    inputs, adam = [(symbols(text), y) for text, y in rows], Adam(model)
    for _ in range(PASSES):
        order = random.permutation(len(inputs))
        for start in range(0, len(order), STEP_ROWS):
            grads = {k: np.zeros_like(x) for k, x in model.items()}
            for i in order[start : start + STEP_ROWS]:
                x, y = inputs[i]
                top, at = pooled(model["table"], model["bias"], x)
                mean, most = top.mean(0), top.max(0)
                a = mean @ model["mean"] + most @ model["max"] + model["base"][0]
                g = np.float32((1 / (1 + np.exp(-np.clip(a, -30, 30))) - y) / STEP_ROWS)
                grads["mean"] += g * mean
                grads["max"] += g * most
                grads["base"] += g
                d = np.repeat((g / len(top) * model["mean"])[None], len(top), 0)
                d[top.argmax(0), np.arange(FILTERS)] += g * model["max"]
                d *= top > 0
                grads["bias"] += d.sum(0)
                f = np.broadcast_to(np.arange(FILTERS), at.shape)
                for j in range(TAPS):
                    np.add.at(grads["table"][j], (x[at * STRIDE + j], f), d)
            adam.step(grads)
    return model


def _train(batches):
    held = [batch.to_pandas() for batch in batches if batch.num_rows]
    if held:
        rows = pd.concat(held).sort_values(["order", "id"], kind="stable")
        model = fit([(x, int(y)) for x, y in zip(rows["text"], rows["y"], strict=True)])
        names = list(model)
        yield pa.record_batch([pa.array(names), pa.array([model[k].astype(np.float32).tobytes() for k in names])], names=["name", "value"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, fold: int = 0, most: int = MOST_ROWS) -> dict | None:
    """The network of at most `most` labelled rows outside the held-out fold; none of no rows. It has a fixed size."""
    rows = training_rows(docs, labels, label, folds, fold, most)
    found = {r["name"]: np.frombuffer(r["value"], np.float32) for r in rows.repartition(1).mapInArrow(_train, "name string, value binary").collect()}
    return {k: x.reshape(TAPS, SYMBOLS, FILTERS) if k == "table" else x for k, x in found.items()} or None


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, held_out, score, predicted (1 if score >= threshold).

    A null text is scored as an empty one. Null and repeated keys are kept; a null key is not held out. Without usable
    labels every score is 0.5.
    """
    model = train(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels, folds=folds, fold=fold)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        net = sent.value
        return pd.Series([probability(net, x or "") if net else 0.5 for x in texts], dtype="float64")

    out = docs.select(F.col(key), held_out(F.col(key), folds, fold).alias("held_out"), score(F.coalesce(F.col(text), F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
