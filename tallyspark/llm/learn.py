"""Bounded training samples and the small models fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, with_value

#: Labelled documents a model is fitted on at most: those whose ids hash lowest.
SAMPLE = 8_000


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, features, fold: tuple[int, int] | None, most: int = SAMPLE) -> tuple[list[bytes], np.ndarray]:
    """Feature bytes and 0/1 labels of at most ``most`` labelled documents.

    ``features`` gives the feature bytes of a list of texts (UTF-8 bytes or None). ``fold`` is (modulus, remainder held out).
    Ids are taken by lowest hash, so the sample is the same in each run; null labels and ids take no
    part; a repeated label row counts once (its greatest label), a repeated document once.
    """
    import pyarrow as pa

    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if fold:
        chosen = chosen.filter(remainder(F.col("doc_id"), fold[0]) != fold[1])
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = documents.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "_id")  # at most ``most`` ids
    got = with_value(rows, "text", "_f", "binary", features).groupBy("_id", "_y").agg(F.min("_f").alias("_f")).orderBy("_id").toArrow()
    features, y = got.column("_f").to_pylist(), np.array(got.column("_y").to_pylist(), np.float64)
    del got
    pa.default_memory_pool().release_unused()  # the driver's memory is scarcer than the time to ask for it again
    return features, y


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    """Adam steps on a list of arrays."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression, by full-batch Adam."""
    w, b = np.zeros(x.shape[1]), np.zeros(1)
    if not len(y):
        return w, 0.0
    adam = Adam([w, b], rate)
    for _ in range(steps):
        g = (sigmoid(x @ w + b[0]) - y) / len(y)
        adam.step([x.T @ g + penalty * w, np.array([g.sum()])])
    return w, float(b[0])
