"""Operator 4: toxicity by a factorization machine over hashed terms.

A document's terms are its distinct lower-case words and their first four and five letters, hashed.
The terms that tell the labels apart most (chi-square) are kept; on those a factorization machine

    score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)

learns weights of terms and of pairs of terms, so an insult counts for more beside another insult
or a group's name than alone.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, remainder, with_value, worker_cache
from .learn import SAMPLE, Adam, labelled_sample, sigmoid

WORD = re.compile(r"\w+")
BUCKETS = 1 << 24
#: Terms kept for the model and factors of each.
TERMS, FACTORS = 1024, 8


def word_terms(word: str) -> tuple[int, ...]:
    """The hashed terms of a lower-case word."""
    return (
        zlib.crc32(b"w" + word.encode("utf-8", "replace")) % BUCKETS, zlib.crc32(b"4" + word[:4].encode("utf-8", "replace")) % BUCKETS,
        zlib.crc32(b"5" + word[:5].encode("utf-8", "replace")) % BUCKETS,
    )


class Terms(dict):
    """Words to their terms, those in ``kept`` only if given; starts anew at 100,000 words."""

    def __init__(self, kept: dict[int, int] | None = None):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = word_terms(word)
        if self.kept is not None:
            out = tuple(self.kept[t] for t in out if t in self.kept)
        if len(self) >= 100_000:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out

    def of(self, text: bytes | None) -> set[int]:
        """Distinct terms of a whole text (UTF-8)."""
        return set().union(*map(self.__getitem__, set(WORD.findall(text.decode("utf-8", "replace").lower())))) if text else set()


def _features(texts: list[bytes | None]) -> list[bytes]:
    terms = worker_cache("all terms", Terms)
    return [np.array(sorted(terms.of(t)), "<u4").tobytes() for t in texts]


class Machine:
    """A fitted factorization machine: ``kept`` maps hashed terms to rows of ``w`` and ``v``."""

    def __init__(self, kept: dict[int, int], bias: float, w: np.ndarray, v: np.ndarray):
        self.kept, self.bias, self.w, self.v = kept, bias, w, v
        #: Names the kept terms, so that a worker's cache of one machine never serves another.
        self.name = zlib.crc32(repr(sorted(kept)).encode())

    def score(self, terms: set[int]) -> float:
        at = list(terms)
        s = self.v[at]
        total = s.sum(axis=0)
        return float(sigmoid(np.array(self.bias + self.w[at].sum() + 0.5 * (total @ total - (s * s).sum()))))


def fit(features: list[bytes], labels: np.ndarray, terms: int = TERMS, factors: int = FACTORS, epochs: int = 30, seed: int = 0) -> Machine:
    """A machine fitted on documents' hashed terms; without examples of both labels it gives the base rate."""
    y = labels
    base = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    bias0 = float(np.log(base / (1 - base)))
    if not len(y) or y.min() == y.max():
        return Machine({}, bias0, np.zeros(0), np.zeros((0, factors)))
    # terms of four documents or more, from sorted terms: an inverse of all terms would be several times the sample
    ordered = np.frombuffer(bytearray().join(features), "<u4")
    ordered.sort()
    every = np.unique(ordered[:-3][ordered[:-3] == ordered[3:]])
    all_ = np.searchsorted(ordered, every, "right") - np.searchsorted(ordered, every, "left")
    del ordered
    pos = np.zeros(len(every))
    for f, n in zip(features, y.tolist(), strict=True):
        if n and len(every):
            found = np.frombuffer(f, "<u4")
            at = np.searchsorted(every, found)
            pos[at[(at < len(every)) & (every[np.minimum(at, len(every) - 1)] == found)]] += n
    want = all_ * base
    chi = (pos - want) ** 2 / (want * (1 - base) + 1)
    best = np.argsort(-chi, kind="stable")[:terms]
    best = best[chi[best] > 0]
    every = every[best]
    x = np.zeros((len(features), len(best)), np.float32)
    by = np.argsort(every)
    for row, f in zip(x, features, strict=True):
        if f:
            found = np.frombuffer(f, "<u4")
            at = np.minimum(np.searchsorted(found, every[by]), len(found) - 1)
            row[by[found[at] == every[by]]] = 1
    rng = np.random.default_rng(seed)
    b, w, v = np.array([bias0]), np.zeros(len(best)), rng.normal(0, 0.05, (len(best), factors))
    adam = Adam([b, w, v], 0.02)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 256):
            xs, ys = x[order[k : k + 256]], y[order[k : k + 256]]
            s = xs @ v
            z = b[0] + xs @ w + 0.5 * ((s * s).sum(axis=1) - xs @ (v * v).sum(axis=1))
            g = (sigmoid(z) - ys) / len(ys)
            adam.step([np.array([g.sum()]), xs.T @ g + 1e-4 * w, xs.T @ (g[:, None] * s) - (xs.T @ g)[:, None] * v + 1e-3 * v])
    return Machine({int(t): i for i, t in enumerate(every)}, float(b[0]), w, v)


def train(documents: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = (5, 0), most: int = SAMPLE) -> Machine:
    """A machine fitted on at most ``most`` labelled documents outside the held-out fold."""
    return fit(*labelled_sample(documents, labels, "toxic", _features, fold, most))


def scored(rows: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """``rows`` with the toxicity of whole texts, 0 to 1; null and empty texts have the score of no terms."""

    def work(texts: list[bytes | None]) -> list[float]:
        terms = worker_cache(("terms", machine.name), lambda: Terms(machine.kept))
        return [machine.score(terms.of(t)) for t in texts]

    return with_value(rows, text, name, "double", work)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the toxicity of every document, learnt outside the fifth of ids that is held out."""
    docs = read(spark, sf_dir, "documents")
    machine = train(docs, read(spark, sf_dir, "labels"))
    got = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), machine)
    return got.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(documents: DataFrame, machine: Machine, at: float = 0.5) -> DataFrame:
    """``documents``, whatever their columns' names, without those that score ``at`` or more."""
    own = {c: f"_own_{i}" for i, c in enumerate(documents.columns)}
    got = scored(documents.toDF(*own.values()), machine, own["text"])
    return got.filter(F.col("score") < at).select(*(F.col(n).alias(c) for c, n in own.items()))
