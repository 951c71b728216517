"""Operator 9: document quality by hierarchical empirical Bayes.

A logistic model of a document's form (shares of word shapes, repeated words, repeated lines) gives
each document its own evidence. Sites are two levels deep: a host, and a path below it. Every
document adds its evidence to its host and its path by grouped aggregation; a host's posterior mean
shrinks to the global mean and a path's to its host's, by strengths that the spread of the sites'
means implies (method of moments), so sparse sites stay near their parents. A document's score is
its own log-odds plus the log-odds by which its path (without the document itself) departs from the
global mean. ``documents`` has no address: its host is ``source`` and its path the language section.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, remainder, with_value, worker_cache
from .learn import SAMPLE, labelled_sample, logistic

SHAPES = 512
#: Sites (one row of a few numbers each) up to which their table is broadcast; more are joined by a shuffle.
BROADCAST_SITES = 20_000
#: Evidence is added up in whole millionths: sums are the same in any order.
UNIT = 1_000_000

# Every letter becomes "a" or "A", every digit "0"; other bytes stay. Bytes above ASCII are letters.
_SHAPE = bytes(
    ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256)
)


class Shapes(dict):
    """Class strings of words to buckets: runs of letters and digits count as one; starts anew at 50,000."""

    def __missing__(self, word: bytes) -> int:
        runs = bytearray()
        for b in word:
            if not runs or runs[-1] != b:
                runs.append(b)
        bucket = zlib.crc32(bytes(runs)) % SHAPES
        if len(self) >= 50_000:
            self.clear()
        if len(word) <= 64:
            self[word] = bucket
        return bucket


def form(text: bytes | None) -> np.ndarray:
    """Features of a whole text: square roots of shape shares, shares of words equal to the one before and of repeated lines."""
    out = np.zeros(SHAPES + 2, np.float32)
    words = text.split() if text else []
    if not words:
        return out
    buckets = worker_cache("shapes", Shapes)
    for shape, n in Counter(text.translate(_SHAPE).split()).items():
        out[buckets[shape]] += n
    out[:SHAPES] = np.sqrt(out[:SHAPES] / len(words))
    out[SHAPES] = sum(map(eq, words, words[1:])) / len(words)
    lines = text.split(b"\n")
    out[SHAPES + 1] = 1 - len(set(lines)) / len(lines)
    return out


#: A feature that isn't zero, as samples are sent to the driver: most features of a text are.
FEATURE = np.dtype([("at", "<u2"), ("value", "<f4")])


def _features(texts: list[bytes | None]) -> list[bytes]:
    out = []
    for t in texts:
        x = form(t)
        found = np.zeros(np.count_nonzero(x), FEATURE)
        found["at"] = np.flatnonzero(x)
        found["value"] = x[found["at"]]
        out.append(found.tobytes())
    return out


def _matrix(features: list[bytes]) -> np.ndarray:
    """Features as ``_features`` gives them, a row per text."""
    out = np.zeros((len(features), SHAPES + 2))
    for row, f in zip(out, features, strict=True):
        found = np.frombuffer(f, FEATURE)
        row[found["at"]] = found["value"]
    return out


@dataclass
class Evidence:
    """A fitted model of form."""

    weights: np.ndarray
    bias: float

    def of(self, rows: DataFrame, text: str, name: str = "evidence") -> DataFrame:
        """``rows`` with a text's own log-odds of good quality, within -12 and 12; texts without words have those of no features."""
        weights, bias = self.weights, self.bias
        return with_value(rows, text, name, "double", lambda texts: [float(np.clip(form(t) @ weights + bias, -12, 12)) for t in texts])


def train(documents: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = None, most: int = SAMPLE) -> Evidence:
    """The model fitted on at most ``most`` labelled documents; without labels it holds every document for good."""
    features, y = labelled_sample(documents, labels, "quality", _features, fold, most)
    if not len(y) or y.min() == y.max():
        return Evidence(np.zeros(SHAPES + 2), 4.0 if not len(y) or y[0] else -4.0)
    weights, bias = logistic(_matrix(features), y, penalty=1e-5, steps=1000)
    return Evidence(weights, bias)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(means: DataFrame, mean: str, parent: str, weight: str) -> float:
    """Prior strength by the method of moments: how many documents the parent's mean counts for."""
    # spread of site means beyond what sampling alone gives
    row = means.agg(
        F.sum(F.col(weight) * (F.col(mean) - F.col(parent)) ** 2).alias("spread"), F.sum(F.col(parent) * (1 - F.col(parent))).alias("noise"),
        F.sum(F.col(weight) * F.col(parent) * (1 - F.col(parent))).alias("scale"), F.sum(weight).alias("n"),
    ).first()
    if not row["n"] or not row["scale"]:
        return 1000.0
    between = max(0.0, (row["spread"] - row["noise"]) / row["scale"])
    return float(np.clip(1 / between - 1 if between > 0 else 1000.0, 10.0, 1000.0))


def scored(documents: DataFrame, evidence: Evidence, host: Column, path: Column, keep: tuple[str, ...] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``documents`` (of their columns ``keep``, all if not given) under neutral names with evidence, host_mean, path_mean and score; and the names.

    Null hosts and paths are sites of their own; null and empty texts have the evidence of no features; repeated
    rows are documents of their own; an empty table gives no rows. Texts are looked at once: rows with
    their evidence are kept in the shared folder. Sums over sites are partial aggregations, so a host
    with a third of all rows is no hot task; site tables are broadcast only below a checked count.
    """
    own = {c: f"_own_{i}" for i, c in enumerate(documents.columns)}
    keyed = documents.select(
        *(F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in own.items()),
        F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("null")).alias("host"), F.coalesce(F.concat(F.lit("p"), path.cast("string")), F.lit("null")).alias("path"),
    )
    kept = [own[c] for c in keep or documents.columns]
    base = cut(evidence.of(keyed, own["text"]).select(*kept, "host", "path", "evidence"))
    good = F.round(UNIT / (1 + F.exp(-F.col("evidence")))).cast("long")
    paths = cut(base.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("g")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("g").alias("hg"))
    total = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("hn").alias("n"), F.sum("hg").alias("g")).first()
    mu = float(np.clip(total["g"] / total["n"] / UNIT if total["n"] else 0.5, 1e-4, 1 - 1e-4))
    k0 = _strength(hosts.select((F.col("hg") / F.col("hn") / UNIT).alias("m"), F.lit(mu).alias("p"), F.col("hn").alias("w")), "m", "p", "w")
    host_mean = (F.col("hg") / UNIT + k0 * mu) / (F.col("hn") + k0)
    sites = paths.join(hosts, "host").withColumn("host_mean", host_mean)
    k1 = _strength(sites.select((F.col("g") / F.col("n") / UNIT).alias("m"), F.col("host_mean").alias("p"), F.col("n").alias("w")), "m", "p", "w")
    sites = sites.select("host", "path", "n", "g", "host_mean")
    small = paths.count() <= BROADCAST_SITES
    got = base.join(F.broadcast(sites) if small else sites, ["host", "path"])
    # the document's own evidence is taken out of its path's sum
    path_mean = ((F.col("g") - good) / UNIT + k1 * F.col("host_mean")) / (F.col("n") - 1 + k1)
    got = got.withColumn("path_mean", F.least(F.greatest(path_mean, F.lit(1e-4)), F.lit(1 - 1e-4)))
    odds = F.col("evidence") + _logit(F.col("path_mean")) - float(np.log(mu / (1 - mu)))
    return got.withColumn("score", 1 / (1 + F.exp(-odds))), own


def accept(documents: DataFrame, evidence: Evidence, at: float = 0.5) -> DataFrame:
    """``documents`` whose score is ``at`` or more, in their own columns, whatever their names; host and path are source and lang."""
    got, own = scored(documents, evidence, F.col("source"), F.col("lang"))
    return got.filter(F.col("score") >= at).select(*(F.col(n).alias(c) for c, n in own.items()))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the quality of every document, learnt outside the fifth of ids that is held out. Odd rows as in ``scored``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    got, own = scored(docs, train(docs, read(spark, sf_dir, "labels"), (5, 0)), F.col("source"), F.col("lang"), ("doc_id",))
    doc_id = F.col(own["doc_id"])
    return got.select(
        doc_id.alias("doc_id"), (remainder(doc_id, 5) == 0).alias("held_out"), "evidence", "host_mean", "path_mean", "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"),
    )
