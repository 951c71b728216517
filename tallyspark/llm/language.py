"""Operator 5: language identification by error-correcting output codes.

Each language has a codeword; each bit splits the languages in two, and a binary classifier over
hashed character n-grams (log-odds of the two halves' n-gram distributions, as in naive Bayes)
predicts it. Decoding adds, over the bits, the logistic loss of the predicted margin against the
codeword's bit, weighted by how far apart the bit's halves are; the least loss wins. Two codewords
with nearly the same loss are flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, remainder, sliced

BUCKETS = 1 << 13
ORDERS = 3
#: Characters handled at a time: bounds memory for very long texts; spans overlap, so that no n-gram is lost or counted twice.
SPAN = 1 << 20
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """Counts of the whole text's hashed 1- to 3-grams; what isn't a letter counts as a space."""
    out = np.zeros(BUCKETS)
    text = text.lower()
    for k in range(0, len(text), SPAN):
        c = np.frombuffer(text[k : k + SPAN + ORDERS - 1].encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        c[(c < 97) | ((c > 122) & (c < 170))] = 32
        g = c
        for n in range(ORDERS):
            if n:
                if len(g) < 2:
                    break
                g = g[:-1] * np.uint64(0x9E3779B1) + c[n:]
            h = (g[:SPAN] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)  # those that begin in this span
            out += np.bincount((h >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)
    return out


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """A row of -1 and 1 per language: all two-part splits for up to 6 languages, else the random code with the best least distance."""
    if n < 2:
        return np.ones((n, 1), np.int64)
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        return np.where(splits[None, :] >> np.arange(n)[:, None] & 1, 1, -1)
    bits, rng, best, far = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice((-1, 1), (n, bits))
        near = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if near > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, near
    return best if best is not None else np.where(np.arange(1, 1 << n)[None, :] >> np.arange(n)[:, None] & 1, 1, -1)


class Decoder:
    """Languages, codewords, per-bucket log-odds of each bit, and bit weights."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        if not langs:
            return
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        self.code = codewords(len(langs))
        odds, weight = [], []
        for bit in self.code.T:
            if (bit > 0).all() or (bit < 0).all():
                odds.append(np.zeros(BUCKETS))
                weight.append(1.0)
                continue
            yes, no = share[bit > 0].mean(axis=0), share[bit < 0].mean(axis=0)
            odds.append(np.log(yes / no))
            weight.append(float(((yes - no) * odds[-1]).sum()))
        self.odds, self.weight = np.array(odds).T, np.array(weight) / max(1e-9, max(weight))

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1) and whether the second is nearly as good."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        f = gram_counts(text)
        margin = f @ self.odds / f.sum() * min(float(f.sum()), 60.0)
        loss = np.logaddexp(0, -self.code * margin[None, :]) @ self.weight
        order = np.argsort(loss, kind="stable")
        near = np.exp(-(loss - loss[order[0]]))
        score = 1 / near.sum()
        return self.langs[order[0]], float(score), bool(len(order) > 1 and near[order[1]] > 0.5)


def train(documents: DataFrame, fold: tuple[int, int] | None = (4, 2)) -> Decoder:
    """Counts n-grams of every training text (non-null text and lang, outside the fold) and builds the decoder.

    Tasks add their texts up, so what moves is one number per task, language and bucket. The driver holds
    the model, ``BUCKETS`` numbers per distinct lang and bit: lang is a label, so its values are few.
    Repeated rows count as often as they are there; texts without a letter and empty tables teach nothing.
    """
    rows = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if fold:
        rows = rows.filter(remainder(F.col("doc_id"), fold[0]) != fold[1])

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    total[lang] = total.get(lang, 0) + gram_counts(text)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(c[at].astype(np.int64))})

    grams = rows.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(count, "lang string, bucket int, n long")
    got = grams.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()  # languages times buckets
    langs = sorted(set(got["lang"]))
    at = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS))
    for lang, b, n in zip(got["lang"], got["bucket"], got["n"], strict=True):
        counts[at[lang], b] = n
    return Decoder(langs, counts)


def predicted(text: Column, decoder: Decoder) -> Column:
    """struct<lang_pred, score, ambiguous> of whole texts; ``und`` with score 0 for null texts and those without a letter."""

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def decode(texts):
        import pyarrow as pa

        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
        return sliced(texts, kind, lambda part: [dict(zip(("lang_pred", "score", "ambiguous"), decoder.decode(t), strict=True)) for t in part])

    return decode(text)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the language of every document, learnt outside the quarter of ids that is held out.

    Every row, repeated ones too, has its own answer; other columns take no part; an empty table gives no rows."""
    docs = read(spark, sf_dir, "documents")
    decoder = train(docs)
    got = docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), predicted(F.col("text").cast("string"), decoder).alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")
