"""The stages on planted documents, run() against the stages worked out plainly, and the registered queries."""

import math
import sys
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import mixing, quality, queries, tokens, toxicity

from .test_text_dedup import brute

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near duplicates", "mixing", "packing"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, DATA).write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert new.columns == docs.columns
        if name == "quality":
            assert new.count() < docs.count() and new.join(labels.filter("quality = 1"), "doc_id", "left_semi").count() == docs.join(labels.filter("quality = 1"), "doc_id", "left_semi").count()
        if name == "toxicity":
            assert new.join(labels.filter("toxic = 1"), "doc_id", "left_semi").count() <= 2
        if name == "near duplicates":
            assert new.count() == new.select("text").distinct().count()
        now = new
    assert now.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def plain_quality(rows, model):
    """Rows that stay: own evidence, and a path's mean without the row, shrunk to its host's, shrunk to all."""
    own = [float(np.clip(quality.form(r["text"].encode() if r["text"] else None) @ model.weights + model.bias, -12, 12)) for r in rows]
    good = [round(1e6 / (1 + math.exp(-e))) / 1e6 for e in own]
    by_host, by_path = {}, {}
    for r, g in zip(rows, good, strict=True):
        by_host.setdefault(r["source"], []).append(g)
        by_path.setdefault((r["source"], r["lang"]), []).append(g)
    mu = min(max(sum(good) / len(good), 1e-4), 1 - 1e-4)

    def strength(sites):  # (mean, parent's mean, rows)
        scale = sum(w * p * (1 - p) for _, p, w in sites)
        between = max(0.0, (sum(w * (m - p) ** 2 for m, p, w in sites) - sum(p * (1 - p) for _, p, _ in sites)) / scale) if scale else 0.0
        return min(max(1 / between - 1 if between > 0 else 1000.0, 10.0), 1000.0)

    k0 = strength([(sum(g) / len(g), mu, len(g)) for g in by_host.values()])
    host = {h: (sum(g) + k0 * mu) / (len(g) + k0) for h, g in by_host.items()}
    k1 = strength([(sum(g) / len(g), host[h], len(g)) for (h, _), g in by_path.items()])
    kept = []
    for r, e, g in zip(rows, own, good, strict=True):
        mates = by_path[r["source"], r["lang"]]
        mean = min(max((sum(mates) - g + k1 * host[r["source"]]) / (len(mates) - 1 + k1), 1e-4), 1 - 1e-4)
        if e + math.log(mean / (1 - mean)) - math.log(mu / (1 - mu)) >= 0:
            kept.append(r)
    return kept


def plain_run(spark, sf_dir, tmp_path):
    """The pieces that run() must give, as a Counter, by plain loops over rows; models are fitted as the stages fit them."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = plain_quality([r.asDict() for r in docs.collect()], quality.train(docs, labels)) if docs.count() else []
    machine = toxicity.train(spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema), labels, None)
    terms = toxicity.Terms(machine.kept)
    rows = [r for r in rows if machine.score(terms.of(r["text"].encode() if r["text"] else None)) < 0.5]
    named = [r for r in rows if r["doc_id"] is not None]
    # brute takes each id once; rows of a repeated id in these tables have the same text
    once = {r["doc_id"]: r["text"] for r in named}
    low = brute(list(once), list(once.values()), 5)
    rows = [r for r in rows if r["doc_id"] is None or low[r["doc_id"]][1] == r["doc_id"]]
    path = str(tmp_path / "kept.parquet")
    spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema).coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}/*.parquet'")
    taken = Counter()
    for doc_id, size, _, _, n, _ in c.execute(mixing.OP2_SQL).fetchall():
        taken[doc_id, size] += n
    library, out = Tokenizer.from_file(tokens.default_path()), Counter()
    text = {(r["doc_id"], len((r["text"] or "").split())): r["text"] or "" for r in rows}
    assert set(text) >= set(taken)
    for key, n in taken.items():
        ids = [*library.encode(text[key], add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            out[key[0], piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += n
    return +out


def written(tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("table", ["planted", "odd", "empty"])
def test_run_equals_the_stages_worked_out_plainly(spark, odd, none, tmp_path, table):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, 0), (5, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    sf_dir = DATA if table == "planted" else written(tmp_path, (odd if table == "odd" else none).select(*names), labels)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    want = plain_run(spark, sf_dir, tmp_path)
    assert Counter(tuple(r)[:5] for r in got) == want and (table == "empty") == (not got)
    for s in {r["sequence_id"] for r in got}:
        own = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == s)
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048


def test_registration(monkeypatch):
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
    assert set(queries.ORACLES) <= set(queries.QUERIES) and corpus_pipeline.ORACLE_SQL is None
    # the package can be imported without the module at the repository's top
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("tallyspark.llm.queries")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    from tallyspark.llm import queries as again

    assert "pipeline" in again.QUERIES
