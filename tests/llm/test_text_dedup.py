"""Operator 10 against brute force, and the components routine."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import common
from tallyspark.llm import text_dedup as td
from tallyspark.llm.common import components, look_up


def sets_of(texts, size):
    out = []
    for t in texts:
        w = t.encode().lower().split() if t else []
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def brute(ids, texts, size):
    s, up = sets_of(texts, size), list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                up[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: (len(s[i]), low[root(i)]) for i, d in enumerate(ids)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        if a != b:
            up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(40):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up


def near_texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = rng.choice(vocabulary, rng.integers(3, 120)).tolist()
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 5)):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return texts + ["same passage " * 30] * 40 + ["same passage " * 30 + f"end {i % 7}" for i in range(40)] + ["", None, "one", "one", "ONE", " a\tb ", "a b", "é é", "É É"]


@pytest.mark.parametrize("size,chunk", [(4, td.CHUNK), (5, td.CHUNK), (4, 6)])
def test_near_texts(spark, monkeypatch, size, chunk):
    monkeypatch.setattr(td, "CHUNK", chunk)
    monkeypatch.setattr(td, "CHUNK_SETS", chunk)
    texts = near_texts()
    ids = [int(i) for i in np.random.default_rng(1).permutation(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("set", F.lit(1)).withColumn("a", F.lit("x"))
    want = brute(ids, texts, size)
    got = td.clusters(docs, size).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"]), texts[ids.index(r["doc_id"])]
    kept = td.deduplicated(docs, size)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {low for _, low in want.values()}


def test_a_cluster_beyond_its_leader(spark, monkeypatch):
    """A chain of texts, each near the next only: links far from the leader are found too."""
    monkeypatch.setattr(td, "CHUNK", 4)
    monkeypatch.setattr(td, "CHUNK_SETS", 3)
    words = [f"v{i}" for i in range(300)]
    texts = [" ".join(words[4 * k : 4 * k + 60]) for k in range(40)] + [" ".join(words[:60])] * 9
    ids = [int(i) for i in np.random.default_rng(4).permutation(len(texts))]
    want = brute(ids, texts, 4)
    got = td.clusters(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), 4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(set(want.values())) < 40


def test_texts_of_one_id_are_one_node(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(5, near), (5, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26"), (7, near + " zz"), (9, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 27"), (3, "alone with these words here")]
    got = td.clusters(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 5), (5, 5), (7, 5), (9, 5)]


def test_products_of_large_sets_are_exact():
    a = np.arange(1_000_000, dtype=np.uint64)
    # at 80 % exactly, and one shingle below
    assert td.exact_matrix([a, a[:800_000]], 80)[0, 1] and not td.exact_matrix([a, a[:799_999]], 80)[0, 1]
    assert td.exact_pair(a, a[:800_000], 80) and not td.exact_pair(a, a[:799_999], 80)


@pytest.mark.parametrize("leaves", [5, 3000])
def test_hubs_are_looked_up_apart(spark, leaves):
    star = spark.range(1, leaves + 1).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    tail = spark.createDataFrame([(leaves, leaves + 7), (leaves + 7, leaves + 9), (100_000, 100_001)], "a long, b long")
    got = components(star.unionByName(tail)).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in got} == {0: leaves + 3, 100_000: 2}


def test_settled_stars_take_no_round(spark, monkeypatch):
    """Nor is there a last round that only confirms; and no plan of a round holds its other half."""
    cuts = []
    monkeypatch.setattr(common, "cut", lambda df, cut=common.cut: cuts.append(df._jdf.queryExecution().toString().count("Exchange")) or cut(df))
    stars = [(0, i) for i in range(1, 9)] + [(100, i) for i in range(101, 104)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(9)} | {n: 100 for n in range(100, 104)} and len(cuts) == 1
    cuts.clear()
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*stars, (104, 103), (105, 104)], "a long, b long")).collect()}
    assert got == {n: 0 for n in range(9)} | {n: 100 for n in range(100, 106)} and len(cuts) <= 1 + 2 * 2 and max(cuts) <= 20
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), rounds=0)


def test_names_that_clash(odd):
    assert td.deduplicated(odd.withColumn("gone", F.lit(1)).withColumn("_gone", F.lit(2))).columns[-2:] == ["gone", "_gone"]


def test_odd_documents(odd, none):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in td.clusters(odd, 4).collect()}
    assert got[(6, 2)] == (5, False) and got[(5, 2)] == (5, True) and got[(2, 0)] == (2, True) and got[(None, 1)] == (None, True)
    assert td.clusters(odd, 4).count() == odd.count() and td.clusters(none, 4).count() == 0
    assert td.deduplicated(odd).count() == odd.count() - 1 and td.deduplicated(none).columns == none.columns


def test_posterior_bound():
    assert td.least_matches(175, 80) > td.least_matches(175, 50) > 0
    # pairs at the threshold survive a batch but for a chance far below one in a thousand
    rng = np.random.default_rng(2)
    lost = sum((rng.random(175) < 0.8).sum() < td.least_matches(175, 80) for _ in range(5000))
    assert lost <= 1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    x, y = td.signature(a), td.signature(b)
    assert abs((x == y).mean() - 1500 / 2500) < 0.12 and np.array_equal(td.signature(a[::-1].copy()), x)


def test_hubs_are_spread(spark):
    """Rows of a key above the limit meet no other in the shuffle, and each row gets its key's value."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in held}
    for name, value in held.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(4_000).select(F.when(F.col("id") < 3_000, F.lit(-1)).otherwise(F.col("id") % 100).cast("long").alias("a"), F.col("id").alias("b"))
        table = rows.filter("a != 5").groupBy("a").agg((F.min("a") * 2).alias("twice"), F.count(F.lit(1)).alias("_n"))
        got = look_up(rows, table, ["a"], 50, "b").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(got) == 3_990 and all(r["twice"] == 2 * r["a"] for r in got) and not any(r["a"] == 5 for r in got)
    hub = Counter(r["task"] for r in got if r["a"] == -1)
    assert len(hub) == 16 and max(hub.values()) < 400
