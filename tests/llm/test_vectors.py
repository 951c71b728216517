"""Operators 7 and 8 against brute force."""

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import topk, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"
BAD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] * 16, 1), (905, [1.0] * 16, None), (906, [], 1), (None, [1.0] * 16, 1)]


def brute(x, ids, q, q_ids, k):
    out = []
    for i in range(len(q)):
        s = sorted((-int(sum(int(u) * int(v) for u, v in zip(a, q[i], strict=True))), int(d)) for a, d in zip(x, ids, strict=True) if d != q_ids[i])[:k]
        out += [(i, d, -v) for v, d in s]
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 6), st.sampled_from([1, 3, 50]), st.booleans())
def test_threshold_algorithm(seed, n, dims, high, known):
    rng = np.random.default_rng(seed)
    x, ids = rng.integers(-high, high + 1, (n, dims)).astype(float), np.arange(n) * 3
    q, q_ids = x[: min(5, n)], ids[: min(5, n)]
    want = brute(x, ids, q, q_ids, 7)
    # a kth score that other candidates gave: what is below it isn't asked for
    kth = [None if i == 1 else int(rng.integers(-high, high + 1)) * high for i in range(len(q))] if known else None
    found, reads = topk.threshold_top_k(x, ids, q, q_ids, 7, kth)
    assert sorted(found, key=lambda r: (r[0], -r[2], r[1])) == [r for r in want if kth is None or kth[r[0]] is None or r[2] >= kth[r[0]]]
    assert 0 <= reads <= n * len(q)


def test_threshold_stops_early():
    """Queries with few large components stop long before the lists end; every result is still that of brute force."""
    rng = np.random.default_rng(1)
    x = np.floor(np.abs(rng.standard_cauchy((4000, 8))) * 10)
    q = np.zeros((20, 8))
    q[np.arange(20), np.arange(20) % 8] = rng.integers(5, 60, 20)
    q[np.arange(20), (np.arange(20) + 3) % 8] = -1
    ids, q_ids = np.arange(4000), np.full(20, -1)
    first, every = topk.threshold_top_k(x[:1000], ids[:1000], q, q_ids, 10)
    assert every == 20 * 1000
    kth = [min(s for i, _, s in first if i == j) for j in range(20)]
    found, reads = topk.threshold_top_k(x[1000:], ids[1000:], q, q_ids, 10, kth)
    assert 0 < reads < 0.1 * 20 * 3000
    merged = [r for j in range(20) for r in sorted([r for r in first + found if r[0] == j], key=lambda r: (-r[2], r[1]))[:10]]
    assert merged == brute(x, ids, q, q_ids, 10)


@pytest.mark.parametrize("copies", [1, 2, 5, 40])
def test_repeated_query_ids(copies):
    rng = np.random.default_rng(copies)
    x = rng.integers(-50, 51, (200, 4)).astype(float)
    x[:copies] = 60  # rows of the query's own id, the best of all
    ids = np.sort(np.concatenate([np.zeros(copies, int), np.arange(1, 201 - copies)]))
    q, q_ids = x[[0, 100]], ids[[0, 100]]
    assert topk.threshold_top_k(x, ids, q, q_ids, 20)[0] == brute(x, ids, q, q_ids, 20)


@settings(max_examples=200, deadline=None)
@given(st.integers(-(2**80), 2**80), st.integers(-(2**80), 2**80))
def test_order_keys(a, b):
    assert (topk.order_key(a) < topk.order_key(b)) == (a < b) and topk._from_key(topk.order_key(a)) == a


def test_huge_components_stay_exact(spark):
    big = [[2.0**40, 3.0], [2.0**40, 4.0], [-(2.0**40), 1.0], [1e300, -1.0], [0.5, 0.25]]
    table = spark.createDataFrame([(20 * i, v) for i, v in enumerate(big)], "id long, v array<double>")
    got = {}
    for r in topk.top_k(table, table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    x = [[int(c) * 64 if abs(c) >= 1 else int(c * 64) for c in v] for v in big]
    for i, q in enumerate(x):
        s = sorted((-sum(a * b for a, b in zip(v, q, strict=True)), 20 * j) for j, v in enumerate(x) if j != i)
        assert got[20 * i] == [(d, -v if -(2**63) <= -v < 2**63 else None) for v, d in s]


def test_topk_table(spark, monkeypatch):
    rng = np.random.default_rng(0)
    data = [(i, [float(v) for v in rng.normal(size=16).astype(np.float32)], i % 3) for i in range(150)]
    data += [(200 + i, data[0][1], 0) for i in range(30)] + BAD  # thirty equal vectors: ties by id
    data += [(1000, [1.0, 2.0, 3.0], 0), (1001, [1.0, 2.0, 2.0], 0)]  # of another length
    table = spark.createDataFrame(data, SCHEMA).withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    v = table.select(F.col("vec_id").alias("id"), topk.usable(F.col("embedding")).alias("v"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(v, v.filter("id % 20 = 0")).collect())
    assert [r for r in got if r[0] == 1000] == [(1000, 1, 1001, 64 * 64 * 11)]
    good = [(i, e) for i, e, _ in data[:-2] if i is not None and e and all(c is not None and np.isfinite(c) for c in e)]
    ids, x = np.array([i for i, _ in good]), np.floor(64 * np.array([e for _, e in good], np.float32).astype(float)).astype(int)
    at = np.flatnonzero(ids % 20 == 0)
    want, seen = [], {}
    for i, d, s in brute(x, ids, x[at], ids[at], 20):
        seen[i] = seen.get(i, 0) + 1
        want.append((int(ids[at][i]), seen[i], d, s))
    assert [r for r in got if r[0] != 1000] == sorted(want)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def near_table(spark):
    rng = np.random.default_rng(3)
    data, n = [], 0
    for label in (0, 1):
        for _ in range(25):
            base = rng.normal(size=16)
            for k in range(rng.integers(1, 5)):
                data.append((n, [float(v) for v in (base + 0.12 * k * rng.normal(size=16)).astype(np.float32)], label))
                n += 1
    data += [(500 + i, data[0][1], 0) for i in range(40)] + [(540, data[0][1], 1), (541, [v * 7 for v in data[0][1]], 0)] + BAD
    data += [(600, [v * 1e30 for v in data[3][1]], 0), (601, [v * 1e-30 for v in data[3][1]], 0)]  # squares far from one
    return data, spark.createDataFrame(data, SCHEMA).withColumn("n", F.lit(3)).withColumn("other", F.lit(3))


def pairs_of(data):
    good = [(i, np.array(e, np.float32).astype(float), lab) for i, e, lab in data if i is not None and lab is not None and e and all(c is not None and np.isfinite(c) for c in e) and any(e)]
    return good, [(a, b) for k, (a, u, p) in enumerate(good) for b, v, q in good[k + 1 :] if p == q and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.93]


@pytest.mark.parametrize("chunk", [vector_dedup.CHUNK, 8])
def test_near_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(vector_dedup, "CHUNK", chunk)
    data, table = near_table(spark)
    _, links = pairs_of(data)
    n, up = {}, {i: i for i, _, _ in data if i is not None}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    got = vector_dedup.near_duplicates(table).collect()
    assert len(got) == len(data)
    for r in got:
        if r["vec_id"] is not None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (n.get(r["vec_id"], 0), up[r["vec_id"]], up[r["vec_id"]] == r["vec_id"]), r
    assert vector_dedup.near_duplicates(table.limit(0)).count() == 0


def test_huge_vectors_link(spark):
    rows = [(1, [1e300, 1.0], 1), (2, [3e307, 0.0], 1), (3, [1e-300, 0.0], 1), (4, [0.0, -1e300], 1), (5, [-0.0, -1.0], 1), (5, [0.0, 2.0], 1), (5, [0.0, 2.0], 1), (6, [0.0, 2.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    # 5 is one node with three vectors: one links with 4, each of the others with its copy and with 6
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (5, 4), 6: (2, 4)}


@pytest.mark.parametrize("name", ["op7_topk", "op8_vector_dedup"])
def test_equals_sql(spark, name):
    from tallyspark.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    c.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, c.execute(ORACLES[name]).fetchall()))
