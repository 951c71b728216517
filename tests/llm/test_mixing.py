"""Operator 2: against its SQL, and its contract on odd tables."""

import duckdb
import pytest

from pyspark.sql import functions as F

from tallyspark.llm import mixing

DATA = "/root/testdata/sf0.001"


def duck(path):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}'")
    return sorted(map(repr, c.execute(mixing.OP2_SQL).fetchall()))


def test_equals_sql(spark):
    got = mixing.op2_mixing(spark, DATA)
    assert got.columns == ["doc_id", "size", "source_size", "target", "copies", "taken"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == duck(f"{DATA}/documents.parquet")


def test_odd_documents(spark, odd, none, tmp_path):
    odd.select("doc_id", "text", "source").coalesce(1).write.parquet(str(tmp_path / "documents"))
    got = mixing.copies(odd).collect()
    assert sorted(repr((*r, r["copies"] * r["size"])) for r in got) == duck(f"{tmp_path}/documents/*.parquet")
    assert all(r["copies"] <= 2 for r in got) and len(got) == odd.count()
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.copies(none).count() == 0 and mixing.mix(none).columns == none.columns


def test_targets(spark):
    rows = [("a", 100)] * 10 + [("b", 1)] * 5 + [(None, 50)] * 4 + [("d", 0)]
    t = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    total = 1000 + 5 + 200
    assert sum(r["target"] for r in t.values()) == pytest.approx(1.5 * total)
    assert t["b"]["target"] == 10 and t["d"]["target"] == 0 and all(r["target"] <= 2 * r["source_size"] for r in t.values())


def test_near_target_and_stable(spark):
    rows = [(i, "w " * (1 + i * 7919 % 400), f"s{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted(map(tuple, mixing.copies(d).collect())) for d in (docs, docs.repartition(7)))
    assert first == again
    for s in (0, 1, 2):
        own = [r for r in first if r[0] % 3 == s]
        assert sum(r[4] * r[1] for r in own) == pytest.approx(own[0][3], rel=0.01)


def test_stretches_spread_any_ids(spark, monkeypatch, tmp_path):
    """Ids that are multiples of a power of two, and null ids, are dealt evenly; results stay those of one running sum."""
    monkeypatch.setattr(mixing, "STRETCH_ROWS", 8)
    rows = [(i << 31, f"w{i} x y", "a") for i in range(400)] + [(None, f"n{i} x y", "a") for i in range(400)] + [(7, "", "b"), (8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    dealt = docs.filter("source = 'a'").select(F.shiftright(mixing.spread(F.col("doc_id"), F.col("text"), 0) * 100, 32).alias("s")).groupBy("s").count()
    assert dealt.agg(F.max("count")).first()[0] < 30
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    assert sorted(repr((*r, r["copies"] * r["size"])) for r in mixing.copies(docs).collect()) == duck(f"{tmp_path}/documents/*.parquet")


def test_many_sources_take_the_shuffled_way(spark, odd, monkeypatch):
    want = sorted(map(repr, mixing.copies(odd).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CLASSES", 0)
    assert sorted(map(repr, mixing.copies(odd).collect())) == want
