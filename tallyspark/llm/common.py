"""What the training-data operators share: reading, cutting lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch at most: texts and pages are long, and a batch is held whole on either side.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ``BATCH_ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, by whatever file system its path names."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset and the master is local (tests, one
    machine), a new temporary folder is made once and set. A cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext._jsc.sc()
    if not found:
        now = context.getCheckpointDir()
        if not now.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = now.get() if now.isDefined() else tempfile.mkdtemp(prefix="tallyspark-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; it outlives lost executors."""
    shared_dir(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def sliced(column, kind, work, rows: int = 256):
    """``work`` (list to list of values) over an Arrow column, a few rows at a time: long texts are not all held as objects at once."""
    import pyarrow as pa

    parts = [pa.array(work(column.slice(k, rows).to_pylist()), kind) for k in range(0, len(column), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def with_value(rows: DataFrame, source: str, name: str, kind: str, work) -> DataFrame:
    """``rows`` with a column ``name`` (double or binary) that ``work`` (list of bytes to list) gives for the text or binary column ``source``.

    Other columns pass through Arrow untouched. One kind of Python function for all stages of a pipeline
    means one set of workers.
    """
    from pyspark.sql.types import StructType

    at = rows.columns.index(source)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            value = sliced(batch.column(at).cast(pa.binary()), pa.float64() if kind == "double" else pa.binary(), work)
            yield pa.RecordBatch.from_arrays([*batch.columns, value], [*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


_KEPT: dict = {}


def worker_cache(kind: object, make):
    """What ``make`` gave a worker for ``kind``; it stays while tasks ask for the same kind, and goes when they ask for another.

    Workers outlive stages: without this each would keep every stage's caches.
    """
    if kind not in _KEPT:
        _KEPT.clear()
        _KEPT[kind] = make()
    return _KEPT[kind]


def remainder(doc_id, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; -1 where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


#: Keys with more than a 20,000th of all rows are hubs: there are at most 20,000 of them, whatever the table, so they are broadcast.
HUB_SHARE = 20_000
#: Rows of a key that never make it a hub.
HUB_LEAST = 256


def hub_limit(rows: int) -> int:
    """Rows of a key beyond which it is a hub; at most ``rows`` / limit keys are."""
    return max(HUB_LEAST, rows // HUB_SHARE)


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], limit: int, spread: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row per key and in ``_n`` how many of ``rows`` have it; rows of other keys go.

    Hubs (``_n`` above ``limit``, so at most as many as there are rows by limit) are broadcast; in the
    shuffle by which the others meet their key, rows of hubs are spread by the column ``spread``. So no key has more than ``limit`` rows in a task.
    """
    values = [c for c in table.columns if c not in (*keys, "_n")]
    named = lambda t, tag, *more: t.select(*keys, *more, *(F.col(v).alias(tag + v) for v in values), F.lit(tag).alias(tag))
    got = rows.join(F.broadcast(named(table.filter(F.col("_n") > limit), "_hub")), keys, "left")
    got = got.withColumn("_salt", F.when(F.col("_hub").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).otherwise(0))
    # 0 for every count, but no literal: the optimizer takes a literal out of the join's keys, and a hub's rows meet in one task
    salt = F.least("_n", F.lit(0)).cast("long").alias("_salt")
    got = got.join(named(table.filter(F.col("_n") <= limit), "_own", salt), [*keys, "_salt"], "left").filter(F.col("_hub").isNotNull() | F.col("_own").isNotNull())
    return got.select(*rows.columns, *(F.when(F.col("_hub").isNotNull(), F.col("_hub" + v)).otherwise(F.col("_own" + v)).alias(v) for v in values))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges`` (a long, b long).

    Returns (node, component) for each node that has an edge to another; component is the least
    node reachable. Large-star and small-star rounds: every step is a partial aggregation and a join
    in which hubs (the centres of stars) are broadcast, so a star with millions of leaves is no hot task.
    Rounds stop when every edge hangs a node from the root of its star, which is O(log n) rounds; edges that
    are so from the start take none. Each half of a round is a plan of its own: the driver's memory
    grows with the stages that it keeps track of and with their plans.
    """
    now = cut(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )

    def mark(e: DataFrame) -> tuple[int, int]:
        """Edges, and nodes that are not settled: with two smaller neighbours, or with a smaller and a larger one."""
        side = lambda node, up: F.struct(F.col(node).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
        ends = e.select(F.inline(F.array(side("a", 1), side("b", 0))))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        got = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count(F.when(F.col("up") + F.when(F.col("up") > 0, F.col("down")).otherwise(0) > 1, 1))).first()
        return (got[0], got[1])

    for left in range(rounds, -1, -1):
        size, unsettled = mark(now)
        if not unsettled:
            break
        if not left:
            raise RuntimeError("components did not settle")
        limit = hub_limit(size)
        turned = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        # _n counts the larger neighbours, whose rows are joined
        low = now.unionByName(turned).groupBy("a").agg(F.min("b").alias("m"), F.count(F.when(F.col("b") > F.col("a"), 1)).alias("_n"))
        low = low.select("a", F.least("a", "m").alias("m"), "_n")
        large = cut(look_up(turned, low, ["a"], limit, "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
        hung = look_up(large, low, ["a"], limit, "b").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(low.select("a", F.col("m").alias("b")).unionByName(hung).filter(F.col("a") != F.col("b")).distinct())
    # each remaining edge hangs a node, which has no other, from the root of its star
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Forest:
    """Union-find over the positions of a group, for long lists of pairs as arrays."""

    def __init__(self, n: int):
        import numpy as np

        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while (above := int(self.up[i])) != i:
            self.up[i] = self.up[above]
            i = above
        return i

    def roots(self):
        """The root of every position."""
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return self.up
            self.up = above

    def joining(self, p, q, good=None, check=None, block: int = 20_000):
        """The pairs that join two trees, in order, as they are joined.

        ``good`` (arrays to a mask) and ``check`` (a pair to a truth) may refuse pairs; they are asked only for
        pairs whose ends are still apart. Pairs are looked at a block at a time: most are settled by one comparison of roots.
        """
        for k in range(0, len(p), block):
            roots = self.roots()
            x, y = p[k : k + block], q[k : k + block]
            open_ = roots[x] != roots[y]
            x, y = x[open_], y[open_]
            if good is not None and len(x):
                kept = good(x, y)
                x, y = x[kept], y[kept]
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                a, b = self.root(i), self.root(j)
                if a != b and (check is None or check(i, j)):
                    self.up[max(a, b)] = min(a, b)
                    yield i, j
