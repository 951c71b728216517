"""Operator 8: near-duplicate vectors by a subspace pigeonhole join.

Equal vectors of a label form a class; classes with their counts are compared, not copies.

Unit vectors u, v with cosine >= c have |u - v|^2 <= 2 - 2c. A fixed random rotation spreads their
energy; the rotated coordinates are cut into ``PARTS`` blocks, and in at least one block the squared
distance is within that block's proportional share of the budget. So a pair is a candidate if it is
within the share in some block, and each block is a range join of its own: vectors are dealt to
cells of a grid over the block's ``LEAD`` leading coordinates, as wide as twice the radius, and go also
to those of the neighbouring cells within reach that come after their own. A pair meets in one cell
per block; the first block whose share it keeps is the one that counts it, so no pair is counted
twice, and its cosine is verified in double precision on the vectors as they are. Rotated coordinates
are computed step by step, the same in every group, and one comparison of them decides about a block.

A cell's rows are dealt into chunks; pairs of chunks are separate groups, so one crowded cell is
many tasks. A group gives link counts per vector and a spanning forest of its links, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, components, cut, hub_limit, look_up, read

COSINE = 0.93
#: Fewer blocks have wider cells but rows go to fewer of them; on 64 dimensions four look at the fewest pairs.
PARTS = 4
#: Coordinates of a block that its grid is over.
LEAD = 2
#: Rows of a chunk of a cell.
CHUNK = 2_048


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0]


def cuts(dims: int, parts: int = PARTS) -> list[slice]:
    """The blocks of coordinates; fewer than ``parts`` if there are fewer dimensions."""
    edges = np.linspace(0, dims, min(parts, dims) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def radii(dims: int, cosine: float, parts: int = PARTS) -> np.ndarray:
    """Squared radius of each block: its share of the budget by dimensions, and a little for rounding."""
    return np.array([(2 - 2 * cosine) * (c.stop - c.start) / dims + 1e-9 for c in cuts(dims, parts)])


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two so that squares neither overflow nor vanish; cosines stay the same."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True, initial=0))[1])


def unit_rotated(v: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; a row's result doesn't depend on the rows beside it."""
    u, turn = v / np.sqrt((v * v).sum(axis=1, keepdims=True)), rotation(v.shape[1])
    out = np.zeros_like(u)
    for k in range(v.shape[1]):
        out += u[:, k : k + 1] * turn[k]
    return out


def verified_links(left: np.ndarray, right: np.ndarray | None, part: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of left and right, or of left and left with i < j) that ``part`` is the first to hold and whose cosine is enough."""
    dims = left.shape[1]
    blocks, limit = cuts(dims), radii(dims, cosine)
    left = scaled(left)
    a = unit_rotated(left)
    other = left if right is None else scaled(right)
    b = a if right is None else unit_rotated(other)
    held = lambda x, y, p: ((a[x, blocks[p]] - b[y, blocks[p]]) ** 2).sum(axis=1) <= limit[p]
    out_i, out_j = [], []
    step = max(1, (1 << 22) // max(1, len(b)))
    norms_b = (b[:, blocks[part]] ** 2).sum(axis=1)
    for k in range(0, len(a), step):
        own = a[k : k + step, blocks[part]]
        # a first look by products; wider than the share by more than they round
        near = (own**2).sum(axis=1)[:, None] + norms_b[None, :] - 2 * own @ b[:, blocks[part]].T <= limit[part] + 1e-9
        if right is None:
            near &= np.arange(len(b))[None, :] > np.arange(k, k + len(own))[:, None]
        i, j = np.nonzero(near)
        for at in np.array_split(np.arange(len(i)), -(-len(i) // 100_000)) if len(i) else ():
            x, y = i[at] + k, j[at]
            u, v = left[x], other[y]
            cos = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
            good = cos >= cosine
            x, y = x[good], y[good]
            first = held(x, y, part)
            for p in range(part):  # an earlier block has counted it
                first &= ~held(x, y, p)
            out_i.append(x[first])
            out_j.append(y[first])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def vectors_of(raw: pd.Series, dims: int) -> np.ndarray:
    """Rows of bytes as double vectors."""
    return np.stack([np.frombuffer(x, "<f4" if len(x) == 4 * dims else "<f8") for x in raw]).astype(np.float64)


def _summary(ids: np.ndarray, names: np.ndarray, weights: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Weights linked to each (other is its name) and forest edges (other is an id, n 0) of a group."""
    counts = np.bincount(i, weights[j], len(ids)) + np.bincount(j, weights[i], len(ids))
    edges = [(ids[x], ids[y]) for x, y in Forest(len(ids)).joining(i, j)]
    at = np.flatnonzero(counts)
    return pd.DataFrame({
        "id": np.concatenate([ids[at], np.array([e[0] for e in edges], np.int64)]).astype(np.int64),
        "other": np.concatenate([names[at], np.array([e[1] for e in edges], np.int64)]).astype(np.int64),
        "n": np.concatenate([counts[at], np.zeros(len(edges))]).astype(np.int64),
    })


def cells(v: np.ndarray, cosine: float) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, positions, cell coordinates, whether the cell is the row's own) of vectors in the grids of all blocks."""
    r, out = unit_rotated(scaled(v)), []
    for p, (block, limit) in enumerate(zip(cuts(v.shape[1]), radii(v.shape[1], cosine), strict=True)):
        lead = r[:, block][:, :LEAD]
        width = 2 * np.sqrt(limit) + 1e-6
        cell = np.floor(lead / width).astype(np.int64)
        side = np.where(lead / width - cell < 0.5, -1, 1)  # within reach is one neighbour a coordinate
        for move in np.ndindex(*(2,) * lead.shape[1]):
            step = side * np.array(move)
            moved = step != 0
            # the first coordinate that differs decides which cell comes after which
            later = np.take_along_axis(step, moved.argmax(axis=1)[:, None], axis=1)[:, 0] > 0
            at = np.flatnonzero(later) if any(move) else np.arange(len(v))
            out.append((p, at, (cell + step)[at], np.full(len(at), not any(move))))
    return out


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(id, other, n) partial results over ``vectors`` (id long, name long, label, w long, v array<double>).

    With n above 0 they are the weights linked to the vector of that id and name (``other``), with n 0 edges of forests of ids.
    """

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            length = np.array([len(x) for x in batch.column("v")], np.int64)
            for d in np.unique(length):
                own = batch.take(pa.array(np.flatnonzero(length == d)))
                v = own.column("v").flatten().to_numpy().reshape(-1, d)
                with np.errstate(over="ignore"):
                    exact = (v.astype(np.float32) == v).all(axis=1)  # such rows travel in half the bytes, unchanged
                raw = pa.array([x.astype("<f4" if e else "<f8").tobytes() for x, e in zip(v, exact, strict=True)], pa.binary())
                for p, at, cell, home in cells(v, cosine):
                    pick = pa.array(at)
                    both = np.zeros((len(at), LEAD), np.int64)
                    both[:, : cell.shape[1]] = cell
                    yield pa.RecordBatch.from_pydict({
                        "label": own.column("label").take(pick), "d": pa.array(np.full(len(at), d, np.int32)), "part": pa.array(np.full(len(at), p, np.int32)),
                        "cell": pa.FixedSizeListArray.from_arrays(pa.array(both.ravel()), LEAD).cast(pa.list_(pa.int64())), "home": pa.array(home),
                        "id": own.column("id").take(pick), "name": own.column("name").take(pick), "w": own.column("w").take(pick), "v": raw.take(pick),
                    })

    dealt = cut(vectors.select("id", "name", "label", "w", "v").mapInArrow(deal, "label string, d int, part int, cell array<long>, home boolean, id long, name long, w long, v binary"))
    keys = ["label", "d", "part", "cell"]
    # cells with more than one chunk of rows are few; their sizes decide in how many chunks rows are dealt
    sizes = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.filter("_n > 1").withColumn("_k", F.ceil(F.col("_n") / CHUNK).cast("int"))
    rows = look_up(dealt, sizes, keys, hub_limit(dealt.count()), "id").withColumn("_c", F.pmod(F.xxhash64("id", "v"), F.col("_k")).cast("int"))
    # chunk pairs (x, y), x <= y: a row of chunk c goes to each pair that holds c
    pair = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda o: F.struct(F.least(F.col("_c"), o).alias("x"), F.greatest(F.col("_c"), o).alias("y")))
    rows = rows.withColumn("_p", F.explode(pair)).select(*keys, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), F.col("_c").alias("c"), "home", "id", "name", "w", "v")

    def search(f: pd.DataFrame) -> pd.DataFrame:
        d, part, x, y = int(f["d"].iloc[0]), int(f["part"].iloc[0]), int(f["x"].iloc[0]), int(f["y"].iloc[0])
        f = f.sort_values(["id", "name"], kind="stable")
        v, ids, weights, home, c = vectors_of(f["v"], d), f["id"].to_numpy(), f["w"].to_numpy(float), f["home"].to_numpy(), f["c"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def meet(a: np.ndarray, b: np.ndarray | None) -> None:
            if len(a) and (b is None or len(b)):
                i, j = verified_links(v[a], None if b is None else v[b], part, cosine)
                found.append((a[i], (a if b is None else b)[j]))

        if x == y:
            meet(np.flatnonzero(home), None)
            meet(np.flatnonzero(~home), np.flatnonzero(home))
        else:
            for one, other in (((home, x), (home, y)), ((~home, x), (home, y)), ((~home, y), (home, x))):
                meet(np.flatnonzero(one[0] & (c == one[1])), np.flatnonzero(other[0] & (c == other[1])))
        i, j = (np.concatenate([np.zeros(0, np.int64), *side]) for side in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return _summary(ids, f["name"].to_numpy(), weights, i, j)

    # an exchange of its own: else a cell's pairs of chunks would stay where the cell is
    return rows.repartition(*keys, "x", "y").groupBy(*keys, "x", "y").applyInPandas(search, "id long, other long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows are compared within a label; null labels, null or empty vectors, zero vectors and those with
    null or non-finite components link with nothing. A null vec_id links with nothing and is kept. A repeated
    vec_id is one node: its rows share n_links (the other rows linked with any of them, summed) and component.
    Other columns take no part; an empty table gives no rows.
    """
    x = F.col("embedding").cast("array<double>")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    base = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.transform(x, lambda v: v + 0.0).alias("v"), usable.alias("usable"))
    fit = base.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("usable"))
    # 128 bits name a vector of a label
    named = fit.withColumn("key", F.struct(F.xxhash64(F.lit(1), "label", "v").alias("p"), F.xxhash64(F.lit(2), "v", "label").alias("q")))
    rows = cut(named.select("id", "label", "v", "key"))
    classes = cut(rows.groupBy("key", "label").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v")))
    # a repeated id may have several classes, which its name and a part of the key tell apart
    found = cut(links(classes.select(F.col("class").alias("id"), F.col("key.p").alias("name"), "label", "w", "v"), cosine))
    counts = found.filter("n > 0").groupBy(F.col("id").alias("class"), F.col("other").alias("p")).agg(F.sum("n").alias("linked"))
    names = classes.select("key", "class", F.col("key.p").alias("p"), "w").join(counts, ["class", "p"], "left")
    names = names.select("key", "class", (F.col("w") - 1 + F.coalesce("linked", F.lit(0))).alias("linked"), F.col("w").alias("_n"))
    limit = hub_limit(classes.agg(F.sum("w")).first()[0] or 0)
    of = cut(look_up(rows.select("id", "key"), names, ["key"], limit, "id").select("id", "class", "linked"))
    tied = of.groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("_last")).filter(F.col("b") < F.col("_last")).select("id", "b")
    ties = of.join(tied, "id").select(F.col("class").alias("a"), "b").filter("a <> b").distinct()
    reach = components(found.filter("n = 0").select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(ties))
    looked = names.groupBy("class").agg(F.sum("_n").alias("_n")).join(reach.withColumnRenamed("node", "class"), "class", "left")
    each = look_up(of, looked.select("class", F.coalesce("component", "class").alias("component"), "_n"), ["class"], limit, "id")
    per_id = each.groupBy("id").agg(F.sum("linked").alias("n_links"), F.min("component").alias("component"))
    got = base.filter("id IS NOT NULL").select("id").join(per_id, "id", "left").unionByName(base.filter("id IS NULL").select("id"), allowMissingColumns=True)
    return got.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: near-duplicate vectors of ``embeddings``."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id::BIGINT AS vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), fit AS (
  SELECT * FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM e
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
), least_of AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN least_of ON e.vec_id = node LEFT JOIN counted ON counted.a = e.vec_id
"""
