"""Operator 10: near-duplicate texts by MinHash with sequential Bayesian verification.

1. Texts with the same set of shingles form a class; classes, not copies, are compared.
2. A class's MinHash signature is cut into bands; classes that share a band meet in a bucket. Rows
   and bands are such that two texts at the threshold meet nowhere with a probability of 1e-6.
3. In a bucket signatures are compared a batch at a time; after each batch a pair is pruned if, by
   the posterior of its similarity (uniform prior), similarity >= threshold has a probability below
   ``PRUNE``. A bucket gives a spanning forest of its survivors, never their pairs; the forests'
   components are clusters of classes that may link.
4. In a cluster every member is first verified exactly against the cluster's leader (its least class),
   which is linear. Those that don't link with it, the rest, are verified against all other members as
   far as the pair survives, and a spanning forest of the links gives the components. Members that
   link with the leader are together already; no two of them need be compared.

Members of a large bucket are dealt into chunks and every two chunks are a group of their own; in a
cluster every chunk of the rest meets every chunk of members. No group grows beyond two chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, components, cut, hub_limit, look_up, read, worker_cache

#: 35 bands of 5: (1 - 0.8 ** 5) ** 35 = 9e-7 is the chance that texts at 0.8 meet in no bucket.
ROWS, BANDS = 5, 35
BATCH = 25
#: A pair is pruned when it is at the threshold with less probability than this.
PRUNE = 1e-6
THRESHOLD = 80
#: Shingles hashed at a time while taking minima: bounds memory for very long texts.
SPAN = 1 << 12
#: Rows of a chunk of a bucket; rows of a chunk of a cluster, and shingles in the sets of one.
CHUNK, CHUNK_SETS, CHUNK_SHINGLES = 512, 128, 1_000_000
#: Candidate ids up to which they are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Words(dict):
    """Words to 64-bit hashes; starts anew at 150,000 words."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= 150_000:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; a shorter text is one shingle, one without words none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(worker_cache("shingles", Words).__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(len(words), size), np.uint64)
    for k in range(min(size, len(words))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


@lru_cache(1)
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray, n: int = ROWS * BANDS) -> np.ndarray:
    """The low 16 bits of ``n`` minima of 32-bit hashes of a set."""
    flip, odd = _seeds(n)
    out = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    for k in range(0, len(low), SPAN):
        h = (low[k : k + SPAN, None] ^ flip) * odd
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(out, h.min(axis=0), out=out)
    return (out & np.uint32(0xFFFF)).astype("<u2")


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of signatures."""
    grid = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), grid.shape[:2]).copy()
    for k in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, k])
    return h.view(np.int64)


def _log_beta(a: float, b: float) -> float:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


@lru_cache(64)
def least_matches(n: int, threshold: int = THRESHOLD, prune: float = PRUNE) -> int:
    """The fewest matches of ``n`` with which similarity >= threshold% still has probability >= ``prune``."""
    s = np.linspace(0, 1, 4001)[1:-1]
    for m in range(n + 1):
        log = m * np.log(s) + (n - m) * np.log1p(-s) - _log_beta(m + 1, n - m + 1)
        if np.exp(log[s >= threshold / 100]).sum() / (len(s) + 1) >= prune:
            return m
    return n


def survivors(x: np.ndarray, y: np.ndarray | None, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, matches) of the pairs of signature rows of x and y (of x and x with i < j if y is None) that survive every batch."""
    other = x if y is None else y
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, 200_000 // max(1, len(other)))
    for k in range(0, len(x), step):
        first = (x[k : k + step, None, :BATCH] == other[None, :, :BATCH]).sum(axis=2, dtype=np.int16)
        alive = first >= least_matches(BATCH, threshold)
        if y is None:
            alive &= np.arange(len(other))[None, :] > np.arange(k, min(len(x), k + step))[:, None]
        i, j = np.nonzero(alive)
        matches = first[i, j].astype(np.int64)
        i = i + k
        for b in range(BATCH, x.shape[1], BATCH):
            if not len(i):
                break
            matches = matches + (x[i, b : b + BATCH] == other[j, b : b + BATCH]).sum(axis=1)
            keep = matches >= least_matches(min(b + BATCH, x.shape[1]), threshold)
            i, j, matches = i[keep], j[keep], matches[keep]
        out.append((i.astype(np.int32), j.astype(np.int32), matches.astype(np.int16)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int32),) * 3


def _halves(chunk: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Positions to compare in a group: within its chunk, or between its two chunks."""
    kinds = np.unique(chunk)
    if len(kinds) == 1:
        return [(np.arange(len(chunk)), None)]
    return [(np.flatnonzero(chunk == kinds[0]), np.flatnonzero(chunk == kinds[1]))]


def bucket_forest(ids: np.ndarray, chunk: np.ndarray, signatures: list[bytes], same: bool, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of a bucket's survivors. ``same``: the group is one chunk with itself."""
    x = np.frombuffer(b"".join(signatures), "<u2").reshape(len(ids), -1)
    forest, out = Forest(len(ids)), []
    for a, b in _halves(chunk) if not same else [(np.arange(len(ids)), None)]:
        if not same and b is None:
            continue  # the other chunk has no row here
        i, j, _ = survivors(x[a], None if b is None else x[b], threshold)
        out += [(int(ids[p]), int(ids[q])) for p, q in forest.joining(a[i], (a if b is None else b)[j])]
    return out


def exact_matrix(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """Whether each two sets link, from products of incidence matrices a few thousand shingles at a time."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    every, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = counts[inverse] > 1  # a shingle of one set alone is in no intersection
    row, column = row[shared], (np.cumsum(counts > 1) - 1)[inverse[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.int64)
    width = 4096
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [k, k + width])
        m = np.zeros((n, width), np.float32)
        m[row[lo:hi], column[lo:hi] - k] = 1
        common += (m @ m.T).astype(np.int64)  # a product is 4096 at most, so exact
    out = np.empty((n, n), bool)
    for k in range(0, n, 256):
        c = common[k : k + 256]
        out[k : k + 256] = 100 * c >= threshold * (sizes[k : k + 256, None] + sizes[None, :] - c)
    return out


def exact_pair(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """100 * intersection >= threshold * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    merged = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((merged[1:] == merged[:-1]).sum())
    return 100 * common >= threshold * (len(merged) - common)


def leader_links(ids: np.ndarray, rows: list[int], lead: list[bool], sets: list[bytes], threshold: int) -> list[tuple[int, int, int]]:
    """(leader, member, the member's row) of the members of a chunk that link with the leader, which is in every chunk of its cluster."""
    at = lead.index(True)
    own = np.frombuffer(sets[at], "<u8")
    return [(int(ids[at]), int(ids[i]), rows[i]) for i in range(len(ids)) if i != at and exact_pair(own, np.frombuffer(sets[i], "<u8"), threshold)]


def rest_forest(ids: np.ndarray, rows: np.ndarray, side: np.ndarray, rest: np.ndarray, signatures: list[bytes], sets: list[bytes], threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the exact links between a chunk of the rest and a chunk of members, likeliest pairs first, unless already joined.

    ``side`` marks the chunk of the rest; ``rest`` marks members that belong to the rest themselves and may stand on
    both sides: of two such the pair with the smaller row first counts.
    """
    a, b = np.flatnonzero(side), np.flatnonzero(~side)
    if not len(a) or not len(b):
        return []
    x = np.frombuffer(b"".join(signatures), "<u2").reshape(len(ids), -1)
    i, j, matches = survivors(x[a], x[b], threshold)
    p, q = a[i], b[j]
    once = ~rest[q] | (rows[p] < rows[q])
    order = np.argsort(-matches[once], kind="stable")
    _, place, node = np.unique(rows, return_index=True, return_inverse=True)
    p, q = node[p[once][order]], node[q[once][order]]
    full, forest = [np.frombuffer(sets[k], "<u8") for k in place], Forest(len(place))
    one = lambda u, v: exact_pair(full[u], full[v], threshold)
    # the likeliest pairs are compared one by one; if many are left apart, all sets at once
    out = list(forest.joining(p[:500], q[:500], check=one))
    if len(p) > 500:
        roots = forest.roots()
        apart = roots[p[500:]] != roots[q[500:]]
        p, q = p[500:][apart], q[500:][apart]
        if len(p) > 500:
            links = exact_matrix(full, threshold)
            out += list(forest.joining(p, q, good=lambda u, v: links[u, v]))
        else:
            out += list(forest.joining(p, q, check=one))
    return [(int(ids[place[u]]), int(ids[place[v]])) for u, v in out]


def _grouped(rows: DataFrame, keys: list[str], values: list[str], work: Callable, names: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Rows of longs (``names``) that ``work(key row, columns of values as lists)`` gives for each group of ``keys``.

    Groups are read as they come from sorted partitions: many small groups cost little. Their rows ascend by
    id, so that the forests of different bands over the same members have the same edges.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: pa.Table | None = None

        def edges(t: pa.Table, whole: bool) -> tuple[list, pa.Table | None]:
            """Edges of the table's complete groups, and the rows of the last one unless ``whole``."""
            ends = np.zeros(max(0, t.num_rows - 1), bool)
            for k in keys:
                c = t.column(k).to_numpy()
                ends |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.flatnonzero(ends) + 1, [t.num_rows]])
            last = len(starts) - 1 if whole else len(starts) - 2
            lists = {k: t.column(k).slice(0, starts[last]).to_pylist() for k in [*keys, *values]}
            out: list[tuple[int, int]] = []
            for lo, hi in zip(starts[:last], starts[1 : last + 1], strict=True):
                if hi - lo > 1:
                    out += work({k: lists[k][lo] for k in keys}, {k: lists[k][lo:hi] for k in values})
            return out, None if whole else t.slice(starts[last])

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: pa.array([e[i] for e in found], pa.int64()) for i, n in enumerate(names)})

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None or not held.num_rows else pa.concat_tables([held, t])
            if held.num_rows:
                found, held = edges(held, False)
                yield batch_of(found)
        if held is not None and held.num_rows:
            yield batch_of(edges(held, True)[0])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "id").select(*keys, *values).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _chunked(rows: DataFrame, key: str, chunks: DataFrame) -> DataFrame:
    """Rows of each key dealt into its ``chunks`` (key, k) chunks, once for each two chunks (x, y) that hold theirs: key, x, y, c, ..."""
    rows = rows.join(chunks, key).withColumn("c", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(F.col("c"), o).alias("x"), F.greatest(F.col("c"), o).alias("y")))
    return rows.withColumn("_p", F.explode(pair)).withColumn("x", F.col("_p.x")).withColumn("y", F.col("_p.y")).drop("_p", "k")


def _by_rows(rows: DataFrame, schema: str, work: Callable, size: int = 256) -> DataFrame:
    """``work`` (lists of the columns to a dict of Arrow arrays) over a few rows at a time.

    All steps of this operator are of this kind: a second kind of Python function would keep a second set of workers.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, size):
                yield pa.RecordBatch.from_pydict(work(*(c.to_pylist() for c in batch.slice(k, size).columns)))

    return rows.mapInArrow(run, schema)


def summaries(rows: DataFrame, size: int) -> DataFrame:
    """id, n, digest, signature of whole texts (id, text): set size, 128-bit digest of the set, MinHash signature (empty set: null)."""

    def work(ids: list, texts: list) -> dict:
        import pyarrow as pa

        sets = [shingle_set(t, size) for t in texts]
        return {
            "id": pa.array(ids, pa.int64()), "n": pa.array(list(map(len, sets)), pa.int64()), "digest": pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
            "signature": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
        }

    return _by_rows(rows.select("id", "text"), "id long, n long, digest binary, signature binary", work)


def _bands(classes: DataFrame) -> DataFrame:
    """(id, key) of each band of each class."""

    def work(ids: list, signatures: list) -> dict:
        import pyarrow as pa

        keys = band_keys(np.frombuffer(b"".join(signatures), "<u2").reshape(len(ids), -1))
        return {"id": pa.array(np.repeat(np.array(ids, np.int64), BANDS)), "key": pa.array(keys.ravel())}

    return _by_rows(classes.select("id", "signature"), "id long, key long", work)


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(id, digest, set) of whole texts: the full set as bytes."""

    def work(ids: list, texts: list) -> dict:
        import pyarrow as pa

        sets = [shingle_set(t, size) for t in texts]
        return {"id": pa.array(ids, pa.int64()), "digest": pa.array(list(map(set_digest, sets)), pa.binary()), "set": pa.array([s.tobytes() for s in sets], pa.binary())}

    return _by_rows(texts.select("id", "text"), "id long, digest binary, set binary", work)


def clusters(documents: DataFrame, size: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingle and link with nothing; equal texts link, whatever their
    length. A null doc_id stays apart. A repeated doc_id is one node with all its texts (a text without
    shingles leaves that row by itself); each of its rows is returned.
    """
    base = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    summed = cut(summaries(base, size))
    usable = summed.filter(F.col("id").isNotNull() & F.col("signature").isNotNull())
    # a class is named by its least document; all of a class's signatures are equal
    classes = cut(usable.groupBy("digest").agg(F.min("id").alias("id"), F.max("signature").alias("signature"), F.count(F.lit(1)).alias("n")).select("id", "digest", "signature", "n"))
    bands = _bands(classes)
    # buckets with two classes or more; of buckets with the same members one
    several = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members")).filter("n > 1")
    chosen = several.groupBy("n", "members").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("k"))
    met = _chunked(bands, "key", chosen).join(classes.select("id", "signature"), "id")
    may = cut(_grouped(met, ["key", "x", "y"], ["id", "c", "signature"], lambda k, v: bucket_forest(np.array(v["id"]), np.array(v["c"]), v["signature"], k["x"] == k["y"], threshold)))
    named = components(may).select(F.col("node").alias("id"), F.col("component").alias("key"))
    # full sets of the classes that may link, from their whole texts
    small = named.count() <= BROADCAST_IDS
    member = classes.join(named, "id").select("id", "key", "signature")
    texts = base.join(F.broadcast(named.select("id")) if small else named.select("id"), "id")
    sets = _sets(texts, size).groupBy("id", "digest").agg(F.max("set").alias("set"))
    # a repeated id has several texts; the class's own is the one with its digest
    whole = cut(member.join(classes.select("id", "digest"), "id").join(sets, ["id", "digest"]).select("id", "key", "digest", "signature", "set"))
    linked = _verified(whole, threshold)
    # components are of classes: copies, of which one class may have a third of all rows, only look theirs up
    names = classes.select("digest", F.col("id").alias("class"), F.col("n").alias("_n"))
    limit = hub_limit(classes.agg(F.sum("n")).first()[0] or 0)
    of = look_up(usable.select("id", "digest"), names, ["digest"], limit, "id").select("id", "class")
    # a repeated id with several texts ties its classes together
    tied = of.groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("_last")).filter(F.col("b") < F.col("_last")).select("id", "b")
    ties = of.join(tied, "id").select(F.col("class").alias("a"), "b").filter("a <> b").distinct()
    reach = components(linked.unionByName(ties))
    named_by = names.join(reach.withColumnRenamed("node", "class"), "class", "left").select("digest", F.coalesce("component", "class").alias("component"), "_n")
    placed = F.col("id").isNotNull() & F.col("digest").isNotNull()
    got = look_up(summed.filter(placed).select("id", "n", "digest"), named_by, ["digest"], limit, "id").select("id", "n", "component")
    # the others have no class
    got = got.unionByName(summed.filter(~placed).select("id", "n", F.col("id").alias("component")))
    return got.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def _verified(whole: DataFrame, threshold: int) -> DataFrame:
    """(a, b): exact links of ``whole`` (id, key, digest, signature, set; ``key`` is the cluster, its least id) that span its components."""
    in_chunks = lambda n, shingles: F.greatest(F.ceil(n / CHUNK_SETS), F.ceil(shingles / CHUNK_SHINGLES)).cast("int")
    deal = lambda many: F.pmod(F.col("row"), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    load = F.sum(F.length("set") / 8)
    # of several texts of the least id one leads
    sizes = whole.groupBy("key").agg(F.count(F.lit(1)).alias("n"), in_chunks(F.count(F.lit(1)), load).alias("k"), F.min(F.when(F.col("id") == F.col("key"), F.col("digest"))).alias("first"))
    members = whole.join(sizes, "key").select("key", "id", F.xxhash64("digest").alias("row"), "signature", "set", "n", "k", (F.col("digest") == F.col("first")).alias("lead"))
    led = members.filter("NOT lead").withColumn("c", deal("k")).unionByName(members.filter("lead").withColumn("c", every("k")))  # the leader goes to each chunk
    work = lambda k, v: leader_links(np.array(v["id"]), v["row"], v["lead"], v["set"], threshold)
    near = cut(_grouped(led.select("key", "c", "id", "row", "lead", "set"), ["key", "c"], ["id", "row", "lead", "set"], work, ("a", "b", "row")))
    # of two members nothing is left to ask
    others = members.filter("n > 2 AND NOT lead").select("key", "id", "row", "signature", "set")
    settled = near.select(F.col("a").alias("key"), "row", F.lit(False).alias("rest")).distinct()
    others = cut(others.join(settled, ["key", "row"], "left").withColumn("rest", F.coalesce("rest", F.lit(True))))
    chunks = others.groupBy("key").agg(
        in_chunks(F.count(F.lit(1)), load).alias("k"), in_chunks(F.count(F.when(F.col("rest"), 1)), F.coalesce(F.sum(F.when(F.col("rest"), F.length("set") / 8)), F.lit(0.0))).alias("kr")
    ).filter("kr > 0")
    dealt = others.join(chunks, "key")
    columns = ["key", "x", "y", "id", "row", "side", "rest", "signature", "set"]
    left = dealt.filter("rest").withColumn("x", deal("kr")).withColumn("y", every("k")).withColumn("side", F.lit(True)).select(*columns)
    right = dealt.withColumn("x", every("kr")).withColumn("y", deal("k")).withColumn("side", F.lit(False)).select(*columns)
    work = lambda k, v: rest_forest(np.array(v["id"]), np.array(v["row"]), np.array(v["side"]), np.array(v["rest"]), v["signature"], v["set"], threshold)
    return cut(near.select("a", "b").unionByName(_grouped(left.unionByName(right), columns[:3], columns[3:], work)))


def deduplicated(documents: DataFrame, size: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """``documents``, whatever their columns' names, with one document of each group: the least id.

    Documents without an id can't be told apart by it and all stay, as do all rows of a repeated id that
    is the least of its group. Null and empty texts are groups of their own.
    """
    gone = clusters(documents, size, threshold).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    own = {c: f"_own_{i}" for i, c in enumerate(documents.columns)}
    rows = documents.toDF(*own.values())
    return rows.join(gone, rows[own["doc_id"]].cast("long") == F.col("gone"), "left_anti").select(*(F.col(n).alias(c) for c, n in own.items()))


def op10_text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: near duplicates of ``documents`` by shingles of four words."""
    return clusters(read(spark, sf_dir, "documents"), 4)
