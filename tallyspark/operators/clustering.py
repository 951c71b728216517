"""Order-dependent clustering of vectors within groups.

The greedy scan compares a row with representatives that came before it, so its order is fixed: rows
are sorted by ``position``. A group is a sender (or an explicit bucket of names) and is clustered whole,
whatever its size: one task holds all its rows, so a very large sender takes that task's time and memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from .aggregates import floor_percentile

S = lx.SIMILARITY


def unit_rows(vectors) -> np.ndarray:
    v = np.array([np.asarray(x, np.float64) for x in vectors])
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def greedy(u: np.ndarray, least: float) -> list[list[int]]:
    """Groups of positions: each unassigned row in turn takes all later unassigned rows that are near it; the largest first."""
    free, out = np.ones(len(u), bool), []
    for i in range(len(u)):
        if free[i]:
            own = np.flatnonzero(free & (np.round(u @ u[i], 6) >= least) & (np.arange(len(u)) > i))
            free[own] = False
            free[i] = False
            out.append([i, *own.tolist()])
    return sorted(out, key=len, reverse=True)


def stable(u: np.ndarray, members: list[int]) -> bool:
    """Whether members are near their first: median and fifth percentile, at the rounded-down place."""
    if len(members) <= 1:
        return True
    s = np.sort(np.round(u[members] @ u[members[0]], 6))
    at = lambda p: s[int(p * (len(s) - 1))]
    return bool(at(0.5) >= S["unstable_median"] and at(0.2) >= S["unstable_p20"])


def seeded(u: np.ndarray, templates: list[str], least: float = S["sms_group"], small: int = 10, most_singles: int = 120) -> list[list[int]]:
    """Groups of a sender: equal templates that hang together are seeds, singles join the nearest seed, the rest is clustered."""
    if len(u) == 1:
        return [[0]]
    buckets: dict[str, list[int]] = {}
    for i, t in enumerate(templates):
        buckets.setdefault(t, []).append(i)
    seeds, singles = [], []
    for own in buckets.values():
        if len(own) < 2:
            singles += own
        elif stable(u, own):
            seeds.append(list(own))
        elif len(own) <= small or len(parts := greedy(u[own], least)) <= 1:
            singles += own
        else:
            seeds += [[own[k] for k in part] for part in parts]
    left, heads = [], u[[g[0] for g in seeds]]
    for i in singles:
        near = np.round(heads @ u[i], 6)
        if len(near) and near.max() >= least:
            seeds[int(np.argmax(near))].append(i)
        else:
            left.append(i)
    if len(left) > most_singles:
        return seeds + [[i] for i in left]
    return seeds + ([[left[k] for k in part] for part in greedy(u[left], least)] if left else [])


def merged(u: np.ndarray, groups: list[list[int]], small: int = 5, least: float = S["small_group_merge"]) -> list[list[int]]:
    """Small groups near the largest become part of it."""
    if len(groups) <= 1:
        return groups
    groups = sorted(groups, key=len, reverse=True)
    head, kept = list(groups[0]), []
    for g in groups[1:]:
        if len(g) <= small and np.round(u[head[0]] @ u[g[0]], 6) >= least:
            head += g
        else:
            kept.append(g)
    return [head, *kept]


def cluster(rows: DataFrame, by: str, mode: str = "greedy", least: float = S["store_group"]) -> DataFrame:
    """(id, group key, bucket, cluster, representative, size) of rows (id, position, vector, template) per value of ``by``.

    ``mode``: greedy (names) or seeded (messages: templates first, small groups merged). Rows with a null key take no
    part; ``bucket`` is 0, as no group is dealt.
    """
    whole = rows.filter(F.col(by).isNotNull()).select(by, "id", "position", "vector", "template")

    def work(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["position", "id"], kind="stable").reset_index(drop=True)
        u = unit_rows(f["vector"])
        groups = greedy(u, least) if mode == "greedy" else merged(u, seeded(u, f["template"].tolist(), least))
        out = [(f[by].iloc[0], 0, f["id"].iloc[i], n, f["id"].iloc[g[0]], len(g)) for n, g in enumerate(groups) for i in g]
        return pd.DataFrame(out, columns=["key", "bucket", "id", "cluster", "representative", "size"])

    return whole.groupBy(by).applyInPandas(work, "key string, bucket int, id long, cluster int, representative long, size int")


def stability(pairs: DataFrame) -> DataFrame:
    """Per group (similarities of members to their representative): size, median, p20, unstable."""
    out = pairs.groupBy("group").agg(F.count(F.lit(1)).alias("size"), floor_percentile("similarity", 0.5).alias("median"), floor_percentile("similarity", 0.2).alias("p20"))
    return out.withColumn("unstable", (F.col("size") > 1) & ((F.col("median") < S["unstable_median"]) | (F.col("p20") < S["unstable_p20"])))


def source_groups(clusters: DataFrame) -> DataFrame:
    """Per sender: groups, messages, the main group's size and its share in percent."""
    per = clusters.groupBy("key", "bucket", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("messages"), F.max("n").alias("main")).withColumn("share", F.floor(F.col("main") * 100 / F.col("messages")).cast("int"))


def group_route(groups: DataFrame) -> DataFrame:
    """What becomes of groups (size, unstable): stable ones get a rule, small unstable ones go one by one, others are split once more."""
    return groups.withColumn("route", F.when(~F.col("unstable"), "RULE").when(F.col("size") <= 10, "DIRECT").otherwise("RESPLIT"))
