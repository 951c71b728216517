"""Operator 3: packing pieces of documents into sequences by a configuration linear program.

Pieces are at most ``capacity`` tokens, so everything that the program needs is the histogram of
lengths: at most ``capacity`` numbers whatever the corpus. A configuration is a multiset of lengths
that fits a sequence. Multiplicative weights price lengths by how little they are covered so far; a
knapsack dynamic program over the prices finds the best configurations, among them the best that
holds each badly covered length. The fractional counts are rounded down within what is there, and
what is left is packed best-fit-decreasing on the histogram. Best fit alone is taken where it is better. The plan maps (length, rank among the
pieces of that length) to a sequence and an offset; each task looks its pieces up.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read
from .tokens import default_path, encoder

CAPACITY = 2048
END_ID = 0
#: Chunks in a cache generation: packing follows other stages in the same workers, so it keeps half of what op1 does.
CACHE_ENTRIES = 350_000
#: Most rounds of multiplicative weights, configurations taken from each pricing, the weights' rate, and the share of a demand that a step covers.
ROUNDS, PER_ROUND, RATE, SHARE = 400, 32, 4.0, 0.1


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the highest price of lengths (repeats allowed) that fit c; take[c]: a length to take there, 0 for none."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    order = np.argsort(sizes)
    sizes, prices = sizes[order], prices[order]
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            got = best[c - sizes[:n]] + prices[:n]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], take[c] = got[i], sizes[i]
    return best, take


def fractional(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> dict[tuple, float]:
    """Configurations with fractional counts that cover every length as often as it is there.

    A length's price is what its tokens are worth, less the more of its demand is covered beside the
    least covered one, and nothing once all of it is: so all lengths run out together. Each pricing
    is one dynamic program; the worst covered lengths each take the best configuration that holds
    them, for a share of its scarcest length's demand. Rounds end when all are covered.
    """
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes], float)
    at = {int(s): i for i, s in enumerate(sizes)}
    covered, x = np.zeros(len(sizes)), Counter()
    for _ in range(rounds):
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        if not len(open_):
            break
        price = sizes[open_] * np.exp(-rate * (covered[open_] - covered[open_].min()))
        _, take = knapsack(sizes[open_], price, capacity)
        last = np.maximum.accumulate(np.where(take > 0, np.arange(capacity + 1), 0))
        for s in sizes[open_[np.argsort(covered[open_] * 1e6 - sizes[open_], kind="stable")][:PER_ROUND]].tolist():
            config, room = Counter({s: 1}), capacity - s
            while (room := int(last[room])) > 0:
                config[int(take[room])] += 1
                room -= int(take[room])
            step = min(min(demand[at[k]] * SHARE, demand[at[k]] * (1 - covered[at[k]])) / n for k, n in config.items())
            if step <= 0:
                continue
            x[tuple(sorted(config.items(), reverse=True))] += step
            for k, n in config.items():
                covered[at[k]] += n * step / demand[at[k]]
    return dict(x)


class Groups:
    """Sequences in groups of equal content: a content (lengths in order) and how many sequences have it."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[list]] = {}

    def add(self, content: tuple[tuple[int, int], ...], room: int, count: int) -> None:
        self.by_room.setdefault(room, []).append([content, count])

    def best_fit(self, size: int, count: int) -> None:
        """Put ``count`` pieces of a length, each into the fullest sequence that has room, else a new one."""
        while count:
            room = min((r for r in self.by_room if r >= size and self.by_room[r]), default=None)
            if room is None:
                each = self.capacity // size
                full, rest = divmod(count, each)
                if full:
                    self.add(((size, each),), self.capacity - each * size, full)
                if rest:
                    self.add(((size, rest),), self.capacity - rest * size, 1)
                return
            content, there = self.by_room[room].pop()
            each = room // size
            use = min(there, count // each)
            if use:
                self.add((*content, (size, each)), room - each * size, use)
                count -= use * each
                there -= use
            elif there:
                self.add((*content, (size, count)), room - count * size, 1)
                there, count = there - 1, 0
            if there:
                self.add(content, room, there)
        return


Contents = list[tuple[tuple[tuple[int, int], ...], int]]


def best_fit(left: dict[int, int], groups: Groups) -> Contents:
    """What is left packed best-fit-decreasing into the groups and new sequences; all contents."""
    for s in sorted(left, reverse=True):
        groups.best_fit(s, left[s])
    return [(content, n) for room in sorted(groups.by_room) for content, n in groups.by_room[room] if n]


def rounded(x: dict[tuple, float], histogram: dict[int, int], capacity: int) -> Contents:
    """The program's configurations, the fullest first, in whole numbers as far as the pieces go; then best fit."""
    left, groups = dict(histogram), Groups(capacity)
    for config, n in sorted(x.items(), key=lambda c: (capacity - sum(s * k for s, k in c[0]), -c[1], c[0])):
        if use := int(min(min(left[s] // k for s, k in config), np.floor(n + 1e-6))):
            groups.add(config, capacity - sum(s * k for s, k in config), use)
            for s, k in config:
                left[s] -= k * use
    return best_fit(left, groups)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Contents:
    """Contents ((length, copies), ...) with the number of sequences of each; together they are the histogram.

    The rounded program, or best fit alone where that takes fewer sequences (few pieces round badly).
    """
    left = {int(s): int(n) for s, n in histogram.items() if n > 0}
    whole = [(((capacity, 1),), left.pop(capacity))] if capacity in left else []
    if not left:
        return whole
    plans = [rounded(fractional(left, capacity), left, capacity), best_fit(left, Groups(capacity))]
    return whole + min(plans, key=lambda p: sum(n for _, n in p))


def slots(contents: list) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: (first rank, first sequence, copies, first offset) of each run of ranks, by rank."""
    runs: dict[int, list] = {}
    rank: Counter = Counter()
    sequence = 0
    for content, n in contents:
        offset = 0
        for s, k in content:
            runs.setdefault(s, []).append((rank[s], sequence, k, offset))
            rank[s] += k * n
            offset += s * k
        sequence += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}


def pieces(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, with (part, nth): its rank of its length in its task."""
    tokenizer = tokenizer or default_path()

    def cutting(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part, seen = encoder(tokenizer, CACHE_ENTRIES).encode, TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    data = ids[at : at + 4 * capacity]
                    n = len(data) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(data), part, seen[n]))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        cutting, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    )


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece of ``documents`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and has its end id alone; repeated rows are documents of their own; an empty
    table gives no rows. The pieces are kept once in the shared folder, so their ranks hold even if
    executors are lost. The driver sees only the histogram (at most ``capacity`` rows).
    """
    kept = cut(pieces(documents, tokenizer, capacity, end_id))
    counts = kept.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # a length has one row per task of the scan here
    ranks = counts.select("part", "length", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    where = slots(plan(histogram, capacity))
    sent = kept.sparkSession.sparkContext.broadcast(where)  # a few numbers per run; runs are bounded by lengths and rounds

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found = sent.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    first, base, copies, start = found[int(length[own[0]])]
                    run = np.searchsorted(first, rank[own], side="right") - 1
                    into, nth = np.divmod(rank[own] - first[run], copies[run])
                    sequence[own], offset[own] = base[run] + into, start[run] + nth * length[own]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = kept.join(ranks.select("part", "length", "before"), ["part", "length"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document of ``documents`` packed."""
    return pack(read(spark, sf_dir, "documents"))
