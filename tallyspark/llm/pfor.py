"""Operator 1: token ids in patched frame-of-reference blocks.

File format. A shard is a range of the document order; its files are Parquet containers whose rows
are segments. A segment holds whole consecutive documents:

    magic ``PFR1`` | n_docs u32 | n_tokens u64 | n_blocks u32
    doc_id i64 x n_docs | id validity u8 x n_docs | length u32 x n_docs
    block start (byte offset after this index) u32 x n_blocks
    blocks: minimum u32 | width u8 | n_exceptions u16 | packed (value - minimum) low bits
            | exception positions u16 | exception high parts u32

A block has 1024 ids (the last is padded with the last id). The width is the number of bits that
``percentile`` of the block's residuals fit into; residuals above it keep their low bits in place
and their high part in the exception list. Documents are in ascending id order, nulls first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch_path
from .tokens import default_path, encoder

BLOCK = 1024
#: Ids in a segment before it is closed (a document is never split).
SEGMENT_TOKENS = 1 << 17
END_ID = 2


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits needed for each value; 0 for 0."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values as rows of packed bytes, ``width`` bits each."""
    if not width:
        return np.zeros((len(values), 0), np.uint8)
    size = 16 if width <= 16 else 32
    bits = np.unpackbits(values.astype(f">u{size // 8}").view(np.uint8).reshape(len(values), BLOCK, size // 8), axis=2)
    return np.packbits(bits[:, :, size - width :].reshape(len(values), BLOCK * width), axis=1)


def unpack(rows: np.ndarray, width: int) -> np.ndarray:
    """Inverse of ``pack``: each value is cut from the five bytes at its first bit."""
    if not width:
        return np.zeros((len(rows), BLOCK), np.uint32)
    at = np.arange(BLOCK) * width
    span = 3 if width <= 17 else 5
    wide = np.zeros((len(rows), rows.shape[1] + span), np.uint32 if span == 3 else np.uint64)
    wide[:, : rows.shape[1]] = rows
    got = wide[:, at // 8]
    for k in range(1, span):
        got <<= 8
        got |= wide[:, at // 8 + k]
    got >>= (8 * span - width - at % 8).astype(got.dtype)
    return (got & ((1 << width) - 1)).astype(np.uint32)


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percentile: float = 90.0) -> bytes:
    """Documents' ids (joined in ``ids``) as one segment."""
    n_blocks = -(-len(ids) // BLOCK)
    head = [
        b"PFR1", np.uint32(len(lengths)).tobytes(), np.uint64(len(ids)).tobytes(), np.uint32(n_blocks).tobytes(),
        np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
        np.array([x is not None for x in doc_ids], np.uint8).tobytes(), np.array(lengths, "<u4").tobytes(),
    ]
    if not n_blocks:
        return b"".join(head)
    # ids of small vocabularies move in half the bytes
    grid = np.full(n_blocks * BLOCK, ids[-1], np.uint16 if ids.max() < 1 << 16 else np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(n_blocks, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(percentile / 100 * BLOCK)) - 1)
    widths = _bits(np.partition(rest, rank, axis=1)[:, rank])
    blocks: list[bytes] = [b""] * n_blocks
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        part = rest[at]
        packed = pack(part & part.dtype.type((1 << int(width)) - 1), int(width))
        high = part.astype(np.uint32) >> np.uint32(width)
        odd = np.flatnonzero(high.any(axis=1))
        lists = {int(i): np.flatnonzero(high[i]) for i in odd}
        none = np.zeros(0, np.int64)
        for i, b in enumerate(at):
            where = lists.get(i, none)
            blocks[b] = b"".join((
                low[b].astype("<u4").tobytes(), bytes((int(width),)), len(where).to_bytes(2, "little"),
                packed[i].tobytes(), where.astype("<u2").tobytes(), high[i][where].astype("<u4").tobytes(),
            ))
    starts = np.cumsum([0, *map(len, blocks[:-1])])
    return b"".join([*head, starts.astype("<u4").tobytes(), *blocks])


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The document ids, the lengths and the joined ids of a segment."""
    if data[:4] != b"PFR1":
        raise ValueError("not a segment")
    n, tokens, n_blocks = int.from_bytes(data[4:8], "little"), int.from_bytes(data[8:16], "little"), int.from_bytes(data[16:20], "little")
    at = 20
    raw, at = np.frombuffer(data, "<i8", n, at), at + 8 * n
    valid, at = np.frombuffer(data, np.uint8, n, at), at + n
    lengths, at = np.frombuffer(data, "<u4", n, at), at + 4 * n
    starts, at = np.frombuffer(data, "<u4", n_blocks, at).astype(np.int64), at + 4 * n_blocks
    bytes_ = np.frombuffer(data, np.uint8)
    out = np.empty((n_blocks, BLOCK), np.uint32)
    if n_blocks:
        first = at + starts
        low = bytes_[first[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        widths = bytes_[first + 4].astype(np.int64)
        counts = bytes_[first + 5].astype(np.int64) | bytes_[first + 6].astype(np.int64) << 8
        for width in np.unique(widths):
            which = np.flatnonzero(widths == width)
            size = BLOCK * int(width) // 8
            out[which] = unpack(bytes_[first[which][:, None] + 7 + np.arange(size)], int(width)) if size else 0
        for b in np.flatnonzero(counts):
            k, width = int(counts[b]), int(widths[b])
            p = int(first[b]) + 7 + BLOCK * width // 8
            out[b, np.frombuffer(data, "<u2", k, p)] |= np.frombuffer(data, "<u4", k, p + 2 * k) << np.uint32(width)
        out += low[:, None]
    return [int(x) if v else None for x, v in zip(raw, valid, strict=True)], lengths.astype(np.int64), out.reshape(-1)[:tokens]


def write(documents: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, percentile: float = 90.0) -> None:
    """Encode every text of ``documents`` (doc_id, text) and write segments below ``path``.

    One range shuffle puts the documents in id order; equal and null ids are ordered by a hash of their texts, and
    repeated rows by their place in the table, so that no id, however often repeated, is one task's.
    A null text is empty and still gets the end id; an empty table writes no segment; other columns take no part.
    """
    tokenizer = tokenizer or default_path()

    def segments(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode, shard, number, start = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        names: list[int | None] = []
        lengths: list[int] = []
        parts: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            data = encode_segment(names, lengths, np.frombuffer(b"".join(parts), "<u4"), percentile)
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "segment": pa.array([number], pa.int32()), "shard_start": pa.array([start], pa.int64()), "n_tokens": pa.array([total], pa.int64()), "payload": pa.array([data], pa.binary())}
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                names.append(doc_id)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                total += len(ids) // 4
                if total >= SEGMENT_TOKENS:
                    yield close()
                    number, start, total, names, lengths, parts = number + 1, start + total, 0, [], [], []
        if names:
            yield close()

    (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        .withColumn("_h", F.xxhash64("text"))
        .withColumn("_n", F.monotonically_increasing_id())
        .repartitionByRange("doc_id", "_h", "_n")
        .sortWithinPartitions("doc_id", "_h", "_n")
        .select("doc_id", "text")
        .mapInArrow(segments, "shard int, segment int, shard_start long, n_tokens long, payload binary")
        .write.option("compression", "none")
        .parquet(path)
    )


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, and where it lies (shard, segment).

    The only global step is a running sum over one row per shard.
    """

    def documents(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for shard, segment, start, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                names, lengths, ids = decode_segment(data)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(names, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "local": pa.array(start + ends - lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends, lengths, strict=True)], pa.int64()),
                    "shard": pa.array([shard] * len(names), pa.int32()), "segment": pa.array([segment] * len(names), pa.int32()),
                })

    files = spark.read.schema("shard int, segment int, shard_start long, n_tokens long, payload binary").parquet(path)
    from pyspark.sql import Window

    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    rows = files.select("shard", "segment", "shard_start", "payload").mapInArrow(
        documents, "doc_id long, n_tokens long, local long, ids_crc32 long, shard int, segment int"
    )
    # one row per shard: the number of shards is the number of shuffle partitions, not of documents
    return rows.join(F.broadcast(before), "shard").select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment"
    )


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document of ``documents`` written as blocks, and read from the files again; odd rows as in ``write``."""
    path = scratch_path(spark, "token-ids")
    write(read(spark, sf_dir, "documents"), path)
    return read_back(spark, path)
