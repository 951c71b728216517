"""Streaming ingestion: the batch transforms on a stream, with deduplication by time and reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import message_id
from ..operators.predicates import classified, prefiltered


def recent_only_once(messages: DataFrame, ttl: str = "5 minutes") -> DataFrame:
    """Messages of which an equal one came within the last minutes are dropped; state is kept for that time only."""
    stamped = messages.withColumn("event_time", F.timestamp_millis("date"))
    return stamped.withWatermark("event_time", ttl).dropDuplicatesWithinWatermark(["id"]).drop("event_time")


def transform(messages: DataFrame) -> DataFrame:
    """What a message goes through before rules: the prefilter and the classification. The same on streams and batches."""
    keyed = messages.withColumn("id", F.coalesce("id", message_id(F.col("address"), F.col("date"), F.col("body"))))
    return classified(prefiltered(keyed)).filter("type <> 'SKIP'")


def ingest(messages: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, ttl: str = "5 minutes"):
    """Start a query that gives each micro-batch of new, classified messages to ``write`` (an upsert by id)."""
    return transform(recent_only_once(messages, ttl)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Lengths of ends by which notifications meet messages on a stream: none, and powers of two.
ENDS = (0, *(1 << k for k in range(31)))
#: Into how many shares the messages of a stretch are dealt.
SHARES = 64


def late_matches(notes: DataFrame, stored: DataFrame, window: str = "2 minutes") -> DataFrame:
    """Notifications joined with messages that arrive up to two minutes around them, whose text holds theirs.

    A notification meets messages by equality of a stretch of time and of its end, as long as the largest power
    of two it has room for; time and text are then compared whole. A message has all its pieces of the lengths that
    notifications of its stretch ask for; on a stream, where these aren't known, of every power of two.
    """
    n = notes.withColumn("note_time", F.timestamp_millis("ts_ms")).withWatermark("note_time", window)
    m = stored.select(F.col("id").alias("message_id"), F.col("body").alias("message_body"), F.timestamp_millis("date").alias("message_time")).withWatermark("message_time", window)
    gap = F.expr(f"message_time BETWEEN note_time - INTERVAL {window} AND note_time + INTERVAL {window}")
    # stretches are twice the window long, so what is around a notification lies in two of them
    stretch = lambda time: F.expr(f"floor(unix_millis({time}) / greatest(1, 2 * unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {window})))")
    size = F.expr("IF(length(body) = 0, 0, shiftleft(1, length(bin(length(body))) - 1))")
    n = n.withColumn("_stretch", F.explode(F.sequence(stretch(f"note_time - INTERVAL {window}"), stretch(f"note_time + INTERVAL {window}")))).withColumn("_size", size)
    m = m.withColumn("_at", stretch("message_time"))
    if notes.isStreaming or stored.isStreaming:
        m = m.withColumn("_sizes", F.lit(list(ENDS)))
    else:
        # a stretch's lengths are given in shares, so that the messages of one stretch are no task's alone
        asked = n.groupBy(F.col("_stretch").alias("_at")).agg(F.collect_set("_size").alias("_sizes"))
        asked = asked.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        m = m.withColumn("_share", F.pmod(F.xxhash64("message_id"), F.lit(SHARES)).cast("int")).join(asked, ["_at", "_share"]).drop("_share")
    room = F.length("message_body")
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.when(k == 0, 1).otherwise(room - k + 1)), lambda i: F.xxhash64(F.substring("message_body", i, k)))
    m = m.withColumn("_piece", F.explode(F.array_distinct(F.flatten(F.transform(F.filter("_sizes", lambda k: k <= room), cut))))).drop("_sizes")
    n = n.withColumn("_end", F.xxhash64(F.substring("body", F.length("body") - F.col("_size") + 1, F.col("_size"))))
    met = (F.col("_stretch") == F.col("_at")) & (F.col("_end") == F.col("_piece"))
    return n.join(m, met & gap & F.col("message_body").contains(F.col("body"))).select("note_id", "message_id", "note_time", "message_time")


def live_totals(expenses: DataFrame) -> DataFrame:
    """Totals per category that a complete-mode stream emits anew after each change."""
    return expenses.groupBy("category").agg(F.sum("amount").alias("total"))
