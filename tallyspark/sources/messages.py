"""Message channels: scans with their own filters, and their union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import rich_text
from ..functions.text import message_id, normalize_sender
from ..operators.predicates import unwanted_sender

SCHEMA = "id string, body string, address string, date long"


def _wanted(rows: DataFrame, blocked: DataFrame | None) -> DataFrame:
    out = rows.filter(F.col("address").isNotNull() & F.col("body").isNotNull() & ~unwanted_sender(F.col("address")))
    if blocked is None:
        return out
    b = blocked.select(normalize_sender(F.col("address")).alias("_a")).distinct()
    return out.withColumn("_a", normalize_sender(F.col("address"))).join(b, "_a", "left_anti").drop("_a")


def _identified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", message_id(F.col("address"), F.col("date"), F.col("body"))).select("id", "body", "address", "date")


def scan_sms(raw: DataFrame, start_ms: int, end_ms: int, blocked: DataFrame | None = None) -> DataFrame:
    """Text messages (address, body, date) of an inclusive range, without blocked and personal senders."""
    return _identified(_wanted(raw.filter(F.col("date").between(start_ms, end_ms)), blocked))


def scan_mms(raw: DataFrame, parts: DataFrame, senders: DataFrame, start_ms: int, end_ms: int, blocked: DataFrame | None = None) -> DataFrame:
    """Multimedia messages: dates in seconds; text parts in order; the sender's address (kind 137 first), else ``unknown``."""
    m = raw.filter(F.col("date").between(start_ms // 1000, end_ms // 1000)).select("mms_id", (F.col("date") * 1000).alias("date"))
    text = parts.filter(F.col("content_type") == "text/plain").groupBy("mms_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("body")
    )
    order = F.struct(F.when(F.col("kind") == 137, 0).otherwise(1).alias("k"), "row")
    sender = senders.groupBy("mms_id").agg(F.min_by("address", order).alias("address"))
    j = m.join(text, "mms_id").join(sender, "mms_id", "left").withColumn("address", F.coalesce("address", F.lit("unknown")))
    return _identified(_wanted(j.select("address", "body", "date"), blocked))


def scan_rcs(raw: DataFrame, start_ms: int, end_ms: int, blocked: DataFrame | None = None) -> DataFrame:
    """Rich messages: the text within their JSON bodies."""
    rows = raw.filter(F.col("date").between(start_ms, end_ms)).withColumn("body", rich_text(F.col("body")))
    return _identified(_wanted(rows, blocked))


def all_messages(sms: DataFrame, mms: DataFrame, rcs: DataFrame) -> DataFrame:
    """The channels' union: of one id the first channel's message, newest first."""
    both = sms.withColumn("_c", F.lit(0)).unionByName(mms.withColumn("_c", F.lit(1))).unionByName(rcs.withColumn("_c", F.lit(2)))
    one = both.groupBy("id").agg(F.min_by(F.struct("body", "address", "date"), "_c").alias("_m"))
    return one.select("id", F.col("_m.body").alias("body"), F.col("_m.address").alias("address"), F.col("_m.date").alias("date")).orderBy(F.desc("date"), "id")


def joined_parts(parts: DataFrame) -> DataFrame:
    """Multipart messages (message, part, body, address, date) as one each, parts in order."""
    g = parts.groupBy("message").agg(F.sort_array(F.collect_list(F.struct("part", "body"))).alias("_p"), F.min_by("address", "part").alias("address"), F.min("date").alias("date"))
    return g.select(F.col("message").alias("id"), F.array_join(F.transform("_p", lambda p: p["body"]), "").alias("body"), "address", "date")


def failure_samples(failures: DataFrame) -> DataFrame:
    """Failures (sender, type, template, reason, date) collected by fingerprint: count, first and last seen."""
    from ..functions.text import fingerprint

    return failures.withColumn("fingerprint", fingerprint(F.col("sender"), F.col("type"), F.col("template"), F.col("reason"))).groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.min("reason").alias("reason")
    )


def probe_log(log: DataFrame, new: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """A log with new rows (bodies masked) and without those older than a week."""
    from ..functions.text import mask_digits

    return log.unionByName(new.withColumn("body", mask_digits(F.col("body")))).filter(F.col("createdAt") >= now_ms - days * 86_400_000)


def newest_per_channel(rows: DataFrame, most: int) -> DataFrame:
    """The bounded re-scan: the newest rows of each channel."""
    w = Window.partitionBy("channel").orderBy(F.desc("date"), "id")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
