"""Running totals, averages over months, ranks and interval coverage."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import billing_month, day_spine
from .predicates import within


def cumulative(rows: DataFrame, first: date, days: int) -> DataFrame:
    """(day 0 to days, cumulative): the running total over every day of a period, from a leading 0.

    Rows before or after the period count on its first or last day. One row per day is windowed.
    """
    if days <= 0:
        return rows.sparkSession.createDataFrame([], "day int, cumulative long")
    index = F.least(F.greatest(F.datediff(F.to_date("ts"), F.lit(first.isoformat()).cast("date")), F.lit(0)), F.lit(days - 1))
    per = rows.groupBy((index + 1).alias("day")).agg(F.sum("amount").cast("long").alias("_t"))
    spine = rows.sparkSession.range(days + 1).select(F.col("id").cast("int").alias("day"))
    run = F.sum(F.coalesce("_t", F.lit(0))).over(Window.orderBy("day"))
    return spine.join(per, "day", "left").select("day", run.cast("long").alias("cumulative"))


def average_cumulative(rows: DataFrame, months: int, year: int, month: int, start_day: int, days: int) -> DataFrame:
    """(day, cumulative) averaged over the ``months`` billing months before; no row unless each has spending.

    A shorter month keeps its last value; the quotient is whole. One pass over the rows: each is dealt to its billing month and day.
    """
    spark = rows.sparkSession
    if months <= 0 or days <= 0:
        return spark.createDataFrame([], "day int, cumulative long")
    spans = []
    for k in range(1, months + 1):
        y, m = divmod(year * 12 + month - 1 - k, 12)
        spans.append(billing_month(y, m + 1, start_day))
    own = lambda value: F.coalesce(*(F.when(within("ts", first, last), value(k, first, last)) for k, (first, last) in enumerate(spans)))
    length = lambda first, last: (last.date() - first.date()).days + 1
    index = lambda k, first, last: F.least(F.datediff(F.to_date("ts"), F.lit(first.date().isoformat()).cast("date")), F.lit(length(first, last) - 1)) + 1
    inside = rows.filter(within("ts", spans[-1][0], spans[0][1])).withColumn("_k", own(lambda k, *_: F.lit(k))).filter("_k IS NOT NULL")
    per = inside.groupBy("_k", own(index).alias("day")).agg(F.sum("amount").cast("long").alias("_t"), F.count(F.lit(1)).alias("_n"))  # a row per month and day
    lengths = spark.createDataFrame([(k, length(*s)) for k, s in enumerate(spans)], "_k int, _days int")
    grid = lengths.withColumn("day", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_days"), F.lit(days)))))
    upto = Window.partitionBy("_k").orderBy("day")
    curves = grid.join(per, ["_k", "day"], "left").select("_k", "day", F.sum(F.coalesce("_t", F.lit(0))).over(upto).alias("_c"), F.sum(F.coalesce("_n", F.lit(0))).over(Window.partitionBy("_k")).alias("_n"))
    out = curves.filter(F.col("day") <= days).groupBy("day").agg(F.sum("_c").alias("_s"), F.min("_n").alias("_least"))
    return out.filter("_least > 0").select("day", F.expr(f"_s div {months}").cast("long").alias("cumulative"))


def budget_line(spark, budget: int, days: int) -> DataFrame:
    """(day, cumulative) of a budget spent evenly."""
    return spark.range(max(0, days) + 1 if days > 0 else 0).select(F.col("id").cast("int").alias("day"), F.expr(f"({budget}L * id) div {max(1, days)}").cast("long").alias("cumulative"))


def with_frequency(rows: DataFrame, key: str = "storeName") -> DataFrame:
    """Rows with the number of rows of their shop. Counted by partial aggregation and joined, so no shop is one task's."""
    return rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("frequency")), key)


def top_per(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows per key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)


def repeats(rows: DataFrame, keys: tuple[str, ...], id_column: str = "id") -> DataFrame:
    """All but the least id of each key (null keys are keys)."""
    named = {k: f"_key_{i}" for i, k in enumerate(keys)}
    firsts = rows.groupBy(*(F.col(k).alias(n) for k, n in named.items())).agg(F.min(id_column).alias("_first"))
    match = F.lit(True)
    for k, n in named.items():
        match = match & F.col(k).eqNullSafe(F.col(n))
    return rows.join(firsts, match).filter(F.col(id_column) > F.col("_first")).select(*rows.columns)


def without_repeats(rows: DataFrame, keys: tuple[str, ...], id_column: str = "id") -> DataFrame:
    """The least id of each key."""
    firsts = rows.groupBy(*keys).agg(F.min(id_column).alias("_first")).select(F.col("_first").alias(id_column))
    return rows.join(firsts, id_column, "left_semi")


def coverage(targets: DataFrame, covered: DataFrame) -> DataFrame:
    """Per target (id, start, end): FULL, PARTIAL or NONE by the covered ranges (start, end), all inclusive and whole.

    Ranges that touch (start one after an end) leave no gap; nested ones change nothing. A target that ends before it starts is NONE.
    """
    c = covered.select(F.col("start").alias("_s"), F.col("end").alias("_e")).filter("_s <= _e")
    # buckets as wide as the longest range: each range lies in two at most, and overlapping ones share one
    length = lambda rows, a, b: rows.agg(F.max(F.col(b) - F.col(a))).first()[0] or 0
    width = max(length(targets, "start", "end"), length(c, "_s", "_e"), 0) + 1
    bucket = lambda x: F.expr(f"floor({x} / {width})")
    dealt = lambda rows, a, b: rows.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(a), bucket(b)))))
    t = dealt(targets.filter("start <= `end`").select("id", "start", "end"), "start", "`end`")
    overlap = (F.col("_s") <= F.col("end")) & (F.col("_e") >= F.col("start")) & (F.col("_b") == F.greatest(bucket("_s"), bucket("start")))
    hit = t.join(dealt(c, "_s", "_e"), "_b").filter(overlap)
    w = Window.partitionBy("id").orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    # what must be reached before the next range starts: the furthest end so far, or just before the target
    reach = F.greatest(F.coalesce(F.max("_e").over(w), F.col("start") - 1), F.col("start") - 1)
    gaps = hit.withColumn("_gap", F.when(F.col("_s") > reach + 1, 1).otherwise(0))
    per = gaps.groupBy("id").agg(F.sum("_gap").alias("_gaps"), F.max("_e").alias("_last"))
    full = (F.col("_gaps") == 0) & (F.col("_last") >= F.col("end"))
    return targets.join(per, "id", "left").select("id", F.when(F.col("_gaps").isNull(), "NONE").when(full, "FULL").otherwise("PARTIAL").alias("status"))


def coverage_by_day(targets: DataFrame, covered: DataFrame) -> DataFrame:
    """Coverage of whole days: both ends are taken to their days first (milliseconds, UTC)."""
    days = lambda d: d.withColumn("start", F.expr("start div 86400000")).withColumn("end", F.expr("`end` div 86400000"))
    return coverage(days(targets), days(covered))


def comparison(rows: DataFrame, first: datetime, until: datetime, before_first: datetime, before_until: datetime) -> DataFrame:
    """One row: spending of two stretches and LESS, SAME (within 3%) or MORE."""
    now, before = within("ts", first, until), within("ts", before_first, before_until)
    per = rows.filter(now | before).agg(*(F.coalesce(F.sum(F.when(t, F.col("amount"))), F.lit(0)).cast("long").alias(n) for t, n in ((now, "current"), (before, "previous"))))
    ratio = (F.col("current") - F.col("previous")) / F.col("previous")
    verdict = F.when(F.col("previous") <= 0, "NONE").when(F.abs(ratio) <= 0.03, "SAME").when(ratio < 0, "LESS").otherwise("MORE")
    return per.select("current", "previous", F.when(F.col("previous") > 0, F.round(ratio * 100)).otherwise(0).cast("long").alias("percent"), verdict.alias("verdict"))


def last_messages(chat: DataFrame, most: int, skip: int = 0) -> DataFrame:
    """Per session the last ``most`` messages (after leaving out the last ``skip``), oldest first by ``position``."""
    w = Window.partitionBy("session").orderBy(F.desc("timestamp"), F.desc("id"))
    return chat.withColumn("_n", F.row_number().over(w)).filter(F.col("_n").between(skip + 1, skip + most)).withColumn(
        "position", F.row_number().over(Window.partitionBy("session").orderBy("timestamp", "id"))
    ).drop("_n")


def spine(spark, first: date, last: date) -> DataFrame:
    """Every day from first to last."""
    return day_spine(spark, first, last)
