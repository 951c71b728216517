"""Totals, groupings and statistics of the ledger. Sums are long; sums of nothing are 0."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.dates import calendar_grid, day_key, month_key
from ..functions.text import normalize_card, trim_space


def total(rows: DataFrame, name: str = "total") -> DataFrame:
    """One row: the sum of amounts."""
    return rows.agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("long").alias(name))


def total_by(rows: DataFrame, **keys: Column) -> DataFrame:
    """Sum of amounts per key."""
    return rows.groupBy(*(c.alias(n) for n, c in keys.items())).agg(F.sum("amount").cast("long").alias("total"))


def daily(rows: DataFrame) -> DataFrame:
    return total_by(rows, date=day_key(F.col("ts")))


def monthly(rows: DataFrame) -> DataFrame:
    return total_by(rows, month=month_key(F.col("ts")))


def of_owned_cards(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """Rows paid with a card that the user owns."""
    return rows.join(owned.filter("isOwned").select("cardName").distinct(), "cardName", "left_semi")


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct().orderBy(column)


def first_ids(rows: DataFrame, keys: tuple[str, ...], id_column: str = "id") -> DataFrame:
    """The least id per key: partially aggregated, so a key with many rows is no hot task."""
    return rows.groupBy(*keys).agg(F.min(id_column).alias(id_column))


def percentage(part: Column, whole: Column) -> Column:
    """A share in percent to one decimal; 0 where the whole isn't positive."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 1)).otherwise(F.lit(0.0))


def category_ratio(rows: DataFrame, monthly_income: int, only: tuple[str, ...] | None = None) -> DataFrame:
    """Per category: total and its shares of income and of all spending (unfiltered)."""
    per = total_by(rows, category=F.col("category"))
    everything = per.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("_all"))
    shown = per if only is None else per.filter(F.col("category").isin(*only))
    return shown.join(F.broadcast(everything)).select(  # one row
        "category", "total", percentage(F.col("total"), F.lit(monthly_income)).alias("income_ratio"), percentage(F.col("total"), F.col("_all")).alias("expense_ratio")
    )


def visible_totals(expenses: DataFrame, incomes: DataFrame) -> DataFrame:
    """One row: spending (transfers count unless they came in) and income (incomes and transfers that came in)."""
    transfer, came_in = F.col("transaction_type") == "TRANSFER", F.col("transfer_direction") == "DEPOSIT"
    out = expenses.agg(
        F.coalesce(F.sum(F.when(~transfer | ~came_in, F.col("amount"))), F.lit(0)).cast("long").alias("expense_total"),
        F.coalesce(F.sum(F.when(transfer & came_in, F.col("amount"))), F.lit(0)).cast("long").alias("_in"),
    )
    return out.join(F.broadcast(total(incomes, "_income"))).select("expense_total", (F.col("_in") + F.col("_income")).alias("income_total"))  # one row each


def visits(rows: DataFrame, key: str) -> DataFrame:
    """Header totals: per key its sum and number of visits."""
    return rows.groupBy(key).agg(F.sum("amount").cast("long").alias("total"), F.count(F.lit(1)).alias("visits"))


def income_headers(incomes: DataFrame) -> DataFrame:
    """Incomes by source, or by type where the source is blank."""
    return incomes.groupBy(F.when(trim_space(F.col("source")) != "", F.col("source")).otherwise(F.col("type")).alias("source_key")).agg(
        F.sum("amount").cast("long").alias("total"), F.count(F.lit(1)).alias("visits")
    )


def day_headers(expenses: DataFrame, incomes: DataFrame) -> DataFrame:
    """Per day spending and income; days of either."""
    e, i = daily(expenses).withColumnRenamed("total", "expense"), daily(incomes).withColumnRenamed("total", "income")
    return e.join(i, "date", "full_outer").select("date", F.coalesce("expense", F.lit(0)).alias("expense"), F.coalesce("income", F.lit(0)).alias("income"))


def weekly(rows: DataFrame, first: date, last: date) -> DataFrame:
    """Per calendar week (Sunday first) of a period: the total of its days in the period."""
    grid = calendar_grid(rows.sparkSession, first, last).filter("in_period")
    per = rows.groupBy(F.to_date("ts").alias("day")).agg(F.sum("amount").cast("long").alias("total"))
    return grid.join(per, "day", "left").groupBy("week").agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"), F.min("day").alias("first_day"))


def calendar(rows: DataFrame, first: date, last: date) -> DataFrame:
    """The calendar's cells with each day's total."""
    per = rows.groupBy(F.to_date("ts").alias("day")).agg(F.sum("amount").cast("long").alias("total"))
    return calendar_grid(rows.sparkSession, first, last).join(per, "day", "left").select("week", "weekday", "day", "in_period", F.coalesce("total", F.lit(0)).alias("total"))


def no_spend_days(rows: DataFrame, first: date, last: date, today: date) -> DataFrame:
    """One row: days of the period up to today without spending."""
    grid = calendar_grid(rows.sparkSession, first, last).filter(F.col("in_period") & (F.col("day") <= F.lit(today.isoformat()).cast("date")))
    spent = rows.filter("amount > 0").select(F.to_date("ts").alias("day")).distinct()
    return grid.join(spent, "day", "left_anti").agg(F.count(F.lit(1)).alias("days"))


def store_ranking(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Shops by spending, the most first."""
    out = rows.groupBy("storeName").agg(F.sum("amount").cast("long").alias("total")).orderBy(F.desc("total"), "storeName")
    return out if most is None else out.limit(most)


def majority(votes: DataFrame, group: str) -> DataFrame:
    """Per group the category with most votes (then the greater similarity, then the name) and its mean similarity."""
    per = votes.groupBy(group, "category").agg(F.count(F.lit(1)).alias("votes"), F.avg("similarity").alias("similarity"))
    order = Window.partitionBy(group).orderBy(F.desc("votes"), F.round("similarity", 9).desc(), "category")
    return per.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def card_counts(rows: DataFrame) -> DataFrame:
    """Uses per card company; blank and other are left out."""
    return rows.groupBy(normalize_card(F.col("cardName")).alias("cardName")).agg(F.count(F.lit(1)).alias("seenCount")).filter((F.col("cardName") != "") & (F.col("cardName") != lx.OTHER))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(trim_space(F.col(column)) != "").groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def floor_percentile(column: str, p: float) -> Column:
    """The value at the rounded-down place among the sorted ones."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def pass_ratio(parsed: Column) -> Column:
    """Share of samples that a rule parses."""
    return F.avg(F.when(parsed, 1.0).otherwise(0.0))


def rule_verdict(ratio: Column) -> Column:
    """accept at 0.8, repair at 0.6, else abort."""
    return F.when(ratio >= 0.8, "accept").when(ratio >= 0.6, "repair").otherwise("abort")


def examples(mappings: DataFrame, most: int = 5) -> DataFrame:
    """Per category up to ``most`` example shops, the user's own first."""
    order = Window.partitionBy("category").orderBy(F.when(F.col("source") == "user", 0).otherwise(1), "storeName")
    return mappings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("category", "rank", "storeName")


def pipeline_statistics(messages: DataFrame) -> DataFrame:
    """One row of counts over classified messages (type, parsed, route)."""
    count = lambda test, name: F.count(F.when(test, 1)).alias(name)
    return messages.agg(
        F.count(F.lit(1)).alias("input"), count(F.col("type") == "PAYMENT", "payments"), count(F.col("type") == "INCOME", "incomes"), count(F.col("type") == "SKIP", "skipped"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
