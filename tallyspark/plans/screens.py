"""Queries of whole screens, composed of operators."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.categories import resolved
from ..functions.dates import billing_month
from ..operators import aggregates as ag
from ..operators.predicates import fixed_filter, visible, within, without_keywords
from ..operators.windows import average_cumulative, budget_line, cumulative, with_frequency


def home(expenses: DataFrame, incomes: DataFrame, year: int, month: int, start_day: int, exclusions: DataFrame | None = None, text: str = "originalSms") -> DataFrame:
    """(part, key, amount) of a billing month: spending, its categories, income; rows whose ``text`` holds an excluded word are left out of both."""
    first, last = billing_month(year, month, start_day)
    rows, got = expenses.filter(within("ts", first, last)), incomes.filter(within("ts", first, last))
    if exclusions is not None:
        rows, got = without_keywords(rows, text, exclusions), without_keywords(got, text, exclusions) if text in got.columns else got
    spent = ag.total(rows, "amount").select(F.lit("spent").alias("part"), F.lit("").alias("key"), "amount")
    per = ag.total_by(rows, key=F.col("category")).select(F.lit("category").alias("part"), "key", F.col("total").alias("amount"))
    income = ag.total(got, "amount").select(F.lit("income").alias("part"), F.lit("").alias("key"), "amount")
    return spent.unionByName(per).unionByName(income)


def home_curves(expenses: DataFrame, year: int, month: int, start_day: int, budget: int, months: int = 3) -> DataFrame:
    """(part, key, amount) of a billing month day by day: spending so far, its mean over the ``months`` before, and the budget spent evenly."""
    first, last = billing_month(year, month, start_day)
    days = (last.date() - first.date()).days + 1
    tag = lambda curve, part: curve.select(F.lit(part).alias("part"), F.format_string("%02d", "day").alias("key"), F.col("cumulative").alias("amount"))
    now = cumulative(expenses.filter(within("ts", first, last)), first.date(), days)
    mean = average_cumulative(expenses, months, year, month, start_day, days)
    return tag(now, "now").unionByName(tag(mean, "mean")).unionByName(tag(budget_line(expenses.sparkSession, budget, days), "budget"))


def home_categories(expenses: DataFrame, year: int, month: int, start_day: int, custom: tuple[str, ...] = (), most: int = 3) -> DataFrame:
    """The categories, resolved to known and custom ones, with most spending in a billing month, and what they had in the one before."""
    before = divmod(year * 12 + month - 2, 12)
    known = expenses.withColumn("category", resolved(F.col("category"), True, custom))
    return top_categories(known, billing_month(year, month, start_day), billing_month(before[0], before[1] + 1, start_day), most)


def category_curve(expenses: DataFrame, names: tuple[str, ...], year: int, month: int, start_day: int = 1) -> DataFrame:
    """The running total of categories over a billing month."""
    first, last = billing_month(year, month, start_day)
    rows = expenses.filter(within("ts", first, last) & F.col("category").isin(*names))
    return cumulative(rows, first.date(), (last.date() - first.date()).days + 1)


def top_categories(expenses: DataFrame, now: tuple[datetime, datetime], before: tuple[datetime, datetime], most: int = 3) -> DataFrame:
    """The categories with most spending, and what they had the month before."""
    from ..operators.joins import with_last_month

    totals = lambda span: ag.total_by(expenses.filter(within("ts", *span)), category=F.col("category"))
    return with_last_month(totals(now).orderBy(F.desc("total"), "category").limit(most), totals(before))


def history(expenses: DataFrame, year: int, month: int, start_day: int, fixed: str = "ALL", exclusions: DataFrame | None = None) -> DataFrame:
    """Per day of a billing month: number and total of the rows that filters leave."""
    rows = expenses.filter(within("ts", *billing_month(year, month, start_day)) & fixed_filter(fixed))
    if exclusions is not None:
        rows = without_keywords(rows, "memo", exclusions)
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("long").alias("total"))


def history_days(
    expenses: DataFrame, incomes: DataFrame, year: int, month: int, start_day: int, shown: dict[str, tuple[str, ...] | None], fixed: str = "ALL", exclusions: DataFrame | None = None, text: str = "originalSms"
) -> DataFrame:
    """Per day of a billing month: rows, spending and income of what is shown. ``shown``: kinds of rows and their categories (None for all)."""
    span = within("ts", *billing_month(year, month, start_day))
    rows = expenses.filter(span & visible(F.col("transaction_type"), F.col("category"), shown) & fixed_filter(fixed))
    if exclusions is not None:
        rows = without_keywords(rows, text, exclusions)
    both = rows.select("ts", F.col("amount").alias("spent"), F.lit(0).cast("long").alias("got"))
    if "INCOME" in shown:
        both = both.unionByName(incomes.filter(span).select("ts", F.lit(0).cast("long").alias("spent"), F.col("amount").alias("got")))
    return both.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("spent").cast("long").alias("expense"), F.sum("got").cast("long").alias("income"))


def day_detail(expenses: DataFrame, incomes: DataFrame, day: date) -> DataFrame:
    """(kind, id, amount) of one day."""
    first = datetime(day.year, day.month, day.day)
    own = within("ts", first, first + timedelta(days=1, milliseconds=-1))
    return expenses.filter(own).select(F.lit("expense").alias("kind"), "id", "amount").unionByName(incomes.filter(own).select(F.lit("income").alias("kind"), "id", "amount"))


def list_orders(expenses: DataFrame, most: int) -> DataFrame:
    """(kind, id) of the first rows in each of the three list orders."""
    rows = with_frequency(expenses)
    orders = {"DATE_DESC": [F.desc("ts"), F.asc("id")], "AMOUNT_DESC": [F.desc("amount"), F.asc("id")], "STORE_FREQ": [F.desc("frequency"), F.desc("ts"), F.asc("id")]}
    out = None
    for kind, order in orders.items():
        one = rows.orderBy(*order).limit(most).select(F.lit(kind).alias("kind"), "id")
        out = one if out is None else out.unionByName(one)
    return out
