"""The JSON analytics language: requests parsed into dataclasses, compiled to DataFrames.

A request holds queries (18 types) and actions (13 types). Queries give typed tables; actions give new
tables and a count. Clock and settings are parts of the ledger that is asked, never read from outside.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.categories import expansion
from ..functions.dates import day_key, month_key, period, weekday_key
from ..operators import aggregates as ag
from ..operators import mutations as mu
from ..operators.joins import budget_status, by_alias
from ..operators.predicates import EXPENSE_SEARCH, holds, search, within
from ..operators.windows import repeats


@dataclass(frozen=True)
class Filter:
    field: str = ""
    op: str = ""
    value: Any = None
    includeSubcategories: bool = False


@dataclass(frozen=True)
class Metric:
    op: str = ""
    field: str = "amount"


@dataclass(frozen=True)
class Query:
    type: str = ""
    startDate: str | None = None
    endDate: str | None = None
    category: str | None = None
    storeName: str | None = None
    cardName: str | None = None
    searchKeyword: str | None = None
    limit: int | None = None
    filters: tuple[Filter, ...] = ()
    groupBy: str | None = None
    metrics: tuple[Metric, ...] = ()
    topN: int | None = None
    sort: str | None = None


@dataclass(frozen=True)
class Action:
    type: str = ""
    expenseId: int | None = None
    storeName: str | None = None
    newCategory: str | None = None
    searchKeyword: str | None = None
    amount: int | None = None
    date: str | None = None
    cardName: str | None = None
    memo: str | None = None
    newStoreName: str | None = None
    newAmount: int | None = None
    category: str | None = None


@dataclass(frozen=True)
class Request:
    queries: tuple[Query, ...] = ()
    actions: tuple[Action, ...] = ()
    clarification: str | None = None


def _build(kind, data: dict):
    names = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in data.items() if k in names and v is not None})


def parse(text: str) -> Request | None:
    """A request from an answer that holds a JSON object; None if it holds none that can be read."""
    lo, hi = text.find("{"), text.rfind("}")
    if lo < 0 or hi <= lo:
        return None
    try:
        data = json.loads(text[lo : hi + 1])
    except ValueError:
        return None
    queries = tuple(
        _build(Query, {**q, "filters": tuple(_build(Filter, f) for f in q.get("filters") or ()), "metrics": tuple(_build(Metric, m) for m in q.get("metrics") or ())}) for q in data.get("queries") or ()
    )
    return Request(queries, tuple(_build(Action, a) for a in data.get("actions") or ()), data.get("clarification"))


@dataclass(frozen=True)
class Ledger:
    """What requests are asked of."""

    expenses: DataFrame
    incomes: DataFrame | None = None
    budgets: DataFrame | None = None
    exclusions: DataFrame | None = None
    now: datetime = datetime(2000, 1, 1)
    monthly_income: int = 0
    tombstones: DataFrame | None = None
    parents: dict[str, str] = field(default_factory=dict)
    strict_categories: bool = False


# Filters


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _list(value: Any) -> list[str]:
    return [str(v) for v in value] if isinstance(value, (list, tuple)) else [] if value is None else [str(value)]


def _number(value: Any) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return 0.0


def _words(column: Column, op: str, value: Any, any_case_lists: bool) -> Column:
    """Operators of text fields; an operator that isn't one lets every row pass."""
    low = F.lower(column)
    if op == "==":
        return low == _text(value).lower()
    if op == "!=":
        return low != _text(value).lower()
    if op == "contains":
        return low.contains(_text(value).lower())
    if op == "not_contains":
        return ~low.contains(_text(value).lower())
    if op in ("in", "not_in"):
        values = _list(value)
        hit = low.isin([v.lower() for v in values]) if any_case_lists else column.isin(values)
        hit = hit if values else F.lit(False)
        return hit if op == "in" else ~hit
    return F.lit(True)


def compile_filter(f: Filter, parents: dict[str, str] | None = None) -> Column:
    """One filter as a condition; an unknown field lets every row pass."""
    if f.field == "category":
        if f.includeSubcategories and isinstance(f.value, str) and f.op in ("==", "!=", "in", "not_in"):
            hit = F.col("category").isin(*expansion(f.value, parents))
            return hit if f.op in ("==", "in") else ~hit
        return _words(F.col("category"), f.op, f.value, False)
    if f.field in ("storeName", "cardName"):
        return _words(F.col(f.field), f.op, f.value, True)
    if f.field == "amount":
        a, v = F.col("amount").cast("double"), _number(f.value)
        ops = {"==": a == v, "!=": a != v, ">": a > v, ">=": a >= v, "<": a < v, "<=": a <= v}
        return ops.get(f.op, F.lit(True))
    if f.field == "memo" and f.op in ("==", "!=", "contains", "not_contains"):
        return _words(F.coalesce("memo", F.lit("")), f.op, f.value, True)
    if f.field == "dayOfWeek":
        day = weekday_key(F.col("ts"))
        if f.op in ("==", "!="):
            return (day == _text(f.value).upper()) if f.op == "==" else (day != _text(f.value).upper())
        if f.op in ("in", "not_in"):
            hit = day.isin([v.upper() for v in _list(f.value)]) if _list(f.value) else F.lit(False)
            return hit if f.op == "in" else ~hit
    return F.lit(True)


# Analytics

GROUPS = {
    "category": lambda: F.col("category"), "storeName": lambda: F.col("storeName"), "cardName": lambda: F.col("cardName"), "date": lambda: day_key(F.col("ts")),
    "month": lambda: month_key(F.col("ts")), "dayOfWeek": lambda: weekday_key(F.col("ts")),
}


def _metric(op: str) -> Column:
    """A metric of amounts as a whole number; of nothing, and of an unknown kind, 0. Means are cut to whole numbers."""
    a = F.col("amount")
    kinds = {"sum": F.sum(a), "avg": (F.sum(a) / F.count(a)), "count": F.count(F.lit(1)), "max": F.max(a), "min": F.min(a)}
    return F.coalesce(kinds[op].cast("long"), F.lit(0).cast("long")) if op in kinds else F.lit(0).cast("long")


def analytics(rows: DataFrame, q: Query, parents: dict[str, str] | None = None) -> DataFrame:
    """filter, group, measure, sort by the first metric and keep the top: group_key, then one column per metric.

    Ties go to the group with the newest row, then by key. Without groups there is one row, of zeros if nothing is left.
    """
    kept = reduce(lambda d, f: d.filter(compile_filter(f, parents)), q.filters, rows)
    metrics = [m.op for m in q.metrics] or ["sum", "count"]
    names = [m if metrics.index(m) == i else f"{m}_{i}" for i, m in enumerate(metrics)]
    columns = [_metric(m).alias(n) for m, n in zip(metrics, names, strict=True)]
    if not q.groupBy or not q.groupBy.strip() or q.groupBy == "none":
        return kept.agg(*columns).select(F.lit(lx.EVERYTHING).alias("group_key"), *names)
    key = GROUPS[q.groupBy]() if q.groupBy in GROUPS else F.lit(lx.EVERYTHING)
    out = kept.groupBy(key.alias("group_key")).agg(*columns, F.max("ts").alias("_newest"))
    first = F.asc(names[0]) if q.sort == "asc" else F.desc(names[0])
    out = out.orderBy(first, F.desc("_newest"), "group_key")
    return (out if q.topN is None else out.limit(max(0, q.topN))).select("group_key", *names)


# The other query types


def _newest(rows: DataFrame, most: int) -> DataFrame:
    return rows.orderBy(F.desc("ts"), "id").limit(most)


LIST = ("id", "ts", "storeName", "category", "cardName", "amount", "memo")


def run(q: Query, ledger: Ledger) -> DataFrame:
    """The table that a query asks for; an unknown type gives the summary of the fallback."""
    first, last = period(q.startDate, q.endDate, ledger.now)
    within_range = within("ts", first, last)
    e = ledger.expenses
    names = None if q.category is None else expansion(q.category, ledger.parents, ledger.strict_categories)
    kind = q.type.lower()
    if kind == "total_expense":
        rows = e.filter(within_range)
        return ag.total(rows if names is None else rows.filter(F.col("category").isin(*names)))
    if kind == "total_income":
        return ag.total(ledger.incomes.filter(within_range))
    if kind == "expense_by_category":
        out = ag.total_by(e.filter(within_range), category=F.col("category"))
        return out if names is None else out.filter(F.col("category").isin(*names))
    if kind == "expense_list":
        rows = e.filter(within_range) if names is None else e.filter(within_range & F.col("category").isin(*names))
        return _newest(rows, q.limit or 50).select(*LIST)
    if kind == "daily_totals":
        return ag.daily(e.filter(within_range)).orderBy(F.desc("date"))
    if kind == "monthly_totals":
        return ag.monthly(e).orderBy(F.desc("month"))
    if kind == "monthly_income":
        return e.sparkSession.range(1).select(F.lit(ledger.monthly_income).cast("long").alias("monthly_income"))
    if kind == "expense_by_store":
        rows = by_alias(e.filter(within_range), q.storeName or "")
        w = rows.agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("long").alias("total"), F.count(F.lit(1)).alias("n"))
        return _newest(rows, 10).select(*LIST).crossJoin(F.broadcast(w))  # one row
    if kind == "uncategorized_list":
        return _newest(e.filter(F.col("category") == lx.UNCLASSIFIED), q.limit or 20).select(*LIST)
    if kind == "category_ratio":
        return ag.category_ratio(e.filter(within_range), ledger.monthly_income, names)
    if kind == "expense_by_card":
        word = q.cardName or q.storeName or ""
        return _newest(e.filter(within_range & holds(F.col("cardName"), word)), q.limit or 20).select(*LIST)
    if kind == "search_expense":
        return _newest(e.filter(search(q.searchKeyword or q.storeName or "", EXPENSE_SEARCH)), q.limit or 30).select(*LIST)
    if kind == "card_list":
        return ag.distinct_values(e, "cardName")
    if kind == "income_list":
        rows = _newest(ledger.incomes.filter(within_range), q.limit or 20)
        return rows.select("id", "ts", "type", "source", "amount").crossJoin(F.broadcast(ag.total(rows)))  # one row: of those listed
    if kind == "duplicate_list":
        rows = repeats(e, mu.DUPLICATE_KEYS)
        n = rows.agg(F.count(F.lit(1)).alias("n"))
        return _newest(rows, 20).select(*LIST).crossJoin(F.broadcast(n))  # one row
    if kind == "sms_exclusion_list":
        return ledger.exclusions.select("keyword", "source").orderBy("source", "keyword")
    if kind == "analytics":
        return analytics(e.filter(within_range), q, ledger.parents)
    if kind == "budget_status":
        return budget_status(e, ledger.budgets, first, last)
    return fallback(ledger, first, last)


def fallback(ledger: Ledger, first: datetime, last: datetime) -> DataFrame:
    """(part, key, amount): the total, each category's total and the ten newest rows of a range."""
    rows = ledger.expenses.filter(within("ts", first, last))
    total = ag.total(rows, "amount").select(F.lit("total").alias("part"), F.lit("").alias("key"), "amount")
    per = ag.total_by(rows, key=F.col("category")).select(F.lit("category").alias("part"), "key", F.col("total").alias("amount"))
    recent = _newest(rows, 10).select(F.lit("recent").alias("part"), F.col("id").cast("string").alias("key"), "amount")
    return total.unionByName(per).unionByName(recent)


def apply(a: Action, ledger: Ledger) -> tuple[str, DataFrame, DataFrame]:
    """(name of the changed table, its new state, one row with the count); what an action lacks makes it change nothing."""
    e, kind = ledger.expenses, a.type.lower()
    nothing = ("expenses", e, e.filter(F.lit(False)).agg(F.count(F.lit(1)).alias("affected")))
    i = a.expenseId
    if kind == "update_category" and i is not None and a.newCategory:
        return "expenses", *mu.set_category(e, i, a.newCategory)
    if kind == "update_category_by_store" and a.storeName and a.newCategory:
        return "expenses", *mu.set_category_by_store(e, a.storeName, a.newCategory)
    if kind == "update_category_by_keyword" and a.searchKeyword and a.newCategory:
        return "expenses", *mu.set_category_by_keyword(e, a.searchKeyword, a.newCategory)
    if kind == "delete_expense" and i is not None:
        return "expenses", *mu.delete(e, F.col("id") == i)  # ``after`` writes its tombstone
    if kind == "delete_by_keyword" and a.searchKeyword:
        return "expenses", *mu.delete_by_keyword(e, a.searchKeyword)
    if kind == "delete_duplicates":
        return "expenses", *mu.delete_duplicates(e)
    if kind == "add_expense" and a.storeName and a.amount:
        top = e.agg(F.max("id")).first()[0] or 0
        return "expenses", *mu.add_expense(e, top + 1, a.storeName, a.amount, f"{a.date or ledger.now:%Y-%m-%d}" if not a.date else a.date, a.cardName or "수동입력", a.category or lx.UNCLASSIFIED, a.memo)
    if kind == "update_memo" and i is not None:
        return "expenses", *mu.set_memo(e, i, a.memo)
    if kind == "update_store_name" and i is not None and a.newStoreName:
        return "expenses", *mu.set_store(e, i, a.newStoreName)
    if kind == "update_amount" and i is not None and a.newAmount:
        return "expenses", *mu.set_amount(e, i, a.newAmount)
    if kind == "add_sms_exclusion" and a.searchKeyword:
        return "exclusions", *mu.add_exclusion(ledger.exclusions, a.searchKeyword)
    if kind == "remove_sms_exclusion" and a.searchKeyword:
        return "exclusions", *mu.remove_exclusion(ledger.exclusions, a.searchKeyword)
    if kind == "set_budget" and a.category and a.amount:
        return "budgets", *mu.set_budget(ledger.budgets, a.category, a.amount)
    return nothing


def after(a: Action, ledger: Ledger) -> tuple[Ledger, DataFrame]:
    """The ledger that an action leaves, and one row with the count. A deleted row leaves a tombstone, so that reading its message again doesn't bring it back."""
    name, new, count = apply(a, ledger)
    changed = {name: new}
    if a.type.lower() == "delete_expense" and a.expenseId is not None:
        start = ledger.tombstones if ledger.tombstones is not None else ledger.expenses.select("smsId").limit(0)
        changed["expenses"], changed["tombstones"], count = mu.delete_expense(ledger.expenses, start, a.expenseId)
    return replace(ledger, **changed), count


def answer(text: str, ledger: Ledger) -> list[DataFrame]:
    """What a request gives: the tables of its queries, then the count of each action; the fallback where it can't be read or asks nothing."""
    return respond(text, ledger)[0]


def respond(text: str, ledger: Ledger) -> tuple[list[DataFrame], Ledger]:
    """``answer`` and the ledger that the request leaves. Queries are asked of the ledger as it is; actions follow each other in order."""
    request = parse(text)
    if request is None or not (request.queries or request.actions or request.clarification):
        return [fallback(ledger, *period(None, None, ledger.now))], ledger
    out = [run(q, ledger) for q in request.queries]
    for a in request.actions:
        ledger, count = after(a, ledger)
        out.append(count)
    return out, ledger
