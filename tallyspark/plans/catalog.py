"""The registered queries of the ledger engine and the SQL that each must equal.

Every query runs over whole tables. Where limits stand they are the feature (a list's length, a top-k).
Remainders of ids only give rows their roles (which are stored already, which were deleted): all rows take part.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.vectors import cosine
from ..operators import aggregates as ag
from ..operators import clustering, joins, matching, predicates
from ..operators import mutations as mu
from ..operators import windows as wi
from ..sources import ledger as lg
from ..sources import messages as ms
from ..sources import rules as rl
from . import dsl, screens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES = {"e": lg.EXPENSES_SQL, "i": lg.INCOMES_SQL, "b": lg.BUDGETS_SQL, "p": lg.PLANTED_SQL}
NOW = datetime(1998, 8, 2, 12)


def query(name: str, sql: str | None = None, ctes: str = "e"):
    """Register a query; ``sql`` is its body in DuckDB, over the ledger views that ``ctes`` names."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            views = ",".join(CTES[c] for c in ctes)
            body = sql.strip()
            if views and body.startswith("WITH "):
                views, body = views + ",", body[5:]
            ORACLES[name] = (f"WITH {views} " if views else "") + body
        return f

    return register


def book(spark: SparkSession, d: str) -> dsl.Ledger:
    exclusions = spark.createDataFrame([("광고", "default"), ("vip", "user")], "keyword string, source string")
    return dsl.Ledger(lg.expenses(spark, d), lg.incomes(spark, d), lg.budgets(spark), exclusions, NOW, 5_000_000_000)


def ask(spark: SparkSession, d: str, **q) -> DataFrame:
    q["filters"] = tuple(dsl.Filter(**f) for f in q.get("filters", ()))
    q["metrics"] = tuple(dsl.Metric(m) for m in q.get("metrics", ()))
    return dsl.run(dsl.Query(**q), book(spark, d))


# The language: analytics

YEAR = {"startDate": "1997-01-01", "endDate": "1997-12-31"}
IN_YEAR = "ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01'"

FLAGSHIP = """Here it is: {"queries":[{"type":"analytics","startDate":"1997-01-01","endDate":"1997-12-31",
  "filters":[{"field":"amount","op":">=","value":1000}],
  "groupBy":"category","metrics":[{"op":"sum"},{"op":"count"}],"sort":"desc","topN":5}]}"""


@query("dsl_analytics_top_categories", f"SELECT category AS group_key, sum(amount)::BIGINT AS sum, count(*)::BIGINT AS count FROM expenses WHERE {IN_YEAR} AND amount >= 1000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(s, d):
    return dsl.answer(FLAGSHIP, book(s, d))[0]


def _analytics(name: str, sql: str, **q) -> None:
    query(f"dsl_analytics_{name}", sql)(lambda s, d: ask(s, d, type="analytics", **q))


_analytics("all_metrics", "SELECT cardName AS group_key, sum(amount)::BIGINT AS sum, floor(sum(amount)::DOUBLE / count(*))::BIGINT AS avg, count(*)::BIGINT AS count, max(amount)::BIGINT AS max, min(amount)::BIGINT AS min FROM expenses WHERE " + IN_YEAR + " GROUP BY 1", groupBy="cardName", metrics=("sum", "avg", "count", "max", "min"), **YEAR)
_analytics("empty", "SELECT '전체' AS group_key, 0::BIGINT AS sum, 0::BIGINT AS count", filters=({"field": "amount", "op": "<", "value": -1},), **YEAR)
_analytics("unknown_filter", f"SELECT '전체' AS group_key, sum(amount)::BIGINT AS sum, count(*)::BIGINT AS count FROM expenses WHERE {IN_YEAR}", filters=({"field": "mood", "op": "==", "value": 1}, {"field": "amount", "op": "~", "value": 3}), **YEAR)
_analytics("memo_not_contains", f"SELECT '전체' AS group_key, sum(amount)::BIGINT AS sum, count(*)::BIGINT AS count FROM expenses WHERE {IN_YEAR} AND NOT (coalesce(memo, '') ILIKE '%f%')", filters=({"field": "memo", "op": "not_contains", "value": "F"},), **YEAR)
_analytics("weekday", f"SELECT upper(strftime(ts, '%a')) AS group_key, count(*)::BIGINT AS count, sum(amount)::BIGINT AS sum FROM expenses WHERE {IN_YEAR} AND upper(strftime(ts, '%a')) IN ('SAT', 'SUN') GROUP BY 1", groupBy="dayOfWeek", metrics=("count", "sum"), filters=({"field": "dayOfWeek", "op": "in", "value": ["sat", "sun"]},), **YEAR)
_analytics("months_ascending", f"SELECT strftime(ts, '%Y-%m') AS group_key, sum(amount)::BIGINT AS sum FROM expenses WHERE {IN_YEAR} GROUP BY 1 ORDER BY 2 LIMIT 4", groupBy="month", metrics=("sum",), sort="asc", topN=4, **YEAR)
_analytics("stores_top", f"SELECT storeName AS group_key, sum(amount)::BIGINT AS sum, count(*)::BIGINT AS count FROM expenses WHERE {IN_YEAR} GROUP BY 1 ORDER BY 2 DESC, max(ts) DESC, 1 LIMIT 20", groupBy="storeName", topN=20, **YEAR)
_analytics("category_case", f"SELECT category AS group_key, count(*)::BIGINT AS count FROM expenses WHERE {IN_YEAR} AND lower(category) <> '1-urgent' AND category NOT IN ('2-high', '5-LOW') GROUP BY 1", groupBy="category", metrics=("count",), filters=({"field": "category", "op": "!=", "value": "1-URGENT"}, {"field": "category", "op": "not_in", "value": ["2-high", "5-LOW"]}), **YEAR)
_analytics("subcategories", f"SELECT '전체' AS group_key, count(*)::BIGINT AS count FROM expenses WHERE {IN_YEAR} AND category = '3-MEDIUM'", metrics=("count",), filters=({"field": "category", "op": "==", "value": "3-MEDIUM", "includeSubcategories": True},), **YEAR)
_analytics("store_list", f"SELECT storeName AS group_key, count(*)::BIGINT AS count FROM expenses WHERE {IN_YEAR} AND lower(storeName) IN ('customer#000000001', 'customer#000000002', 'customer#000000004') GROUP BY 1", groupBy="storeName", metrics=("count",), filters=({"field": "storeName", "op": "in", "value": ["CUSTOMER#000000001", "customer#000000002", "Customer#000000004"]},), **YEAR)
_analytics("days", f"SELECT strftime(ts, '%Y-%m-%d') AS group_key, sum(amount)::BIGINT AS sum, count(*)::BIGINT AS count FROM expenses WHERE {IN_YEAR} AND lower(cardName) LIKE '%build%' GROUP BY 1", groupBy="date", filters=({"field": "cardName", "op": "contains", "value": "BUILD"},), **YEAR)
_analytics("unknown_group", f"SELECT '전체' AS group_key, max(amount)::BIGINT AS max, 0::BIGINT AS median FROM expenses WHERE {IN_YEAR}", groupBy="planet", metrics=("max", "median"), **YEAR)

# The language: the other query types

LISTED = "id, ts, storeName, category, cardName, amount, memo"


def _asked(name: str, sql: str | None, ctes: str = "e", **q) -> None:
    query(f"dsl_{name}", sql, ctes)(lambda s, d: ask(s, d, **{"type": name, **q}))


_asked("total_expense", f"SELECT coalesce(sum(amount), 0)::BIGINT AS total FROM expenses WHERE {IN_YEAR} AND category = '1-URGENT'", category="1-URGENT", **YEAR)
_asked("total_income", "SELECT coalesce(sum(amount), 0)::BIGINT AS total FROM incomes WHERE ts >= TIMESTAMP '1970-01-01' AND ts < TIMESTAMP '2100-01-01'", "i", startDate="1970-01-01", endDate="2099-12-31")
_asked("expense_by_category", f"SELECT category, sum(amount)::BIGINT AS total FROM expenses WHERE {IN_YEAR} GROUP BY 1", **YEAR)
_asked("expense_list", f"SELECT {LISTED} FROM expenses WHERE {IN_YEAR} ORDER BY ts DESC, id LIMIT 50", **YEAR)
_asked("daily_totals", f"SELECT strftime(ts, '%Y-%m-%d') AS date, sum(amount)::BIGINT AS total FROM expenses WHERE {IN_YEAR} GROUP BY 1", **YEAR)
_asked("monthly_totals", "SELECT strftime(ts, '%Y-%m') AS month, sum(amount)::BIGINT AS total FROM expenses GROUP BY 1", **YEAR)
_asked("monthly_income", "SELECT 5000000000::BIGINT AS monthly_income", "")
_asked("expense_by_store", f"WITH f AS (SELECT * FROM expenses WHERE {IN_YEAR} AND lower(storeName) LIKE '%0000000%'), t AS (SELECT coalesce(sum(amount), 0)::BIGINT AS total, count(*)::BIGINT AS n FROM f) SELECT {LISTED}, total, n FROM f, t ORDER BY ts DESC, id LIMIT 10", storeName="0000000", **YEAR)
_asked("category_ratio", f"WITH per AS (SELECT category, sum(amount)::BIGINT AS total FROM expenses WHERE {IN_YEAR} GROUP BY 1) SELECT category, total, round(total * 100.0::DOUBLE / 5000000000, 1) AS income_ratio, round(total * 100.0::DOUBLE / (SELECT sum(total) FROM per), 1) AS expense_ratio FROM per", **YEAR)
_asked("expense_by_card", f"SELECT {LISTED} FROM expenses WHERE {IN_YEAR} AND lower(cardName) LIKE '%machin%' ORDER BY ts DESC, id LIMIT 20", cardName="Machin", **YEAR)
_asked("search_expense", f"SELECT {LISTED} FROM expenses WHERE storeName ILIKE '%urg%' OR category ILIKE '%urg%' OR cardName ILIKE '%urg%' OR coalesce(memo, '') ILIKE '%urg%' ORDER BY ts DESC, id LIMIT 30", searchKeyword="urg")
_asked("card_list", "SELECT DISTINCT cardName FROM expenses")
_asked("income_list", "WITH f AS (SELECT * FROM incomes WHERE ts < TIMESTAMP '2100-01-01' ORDER BY ts DESC, id LIMIT 20) SELECT id, ts, type, source, amount, (SELECT sum(amount)::BIGINT FROM f) AS total FROM f", "i", startDate="1970-01-01", endDate="2099-12-31")
_asked("sms_exclusion_list", "SELECT * FROM (VALUES ('광고', 'default'), ('vip', 'user')) t(keyword, source)", "")
_asked("budget_status", """
WITH months AS (SELECT strftime(m, '%Y-%m') AS month FROM generate_series(DATE '1997-02-01', DATE '1997-05-01', INTERVAL 1 MONTH) t(m)),
per AS (SELECT strftime(ts, '%Y-%m') AS month, category, sum(amount) AS spent FROM expenses WHERE ts >= TIMESTAMP '1997-02-10' AND ts < TIMESTAMP '1997-05-06' GROUP BY 1, 2),
spent AS (SELECT * FROM per UNION ALL SELECT month, '전체', sum(spent) FROM per GROUP BY 1)
SELECT m.month, b.category, b.monthlyLimit AS budget_limit, coalesce(s.spent, 0)::BIGINT AS spent, (b.monthlyLimit - coalesce(s.spent, 0))::BIGINT AS remaining,
  CASE WHEN b.monthlyLimit >= coalesce(s.spent, 0) THEN '남음' ELSE '초과' END AS state
FROM months m CROSS JOIN budgets b LEFT JOIN spent s ON s.month = m.month AND s.category = b.category""", "eb", startDate="1997-02-10", endDate="1997-05-05")  # fmt: skip
_asked("fallback", f"SELECT 'total' AS part, '' AS key, coalesce(sum(amount), 0)::BIGINT AS amount FROM expenses WHERE {IN_YEAR} UNION ALL SELECT 'category', category, sum(amount)::BIGINT FROM expenses WHERE {IN_YEAR} GROUP BY category UNION ALL SELECT 'recent', id::VARCHAR, amount FROM (SELECT * FROM expenses WHERE {IN_YEAR} ORDER BY ts DESC, id LIMIT 10)", type="something else", **YEAR)

# Actions

STATE = "SELECT category, count(*)::BIGINT AS n, sum(amount)::BIGINT AS total, count(memo)::BIGINT AS memos FROM ({rows}) GROUP BY 1"


def _acted(name: str, rows: str, table: str = "expenses", **a) -> None:
    def run(s, d):
        _, new, _ = dsl.apply(dsl.Action(**{"type": name, **a}), book(s, d))
        return new.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("long").alias("total"), F.count("memo").alias("memos"))

    query(f"action_{name}", STATE.format(rows=rows))(run)


OTHERS = "id, amount, memo"
_acted("update_category", f"SELECT {OTHERS}, CASE WHEN id = 7 THEN '식비' ELSE category END AS category FROM expenses", expenseId=7, newCategory="식비")
_acted("update_category_by_store", f"SELECT {OTHERS}, CASE WHEN transaction_type = 'EXPENSE' AND lower(storeName) LIKE '%00001%' THEN '식비' ELSE category END AS category FROM expenses", storeName="00001", newCategory="식비")
_acted("update_category_by_keyword", f"SELECT {OTHERS}, CASE WHEN transaction_type = 'EXPENSE' AND lower(storeName) LIKE '%00007%' THEN '교통' ELSE category END AS category FROM expenses", searchKeyword="00007", newCategory="교통")
_acted("delete_expense", "SELECT * FROM expenses WHERE id <> 7", expenseId=7)
_acted("delete_by_keyword", "SELECT * FROM expenses WHERE NOT (storeName ILIKE '%build%' OR category ILIKE '%build%' OR cardName ILIKE '%build%' OR coalesce(memo, '') ILIKE '%build%')", searchKeyword="BUILD")
_acted("add_expense", f"SELECT {OTHERS}, category FROM expenses UNION ALL SELECT (SELECT max(id) FROM expenses) + 1, 1234, 'tea', '미분류'", storeName="tea house", amount=1234, date="1998-01-02", memo="tea")
_acted("update_memo", "SELECT id, amount, category, CASE WHEN id = 4 THEN 'note' ELSE memo END AS memo FROM expenses", expenseId=4, memo="note")
_acted("update_amount", "SELECT id, category, memo, CASE WHEN id = 4 THEN 99 ELSE amount END AS amount FROM expenses", expenseId=4, newAmount=99)


@query("action_exclusions", "SELECT * FROM (VALUES ('광고', 'default'), ('vip', 'user'), ('sale', 'chat')) t(keyword, source)", "")
def _(s, d):
    start = book(s, d).exclusions
    once, _ = mu.add_exclusion(start, " Sale ")
    twice, _ = mu.add_exclusion(once, "sale")
    return mu.remove_exclusion(twice, "광고")[0]


@query("action_set_budget", "SELECT * FROM budgets WHERE category <> '2-HIGH' UNION ALL SELECT '2-HIGH', 777::BIGINT, 'default'", "b")
def _(s, d):
    return dsl.apply(dsl.Action("set_budget", category="2-HIGH", amount=777), book(s, d))[1]


@query("action_counts", "SELECT count(*)::BIGINT AS affected FROM expenses WHERE lower(storeName) LIKE '%00003%' AND transaction_type = 'EXPENSE'")
def _(s, d):
    return mu.set_category_by_store(lg.expenses(s, d), "00003", "식비")[1]


@query("upsert_and_insert", "SELECT * FROM budgets WHERE category <> '5-LOW' UNION ALL SELECT '5-LOW', 9::BIGINT, 'default' UNION ALL SELECT 'new', 8::BIGINT, 'default'", "b")
def _(s, d):
    b = lg.budgets(s)
    replaced = mu.upsert(b, s.createDataFrame([("5-LOW", 9, "default")], b.schema), ("category",))
    return mu.insert_new(replaced, s.createDataFrame([("2-HIGH", 1, "default"), ("new", 8, "default")], b.schema), ("category",))


@query("reconcile_keeps_stored", "SELECT id, CASE WHEN id % 2 = 0 THEN 'stored' END AS memo, amount + 1 AS amount FROM expenses WHERE id % 3 <> 0 UNION ALL SELECT id + 100000000, 'fresh', amount + 1 FROM expenses WHERE id % 3 = 0")
def _(s, d):
    e = lg.expenses(s, d)
    stored = e.filter("id % 3 <> 0").select("id", "smsId", F.when(F.col("id") % 2 == 0, "stored").alias("memo"), F.col("dateTime").alias("createdAt"))
    fresh = e.select((F.col("id") + 100000000).alias("id"), "smsId", F.lit("fresh").alias("memo"), (F.col("amount") + 1).alias("amount"), F.lit(0).cast("long").alias("createdAt"))
    return mu.reconcile(fresh, stored).select("id", "memo", "amount")


@query("move_to_incomes", "SELECT 'expenses' AS part, count(*)::BIGINT AS n, sum(amount)::BIGINT AS total FROM expenses WHERE id <> 33 UNION ALL SELECT 'incomes', count(*), sum(amount)::BIGINT FROM (SELECT amount FROM incomes UNION ALL SELECT amount FROM expenses WHERE id = 33)", "ei")
def _(s, d):
    e, i = mu.expense_to_income(lg.expenses(s, d), lg.incomes(s, d), 33)
    both = e.select(F.lit("expenses").alias("part"), "amount").unionByName(i.select(F.lit("incomes").alias("part"), "amount"))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("long").alias("total"))


# Aggregates


@query("visible_totals", "SELECT sum(CASE WHEN transaction_type <> 'TRANSFER' OR transfer_direction <> 'DEPOSIT' THEN amount ELSE 0 END)::BIGINT AS expense_total, (sum(CASE WHEN transaction_type = 'TRANSFER' AND transfer_direction = 'DEPOSIT' THEN amount ELSE 0 END) + (SELECT coalesce(sum(amount), 0) FROM incomes))::BIGINT AS income_total FROM expenses", "ei")
def _(s, d):
    return ag.visible_totals(lg.expenses(s, d), lg.incomes(s, d))


@query("store_visits", "SELECT storeName, sum(amount)::BIGINT AS total, count(*)::BIGINT AS visits FROM expenses GROUP BY 1")
def _(s, d):
    return ag.visits(lg.expenses(s, d), "storeName")


@query("income_headers", "SELECT CASE WHEN trim(source) <> '' THEN source ELSE type END AS source_key, sum(amount)::BIGINT AS total, count(*)::BIGINT AS visits FROM incomes GROUP BY 1", "i")
def _(s, d):
    return ag.income_headers(lg.incomes(s, d))


@query("day_headers", "SELECT coalesce(e.date, i.date) AS date, coalesce(expense, 0)::BIGINT AS expense, coalesce(income, 0)::BIGINT AS income FROM (SELECT strftime(ts, '%Y-%m-%d') AS date, sum(amount) AS expense FROM expenses GROUP BY 1) e FULL JOIN (SELECT strftime(ts, '%Y-%m-%d') AS date, sum(amount) AS income FROM incomes GROUP BY 1) i ON e.date = i.date", "ei")
def _(s, d):
    return ag.day_headers(lg.expenses(s, d), lg.incomes(s, d))


@query("weekly_totals", "WITH g AS (SELECT ((t.dd::DATE - DATE '1997-01-12') // 7)::INT AS week, t.dd::DATE AS day FROM generate_series(DATE '1997-01-19', DATE '1997-02-18', INTERVAL 1 DAY) t(dd)), p AS (SELECT ts::DATE AS day, sum(amount) AS total FROM expenses GROUP BY 1) SELECT week - 1 AS week, coalesce(sum(total), 0)::BIGINT AS total, min(g.day) AS first_day FROM g LEFT JOIN p ON g.day = p.day GROUP BY 1")
def _(s, d):
    return ag.weekly(lg.expenses(s, d), date(1997, 1, 19), date(1997, 2, 18))


@query("no_spend_days", "SELECT count(*)::BIGINT AS days FROM generate_series(DATE '1997-01-19', DATE '1997-02-10', INTERVAL 1 DAY) t(dd) WHERE NOT EXISTS (SELECT 1 FROM expenses WHERE ts::DATE = t.dd::DATE AND amount > 0 AND cardName = 'BUILDING' AND category = '1-URGENT')")
def _(s, d):
    rows = lg.expenses(s, d).filter("cardName = 'BUILDING' AND category = '1-URGENT'")
    return ag.no_spend_days(rows, date(1997, 1, 19), date(1997, 2, 18), date(1997, 2, 10))


@query("store_ranking", "SELECT storeName, sum(amount)::BIGINT AS total FROM expenses GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(s, d):
    return ag.store_ranking(lg.expenses(s, d), 50)


@query("owned_card_total", "SELECT coalesce(sum(amount), 0)::BIGINT AS total FROM expenses WHERE cardName IN ('BUILDING', 'MACHINERY')")
def _(s, d):
    owned = s.createDataFrame([("BUILDING", True), ("MACHINERY", True), ("HOUSEHOLD", False)], "cardName string, isOwned boolean")
    return ag.total(ag.of_owned_cards(lg.expenses(s, d), owned))


@query("card_counts", "SELECT cardName, count(*)::BIGINT AS \"seenCount\" FROM expenses GROUP BY 1")
def _(s, d):
    return ag.card_counts(lg.expenses(s, d))


@query("percentiles", "WITH r AS (SELECT category, amount, row_number() OVER (PARTITION BY category ORDER BY amount) AS k, count(*) OVER (PARTITION BY category) AS n FROM expenses) SELECT category, max(CASE WHEN k = ceil(0.5 * n) THEN amount END)::DOUBLE AS median, max(CASE WHEN k = ceil(0.2 * n) THEN amount END)::DOUBLE AS p20 FROM r GROUP BY 1")
def _(s, d):
    return lg.expenses(s, d).groupBy("category").agg(ag.floor_percentile("amount", 0.5).cast("double").alias("median"), ag.floor_percentile("amount", 0.2).cast("double").alias("p20"))


@query("example_stores", "WITH m AS (SELECT DISTINCT storeName, category, CASE WHEN storeName LIKE '%7' THEN 'user' ELSE 'local' END AS source FROM expenses), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE source WHEN 'user' THEN 0 ELSE 1 END, storeName)::INT AS rank FROM m) SELECT category, rank, storeName FROM r WHERE rank <= 5")
def _(s, d):
    m = lg.expenses(s, d).select("storeName", "category", F.when(F.col("storeName").endswith("7"), "user").otherwise("local").alias("source")).distinct()
    return ag.examples(m)


# Windows


@query("cumulative_month", "WITH g AS (SELECT range::INT AS day FROM range(0, 32)), p AS (SELECT least(greatest(ts::DATE - DATE '1997-03-01', 0), 30) + 1 AS day, sum(amount) AS t FROM expenses WHERE ts >= TIMESTAMP '1997-03-01' AND ts < TIMESTAMP '1997-04-01' GROUP BY 1) SELECT g.day, (sum(coalesce(t, 0)) OVER (ORDER BY g.day))::BIGINT AS cumulative FROM g LEFT JOIN p ON g.day = p.day")
def _(s, d):
    rows = lg.expenses(s, d).filter(predicates.within("ts", datetime(1997, 3, 1), datetime(1997, 3, 31, 23, 59, 59)))
    return wi.cumulative(rows, date(1997, 3, 1), 31)


@query("average_three_months", """
WITH m AS (SELECT k, (DATE '1997-07-19' - (k || ' months')::INTERVAL)::DATE AS first, (DATE '1997-08-19' - (k || ' months')::INTERVAL)::DATE AS next FROM range(1, 4) t(k)),
g AS (SELECT k, first, next - first AS days, r.range::INT AS day FROM m, range(0, 33) r WHERE r.range <= 31),
p AS (SELECT k, (ts::DATE - first) + 1 AS day, sum(amount) AS t FROM m JOIN expenses ON ts >= first AND ts < next GROUP BY 1, 2),
c AS (SELECT g.k, g.day, sum(coalesce(t, 0)) OVER (PARTITION BY g.k ORDER BY g.day) AS cum FROM g LEFT JOIN p ON p.k = g.k AND p.day = g.day)
SELECT day, (sum(cum) // 3)::BIGINT AS cumulative FROM c GROUP BY 1""")
def _(s, d):
    # billing months of August less one to three, with start day 19
    return wi.average_cumulative(lg.expenses(s, d), 3, 1997, 8, 19, 31)


@query("budget_line", "SELECT range::INT AS day, (1000000 * range // 30)::BIGINT AS cumulative FROM range(0, 31)", "")
def _(s, d):
    return wi.budget_line(s, 1_000_000, 30)


@query("store_frequency", "SELECT id, storeName, count(*) OVER (PARTITION BY storeName)::BIGINT AS frequency FROM expenses")
def _(s, d):
    return wi.with_frequency(lg.expenses(s, d)).select("id", "storeName", "frequency")


@query("coarse_duplicates", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY storeName, strftime(ts, '%Y-%m') ORDER BY id) AS k FROM expenses) WHERE k > 1")
def _(s, d):
    return wi.repeats(lg.expenses(s, d).withColumn("month", dates.month_key(F.col("ts"))), ("storeName", "month")).select("id")


@query("first_per_store_month", "SELECT min(id) AS id FROM expenses GROUP BY storeName, strftime(ts, '%Y-%m')")
def _(s, d):
    return wi.without_repeats(lg.expenses(s, d).withColumn("month", dates.month_key(F.col("ts"))), ("storeName", "month")).select("id")


@query("top_per_category", "WITH r AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY amount DESC, id)::INT AS rank FROM expenses) SELECT * FROM r WHERE rank <= 5")
def _(s, d):
    return wi.top_per(lg.expenses(s, d), ["category"], [F.desc("amount"), F.asc("id")], 5).select("id", "category", "rank")


@query("billing_months", """
SELECT strftime(m, '%Y-%m') AS month, d::INT AS start_day,
  CASE WHEN d = 1 THEN m::DATE ELSE ((m - INTERVAL 1 MONTH)::DATE + (least(d, day(last_day((m - INTERVAL 1 MONTH)::DATE))) - 1)::INT) END AS first_day,
  CASE WHEN d = 1 THEN last_day(m::DATE) ELSE (m::DATE + (least(d - 1, day(last_day(m::DATE))) - 1)::INT) END AS final_day
FROM generate_series(DATE '1992-01-01', DATE '1998-12-01', INTERVAL 1 MONTH) t(m), (VALUES (1), (18), (19), (25), (30), (31)) s(d)""", "")
def _(s, d):
    out = None
    months = s.range(1).select(F.explode(F.expr("sequence(date'1992-01-01', date'1998-12-01', interval 1 month)")).alias("m"))
    for k in (1, 18, 19, 25, 30, 31):
        one = months.select(F.date_format("m", "yyyy-MM").alias("month"), F.lit(k).alias("start_day"), dates.billing_start(F.col("m"), k).alias("first_day"), dates.billing_end(F.col("m"), k).alias("final_day"))
        out = one if out is None else out.unionByName(one)
    return out


RANGES = [(1, 10, 40), (2, 50, 60), (3, 100, 120), (4, 200, 210), (5, 300, 290), (6, 400, 460)]
COVERED = [(5, 20), (21, 60), (100, 105), (107, 130), (400, 450), (410, 420), (451, 460)]


@query("coverage", "SELECT * FROM (VALUES (1, 'FULL'), (2, 'FULL'), (3, 'PARTIAL'), (4, 'NONE'), (5, 'NONE'), (6, 'FULL')) t(id, status)", "")
def _(s, d):
    return wi.coverage(s.createDataFrame(RANGES, "id int, start long, end long"), s.createDataFrame(COVERED, "start long, end long"))


@query("events_coverage", """
WITH c AS (SELECT (epoch(date_trunc('hour', ts::TIMESTAMP))::BIGINT // 3600) AS h FROM events WHERE event_type = 'click' GROUP BY 1),
t AS (SELECT DISTINCT (epoch(date_trunc('day', ts::TIMESTAMP))::BIGINT // 86400) AS id FROM events),
n AS (SELECT t.id, count(c.h) AS k FROM t LEFT JOIN c ON c.h >= t.id * 24 AND c.h < t.id * 24 + 24 GROUP BY 1)
SELECT id, CASE WHEN k = 24 THEN 'FULL' WHEN k = 0 THEN 'NONE' ELSE 'PARTIAL' END AS status FROM n""", "")
def _(s, d):
    e = lg.table(s, d, "events").withColumn("_ms", lg.millis(F.col("ts")))
    covered = e.filter("event_type = 'click'").select(F.expr("_ms div 3600000").alias("start")).distinct().withColumn("end", F.col("start"))
    targets = e.select(F.expr("_ms div 86400000").alias("id")).distinct().select("id", (F.col("id") * 24).alias("start"), (F.col("id") * 24 + 23).alias("end"))
    return wi.coverage(targets, covered)


@query("month_comparison", "WITH t AS (SELECT sum(CASE WHEN ts >= TIMESTAMP '1997-05-01' AND ts <= TIMESTAMP '1997-05-20' THEN amount ELSE 0 END)::BIGINT AS current, sum(CASE WHEN ts >= TIMESTAMP '1997-04-01' AND ts <= TIMESTAMP '1997-04-20' THEN amount ELSE 0 END)::BIGINT AS previous FROM expenses) SELECT current, previous, round((current - previous)::DOUBLE / previous * 100)::BIGINT AS percent, CASE WHEN abs((current - previous)::DOUBLE / previous) <= 0.03 THEN 'SAME' WHEN current < previous THEN 'LESS' ELSE 'MORE' END AS verdict FROM t")
def _(s, d):
    return wi.comparison(lg.expenses(s, d), datetime(1997, 5, 1), datetime(1997, 5, 20), datetime(1997, 4, 1), datetime(1997, 4, 20))


@query("last_messages", "WITH r AS (SELECT conv_id AS session, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY id)::INT AS position FROM r WHERE n BETWEEN 2 AND 5", "")
def _(s, d):
    chat = lg.table(s, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("id"), F.col("turn").alias("timestamp"))
    return wi.last_messages(chat, 4, 1).select("session", "id", "position")


@query("list_orders", "WITH f AS (SELECT id, ts, amount, count(*) OVER (PARTITION BY storeName) AS n FROM expenses), a AS (SELECT 'DATE_DESC' AS kind, id, row_number() OVER (ORDER BY ts DESC, id) AS p FROM f), b AS (SELECT 'AMOUNT_DESC' AS kind, id, row_number() OVER (ORDER BY amount DESC, id) AS p FROM f), c AS (SELECT 'STORE_FREQ' AS kind, id, row_number() OVER (ORDER BY n DESC, ts DESC, id) AS p FROM f) SELECT kind, id FROM a WHERE p <= 100 UNION ALL SELECT kind, id FROM b WHERE p <= 100 UNION ALL SELECT kind, id FROM c WHERE p <= 100")
def _(s, d):
    return screens.list_orders(lg.expenses(s, d), 100)


# Joins


@query("nearest_in_time", "WITH p AS (SELECT event_id AS id, user_id % 200 AS k, epoch(date_trunc('second', ts::TIMESTAMP))::BIGINT * 1000 AS t FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS id, user_id % 200 AS k, epoch(date_trunc('second', ts::TIMESTAMP))::BIGINT * 1000 AS t FROM events WHERE event_type = 'click'), j AS (SELECT p.id, c.id AS other_id, abs(p.t - c.t) AS distance FROM p JOIN c ON p.k = c.k AND abs(p.t - c.t) <= 600000) SELECT id, other_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other_id) AS n FROM j) WHERE n = 1", "")
def _(s, d):
    e = lg.table(s, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 200).cast("string").alias("content_key"), lg.millis(F.col("ts")).alias("message_ms"), "event_type")
    return joins.nearest(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), 600_000)


@query("all_near_in_time", "WITH p AS (SELECT event_id AS id, user_id % 200 AS k, epoch(date_trunc('second', ts::TIMESTAMP))::BIGINT * 1000 AS t FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS id, user_id % 200 AS k, epoch(date_trunc('second', ts::TIMESTAMP))::BIGINT * 1000 AS t FROM events WHERE event_type = 'click') SELECT p.id, c.id AS other_id, abs(p.t - c.t) AS distance FROM p JOIN c ON p.k = c.k AND abs(p.t - c.t) <= 600000", "")
def _(s, d):
    e = lg.table(s, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 200).cast("string").alias("content_key"), lg.millis(F.col("ts")).alias("message_ms"), "event_type")
    return joins.near(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), 600_000)


@query("new_messages", "SELECT smsId AS id FROM expenses WHERE id % 11 <> 0 AND (id % 5 <> 0 OR id % 15 = 0)")
def _(s, d):
    e = lg.expenses(s, d)
    return joins.unseen(e.select(F.col("smsId").alias("id")), e.filter("id % 5 = 0").select("id", "smsId"), e.filter("id % 11 = 0").select("smsId"), e.filter("id % 15 = 0").select(F.col("smsId").alias("id")))


@query("conflicts_removed", "SELECT id FROM expenses WHERE id % 4 <> 0")
def _(s, d):
    e = lg.expenses(s, d)
    return joins.without_conflicts(e, e.filter("id % 4 = 0")).select("id")


STORE_RULES = [(1, "customer#00000000", "교통", True, 10), (2, "#0000000", "식비", None, 20), (3, "99", "구독", False, 5)]


@query("store_rules_newest", "SELECT id, CASE WHEN lower(storeName) LIKE '%#0000000%' THEN '식비' WHEN lower(storeName) LIKE '%99%' THEN '구독' END AS rule_category, CASE WHEN lower(storeName) LIKE '%#0000000%' THEN NULL WHEN lower(storeName) LIKE '%99%' THEN false END AS rule_fixed FROM expenses")
def _(s, d):
    rules = s.createDataFrame(STORE_RULES, "id int, keyword string, category string, isFixed boolean, createdAt long")
    return joins.store_rules(lg.expenses(s, d), rules).select("id", "rule_category", "rule_fixed")


@query("store_rules_longest", "SELECT id, CASE WHEN lower(storeName) LIKE '%customer#00000000%' THEN '교통' WHEN lower(storeName) LIKE '%#0000000%' THEN '식비' WHEN lower(storeName) LIKE '%99%' THEN '구독' END AS rule_category FROM expenses")
def _(s, d):
    rules = s.createDataFrame(STORE_RULES, "id int, keyword string, category string, isFixed boolean, createdAt long")
    return joins.store_rules(lg.expenses(s, d), rules, "longest").select("id", "rule_category")


@query("mapped_categories", "SELECT id, CASE WHEN storeName = 'Customer#000000007' THEN '식비' WHEN contains(storeName, '00001') THEN '교통' END AS mapped_category FROM expenses")
def _(s, d):
    m = s.createDataFrame([("Customer#000000007", "식비"), ("00001", "교통")], "storeName string, category string")
    return joins.mapped_category(lg.expenses(s, d), m).select("id", "mapped_category")


@query("exclusion_keywords", "SELECT id FROM expenses WHERE memo IS NULL OR NOT contains(lower(memo), 'f')")
def _(s, d):
    return predicates.without_keywords(lg.expenses(s, d), "memo", s.createDataFrame([("F",), ("",)], "keyword string")).select("id")


@query("categories_with_last_month", "WITH a AS (SELECT category, sum(amount)::BIGINT AS total FROM expenses WHERE ts >= TIMESTAMP '1997-05-01' AND ts < TIMESTAMP '1997-06-01' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3), b AS (SELECT category, sum(amount)::BIGINT AS last_total FROM expenses WHERE ts >= TIMESTAMP '1997-04-01' AND ts < TIMESTAMP '1997-05-01' GROUP BY 1) SELECT a.category, total, coalesce(last_total, 0)::BIGINT AS last_total FROM a LEFT JOIN b ON a.category = b.category")
def _(s, d):
    return screens.top_categories(lg.expenses(s, d), (datetime(1997, 5, 1), datetime(1997, 5, 31, 23, 59, 59)), (datetime(1997, 4, 1), datetime(1997, 4, 30, 23, 59, 59)))


@query("fan_out_labels", "SELECT storeName, cardName AS category FROM expenses WHERE cardName IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2")
def _(s, d):
    e = lg.expenses(s, d).filter("cardName IN ('BUILDING', 'MACHINERY')")
    groups = e.groupBy(F.col("cardName").alias("representative")).agg(F.collect_set("storeName").alias("members"))
    return joins.fan_out(groups, e.select(F.col("cardName").alias("storeName"), F.col("cardName").alias("category")).distinct())


# Filters and text


@query("visible_rows", "SELECT id FROM expenses WHERE (transaction_type = 'EXPENSE' AND category IN ('1-URGENT', '2-HIGH')) OR transaction_type = 'TRANSFER'")
def _(s, d):
    return lg.expenses(s, d).filter(predicates.visible(F.col("transaction_type"), F.col("category"), {"EXPENSE": ("1-URGENT", "2-HIGH"), "TRANSFER": None})).select("id")


@query("fixed_only", "SELECT id FROM expenses WHERE is_fixed")
def _(s, d):
    return lg.expenses(s, d).filter(predicates.fixed_filter("FIXED_ONLY")).select("id")


@query("export_rows", "SELECT id FROM expenses WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01' AND cardName IN ('BUILDING') AND category IN ('1-URGENT', '5-LOW')")
def _(s, d):
    return lg.expenses(s, d).filter(predicates.export_filter(datetime(1996, 1, 1), datetime(1996, 12, 31, 23, 59, 59, 999000), ("BUILDING",), ("1-URGENT", "5-LOW"))).select("id")


@query("income_search", "SELECT id FROM incomes WHERE type ILIKE '%급%' OR source ILIKE '%user1%' OR coalesce(memo, '') ILIKE '%급%' OR coalesce(memo, '') ILIKE '%user1%'", "i")
def _(s, d):
    i = lg.incomes(s, d)
    columns = ("type", "source", "memo")
    return i.filter(predicates.search("급", columns) | predicates.search("user1", columns)).select("id")


@query("classified_messages", """
SELECT conv_id::VARCHAR || '_' || turn::VARCHAR AS id,
  CASE WHEN text IS NULL OR trim(text) = '' THEN 'blank' WHEN length(text) > 130 THEN 'tooLong(' || length(text)::VARCHAR || ')'
    WHEN NOT regexp_matches(lower(text), 'kb|sol|nh|bc|citi|ibk|kjb|jb|bnk|dgb|mg|kfcc|post') THEN 'noFinancialKw' ELSE 'noAmount' END AS reason
FROM conversations""", "")
def _(s, d):
    return predicates.classified(lg.messages(s, d)).select("id", "reason")


@query("normalized_senders", "SELECT conv_id::VARCHAR || '_' || turn::VARCHAR AS id, '02' || lpad((conv_id % 40)::VARCHAR, 4, '0') AS sender FROM conversations", "")
def _(s, d):
    return lg.messages(s, d).select("id", text.normalize_sender(F.col("address")).alias("sender"))


@query("parsed_ids", "SELECT id, senderAddress AS address, dateTime AS date, id::VARCHAR AS hash FROM expenses")
def _(s, d):
    return lg.expenses(s, d).select("id", text.parse_message_id(F.col("smsId")).alias("p")).select("id", "p.address", "p.date", "p.hash")


@query("rule_keys", "SELECT id, substr(sha256(storeName || '|' || category || '|' || coalesce(memo, '') || '|' || amount::VARCHAR), 1, 24) AS rule_key FROM expenses")
def _(s, d):
    return lg.expenses(s, d).select("id", text.rule_key(F.col("storeName"), F.col("category"), F.col("memo"), F.col("amount")).alias("rule_key"))


@query("java_hashes", "WITH RECURSIVE w AS (SELECT DISTINCT storeName AS t FROM expenses), h AS (SELECT t, 0 AS k, 0::BIGINT AS h FROM w UNION ALL SELECT t, k + 1, (h * 31 + unicode(substr(t, k + 1, 1))) % 4294967296 FROM h WHERE k < length(t)) SELECT t AS name, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM h WHERE k = length(t)".replace("WITH RECURSIVE w AS", "WITH w AS"))
def _(s, d):
    return lg.expenses(s, d).select("storeName").distinct().select(F.col("storeName").alias("name"), text.java_hash(F.col("storeName")).alias("hash"))


ORACLES["java_hashes"] = ORACLES["java_hashes"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("short_titles", "SELECT doc_id, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS title FROM documents", "")
def _(s, d):
    return lg.table(s, d, "documents").select("doc_id", text.short_title(F.col("text")).alias("title"))


@query("masked_texts", "SELECT doc_id, md5(regexp_replace(text, '[0-9]', '*', 'g')) AS masked FROM documents", "")
def _(s, d):
    return lg.table(s, d, "documents").select("doc_id", F.md5(text.mask_digits(F.col("text")).cast("binary")).alias("masked"))


@query("csv_lines", "SELECT id, strftime(ts, '%Y-%m-%d %H:%M') || ',' || storeName || ',' || category || ',' || cardName || ',' || amount::VARCHAR || ',' || coalesce(memo, '') AS line FROM expenses")
def _(s, d):
    from ..sources.backup import expense_lines

    return expense_lines(lg.expenses(s, d)).select("id", "line")


@query("combined_lines", "SELECT '지출' AS kind, strftime(ts, '%Y-%m-%d %H:%M') || ',지출,' || storeName || ',' || (-amount)::VARCHAR AS line FROM expenses UNION ALL SELECT '수입', strftime(ts, '%Y-%m-%d %H:%M') || ',수입,' || CASE WHEN source <> '' THEN source ELSE type END || ',' || amount::VARCHAR FROM incomes", "ei")
def _(s, d):
    from ..sources.backup import combined_lines

    return combined_lines(lg.expenses(s, d), lg.incomes(s, d)).select(F.split("line", ",")[1].alias("kind"), "line")


@query("weekday_keys", "SELECT id, upper(strftime(ts, '%a')) AS weekday, strftime(ts, '%Y-%m') AS month FROM expenses")
def _(s, d):
    return lg.expenses(s, d).select("id", dates.weekday_key(F.col("ts")).alias("weekday"), dates.month_key(F.col("ts")).alias("month"))


@query("calendar_grid", "SELECT ((t.dd::DATE - DATE '1997-01-19') // 7)::INT AS week, dayofweek(t.dd::DATE)::INT AS weekday, t.dd::DATE AS day, t.dd::DATE BETWEEN DATE '1997-01-21' AND DATE '1997-02-20' AS in_period FROM generate_series(DATE '1997-01-19', DATE '1997-02-22', INTERVAL 1 DAY) t(dd)", "")
def _(s, d):
    return dates.calendar_grid(s, date(1997, 1, 21), date(1997, 2, 20)).select("week", F.col("weekday").cast("int").alias("weekday"), "day", "in_period")


@query("adaptive_priorities", "WITH r AS (SELECT id, (amount % 900)::INT AS p, (id % 20)::INT AS m, (id % 13)::INT AS f, CASE WHEN id % 5 = 0 THEN 0 ELSE 1000000000000 - (id % 200) * 86400000 END AS l FROM expenses) SELECT id, least(1000, greatest(0, greatest(p, 700) + m * 8 - f * 9 + CASE WHEN l <= 0 THEN 0 WHEN 1000000000000 - l <= 7 * 86400000 THEN 40 WHEN 1000000000000 - l <= 30 * 86400000::BIGINT THEN 20 WHEN 1000000000000 - l <= 90 * 86400000::BIGINT THEN 5 ELSE -20 END))::INT AS priority FROM r")
def _(s, d):
    r = lg.expenses(s, d).select("id", (F.col("amount") % 900).cast("int").alias("p"), (F.col("id") % 20).cast("int").alias("m"), (F.col("id") % 13).cast("int").alias("f"), F.when(F.col("id") % 5 == 0, F.lit(0).cast("long")).otherwise(F.lit(1000000000000) - (F.col("id") % 200) * 86400000).alias("l"))
    return r.select("id", predicates.rule_priority(F.col("p"), F.lit("expense"), F.col("m"), F.col("f"), F.col("l"), 1000000000000).cast("int").alias("priority"))


# Sources


@query("channel_union", "SELECT conv_id::VARCHAR || '_' || turn::VARCHAR AS id, CASE WHEN turn % 2 = 0 THEN 'sms' ELSE 'rcs' END AS channel FROM conversations", "")
def _(s, d):
    m = lg.messages(s, d)
    turn = F.split("id", "_")[1].cast("int")
    tag = lambda rows, name: rows.withColumn("body", F.lit(name))
    return ms.all_messages(tag(m.filter(turn % 2 == 0), "sms"), tag(m.filter(F.lit(False)), "mms"), tag(m, "rcs")).select("id", F.col("body").alias("channel"))


@query("sms_scan", "SELECT count(*)::BIGINT AS n FROM conversations WHERE text IS NOT NULL AND conv_id % 40 <> 3 AND conv_id * 3600000 + turn * 60000 BETWEEN 0 AND 360000000", "")
def _(s, d):
    blocked = s.createDataFrame([("02-0003",)], "address string")
    return ms.scan_sms(lg.messages(s, d), 1_700_000_000_000, 1_700_360_000_000, blocked).agg(F.count(F.lit(1)).alias("n"))


@query("rule_overlay", "SELECT * FROM (VALUES ('1588', 'expense', 'a', 'remote'), ('1588', 'expense', 'b', 'asset'), ('1600', 'cancel', 'c', 'remote')) t(\"senderAddress\", type, \"ruleKey\", source)", "")
def _(s, d):
    asset = s.createDataFrame([('{"version":1,"sms_rules":{"1588":{"expense":{"a":{"bodyRegex":"x(\\\\d+)"},"b":{"bodyRegex":"y"}}}}}',)], "json string")
    over = s.createDataFrame([('{"version":2,"sms_rules":{"1588":{"expense":{"a":{"bodyRegex":"z(\\\\\\\\d+)"}}},"1600":{"cancel":{"c":{"bodyRegex":"w"}}}}}',)], "json string")
    return rl.overlay(rl.flatten(asset), rl.remote(over)).select("senderAddress", "type", "ruleKey", "source")


@query("failure_histogram", "SELECT category AS reason, count(*)::BIGINT AS n FROM expenses GROUP BY 1")
def _(s, d):
    return ag.histogram(lg.expenses(s, d).select(F.col("category").alias("reason")), "reason")


# Vectors


def vectors(s: SparkSession, d: str) -> DataFrame:
    return lg.table(s, d, "embeddings").select("vec_id", "embedding", "label")


@query("best_vector_match", "WITH p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) AS k FROM p) SELECT left_id, right_id, similarity FROM r WHERE k = 1", "")
def _(s, d):
    v = vectors(s, d)
    return matching.near_pairs(v.select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("vector")), best_only=True, skip_equal=True)


@query("vector_range_match", "SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3", "")
def _(s, d):
    v = vectors(s, d)
    return matching.near_pairs(v.select(F.col("vec_id").alias("left_id"), "label", F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("right_id"), "label", F.col("embedding").alias("vector")), 0.3, skip_equal=True, keys=("label",))


@query("neighbour_vote", "WITH p AS (SELECT a.vec_id AS store, b.label::VARCHAR AS category, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), v AS (SELECT store, category, count(*) AS votes, avg(s) AS similarity FROM p WHERE s >= 0.2 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY votes DESC, round(similarity, 9) DESC, category) AS k FROM v) SELECT store, category, votes::BIGINT AS votes FROM r WHERE k = 1", "")
def _(s, d):
    v = vectors(s, d)
    pairs = matching.near_pairs(v.select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("vector")), 0.2, skip_equal=True)
    return matching.group_vote(pairs.join(v.select(F.col("vec_id").alias("right_id"), F.col("label").cast("string").alias("category")), "right_id"), 0.2).select("store", "category", "votes")


@query("self_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS similarity FROM embeddings", "")
def _(s, d):
    return vectors(s, d).select("vec_id", cosine(F.col("embedding"), F.col("embedding")).alias("similarity"))


@query("vector_clusters")
def _(s, d):
    rows = vectors(s, d).select(F.col("vec_id").alias("id"), F.col("vec_id").alias("position"), F.col("label").cast("string").alias("sender"), F.col("embedding").alias("vector"), F.lit("t").alias("template"))
    return clustering.cluster(rows, "sender", "greedy", 0.3)


@query("categorized_stores", "SELECT id, CASE WHEN lower(storeName) LIKE '%#0000000%' THEN '식비' WHEN lower(storeName) LIKE '%99%' THEN '구독' WHEN contains(storeName, '00001') THEN '교통' WHEN contains(lower(storeName), 'cu') THEN '식비' ELSE '미분류' END AS category, CASE WHEN lower(storeName) LIKE '%#0000000%' OR lower(storeName) LIKE '%99%' THEN 'rule' WHEN contains(storeName, '00001') THEN 'mapping' WHEN contains(lower(storeName), 'cu') THEN 'word' ELSE 'none' END AS tier FROM expenses")
def _(s, d):
    rules = s.createDataFrame(STORE_RULES, "id int, keyword string, category string, isFixed boolean, createdAt long")
    m = s.createDataFrame([("00001", "교통")], "storeName string, category string")
    return matching.categorize(lg.expenses(s, d).select("id", "storeName"), rules, m, words={"식비": ("CU",)}).select("id", "category", "tier")


# Screens


@query("home_page", """
WITH now AS (SELECT * FROM expenses WHERE ts >= TIMESTAMP '1997-04-19' AND ts < TIMESTAMP '1997-05-19')
SELECT 'spent' AS part, '' AS key, coalesce(sum(amount), 0)::BIGINT AS amount FROM now
UNION ALL SELECT 'category', category, sum(amount)::BIGINT FROM now GROUP BY category
UNION ALL SELECT 'income', '', coalesce(sum(amount), 0)::BIGINT FROM incomes WHERE ts >= TIMESTAMP '1997-04-19' AND ts < TIMESTAMP '1997-05-19'""", "ei")
def _(s, d):
    return screens.home(lg.expenses(s, d), lg.incomes(s, d), 1997, 5, 19)


@query("category_page", "WITH now AS (SELECT * FROM expenses WHERE ts >= TIMESTAMP '1997-05-01' AND ts < TIMESTAMP '1997-06-01' AND category IN ('1-URGENT')), g AS (SELECT range::INT AS day FROM range(0, 32)), p AS (SELECT (ts::DATE - DATE '1997-05-01') + 1 AS day, sum(amount) AS t FROM now GROUP BY 1) SELECT g.day, (sum(coalesce(t, 0)) OVER (ORDER BY g.day))::BIGINT AS cumulative FROM g LEFT JOIN p ON g.day = p.day")
def _(s, d):
    return screens.category_curve(lg.expenses(s, d), ("1-URGENT",), 1997, 5)


@query("day_detail", "SELECT 'expense' AS kind, id, amount FROM expenses WHERE ts >= TIMESTAMP '1997-05-05' AND ts < TIMESTAMP '1997-05-06' UNION ALL SELECT 'income', id, amount FROM incomes WHERE ts >= TIMESTAMP '1997-05-05' AND ts < TIMESTAMP '1997-05-06'", "ei")
def _(s, d):
    return screens.day_detail(lg.expenses(s, d), lg.incomes(s, d), date(1997, 5, 5))


@query("calendar_page", "WITH g AS (SELECT t.dd::DATE AS day FROM generate_series(DATE '1997-04-27', DATE '1997-05-31', INTERVAL 1 DAY) t(dd)), p AS (SELECT ts::DATE AS day, sum(amount) AS total FROM expenses GROUP BY 1) SELECT ((g.day - DATE '1997-04-27') // 7)::INT AS week, dayofweek(g.day)::INT AS weekday, g.day, g.day BETWEEN DATE '1997-05-01' AND DATE '1997-05-31' AS in_period, coalesce(total, 0)::BIGINT AS total FROM g LEFT JOIN p ON g.day = p.day")
def _(s, d):
    return ag.calendar(lg.expenses(s, d), date(1997, 5, 1), date(1997, 5, 31)).withColumn("weekday", F.col("weekday").cast("int"))


@query("history_page", "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*)::BIGINT AS n, sum(amount)::BIGINT AS total FROM expenses WHERE ts >= TIMESTAMP '1997-05-01' AND ts < TIMESTAMP '1997-06-01' AND NOT is_fixed AND (memo IS NULL OR NOT contains(lower(memo), 'f')) GROUP BY 1")
def _(s, d):
    return screens.history(lg.expenses(s, d), 1997, 5, 1, "EXCLUDE_FIXED", s.createDataFrame([("f",)], "keyword string"))


from . import catalog_edits, catalog_messages  # noqa: E402, F401  register their queries
