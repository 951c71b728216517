"""Registered queries of edits end to end, of operators on single values, of whole screens and of streams' transforms, with their SQL.

The ledger here has planted rows: copies of expenses under other ids, and unclassified ones.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, extract, text
from ..functions import vectors as ve
from ..operators import joins, matching, predicates
from ..operators import mutations as mu
from ..sources import backup
from ..sources import ledger as lg
from ..streaming import ingest
from . import dsl, screens
from .catalog import LISTED, book, query
from .catalog_messages import payments
from .catalog_messages import vectors as vectors_of


def planted(s: SparkSession, d: str) -> DataFrame:
    return lg.planted(lg.expenses(s, d))


def planted_book(s: SparkSession, d: str) -> dsl.Ledger:
    return dsl.replace(book(s, d), expenses=planted(s, d))


# Rows that edits look for


@query("dsl_uncategorized_list", f"SELECT {LISTED} FROM expenses WHERE category = '미분류' ORDER BY ts DESC, id LIMIT 20", "p")
def _(s, d):
    return dsl.run(dsl.Query("uncategorized_list"), planted_book(s, d))


@query("dsl_duplicate_list", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY amount, storeName, ts ORDER BY id) AS k FROM expenses), f AS (SELECT * FROM r WHERE k > 1) SELECT {LISTED}, (SELECT count(*) FROM f)::BIGINT AS n FROM f ORDER BY ts DESC, id LIMIT 20", "p")
def _(s, d):
    return dsl.run(dsl.Query("duplicate_list"), planted_book(s, d))


@query("action_delete_duplicates", "SELECT id, category, amount FROM (SELECT *, row_number() OVER (PARTITION BY amount, storeName, ts ORDER BY id) AS k FROM expenses) WHERE k = 1", "p")
def _(s, d):
    return dsl.apply(dsl.Action("delete_duplicates"), planted_book(s, d))[1].select("id", "category", "amount")


@query("action_update_store_name", "SELECT id, CASE WHEN id = 4 THEN 'renamed' ELSE storeName END AS \"storeName\", amount FROM expenses")
def _(s, d):
    return dsl.apply(dsl.Action("update_store_name", expenseId=4, newStoreName="renamed"), book(s, d))[1].select("id", "storeName", "amount")


#: Numbers that hold the dialling code of advertisers count as advertisements.
ADVERT = "contains(storeName || ' ' || amount::VARCHAR, '080')"


@query("prefiltered_messages", f"SELECT id::VARCHAR AS id FROM expenses WHERE id % 5 = 0 AND NOT {ADVERT}")
def _(s, d):
    m, k = payments(s, d), F.col("id").cast("long") % 5
    body = F.when(k == 0, F.col("body")).when(k == 1, "[NH] no digits at all in this one, just words of a card").when(k == 2, F.concat(F.lit("(광고) [KB] "), F.col("body"))).when(k == 3, "short 12")
    return predicates.prefiltered(m.withColumn("body", body.otherwise(F.repeat("body", 5)))).select("id")


@query("propagated_categories", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT 1000000 + k, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) FROM range(0, 10) t(k))
SELECT vec_id::VARCHAR AS "storeName", CASE WHEN vec_id <> 0 AND vec_id % 7 <> 0 AND round(list_cosine_similarity(v, (SELECT v FROM v WHERE vec_id = 0)), 6) >= 0.9 THEN 'new' ELSE 'old' END AS category FROM v""", "")
def _(s, d):
    v = vectors_of(s, d)
    near = v.filter("id = 0").withColumn("id", F.explode(F.sequence(F.lit(1_000_000).cast("long"), F.lit(1_000_009).cast("long"))))
    v = v.unionByName(near.select(*v.columns)).withColumn("name", F.col("id").cast("string"))
    stores = v.select(F.col("name").alias("storeName"), F.lit("old").alias("category"), F.when(F.col("id") % 7 == 0, "user").otherwise("vector").alias("source"))
    pairs = matching.near_pairs(v.filter("id = 0").select(F.col("name").alias("left_id"), "vector"), v.select(F.col("name").alias("right_id"), "vector"), 0.9)
    return matching.propagate(stores, pairs, "0", "new", 0.8).select("storeName", "category")


# Requests with actions

REQUEST = """{"queries":[{"type":"total_expense","startDate":"1997-01-01","endDate":"1997-12-31"}],
 "actions":[{"type":"delete_expense","expenseId":33},{"type":"update_category","expenseId":7,"newCategory":"식비"},{"type":"delete_expense","expenseId":33},
 {"type":"add_sms_exclusion","searchKeyword":"sale"},{"type":"set_budget","category":"2-HIGH","amount":777}]}"""


@query("answered_actions", "SELECT * FROM (VALUES (1, 1::BIGINT), (2, 1), (3, 0), (4, 1), (5, 1)) t(step, affected) UNION ALL SELECT 0, sum(amount)::BIGINT FROM expenses WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01'")
def _(s, d):
    out = None
    for step, table in enumerate(dsl.answer(REQUEST, book(s, d))):
        one = table.toDF("affected").select(F.lit(step).alias("step"), F.col("affected").cast("long").alias("affected"))
        out = one if out is None else out.unionByName(one)
    return out


@query("ledger_after_actions", "SELECT id, CASE WHEN id = 7 THEN '식비' ELSE category END AS category FROM expenses WHERE id <> 33")
def _(s, d):
    return dsl.respond(REQUEST, book(s, d))[1].expenses.select("id", "category")


@query("deleted_rows_stay_away", "SELECT smsId AS id FROM expenses WHERE id % 2 = 0")
def _(s, d):
    # all messages are read again: stored ones and the deleted one are not new
    left = dsl.respond(REQUEST, dsl.replace(book(s, d), expenses=lg.expenses(s, d).filter("id % 2 = 1")))[1]
    messages = lg.expenses(s, d).select(F.col("smsId").alias("id"))
    return joins.unseen(messages, left.expenses.select("id", "smsId"), left.tombstones, messages.limit(0))


RULES = "id int, keyword string, category string, isFixed boolean, createdAt long"


@query("store_rule_changed", """
SELECT id, CASE WHEN lower(storeName) LIKE '%00007%' THEN '구독' WHEN lower(storeName) LIKE '%00001%' AND transaction_type <> 'TRANSFER' THEN 'found' ELSE category END AS category,
  CASE WHEN lower(storeName) LIKE '%00007%' THEN transfer_direction <> 'DEPOSIT' WHEN lower(storeName) LIKE '%00001%' THEN transfer_direction <> 'DEPOSIT' AND lower(storeName) LIKE '%000012%' ELSE is_fixed END AS is_fixed
FROM expenses""")
def _(s, d):
    rules = s.createDataFrame([(2, "00007", "구독", True, 20), (3, "000012", None, True, 5)], RULES)
    old, new = {"keyword": "00001", "category": "교통", "isFixed": True}, {"keyword": "00007", "category": "구독", "isFixed": True}
    return mu.change_store_rule(lg.expenses(s, d), rules, old, new, lambda rows: rows.select("id", F.lit("found").alias("category"))).select("id", "category", "is_fixed")


@query("store_rule_removed", "SELECT id, CASE WHEN lower(storeName) LIKE '%00001%' AND transaction_type <> 'TRANSFER' THEN '미분류' ELSE category END AS category, is_fixed FROM expenses")
def _(s, d):
    rules, m = s.createDataFrame([], RULES), s.createDataFrame([], "storeName string, category string")
    return mu.change_store_rule(lg.expenses(s, d), rules, {"keyword": "00001", "category": "교통"}, None, lambda rows: matching.categorize(rows.select("id", "storeName"), rules, m)).select("id", "category", "is_fixed")


@query("fixed_support", "SELECT id, transaction_type = 'EXPENSE' OR transfer_direction = 'WITHDRAWAL' AS supported FROM expenses")
def _(s, d):
    return lg.expenses(s, d).select("id", predicates.supports_fixed(F.col("transaction_type"), F.col("transfer_direction")).alias("supported"))


@query("classified_incomes", """
SELECT id, CASE WHEN id % 7 = 0 THEN 'kept' WHEN s = '하*현' THEN '이체' WHEN s = '김*' THEN coalesce(t, '미분류') ELSE coalesce(t, l, '미분류') END AS category
FROM (SELECT id, CASE id % 4 WHEN 0 THEN '하*현' WHEN 1 THEN '김*' WHEN 2 THEN 'shop' ELSE 'none' END AS s, CASE WHEN id % 4 = 1 THEN '급여' END AS t, CASE WHEN id % 4 = 2 THEN 'by label' END AS l FROM incomes)""", "i")
def _(s, d):
    k = F.col("id") % 4
    i = lg.incomes(s, d).withColumn("source", F.when(k == 0, "하*현").when(k == 1, "김*").when(k == 2, "shop").otherwise("none"))
    i = i.withColumn("type", F.when(k == 1, "월급").otherwise("other")).withColumn("category", F.when(F.col("id") % 7 == 0, "kept").otherwise("미분류"))
    labels = s.createDataFrame([("shop", "by label"), ("none", "미분류"), ("김*", "no")], "source string, category string")
    return mu.classify_incomes(i, {"월급": "급여"}, labels, ("김*",)).select("id", "category")


# Messages


@query("probed_failures", "SELECT id::VARCHAR AS id, id % 6 IN (0, 2, 3) AS probed FROM expenses")
def _(s, d):
    m, k = payments(s, d), F.col("id").cast("long") % 6
    body = F.when(k == 0, "결제 1,200원").when(k == 1, "결제 1,200원").when(k == 2, "우리(1234)승인 none").when(k == 3, "anything").when(k == 4, "1,200원 and no word").otherwise("카드 but no amount")
    return m.select("id", predicates.probed(F.when(k == 1, "accepted").otherwise("parse_failed"), F.when(k == 3, "1588-9955").otherwise("02-123"), body).alias("probed"))


@query("debit_fallbacks", "SELECT id::VARCHAR AS id, amount::INT AS amount, storeName AS \"storeName\", 'KB' AS \"cardName\", 3 AS tier FROM expenses WHERE id % 2 = 0")
def _(s, d):
    m = payments(s, d)
    other = F.when(F.col("id").cast("long") % 2 == 0, F.col("body")).otherwise(F.replace("body", F.lit("출금"), F.lit("승인")))
    return matching.debit_fallback(m.withColumn("body", other)).select("id", "amount", "storeName", "cardName", "tier")


@query("best_notifications", "SELECT id AS note_id, 'KB카드 01/02 10:11 결제 ' || amount::VARCHAR || '원' AS body FROM expenses")
def _(s, d):
    e = lg.expenses(s, d)
    texts = F.array(F.lit("KB카드"), F.concat(F.lit("KB카드 01/02 10:11 결제 "), F.col("amount").cast("string"), F.lit("원")), F.lit("  "), F.concat(F.col("amount").cast("string"), F.lit("원")))
    return predicates.best_notification(e.select(F.col("id").alias("note_id"), F.explode(texts).alias("body"))).select("note_id", "body")


@query("recoverable_messages", "SELECT id::VARCHAR AS id, id % 3 = 0 AS recoverable FROM expenses")
def _(s, d):
    k = F.col("id").cast("long") % 3
    return payments(s, d).select("id", extract.recoverable(F.when(k == 0, "승인 1,234").when(k == 1, "승인 12").otherwise("hello 1,234")).alias("recoverable"))


@query("inferred_types", "SELECT id::VARCHAR AS id, CASE id % 4 WHEN 0 THEN 'cancel' WHEN 1 THEN 'overseas' WHEN 2 THEN 'income' ELSE 'expense' END AS type, CASE id % 4 WHEN 2 THEN 3 ELSE 1 END AS lines FROM expenses")
def _(s, d):
    k = F.col("id").cast("long") % 4
    body = F.when(k == 0, "승인취소 USD").when(k == 1, "JPY 100 입금").when(k == 2, "a\n\n입금\n \n100").otherwise("승인 100")
    return payments(s, d).select("id", text.infer_type(body).alias("type"), text.filled_lines(body).alias("lines"))


@query("like_templates", "SELECT id::VARCHAR AS id, id % 3 <> 2 AS loose, id % 3 <> 1 AS structural FROM expenses")
def _(s, d):
    k, a = F.col("id").cast("long") % 3, "KB카드 {DATE} {TIME} 승인 {AMOUNT}"
    key = text.loose_template_key
    other = F.when(k == 0, "KB카드 {DATE} 승인 {AMOUNT}").when(k == 1, "KB카드 {DATE} 승인\n{AMOUNT}\n{STORE}\na\nb").otherwise("하나은행 {AMOUNT} 승인")
    return payments(s, d).select("id", text.loosely_equal(key(F.lit(a)), key(other)).alias("loose"), text.structurally_equal(F.lit(a), F.lit(a), other).alias("structural"))


@query("well_known_names", "SELECT id, CASE id % 3 WHEN 0 THEN '보험' WHEN 1 THEN '기타' END AS category FROM expenses")
def _(s, d):
    k = F.col("id") % 3
    return lg.expenses(s, d).select("id", text.pre_classify(F.when(k == 0, "삼성화재 자동").when(k == 1, "kcp pay").otherwise(F.col("storeName"))).alias("category"))


@query("answered_categories", "SELECT id, CASE id % 3 WHEN 0 THEN '식비' WHEN 1 THEN '카페/간식' ELSE '기타' END AS category FROM expenses")
def _(s, d):
    k = F.col("id") % 3
    return lg.expenses(s, d).select("id", text.normalize_category(F.when(k == 0, " 식비 ").when(k == 1, "이건 커피값").otherwise("???"), {"커피": "카페/간식"}).alias("category"))


@query("template_rules", "SELECT id::VARCHAR AS id, amount::VARCHAR AS amount, storeName AS \"storeName\" FROM expenses")
def _(s, d):
    pattern = text.template_regex("[KB]{DATE} {TIME}\n{CARD_NUM}\n{STORE}\n출금\n{AMOUNT}\n잔액{BALANCE}")
    pick = lambda name: F.regexp_extract("body", pattern, extract.group_index(pattern, name))
    return payments(s, d).select("id", pick("amount").alias("amount"), pick("store").alias("storeName"))


# Single values


@query("absent_filters", "SELECT id FROM expenses WHERE cardName = 'BUILDING'")
def _(s, d):
    return lg.expenses(s, d).filter(predicates.optional("cardName", "BUILDING") & predicates.optional("category", None)).select("id")


@query("similarity_policies", "SELECT vec_id AS id, s >= 0.92 AS auto, false AS nothing, s >= 0.8 AND s < 0.92 AS asked, s >= 0.9 AND vec_id % 2 = 0 AS spreads FROM (SELECT vec_id, (vec_id % 100) / 100.0 AS s FROM embeddings)", "")
def _(s, d):
    x, sure = (F.col("id") % 100) / 100, F.when(F.col("id") % 2 == 0, 0.6).otherwise(0.5)
    return vectors_of(s, d).select("id", predicates.similar(x, "store", "auto").alias("auto"), predicates.similar(x, "store", "unheard").alias("nothing"), predicates.needs_model(x).alias("asked"), predicates.may_propagate(x, sure).alias("spreads"))


@query("vectors_as_text", "SELECT vec_id AS id, len(embedding)::INT AS n, round(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS same FROM embeddings", "")
def _(s, d):
    v = vectors_of(s, d).withColumn("again", ve.from_json(ve.to_json(F.col("vector"))))
    return v.select("id", F.size("again").alias("n"), ve.cosine(F.col("vector"), F.col("again")).alias("same"))


@query("effective_months", "SELECT * FROM (VALUES (1, 1998, 8), (2, 1998, 9), (3, 1999, 1), (4, 1998, 12)) t(id, year, month)", "")
def _(s, d):
    asked = [(1, date(1998, 8, 18), 19), (2, date(1998, 8, 19), 19), (3, date(1998, 12, 25), 25), (4, date(1998, 12, 25), 1)]
    return s.createDataFrame([(i, *dates.effective_month(day, start)) for i, day, start in asked], "id int, year int, month int")


@query("sync_ranges", "SELECT * FROM (VALUES (1, 4816000000::BIGINT, 10000000000::BIGINT), (2, 9999600000, 10000000000), (3, 4729600000, 10000000000)) t(id, first, last)", "")
def _(s, d):
    now = 10_000_000_000
    return s.createDataFrame([(1, *dates.sync_range(None, now)), (2, *dates.sync_range(now - 100_000, now)), (3, *dates.sync_range(5, now, 1))], "id int, first long, last long")


@query("touched_months", "SELECT strftime(m, '%Y-%m') AS month FROM generate_series(DATE '1997-11-01', DATE '1998-02-01', INTERVAL 1 MONTH) t(m)", "")
def _(s, d):
    return s.createDataFrame([(m,) for m in dates.months_between(date(1997, 11, 30), date(1998, 2, 1))], "month string")


@query("backup_restored", "SELECT id, amount, memo, is_fixed, strftime(ts, '%Y-%m-%d') AS day FROM expenses")
def _(s, d):
    e = lg.expenses(s, d)
    folder = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getConf().get("spark.checkpoint.dir") or s.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/backup-{uuid.uuid4().hex[:12]}"
    backup.write_backup(e, path)
    return backup.read_backup(s, path, e).select("id", "amount", "memo", "is_fixed", F.date_format("ts", "yyyy-MM-dd").alias("day"))


# Streams' transforms, here on tables


@query("ingested_messages", f"SELECT id::VARCHAR AS id, 'PAYMENT' AS type FROM expenses WHERE id % 5 = 0 AND NOT {ADVERT}")
def _(s, d):
    m = payments(s, d)
    return ingest.transform(m.withColumn("body", F.when(F.col("id").cast("long") % 5 == 0, F.col("body")).otherwise("short"))).select("id", "type")


@query("live_totals", "SELECT category, sum(amount)::BIGINT AS total FROM expenses GROUP BY 1")
def _(s, d):
    return ingest.live_totals(lg.expenses(s, d))


@query("late_matches", "SELECT id AS note_id, id AS message_id FROM expenses WHERE id % 3 = 0")
def _(s, d):
    e = lg.expenses(s, d).withColumn("mark", F.concat(F.lit("<"), F.col("id").cast("string"), F.lit(">")))
    apart = F.when(F.col("id") % 3 == 0, 60_000).when(F.col("id") % 3 == 1, 200_000).otherwise(0)
    notes = e.select(F.col("id").alias("note_id"), F.when(F.col("id") % 3 == 2, "else").otherwise(F.col("mark")).alias("body"), F.col("dateTime").alias("ts_ms"))
    stored = e.select("id", F.concat(F.lit("a"), "mark", F.lit("b")).alias("body"), (F.col("dateTime") + apart).alias("date"))
    return ingest.late_matches(notes, stored).select("note_id", "message_id")


# Whole screens

MAY = "ts >= TIMESTAMP '1997-04-19' AND ts < TIMESTAMP '1997-05-19'"


@query("home_excluded", f"""
WITH now AS (SELECT * FROM expenses WHERE {MAY} AND NOT contains(lower('web ' || coalesce(memo, '-')), 'f')),
got AS (SELECT * FROM incomes WHERE {MAY} AND NOT contains(lower('from ' || type || ' f'), 'x'))
SELECT 'spent' AS part, '' AS key, coalesce(sum(amount), 0)::BIGINT AS amount FROM now
UNION ALL SELECT 'category', category, sum(amount)::BIGINT FROM now GROUP BY category
UNION ALL SELECT 'income', '', 0""", "ei")
def _(s, d):
    e = lg.expenses(s, d).withColumn("originalSms", F.concat(F.lit("Web "), F.coalesce("memo", F.lit("-"))))
    i = lg.incomes(s, d).withColumn("originalSms", F.concat(F.lit("From "), F.col("type")))  # every one holds the word
    return screens.home(e, i, 1997, 5, 19, s.createDataFrame([("F",)], "keyword string"))


@query("home_curves", """
WITH m AS (SELECT k, (DATE '1997-05-01' - (k || ' months')::INTERVAL)::DATE AS first, (DATE '1997-06-01' - (k || ' months')::INTERVAL)::DATE AS next FROM range(0, 4) t(k)),
g AS (SELECT k, first, r.range::INT AS day FROM m, range(0, 32) r),
p AS (SELECT k, (ts::DATE - first) + 1 AS day, sum(amount) AS t FROM m JOIN expenses ON ts >= first AND ts < next GROUP BY 1, 2),
c AS (SELECT g.k, g.day, sum(coalesce(t, 0)) OVER (PARTITION BY g.k ORDER BY g.day) AS cum FROM g LEFT JOIN p ON p.k = g.k AND p.day = g.day)
SELECT 'now' AS part, lpad(day::VARCHAR, 2, '0') AS key, cum::BIGINT AS amount FROM c WHERE k = 0
UNION ALL SELECT 'mean', lpad(day::VARCHAR, 2, '0'), (sum(cum) // 3)::BIGINT FROM c WHERE k > 0 GROUP BY day
UNION ALL SELECT 'budget', lpad(range::VARCHAR, 2, '0'), (3100000 * range // 31)::BIGINT FROM range(0, 32)""")
def _(s, d):
    return screens.home_curves(lg.expenses(s, d), 1997, 5, 1, 3_100_000)


@query("home_categories", """
WITH r AS (SELECT ts, amount, CASE category WHEN '1-URGENT' THEN '식비' WHEN '2-HIGH' THEN '2-HIGH' WHEN '3-MEDIUM' THEN '미분류' ELSE '기타' END AS category FROM expenses),
a AS (SELECT category, sum(amount)::BIGINT AS total FROM r WHERE ts >= TIMESTAMP '1997-05-01' AND ts < TIMESTAMP '1997-06-01' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3),
b AS (SELECT category, sum(amount)::BIGINT AS last_total FROM r WHERE ts >= TIMESTAMP '1997-04-01' AND ts < TIMESTAMP '1997-05-01' GROUP BY 1)
SELECT a.category, total, coalesce(last_total, 0)::BIGINT AS last_total FROM a LEFT JOIN b ON a.category = b.category""")
def _(s, d):
    raw = F.when(F.col("category") == "1-URGENT", "식비").when(F.col("category") == "3-MEDIUM", "미분류").otherwise(F.col("category"))
    return screens.home_categories(lg.expenses(s, d).withColumn("category", raw), 1997, 5, 1, ("2-HIGH",))


@query("history_days", """
WITH u AS (SELECT ts, amount AS spent, 0 AS got FROM expenses WHERE ts >= TIMESTAMP '1997-05-01' AND ts < TIMESTAMP '1997-06-01' AND NOT is_fixed AND NOT contains(lower(coalesce(memo, '') || 'sms'), 'f')
    AND ((transaction_type = 'EXPENSE' AND category IN ('1-URGENT', '2-HIGH')) OR transaction_type = 'TRANSFER')
  UNION ALL SELECT ts, 0, amount FROM incomes WHERE ts >= TIMESTAMP '1997-05-01' AND ts < TIMESTAMP '1997-06-01')
SELECT strftime(ts, '%Y-%m-%d') AS date, count(*)::BIGINT AS n, sum(spent)::BIGINT AS expense, sum(got)::BIGINT AS income FROM u GROUP BY 1""", "ei")
def _(s, d):
    e = lg.expenses(s, d).withColumn("originalSms", F.concat(F.coalesce("memo", F.lit("")), F.lit("sms")))
    shown = {"EXPENSE": ("1-URGENT", "2-HIGH"), "TRANSFER": None, "INCOME": None}
    return screens.history_days(e, lg.incomes(s, d), 1997, 5, 1, shown, "EXCLUDE_FIXED", s.createDataFrame([("F",)], "keyword string"))
