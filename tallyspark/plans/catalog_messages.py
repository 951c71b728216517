"""Registered queries of the message side: channels, rules, templates, vectors and edits, with their SQL.

Messages are written from the ledger's own rows, so that SQL knows what must be read from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, extract, text
from ..operators import aggregates as ag
from ..operators import clustering, joins, matching, predicates
from ..operators import mutations as mu
from ..sources import ledger as lg
from ..sources import messages as ms
from ..sources import rules as rl
from .catalog import query


def payments(s: SparkSession, d: str) -> DataFrame:
    """One bank message per expense: id, body, address, date."""
    e = lg.expenses(s, d)
    body = F.concat(F.lit("[KB]"), F.date_format("ts", "MM/dd HH:mm"), F.lit("\n1234*5678\n"), F.col("storeName"), F.lit("\n출금\n"), F.col("amount").cast("string"), F.lit("\n잔액100,000"))
    return e.select(F.col("id").cast("string").alias("id"), body.alias("body"), F.lit("1644-9999").alias("address"), F.col("dateTime").alias("date"), F.col("amount").alias("_amount"))


RULE = r"^\[KB\](\d\d/\d\d \d\d:\d\d)\n\d+\*\d+\n([^\n]+)\n출금\n([\d,]+)\n"
RULES = (
    '{"version":1,"sms_rules":{"16449999":{"expense":{'
    '"good":{"priority":700,"bodyRegex":"' + RULE.replace("\\", "\\\\") + '","amountGroup":"3","storeGroup":"2","cardGroup":"","dateGroup":"1"},'
    '"worse":{"priority":10,"bodyRegex":"(\\\\d+)","amountGroup":"1","storeGroup":"1"}},'
    '"income":{"no":{"priority":999,"bodyRegex":".*"}}},"1588":{"cancel":{"other":{"bodyRegex":"x"}}}}}'
)


@query("rule_matched_messages", "SELECT id::VARCHAR AS id, 'good' AS \"ruleKey\", amount::INT AS amount, storeName AS \"storeName\", 'KB' AS \"cardName\", strftime(ts, '%Y-%m-%d %H:%M') AS \"dateTime\" FROM expenses")
def _(s, d):
    rules = rl.indexed(matching.tuned_rules(rl.flatten(s.createDataFrame([(RULES,)], "json string")), 1_000))
    return matching.first_matches(matching.match_rules(payments(s, d), rules)).select("id", "ruleKey", "amount", "storeName", "cardName", "dateTime")


@query("rule_failures", "SELECT 'other' AS \"ruleKey\", 'regex_miss' AS reason, count(*)::BIGINT AS n FROM expenses")
def _(s, d):
    rules = rl.indexed(rl.flatten(s.createDataFrame([('{"sms_rules":{"16449999":{"cancel":{"other":{"bodyRegex":"^x"}}}}}',)], "json string")))
    return matching.match_rules(payments(s, d), rules).groupBy("ruleKey", "reason").agg(F.count(F.lit(1)).alias("n"))


TEMPLATE = "[KB]{DATE} {TIME}\n{CARD_NUM}\n{STORE}\n출금\n{AMOUNT}\n잔액{BALANCE}"


@query("templatized_messages", "SELECT '" + TEMPLATE + "' AS template, count(*)::BIGINT AS n FROM expenses")
def _(s, d):
    return payments(s, d).groupBy(text.templatize(F.col("body")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query("template_matched_messages", "SELECT id::VARCHAR AS id, 2 AS \"patternId\", 1 AS tier, amount::INT AS amount, storeName AS \"storeName\" FROM expenses")
def _(s, d):
    rows = [(1, "16449999", "unlike anything", r"(\d+)", r"(\w+)", "", 99, 0), (2, "1644-9999", TEMPLATE, r"\n([\d,]+)\n잔액", r"\n([^\n]+)\n출금", "", 5, 0), (3, "1588", TEMPLATE, "(x)", "(y)", "", 1, 0)]
    patterns = s.createDataFrame(rows, "patternId int, senderAddress string, smsTemplate string, amountRegex string, storeRegex string, cardRegex string, matchCount int, lastMatchedAt long")
    return matching.match_templates(payments(s, d), patterns).select("id", "patternId", "tier", "amount", "storeName")


@query("store_fallbacks", "SELECT id::VARCHAR AS id, storeName AS store FROM expenses")
def _(s, d):
    return payments(s, d).select("id", text.store_fallback(F.col("body")).alias("store"))


@query("grounded_answers", "SELECT id::VARCHAR AS id, id % 3 <> 0 AS grounded FROM expenses")
def _(s, d):
    m = payments(s, d)
    store = F.regexp_extract("body", r"\n([^\n]+)\n출금", 1)
    claimed = F.when(F.col("id").cast("long") % 3 == 0, F.col("_amount") + 10_000_000).otherwise(F.col("_amount"))
    return m.select("id", extract.grounded(F.col("body"), claimed, store).alias("grounded"))


@query("income_messages", "SELECT id, amount::INT AS amount, 'user' || (id % 50)::VARCHAR AS source, CASE type WHEN '급여' THEN '급여' WHEN '정산' THEN '정산' ELSE '이체' END AS kind, CASE type WHEN '급여' THEN '급여' WHEN '정산' THEN '더치페이' ELSE '미분류' END AS category FROM incomes WHERE amount >= 100", "i")
def _(s, d):
    i = lg.incomes(s, d).filter("amount >= 100")
    body = F.concat(F.lit("[KB]02/05 22:47\n123**456\nuser"), (F.col("id") % 50).cast("string"), F.lit("\n입금\n"), F.col("amount").cast("string"), F.lit("\n"), F.col("type"))
    kind = extract.income_type(F.col("body"))
    return i.withColumn("body", body).select("id", extract.income_amount(F.col("body")).alias("amount"), extract.income_source(F.col("body")).alias("source"), kind.alias("kind"), extract.income_category(kind).alias("category"))


@query("body_times", "SELECT id, strftime(ts, '%Y-%m-%d') || ' 07:30' AS written, strftime(ts, '%Y-%m-%d') || ' 07:30' AS strict FROM expenses")
def _(s, d):
    e = lg.expenses(s, d).withColumn("body", F.concat(F.date_format("ts", "MM/dd"), F.lit(" 07:30 shop")))
    return e.select("id", dates.format_minute(dates.body_time(F.col("body"), F.col("ts"))).alias("written"), dates.strict_body_time(F.col("body"), F.col("ts")).alias("strict"))


@query("corrected_years", "SELECT id, strftime(CASE WHEN id % 2 = 0 THEN make_timestamp(year(ts), 1, 1, 0, 0, 0) + (month(ts - INTERVAL 12 MONTH) - 1) * INTERVAL 1 MONTH + (day(ts - INTERVAL 12 MONTH) - 1) * INTERVAL 1 DAY ELSE ts + INTERVAL 3 DAY END, '%Y-%m-%d') AS day FROM expenses")
def _(s, d):
    e = lg.expenses(s, d)
    # even ids claim a time a year off (of 29 February its last day), odd ones three days off
    claimed = F.when(F.col("id") % 2 == 0, F.expr("ts - interval 12 months")).otherwise(F.expr("ts + interval 3 days"))
    return e.select("id", F.date_format(dates.corrected_year(claimed.cast("timestamp_ntz"), F.col("ts")), "yyyy-MM-dd").alias("day"))


@query("card_companies", "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'KB국민' WHEN 1 THEN 'KB국민' WHEN 2 THEN '신한' WHEN 3 THEN c_name WHEN 4 THEN '' ELSE 'NH농협' END AS card FROM customer", "")
def _(s, d):
    c = lg.table(s, d, "customer")
    k = F.col("c_custkey") % 6
    raw = F.when(k == 0, " kb카드 ").when(k == 1, "KB국민카드 노리").when(k == 2, "SOL").when(k == 3, F.concat(F.col("c_name"), F.lit(" "))).when(k == 4, "  ").otherwise("[Web발신]")
    body = F.when(k == 5, "[NH] 승인").otherwise("-")
    return c.select(F.col("c_custkey").alias("id"), text.card_with_fallback(raw, body).alias("card"))


@query("store_names", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '스타벅스' WHEN 1 THEN '쿠팡' WHEN 2 THEN NULL ELSE '맥도날드' END AS store, CASE c_custkey % 4 WHEN 0 THEN '카페/간식' WHEN 1 THEN '온라인쇼핑' WHEN 2 THEN '보험' ELSE '식비' END AS category FROM customer", "")
def _(s, d):
    c = lg.table(s, d, "customer")
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, "STARBUCKS 강남점").when(k == 1, "로켓배송").when(k == 2, "삼성화재").otherwise("맥날 역삼")
    known = F.when(k == 0, "스타벅스").when(k == 1, "쿠팡").when(k == 2, "보험").otherwise("맥도날드")
    return c.select(F.col("c_custkey").alias("id"), text.canonical_store(raw).alias("store"), text.infer_category(known, F.lit(""), {"카페/간식": ("스타벅스",), "온라인쇼핑": ("쿠팡",), "보험": ("보험",), "식비": ("맥도날드",)}).alias("category"))


@query("transfer_names", "SELECT c_custkey AS id, c_custkey % 4 IN (0, 1) AS transfer FROM customer", "")
def _(s, d):
    c = lg.table(s, d, "customer")
    k = F.col("c_custkey") % 4
    return c.select(F.col("c_custkey").alias("id"), text.is_transfer_name(F.when(k == 0, "하*현").when(k == 1, "자동이체 3월").when(k == 2, "쿠팡").otherwise(F.col("c_name"))).alias("transfer"))


# Channels


@query("mms_scan", "SELECT string_agg(text, '' ORDER BY turn) AS body, '15881111' AS address, (1700000000 + conv_id) * 1000 AS date FROM conversations WHERE text IS NOT NULL AND conv_id BETWEEN 10 AND 60 GROUP BY conv_id", "")
def _(s, d):
    c = lg.table(s, d, "conversations").filter("text IS NOT NULL")
    raw = c.select(F.col("conv_id").alias("mms_id"), (F.lit(1_700_000_000) + F.col("conv_id")).alias("date")).distinct()
    parts = c.select(F.col("conv_id").alias("mms_id"), F.col("turn").alias("part"), F.lit("text/plain").alias("content_type"), "text")
    senders = raw.select("mms_id", F.lit(0).alias("row"), F.lit(151).alias("kind"), F.lit("010-1").alias("address")).unionByName(raw.select("mms_id", F.lit(1).alias("row"), F.lit(137).alias("kind"), F.lit("15881111").alias("address")))
    return ms.scan_mms(raw, parts, senders, 1_700_000_010_000, 1_700_000_060_999).select("body", "address", "date")


@query("rcs_scan", "SELECT text AS body, 1700000000000 + conv_id * 1000 + turn AS date FROM conversations WHERE text IS NOT NULL AND trim(text) <> ''", "")
def _(s, d):
    c = lg.table(s, d, "conversations").filter("text IS NOT NULL AND trim(text) <> ''")
    nested = F.to_json(F.struct(F.lit(" ").alias("text"), F.struct(F.col("text").alias("description")).alias("card")))
    raw = c.select(F.lit("15881111").alias("address"), nested.alias("body"), (F.lit(1_700_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("date"))
    return ms.scan_rcs(raw, 0, 9_000_000_000_000).select("body", "date")


@query("joined_parts", "SELECT conv_id AS id, string_agg(text, '' ORDER BY turn) AS body FROM conversations WHERE text IS NOT NULL GROUP BY 1", "")
def _(s, d):
    c = lg.table(s, d, "conversations").filter("text IS NOT NULL")
    return ms.joined_parts(c.select(F.col("conv_id").alias("message"), F.col("turn").alias("part"), F.col("text").alias("body"), F.lit("a").alias("address"), F.col("turn").alias("date"))).select("id", "body")


@query("newest_per_channel", "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id AS channel, turn AS id FROM r WHERE n <= 3", "")
def _(s, d):
    c = lg.table(s, d, "conversations").select(F.col("conv_id").alias("channel"), F.col("turn").alias("id"), F.col("turn").alias("date"))
    return ms.newest_per_channel(c, 3).select("channel", "id")


@query("failure_samples", "SELECT sha256(cardName || '|' || category || '||') AS fingerprint, count(*)::BIGINT AS n, min(dateTime) AS first_seen, max(dateTime) AS last_seen FROM expenses GROUP BY 1")
def _(s, d):
    f = lg.expenses(s, d).select(F.col("cardName").alias("sender"), F.col("category").alias("type"), F.lit("").alias("template"), F.lit("").alias("reason"), F.col("dateTime").alias("date"))
    return ms.failure_samples(f).select("fingerprint", "n", "first_seen", "last_seen")


@query("probe_log", "SELECT id, regexp_replace(storeName, '[0-9]', '*', 'g') AS body FROM expenses WHERE dateTime >= 900000000000 - 7 * 86400000 AND id % 2 = 0")
def _(s, d):
    e = lg.expenses(s, d).filter("id % 2 = 0").select("id", F.col("storeName").alias("body"), F.col("dateTime").alias("createdAt"))
    return ms.probe_log(e.filter(F.lit(False)), e, 900_000_000_000).select("id", "body")


@query("unwanted_senders", "SELECT c_custkey AS id, c_custkey % 3 <> 2 AS unwanted FROM customer", "")
def _(s, d):
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, "+82 10-1234-5678").when(k == 1, "070.123").otherwise("1588-0000")
    return lg.table(s, d, "customer").select(F.col("c_custkey").alias("id"), predicates.unwanted_sender(raw).alias("unwanted"))


@query("pipeline_statistics", "SELECT count(*)::BIGINT AS input, count(*)::BIGINT AS payments, 0::BIGINT AS incomes, 0::BIGINT AS skipped, min(dateTime) AS first_date, max(dateTime) AS last_date FROM expenses")
def _(s, d):
    return ag.pipeline_statistics(predicates.classified(payments(s, d)))


@query("rule_health", "SELECT id, (id % 4 = 0 AND id % 20 >= 12) OR (id % 3 <> 0 AND 200 - id % 199 >= 120 AND id % 20 >= id % 4 + 8) AS failing FROM expenses")
def _(s, d):
    day = 86_400_000
    last = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.lit(1_000_000_000_000) - (F.lit(200) - F.col("id") % 199) * day)
    return lg.expenses(s, d).select("id", predicates.rule_failing((F.col("id") % 4).cast("int"), (F.col("id") % 20).cast("int"), last, 1_000_000_000_000).alias("failing"))


@query("rule_verdicts", "SELECT category, CASE WHEN avg(CASE WHEN amount % 10 < 7 THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'accept' WHEN avg(CASE WHEN amount % 10 < 7 THEN 1.0 ELSE 0.0 END) >= 0.6 THEN 'repair' ELSE 'abort' END AS verdict FROM expenses GROUP BY 1")
def _(s, d):
    return lg.expenses(s, d).groupBy("category").agg(ag.rule_verdict(ag.pass_ratio(F.col("amount") % 10 < 7)).alias("verdict"))


@query("notification_matches", "WITH n AS (SELECT event_id AS note_id, user_id % 50 AS k, epoch(date_trunc('second', ts::TIMESTAMP))::BIGINT * 1000 AS t FROM events WHERE event_type = 'purchase'), m AS (SELECT event_id AS id, user_id % 50 AS k, epoch(date_trunc('second', ts::TIMESTAMP))::BIGINT * 1000 AS t FROM events WHERE event_type = 'click'), j AS (SELECT note_id, id AS message_id, abs(n.t - m.t) AS distance FROM n JOIN m ON n.k = m.k AND abs(n.t - m.t) <= 120000) SELECT note_id, message_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY distance, message_id) AS r FROM j) WHERE r = 1", "")
def _(s, d):
    e = lg.table(s, d, "events").withColumn("t", lg.millis(F.col("ts"))).withColumn("k", F.concat(F.lit("<user "), (F.col("user_id") % 50).cast("string"), F.lit(">")))
    notes = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("note_id"), F.col("k").alias("body"), F.col("t").alias("ts_ms"))
    stored = e.filter("event_type = 'click'").select(F.col("event_id").alias("id"), F.concat(F.lit("x"), "k", F.lit("y")).alias("body"), F.col("t").alias("date"))
    return joins.notification_match(notes, stored)


# Vectors


def vectors(s: SparkSession, d: str) -> DataFrame:
    return lg.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label"))


@query("pattern_matches", "WITH m AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT * FROM m WHERE label < 8), j AS (SELECT m.vec_id AS left_id, p.vec_id AS right_id, round(list_cosine_similarity(m.v, p.v), 6) AS similarity FROM m JOIN p ON m.label = p.label OR m.label NOT IN (SELECT label FROM p)) SELECT left_id, right_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) AS k FROM j) WHERE k = 1", "")
def _(s, d):
    v = vectors(s, d)
    sender = F.concat(F.lit("1588-"), F.col("label").cast("string"))
    patterns = v.filter("label < 8").select(F.col("id").alias("patternId"), sender.alias("senderAddress"), "vector")
    return matching.match_patterns(v.withColumn("address", sender), patterns)


@query("message_routes", "SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN 'NON_PAYMENT' WHEN vec_id % 4 = 1 THEN 'MAIN' WHEN vec_id % 4 = 2 THEN 'EXCEPTION' ELSE 'UNMATCHED' END AS route FROM embeddings", "")
def _(s, d):
    v = vectors(s, d)
    k = F.col("id") % 4
    score = lambda at, high, low: v.select("id", F.when(k == at, high).otherwise(low).alias("similarity"))
    return matching.route(v, score(0, 0.98, 0.9), v.select("id", F.when(k <= 1, 0.93).otherwise(0.5).alias("similarity")), score(2, 0.95, 0.1).filter("id % 4 <> 3"))


@query("group_stability", """
WITH m AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT label, min(vec_id) AS r FROM m GROUP BY 1),
s AS (SELECT m.label AS "group", round(list_cosine_similarity(m.v, q.v), 6) AS c FROM m JOIN f ON m.label = f.label JOIN m q ON q.vec_id = f.r),
o AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY c) AS k, count(*) OVER (PARTITION BY "group") AS n FROM s),
t AS (SELECT "group", max(n) AS size, max(CASE WHEN k = floor(0.5 * (n - 1))::BIGINT + 1 THEN c END) AS median, max(CASE WHEN k = floor(0.2 * (n - 1))::BIGINT + 1 THEN c END) AS p20 FROM o GROUP BY 1)
SELECT "group", size::BIGINT AS size, median < 0.92 OR p20 < 0.88 AS unstable, CASE WHEN NOT (median < 0.92 OR p20 < 0.88) THEN 'RULE' WHEN size <= 10 THEN 'DIRECT' ELSE 'RESPLIT' END AS route FROM t""", "")
def _(s, d):
    v = vectors(s, d)
    first = v.groupBy("label").agg(F.min_by("vector", "id").alias("vector"))
    pairs = matching.similarities(v.select(F.col("id").alias("left_id"), "label", "vector"), first, ("label",)).select(F.col("label").alias("group"), "similarity")
    return clustering.group_route(clustering.stability(pairs)).select("group", "size", "unstable", "route")


@query("remote_rule_matches", "SELECT id::VARCHAR AS id, 1 AS \"ruleId\", amount::INT AS amount, storeName AS \"storeName\" FROM expenses")
def _(s, d):
    m = payments(s, d).withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    rows = [(1, "1644.9999", [1.0, 0.01], r"\n([\d,]+)\n잔액", r"\n([^\n]+)\n출금", "", None, None), (2, "16449999", [1.0, 0.0], "(no)", "(no)", "", None, None), (3, "16449999", [0.0, 1.0], r"(\d+)", r"(\w+)", "", 0.9, None), (4, "16449999", [1.0, 0.0], r"\n(\d+)\n", "(K)", "", 0.5, False)]
    rules = s.createDataFrame(rows, "ruleId int, senderAddress string, vector array<double>, amountRegex string, storeRegex string, cardRegex string, minSimilarity double, enabled boolean")
    return matching.remote_rules(m, rl.vector_rules(rules)).select("id", "ruleId", "amount", "storeName")


@query("clustered_senders")
def _(s, d):
    rows = vectors(s, d).select("id", F.col("id").alias("position"), F.col("label").cast("string").alias("sender"), "vector", (F.col("id") % 5).cast("string").alias("template"))
    return clustering.source_groups(clustering.cluster(rows, "sender", "seeded", 0.4))


# Edits


@query("store_rule_applied", "SELECT id, CASE WHEN lower(storeName) LIKE '%00001%' THEN '교통' ELSE category END AS category, CASE WHEN lower(storeName) LIKE '%00001%' THEN transfer_direction <> 'DEPOSIT' ELSE is_fixed END AS is_fixed FROM expenses")
def _(s, d):
    return mu.apply_store_rule(lg.expenses(s, d), "00001", "교통", True)[0].select("id", "category", "is_fixed")


@query("marked_transfers", "SELECT id, transaction_type, transfer_direction, category FROM (SELECT id, CASE WHEN storeName = 'Customer#000000010' THEN 'TRANSFER' ELSE transaction_type END AS transaction_type, CASE WHEN storeName = 'Customer#000000010' THEN 'WITHDRAWAL' ELSE transfer_direction END AS transfer_direction, CASE WHEN storeName = 'Customer#000000010' THEN '이체' ELSE '미분류' END AS category FROM expenses)")
def _(s, d):
    e = lg.expenses(s, d).withColumn("category", F.lit("미분류"))
    return mu.mark_transfers(e, "Customer#000000010", "이체", "WITHDRAWAL")[0].select("id", "transaction_type", "transfer_direction", "category")


@query("default_budgets", "SELECT category, max(amount) AS \"monthlyLimit\", 'default' AS \"yearMonth\" FROM (SELECT category, amount, row_number() OVER (PARTITION BY category ORDER BY ts DESC, id DESC) AS k FROM expenses) WHERE k = 1 GROUP BY 1")
def _(s, d):
    e = lg.expenses(s, d)
    # a month key that is unique, so that there is one latest budget
    key = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lpad(F.col("id").cast("string"), 12, "0"))
    return mu.budgets_to_default(e.select("category", F.col("amount").alias("monthlyLimit"), key.alias("yearMonth")))


@query("unique_incomes", "SELECT id FROM incomes WHERE id % 3 = 0 UNION ALL SELECT min(id) FROM incomes WHERE id % 3 <> 0 GROUP BY id % 100", "i")
def _(s, d):
    i = lg.incomes(s, d).withColumn("smsId", F.when(F.col("id") % 3 != 0, (F.col("id") % 100).cast("string")))
    return mu.unique_incomes(i).select("id")


@query("purged_patterns", "SELECT id FROM expenses WHERE NOT (dateTime < 800000000000 AND id % 4 <= 1)")
def _(s, d):
    p = lg.expenses(s, d).select("id", F.col("dateTime").alias("lastMatchedAt"), (F.col("id") % 4).alias("matchCount"))
    return mu.purge_patterns(p, 800_000_000_000).select("id")


@query("relabelled_stores", "SELECT DISTINCT storeName AS \"storeName\", CASE WHEN storeName LIKE '%3' THEN 'new' ELSE 'old' END AS category, CASE WHEN storeName LIKE '%3' THEN 0.99 ELSE 0.5 END::DOUBLE AS confidence FROM expenses")
def _(s, d):
    names = lg.expenses(s, d).select("storeName").distinct()
    stores = names.select("storeName", F.lit("old").alias("category"), F.lit(0.5).alias("confidence"), F.when(F.col("storeName").endswith("5"), "user").otherwise("local").alias("source"))
    labels = names.filter("storeName LIKE '%3' OR storeName LIKE '%5'").select("storeName", F.lit("new").alias("category"), F.lit(0.99).alias("confidence"))
    return mu.relabel_unsure(stores, labels).select("storeName", "category", "confidence")


@query("match_counts", "SELECT category AS id, count(*)::BIGINT AS \"matchCount\" FROM expenses GROUP BY 1 UNION ALL SELECT 'unused', 7")
def _(s, d):
    e = lg.expenses(s, d)
    patterns = e.select(F.col("category").alias("id")).distinct().select("id", F.lit(0).cast("long").alias("matchCount"), F.lit(0).cast("long").alias("lastMatchedAt"))
    patterns = patterns.unionByName(s.createDataFrame([("unused", 7, 0)], "id string, matchCount long, lastMatchedAt long"))
    return mu.count_matches(patterns, e.select(F.col("category").alias("pattern_id")), 5).select("id", "matchCount")


@query("replaced_rows", "SELECT id, CASE WHEN id % 9 = 0 THEN 'x' ELSE category END AS category FROM expenses")
def _(s, d):
    e = lg.expenses(s, d).select("id", "category")
    return mu.replace_rows(e, e.filter("id % 9 = 0").withColumn("category", F.lit("x")).unionByName(s.createDataFrame([(-5, "none")], e.schema)))


@query("exact_matches", "SELECT smsId AS \"smsId\", CASE WHEN id % 2 = 0 THEN id END AS stored_id, CASE WHEN id % 2 = 0 THEN memo END AS stored_memo FROM expenses")
def _(s, d):
    e = lg.expenses(s, d)
    return joins.exact(e.select("smsId"), e.filter("id % 2 = 0").select("smsId", "id", "memo"))


@query("resolved_categories", "SELECT CASE id % 5 WHEN 0 THEN '카페/간식' WHEN 1 THEN '식비' WHEN 2 THEN '기타' WHEN 3 THEN '미분류' ELSE 'my own' END AS category, sum(amount)::BIGINT AS total FROM expenses GROUP BY 1")
def _(s, d):
    from ..functions.categories import resolved

    k = F.col("id") % 5
    raw = F.when(k == 0, "카페").when(k == 1, "식비").when(k == 2, "who knows").when(k == 3, "AI 분류 중").otherwise("my own")
    return ag.total_by(lg.expenses(s, d), category=resolved(raw, True, ("my own",)))


@query("looked_up_categories", "SELECT CASE id % 3 WHEN 0 THEN '온라인쇼핑' WHEN 1 THEN '기타' ELSE 'mine' END AS resolved_category, count(*)::BIGINT AS n FROM expenses GROUP BY 1")
def _(s, d):
    from ..functions.categories import dimension

    k = F.col("id") % 3
    rows = lg.expenses(s, d).select("id", F.when(k == 0, "쇼핑").when(k == 1, "nothing").otherwise("mine").alias("category"))
    table = dimension(s, s.createDataFrame([("mine", "EXPENSE")], "name string, type string"))
    return joins.category_lookup(rows, table).groupBy("resolved_category").agg(F.count(F.lit(1)).alias("n"))


@query("budget_total", "SELECT sum(monthlyLimit)::BIGINT AS total FROM budgets WHERE yearMonth = 'default'", "b")
def _(s, d):
    return lg.budgets(s).filter("yearMonth = 'default'").agg(F.sum("monthlyLimit").alias("total"))


@query("coverage_by_day", "SELECT id, CASE WHEN id % 2 = 0 THEN 'FULL' ELSE 'PARTIAL' END AS status FROM expenses")
def _(s, d):
    from ..operators.windows import coverage_by_day

    e = lg.expenses(s, d).select("id")
    # each row's own span of days, far from the others'; odd ones lack their second day
    day = F.col("id") * 10 * 86_400_000
    targets = e.select("id", day.alias("start"), (day + 3 * 86_400_000 - 1).alias("end"))
    covered = e.select((day + 5000).alias("start"), F.when(F.col("id") % 2 == 0, day + 86_400_000 + 7).otherwise(day + 9000).alias("end"))
    return coverage_by_day(targets, covered.unionByName(e.select((day + 2 * 86_400_000 + 1).alias("start"), (day + 2 * 86_400_000 + 2).alias("end"))))


@query("period_bounds", "SELECT * FROM (VALUES (1, '1998-08-01 00:00:00', '1998-08-02 12:00:00'), (2, '1997-01-01 00:00:00', '1997-02-01 23:59:59'), (3, '1970-01-01 00:00:00', '1998-08-02 12:00:00')) t(id, first, last)", "")
def _(s, d):
    from .catalog import NOW

    asked = [(1, None, None), (2, "1997-01-01", "1997-02-01"), (3, "not a day", "neither")]
    rows = [(i, *(f"{t:%Y-%m-%d %H:%M:%S}" for t in dates.period(a, b, NOW))) for i, a, b in asked]
    return s.createDataFrame(rows, "id int, first string, last string")
