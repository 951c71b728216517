"""Joins of messages, rules, mappings and budgets with the ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.categories import resolved
from ..functions.text import all_aliases, any_of, content_key, parse_message_id
from .predicates import few, holds, pieces, within

#: A message and its stored row are the same if their times differ by this much at most.
MARGIN_MS = 10_000


def with_content_key(rows: DataFrame, sms_id: str = "smsId") -> DataFrame:
    """Rows with (content_key, message_ms) from their ids."""
    p = parse_message_id(F.col(sms_id))
    return rows.withColumn("content_key", content_key(p["address"], p["hash"])).withColumn("message_ms", p["date"])


def exact(new: DataFrame, stored: DataFrame, key: str = "smsId") -> DataFrame:
    """New rows with the stored row's id, memo and createdAt (null if new)."""
    s = stored.select(key, F.col("id").alias("stored_id"), F.col("memo").alias("stored_memo"))
    return new.join(s, key, "left")


def near(left: DataFrame, right: DataFrame, margin_ms: int = MARGIN_MS) -> DataFrame:
    """All pairs with the same content_key within the margin: id, other_id, distance.

    Times are dealt into buckets of the margin; a row meets its own and the two beside it, so a key
    with many rows is joined by (key, bucket) and not as one.
    """
    bucket = F.floor(F.col("message_ms") / margin_ms)
    a = left.select(F.col("id").alias("id"), "content_key", F.col("message_ms").alias("_t"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    b = right.select(F.col("id").alias("other_id"), "content_key", F.col("message_ms").alias("_u"), bucket.alias("_b"))
    distance = F.abs(F.col("_t") - F.col("_u"))
    return a.join(b, ["content_key", "_b"]).filter(distance <= margin_ms).select("id", "other_id", distance.alias("distance"))


def nearest(left: DataFrame, right: DataFrame, margin_ms: int = MARGIN_MS) -> DataFrame:
    """Per row of ``left`` the nearest of ``right`` within the margin, ties to the smaller id."""
    best = near(left, right, margin_ms).groupBy("id").agg(F.min(F.struct("distance", "other_id")).alias("_m"))
    return best.select("id", F.col("_m.other_id").alias("other_id"), F.col("_m.distance").alias("distance"))


def unseen(messages: DataFrame, stored: DataFrame, tombstones: DataFrame, pending: DataFrame) -> DataFrame:
    """Messages to read: not deleted by the user, and not stored (exactly or nearly) unless still pending."""
    live = messages.join(tombstones.select(F.col("smsId").alias("id")).distinct(), "id", "left_anti")
    known_exact = live.join(stored.select(F.col("smsId").alias("id")).distinct(), "id", "left_semi").select("id")
    keyed = with_content_key(live.select("id", F.col("id").alias("smsId")))
    known_near = near(keyed, with_content_key(stored.select("id", "smsId"))).select("id")
    gone = known_exact.unionByName(known_near).distinct().join(pending.select("id").distinct(), "id", "left_anti")
    return live.join(gone, "id", "left_anti")


def without_conflicts(stored: DataFrame, new: DataFrame, key: str = "smsId") -> DataFrame:
    """Stored rows of one kind whose message has now become the other kind are removed."""
    return stored.join(new.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def store_rules(rows: DataFrame, rules: DataFrame, policy: str = "newest") -> DataFrame:
    """Rows with the rule (rule_category, rule_fixed) whose keyword their shop holds: the newest, or the longest keyword.

    Shops are matched once per distinct name: with a few rules each by each, with many by equal pieces.
    """
    names = rows.select("storeName").distinct().withColumn("_lower", F.lower("storeName"))
    r = rules.select(F.lower("keyword").alias("_k"), F.col("category").alias("rule_category"), F.col("isFixed").alias("rule_fixed"), F.col("createdAt").alias("_at"), F.col("id").alias("_rid"))
    order = F.struct("_at", "_rid") if policy == "newest" else F.struct(F.length("_k"), "_at", "_rid")
    hit = names.join(F.broadcast(r), F.col("_lower").contains(F.col("_k"))) if few(r) else pieces(names, "_lower", r, "_k")
    best = hit.groupBy("storeName").agg(F.max_by(F.struct("rule_category", "rule_fixed"), order).alias("_r"))
    return rows.join(best, "storeName", "left").select(*(rows[c] for c in rows.columns), F.col("_r.rule_category").alias("rule_category"), F.col("_r.rule_fixed").alias("rule_fixed"))


def mapped_category(stores: DataFrame, mappings: DataFrame) -> DataFrame:
    """Shops (storeName) with the category of their mapping: exact, else the first (by name) that contains or is contained.

    A few mappings are tried on every name; many meet the names by equal pieces, either way.
    """
    m = mappings.select(F.col("storeName").alias("_m"), F.col("category").alias("_c"))
    names = stores.select("storeName").distinct()
    exact_hit = names.join(m, F.col("storeName") == F.col("_m"), "left").select("storeName", F.col("_c").alias("_exact"))
    rest = exact_hit.filter("_exact IS NULL").select("storeName")
    if few(m):
        hit = rest.join(F.broadcast(m), F.col("storeName").contains(F.col("_m")) | F.col("_m").contains(F.col("storeName")))
    else:
        hit = pieces(rest, "storeName", m, "_m").unionByName(pieces(m, "_m", rest, "storeName"))
    partial = hit.groupBy("storeName").agg(F.min_by("_c", "_m").alias("_partial"))
    found = exact_hit.join(partial, "storeName", "left").select("storeName", F.coalesce("_exact", "_partial").alias("mapped_category"))
    return stores.join(found, "storeName", "left")


def budget_status(expenses: DataFrame, budgets: DataFrame, first: datetime, last: datetime) -> DataFrame:
    """Per calendar month of a range and budget: limit, spent (within both), remaining, state.

    Spending is added up per month and category before it meets the budgets.
    """
    per = expenses.filter(within("ts", first, last)).groupBy(F.date_format("ts", "yyyy-MM").alias("month"), resolved(F.col("category"), strict=False).alias("category")).agg(F.sum("amount").alias("spent"))
    whole = per.groupBy("month").agg(F.sum("spent").alias("spent")).withColumn("category", F.lit(lx.EVERYTHING))
    spent = per.unionByName(whole.select("month", "category", "spent"))
    months = expenses.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first.strftime("%Y-%m-01")).cast("date"), F.lit(last.strftime("%Y-%m-01")).cast("date"), F.expr("interval 1 month"))).alias("_m")
    ).select(F.date_format("_m", "yyyy-MM").alias("month"))
    limits = budgets.filter("yearMonth = 'default'").select("category", F.col("monthlyLimit").cast("long").alias("budget_limit"))
    out = months.crossJoin(limits).join(spent, ["month", "category"], "left")  # months times budgets
    used = F.coalesce("spent", F.lit(0)).cast("long")
    return out.select("month", "category", "budget_limit", used.alias("spent"), (F.col("budget_limit") - used).alias("remaining"), F.when(F.col("budget_limit") >= used, "남음").otherwise("초과").alias("state"))


def category_lookup(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """Rows with resolved_category: the dimension's name, else other."""
    d = dimension.select("name").distinct()
    return rows.withColumn("_r", resolved(F.col("category"), strict=False)).join(d, F.col("_r") == F.col("name"), "left").select(
        *(rows[c] for c in rows.columns), F.coalesce("name", F.lit(lx.OTHER)).alias("resolved_category")
    )


def with_last_month(top: DataFrame, before: DataFrame) -> DataFrame:
    """Category totals with those of the month before, 0 if none."""
    b = before.select("category", F.col("total").alias("last_total"))
    return top.join(b, "category", "left").select("category", "total", F.coalesce("last_total", F.lit(0)).alias("last_total"))


def by_alias(rows: DataFrame, keyword: str) -> DataFrame:
    """Rows whose shop holds any spelling of the shop that the keyword names, each once."""
    return rows.filter(any_of(F.lower("storeName"), [a.lower() for a in all_aliases(keyword)]))


def notification_match(notes: DataFrame, provider: DataFrame, window_ms: int = 120_000) -> DataFrame:
    """Notifications (note_id, body, ts_ms) with the nearest stored message (id, body, date) whose body holds theirs or is held, within two minutes."""
    b = F.floor(F.col("ts_ms") / window_ms)
    n = notes.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    p = provider.select(F.col("id").alias("message_id"), F.col("body").alias("_body"), F.col("date").alias("_date"), F.floor(F.col("date") / window_ms).alias("_b"))
    distance = F.abs(F.col("ts_ms") - F.col("_date"))
    hit = n.join(p, "_b").filter((distance <= window_ms) & (F.col("body").contains(F.col("_body")) | F.col("_body").contains(F.col("body"))))
    return hit.groupBy("note_id").agg(F.min(F.struct(distance.alias("d"), "message_id")).alias("_m")).select("note_id", F.col("_m.message_id").alias("message_id"), F.col("_m.d").alias("distance"))


def fan_out(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of representatives given to all members: (representative, members) with (storeName, category)."""
    return groups.join(labels.withColumnRenamed("storeName", "representative"), "representative").select(F.explode("members").alias("storeName"), "category")


def keyword_hits(rows: DataFrame, keyword: str, columns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | holds(F.col(c), keyword)
    return out
