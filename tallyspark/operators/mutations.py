"""Edits of the ledger as functions of tables: each returns (new table, one-row table of affected rows)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import all_aliases, any_of, is_transfer_name
from .joins import store_rules
from .predicates import EXPENSE_SEARCH, search, supports_fixed
from .windows import repeats, without_repeats

Edit = tuple[DataFrame, DataFrame]


def _count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("affected"))


def update(rows: DataFrame, where: Column, **values) -> Edit:
    """Set columns of the rows that a condition holds for."""
    hit = F.coalesce(where, F.lit(False))
    new = rows.select(*(F.when(hit, values[c] if isinstance(values[c], Column) else F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))
    return new, _count(rows.filter(hit))


def delete(rows: DataFrame, where: Column) -> Edit:
    """Remove the rows that a condition holds for; rows for which it is unknown stay."""
    hit = F.coalesce(where, F.lit(False))
    return rows.filter(~hit), _count(rows.filter(hit))


def set_category(rows: DataFrame, expense_id: int, category: str) -> Edit:
    return update(rows, F.col("id") == expense_id, category=category)


def set_category_by_store(rows: DataFrame, store: str, category: str) -> Edit:
    """All spellings of the shop; only spending, no transfers. Each row counts once."""
    return update(rows, (F.col("transaction_type") == "EXPENSE") & any_of(F.lower("storeName"), [a.lower() for a in all_aliases(store)]), category=category)


set_category_by_keyword = set_category_by_store


def delete_expense(rows: DataFrame, tombstones: DataFrame, expense_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the row, the tombstones with its message id, and the count."""
    gone = rows.filter(F.col("id") == expense_id)
    return rows.filter(~F.coalesce(F.col("id") == expense_id, F.lit(False))), tombstones.select("smsId").unionByName(gone.select("smsId").filter("smsId <> ''")).distinct(), _count(gone)


def delete_by_keyword(rows: DataFrame, keyword: str) -> Edit:
    return delete(rows, search(keyword, EXPENSE_SEARCH))


DUPLICATE_KEYS = ("amount", "storeName", "ts")


def delete_duplicates(rows: DataFrame, keys: tuple[str, ...] = DUPLICATE_KEYS) -> Edit:
    """One row of each key stays: that with the least id."""
    return without_repeats(rows, keys), _count(repeats(rows, keys))


def add_expense(rows: DataFrame, new_id: int, store: str, amount: int, ts: str, card: str = "수동입력", category: str = lx.UNCLASSIFIED, memo: str | None = None) -> Edit:
    """A row entered by hand; without a shop or a positive amount nothing is added."""
    spark = rows.sparkSession
    good = bool(store.strip()) and amount > 0
    values = {"id": new_id, "amount": amount, "storeName": store, "category": category, "cardName": card, "ts": ts, "memo": memo, "transaction_type": "EXPENSE", "transfer_direction": "", "is_fixed": False}
    new = spark.range(1 if good else 0).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema))
    return rows.unionByName(new), _count(new)


def set_memo(rows: DataFrame, expense_id: int, memo: str | None) -> Edit:
    return update(rows, F.col("id") == expense_id, memo=memo)


def set_store(rows: DataFrame, expense_id: int, store: str) -> Edit:
    return update(rows, F.col("id") == expense_id, storeName=store) if store.strip() else (rows, _count(rows.filter(F.lit(False))))


def set_amount(rows: DataFrame, expense_id: int, amount: int) -> Edit:
    return update(rows, F.col("id") == expense_id, amount=F.lit(amount).cast("long")) if amount > 0 else (rows, _count(rows.filter(F.lit(False))))


def add_exclusion(keywords: DataFrame, keyword: str, source: str = "chat") -> Edit:
    """A keyword in lower case; one that exists, or a blank one, adds nothing."""
    k = keyword.strip().lower()
    new = keywords.sparkSession.range(1 if k else 0).select(F.lit(k).alias("keyword"), F.lit(source).alias("source")).join(keywords.select("keyword"), "keyword", "left_anti")
    return keywords.unionByName(new.select(*keywords.columns)), _count(new)


def remove_exclusion(keywords: DataFrame, keyword: str) -> Edit:
    """Without the keyword, unless it came with the product."""
    return delete(keywords, (F.col("keyword") == keyword.strip().lower()) & (F.col("source") != "default"))


def set_budget(budgets: DataFrame, category: str, limit: int) -> Edit:
    """The limit of a category for every month; it takes the place of any other."""
    new = budgets.sparkSession.range(1).select(F.lit(category).alias("category"), F.lit(limit).cast("long").alias("monthlyLimit"), F.lit("default").alias("yearMonth"))
    return upsert(budgets, new, ("category",)), _count(new)


def upsert(rows: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """New rows take the place of those with their keys; of new rows with one key the last in column order stays."""
    others = [c for c in rows.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_v")).select(*keys, *(F.col(f"_v.{c}").alias(c) for c in others))
    return rows.join(one, list(keys), "left_anti").select(*rows.columns).unionByName(one.select(*rows.columns))


def insert_new(rows: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """New rows are added unless their keys exist."""
    others = [c for c in rows.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_v")).select(*keys, *(F.col(f"_v.{c}").alias(c) for c in others))
    return rows.unionByName(one.join(rows.select(*keys), list(keys), "left_anti").select(*rows.columns))


def replace_rows(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Whole rows replaced by key; keys that don't exist add nothing."""
    hit = new.join(rows.select(key), key, "left_semi")
    return rows.join(hit.select(key), key, "left_anti").select(*rows.columns).unionByName(hit.select(*rows.columns))


def reconcile(new: DataFrame, stored: DataFrame, key: str = "smsId", keep: tuple[str, ...] = ("id", "memo", "createdAt")) -> DataFrame:
    """New rows that are stored already keep the stored id, memo and creation time, null or not."""
    s = stored.select(key, *(F.col(c).alias(f"_{c}") for c in keep), F.lit(True).alias("_hit"))
    j = new.join(s, key, "left")
    return j.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in new.columns))


def apply_store_rule(rows: DataFrame, keyword: str, category: str | None, fixed: bool | None) -> Edit:
    """A shop rule on what is stored: rows whose shop holds the keyword take its category and fixed state, where given; rows that can't be fixed costs are none."""
    values = {} if category is None else {"category": category}
    if fixed is not None:
        values["is_fixed"] = supports_fixed(F.col("transaction_type"), F.col("transfer_direction")) & F.lit(fixed)
    return update(rows, F.lower("storeName").contains(keyword.lower()), **values)


def change_store_rule(rows: DataFrame, rules: DataFrame, old: dict | None, new: dict | None, classify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored rows after a shop rule changed from ``old`` to ``new`` (keyword, category, isFixed; None for none).

    Where the old rule's fixed state or category no longer holds, rows of its keyword get the fixed state of the
    ``rules`` there are now, and those that are no transfers the category that ``classify`` (rows to id, category) finds. Then the new rule applies.
    """
    lower = lambda r: (r["keyword"] if r else "").lower()
    gone = lambda k: old is not None and old.get(k) is not None and (new is None or new.get(k) is None or lower(old) != lower(new))
    hit = F.lower("storeName").contains(lower(old)) if old else F.lit(False)
    columns = rows.columns
    if gone("isFixed"):
        can = supports_fixed(F.col("transaction_type"), F.col("transfer_direction"))
        fixed = F.when(hit, can & F.coalesce("rule_fixed", F.lit(False))).otherwise(F.col("is_fixed"))
        rows = store_rules(rows, rules).withColumn("is_fixed", fixed).select(*columns)
    if gone("category"):
        found = classify(rows.filter(hit & (F.col("transaction_type") != "TRANSFER"))).select("id", F.col("category").alias("_found"))
        rows = rows.join(found, "id", "left").withColumn("category", F.coalesce("_found", "category")).select(*columns)
    return rows if new is None else apply_store_rule(rows, new["keyword"], new.get("category"), new.get("isFixed"))[0]


def classify_incomes(incomes: DataFrame, by_type: dict[str, str], labels: DataFrame, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """Unclassified incomes (source, type, category) by steps, each for all unclassified rows of a source.

    A masked name or a word of transfers makes a source a transfer, unless it is among ``exceptions``; then a type that
    ``by_type`` knows decides (of several the last by id); then ``labels`` (source, category), where not unclassified.
    """
    open_ = F.col("category") == lx.UNCLASSIFIED
    moved = open_ & is_transfer_name(F.col("source")) & ~F.col("source").isin(*exceptions) if exceptions else open_ & is_transfer_name(F.col("source"))
    first = incomes.withColumn("category", F.when(moved, "이체").otherwise(F.col("category")))
    known = F.coalesce(*(F.when(F.col("type") == t, c) for t, c in by_type.items()), F.lit(None).cast("string"))
    typed = first.filter(open_).withColumn("_known", known).filter("_known IS NOT NULL").groupBy("source").agg(F.max_by("_known", "id").alias("_typed"))
    named = labels.filter(F.col("category") != lx.UNCLASSIFIED).select("source", F.col("category").alias("_label"))
    got = first.join(typed, "source", "left").join(named, "source", "left")
    return got.withColumn("category", F.when(open_, F.coalesce("_typed", "_label", "category")).otherwise(F.col("category"))).select(*incomes.columns)


def mark_transfers(rows: DataFrame, store: str, category: str, direction: str) -> Edit:
    """Unclassified rows of a shop become transfers."""
    return update(rows, (F.col("storeName") == store) & (F.col("category") == lx.UNCLASSIFIED), category=category, transaction_type="TRANSFER", transfer_direction=direction)


def expense_to_income(expenses: DataFrame, incomes: DataFrame, expense_id: int, kind: str = "이체") -> tuple[DataFrame, DataFrame]:
    """A row moved from expenses to incomes."""
    row = expenses.filter(F.col("id") == expense_id)
    has = {"amount": F.col("amount"), "type": F.lit(kind), "source": F.col("storeName"), "ts": F.col("ts"), "dateTime": F.col("dateTime"), "memo": F.col("memo"), "id": F.col("id"), "isRecurring": F.col("is_fixed")}
    moved = row.select(*(has.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in incomes.schema))
    return expenses.filter(F.col("id") != expense_id), incomes.unionByName(moved)


def budgets_to_default(budgets: DataFrame) -> DataFrame:
    """Monthly budgets as budgets of every month: per category the latest month's."""
    return budgets.groupBy("category").agg(F.max_by("monthlyLimit", "yearMonth").alias("monthlyLimit")).withColumn("yearMonth", F.lit("default"))


def unique_incomes(incomes: DataFrame, key: str = "smsId") -> DataFrame:
    """One income per message id: the least id; rows without one stay."""
    return incomes.filter(F.col(key).isNull()).unionByName(without_repeats(incomes.filter(F.col(key).isNotNull()), (key,)))


def purge_patterns(patterns: DataFrame, before_ms: int) -> DataFrame:
    """Without patterns that are old and matched once at most."""
    return patterns.filter(~F.coalesce((F.col("lastMatchedAt") < before_ms) & (F.col("matchCount") <= 1), F.lit(False)))


def relabel_unsure(stores: DataFrame, labels: DataFrame, below: float = 0.95) -> DataFrame:
    """Shops of low confidence take a new label, never those that the user labelled."""
    fresh = labels.select("storeName", F.col("category").alias("_c"), F.col("confidence").alias("_p"))
    open_ = (F.col("confidence") < below) & (F.col("source") != "user") & F.col("_c").isNotNull()
    j = stores.join(fresh, "storeName", "left")
    return j.select(*(F.when(open_, F.col("_c")).otherwise(F.col("category")).alias("category") if c == "category" else F.when(open_, F.col("_p")).otherwise(F.col("confidence")).alias("confidence") if c == "confidence" else F.col(c) for c in stores.columns))


def count_matches(patterns: DataFrame, hits: DataFrame, now_ms: int, key: str = "id") -> DataFrame:
    """Patterns with their hits added to matchCount and lastMatchedAt set."""
    per = hits.groupBy(F.col("pattern_id").alias(key)).agg(F.count(F.lit(1)).alias("_n"))
    j = patterns.join(per, key, "left")
    return j.select(*(F.col(c) + F.coalesce("_n", F.lit(0)) if c == "matchCount" else F.when(F.col("_n").isNotNull(), F.lit(now_ms)).otherwise(F.col(c)) if c == "lastMatchedAt" else F.col(c) for c in patterns.columns)).toDF(*patterns.columns)


def record_attempts(rules: DataFrame, attempts: DataFrame, now_ms: int, keys: tuple[str, ...] = ("senderAddress", "type", "ruleKey"), cap: int = 1_000_000) -> DataFrame:
    """Rules with their matches and failures of a batch added (up to a cap)."""
    per = attempts.groupBy(*keys).agg(F.count(F.when(F.col("matched"), 1)).alias("_ok"), F.count(F.when(~F.col("matched"), 1)).alias("_bad"))
    j = rules.join(per, list(keys), "left")
    values = {
        "matchCount": F.least(F.lit(cap), F.col("matchCount") + F.coalesce("_ok", F.lit(0))), "failCount": F.least(F.lit(cap), F.col("failCount") + F.coalesce("_bad", F.lit(0))),
        "lastMatchedAt": F.when(F.col("_ok") > 0, F.lit(now_ms)).otherwise(F.col("lastMatchedAt")),
    }
    return j.select(*(values.get(c, F.col(c)).alias(c) for c in rules.columns))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
