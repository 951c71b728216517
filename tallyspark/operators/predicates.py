"""Filters of the ledger and of the message cascade; all are pushed down or stay in generated code."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import any_of, first_of, normalize_sender, trim_space

#: Keywords or mappings up to this number are broadcast and tried on every text; more are found by equal pieces.
FEW = 64


def within(column: str, first: datetime, last: datetime) -> Column:
    """An inclusive range of local times on the raw column, so that scans can prune by it."""
    stamp = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return F.col(column).between(stamp(first), stamp(last))


def optional(column: str, value) -> Column:
    """Equality with a value that may be absent: no value lets every row pass."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)


def holds(column: Column, keyword: str) -> Column:
    """Substring test of any case; wildcard marks in the keyword mean themselves. Null doesn't match."""
    return F.coalesce(F.lower(column).contains(keyword.lower()), F.lit(False))


def search(keyword: str, columns: tuple[str, ...]) -> Column:
    """Whether any of the columns holds the keyword."""
    out = F.lit(False)
    for c in columns:
        out = out | holds(F.col(c), keyword)
    return out


EXPENSE_SEARCH = ("storeName", "category", "cardName", "memo")
INCOME_SEARCH = ("type", "source", "memo", "category", "description")


def either_holds(a: Column, b: Column) -> Column:
    """Containment one way or the other."""
    return a.contains(b) | b.contains(a)


def few(rows: DataFrame) -> bool:
    """Whether a table has ``FEW`` rows at most."""
    return rows.limit(FEW + 1).count() <= FEW


def pieces(texts: DataFrame, text: str, keys: DataFrame, key: str) -> DataFrame:
    """Pairs of rows of ``texts`` and ``keys`` whose ``text`` holds ``key``, as often as it does; the columns' names differ.

    Every piece of a text that is as long as some key meets the keys by equality, so no text meets all keys. Null holds and is held by nothing.
    """
    size = F.col("_piece_size")
    sizes = keys.agg(F.collect_set(F.length(key)).alias("_piece_sizes"))  # one row
    cut = texts.crossJoin(F.broadcast(sizes)).withColumn("_piece_size", F.explode("_piece_sizes")).filter(size <= F.length(text))
    last = F.when(size == 0, 1).otherwise(F.length(text) - size + 1)
    cut = cut.withColumn("_piece_at", F.explode(F.sequence(F.lit(1), last))).withColumn("_piece", F.substring(F.col(text), F.col("_piece_at"), size))
    return cut.join(keys, F.col("_piece") == F.col(key)).drop("_piece_sizes", "_piece_size", "_piece_at", "_piece")


def without_keywords(rows: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """Rows whose text holds no exclusion keyword (lower case); null texts stay.

    A few keywords are broadcast and tried on every text; many meet the distinct texts by equal pieces.
    """
    k = keywords.select(F.lower("keyword").alias("_keyword")).filter("_keyword <> ''").distinct()
    own = F.lower(F.col(text))
    if few(k):
        return rows.join(F.broadcast(k), own.contains(F.col("_keyword")), "left_anti")
    gone = pieces(rows.select(own.alias("_lower")).distinct(), "_lower", k, "_keyword").select("_lower").distinct()
    return rows.join(gone, own == F.col("_lower"), "left_anti")


def visible(row_type: Column, category: Column, shown: dict[str, tuple[str, ...] | None]) -> Column:
    """Visibility by kind: ``shown`` maps EXPENSE, INCOME and TRANSFER to their categories; None shows all, absent none."""
    out = F.lit(False)
    for kind, names in shown.items():
        out = out | ((row_type == kind) & (F.lit(True) if names is None else category.isin(*names)))
    return out


def fixed_filter(mode: str) -> Column:
    """ALL, FIXED_ONLY or EXCLUDE_FIXED."""
    return {"FIXED_ONLY": F.col("is_fixed"), "EXCLUDE_FIXED": ~F.col("is_fixed")}.get(mode, F.lit(True))


def export_filter(first: datetime | None = None, last: datetime | None = None, cards: tuple[str, ...] = (), categories: tuple[str, ...] = ()) -> Column:
    """Rows to export: each condition that is given."""
    out = F.lit(True)
    if first is not None and last is not None:
        out = out & within("ts", first, last)
    if cards:
        out = out & F.col("cardName").isin(*cards)
    if categories:
        out = out & F.col("category").isin(*categories)
    return out


def unwanted_sender(address: Column) -> Column:
    """Personal numbers: 010 and 070 in national form, whatever the message says."""
    n = normalize_sender(address)
    return n.startswith("010") | n.startswith("070")


def not_payment(body: Column) -> Column:
    """The keyword prefilter: patterns that rule out, then words that protect, then words that rule out."""
    low = F.lower(body)
    never = body.rlike("|".join(lx.NEVER_PAYMENT_PATTERNS))
    return F.when(never, True).when(any_of(low, lx.INCOME_PROTECTION_WORDS), False).otherwise(any_of(low, [w.lower() for w in lx.NON_PAYMENT_WORDS]))


def no_payment_shape(body: Column) -> Column:
    """The structural prefilter: length, digits, links without payment words, neither hint nor amount."""
    link = body.rlike("(?i)https?://") & ~body.contains("결제") & ~body.contains("승인")
    hint = any_of(F.lower(body), [w.lower() for w in lx.PAYMENT_HINTS]) | body.rlike(r"[\d,]+원")
    return ~F.length(body).between(lx.MIN_LENGTH, lx.MAX_LENGTH) | ~body.rlike(r"\d{2,}") | link | ~hint


def prefiltered(messages: DataFrame) -> DataFrame:
    """Messages that may speak of a payment."""
    return messages.filter(~not_payment(F.col("body")) & ~no_payment_shape(F.col("body")))


def classification(body: Column, user_words: tuple[str, ...] = ()) -> Column:
    """struct<type, reason> of a message: PAYMENT, INCOME or SKIP by the first rule that applies."""
    low = F.lower(body)
    out = lambda kind, reason: F.struct(F.lit(kind).alias("type"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    amount = body.rlike(r"[\d,]+원") | body.rlike(r"\n[\d,]{3,}\n")
    excluded, by_user = first_of(low, lx.CLASSIFIER_EXCLUDE_WORDS), first_of(low, user_words) if user_words else F.lit(None).cast("string")
    return (
        F.when(body.isNull() | (trim_space(body) == ""), out("SKIP", "blank"))
        .when(F.length(body) > lx.MAX_LENGTH, out("SKIP", F.concat(F.lit("tooLong("), F.length(body).cast("string"), F.lit(")"))))
        .when(excluded.isNotNull(), out("SKIP", F.concat(F.lit("excludeKw["), excluded, F.lit("]"))))
        .when(by_user.isNotNull(), out("SKIP", F.concat(F.lit("userExcludeKw["), by_user, F.lit("]"))))
        .when(~any_of(low, lx.FINANCIAL_WORDS), out("SKIP", "noFinancialKw"))
        .when(~amount, out("SKIP", "noAmount"))
        .when(any_of(low, lx.CANCEL_WORDS), out("INCOME", "cancel"))
        .when(any_of(low, lx.INCOME_EXCLUDE_WORDS), out("SKIP", "incomeExclude"))
        .when(any_of(low, lx.PAYMENT_WORDS), out("PAYMENT", "paymentKw"))
        .when(any_of(low, lx.INCOME_WORDS), out("INCOME", "incomeKw"))
        .otherwise(out("PAYMENT", "fallback"))
    )


def classified(messages: DataFrame, user_words: tuple[str, ...] = ()) -> DataFrame:
    """Messages with (type, reason); split by type with a filter."""
    return messages.withColumn("_c", classification(F.col("body"), user_words)).select(*messages.columns, F.col("_c.type").alias("type"), F.col("_c.reason").alias("reason"))


def rule_usable(kind: Column, status: Column) -> Column:
    return (status == "ACTIVE") & ((trim_space(kind) == "") | F.lower(kind).isin(*lx.RULE_TYPES))


def rule_failing(matches: Column, fails: Column, last_matched_ms: Column, now_ms: int) -> Column:
    """Rules to retire: a dozen failures and no match, or stale for 120 days with failures ahead by eight."""
    stale = (last_matched_ms > 0) & (F.lit(now_ms) - last_matched_ms >= 120 * 86_400_000)
    return ((matches == 0) & (fails >= 12)) | (stale & (fails >= matches + 8))


def rule_priority(priority: Column, kind: Column, matches: Column, fails: Column, last_matched_ms: Column, now_ms: int) -> Column:
    """A rule's priority by its record: 8 a match, -9 a failure, and a bonus for recent use, within 0 and 1000."""
    base = F.coalesce(*(F.when(F.lower(kind) == k, F.lit(v)) for k, v in lx.RULE_PRIORITY.items()), F.lit(600))
    age = F.lit(now_ms) - last_matched_ms
    day = 86_400_000
    bonus = F.when(last_matched_ms <= 0, 0).when(age <= 7 * day, 40).when(age <= 30 * day, 20).when(age <= 90 * day, 5).otherwise(-20)
    return F.least(F.lit(1000), F.greatest(F.lit(0), F.greatest(priority, base) + matches * 8 - fails * 9 + bonus))


def looks_financial(text: Column, hints: tuple[str, ...] = lx.PAYMENT_HINTS) -> Column:
    """A notification with an amount and a word of money."""
    return text.rlike(r"[\d,]+\s*원") & any_of(F.lower(text), [h.lower() for h in hints])


def notification_score(body: Column, most: int = lx.MAX_LENGTH) -> Column:
    """How much a candidate body looks like a payment: amount, words, date, time and length."""
    flat = F.regexp_replace(body, "\n", " ")
    n = F.length(flat)
    points = lambda test, p: F.when(test, p).otherwise(0)
    return (
        points(flat.rlike(r"[\d,]+\s*원"), 40) + points(any_of(F.lower(flat), [h.lower() for h in lx.PAYMENT_HINTS]), 30) + points(flat.rlike(r"\d{1,2}[/.-]\d{1,2}"), 10)
        + points(flat.rlike(r"\d{1,2}:\d{2}"), 15) + points(n.between(15, most), 10) - F.greatest(F.lit(0), n - most)
    )


def similar(similarity: Column, policy: str, purpose: str) -> Column:
    """Whether a similarity is enough for a purpose; purposes without a threshold never are."""
    limit = lx.SIMILARITY.get(f"{policy}_{purpose}", 0)
    return similarity >= limit if limit > 0 else F.lit(False)


def needs_model(similarity: Column) -> Column:
    """The band between too far and near enough, which a language model decides."""
    return (similarity >= lx.SIMILARITY["sms_llm"]) & (similarity < lx.SIMILARITY["sms_confirm"])


def may_propagate(similarity: Column, confidence: Column) -> Column:
    return (similarity >= lx.SIMILARITY["store_propagate"]) & (confidence >= lx.SIMILARITY["propagate_confidence"])


def supports_fixed(kind: Column, direction: Column) -> Column:
    """Whether a row can be a fixed cost: spending, and transfers that are withdrawals."""
    return (kind == "EXPENSE") | ((kind == "TRANSFER") & (direction == "WITHDRAWAL"))


def probed(stage: Column, address: Column, body: Column) -> Column:
    """Whether a channel's failure is worth a sample: from the kept sender, or it looks like a payment."""
    text = F.lower(F.trim(F.regexp_replace(body, r"\s+", " ")))
    hinted = any_of(text, [w.lower() for w in (*lx.TRANSACTION_HINTS, *lx.FINANCE_HINTS)])
    payment = text.contains(lx.PROBED_PHRASE.lower()) | text.rlike(lx.PROBED_PATTERN) | (text.rlike(r"[\d,]+원") & hinted)
    return ~stage.isin(*lx.QUIET_STAGES) & ((normalize_sender(address) == lx.PROBED_SENDER) | F.coalesce(payment, F.lit(False)))


def best_notification(candidates: DataFrame) -> DataFrame:
    """Per notification (note_id) of its candidate texts (body) the one most like a payment; of equals the shorter, then the first by text. Blank ones are none."""
    rows = candidates.withColumn("body", F.trim("body")).filter("body <> ''")
    order = F.struct(notification_score(F.col("body")).alias("s"), (-F.length("body")).alias("n"))
    scored = rows.groupBy("note_id", "body").agg(F.first(order).alias("o"))
    best = scored.groupBy("note_id").agg(F.max("o").alias("o"))
    return scored.join(best, ["note_id", "o"]).groupBy("note_id").agg(F.min("body").alias("body"), F.max("o.s").alias("score"))
