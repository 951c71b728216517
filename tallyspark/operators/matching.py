"""Rules, templates and vectors against messages, and the category cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.dates import group_time
from ..functions.extract import digits, group, parsed
from ..functions.text import (
    bank_tag,
    infer_category,
    loose_template_key,
    loosely_equal,
    newlines,
    normalize_sender,
    normalize_sender_dotted,
    pre_classify,
    sanitize_store,
    store_fallback,
    store_or_debit,
    structurally_equal,
    templatize,
)
from ..functions.vectors import dot, unit
from ..sources.ledger import wall_clock
from .joins import mapped_category, store_rules
from .predicates import rule_failing, rule_priority, rule_usable


def tuned_rules(rules: DataFrame, now_ms: int, most: int = 5) -> DataFrame:
    """Active rules: failing ones retired, priorities by record, ``most`` per sender and type."""
    active = rules.filter(rule_usable(F.col("type"), F.col("status")) & ~rule_failing(F.col("matchCount"), F.col("failCount"), F.col("lastMatchedAt"), now_ms))
    scored = active.withColumn("priority", rule_priority(F.col("priority"), F.col("type"), F.col("matchCount"), F.col("failCount"), F.col("lastMatchedAt"), now_ms))
    order = Window.partitionBy("senderAddress", F.lower("type")).orderBy(F.desc("priority"), F.desc("lastMatchedAt"), F.desc("updatedAt"), "ruleKey")
    return scored.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def match_rules(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Every attempt of a sender's rules on its messages: id, ruleKey, type, matched, reason, and what was read.

    Rules carry group numbers (amountIndex, storeIndex, cardIndex, dateIndex; 0 for none) resolved when they were loaded.
    The join is by sender; rules are few per sender, and Spark broadcasts them below its size limit.
    """
    m = messages.withColumn("senderAddress", normalize_sender(F.col("address"))).withColumn("_body", newlines(F.col("body")))
    # a step of its own for whatever is used more than once: each pattern runs once a pair
    pick = lambda index: F.when(F.col(index) > 0, group(F.col("_body"), F.col("bodyRegex"), F.col(index)))
    j = m.join(rules, "senderAddress").withColumn("_hit", F.rlike(F.col("_body"), F.col("bodyRegex")))
    j = j.withColumn("_amount", F.when(F.col("_hit"), digits(pick("amountIndex")))).withColumn("_raw", F.when(F.col("_hit"), sanitize_store(pick("storeIndex"))))
    j = j.withColumn("_named", store_or_debit(F.col("_raw"), F.col("_body")))
    j = j.withColumn("_store", F.coalesce("_named", F.when(F.col("_hit") & F.col("_named").isNull(), store_fallback(F.col("_body")))))
    card = F.when(F.col("_hit"), F.coalesce(pick("cardIndex"), bank_tag(F.col("_body")), F.lit(lx.OTHER)))
    when = F.when(F.col("_hit"), group_time(F.coalesce(pick("dateIndex"), F.lit("")), F.col("_body"), wall_clock(F.col("date"))))
    paid = F.coalesce(F.col("_amount") > 0, F.lit(False))
    reason = F.when(~F.col("_hit"), "regex_miss").when(~paid, "invalid_amount").when(F.col("_store").isNull(), "invalid_store").otherwise("")
    return j.select(
        "id", "senderAddress", "ruleKey", "type", "priority", "lastMatchedAt", "updatedAt", (F.col("_hit") & paid & F.col("_store").isNotNull()).alias("matched"), reason.alias("reason"),
        F.col("_amount").alias("amount"), F.col("_store").alias("storeName"), card.alias("cardName"), when.alias("dateTime"),
    )


def first_matches(attempts: DataFrame) -> DataFrame:
    """Per message the result of its first rule that matched: by priority, then last match, then update."""
    order = F.struct((-F.col("priority")).alias("p"), (-F.col("lastMatchedAt")).alias("m"), (-F.col("updatedAt")).alias("u"), F.col("ruleKey").alias("k"))
    best = attempts.filter("matched").groupBy("id").agg(F.min_by(F.struct("ruleKey", "type", "amount", "storeName", "cardName", "dateTime"), order).alias("_r"))
    return best.select("id", "_r.*")


def match_templates(messages: DataFrame, patterns: DataFrame, most: int = 20, structural: int = 12) -> DataFrame:
    """Per message the best of its sender's patterns that parses: equal template, then loosely, then structurally equal."""
    own = patterns.filter((F.col("amountRegex") != "") & (F.col("storeRegex") != "")).withColumn("senderAddress", normalize_sender(F.col("senderAddress")))
    rank = Window.partitionBy("senderAddress").orderBy(F.desc("matchCount"), F.desc("lastMatchedAt"), "patternId")
    own = own.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= most)
    own = own.withColumn("_own_key", loose_template_key(F.col("smsTemplate")))
    m = messages.withColumn("senderAddress", normalize_sender(F.col("address"))).withColumn("_template", templatize(newlines(F.col("body"))))
    m = m.withColumn("_key", loose_template_key(F.col("_template")))
    j = m.join(own, "senderAddress")
    loose = loosely_equal(F.col("_key"), F.col("_own_key"))
    tier = F.when(F.col("_template") == F.col("smsTemplate"), 1).when(loose, 2).when(structurally_equal(F.col("body"), F.col("_template"), F.col("smsTemplate")) & (F.col("_n") <= structural), 3)
    j = j.withColumn("tier", tier)
    j = j.withColumn("_p", F.when(F.col("tier").isNotNull(), parsed(F.col("body"), wall_clock(F.col("date")), F.col("amountRegex"), F.col("storeRegex"), F.col("cardRegex"))))
    # pairs that don't parse have no place in the order
    place = F.when(F.col("_p").isNotNull(), F.struct("tier", "_n"))
    best = j.groupBy("id").agg(F.min_by(F.struct("patternId", "tier", "_p"), place).alias("_r")).filter("_r IS NOT NULL")
    return best.select("id", F.col("_r.patternId").alias("patternId"), F.col("_r.tier").alias("tier"), "_r._p.*")


def similarities(left: DataFrame, right: DataFrame, keys: tuple[str, ...], least: float | None = None) -> DataFrame:
    """Cosines (rounded to 6) of pairs of (left_id, vector) and (right_id, vector) that agree in ``keys``; ``near_pairs`` is for those without keys.

    Vectors are brought to length 1 once per row.
    """
    a = left.withColumn("_a", unit(F.col("vector"))).drop("vector")
    b = right.withColumn("_b", unit(F.col("vector"))).drop("vector")
    out = a.join(b, list(keys)).withColumn("similarity", F.when(F.size("_a") == F.size("_b"), F.round(dot(F.col("_a"), F.col("_b")), 6)).otherwise(0.0)).drop("_a", "_b")
    return out if least is None else out.filter(F.col("similarity") >= least)


#: Rows of a block of vectors; a task meets two blocks.
BLOCK = 4_096
#: Rows whose products with a block are held at once.
ROWS = 512


def near_pairs(left: DataFrame, right: DataFrame, least: float | None = None, best_only: bool = False, skip_equal: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """(left_id, right_id, similarity) of vectors whose cosine (rounded to 6) is ``least`` or more, or each left row's best.

    Both sides are dealt into blocks by a hash of their ids, within ``keys`` if there are some (null keys
    meet nothing); every two blocks meet in one task as a matrix product, and only what is kept leaves it,
    so a key of any size is many tasks. Vectors that are null or hold null or non-finite components, and pairs of
    other lengths, take no part. ``best_only``
    ties go to the smaller right id; ``skip_equal`` leaves out a row's own id. Ids may be of any type.
    """
    keys = list(keys)
    kinds = {name: rows.schema[name].dataType.simpleString() for name, rows in (("left_id", left), ("right_id", right))}
    if keys:
        blocks = lambda rows, n: rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n))
        sizes = blocks(left, "_p").join(blocks(right, "_q"), keys)
        left, right = left.join(sizes, keys), right.join(sizes, keys)
    else:
        n = [F.lit(max(1, -(-rows.count() // BLOCK))) for rows in (left, right)]
        left, right = (rows.withColumn("_p", n[0]).withColumn("_q", n[1]) for rows in (left, right))

    def side(rows: DataFrame, name: str, own: str, other: str) -> DataFrame:
        own_names = [F.col(c).alias(c) for c in (*keys, "vector", "_p", "_q")]  # new columns, as both sides may be one table
        plain = rows.filter("vector IS NOT NULL").select(*own_names, F.col(name).alias("id"), F.size("vector").alias("d"))
        block = F.pmod(F.xxhash64("id"), F.col(f"_{own}")).cast("int").alias(own)
        return plain.select(*keys, "id", "vector", "d", block, F.explode(F.sequence(F.lit(0), F.col(f"_{other}") - 1)).alias(other))

    x, y = side(left, "left_id", "p", "q"), side(right, "right_id", "q", "p")

    def meet(f, g):
        import numpy as np
        import pandas as pd

        def units(t):
            v = np.stack(t["vector"].to_numpy()).astype(np.float64) if len(t) else np.zeros((0, 0))
            sound = np.isfinite(v).all(axis=1)
            n = np.linalg.norm(v[sound], axis=1)[:, None]
            return t["id"].to_numpy()[sound], np.divide(v[sound], n, out=np.zeros((len(n), v.shape[1])), where=n > 0)

        (ids, u), (others, v) = units(f), units(g.sort_values("id"))
        kept = [(ids[:0], others[:0], np.zeros(0))]
        for k in range(0, len(u) if len(v) else 0, ROWS):
            own = ids[k : k + ROWS]
            s = u[k : k + ROWS] @ v.T
            if skip_equal:
                s[own[:, None] == others[None, :]] = -np.inf
            # what may be kept once it is rounded
            i, j = np.nonzero(s >= (s.max(axis=1)[:, None] if best_only else least if least is not None else -1) - 2e-6)
            c = np.round(s[i, j], 6)
            if best_only:
                top = np.full(len(own), -np.inf)
                np.maximum.at(top, i, c)
                at = np.nonzero(np.isfinite(c) & (c == top[i]))[0]
                at = at[np.unique(i[at], return_index=True)[1]]  # a row's first has the smallest id
            else:
                at = np.nonzero(c >= (least if least is not None else -1))[0]
            kept.append((own[i[at]], others[j[at]], c[at]))
        return pd.DataFrame(dict(zip(("left_id", "right_id", "similarity"), map(np.concatenate, zip(*kept, strict=True)), strict=True)))

    found = x.groupBy(*keys, "p", "q", "d").cogroup(y.groupBy(*keys, "p", "q", "d")).applyInPandas(meet, f"left_id {kinds['left_id']}, right_id {kinds['right_id']}, similarity double")
    return best_match(found) if best_only else found


def best_match(pairs: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """Per left row its most similar right row, ties to the smaller id."""
    best = pairs.groupBy(left).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col(right).alias("r"))).alias("_m"))
    return best.select(left, F.col("_m.r").alias(right), (-F.col("_m.s")).alias("similarity"))


def match_patterns(messages: DataFrame, patterns: DataFrame) -> DataFrame:
    """Messages with the most similar pattern of their sender, or of all senders if theirs has none: left_id, right_id, similarity.

    Either way vectors meet in blocks (``near_pairs``). Within a sender a pattern of another length, or none, counts 0, and one that
    can't be compared for its components comes last (NaN), so every message of a known sender has a row.
    """
    a = messages.withColumn("sender", normalize_sender_dotted(F.col("address"))).select(F.col("id").alias("left_id"), "sender", "vector")
    b = patterns.withColumn("sender", normalize_sender_dotted(F.col("senderAddress"))).select(F.col("patternId").alias("right_id"), "sender", "vector")
    known = b.select(F.col("sender").alias("_known")).distinct()
    homeless = a.join(known, F.col("sender") == F.col("_known"), "left_anti")
    # of a sender's patterns the smallest ids of two lengths: one of them is of another length than a message, if any is
    length = F.coalesce(F.size("vector"), F.lit(-1))
    lengths = b.groupBy("sender", length.alias("n")).agg(F.min("right_id").alias("r"))
    firsts = lengths.groupBy("sender").agg(F.slice(F.array_sort(F.collect_list(F.struct("r", "n"))), 1, 2).alias("_firsts"))
    other = F.filter("_firsts", lambda x: (x["n"] < 0) | (x["n"] != length))
    plain = F.array(F.struct(F.get(other, 0)["r"].alias("r"), F.lit(0.0).alias("s")), F.struct(F.get("_firsts", 0)["r"].alias("r"), F.lit(float("nan")).alias("s")))
    rest = a.join(firsts, "sender").select("left_id", F.explode(plain).alias("_p")).select("left_id", F.col("_p.r").alias("right_id"), F.col("_p.s").alias("similarity")).filter("right_id IS NOT NULL")
    own = best_match(near_pairs(a, b, best_only=True, keys=("sender",)).unionByName(rest))
    return own.unionByName(near_pairs(homeless.drop("sender"), b.drop("sender"), best_only=True))


def route(messages: DataFrame, non_payment: DataFrame, main: DataFrame, exception: DataFrame) -> DataFrame:
    """Each message's route by the similarity of its best pattern of three kinds (id, similarity): first hit wins."""
    j = messages.select("id")
    for name, table in (("_non", non_payment), ("_main", main), ("_exc", exception)):
        j = j.join(table.select("id", F.col("similarity").alias(name)), "id", "left")
    s = lx.SIMILARITY
    chosen = F.when(F.col("_non") >= s["sms_non_payment"], "NON_PAYMENT").when(F.col("_main") >= s["sms_confirm"], "MAIN").when(F.col("_exc") >= s["sms_confirm"], "EXCEPTION").otherwise("UNMATCHED")
    return j.select("id", chosen.alias("route"))


def remote_rules(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Per message the most similar rule of its sender that is near enough for that rule and parses: id, ruleId, similarity, and what was read."""
    a = messages.withColumn("sender", normalize_sender_dotted(F.col("address"))).select("id", "body", "date", "sender", "vector")
    b = rules.filter(F.coalesce("enabled", F.lit(True)) & (F.col("amountRegex") != "") & (F.col("storeRegex") != "")).select(
        "ruleId", normalize_sender_dotted(F.col("senderAddress")).alias("sender"), "vector", "amountRegex", "storeRegex", "cardRegex", F.coalesce("minSimilarity", F.lit(lx.SIMILARITY["remote_rule"])).alias("_least")
    )
    j = similarities(a, b, ("sender",)).filter(F.col("similarity") >= F.col("_least"))
    j = j.withColumn("_p", parsed(F.col("body"), wall_clock(F.col("date")), F.col("amountRegex"), F.col("storeRegex"), F.col("cardRegex"))).filter("_p IS NOT NULL")
    best = j.groupBy("id").agg(F.min_by(F.struct("ruleId", "similarity", "_p"), F.struct((-F.col("similarity")).alias("s"), "ruleId")).alias("_r"))
    return best.select("id", F.col("_r.ruleId").alias("ruleId"), F.col("_r.similarity").alias("similarity"), "_r._p.*")


def group_vote(pairs: DataFrame, least: float = lx.SIMILARITY["store_group"]) -> DataFrame:
    """Per left row the majority category among its near right rows."""
    from .aggregates import majority

    return majority(pairs.filter(F.col("similarity") >= least).withColumnRenamed("left_id", "store"), "store")


def propagate(stores: DataFrame, pairs: DataFrame, source_name: str, category: str, confidence: float) -> DataFrame:
    """Stores near a confirmed one take its category: never the user's own, itself or equal ones."""
    near = pairs.filter((F.col("left_id") == source_name) & (F.col("similarity") >= lx.SIMILARITY["store_propagate"])).select(F.col("right_id").alias("storeName"), F.lit(True).alias("_near"))
    j = stores.join(near, "storeName", "left")
    change = F.coalesce("_near", F.lit(False)) & (F.col("source") != "user") & (F.col("storeName") != source_name) & (F.col("category") != category) & F.lit(confidence >= lx.SIMILARITY["propagate_confidence"])
    return j.select(*(F.when(change, F.lit(category)).otherwise(F.col("category")).alias("category") if c == "category" else F.when(change, F.lit("propagated")).otherwise(F.col("source")).alias("source") if c == "source" else F.col(c) for c in stores.columns))


def categorize(rows: DataFrame, rules: DataFrame, mappings: DataFrame, vector_labels: DataFrame | None = None, votes: DataFrame | None = None, words: dict | None = None) -> DataFrame:
    """Rows with (category, tier): shop rule, mapping, best vector at 0.92, group vote at 0.88, well-known name, word, unclassified."""
    kept = [c for c in rows.columns if c not in ("category", "tier")]
    if "originalSms" not in rows.columns and kept != ["storeName"]:
        # without messages a name decides: each is looked up once
        names = categorize(rows.select("storeName").distinct(), rules, mappings, vector_labels, votes, words)
        out = rows.select(*kept).join(names, "storeName", "left")
        return out.select(*kept, F.coalesce("category", F.lit(lx.UNCLASSIFIED)).alias("category"), F.coalesce("tier", F.lit("none")).alias("tier"))
    s = lx.SIMILARITY
    r = mapped_category(store_rules(rows, rules), mappings)
    if vector_labels is not None:
        r = r.join(vector_labels.filter(F.col("similarity") >= s["store_auto"]).select("storeName", F.col("category").alias("_vector")), "storeName", "left")
    if votes is not None:
        r = r.join(votes.filter(F.col("similarity") >= s["store_group"]).select("storeName", F.col("category").alias("_vote")), "storeName", "left")
    word = F.nullif(infer_category(F.col("storeName"), F.col("originalSms") if "originalSms" in rows.columns else F.lit(""), words), F.lit(lx.UNCLASSIFIED))
    tiers = [("rule", F.col("rule_category")), ("mapping", F.col("mapped_category"))]
    tiers += [("vector", F.col("_vector"))] if vector_labels is not None else []
    tiers += [("group", F.col("_vote"))] if votes is not None else []
    tiers += [("name", pre_classify(F.col("storeName"))), ("word", word)]
    category, tier = F.coalesce(*(c for _, c in tiers), F.lit(lx.UNCLASSIFIED)), F.coalesce(*(F.when(c.isNotNull(), n) for n, c in tiers), F.lit("none"))
    return r.select(*(F.col(c) for c in kept), category.alias("category"), tier.alias("tier"))


def debit_fallback(messages: DataFrame, card: str = "KB") -> DataFrame:
    """Debit messages of several lines that no rule and no pattern read (id, body, date): what they say, at tier 3 with full confidence."""
    own = messages.filter(F.col("body").contains("[KB]") & F.col("body").contains("\n출금\n"))
    got = own.withColumn("_p", parsed(F.col("body"), wall_clock(F.col("date")), F.lit(lx.DEBIT_AMOUNT), F.lit(lx.DEBIT_SHOP), F.lit(""), card))
    return got.filter("_p IS NOT NULL").select("id", "_p.amount", "_p.storeName", "_p.cardName", "_p.dateTime", F.lit(3).alias("tier"), F.lit(1.0).alias("confidence"))
