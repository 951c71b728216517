"""Extraction of amounts, shops, cards and sources from messages."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .dates import body_time, format_minute
from .text import any_of, bank_tag, debit_store, newlines, trim_space, valid_store_strict


def group(body: Column, pattern: str | Column, index: int | Column) -> Column:
    """A regex group, trimmed; null if it is blank or nothing matches. Patterns may come from a column of rules."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    index = F.lit(index) if isinstance(index, int) else index
    return F.nullif(trim_space(F.call_function("regexp_extract", body, pattern, index)), F.lit(""))


def digits(text: Column) -> Column:
    """The whole number of a text's digits; null if it has none or doesn't fit 32 bits."""
    return F.nullif(F.regexp_replace(text, r"[^0-9]", ""), F.lit("")).try_cast("int")


def amount(body: Column, pattern: str | Column, index: int | Column = 1) -> Column:
    """A positive amount by a rule's group; null otherwise."""
    n = digits(group(body, pattern, index))
    return F.when(n > 0, n)


def group_index(pattern: str, name: str) -> int:
    """The number of a named or numbered group of a pattern; 0 if it has none. Resolved once, when rules are loaded."""
    if name.strip().isdigit():
        return int(name)
    count = 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]])*\]|\((\?)?(<(\w+)>|[:=!>]|<[=!])?", pattern):
        if not m[0].startswith("("):
            continue
        if m[1] is None or m[3]:
            count += 1
            if m[3] == name.strip():
                return count
    return 0


def parsed(body: Column, received: Column, amount_pattern: Column, store_pattern: Column, card_pattern: Column, fallback_card: str = lx.OTHER) -> Column:
    """struct<amount, storeName, cardName, dateTime, category> by three patterns; null if amount or shop is missing."""
    text = newlines(body)
    n = amount(text, amount_pattern)
    raw = F.substring(group(text, store_pattern, 1), 1, 20)
    one_letter = F.when((F.length(raw) == 1) & text.rlike(r"(?:^|\n)출금(?:\n|$)"), raw)
    store = F.when(valid_store_strict(raw), trim_space(raw)).otherwise(F.coalesce(one_letter, debit_store(raw, text)))
    card = F.when(card_pattern != "", group(text, card_pattern, 1))
    good_card = F.when(F.length(card).between(2, 20) & ~card.rlike(r"^[\d*\-\s]+$") & ~any_of(F.lower(card), ("web발신", "승인", "출금", "입금", "잔액")), card)
    out = F.struct(
        n.alias("amount"), store.alias("storeName"), F.coalesce(good_card, bank_tag(text), F.lit(fallback_card)).alias("cardName"),
        format_minute(body_time(text, received)).alias("dateTime"), F.lit(lx.UNCLASSIFIED).alias("category"),
    )
    return F.when(n.isNotNull() & store.isNotNull(), out)


def income_type(body: Column) -> Column:
    """What kind of income a message speaks of, first hit in order."""
    out = F.when(any_of(body, lx.CANCEL_WORDS), "환불")
    for words, kind in ((("급여", "월급"), "급여"), (("보너스", "상여"), "보너스"), (("환급",), "환급"), (("정산",), "정산"), (("이체",), "이체"), (("송금",), "송금")):
        out = out.when(any_of(body, words), kind)
    return out.otherwise("입금")


def income_category(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, v) for k, v in lx.INCOME_TYPE_CATEGORY.items()), F.lit(lx.UNCLASSIFIED))


def _trimmed_lines(body: Column) -> Column:
    return F.transform(F.split(body, "\n"), trim_space)


def income_amount(body: Column) -> Column:
    """An income's amount: the number below a withdrawal line, else ``N원`` not followed by Hangul, else the first bare number line; 100 at least, else 0."""
    lines = _trimmed_lines(body)
    number = lambda x: F.when(x.rlike(r"^[\d,]+$"), digits(x))
    is_debit = lambda x: x.contains("체크카드출금") | (x == "출금") | x.contains("FBS출금") | x.contains("공동CMS출")
    below = F.get(F.filter(F.transform(lines, lambda x, i: F.when(is_debit(x), number(F.get(lines, i + 1)))), lambda n: n >= 100), F.lit(0))
    won = digits(F.regexp_extract(body, r"([\d,]+)원(?![가-힣])", 1))
    bare = F.get(F.filter(F.transform(F.filter(lines, lambda x: ~x.startswith("잔액") & (F.length(F.replace(x, F.lit(","), F.lit(""))) >= 3)), number), lambda n: n >= 100), F.lit(0))
    return F.coalesce(below, F.when(won >= 100, won), bare, F.lit(0))


def _clean_name(name: Column) -> Column:
    text = F.regexp_replace(trim_space(name), r"\(주\)|\(유\)|\(사\)|\(재\)", "")
    return trim_space(F.regexp_replace(text, r"^[^\w가-힣]+|[^\w가-힣]+$", ""))


def income_source(body: Column) -> Column:
    """Who sent an income: the nearest usable line above the first ``입금`` that has one, else ``…으로부터``, else the word beside ``입금``; '' if unclear."""
    lines = _trimmed_lines(body)
    skip = lambda x: x.contains("**") | x.rlike(r"^[\d*]+$") | x.rlike(r"^\d{1,2}[/.-]\d{1,2}\s+\d{1,2}:\d{2}$") | x.rlike(r"^\[.+\]$") | x.rlike(r"^\[.+\]\d{1,2}[/.-]\d{1,2}\s+\d{1,2}:\d{2}$") | (x == "") | x.contains("Web발신")
    nearest = lambda i: F.get(F.filter(F.transform(F.filter(F.reverse(F.slice(lines, F.lit(1), F.greatest(i - 1, F.lit(0)))), lambda x: ~skip(x)), _clean_name), lambda x: x != ""), F.lit(0))
    marks = F.filter(F.transform(lines, lambda x, i: F.when(x == "입금", i + 1)), lambda i: i.isNotNull())
    above = F.get(F.filter(F.transform(marks, nearest), lambda x: x.isNotNull()), F.lit(0))
    sender = F.nullif(F.regexp_extract(body, r"([가-힣a-zA-Z0-9]+?)(님)?(?:으)?로부터", 1), F.lit(""))
    pattern = r"입금\s*([가-힣a-zA-Z0-9]{2,10})|([가-힣a-zA-Z0-9]{2,10})\s*입금"
    word = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(x, pattern, 2), F.lit("")))
    beside = F.get(F.filter(F.transform(lines, word), lambda w: w.isNotNull() & ~w.isin(*lx.INCOME_WORDS)), F.lit(0))
    return F.coalesce(above, sender, beside, F.lit(""))


def grounded(body: Column, amount_value: Column, store: Column) -> Column:
    """Whether an answer's amount stands in the message as a token of its own, and its shop in the message without spaces."""
    compact = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    token = F.concat(F.lit(r"(?<!\d)"), amount_value.cast("string"), F.lit(r"(?!\d)"))
    return F.regexp(F.replace(body, F.lit(","), F.lit("")), token) & compact(body).contains(compact(store))


def recoverable(body: Column) -> Column:
    """Whether a message that a rule failed on is worth another try: it has an amount and a word of payment."""
    return body.rlike(r"\d{3,}|\d,\d{3}") & any_of(F.lower(body), lx.PAYMENT_WORDS)


def _rich_text(raw: str | None) -> str | None:
    """The text of a rich message: a text key of the top level, else of nested objects to depth 5, else the layout's text views."""
    if raw is None or not raw.strip().startswith("{"):
        return raw
    try:
        top = json.loads(raw.strip())
    except ValueError:
        return raw

    def plain(v) -> str | None:
        return v if isinstance(v, str) and v.strip() and not v.startswith("{") else None

    def nested(o: dict, depth: int) -> str:
        if depth > 5:
            return ""
        for key in lx.RICH_TEXT_KEYS:
            v = o.get(key)
            if (text := plain(v)) is not None:
                return text
            if isinstance(v, str) and v.startswith("{"):
                try:
                    v = json.loads(v)
                except ValueError:
                    continue
            if isinstance(v, dict) and (text := nested(v, depth + 1)):
                return text
        return next((t for v in o.values() if isinstance(v, dict) and (t := nested(v, depth + 1))), "")

    def views(o: dict) -> list[str]:
        own = [o["text"]] if o.get("widget") == "TextView" and isinstance(o.get("text"), str) and o["text"].strip() else []
        return own + [t for c in o.get("children") or [] if isinstance(c, dict) for t in views(c)]

    for key in lx.RICH_TEXT_KEYS:
        if (text := plain(top.get(key))) is not None:
            return text
    if text := nested(top, 0):
        return text
    layout = top.get("layout")
    try:
        layout = json.loads(layout) if isinstance(layout, str) and layout.startswith("{") else layout
    except ValueError:
        return raw
    return "\n".join(views(layout)) or raw if isinstance(layout, dict) else raw


def rich_text(body: Column) -> Column:
    """The text of a rich message. Its objects nest freely, so this one runs in Python, a batch at a time."""

    @F.arrow_udf("string")
    def texts(bodies):
        import pyarrow as pa

        return pa.array([_rich_text(b) for b in bodies.to_pylist()], pa.string())

    return texts(body)
