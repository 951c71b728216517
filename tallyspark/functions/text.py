"""Normalization and text expressions; all are Columns that stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx


def any_of(text: Column, words) -> Column:
    """Whether any word is in the text: substring tests for a few words, one alternation of quoted words for many."""
    words = list(words)
    if len(words) > 6:
        return text.rlike("|".join(re.sub(r"([\\\[\](){}.*+?^$|])", r"\\\1", w) for w in words))
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words)) if words else F.lit(False)


def first_of(text: Column, words) -> Column:
    """The first word of the list that the text holds; null if none."""
    return F.coalesce(*(F.when(text.contains(w), w) for w in words)) if words else F.lit(None).cast("string")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def trim_space(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _national(clean: Column) -> Column:
    return (
        F.when(clean.startswith("+82"), F.concat(F.lit("0"), F.substring(clean, 4, 1 << 20)))
        .when(clean.startswith("82") & (F.length(clean) >= 11), F.concat(F.lit("0"), F.substring(clean, 3, 1 << 20)))
        .otherwise(clean)
    )


def normalize_sender(address: Column) -> Column:
    """A sender's number without hyphens, spaces, brackets and no-break spaces, in national form."""
    return _national(F.regexp_replace(trim_space(address), "[-\\s()\\u00A0]", ""))


def normalize_sender_dotted(address: Column) -> Column:
    """The variant of the pattern matcher: dots go, no-break spaces stay."""
    return _national(F.regexp_replace(trim_space(address), r"[-\s().]", ""))


def java_hash(text: Column) -> Column:
    """The 32-bit polynomial hash (base 31) of a text's UTF-16 units, as a signed number.

    Characters beyond the basic plane count as their two surrogates.
    """
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: _code_point(c))
    flat = F.flatten(
        F.transform(units, lambda p: F.when(p < 65536, F.array(p)).otherwise(F.array(F.floor((p - 65536) / 1024).cast("long") + 55296, (p - 65536) % 1024 + 56320)))
    )
    folded = F.aggregate(flat, F.lit(0).cast("long"), lambda h, u: (h * 31 + u).bitwiseAND(4294967295))
    return F.when(folded >= 2147483648, folded - 4294967296).otherwise(folded)


def _code_point(c: Column) -> Column:
    """The code point of one character, from its UTF-32 bytes."""
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")


def message_id(address: Column, date: Column, body: Column) -> Column:
    """address_date_hash of the body."""
    return F.concat_ws("_", address, date.cast("string"), java_hash(body).cast("string"))


def parse_message_id(sms_id: Column) -> Column:
    """struct<address, date, hash> of an id, split from the right; null if it isn't one."""
    pattern = r"^(.+)_(-?\d+)_([^_]+)$"
    return F.when(
        sms_id.rlike(pattern),
        F.struct(F.regexp_extract(sms_id, pattern, 1).alias("address"), F.regexp_extract(sms_id, pattern, 2).try_cast("long").alias("date"), F.regexp_extract(sms_id, pattern, 3).alias("hash")),
    )


def content_key(address: Column, body_hash: Column) -> Column:
    return F.concat_ws("_", address, body_hash)


def _alias_rows() -> list[tuple[str, str]]:
    seen: dict[str, str] = {}
    for name, aliases in lx.CARD_ALIASES.items():
        for a in aliases:
            seen[a] = name  # a later card takes over a shared alias
    return list(seen.items())


def normalize_card(card: Column) -> Column:
    """A card's company: exact alias, else the longest alias it holds (of equal ones the first), else as it is; blank gives ''."""
    trimmed = trim_space(card)
    lower, rows = F.lower(trimmed), _alias_rows()
    exact = F.create_map(*(F.lit(x) for row in rows for x in row))[lower]
    longest = sorted(range(len(rows)), key=lambda i: (-len(rows[i][0]), i))
    held = F.coalesce(*(F.when(lower.contains(rows[i][0]), rows[i][1]) for i in longest))
    return F.when(trimmed == "", "").otherwise(F.coalesce(exact, held, trimmed))


BANK_TAG = r"\[(" + "|".join(lx.BANK_TAGS) + r")\]"


def bank_tag(body: Column) -> Column:
    """The bank named in brackets in a message; null if none."""
    return F.nullif(F.regexp_extract(body, BANK_TAG, 1), F.lit(""))


def card_with_fallback(card: Column, body: Column) -> Column:
    """The card's company; for an unknown card the company of the body's bank tag."""
    known = normalize_card(card)
    return F.when(known.isin(*lx.CARD_ALIASES), known).otherwise(F.coalesce(normalize_card(bank_tag(body)), known))


def _store_aliases() -> list[tuple[str, str]]:
    out: dict[str, str] = {}
    for name, aliases in lx.STORE_ALIASES.items():
        out[name.lower()] = name
        for a in aliases:
            out[a.lower()] = name
    return list(out.items())


def all_aliases(keyword: str) -> list[str]:
    """Every spelling of the shop that a keyword names; the keyword alone if it names none."""
    name = dict(_store_aliases()).get(keyword.lower().strip())
    return [keyword] if name is None else list(dict.fromkeys((name, *lx.STORE_ALIASES[name])))


def matches_store(store: Column, keyword: str) -> Column:
    return any_of(F.lower(store), [a.lower() for a in all_aliases(keyword)])


def canonical_store(store: Column) -> Column:
    """The main name of the first alias that a shop's name holds; null if none."""
    lower = F.lower(store)
    return F.coalesce(*(F.when(lower.contains(a), name) for a, name in _store_aliases()))


def newlines(body: Column) -> Column:
    return F.regexp_replace(body, "\r\n?", "\n")


def likely_store(line: Column) -> Column:
    """Whether a line of a message can be a shop's name."""
    first = F.substring(line, 1, 1)
    return (
        F.length(line).between(2, 20) & ~line.contains("{") & ~any_of(F.lower(line), lx.STRUCTURE_WORDS) & ~line.rlike(r"^[\p{Nd},]+$")
        & (first.rlike(r"^\p{L}") | first.isin("(", "*"))
    )


def templatize(body: Column) -> Column:
    """A message with placeholders for names, card numbers, shop, amounts, dates, times and balances."""
    text = F.when(body.contains("\n"), body).otherwise(F.regexp_replace(body, r"\s+/\s+", "\n"))
    text = F.regexp_replace(text, r"[가-힣]\*[가-힣]", "{USER_NAME}")
    text = F.regexp_replace(text, r"\d+\*+\d+", "{CARD_NUM}")

    def with_store(lines: Column) -> Column:
        place = F.array_position(F.transform(lines, lambda line: likely_store(trim_space(line))), True)
        named = let(place, lambda p: F.transform(lines, lambda line, i: F.when(i + 1 == p, "{STORE}").otherwise(line)))
        return F.array_join(F.when(F.size(lines) >= 4, named).otherwise(lines), "\n")

    text = let(F.split(text, "\n", -1), with_store)
    text = F.regexp_replace(text, r"[\d,]+원", "{AMOUNT}원")
    text = F.regexp_replace(text, r"\n[\d,]{3,}\n", "\n{AMOUNT}\n")
    text = F.regexp_replace(text, r"\d{1,2}[/.-]\d{1,2}", "{DATE}")
    text = F.regexp_replace(text, r"\d{1,2}:\d{2}", "{TIME}")
    return F.regexp_replace(text, r"잔액[\d,]+", "잔액{BALANCE}")


def loose_template_key(template: Column) -> Column:
    """A template's letters with # for each placeholder: what loosely equal templates share."""
    text = F.regexp_replace(newlines(template), r"(\{CARD_NUM\}|\{CARD_NO\}|\d+\*+\d+)\s*\n([^\n]{2,40})\s*\n(출금|입금|승인|취소|결제)", "$1\n#\n$3")
    text = F.lower(text)
    for word in ("[web발신]", "(광고)", "광고"):
        text = F.replace(text, F.lit(word), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, r"\{[^}]+\}", "#"), r"[^\p{L}#]", "")
    return F.regexp_replace(F.regexp_replace(text, "#+", "#"), "^#|#$", "")


def loosely_equal(a: Column, b: Column) -> Column:
    """Loose template keys that are equal, hold one another, or share a prefix of 8 and 45% of the shorter."""
    shorter = F.least(F.length(a), F.length(b))
    need = F.greatest(F.lit(8), F.ceil(shorter * 45 / 100).cast("int"))
    prefix = (shorter >= need) & (F.substring(a, F.lit(1), need) == F.substring(b, F.lit(1), need))
    return (a != "") & (b != "") & ((a == b) | a.contains(b) | b.contains(a) | prefix)


def infer_type(body: Column) -> Column:
    """cancel, overseas, income or expense by the words of a message."""
    low = F.lower(body)
    return F.when(low.contains("취소"), "cancel").when(any_of(low, ("해외", "usd", "jpy", "eur")), "overseas").when(low.contains("입금"), "income").otherwise("expense")


def filled_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: trim_space(x) != ""))


def structurally_equal(body: Column, template: Column, pattern: Column) -> Column:
    """Templates of like line counts, type and debit or approval words."""
    n, m = filled_lines(body), filled_lines(pattern)
    lines = (F.abs(n - m) <= 2) | ((n >= 5) & (m >= 5))
    debit, approval = body.contains("출금") != pattern.contains("출금"), body.contains("승인") != pattern.contains("승인")
    return lines & (infer_type(template) == infer_type(pattern)) & ~(debit & approval)


NUMBER_ONLY = r"^[\d,.:/\-\s]+$"
DATE_OR_TIME = r"^(?:\d{1,2}[/.-]\d{1,2}(?:\s+\d{1,2}:\d{2})?|\d{1,2}:\d{2})$"
DEBIT_LINE = r"(?:^|\n)출금(?:\n|$)"


def sanitize_store(raw: Column) -> Column:
    """A shop's name without cash-back prefix and running totals, single spaced."""
    text = F.regexp_replace(raw, r"^\*?\d+원(?:캐쉬백|캐시백)\s*", "")
    text = F.regexp_replace(text, r"\s*(?:누적.*|잔액.*)$", "")
    return trim_space(F.regexp_replace(text, r"\s+", " "))


def valid_store(name: Column) -> Column:
    """Whether an extracted text can be a shop's name (rules)."""
    return (trim_space(name) != "") & (F.length(name) <= 30) & ~name.contains("{") & ~name.rlike(NUMBER_ONLY) & ~any_of(name, lx.NO_STORE_WORDS)


def valid_store_strict(name: Column) -> Column:
    """The variant of the pattern matcher: two letters at least, no bare date or time, any case."""
    t = trim_space(name)
    return F.length(t).between(2, 30) & ~t.contains("{") & ~t.rlike(NUMBER_ONLY) & ~t.rlike(DATE_OR_TIME) & ~any_of(F.lower(t), lx.NO_STORE_WORDS)


def debit_store(name: Column, body: Column) -> Column:
    """The name for withdrawals whose shop is unclear; null where it doesn't apply."""
    applies = (trim_space(name) != "") & body.rlike(DEBIT_LINE) & ~name.contains("{") & ~name.rlike(DATE_OR_TIME)
    vague = name.rlike(NUMBER_ONLY) | name.contains("입출통지") | any_of(name, lx.NO_STORE_WORDS)
    return F.when(applies, F.when(vague, lx.DEBIT_STORE).otherwise(name))


def store_or_debit(name: Column, body: Column) -> Column:
    t = trim_space(name)
    return F.when(valid_store(t), t).otherwise(debit_store(t, body))


def store_fallback(body: Column) -> Column:
    """A shop's name without a rule: after the account line, after the time, the line below the account, the first valid line."""
    after_account = F.regexp_extract(body, r"\n\d+\*+\d+\n(.+?)\n(?:출금|입금|체크카드출금|스마트폰출금|공동CMS출|지로출금|FBS출금)", 1)
    after_time = F.regexp_extract(body, r"\d{1,2}[/.-]\d{1,2}\s+\d{1,2}:\d{2}\s+(.+?)(?:\s+누적|\s*$)", 1)
    lines = F.filter(F.transform(F.split(body, "\n"), trim_space), lambda x: x != "")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(r"\d+\*+\d+")), True).cast("int")
    below = F.when((at > 0) & (at < F.size(lines)), F.get(lines, at))
    tidy = [sanitize_store(x) for x in (after_account, after_time, below)]
    first = F.get(F.filter(F.transform(lines, sanitize_store), valid_store), F.lit(0))
    return F.coalesce(*(F.when(valid_store(x), x) for x in tidy), first)


def infer_category(store: Column, body: Column, words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The first category, in declared order, with a word in the shop's name or the message; else unclassified.

    The dictionary is the caller's (``sources.rules.category_words`` reads one); without it nothing is inferred.
    """
    text = F.lower(F.concat_ws(" ", store, F.coalesce(body, F.lit(""))))
    return F.coalesce(*(F.when(any_of(text, [w.lower() for w in ws]), c) for c, ws in (words or {}).items()), F.lit(lx.UNCLASSIFIED))


def pre_classify(store: Column) -> Column:
    """The category of well-known names; null if none applies."""
    low = F.lower(store)
    return F.coalesce(*(F.when(any_of(low, [w.lower() for w in ws]), c) for ws, c in lx.PRE_CLASSIFY))


def normalize_category(name: Column, mapped: dict[str, str] | None = None, valid: tuple[str, ...] = lx.EXPENSE_CATEGORIES) -> Column:
    """A service's answer as a category: valid, mapped, held in it, a mapped word held in it, else other."""
    mapped = lx.LEGACY_CATEGORIES if mapped is None else mapped
    t = trim_space(name)
    steps = [F.when(t.isin(*valid), t), *(F.when(t == k, v) for k, v in mapped.items()), *(F.when(t.contains(v), v) for v in valid), *(F.when(t.contains(k), v) for k, v in mapped.items())]
    return F.coalesce(*steps, F.lit(lx.OTHER))


def is_transfer_name(store: Column) -> Column:
    """A masked personal name or a word of transfers."""
    t = trim_space(store)
    return t.rlike(r"^[가-힣][*]+[가-힣]?$") | any_of(t, lx.TRANSFER_WORDS)


def mask_digits(body: Column) -> Column:
    return F.regexp_replace(body, r"\d", "*")


def rule_key(*fields: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of the fields joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256), 1, 24)


def fingerprint(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)


def short_title(text: Column, most: int = 30) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def csv_field(text: Column) -> Column:
    """A field quoted where it holds a comma, a quote or a line end; quotes doubled."""
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


_PLACEHOLDERS = {
    "{USER_NAME}": r"[가-힣]\*[가-힣]", "{CARD_NUM}": r"\d+\*+\d+", "{STORE}": r"(?<store>[^\n]+?)", "{AMOUNT}": r"(?<amount>[\d,]+)", "{DATE}": r"\d{1,2}[/.-]\d{1,2}",
    "{TIME}": r"\d{1,2}:\d{2}", "{BALANCE}": r"[\d,]+",
}


def template_regex(template: str) -> str:
    """A rule's pattern from a template: literal text escaped, white space loosened, placeholders as patterns (at rule-building time)."""
    out, seen = [], set()
    for part in re.split(r"(\{[A-Z_]+\})", template):
        if part in _PLACEHOLDERS:
            pattern = _PLACEHOLDERS[part]
            out.append(re.sub(r"\?<\w+>", "?:", pattern) if part in seen else pattern)
            seen.add(part)
        else:
            out.append(re.sub(r"(?:\\?\s)+", lambda _: r"\s*", re.escape(part)))
    return "".join(out)
