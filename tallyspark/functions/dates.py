"""Dates: billing months, calendar grids, periods of the query language and dates in messages.

Python functions bind parameters (clock and start day are arguments); Columns work on local times.
"""

from __future__ import annotations

import calendar
import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def day_of(year: int, month: int, day: int) -> date:
    """A day of a month, the month's last if it is shorter."""
    return date(year, month, min(day, calendar.monthrange(year, month)[1]))


def billing_month(year: int, month: int, start_day: int = 1) -> tuple[datetime, datetime]:
    """First and last instant (milliseconds) of a billing month: from ``start_day`` of the month before, for a day after the first."""
    if start_day <= 1:
        first, last = date(year, month, 1), day_of(year, month, 31)
    else:
        before = (year - 1, 12) if month == 1 else (year, month - 1)
        # either end is held to its month's length on its own, so a start day of 30 has 28 February twice
        first, last = day_of(*before, start_day), day_of(year, month, start_day - 1)
    return datetime(first.year, first.month, first.day), datetime(last.year, last.month, last.day, 23, 59, 59, 999000)


def effective_month(today: date, start_day: int = 1) -> tuple[int, int]:
    """The billing month that a day belongs to."""
    if start_day > 1 and today >= day_of(today.year, today.month, start_day):
        return (today.year + 1, 1) if today.month == 12 else (today.year, today.month + 1)
    return today.year, today.month


def period(start: str | None, end: str | None, now: datetime, default_start: datetime | None = None) -> tuple[datetime, datetime]:
    """Bounds of a query: a start day at 0:00 and an end day to its last millisecond.

    No start is ``default_start`` (the month's first by default); a start that can't be read is the epoch, an end that can't be read or is missing is now.
    """

    def parse(text: str) -> datetime | None:
        try:
            return datetime.strptime(text.strip(), "%Y-%m-%d")
        except ValueError:
            return None

    first = (default_start or datetime(now.year, now.month, 1)) if not start else parse(start) or datetime(1970, 1, 1)
    last = parse(end) if end else None
    return first, last + timedelta(days=1, milliseconds=-1) if last else now


def sync_range(last_sync_ms: int | None, now_ms: int, extra_days: int = 0) -> tuple[int, int]:
    """Bounds of an incremental read: five minutes before the last one, sixty days back at most."""
    floor = now_ms - (60 + extra_days) * DAY_MS
    return max(floor, (last_sync_ms or 0) - 5 * 60_000), now_ms


def relative_days(phrase: str, today: date) -> tuple[date, date] | None:
    """Bounds of a relative phrase in Korean; None if it isn't one."""
    monday = today - timedelta(today.weekday())
    first = today.replace(day=1)
    before = first - timedelta(1)
    fixed = {
        "오늘": (today, today), "어제": (today - timedelta(1),) * 2, "그저께": (today - timedelta(2),) * 2, "이번주": (monday, today),
        "지난주": (monday - timedelta(7), monday - timedelta(1)), "이번달": (first, today), "지난달": (before.replace(day=1), before), "올해": (date(today.year, 1, 1), today),
        "작년": (date(today.year - 1, 1, 1), date(today.year - 1, 12, 31)),
    }
    key = phrase.replace(" ", "")
    if key in fixed:
        return fixed[key]
    if m := re.fullmatch(r"최근(\d+)일", key):
        return today - timedelta(int(m[1]) - 1), today
    return None


# Columns


def billing_start(month_first: Column, start_day: int) -> Column:
    """First day of the billing month whose calendar month begins at ``month_first``."""
    if start_day <= 1:
        return month_first
    before = F.add_months(month_first, -1)
    return F.date_add(before, F.least(F.lit(start_day), F.dayofmonth(F.last_day(before))) - 1)


def billing_end(month_first: Column, start_day: int) -> Column:
    """Last day of that billing month."""
    if start_day <= 1:
        return F.last_day(month_first)
    return F.date_add(month_first, F.least(F.lit(start_day - 1), F.dayofmonth(F.last_day(month_first))) - 1)


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def weekday_key(ts: Column) -> Column:
    """MON to SUN, whatever the locale."""
    return F.element_at(F.array(*map(F.lit, ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"))), F.weekday(ts) + 1)


def format_minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def parse_minute(text: Column, now: Column) -> Column:
    """A time written to the minute; what can't be read is ``now``."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz"), now.cast("timestamp_ntz"))


def corrected_year(extracted: Column, received: Column, most_days: int = 183) -> Column:
    """An extracted time more than ``most_days`` from receipt gets the receipt's year (29 February rolls over)."""
    gap = F.abs(F.timestamp_diff("SECOND", received, extracted))
    moved = lenient(F.year(received), F.month(extracted), F.dayofmonth(extracted), F.hour(extracted), F.minute(extracted))
    return F.when(gap > most_days * 86_400, moved).otherwise(extracted)


def lenient(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """A time with fields beyond their range rolled over, as calendars in lenient mode do."""
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    return F.timestamp_add("MINUTE", hour * 60 + minute, F.date_add(first, day - 1).cast("timestamp_ntz"))


def body_time(body: Column, received: Column) -> Column:
    """The time that a message speaks of: its MM/DD and HH:mm with the receipt's year, rolled over; what it lacks is the receipt's."""
    md, hm = r"(\d{1,2})[/.-](\d{1,2})", r"(\d{1,2}):(\d{2})"
    pick = lambda pattern, k, other: F.coalesce(F.nullif(F.regexp_extract(body, pattern, k), F.lit("")).cast("int"), other)
    return lenient(F.year(received), pick(md, 1, F.month(received)), pick(md, 2, F.dayofmonth(received)), pick(hm, 1, F.hour(received)), pick(hm, 2, F.minute(received)))


def strict_body_time(body: Column, received: Column) -> Column:
    """The variant for incomes, as text: ``M월 D일`` counts too, and a field out of range is the receipt's."""
    slash, korean, hm = r"(\d{1,2})[/.-](\d{1,2})", r"(\d{1,2})월\s*(\d{1,2})일", r"(\d{1,2}):(\d{2})"
    get = lambda pattern, k: F.nullif(F.regexp_extract(body, pattern, k), F.lit("")).cast("int")
    within = lambda v, low, high, other: F.when(v.between(low, high), v).otherwise(other)
    month = within(F.when(body.rlike(slash), get(slash, 1)).otherwise(get(korean, 1)), 1, 12, F.month(received))
    day = within(F.when(body.rlike(slash), get(slash, 2)).otherwise(get(korean, 2)), 1, 31, F.dayofmonth(received))
    hour, minute = within(get(hm, 1), 0, 23, F.hour(received)), within(get(hm, 2), 0, 59, F.minute(received))
    return F.format_string("%04d-%02d-%02d %02d:%02d", F.year(received), month, day, hour, minute)


def group_time(text: Column, body: Column, received: Column) -> Column:
    """A rule's date group as minutes: full date, else MM/DD HH:mm, else HH:mm, else what the body says."""
    full = r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}$"
    md, hm = r"(\d{1,2})[/.-](\d{1,2})\s+(\d{1,2}):(\d{2})", r"(\d{1,2}):(\d{2})"
    get = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("int")
    by_md = lenient(F.year(received), get(md, 1), get(md, 2), get(md, 3), get(md, 4))
    by_hm = lenient(F.year(received), F.month(received), F.dayofmonth(received), get(hm, 1), get(hm, 2))
    return (
        F.when(text.rlike(full), F.regexp_replace(text, r"\s+", " "))
        .when(text.rlike(md), format_minute(by_md)).when(text.rlike(hm), format_minute(by_hm)).otherwise(format_minute(body_time(body, received)))
    )


def day_spine(spark: SparkSession, first: date, last: date) -> DataFrame:
    """(day, index) of each day from first to last."""
    days = F.sequence(F.lit(first.isoformat()).cast("date"), F.lit(last.isoformat()).cast("date"))
    return spark.range(1).select(F.posexplode(days).alias("index", "day")) if last >= first else spark.createDataFrame([], "index int, day date")


def calendar_grid(spark: SparkSession, first: date, last: date) -> DataFrame:
    """Weeks from Sunday to Saturday that cover a period: week, weekday (0 is Sunday), day, in_period."""
    start, end = first - timedelta((first.weekday() + 1) % 7), last + timedelta((5 - last.weekday()) % 7)
    return day_spine(spark, start, end).select(
        F.floor(F.col("index") / 7).cast("int").alias("week"), (F.col("index") % 7).alias("weekday"), "day",
        F.col("day").between(F.lit(first.isoformat()).cast("date"), F.lit(last.isoformat()).cast("date")).alias("in_period"),
    )


def months_between(first: date, last: date) -> list[str]:
    """yyyy-MM of every calendar month that a range touches."""
    out, y, m = [], first.year, first.month
    while (y, m) <= (last.year, last.month):
        out.append(f"{y:04d}-{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out
