"""Dates.  Instants are UTC timestamps; civil days are those of one zone; ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Chicago"


def millis(ts: Column | str) -> Column:
    """Milliseconds since 1970 of an instant, or of a time without a zone taken as UTC."""
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def days_between(earlier: Column, later: Column) -> Column:
    return F.floor((millis(later) - millis(earlier)) / 86_400_000)


def civil_date(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def calendar_days_until(ts: Column, now: Column, zone: str = ZONE) -> Column:
    return F.datediff(civil_date(ts, zone), civil_date(now, zone))


def civil_instant(wall: Column, zone: str = ZONE) -> Column:
    return F.to_utc_timestamp(wall, zone)


def months_between(a: Column, b: Column) -> Column:
    """Whole calendar months from day a to day b, not before a, plus the share of the month begun; month ends are clamped."""
    da, db = F.to_date(a), F.to_date(b)
    whole = (F.year(db) - F.year(da)) * 12 + F.month(db) - F.month(da)
    whole = F.when(F.add_months(da, whole) > db, whole - 1).otherwise(whole)
    start, end = F.add_months(da, whole), F.add_months(da, whole + 1)
    return whole + F.datediff(db, start) / F.datediff(end, start)


def staleness(expires: Column, approved: Column, now: Column, aging: int = 9, stale: int = 18) -> Column:
    """expired, stale, aging or fresh; a future expiry date holds an old listing at aging."""
    age = months_between(approved, now)
    base = F.when(age < aging, "fresh").when(age <= stale, "aging").otherwise("stale")
    return (
        F.when(expires < now, "expired")
        .when(approved.isNull(), F.when(expires.isNotNull(), "aging").otherwise("stale"))
        .when((base == "stale") & expires.isNotNull(), "aging")
        .otherwise(base)
    )


def from_parts(parts: Column) -> Column:
    """[year, month, day], [[year, month, day]]'s inner list, or shorter ones: the first instant of that time; null outside the years 1000 to 3000."""
    y, m, d = (F.try_element_at(parts, F.lit(i)).cast("int") for i in (1, 2, 3))
    return F.when(y.between(1000, 3000), F.try_make_timestamp(y, F.coalesce(m, F.lit(1)), F.coalesce(d, F.lit(1)), F.lit(0), F.lit(0), F.lit(0)))


def to_instant(x: Column) -> Column:
    """An instant from text: nine to thirteen digits as an epoch (below 1e11 in seconds, else milliseconds), ISO stamps (UTC where they name no zone),
    bare dates, "2024 Mar 15", "2024 Mar", "2024", and common written dates; null when none fits or the year is outside 1900 to 2200."""
    t = F.trim(x)
    n = F.when(t.rlike(r"^\d{9,13}$"), t.try_cast("double"))
    epoch = F.when(n < 1e11, F.timestamp_seconds(n)).otherwise(F.timestamp_millis(n.cast("long")))
    year = F.regexp_extract(t, r"^(\d{4})(?:\s+([A-Za-z]{3,9}))?(?:\s+(\d{1,2}))?\s*$", 1).try_cast("int")
    month = F.regexp_extract(t, r"^(\d{4})(?:\s+([A-Za-z]{3,9}))?(?:\s+(\d{1,2}))?\s*$", 2)
    day = F.regexp_extract(t, r"^(\d{4})(?:\s+([A-Za-z]{3,9}))?(?:\s+(\d{1,2}))?\s*$", 3).try_cast("int")
    at = F.when(month == "", 1).otherwise(month_of(month))
    written = F.try_make_timestamp(year, at, F.coalesce(day, F.lit(1)), F.lit(0), F.lit(0), F.lit(0))
    named = [F.try_to_timestamp(t, F.lit(f)) for f in ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/M/d", "M/d/yyyy")]
    out = F.coalesce(F.when(n.isNotNull(), epoch), F.when(~F.contains(t, F.lit("-")) & ~F.contains(t, F.lit("/")), written), F.when(t.rlike(r"^\d{4}-\d{2}(-\d{2})?"), F.try_to_timestamp(t)), *named)
    return F.when(F.year(out).between(1900, 2200) & ~t.isin("NA", "null", ""), out)


def month_of(name: Column) -> Column:
    """1 to 12 by the first three letters, else null."""
    at = F.position(F.lower(F.substring(name, 1, 3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    return F.when((F.length(name) >= 3) & (at > 0) & (at % 3 == 1), ((at + 2) / 3).cast("int"))


def study_instant(x: Column) -> Column:
    """A study's date field: ISO with or without a time (UTC where it names no zone) or month/day/year; anything else is null."""
    t = F.trim(x.cast("string"))
    us = [F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i).try_cast("int") for i in (1, 2, 3)]
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t)), F.try_make_timestamp(us[2], us[0], us[1], F.lit(0), F.lit(0), F.lit(0)))


def week_of(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def rfc822(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def day_key(ts: Column, zone: str = ZONE) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd"), F.lit("undated"))


def agenda_label(ts: Column, now: Column, zone: str = ZONE) -> Column:
    d = calendar_days_until(ts, now, zone)
    return F.when(d.isNull(), "Open listing").when(d < 0, "Earlier today").when(d == 0, "Today").when(d == 1, "Tomorrow").when(d <= 7, "This week").when(d <= 14, "Next week").otherwise("Coming up")


def relative(ts: Column, now: Column) -> Column:
    """in 5 min, 3h ago, in 1 day, 2 mo ago; each unit rounded from the one before.  Unknown: empty."""
    ms = millis(ts) - millis(now)
    half = lambda x: F.floor(x + 0.5)
    minutes = half(F.abs(ms) / 60_000)
    hours = half(minutes / 60)
    days = half(hours / 24)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit) if isinstance(unit, str) else unit)
    some = F.when(minutes < 60, text(minutes, " min")).when(hours < 24, text(hours, "h")).when(days < 30, text(days, F.when(days == 1, " day").otherwise(" days"))).otherwise(text(half(days / 30), " mo"))
    return F.when(ms.isNull(), "").when(ms > 0, F.concat(F.lit("in "), some)).otherwise(F.concat(some, F.lit(" ago")))


def _shown(ts: Column, pattern: str, missing: str, zone: str) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), pattern), F.lit(missing))


def show_datetime(ts: Column, zone: str = ZONE) -> Column:
    """Sun, Sep 6, 1:00 PM"""
    return _shown(ts, "EEE, MMM d, h:mm a", "Date TBD", zone)


def show_date(ts: Column, zone: str = ZONE) -> Column:
    """Sep 6, 2026"""
    return _shown(ts, "MMM d, yyyy", "Undated", zone)


def show_time(ts: Column, zone: str = ZONE) -> Column:
    """1:00 PM"""
    return _shown(ts, "h:mm a", "Time TBD", zone)


def show_day(ts: Column, zone: str = ZONE) -> Column:
    """Sunday, September 6"""
    return _shown(ts, "EEEE, MMMM d", "Date to be announced", zone)


def show_range(starts: Column, ends: Column, zone: str = ZONE) -> Column:
    """One moment where the end is unknown or on the same day (of the session's zone, which is UTC), else two dates."""
    same = F.to_date(starts) == F.to_date(ends)
    return F.when(starts.isNull() | ends.isNull() | same, show_datetime(starts, zone)).otherwise(F.concat(show_date(starts, zone), F.lit(" – "), show_date(ends, zone)))
