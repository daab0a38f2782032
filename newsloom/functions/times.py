"""Date and time functions over columns; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_hours(at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_millis(now) - F.unix_millis(at)) / 3_600_000.0)


def age_bucket(at: Column, now: Column) -> Column:
    hours = age_hours(at, now)
    return F.when(hours < 12, "<12h").when(hours < 48, "12-48h").when(hours < 168, "2-7d").otherwise("8-31d")


def story_bucket(at: Column, hours: int = 72) -> Column:
    """Tumbling window number since the epoch."""
    return F.floor(F.unix_millis(at) / (hours * 3_600_000))


def day_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def rounded(x: Column, places: int = 1) -> Column:
    """Halves up, also below zero."""
    return F.floor(x * 10**places + 0.5) / 10**places


def history_start(now: Column) -> Column:
    """The first day of the month before."""
    return F.add_months(F.trunc(now, "MM"), -1).cast("timestamp")


def history_days(now: Column) -> Column:
    """Days of history, between 31 and 62: those since history_start, begun ones too, and one."""
    since = F.ceil((F.unix_millis(now) - F.unix_millis(history_start(now))) / 86_400_000.0)
    return F.least(F.lit(62), F.greatest(F.lit(31), since + 1)).cast("int")


def day_delta(at: Column, now: Column) -> Column:
    """Days between the days of at and now; 999 without a date."""
    return F.coalesce(F.datediff(now, at), F.lit(999))


def day_label(at: Column, now: Column) -> Column:
    delta = day_delta(at, now)
    return F.when(delta == 0, "Aujourd’hui").when(delta == 1, "Hier").when(delta == 2, "Avant-hier").otherwise(day_key(at))


def in_period(at: Column, now: Column, period: str) -> Column:
    """today, yesterday, week (7 days) or month (30 days), by days that begin at midnight."""
    today = F.date_trunc("day", now)
    ago = lambda n: today - F.make_dt_interval(days=F.lit(n))
    if period == "yesterday":
        return (at >= ago(1)) & (at < today)
    return at >= {"today": today, "week": ago(6), "month": ago(29)}[period]


def freshness(at: Column, now: Column) -> Column:
    """22, 17, 12, 7 and 3 up to 2, 6, 12, 24 and 40 hours, then -10."""
    hours = age_hours(at, now)
    found = F.when(hours <= 2, 22)
    for most, points in ((6, 17), (12, 12), (24, 7), (40, 3)):
        found = found.when(hours <= most, points)
    return found.otherwise(-10)


#: Short names of months.
MONTHS = ("janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc.")


def safe_date(raw: Column, fallback: Column | None = None) -> Column:
    """raw as a time; fallback (null, or the present) where it is none."""
    at = F.try_to_timestamp(F.nullif(F.trim(raw), F.lit("")))
    return at if fallback is None else F.coalesce(at, fallback)


def time_label(at: Column, now: Column) -> Column:
    """Minutes or hours ago, yesterday's time, or day and month; empty without a date."""
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(at)) / 60_000.0 + 0.5)
    found = F.when(at.isNull(), "").when(minutes < 1, "À l’instant").when(minutes < 60, F.concat(F.lit("Il y a "), minutes.cast("string"), F.lit(" min")))
    found = found.when(minutes < 1440, F.concat(F.lit("Il y a "), F.floor(minutes / 60).cast("string"), F.lit(" h"))).when(minutes < 2880, F.concat(F.lit("Hier, "), F.date_format(at, "HH:mm")))
    return found.otherwise(F.concat_ws(" ", F.dayofmonth(at).cast("string"), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(at))))


def fresh_within(at: Column, now: Column, minutes: int = 30) -> Column:
    return F.coalesce(F.unix_millis(now) - F.unix_millis(at) < minutes * 60_000, F.lit(False))
