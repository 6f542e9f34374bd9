"""Dates and times. Months are read from the text prefix (the store's own time
zone); comparisons are in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WARN_DAYS, DOWNGRADE_DAYS = 90, 180


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_time(x) -> Column:
    """Timestamp of ISO text with Z, an offset or only a date; else null."""
    t = _col(x).cast("string")
    return F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")))


def month_key(x) -> Column:
    """yyyy-MM as written, without any conversion of time zone."""
    t = _col(x).cast("string")
    return F.when(t.rlike(r"^\d{4}-\d{2}"), F.substring(t, 1, 7))


def month_add(ym, months) -> Column:
    day = F.to_date(F.concat(_col(ym), F.lit("-01")))
    return F.date_format(F.add_months(day, F.lit(months) if isinstance(months, int) else months), "yyyy-MM")


def iso_week(ts) -> Column:
    """yyyy-Www by ISO rules."""
    t = _col(ts)
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), t), F.weekofyear(t))


def archive_stamp(x) -> Column:
    """Timestamp of up to 14 digits, right-padded with zeros."""
    return F.try_to_timestamp(F.rpad(_col(x).cast("string"), 14, "0"), F.lit("yyyyMMddHHmmss"))


def parse_date(x) -> Column:
    t = _col(x).cast("string")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date"))


def age_days(day, today) -> Column:
    return F.datediff(_col(today), parse_date(day))


def stale(day, today, limit: int = WARN_DAYS) -> Column:
    """True, false or null: an unknown age is neither fresh nor stale."""
    return age_days(day, today) > limit


def stale_level(day, today) -> Column:
    """null, warn or downgrade; without a date: downgrade."""
    age = age_days(day, today)
    return F.when(age.isNull() | (age > DOWNGRADE_DAYS), "downgrade").when(age > WARN_DAYS, "warn")


def days_between(a, b) -> Column:
    return (F.unix_timestamp(_col(b)) - F.unix_timestamp(_col(a))) / 86400.0


def retry_after_seconds(value, now) -> Column:
    """Seconds from a number or an HTTP date, never negative."""
    v = F.trim(_col(value).cast("string"))
    at = F.try_to_timestamp(F.substring(v, 6, 40), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    seconds = F.coalesce(v.try_cast("double"), (F.unix_timestamp(at) - F.unix_timestamp(_col(now))).cast("double"))
    return F.greatest(seconds, F.lit(0.0))


def seconds_text(x) -> Column:
    return F.concat(F.regexp_replace(_col(x).cast("double").cast("string"), r"\.0$", ""), F.lit(" s"))
