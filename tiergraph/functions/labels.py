"""Dates, periods and freshness read from source labels and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiergraph.functions import fixed_values as fixed
from tiergraph.functions.text import ascii_borders


def label_date(label: Column) -> Column:
    """First ``(MM-DD-YYYY)`` in a label; null when absent or not a real date."""
    found = F.nullif(F.regexp_extract(label, fixed.LABEL_DATE, 1), F.lit(""))
    return F.try_to_date(found, "MM-dd-yyyy")


def label_date_key(label: Column) -> Column:
    """``yyyymmdd`` as an integer, -1 without a date: sorts undated labels last."""
    day = label_date(label)
    key = F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)
    return F.coalesce(key, F.lit(-1)).cast("bigint")


def day_fraction(moment: Column) -> Column:
    """Share of its day a timestamp has used up."""
    seconds = F.hour(moment) * 3600 + F.minute(moment) * 60 + F.extract(F.lit("SECOND"), moment)
    return seconds.cast("double") / 86400.0


def is_stale(day: Column, now: Column, limit_days: int = fixed.STALE_DAYS) -> Column:
    """No date, or more than ``limit_days`` (fractional) between midnight and ``now``."""
    moment = now.cast("timestamp_ntz")
    age = F.datediff(moment.cast("date"), day) + day_fraction(moment)
    return day.isNull() | (age > F.lit(float(limit_days)))


def earnings_label(label: Column) -> Column:
    """Whether a label names a fiscal-quarter call."""
    return F.coalesce(label.rlike(fixed.EARNINGS_LABEL), F.lit(False))


def own_call(company: Column, label: Column) -> Column:
    """Whether the label's company prefix and the company name start alike.

    The prefix is what stands before the first blank-Q-digit. An empty prefix
    fits every company; a label without a quarter fits none.
    """
    has_quarter = label.rlike(r"\sQ\d")
    prefix = F.lower(F.trim(F.regexp_replace(label, r"(?s)\sQ\d.*$", "")))
    name = F.lower(company)
    return F.coalesce(
        has_quarter & (F.startswith(name, prefix) | F.startswith(prefix, name)), F.lit(False)
    )


def period_mention(sentence: Column) -> Column:
    """First quarter, half-year, year or early/mid/late-year mention, else null."""
    return F.nullif(F.regexp_extract(sentence, ascii_borders(fixed.PERIOD), 1), F.lit(""))


def period_key(mention: Column) -> Column:
    """Chronological key of a period: ten per year plus a place inside the year.

    The half-year pattern is case-sensitive while every other one is not.
    """
    def first(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(mention, pattern, 1), F.lit(""))

    year = first(r"20(\d\d)")
    quarter = first(r"(?i)Q([1-4])")
    half = F.replace(first(r"([12]H|H[12])"), F.lit("H"), F.lit(""))
    inside = (
        F.when(quarter.isNotNull(), quarter.cast("int") * 2)
        .when(half.isNotNull(), half.cast("int") * 4)
        .when(mention.rlike("(?i)late|end|exiting|H2"), F.lit(8))
        .when(mention.rlike("(?i)mid"), F.lit(5))
        .when(mention.rlike("(?i)early|H1"), F.lit(2))
        .otherwise(F.lit(0))
    )
    key = (F.lit(2000) + year.cast("int")) * 10 + inside
    return F.when(year.isNull(), F.lit(99999)).otherwise(key).cast("bigint")


def call_status(call_seconds: Column, last_data: Column, now_seconds: Column) -> Column:
    """Struct ``(status, days)`` of an earnings call given in epoch seconds.

    The distance is rounded half towards plus infinity, so a call up to half a
    day ago still counts as upcoming.
    """
    apart = (call_seconds.cast("double") - now_seconds.cast("double")) / 86400.0
    days = F.floor(apart + 0.5)
    call_day = F.date_from_unix_date(F.floor(call_seconds / F.lit(86400)).cast("int"))
    status = (
        F.when(call_seconds.isNull(), F.lit("unknown"))
        .when(days >= 0, F.lit("upcoming"))
        .when(last_data >= call_day, F.lit("covered"))
        .otherwise(F.lit("due"))
    )
    distance = F.when(call_seconds.isNull(), F.lit(-1)).otherwise(F.abs(days))
    return F.struct(status.alias("status"), distance.cast("bigint").alias("days"))
