"""Dates out of text, day differences, urgency. The clock is always an argument."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

SLASH = ["M/d/yyyy"]
SALE_FORMATS = ["M/d/yyyy", "MMMM d, yyyy", "MMMM d yyyy"]
DEADLINE_FORMATS = ["M/d/yyyy", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy"]


def as_moment(as_of: datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def as_day(as_of: datetime | date | str) -> Column:
    return F.lit(str(as_of)[:10]).cast("date")


def parse_day(text: Column, formats: list[str]) -> Column:
    """First format that parses; NULL if none does."""
    one_blank = F.regexp_replace(text, r"\s+", " ")
    return F.coalesce(*[F.try_to_date(one_blank, f) for f in formats])


def slash_day(text: Column) -> Column:
    return parse_day(text, SLASH)


def sale_day(text: Column) -> Column:
    return parse_day(text, SALE_FORMATS)


def deadline_day(text: Column) -> Column:
    return parse_day(text, DEADLINE_FORMATS)


def at_five_pm(day: Column) -> Column:
    """Close of the courthouse on a day."""
    return F.date_trunc("DAY", day.cast("timestamp_ntz")).cast("timestamp_ntz") + F.expr("INTERVAL 17 HOURS")


def midnight(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def days_left(deadline: Column, as_of: datetime) -> Column:
    return F.datediff(deadline.cast("date"), as_day(as_of))


def urgency(deadline: Column, as_of: datetime) -> Column:
    """expired after 17:00 of the last day, critical up to 2 days, warning up to 5, else normal."""
    left = days_left(deadline, as_of)
    return (
        F.when(deadline.isNull(), "normal")
        .when(as_moment(as_of) >= at_five_pm(deadline.cast("date")), "expired")
        .when(left <= 2, "critical")
        .when(left <= 5, "warning")
        .otherwise("normal")
    )


def days_label(left: Column, urgent: Column) -> Column:
    """Badge text of the board."""
    return (
        F.when(left.isNull(), "No deadline")
        .when(urgent == "expired", "EXPIRED")
        .when(left == 0, "TODAY")
        .when(left == 1, "1 day")
        .otherwise(F.concat(left.cast("string"), F.lit(" days")))
    )


def lookback_day(day: Column) -> Column:
    """Day whose filings a run covers: Friday when run on a Monday, else the day before."""
    return F.when(F.weekday(day) == 0, F.date_sub(day, 3)).otherwise(F.date_sub(day, 1))


def period_chunks(first: Column, last: Column, size: str) -> Column:
    """``array<struct<chunk_start, chunk_end>>`` covering first..last, clipped at both ends."""
    if size in ("daily", "weekly"):
        step = 1 if size == "daily" else 7
        starts = F.sequence(first, last, F.expr(f"INTERVAL {step} DAYS"))
        ends = lambda d: F.date_add(d, step - 1)
    else:
        unit, months = {"monthly": ("MM", 1), "quarterly": ("QUARTER", 3), "yearly": ("YEAR", 12)}[size]
        head = F.trunc(first, unit)
        periods = F.sequence(head, last, F.expr(f"INTERVAL {months} MONTHS"))
        starts = F.transform(periods, lambda d: F.greatest(d, first))
        ends = lambda d: F.date_sub(F.add_months(F.trunc(d, unit), months), 1)
    chunk = lambda d: F.struct(d.alias("chunk_start"), F.least(ends(d), last).alias("chunk_end"))
    return F.when(first <= last, F.transform(starts, chunk))
