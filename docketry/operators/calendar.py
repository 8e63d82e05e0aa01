"""Court holidays, business days and bid deadlines.

Business days are tested by rules on the date itself, so any year works and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import let

# Anonymous Gregorian computus, one step per column.
_EASTER_STEPS = [
    ("a", "y % 19"),
    ("b", "y div 100"),
    ("c", "y % 100"),
    ("h", "(19 * a + b - b div 4 - (b - (b + 8) div 25 + 1) div 3 + 15) % 30"),
    ("l", "(32 + 2 * (b % 4) + 2 * (c div 4) - h - c % 4) % 7"),
    ("k", "h + l - 7 * ((a + 11 * h + 22 * l) div 451) + 114"),
    ("easter", "make_date(cast(y as int), cast(k div 31 as int), cast(k % 31 + 1 as int))"),
]


def _nth_weekday(month: int, weekday: int, nth: int) -> str:
    """SQL for the nth weekday (0 = Monday) of a month; -1 is the last one."""
    if nth > 0:
        first = f"make_date(cast(y as int), {month}, 1)"
        return f"date_add({first}, pmod({weekday} - weekday({first}), 7) + {7 * (nth - 1)})"
    last = f"last_day(make_date(cast(y as int), {month}, 1))"
    return f"date_sub({last}, pmod(weekday({last}) - {weekday}, 7))"


def court_holidays(years: DataFrame) -> DataFrame:
    """(year, name, holiday, observed) of each year: twelve rules; Saturday is kept on Friday, Sunday on Monday."""
    years = years.select(F.col("year").cast("long").alias("y"))
    for name, step in _EASTER_STEPS:
        years = years.withColumn(name, F.expr(step))
    fixed = lambda m, d: f"make_date(cast(y as int), {m}, {d})"
    thanksgiving = _nth_weekday(11, 3, 4)
    rules = {
        "New Year's Day": fixed(1, 1),
        "Martin Luther King Jr. Day": _nth_weekday(1, 0, 3),
        "Good Friday": "date_sub(easter, 2)",
        "Memorial Day": _nth_weekday(5, 0, -1),
        "Independence Day": fixed(7, 4),
        "Labor Day": _nth_weekday(9, 0, 1),
        "Veterans Day": fixed(11, 11),
        "Thanksgiving Day": thanksgiving,
        "Day after Thanksgiving": f"date_add({thanksgiving}, 1)",
        "Christmas Eve": fixed(12, 24),
        "Christmas Day": fixed(12, 25),
        "Day after Christmas": fixed(12, 26),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.expr(rule).alias("holiday")) for n, rule in rules.items()])
    shift = F.when(F.weekday("holiday") == 5, -1).when(F.weekday("holiday") == 6, 1).otherwise(0)
    return (
        years.select(F.col("y").cast("int").alias("year"), F.inline(pairs))
        .withColumn("observed", F.date_add("holiday", shift))
    )


#: Month and day of the holidays that have a date.
_DATED = [101, 704, 1111, 1224, 1225, 1226]


def _easter(year: Column) -> Column:
    """Easter Sunday by the same steps as above, in one expression."""
    div = lambda x, n: F.floor(x / n)
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    w = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    k = h + w - 7 * div(a + 11 * h + 22 * w, 451) + 114
    return F.make_date(year, div(k, 31).cast("int"), (k % 31 + 1).cast("int"))


def is_business_day(day: Column) -> Column:
    """Monday to Friday and no court holiday kept that day; holidays of the day's own year only."""
    week, month, number = F.weekday(day), F.month(day), F.dayofmonth(day)
    dated = lambda d: F.month(d) * 100 + F.dayofmonth(d)
    nth = lambda m, w, first, last: (month == m) & (week == w) & number.between(first, last)
    holiday = (
        dated(day).isin(_DATED)
        | ((week == 4) & dated(F.date_add(day, 1)).isin(_DATED[1:]))
        | ((week == 0) & dated(F.date_sub(day, 1)).isin(_DATED))
        | nth(1, 0, 15, 21) | nth(5, 0, 25, 31) | nth(9, 0, 1, 7) | nth(11, 3, 22, 28) | nth(11, 4, 23, 29)
        | ((week == 4) & month.isin(3, 4) & (F.date_add(day, 2) == _easter(F.year(day))))
    )
    return (week < 5) & ~holiday


def next_business_day(day: Column) -> Column:
    """First business day at or after a date; no court closes for eight days on end."""

    def first(d: Column) -> Column:
        later = F.filter(F.sequence(F.date_add(d, 1), F.date_add(d, 7)), is_business_day)
        return F.when(is_business_day(d), d).when(d.isNotNull(), F.element_at(later, 1))

    # bound once: the rules name the day often, and Spark writes an expression out wherever it is named
    return let(day, first)


def with_deadline(df: DataFrame, day: Column, out: str) -> DataFrame:
    """Add the bid deadline that follows from ``day``: the first business day ten days on or later; NULL stays NULL."""
    return df.withColumn(out, next_business_day(F.date_add(day, 10)))


def with_business_day(df: DataFrame, day: Column) -> DataFrame:
    """Add ``is_business`` and ``next_business_day`` of a date column."""
    return df.withColumn("is_business", is_business_day(day)).withColumn("next_business_day", next_business_day(day))
