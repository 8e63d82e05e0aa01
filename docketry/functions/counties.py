"""County codes and case-number suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import rules as R


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def county_name(code: Column) -> Column:
    return _lookup(R.COUNTY_BY_CODE, code)


def county_code(name: Column) -> Column:
    return _lookup({n.lower(): c for c, n in R.COUNTY_BY_CODE.items()}, F.lower(name))


def is_county(name: Column) -> Column:
    return county_code(name).isNotNull()


def county_source(code: Column) -> Column:
    return _lookup(R.SOURCE_BY_COUNTY_CODE, code)


def number_suffix(case_number: Column) -> Column:
    """Text after the last dash, NULL without one."""
    return F.when(F.contains(case_number, F.lit("-")), F.substring_index(case_number, "-", -1))


def case_county(case_number: Column, location: Column) -> Column:
    """County code by number suffix, else by a county named in the location."""
    suffix = number_suffix(case_number)
    by_suffix = F.when(county_name(suffix).isNotNull(), suffix)
    low = F.lower(location)
    by_place = [F.when(F.contains(low, F.lit(n.lower())), F.lit(c)) for c, n in R.COUNTY_BY_CODE.items()]
    return F.coalesce(by_suffix, *by_place)


def filed_in_year(case_number: Column, year: int) -> Column:
    """Search prefix of a year (``24SP*``) as a predicate."""
    return F.startswith(case_number, F.lit(f"{year % 100:02d}SP"))
