"""Named queries over the sample tables, each with the check SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources.sample_views import SampleTables, check_sql


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SampleTables], DataFrame]
    sql: str | None
    money: tuple[str, ...]
    days: tuple[str, ...]
    moments: tuple[str, ...]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(SampleTables(spark, folder))
        shown = {n: F.col(n).cast("double") for n in self.money}
        shown |= {n: F.col(n).cast("string") for n in self.days}
        shown |= {n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in self.moments}
        return df.withColumns(shown) if shown else df

    def check(self) -> str | None:
        if self.sql is None:
            return None
        text = check_sql(self.sql)
        shown = [f"CAST({n} AS DOUBLE) AS {n}" for n in self.money]
        shown += [f"CAST({n} AS VARCHAR) AS {n}" for n in self.days + self.moments]
        return f"SELECT * REPLACE ({', '.join(shown)}) FROM ({text}) AS result" if shown else text


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, money: str = "", days: str = "", moments: str = ""):
    """Register a builder under ``name``; ``money``/``days``/``moments`` list the columns shown as plain values."""

    def add(build: Callable[[SampleTables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, sql, tuple(money.split()), tuple(days.split()), tuple(moments.split()))
        return build

    return add


# Fragments of check SQL ----------------------------------------------------------------------------------------


def sql_any(expr: str, words: list[str]) -> str:
    """Case-insensitive substring test, NULL counting as false."""
    tests = " OR ".join("contains(lower({}), '{}')".format(expr, w.lower().replace("'", "''")) for w in words)
    return f"coalesce({tests}, false)"


def sql_rule(expr: str, kinds: list[str], exclusions: list[str] | None = None) -> str:
    return f"({sql_any(expr, kinds)}" + (f" AND NOT {sql_any(expr, exclusions)})" if exclusions else ")")


SQL_CALENDAR = """
years AS (SELECT CAST(range AS INTEGER) AS y FROM range(1970, 2101)),
moon AS (SELECT y, (19*(y%19) + y//100 - (y//100)//4 - ((y//100) - ((y//100)+8)//25 + 1)//3 + 15) % 30 AS h,
    y%19 AS a, y//100 AS b, y%100 AS c FROM years),
week AS (SELECT *, (32 + 2*(b%4) + 2*(c//4) - h - c%4) % 7 AS l FROM moon),
easter AS (SELECT y, make_date(y, (h+l-7*((a+11*h+22*l)//451)+114)//31, (h+l-7*((a+11*h+22*l)//451)+114)%31+1) AS sunday FROM week),
month_days AS (SELECT y, CAST(d AS DATE) AS d FROM years, range(make_date(y,1,1), make_date(y+1,1,1), INTERVAL 1 DAY) t(d)),
ranked AS (SELECT y, d, month(d) AS m, isodow(d) AS w, row_number() OVER (PARTITION BY y, month(d), isodow(d) ORDER BY d) AS n,
    row_number() OVER (PARTITION BY y, month(d), isodow(d) ORDER BY d DESC) AS back FROM month_days),
rules AS (
    SELECT y, d FROM ranked WHERE (m=1 AND day(d)=1) OR (m=7 AND day(d)=4) OR (m=11 AND day(d)=11) OR (m=12 AND day(d) IN (24,25,26))
      OR (m=1 AND w=1 AND n=3) OR (m=5 AND w=1 AND back=1) OR (m=9 AND w=1 AND n=1) OR (m=11 AND w=4 AND n=4)
    UNION ALL SELECT y, d+1 FROM ranked WHERE m=11 AND w=4 AND n=4
    UNION ALL SELECT y, sunday-2 FROM easter),
observed AS (SELECT DISTINCT y, d, CASE isodow(d) WHEN 6 THEN d-1 WHEN 7 THEN d+1 ELSE d END AS day FROM rules),
business AS (SELECT d AS day FROM month_days WHERE isodow(d) < 6 AND NOT EXISTS
    (SELECT 1 FROM observed o WHERE o.day = month_days.d AND o.y = month_days.y)),
deadlines AS (SELECT CAST(m.d - 10 AS DATE) AS day, (SELECT min(b.day) FROM business b WHERE b.day >= m.d AND b.day <= m.d + 7) AS deadline
    FROM month_days m)"""
