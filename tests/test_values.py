"""Scalar rules and extraction against known values."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions import addresses as A
from docketry.functions import links as L
from docketry.functions import money as M
from docketry.functions import text as T
from docketry.operators import calendar as CAL
from docketry.operators import extraction as X


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("350,00.00", "350000.00"), ("$9,830.00", "9830.00"), ("856,161.56", "856161.56"), ("n/a", None), ("", None)])
def test_clean_amount(spark, text, expected):
    assert one(spark, text, M.clean_amount) == (None if expected is None else Decimal(expected))


def test_minimum_and_back(spark):
    bids = [Decimal("100.10"), Decimal("95000.00"), Decimal("123456.78"), Decimal("0.05")]
    rows = spark.createDataFrame([(b,) for b in bids], "b decimal(12,2)").select(
        "b", M.min_next_bid(F.col("b")).alias("m")).withColumn("back", M.bid_from_min(F.col("m"))).collect()
    assert rows[0]["m"] == Decimal("105.10") and rows[1]["m"] == Decimal("99750.00")
    assert all(abs(r["b"] - r["back"]) <= Decimal("0.01") for r in rows)


@pytest.mark.parametrize("address,stnum,prefix,name,city", [
    ("414 S. Salem Street, Apex, NC 27502", "414", "S", "SALEM", "Apex"),
    ("500 North Hills Drive, Raleigh, NC 27609", "500", None, "NORTH HILLS", "Raleigh"),
    ("303 SE Maynard Road, Cary, NC 27511", "303", "SE", "MAYNARD", "Cary"),
    ("4317 Scaup Court Raleigh, NC, 27616", "4317", None, "SCAUP", "Raleigh"),
    ("Main St.", None, None, "MAIN", None)])
def test_address_parts(spark, address, stnum, prefix, name, city):
    got = one(spark, address, A.address_parts)
    assert (got["stnum"], got["prefix"], got["name"], got["city"]) == (stnum, prefix, name, city)


def test_parcel_and_links(spark):
    parts = one(spark, "0753018148", A.parcel_split)
    assert (parts["map"], parts["block"], parts["lot"]) == ("0753", "01", "8148")
    assert one(spark, "075301814", A.parcel_split) is None and one(spark, "075301814x", A.parcel_split) is None
    assert "stname=north+hills&" in one(spark, "North Hills", lambda c: L.address_check_url(F.lit("5"), c))
    assert one(spark, "1 A St, Cary", L.listing_url).endswith("/1+A+St%2C+Cary_rb/")


def _holidays(year):
    """The twelve holidays listed independently of the library."""
    def nth(month, weekday, n):
        days = [dt.date(year, month, d) for d in range(1, 32) if _valid(year, month, d)]
        return [d for d in days if d.weekday() == weekday][n]

    a, b, c = year % 19, year % 4, year % 7  # Gauss, valid 1900-2199
    d = (19 * a + 24) % 30
    e = (2 * b + 4 * c + 6 * d + (5 if year < 2100 else 6)) % 7
    easter = dt.date(year, 3, 22) + dt.timedelta(d + e)
    if (d, e) == (29, 6) or (d == 28 and e == 6 and a > 10):
        easter -= dt.timedelta(7)
    thanks = nth(11, 3, 3)
    days = [dt.date(year, 1, 1), nth(1, 0, 2), easter - dt.timedelta(2), nth(5, 0, -1), dt.date(year, 7, 4), nth(9, 0, 0), dt.date(year, 11, 11),
            thanks, thanks + dt.timedelta(1), dt.date(year, 12, 24), dt.date(year, 12, 25), dt.date(year, 12, 26)]
    return {d + dt.timedelta({5: -1, 6: 1}.get(d.weekday(), 0)) for d in days}


def _valid(year, month, day):
    try:
        return bool(dt.date(year, month, day))
    except ValueError:
        return False


def test_calendar_by_day(spark):
    """Every day of two stretches, far from each other and beyond any table of years."""
    for first, last in ((dt.date(1960, 1, 1), dt.date(1972, 12, 31)), (dt.date(1995, 1, 1), dt.date(2030, 12, 31)), (dt.date(2099, 1, 1), dt.date(2106, 12, 31))):
        days = spark.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
        kept = {y: _holidays(y) for y in range(first.year - 1, last.year + 2)}
        open_day = lambda d, kept=kept: d.weekday() < 5 and d not in kept[d.year]
        for r in CAL.with_business_day(days, F.col("day")).collect():
            assert r["is_business"] == open_day(r["day"]), r
            d = r["day"]
            while not open_day(d):
                d += dt.timedelta(1)
            assert r["next_business_day"] == d


def test_deadlines_of_any_year(spark):
    days = spark.createDataFrame([(dt.date(1969, 12, 1),), (dt.date(2100, 12, 25),), (dt.date(2101, 1, 5),), (None,)], "day date")
    got = {r["day"]: r["deadline"] for r in CAL.with_deadline(days, F.col("day"), "deadline").collect()}
    assert got == {dt.date(1969, 12, 1): dt.date(1969, 12, 11), dt.date(2100, 12, 25): dt.date(2101, 1, 4), dt.date(2101, 1, 5): dt.date(2101, 1, 18), None: None}


ADDRESSES = [
    ("assessments upon 4317 Scaup Court Raleigh, NC, 27616, being known as Lot 96", "4317 Scaup Court Raleigh, NC, 27616", 12),
    ("c/o Brock & Scott, PLLC\n5431 Oleander Drive Suite 200, Wilmington, NC 28403", None, None),
    ("Address of Property: 88 Maple Springs Ln, Cary, NC 27511-1234 and so on", "88 Maple Springs Ln, Cary, NC 27511-1234", 7),
    ("ADDRESS/LOCATION OF PROPERTY:\n12 Oak Street Summons Submitted Yes No, Cary, NC 27511", "12 Oak Street , Cary, NC 27511", 5),
    ("Address of Property:  77 Elm Road, Apex, NC 27502", "77 Elm Road, Apex, NC 27502", 7),
    ("nothing here", None, None)]


@pytest.mark.parametrize("text,address,quality", ADDRESSES)
def test_address_of(spark, text, address, quality):
    got = one(spark, text, X.address_of)
    assert ((got["address"], got["quality"]) if got else (None, None)) == (address, quality)


def test_long_text_is_read_whole(spark):
    text = "12 " + "word " * 20000 + "\nAddress of Property: 5 Elm Street, Cary, NC 27511"
    assert one(spark, text, X.address_of)["address"] == "5 Elm Street, Cary, NC 27511"


def test_bid_notice_form(spark):
    text = "NOTICE OF UPSET BID\nMinimum Amount Of Next Upset Bid   Amount Of Deposit For Next\n $58,782.80   $2,939.14"
    got = one(spark, text, X.bid_notice)
    assert (got["minimum_next_bid"], got["current_bid"], got["deposit_required"]) == (Decimal("58782.80"), Decimal("55983.62"), Decimal("2939.14"))


def test_needles_are_necessary():
    import re

    for pattern in R.REPORT_BID + R.DEADLINE_TEXT + R.NOTICE_MINIMUM + R.EVENT_BID + [p for _, p in R.ADDRESS_PATTERNS]:
        found = T.needle(pattern)
        assert found is None or found == found.lower()
    assert T.needle(r"[Hh]ighest\s*[Bb]id") == "highest" and T.needle(r"(?:sold|bought)\s+for") == "for" and T.needle(r"(?:abc)?\d+") is None
    assert T.needle(r"assessments?\s+upon") == "assessment" and re.search("assessments?", "assessment")


def test_case_numbers(spark):
    got = one(spark, "see 25 SP 1024 and 25SP001024-910, 25sp77 x", T.case_numbers_in)
    assert sorted(got) == ["25SP001024", "25SP001024-910"]


@pytest.mark.parametrize("text,want", [
    ("assessments upon 12 One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Court Raleigh, NC, 27616", "12 One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Court Raleigh, NC, 27616"),
    ("The owner lives at 5 Elm Avenue, Very Long Name Of A Town Of Eight Words North Carolina 27514", None),
    ("lives at 5 Elm Avenue, One Two Three Four Five Six Seven Eight North Carolina 27514", "5 Elm Avenue, One Two Three Four Five Six Seven Eight North Carolina 27514"),
])
def test_addresses_of_many_words(spark, text, want):
    got = one(spark, text, X.address_of)
    assert (got and got["address"]) == want


def test_address_rules_on_very_long_texts(spark):
    words = "Word " * 20_000
    for text in (f"assessments upon 12 {words}", f"assessments upon 12 {words} Court Raleigh, NC, 27616", f"familiar with x at 5 Elm Street {words} NC x"):
        one(spark, text, X.address_of)


def test_words_a_pattern_must_contain():
    """Patterns without a needle are spared the texts that lack all words of their choice (F6)."""
    from docketry import rules as R
    from docketry.functions.text import needle, word_choice

    assert needle(R.ATTORNEY_NAME[1]) is None and word_choice(R.ATTORNEY_NAME[1]) == ["trustee", "attorney"]
    for pattern in ("a(?:one|two)?b", "x|(?:one|two)", "(?:(?:one|two)x)?", "(?:one|of)", r"\(?:one|two\)", "(?:one|two)*"):
        assert word_choice(pattern) is None, pattern
    for pattern in (p for v in vars(R).values() if isinstance(v, list) for p in v if isinstance(p, str)):
        assert word_choice(pattern) is None or "(?:" in pattern
