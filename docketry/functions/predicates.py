"""Event, case and document rules as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.text import contains_any, first_index, starts_as_any


def event_matches(event_type: Column, kinds: list[str], exclusions: list[str] | None = None,
                  strict: bool = False, lowered: bool = False) -> Column:
    """The type names one of ``kinds`` and none of ``exclusions``; strict wants it at the start of the type."""
    hit = starts_as_any(event_type, kinds) if strict else contains_any(event_type, kinds, lowered)
    return hit & ~contains_any(event_type, exclusions, lowered) if exclusions else hit


def event_flags(event_type: Column, lowered: bool = False) -> dict[str, Column]:
    """All timeline rules, one boolean each."""
    rule = lambda kinds, *more, **how: event_matches(event_type, kinds, *more, lowered=lowered, **how)
    return {
        "is_sale": rule(R.SALE_REPORT),
        "is_sale_baseline": rule(R.SALE_BASELINE),
        "is_confirmed": rule(R.SALE_CONFIRMED, R.SALE_CONFIRMED_NOT),
        "is_set_aside": rule(R.SET_ASIDE),
        "is_bankruptcy": rule(R.BANKRUPTCY, R.BANKRUPTCY_NOT),
        "is_lifted": rule(R.LIFTED),
        "is_dismissal": rule(R.DISMISSAL, R.DISMISSAL_NOT),
        "is_reversed": rule(R.REVERSED),
        "is_upset": rule(R.UPSET_FILED),
        "is_upset_filed": rule(["upset bid filed"]),
        "is_initiated": rule(R.INITIATED, R.INITIATED_NOT),
        "is_legacy": rule(R.LEGACY, R.LEGACY_NOT, strict=True),
        "is_withdrawn": rule(["withdrawn"], ["upset bid"]),
        "is_final": rule(R.FINALIZATION),
    }


def monitor_flags(event_type: Column) -> dict[str, Column]:
    """Flags of the page monitor; blocking is bankruptcy or dismissal without their exclusions."""
    return {
        "is_sale": contains_any(event_type, R.SALE_REPORT),
        "is_upset": contains_any(event_type, R.UPSET_FILED),
        "is_blocking": contains_any(event_type, R.BANKRUPTCY + R.DISMISSAL),
    }


def is_foreclosure_type(case_type: Column) -> Column:
    low = F.lower(case_type)
    return F.coalesce(F.contains(low, F.lit("foreclosure")) | (low == "special proceeding"), F.lit(False))


def case_kind(case_type: Column, style: Column) -> Column:
    """HOA, Estate or Mortgage."""
    return (
        F.when(F.contains(F.upper(style), F.lit("HOA")), "HOA")
        .when((case_type == "Special Proceeding")
              & ~F.coalesce(F.contains(style, F.lit("Foreclosure")), F.lit(False)), "Estate")
        .otherwise("Mortgage")
    )


def is_bid_notice(text: Column) -> Column:
    """One of the notice's phrases, or its minimum label with anything between the two halves on one line."""
    plain = [m for m in R.NOTICE_MARKERS if "*" not in m]
    label = contains_any(text, ["minimum am"]) & text.rlike("(?i)" + [m for m in R.NOTICE_MARKERS if "*" in m][0])
    return contains_any(text, plain) | F.coalesce(label, F.lit(False))


def is_sale_report(text: Column) -> Column:
    """Any strong marker, or at least two of the weak ones."""
    strong = contains_any(text, R.REPORT_MARKERS)
    weak = sum((contains_any(text, [m]).cast("int") for m in R.REPORT_WEAK_MARKERS[1:]),
               contains_any(text, R.REPORT_WEAK_MARKERS[:1]).cast("int"))
    return strong | (weak >= 2)


def needs_second_source(name: Column, text: Column, bid: Column) -> Column:
    """A bid document whose amount label (or minimum label) stands without a value."""
    amount_label = text.rlike(r"(?i)Amount\s*(?:of\s+)?Bid")
    dollars = text.rlike(r"\$\s*[\d,]+\.?\d*")
    minimum_label = text.rlike(r"(?i)Minimum\s+Amount.*Next\s+Upset")
    minimum_value = text.rlike(r"(?i)Minimum\s+Amount.*Next\s+Upset[\s\S]{0,100}\$\s*[\d,]+")
    open_label = (amount_label & ~dollars) | (minimum_label & ~minimum_value)
    return contains_any(name, R.SECOND_SOURCE_KINDS) & bid.isNull() & F.coalesce(open_label, F.lit(False))


def document_flags(text: Column) -> dict[str, Column]:
    """Kind of an event by its text: upset bid, or sale (report of ... sale, notice of sale)."""
    has = lambda word: contains_any(text, [word])
    return {
        "is_upset_document": has("upset bid"),
        "is_sale_document": (has("report of") & has("sale")) | has("notice of sale"),
    }


def usable_text(text: Column, ocr: bool = False) -> Column:
    """Text worth extracting from: more than 100 characters when direct, 50 when recognised from an image."""
    size = F.length(F.trim(text))
    return F.coalesce(size >= 50 if ocr else size > 100, F.lit(False))


def document_rank(name: Column) -> Column:
    """Order in which documents are searched for an address; lower is better."""
    return first_index(name, R.ADDRESS_DOCUMENT_ORDER)


def document_tier(name: Column, case_number: Column) -> Column:
    """1 to 4 for the analysis corpus; a file named after its case is always 1."""
    low = F.lower(name)
    out = F.when(F.contains(low, F.lower(case_number)), F.lit(1))
    for word, tier in R.DOCUMENT_TIERS.items():
        out = out.when(F.contains(low, F.lit(word)), F.lit(tier))
    return out.otherwise(F.lit(R.DEFAULT_TIER))


def is_form_residue(address: Column) -> Column:
    return contains_any(address, ["summons submitted"])


def address_fits_county(address: Column, county_code: Column) -> Column:
    """The address names a city of the county, or at least the state."""
    out = contains_any(address, [", nc"])
    for code, cities in R.CITIES_BY_COUNTY_CODE.items():
        out = out | ((county_code == code) & contains_any(address, cities))
    return F.coalesce(out, F.lit(False))


