"""Fields out of document and event text with ordered rules.

Everything is a native column expression: patterns are tried left to right inside ``coalesce``, so a later pattern is
evaluated only for the rows the earlier ones missed, and no text leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.dates import deadline_day, sale_day, slash_day
from docketry.functions.money import (
    MONEY,
    bid_from_min,
    clean_amount,
    loose_amount,
    plain_amount,
    strict_amount,
)
from docketry.functions.predicates import is_bid_notice, is_sale_report
from docketry.functions.text import any_of, contains_any, first_of, folded, group_of, let, plain_blanks, when_possible
from docketry.operators.calendar import with_deadline
from docketry.operators.ranking import group_rank

_REJECT = "(?i)" + "|".join(R.ADDRESS_REJECT_BEFORE + [any_of(R.ATTORNEY_MARKERS)])
_LEGAL = "|".join(R.LEGAL_WORDS_IN_ADDRESS)
CONTEXT_CHARS = 300
MIN_ADDRESS_CHARS = 10


# --- property address ----------------------------------------------------------------------------------------------


def _tidy(raw: Column) -> Column:
    """Label words and everything after the ZIP cut off, form residue taken out."""
    out = raw
    for label in (r"(?i)^commonly\s+known\s+as\s+", r"(?i)^known\s+as\s+"):
        out = F.regexp_replace(out, label, "")
    out = F.trim(F.regexp_replace(out, r"^(.*?\d{5}(?:-\d{4})?).*$", "$1"))
    for residue in R.FORM_ARTIFACTS:
        out = F.regexp_replace(out, "(?i)" + residue, "")
    return folded(out)

_CITY_WORDS = r"(?:\s+[A-Z][a-z]+)*"


def _match(text: Column, low: Column, before: Column | None, groups: int, pattern: str,
           found: Callable[[Column], Column]) -> Column:
    """``found(address)`` for the first match of one pattern, NULL without a match.

    The address is NULL when the match is rejected by what precedes it or by its own content.
    """
    # Greedy words of a city, kept once taken: they stop before the state, so giving some back could never help, and a
    # run of many words needs no stack.
    rx = "(?i)" + pattern.replace(_CITY_WORDS, rf"(?:\s+(?!{R.STATE}\s+\d{{5}})[A-Z][a-z]+)*+")
    raw = folded(F.regexp_extract(text, rx, 1))
    if groups == 2:
        raw = F.concat(raw, F.lit(", "), folded(F.regexp_extract(text, rx, 2)))

    def accepted(start: Column) -> Column:
        own = F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(1)), F.least(start - 1, F.lit(CONTEXT_CHARS)))
        context = own if before is None else F.right(F.concat(before, own), F.lit(CONTEXT_CHARS))
        fits = lambda a: F.when((F.length(a) >= MIN_ADDRESS_CHARS) & ~a.rlike(_LEGAL), a)
        return F.when(start > 0, found(F.when(~context.rlike(_REJECT), let(_tidy(raw), fits))))

    return when_possible(low, pattern, let(F.regexp_instr(text, F.lit(rx)), accepted))


def address_of(text: Column) -> Column:
    """``struct<address, quality>``; quality is the position of the pattern, lower is better. NULL if none holds."""

    def search(plain: Column, low: Column) -> Column:
        tries = [
            let(_match(plain, low, None, groups, pattern, lambda a: a),
                lambda a, q=quality: F.when(a.isNotNull(), F.struct(a.alias("address"), F.lit(q).alias("quality"))))
            for quality, (groups, pattern) in enumerate(R.ADDRESS_PATTERNS)
        ]
        return F.coalesce(*tries)

    possible = lambda plain: F.when(
        plain.rlike("(?i)" + R.ADDRESS_NEEDS), let(F.lower(plain), lambda low: search(plain, low)))
    return let(plain_blanks(text), possible)


def joined_address(documents: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """Address over the texts of a case read as one: per pattern the first match of the whole case decides.

    The texts are never put together. A match lies inside one document; the 300 characters before it may reach back
    over earlier documents, which are supplied by a short window over chunks of the case's document sequence.
    """
    texts = documents.where(F.length("ocr_text") > 0).select(
        "case_id", "document_id", plain_blanks(F.col("ocr_text")).alias("text"))
    texts = texts.withColumn("__bucket", F.floor(F.col("document_id") / chunk_rows))
    ranked = group_rank(texts, ["case_id"], ["__bucket"], [F.col("document_id")], "__n")
    # One text adds at least three characters, so a hundred earlier ones always fill the context.
    reach = CONTEXT_CHARS // 3
    chunk = F.floor((F.col("__n") - 1) / chunk_rows)
    near_end = (F.col("__n") - 1) % chunk_rows >= chunk_rows - reach
    copies = ranked.withColumn("__chunk", F.explode(F.when(near_end, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    earlier = Window.partitionBy("case_id", "__chunk").orderBy("__n").rowsBetween(-reach, -1)
    tail = F.concat(F.right("text", F.lit(CONTEXT_CHARS)), F.lit("\n\n"))
    placed = (
        copies.withColumn("__tail", tail)
        .withColumn("before", F.right(F.array_join(F.collect_list("__tail").over(earlier), ""), F.lit(CONTEXT_CHARS)))
        .where(F.col("__chunk") == chunk)
        .where(F.col("text").rlike("(?i)" + R.ADDRESS_NEEDS))
    )
    outcomes = []
    for quality, (groups, pattern) in enumerate(R.ADDRESS_PATTERNS):
        outcomes.append(_match(
            F.col("text"), F.lower("text"), F.coalesce("before", F.lit("")), groups, pattern,
            lambda a, q=quality: F.struct(F.lit(q).alias("quality"), a.alias("address"))))
    first = (
        placed.select("case_id", "document_id", F.inline(F.array_compact(F.array(*outcomes))))
        .groupBy("case_id", "quality").agg(F.min(F.struct("document_id", "address")).alias("m"))
        .where(F.col("m.address").isNotNull())
    )
    best = first.groupBy("case_id").agg(F.min(F.struct("quality", "m.address")).alias("b"))
    return best.select("case_id", F.col("b.address").alias("address"), F.col("b.quality").alias("quality"))


# --- amounts ---------------------------------------------------------------------------------------------------------


def generic_bid(text: Column) -> Column:
    return first_of(plain_blanks(text), R.GENERIC_BID, plain_amount)


def _label_end(text: Column, label: str) -> Column:
    """Position just after a label's first match; NULL without one."""
    rx = F.lit("(?i)" + label)
    return F.regexp_instr(text, rx) + F.length(F.regexp_substr(text, rx))


def _amounts_after(text: Column, label: str) -> Column:
    """Valid amounts that begin after a label; one that touches the label belongs to the label."""
    rest = F.substring(text, _label_end(text, label), F.length(text))
    rest = F.regexp_replace(rest, "^" + R.FORM_AMOUNT, "")
    found = F.transform(F.regexp_extract_all(rest, F.lit(R.FORM_AMOUNT), F.lit(1)), lambda x: strict_amount(x))
    return F.array_compact(found)


def _first_amount(text: Column) -> Column:
    return let(group_of(text, r"\$?\s*(\d[\d,\.\s]+\.\d{2})", flags=""), strict_amount)


def is_bid_form(text: Column) -> Column:
    return (
        F.contains(text, F.lit("AmountofNew"))
        | F.contains(F.replace(text, F.lit("  "), F.lit(" ")), F.lit("Amount Of New"))
        | F.contains(F.upper(text), F.lit("NOTICE OF UPSET BID"))
    )


def bid_notice(text: Column) -> Column:
    """``struct<current_bid, previous_bid, minimum_next_bid, deposit_required>`` of a notice of upset bid.

    On the court form the typed bottom line counts: minimum next bid within 50 characters of its label, the bid
    computed back from it, the deposit as last amount of the line. Otherwise amounts are assigned by position after
    the labels; texts that are not the form go through pattern lists.
    """
    at = lambda values, i: F.get(values, F.lit(i))

    def shaped(minimum: Column, direct: Column, previous: Column, deposit: Column) -> Column:
        return F.struct(
            F.coalesce(direct, bid_from_min(minimum)).cast(MONEY).alias("current_bid"),
            previous.cast(MONEY).alias("previous_bid"), minimum.cast(MONEY).alias("minimum_next_bid"),
            deposit.cast(MONEY).alias("deposit_required"))

    def on_form(plain: Column) -> Column:
        stated = _first_amount(F.substring(plain, _label_end(plain, R.FORM_MINIMUM_LABEL), F.lit(50)))
        line = F.substring(plain, _label_end(plain, R.FORM_DEPOSIT_LABEL), F.lit(100))
        deposits = F.regexp_extract_all(line, F.lit(r"\$?\s*(\d[\d,\.\s]+\.\d{2})"), F.lit(1))
        deposit = let(F.try_element_at(deposits, F.lit(-1)), strict_amount)
        former = let(group_of(plain, R.FORM_PREVIOUS), strict_amount)

        def from_line(minimum: Column) -> Column:
            bid = bid_from_min(minimum)
            return shaped(minimum, bid, F.when(former < bid, former), deposit)

        def by_position(amounts: Column) -> Column:
            above, below = amounts["above"], amounts["below"]
            return shaped(at(below, 0), at(above, 1), at(above, 0), F.coalesce(at(below, 1), deposit))

        placed = F.struct(_amounts_after(plain, R.FORM_PREVIOUS_POSITION).alias("above"),
                          _amounts_after(plain, R.FORM_MINIMUM_POSITION).alias("below"))
        return let(stated, lambda m: F.when(m.isNotNull(), from_line(m)).otherwise(let(placed, by_position)))

    def elsewhere(plain: Column) -> Column:
        by = lambda patterns: first_of(plain, patterns, strict_amount, flags="is")
        return let(by(R.NOTICE_MINIMUM), lambda m: shaped(
            m, by(R.NOTICE_NEW_BID), by(R.NOTICE_PREVIOUS_BID), by(R.NOTICE_DEPOSIT)))

    return let(plain_blanks(text), lambda p: F.when(is_bid_form(p), on_form(p)).otherwise(elsewhere(p)))


def deadline_text(text: Column) -> Column:
    """Deadline as printed. Kept for audit only: deadlines are always computed from event dates."""
    return first_of(plain_blanks(text), R.DEADLINE_TEXT, deadline_day)


def notice_deadline(text: Column) -> Column:
    """Printed deadline; on the column form the first date that begins after the label."""
    columns = F.contains(text, F.lit("AmountofNew")) | F.contains(
        F.replace(text, F.lit("  "), F.lit(" ")), F.lit("Amount Of New"))
    rest = F.substring(text, _label_end(text, R.FORM_DEADLINE_LABEL), F.length(text))
    rest = F.regexp_replace(rest, r"^\d{1,2}/\d{1,2}/\d{4}", "")
    placed = slash_day(group_of(rest, r"(\d{1,2}/\d{1,2}/\d{4})", flags=""))
    return F.coalesce(F.when(columns, placed), deadline_text(text))


def report_bid(text: Column) -> Column:
    text = plain_blanks(text)
    direct = first_of(text, R.REPORT_BID, loose_amount, flags="is")
    stated = let(group_of(text, R.REPORT_MINIMUM, flags="is"), loose_amount)
    return F.coalesce(direct, bid_from_min(stated)).cast(MONEY)


def report_sale_date(text: Column) -> Column:
    return first_of(plain_blanks(text), R.REPORT_SALE_DATE, sale_day)


def with_sale_report(df: DataFrame, text: str) -> DataFrame:
    """Add initial_bid, sale_date and the deadline that follows from it."""
    out = df.withColumns({"initial_bid": report_bid(F.col(text)), "report_sale_date": report_sale_date(F.col(text))})
    return with_deadline(out, F.col("report_sale_date"), "next_deadline")


def next_minimum(text: Column) -> Column:
    return first_of(plain_blanks(text), R.REPORT_NEXT_MINIMUM, plain_amount)


def page_bid(text: Column) -> Column:
    """First amount above 1,000 on a page, labelled amounts before bare ones."""
    tries = []
    for pattern in R.PAGE_BID:
        found = F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(1))
        big = F.filter(F.transform(found, lambda x: plain_amount(x)), lambda x: x > 1000)
        tries.append(F.get(big, F.lit(0)))
    return F.coalesce(*tries).cast(MONEY)


# --- dates, names, contacts ----------------------------------------------------------------------------------------


def sale_date_text(text: Column) -> Column:
    return first_of(plain_blanks(text), R.SALE_DATE_TEXT, sale_day)


def legal_description(text: Column) -> Column:
    return first_of(plain_blanks(text), R.LEGAL_DESCRIPTION, folded, flags="is")


def trustee_name(text: Column) -> Column:
    return first_of(plain_blanks(text), R.TRUSTEE_NAME, F.trim)


def attorney_name(text: Column) -> Column:
    """A bare bar number is no name."""
    return first_of(plain_blanks(text), R.ATTORNEY_NAME, lambda hit: F.when(~hit.rlike(r"^\d+$"), F.trim(hit)))


def phone(text: Column) -> Column:
    return group_of(text, R.PHONE, flags="")


def email(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.lower(group_of(text, R.EMAIL, flags="")))


def document_bid(text: Column) -> Column:
    """Notice of upset bid first, then report of sale, then any labelled amount."""
    return F.coalesce(
        F.when(is_bid_notice(text), bid_notice(text)["current_bid"]),
        F.when(is_sale_report(text), report_bid(text)),
        generic_bid(text),
    ).cast(MONEY)


def document_fields(text: Column) -> dict[str, Column]:
    """All fields of one document."""
    address = address_of(text)
    return {
        "property_address": address["address"],
        "address_quality": address["quality"],
        "current_bid_amount": document_bid(text),
        "next_bid_deadline": deadline_text(text),
        "sale_date": sale_date_text(text),
        "legal_description": legal_description(text),
        "trustee_name": trustee_name(text),
        "attorney_name": attorney_name(text),
        "attorney_phone": phone(text),
        "attorney_email": email(text),
    }


def extract_documents(documents: DataFrame) -> DataFrame:
    """Documents with text and their extracted fields; a narrow projection, no shuffle."""
    fields = document_fields(F.col("ocr_text"))
    # The address struct is made once and read twice.
    kept = documents.where(F.length("ocr_text") > 0).withColumn("__a", address_of(F.col("ocr_text")))
    fields |= {"property_address": F.col("__a.address"), "address_quality": F.col("__a.quality")}
    return kept.select(*[c for c in documents.columns if c != "ocr_text"], *[c.alias(n) for n, c in fields.items()])


# --- events ----------------------------------------------------------------------------------------------------------


def _newest_first(value: str) -> Column:
    """Value of the newest event: undated ones last, larger id on ties."""
    order = F.struct(F.coalesce("event_date", F.lit("0001-01-01").cast("date")).alias("day"), "event_id",
                     F.col(value).alias("value"))
    return F.max(order)["value"]


def description_bid(description: Column) -> Column:
    positive = lambda hit: F.when(clean_amount(hit) > 0, clean_amount(hit))
    return first_of(description, R.EVENT_BID, positive, flags="").cast(MONEY)


def event_bids(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Bid of the newest bid event of the current sale cycle, per case."""
    found = (
        events.where(contains_any(F.col("event_type"), R.EVENT_BID_KINDS))
        .withColumn("bid", description_bid(F.col("event_description"))).where(F.col("bid").isNotNull())
        .select("case_id", "event_id", "event_date", "bid")
        .join(cases.select("case_id", F.col("sale_date").alias("__sold")), "case_id")
        .where(F.col("__sold").isNull() | (F.col("event_date") >= F.col("__sold")))
    )
    return found.groupBy("case_id").agg(_newest_first("bid").alias("event_bid"))


def description_address(description: Column) -> Column:
    return F.trim(group_of(F.trim(description), R.EVENT_ADDRESS_PATTERN))


def event_addresses(events: DataFrame) -> DataFrame:
    """Address of the newest event that names one, per case."""
    found = (
        events.where(contains_any(F.col("event_type"), R.EVENT_ADDRESS_KINDS))
        .withColumn("address", description_address(F.col("event_description"))).where(F.col("address").isNotNull())
    )
    return found.groupBy("case_id").agg(_newest_first("address").alias("event_address"))
