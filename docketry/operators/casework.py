"""Merging extracted values into cases, and checks on the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.money import MONEY, bid_from_min, min_next_bid
from docketry.functions.predicates import address_fits_county, document_rank, is_bid_notice, is_sale_report
from docketry.functions.text import contains_any, norm_text
from docketry.operators.calendar import with_deadline
from docketry.operators.extraction import (
    bid_notice,
    document_bid,
    event_addresses,
    event_bids,
    extract_documents,
    next_minimum,
    report_bid,
    report_sale_date,
)
from docketry.operators.timeline import cycle_upset

MERGED_FIELDS = ["current_bid_amount", "next_bid_deadline", "sale_date", "legal_description", "trustee_name",
                 "attorney_name", "attorney_phone", "attorney_email"]


def best_address(documents: DataFrame) -> DataFrame:
    """Address from the best-ranked document of a case; newer documents first within a rank."""
    order = F.struct(document_rank(F.col("document_name")).alias("rank"), (-F.col("document_id")).alias("newest"),
                     F.col("property_address").alias("address"), F.col("address_quality").alias("quality"))
    best = documents.where(F.col("property_address").isNotNull()).groupBy("case_id").agg(F.min(order).alias("b"))
    return best.select("case_id", F.col("b.address").alias("document_address"), F.col("b.quality").alias("address_quality"))


def merge_fields(documents: DataFrame, cases: DataFrame, newest: str = "document_id") -> DataFrame:
    """First non-null value per field, newest document first.

    Documents of an earlier sale cycle give neither bid nor sale date: dated before the sale, or undated by name.
    """
    sold = cases.select("case_id", F.col("sale_date").alias("__sold"))
    undated = F.col("document_date").isNull() & F.startswith("document_name", F.lit("unknown"))
    old = F.coalesce(F.col("__sold").isNotNull() & ((F.col("document_date") < F.col("__sold")) | undated), F.lit(False))
    rows = documents.join(sold, "case_id").withColumn("__old", old)

    def newest_value(name: str) -> Column:
        usable = F.col(name).isNotNull()
        if name in ("current_bid_amount", "sale_date"):
            usable = usable & ~F.col("__old")
        return F.max(F.when(usable, F.struct(F.col(newest).alias("at"), F.col(name).alias("value"))))["value"].alias(name)

    return rows.groupBy("case_id").agg(*[newest_value(n) for n in MERGED_FIELDS])


def extract_cases(cases: DataFrame, events: DataFrame, documents: DataFrame) -> DataFrame:
    """All fields of a case from its events and documents.

    A bid in an event description outranks every document. Special proceedings take the address from events first,
    all others from documents first.
    """
    read = extract_documents(documents)
    special = F.coalesce(F.col("case_type") == "Special Proceeding", F.lit(False))
    t = (
        cases.select("case_id", "case_type", "sale_date")
        .join(merge_fields(read, cases).withColumnRenamed("sale_date", "read_sale_date"), "case_id", "left")
        .join(best_address(read), "case_id", "left")
        .join(event_bids(cases, events), "case_id", "left")
        .join(event_addresses(events), "case_id", "left")
    )
    from_event = special & F.col("event_address").isNotNull()
    return t.select(
        "case_id",
        F.when(from_event, F.col("event_address"))
        .otherwise(F.coalesce("document_address", "event_address")).alias("property_address"),
        F.when(from_event, F.lit(0)).otherwise(F.col("address_quality")).alias("address_quality"),
        F.coalesce("event_bid", "current_bid_amount").alias("current_bid_amount"),
        F.col("read_sale_date").alias("sale_date"),
        *[n for n in MERGED_FIELDS if n not in ("current_bid_amount", "sale_date")],
    )


def sticky_apply(cases: DataFrame, extracted: DataFrame) -> DataFrame:
    """Write extracted values in: a differing bid overwrites and sets the minimum, all else only fills gaps."""
    new = extracted.select("case_id", *[F.col(c).alias(f"__{c}") for c in extracted.columns if c != "case_id"])
    t = cases.join(new, "case_id", "left")
    fresh = (F.col("__current_bid_amount") != 0) & ~F.col("__current_bid_amount").eqNullSafe(F.col("current_bid_amount"))
    fresh = F.coalesce(fresh, F.lit(False))
    written = {
        "current_bid_amount": F.when(fresh, F.col("__current_bid_amount")).otherwise(F.col("current_bid_amount")),
        "minimum_next_bid": F.when(fresh, min_next_bid(F.col("__current_bid_amount"))).otherwise(F.col("minimum_next_bid")),
        "sale_date": F.coalesce("sale_date", "__sale_date"),
    }
    for name in ("property_address", "legal_description", "trustee_name", "attorney_name", "attorney_phone", "attorney_email"):
        if name in cases.columns:
            written[name] = F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(f"__{name}"))
    return t.select(*[written[c].cast(cases.schema[c].dataType).alias(c) if c in written else F.col(c) for c in cases.columns])


def bid_crosscheck(documents: DataFrame, bids: DataFrame) -> DataFrame:
    """Document bids more than ten per cent off the bid in the events."""
    read = documents.where(F.length("ocr_text") > 0).select(
        "document_id", "case_id", document_bid(F.col("ocr_text")).alias("document_bid")).where(F.col("document_bid").isNotNull())
    far = F.abs(F.col("document_bid") - F.col("event_bid")) * 10 > F.col("event_bid")
    return read.join(bids, "case_id").where(far)


def extraction_todo(documents: DataFrame) -> DataFrame:
    """Cases having text that no extraction has seen."""
    return documents.where(F.col("ocr_text").isNotNull() & F.col("extraction_attempted_at").isNull()).select(
        "case_id").where(F.col("case_id").isNotNull()).distinct()


def mark_attempted(documents: DataFrame, cases: DataFrame, moment: Column) -> DataFrame:
    """Stamp the unseen texts of the given cases."""
    hit = documents.join(cases.select("case_id", F.lit(True).alias("__hit")).distinct(), "case_id", "left")
    due = F.col("__hit") & F.col("ocr_text").isNotNull() & F.col("extraction_attempted_at").isNull()
    return hit.withColumn("extraction_attempted_at", F.when(due, moment).otherwise(F.col("extraction_attempted_at"))).drop("__hit")


def reset_for_reprocessing(cases: DataFrame, documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clear the address and the attempt marks of some cases; bids and sale dates come from events and stay."""
    flag = ids.select("case_id", F.lit(True).alias("__hit")).distinct()
    clear = lambda df, name: df.join(flag, "case_id", "left").withColumn(
        name, F.when(F.col("__hit").isNull(), F.col(name))).drop("__hit")
    return clear(cases, "property_address"), clear(documents, "extraction_attempted_at")


def missing_fields(cases: DataFrame) -> Column:
    """Names of the required fields that are NULL or blank."""
    kinds = dict(cases.dtypes)
    blank = lambda n: (F.col(n).isNull() | (F.trim(n) == "")) if kinds[n] == "string" else F.col(n).isNull()
    return F.array_compact(F.array(*[F.when(blank(n), F.lit(n)) for n in R.REQUIRED_FIELDS]))


def heal_report(cases: DataFrame, events: DataFrame, documents: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Incomplete upset_bid cases before and after a new extraction; ``read`` is that of the cases, if it was made already."""
    upset = cases.where(F.col("classification") == R.UPSET_BID)
    before = upset.select("case_id", "case_number", missing_fields(upset).alias("missing_before")).where(
        F.size("missing_before") > 0)
    ailing = upset.join(before.select("case_id"), "case_id", "left_semi")
    own = lambda df: df.join(before.select("case_id"), "case_id", "left_semi")
    healed = sticky_apply(ailing, read if read is not None else extract_cases(ailing, own(events), own(documents)))
    after = healed.select("case_id", missing_fields(healed).alias("missing_after"))
    return before.join(after, "case_id").withColumn("is_healed", F.size("missing_after") == 0)


#: The steps of the healing ladder, in order.
HEAL_STEPS = ("extract", "second_text", "re_read")
HEAL_LEDGER = "case_id bigint, step string, attempted_at timestamp_ntz"


def heal_due(cases: DataFrame, documents: DataFrame, ledger: DataFrame) -> DataFrame:
    """Incomplete upset_bid cases with the step that is next: the first the ledger (case_id, step) does not have yet.

    A case without documents has no text to read a second time and goes on to ``re_read``; one that went through all steps is
    ``exhausted``. ``attempts`` counts the steps taken. Steps the ladder does not know are left out of account.
    """
    upset = cases.where(F.col("classification") == R.UPSET_BID)
    ailing = upset.select("case_id", "case_number", missing_fields(upset).alias("missing")).where(F.size("missing") > 0)
    taken = ledger.where(F.col("step").isin(*HEAL_STEPS)).groupBy("case_id").agg(F.collect_set("step").alias("__taken"))
    texts = documents.where("case_id IS NOT NULL").groupBy("case_id").agg(F.lit(True).alias("__has"))
    t = ailing.join(taken, "case_id", "left").join(texts, "case_id", "left")
    done = F.coalesce("__taken", F.array().cast("array<string>"))
    steps = F.array(F.lit(HEAL_STEPS[0]), F.when(F.col("__has"), F.lit(HEAL_STEPS[1])), F.lit(HEAL_STEPS[2]))
    left = F.array_except(F.array_compact(steps), done)
    return t.select("case_id", "case_number", "missing", F.coalesce(F.get(left, F.lit(0)), F.lit("exhausted")).alias("step"),
                    F.size(done).alias("attempts"))


def heal_recorded(ledger: DataFrame, due: DataFrame, moment: Column) -> DataFrame:
    """The ledger with the steps now taken; a step a case has taken already is not entered again."""
    new = due.where(F.col("step") != "exhausted").select("case_id", "step").distinct().join(ledger.select("case_id", "step"), ["case_id", "step"], "left_anti")
    return ledger.select("case_id", "step", "attempted_at").unionByName(new.withColumn("attempted_at", moment))


def heal_counters(due: DataFrame) -> DataFrame:
    """Cases by the step that is next for them."""
    return due.groupBy("step").agg(F.count(F.lit(1)).alias("cases"), F.sum("attempts").cast("bigint").alias("attempts"))


def missing_bid_diagnosis(cases: DataFrame, events: DataFrame, documents: DataFrame) -> DataFrame:
    """Why an upset_bid case has no bid."""
    lacking = cases.where((F.col("classification") == R.UPSET_BID) & F.col("current_bid_amount").isNull())
    seen = events.join(lacking.select("case_id"), "case_id", "left_semi").groupBy("case_id").agg(
        F.count_if(F.col("event_type").ilike("%report%sale%")).alias("sale_events"),
        F.count_if(F.col("event_type").ilike("%upset%bid%")).alias("upset_events"))
    read = documents.join(lacking.select("case_id"), "case_id", "left_semi").where(F.col("ocr_text").isNotNull()).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("texts"), F.min("document_name").alias("__a"), F.max("document_name").alias("__b"))
    t = lacking.select("case_id", "case_number").join(seen, "case_id", "left").join(read, "case_id", "left")
    t = t.fillna(0, ["sale_events", "upset_events", "texts"])
    reason = (
        F.when(F.col("sale_events") == 0, "no sale event")
        .when(F.col("texts") == 0, "no text")
        .when(F.col("__a") == F.col("__b"), "only the main filing")
        .otherwise("no bid in text")
    )
    return t.select("case_id", "case_number", "sale_events", "upset_events", "texts", reason.alias("reason"))


def missing_bid_repair(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Bid for upset_bid cases without one: first notice by id, else last report, else a stated minimum."""
    lacking = cases.where((F.col("classification") == R.UPSET_BID) & F.col("current_bid_amount").isNull())
    texts = documents.where(F.length("ocr_text") > 0).join(lacking.select("case_id"), "case_id", "left_semi")
    body = F.col("ocr_text")
    read = texts.select(
        "case_id", "document_id",
        F.when(is_bid_notice(body), bid_notice(body)["current_bid"]).alias("notice"),
        F.when(is_sale_report(body), report_bid(body)).alias("report"),
        F.when(is_bid_notice(body) | is_sale_report(body), bid_from_min(next_minimum(body))).alias("stated"))
    at = lambda name: F.when(F.col(name).isNotNull(), F.struct("document_id", name))
    picked = read.groupBy("case_id").agg(F.min(at("notice")).alias("n"), F.max(at("report")).alias("r"), F.min(at("stated")).alias("s"))
    bid = F.coalesce("n.notice", "r.report", "s.stated")
    return picked.where(bid.isNotNull()).select(
        "case_id", bid.cast(MONEY).alias("current_bid_amount"), min_next_bid(bid).alias("minimum_next_bid"),
        F.coalesce("n.document_id", "r.document_id", "s.document_id").alias("document_id"))


def missing_address_repair(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Address by document rank for the cases that have none."""
    lacking = cases.where(F.coalesce(F.trim("property_address"), F.lit("")) == "")
    read = extract_documents(documents.join(lacking.select("case_id"), "case_id", "left_semi"))
    return best_address(read)


def best_bid_document(documents: DataFrame) -> DataFrame:
    """Document a case's bid is taken from: newest notice of upset bid, else the report the cycle began with."""
    body = F.col("ocr_text")
    texts = documents.where((F.length("ocr_text") > 0)
                            & contains_any(F.col("document_name"), ["upset bid", "report of", "notice of sale"]))
    read = (
        texts.select("case_id", "document_id", "document_date", body, is_sale_report(body).alias("is_report"),
                     is_bid_notice(body).alias("is_notice"))
        .where("is_report or is_notice")
        .withColumn("n", F.when(~F.col("is_report"), bid_notice(body)))
        .withColumn("bid", F.when(F.col("is_report"), report_bid(body)).otherwise(F.col("n.current_bid")))
        .where(F.col("bid") != 0)
    )
    # Newest first for notices, oldest first for reports; undated documents count as oldest.
    sign = F.when(F.col("is_report"), -1).otherwise(1)
    day = F.coalesce(F.unix_date("document_date"), F.unix_date(F.lit("0001-01-01").cast("date")))
    order = F.struct((~F.col("is_report")).alias("is_notice"), (day * sign).alias("day"), (F.col("document_id") * sign).alias("at"),
                     "document_id", "bid", F.col("n.minimum_next_bid").alias("minimum"),
                     F.when(F.col("is_report"), report_sale_date(body)).alias("report_sale_date"))
    best = read.groupBy("case_id").agg(F.max(order).alias("b"))
    return best.select("case_id", "b.document_id", "b.is_notice", "b.bid", "b.minimum", "b.report_sale_date")


def bid_update(cases: DataFrame, events: DataFrame, documents: DataFrame) -> DataFrame:
    """Bid, minimum, deadline and sale date a case gets from its best bid document."""
    base = cycle_upset(cases.select("case_id", "sale_date"), events).join(best_bid_document(documents), "case_id")
    t = with_deadline(base, F.coalesce("cycle_upset", "sale_date"), "deadline")
    return t.select(
        "case_id", F.col("bid").cast(MONEY).alias("current_bid_amount"),
        F.coalesce(F.col("minimum").cast(MONEY), min_next_bid(F.col("bid"))).alias("minimum_next_bid"),
        "deadline", F.coalesce("sale_date", "report_sale_date").alias("sale_date"))


def discrepancies(cases: DataFrame, analyses: DataFrame, parties: DataFrame) -> DataFrame:
    """Proposed values that disagree with the stored ones, one row per case and field.

    Bids count only when the proposed one is higher; a stored higher bid is a newer upset bid. For defendants the
    stored side shows the first name and how many more there are; the names themselves stay in the party table.
    """
    t = analyses.join(cases.select("case_id", "property_address", "current_bid_amount", "minimum_next_bid"), "case_id")
    named = t.where(F.length("proposed_defendant") > 0).select("case_id", norm_text(F.col("proposed_defendant")).alias("__want"))
    stored = parties.where(contains_any(F.col("party_type"), ["defendant"]) & (F.length("party_name") > 0))
    defendants = stored.join(named, "case_id").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("__stored"), F.min("party_name").alias("__first"),
        F.bool_or(norm_text(F.col("party_name")) == F.col("__want")).alias("__same"))
    t = t.join(defendants, "case_id", "left")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    other_place = norm_text(filled("proposed_address")) != norm_text(filled("property_address"))
    higher = lambda new, old: (F.col(new) != 0) & (F.col(old) != 0) & (F.col(new) - F.col(old) > 0.01)
    row = lambda test, field, old, new: F.when(test, F.struct(
        F.lit(field).alias("field"), old.cast("string").alias("db_value"), new.cast("string").alias("ai_value")))
    first = F.when(F.col("__stored") > 1, F.concat("__first", F.lit(" and "), F.col("__stored") - 1, F.lit(" more"))).otherwise(F.col("__first"))
    rows = F.array_compact(F.array(
        row(other_place, "property_address", F.col("property_address"), F.col("proposed_address")),
        row(higher("proposed_bid", "current_bid_amount"), "current_bid_amount", F.col("current_bid_amount"), F.col("proposed_bid")),
        row(higher("proposed_minimum", "minimum_next_bid"), "minimum_next_bid", F.col("minimum_next_bid"), F.col("proposed_minimum")),
        row((F.length("proposed_defendant") > 0) & ~F.coalesce("__same", F.lit(False)), "defendant_name", first, F.col("proposed_defendant"))))
    return t.select("case_id", F.inline(rows))


def apply_accepted(cases: DataFrame, accepted: DataFrame, parties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write accepted values into the cases; an accepted defendant joins the parties unless already there."""
    value = lambda field: F.max(F.when(F.col("field") == field, F.col("ai_value"))).alias(f"__{field}")
    wide = accepted.groupBy("case_id").agg(*[value(f) for f in ("property_address", "current_bid_amount", "minimum_next_bid")])
    t = cases.join(wide, "case_id", "left").withColumns({
        "property_address": F.coalesce("__property_address", "property_address"),
        "current_bid_amount": F.coalesce(F.col("__current_bid_amount").try_cast(MONEY), F.col("current_bid_amount")),
        "minimum_next_bid": F.coalesce(F.col("__minimum_next_bid").try_cast(MONEY), F.col("minimum_next_bid"))})
    names = accepted.where(F.col("field") == "defendant_name").select("case_id", F.col("ai_value").alias("party_name")).distinct()
    absent = names.join(parties, ["case_id", "party_name"], "left_anti")
    added = parties.unionByName(absent.select("case_id", F.lit("Defendant").alias("party_type"), "party_name"))
    return t.select(*cases.columns), added


def second_source_values(readings: DataFrame, fields: list[str]) -> DataFrame:
    """First non-null value per field, highest document id first."""
    pick = lambda n: F.max(F.when(F.col(n).isNotNull(), F.struct("document_id", n)))[n].alias(n)
    return readings.groupBy("case_id").agg(*[pick(n) for n in fields])


def merge_second_source(cases: DataFrame, readings: DataFrame) -> DataFrame:
    """Bid and minimum overwrite, the address does if it fits the county, the rest fills gaps."""
    fields = ["property_address", "bid_amount", "minimum_next_bid", "legal_description", "sale_date"]
    values = second_source_values(readings, fields)
    t = cases.join(values.select("case_id", *[F.col(f).alias(f"__{f}") for f in fields]), "case_id")
    fits = (F.length("__property_address") > 0) & address_fits_county(F.col("__property_address"), F.col("county_code"))
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    return t.select(
        "case_id",
        F.when(F.coalesce(fits, F.lit(False)), F.col("__property_address")).otherwise(F.col("property_address")).alias("property_address"),
        F.coalesce(some("__bid_amount"), F.col("current_bid_amount")).alias("current_bid_amount"),
        F.coalesce(some("__minimum_next_bid"), F.col("minimum_next_bid")).alias("minimum_next_bid"),
        F.coalesce(F.nullif(F.col("legal_description"), F.lit("")), F.col("__legal_description")).alias("legal_description"),
        F.coalesce("sale_date", "__sale_date").alias("sale_date"))


_BID_FIELDS = ["our_initial_bid", "our_second_bid", "our_max_bid"]
_PATCH_MONEY = _BID_FIELDS + ["estimated_sale_price", "estimated_rehab_cost"]


def checked_patches(cases: DataFrame, patches: DataFrame) -> DataFrame:
    """Cases joined to their patch, with the merged fields (``new_*``) and a reject reason, NULL when valid.

    An absent key keeps the stored value, a null clears it.
    """
    fields = F.from_json("patch_json", "map<string,string>")
    t = cases.join(patches.select("case_id", fields.alias("__p")), "case_id")
    has = lambda n: F.map_contains_key("__p", F.lit(n))
    sent = lambda n: F.try_element_at(F.col("__p"), F.lit(n))
    for n in _PATCH_MONEY:
        t = t.withColumn(f"new_{n}", F.when(has(n), sent(n).try_cast(MONEY)).otherwise(F.col(n)))
    t = t.withColumn("new_team_notes", F.when(has("team_notes"), sent("team_notes")).otherwise(F.col("team_notes")))
    status = sent("interest_status")
    t = t.withColumn("new_interest_status", F.when(status.isNull(), F.col("interest_status")).otherwise(F.nullif(status, F.lit(""))))
    # The interest rules look at what was sent, and at the stored value where nothing (or null) was sent.
    known = lambda n: F.coalesce(sent(n).try_cast(MONEY), F.col(n))
    lacks = known("estimated_sale_price").isNull()
    for n in _BID_FIELDS:
        lacks = lacks | known(n).isNull()
    notes = F.coalesce(sent("team_notes"), F.col("team_notes"), F.lit(""))
    ladder = (F.col("new_our_initial_bid") <= F.col("new_our_second_bid")) & (F.col("new_our_second_bid") <= F.col("new_our_max_bid"))
    reason = (
        F.when(F.coalesce(F.size("__p"), F.lit(0)) <= 0, "no data")
        .when((status == "interested") & lacks, "bid ladder incomplete")
        .when((status == "not_interested") & (F.trim(notes) == ""), "notes missing")
        .when(status.isNotNull() & ~status.isin("interested", "not_interested", ""), "unknown status")
        .when(F.coalesce(~ladder, F.lit(False)), "bid ladder out of order")
    )
    return t.withColumn("reject_reason", reason).drop("__p")


def apply_patches(cases: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patched cases, rejected patches)."""
    checked = checked_patches(cases, patches)
    names = _PATCH_MONEY + ["team_notes", "interest_status"]
    good = checked.where(F.col("reject_reason").isNull()).select(
        *[F.col(f"new_{c}").alias(c) if c in names else F.col(c) for c in cases.columns])
    rest = cases.join(good.select("case_id"), "case_id", "left_anti")
    return rest.unionByName(good), checked.where(F.col("reject_reason").isNotNull()).select("case_id", "reject_reason")


SALE_PAPERS = ["report of foreclosure sale", "report of sale", "allowing foreclosure sale", "affidavit",
               "notice of sale", "notice of foreclosure sale"]


def text_todo(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents still to be read: sale papers of cases lacking a bid, any document of cases lacking an address."""
    unread = documents.where(F.col("ocr_text").isNull())
    no_bid = cases.where((F.col("classification") == R.UPSET_BID) & F.col("current_bid_amount").isNull())
    no_address = cases.where(F.col("property_address").isNull())
    papers = unread.where(contains_any(F.col("document_name"), SALE_PAPERS)).join(no_bid, "case_id", "left_semi")
    anything = unread.join(no_address, "case_id", "left_semi")
    return papers.select("document_id", "case_id", F.lit("bid").alias("wanted")).unionByName(
        anything.select("document_id", "case_id", F.lit("address").alias("wanted")))
