"""Keyed updates: upserts, cascades, quarantine, queues, watch lists."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.dates import as_day, as_moment
from docketry.functions.text import contains_any
from docketry.operators.calendar import with_deadline
from docketry.operators.ranking import keep_first

QUARANTINE_EVENTS = "array<struct<event_date:string,event_type:string,document_title:string,has_document:boolean>>"


def upsert_cases(current: DataFrame, new: DataFrame, as_of: datetime) -> DataFrame:
    """Existing cases take type, status, style and a new ``updated_at``; unknown case numbers are added.

    ``new`` holds at most one row per case number (see ``ingest_case_pages``).
    """
    renewed = ("case_type", "case_status", "style")
    n = new.select(F.col("case_number"), *[F.col(c).alias(f"__{c}") for c in new.columns if c != "case_number"], F.lit(True).alias("__new"))
    t = current.withColumn("__old", F.lit(True)).join(n, "case_number", "full_outer")
    is_old, is_new = F.col("__old").isNotNull(), F.col("__new").isNotNull()

    def value(c: str) -> Column:
        if c == "updated_at":
            return F.when(is_new, as_moment(as_of)).otherwise(F.col(c)).alias(c)
        if c == "case_number" or c not in new.columns:
            return F.col(c)
        if c in renewed:
            return F.when(is_new, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
        return F.when(is_old, F.col(c)).otherwise(F.col(f"__{c}")).alias(c)

    return t.select(*[value(c) for c in current.columns])


def delete_cases(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given cases."""
    gone = ids.select("case_id").distinct()
    return {name: df.join(gone, "case_id", "left_anti") for name, df in tables.items()}


def delete_events(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table after the given events are gone: rows of ``case_events`` go, links to them become NULL."""
    gone = ids.select(F.col("event_id").alias("__gone")).distinct()
    links = {"docket_documents": "event_id", "cases": "finalized_event_id"}
    out = dict(tables)
    if "case_events" in out:
        out["case_events"] = out["case_events"].join(gone, F.col("event_id") == F.col("__gone"), "left_anti")
    for name, link in links.items():
        if name in out:
            # only rows with a link take part in the join, so rows without one meet in no task
            linked, free = out[name].where(F.col(link).isNotNull()), out[name].where(F.col(link).isNull())
            cut_off = linked.join(gone, F.col(link) == F.col("__gone"), "left").withColumn(link, F.when(F.col("__gone").isNull(), F.col(link)))
            out[name] = cut_off.select(*tables[name].columns).unionByName(free)
    return out


def quarantine(candidates: DataFrame, kept: DataFrame, scrape_date: date | str) -> DataFrame:
    """Rejected candidates not yet on record for the day, their events packed as JSON; one row per case number.

    Of candidates that repeat a case number the one with the first JSON text stays.
    """
    rows = candidates.withColumn("scrape_date", as_day(scrape_date)).join(
        kept.select("case_number", "scrape_date"), ["case_number", "scrape_date"], "left_anti")
    packed = rows.withColumn("events_json", F.to_json("events", {"ignoreNullFields": "false"})).drop("events")
    return keep_first(packed, ["case_number"], [F.col("events_json").asc_nulls_last(), *sorted(c for c in packed.columns if c != "events_json")])


def explode_quarantine(rows: DataFrame) -> DataFrame:
    """One row per quarantined event; a doubly encoded array is unwrapped, items that are no objects are dropped.

    Rows without events stay, with NULL event fields.
    """
    text = F.trim("events_json")
    inner = F.when(F.startswith(text, F.lit('"')), F.get_json_object(F.concat(F.lit('{"x":'), text, F.lit("}")), "$.x")).otherwise(text)
    items = F.from_json(inner, "array<string>")
    objects = F.filter(items, lambda i: F.startswith(F.trim(i), F.lit("{")))
    item = F.struct(*[F.get_json_object("__item", f"$.{n}").alias(n) for n in ("event_date", "event_type", "document_title", "has_document")])
    opened = rows.withColumn("__item", F.explode_outer(objects)).withColumn("__e", F.when(F.col("__item").isNotNull(), item))
    return opened.select(
        *[c for c in rows.columns if c != "events_json"], "__e.event_date", "__e.event_type", "__e.document_title",
        (F.col("__e.has_document") == "true").alias("has_document"))


def _any(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def candidate_flags(events: DataFrame, key: str) -> DataFrame:
    """Per case: which indicators its events carry. Needs event_type, event_description, document_title."""
    kind, title, note = F.col("event_type"), F.col("document_title"), F.col("event_description")
    plain = lambda c: contains_any(c, R.SALE_TITLES) & ~contains_any(c, ["motor vehicle"])
    return events.groupBy(key).agg(
        _any(contains_any(kind, R.NON_PROPERTY)).alias("non_property"),
        _any(contains_any(kind, R.FORECLOSURE_EVENTS)).alias("foreclosure_event"),
        _any(contains_any(kind, R.OPPORTUNITY_EVENTS)).alias("opportunity_event"),
        _any(contains_any(title, R.SALE_TITLES)).alias("sale_title"),
        _any(plain(kind)).alias("sale_type"),
        _any(plain(note)).alias("sale_note"),
    )


def candidates(cases: DataFrame, events: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, is_candidate, rule): non-property words exclude first, then type, events, titles and descriptions."""
    t = cases.select(key, "case_type").join(candidate_flags(events, key), key, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rule = (
        F.when(contains_any(F.col("case_type"), R.NON_PROPERTY) | yes("non_property"), "non-property")
        .when(contains_any(F.col("case_type"), ["foreclosure"]), "case type")
        .when(yes("foreclosure_event"), "foreclosure event")
        .when(yes("opportunity_event"), "sale event")
        .when(yes("sale_title"), "document title")
        .when(yes("sale_type"), "event type")
        .when(yes("sale_note"), "event description")
        .otherwise("none")
    )
    return t.select(key, rule.alias("rule")).withColumn("is_candidate", ~F.col("rule").isin("non-property", "none"))


def reevaluate(rows: DataFrame) -> DataFrame:
    """Pending quarantine rows tested again; hits are flagged for review."""
    pending = rows.where(F.col("review_action").isNull())
    events = explode_quarantine(pending.select("id", "events_json")).withColumn("event_description", F.lit(None).cast("string"))
    hits = candidates(pending.select("id", "case_type"), events, "id").where("is_candidate").select("id", F.lit(True).alias("__hit"))
    return rows.join(hits, "id", "left").withColumn(
        "review_action", F.when(F.col("__hit"), F.lit("flagged_for_review")).otherwise(F.col("review_action"))).drop("__hit")


def promote(rows: DataFrame, cases: DataFrame, as_of: datetime) -> DataFrame:
    """Quarantine rows as new cases, those already known left out.

    A report of sale among the events gives sale date, deadline and state (upset_bid while the deadline runs, else
    closed_sold); without one the case is upcoming. Of rows that repeat a case number the earliest becomes the case.
    """
    fresh = keep_first(rows.join(cases.select("case_number"), "case_number", "left_anti"), ["case_number"], [F.col("id")])
    sold = explode_quarantine(fresh.select("id", "events_json")).where(contains_any(F.col("event_type"), ["report of sale"]))
    sold = sold.groupBy("id").agg(F.max(F.try_to_date("event_date", "MM/dd/yyyy")).alias("sale_date"))
    t = with_deadline(fresh.join(sold, "id", "left"), F.col("sale_date"), "next_bid_deadline")
    state = (
        F.when(F.col("sale_date").isNull(), R.UPCOMING)
        .when(F.col("next_bid_deadline") >= as_day(as_of), R.UPSET_BID).otherwise(R.CLOSED_SOLD))
    return t.select("case_number", "case_type", "sale_date", "next_bid_deadline", state.alias("classification"))


def reconcile(stated: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Item count stated on the pages ("1 - 10 of 75 items") against the rows taken from them."""
    total = F.nullif(F.regexp_extract("pager_text", r"(?i)of\s+(\d+)\s+items?", 1), F.lit("")).cast("long")
    said = stated.groupBy(key).agg(F.max(total).alias("stated"))
    got = rows.groupBy(key).agg(F.count(F.lit(1)).alias("ingested"))
    t = said.join(got, key, "left").fillna(0, ["ingested"])
    return t.withColumn("is_complete", F.coalesce(F.col("stated") == F.col("ingested"), F.lit(False)))


def retain(rows: DataFrame, days: int, as_of: datetime) -> DataFrame:
    """Quarantine without the dismissed rows older than ``days``."""
    old = (F.col("review_action") == "dismissed") & (F.col("scrape_date") < F.date_sub(as_day(as_of), days))
    return rows.where(~F.coalesce(old, F.lit(False)))


def stamp_reviewed(rows: DataFrame, ids: DataFrame, key: str, as_of: datetime, action: str | None = None) -> DataFrame:
    """Mark rows as reviewed: with an action where the table keeps one, else only those not reviewed yet."""
    t = rows.join(ids.select(key, F.lit(True).alias("__hit")).distinct(), key, "left")
    if action is None:
        t = t.withColumn("__hit", F.col("__hit") & F.col("reviewed_at").isNull())
    t = t.withColumn("reviewed_at", F.when(F.col("__hit"), as_moment(as_of)).otherwise(F.col("reviewed_at")))
    if action is not None:
        t = t.withColumn("review_action", F.when(F.col("__hit"), F.lit(action)).otherwise(F.col("review_action")))
    return t.drop("__hit")


def enqueue(analyses: DataFrame, ids: DataFrame, as_of: datetime, rerun: bool = False) -> DataFrame:
    """Queue cases for analysis. Known cases keep their row, unless a rerun sets it back to pending."""
    asked = ids.select("case_id").distinct()
    added = asked.join(analyses, "case_id", "left_anti").select(
        "case_id", F.lit("pending").alias("status"), as_day(as_of).alias("requested_on"))
    known = analyses.select("case_id", "status", "requested_on")
    if rerun:
        t = known.join(asked.withColumn("__hit", F.lit(True)), "case_id", "left")
        known = t.select("case_id", F.when(F.col("__hit"), "pending").otherwise(F.col("status")).alias("status"),
                         F.when(F.col("__hit"), as_day(as_of)).otherwise(F.col("requested_on")).alias("requested_on"))
    return known.unionByName(added)


def change_watchlist(watchlist: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Watch list as a set of (user_id, case_id): additions once, removals of absent pairs without effect."""
    key = ["user_id", "case_id"]
    return watchlist.select(*key).unionByName(added.select(*key)).dropDuplicates(key).join(removed.select(*key), key, "left_anti")
