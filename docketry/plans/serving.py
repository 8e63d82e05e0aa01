"""Lists, boards, counts and work queues."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.dates import as_day, as_moment, at_five_pm, days_label, days_left, urgency
from docketry.functions.money import est_profit, present
from docketry.functions.predicates import case_kind
from docketry.operators.documents import select_corpus
from docketry.operators.parcels import wide_enrichments
from docketry.operators.ranking import group_rank, numbered_rows

MAX_PAGE = 100
NEST_ROWS = 500


# --- counts ------------------------------------------------------------------------------------------------------


def class_counts(cases: DataFrame) -> DataFrame:
    """Cases per state and per county, in one long table."""
    return cases.groupingSets([[F.col("classification")], [F.col("county_name")]], "classification", "county_name").agg(
        F.count(F.lit(1)).alias("cases"), F.grouping("classification").alias("__county")).select(
        F.when(F.col("__county") == 1, "county").otherwise("classification").alias("kind"),
        F.when(F.col("__county") == 1, F.col("county_name")).otherwise(F.coalesce("classification", F.lit("unclassified"))).alias("value"),
        "cases")


def dashboard_stats(cases: DataFrame, as_of: datetime) -> DataFrame:
    """Totals of the dashboard in one pass and one row."""
    waiting = (F.col("classification") == R.UPSET_BID) & F.col("next_bid_deadline").isNotNull() & (
        as_moment(as_of) < at_five_pm(F.col("next_bid_deadline").cast("date")))
    soon = days_left(F.col("next_bid_deadline"), as_of) <= 2
    return cases.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("file_date") >= F.date_sub(as_day(as_of), 7)).alias("recent_filings"),
        F.count_if(F.col("classification") == R.UPSET_BID).alias("upset_bid"),
        F.count_if(waiting & soon).alias("urgent"),
        F.count_if(waiting & ~soon).alias("later"),
    )


def documents_per_case(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_id, classification, documents); documents are counted before the join."""
    counts = documents.groupBy("case_id").agg(F.count(F.lit(1)).alias("documents"))
    return cases.select("case_id", "classification").join(counts, "case_id", "left").fillna(0, ["documents"])


def document_totals(cases: DataFrame, documents: DataFrame) -> DataFrame:
    per_case = documents_per_case(cases, documents)
    return per_case.agg(
        F.count(F.lit(1)).alias("cases"), F.sum("documents").alias("documents"),
        F.count_if(F.col("documents") > 0).alias("with_documents"), F.count_if(F.col("documents") == 0).alias("without_documents"),
    ).withColumn("average", F.round(F.try_divide(F.col("documents"), F.col("cases")), 4))


def class_document_stats(cases: DataFrame, documents: DataFrame) -> DataFrame:
    per_case = documents_per_case(cases, documents)
    stats = per_case.groupBy(F.coalesce("classification", F.lit("unknown")).alias("classification")).agg(
        F.count(F.lit(1)).alias("cases"), F.sum("documents").alias("documents"),
        F.count_if(F.col("documents") > 0).alias("with_documents"))
    return stats.withColumns({
        "average": F.round(F.col("documents") / F.col("cases"), 4),
        "percent": F.round(F.col("with_documents") / F.col("cases") * 100, 4)})


def class_averages(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Each case's document count beside the average of its state, joined back from the grouped average."""
    per_case = documents_per_case(cases, documents)
    averages = per_case.groupBy("classification").agg(F.round(F.avg("documents"), 4).alias("class_average"))
    # one row a state: the domain is fixed
    return per_case.join(F.broadcast(averages), per_case.classification.eqNullSafe(averages.classification)).select(
        "case_id", "documents", "class_average")


def duplicate_names(documents: DataFrame, cases: DataFrame, limit: int = 20) -> DataFrame:
    groups = documents.groupBy("case_id", "document_name").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    top = groups.orderBy(F.desc("copies"), "case_id", "document_name").limit(limit)
    return top.join(cases.select("case_id", "case_number", "county_name"), "case_id")


def max_event_index(cases: DataFrame, events: DataFrame) -> DataFrame:
    highest = events.groupBy("case_id").agg(F.max("event_index").alias("max_event_index"))
    return cases.select("case_id").join(highest, "case_id", "left").fillna(0, ["max_event_index"])


def class_summary(applied: DataFrame) -> DataFrame:
    """One row: cases per state, without state, in all."""
    return applied.agg(
        *[F.count_if(F.col("classification") == s).alias(s) for s in R.STATES],
        F.count_if(F.col("classification").isNull()).alias("null_state"), F.count(F.lit(1)).alias("total"))


def queue_status(analyses: DataFrame) -> DataFrame:
    kinds = ["pending", "processing", "completed", "failed"]
    return analyses.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds],
                        F.count_if(F.col("status").isin(kinds)).alias("total"))


def run_summary(results: DataFrame) -> DataFrame:
    """Totals of a monitor run; ``results`` has one row per checked case."""
    return results.agg(
        F.count(F.lit(1)).alias("cases_checked"), F.coalesce(F.sum("events_added"), F.lit(0)).alias("events_added"),
        F.count_if("classification_changed").alias("classifications_changed"),
        F.count_if("bid_updated").alias("bid_updates"), F.count("error").alias("errors"))


def interest_counts(cases: DataFrame) -> DataFrame:
    """Board tabs: per county and over all, how many in all, marked interested, still to review."""
    upset = cases.where(F.col("classification") == R.UPSET_BID)
    return upset.groupingSets([[F.col("county_name")], []], "county_name").agg(
        F.count(F.lit(1)).alias("all_cases"), F.count_if(F.col("interest_status") == "interested").alias("interested"),
        F.count_if(F.col("interest_status").isNull()).alias("needs_review")).select(
        F.coalesce("county_name", F.lit("all")).alias("county_name"), "all_cases", "interested", "needs_review")


def pending_review(cases: DataFrame, quarantined: DataFrame, as_of: datetime) -> DataFrame:
    today = as_day(as_of)
    new = cases.agg(F.count_if((F.col("created_at").cast("date") == today) & F.col("reviewed_at").isNull()).alias("foreclosures"))
    left = quarantined.agg(F.count_if(F.col("review_action").isNull() & (F.col("scrape_date") >= F.date_sub(today, 7))).alias("skipped"))
    both = new.unionByName(left, allowMissingColumns=True).agg(F.sum("foreclosures").alias("foreclosures"), F.sum("skipped").alias("skipped"))
    return both.withColumn("total", F.col("foreclosures") + F.col("skipped"))


def unprocessed_documents(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """upset_bid cases with documents the second reading has not seen, and how many."""
    open_docs = documents.where(F.col("vision_processed_at").isNull()).groupBy("case_id").agg(F.count(F.lit(1)).alias("unprocessed"))
    return cases.where(F.col("classification") == R.UPSET_BID).select("case_id", "case_number").join(open_docs, "case_id")


def chunk_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("chunks_processed"), F.count_if("success").alias("chunks_succeeded"),
        F.count_if(~F.col("success")).alias("chunks_failed"), F.sum(F.when(F.col("success"), F.col("cases"))).alias("total_cases"))


def failed_chunks(results: DataFrame) -> DataFrame:
    return results.where(~F.col("success")).select("chunk_no", "chunk_start", "chunk_end", "county_code", "error")


# --- joins between tables ------------------------------------------------------------------------------------------


def with_text(cases: DataFrame, documents: DataFrame) -> DataFrame:
    return cases.join(documents.where(F.col("ocr_text").isNotNull()).select("case_id"), "case_id", "left_semi")


def without_documents(cases: DataFrame, documents: DataFrame) -> DataFrame:
    return cases.join(documents.select("case_id"), "case_id", "left_anti")


def untyped_cases(cases: DataFrame, events: DataFrame, dated: bool = False) -> DataFrame:
    """Cases with a link that have an event (a dated one) without type."""
    hit = events.where(F.col("event_type").isNull() & (F.col("event_date").isNotNull() if dated else F.lit(True)))
    return cases.where(F.col("case_url").isNotNull()).join(hit.select("case_id"), "case_id", "left_semi")


def missing_sets(cases: DataFrame) -> DataFrame:
    """upset_bid cases lacking bid, deadline or both."""
    no_bid, no_deadline = F.col("current_bid_amount").isNull(), F.col("next_bid_deadline").isNull()
    kind = F.when(no_bid & no_deadline, "both").when(no_bid, "bid only").when(no_deadline, "deadline only")
    return cases.where(F.col("classification") == R.UPSET_BID).select("case_id", "case_number", kind.alias("missing")).where(
        F.col("missing").isNotNull())


# --- case list -----------------------------------------------------------------------------------------------------


def search_cases(cases: DataFrame, parties: DataFrame, text: str) -> DataFrame:
    """Cases whose number, address, style or a party contains the text."""
    like = f"%{text}%"
    named = parties.where(F.col("party_name").ilike(like)).select("case_id", F.lit(True).alias("__named")).distinct()
    own = F.col("case_number").ilike(like) | F.col("property_address").ilike(like) | F.col("style").ilike(like)
    return cases.join(named, "case_id", "left").where(F.coalesce(own, F.lit(False)) | F.col("__named")).drop("__named")


def _iso_day(text: str | None) -> date | None:
    try:
        return datetime.strptime(text or "", "%Y-%m-%d").date()
    except ValueError:
        return None


def filter_cases(cases: DataFrame, classifications: list[str] | None = None, counties: list[str] | None = None,
                 start: str | None = None, end: str | None = None) -> DataFrame:
    """State, county and file-date filters; a date that is none is ignored."""
    if classifications:
        cases = cases.where(F.col("classification").isin(classifications))
    if counties:
        cases = cases.where(F.col("county_code").isin(counties))
    if _iso_day(start):
        cases = cases.where(F.col("file_date") >= F.lit(_iso_day(start)))
    if _iso_day(end):
        cases = cases.where(F.col("file_date") <= F.lit(_iso_day(end)))
    return cases


def case_page(cases: DataFrame, sort_by: str = "file_date", descending: bool = True, page: int = 1, size: int = 20) -> DataFrame:
    """One page, with total and number of pages on each row. Unknown sort columns fall back to the file date."""
    size = min(size, MAX_PAGE)
    column = F.col(sort_by if sort_by in R.SORT_COLUMNS else "file_date")
    order = _page_order(column, descending)
    total = cases.agg(F.count(F.lit(1)))
    rows = cases.orderBy(order, "case_id").offset((page - 1) * size).limit(size)
    return rows.withColumn("total", total.scalar()).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))


def _beyond(column: Column, value, case_id, descending: bool) -> Column:
    """Rows that come after (value, case_id) in the order of ``case_page``."""
    later = F.col("case_id") > F.lit(case_id)
    if value is None:
        return column.isNotNull() | later if descending else column.isNull() & later
    value = F.lit(value).cast("string") if isinstance(value, str) else F.lit(value)
    further = column < value if descending else (column > value) | column.isNull()
    return further | ((column == value) & later)


def next_page(cases: DataFrame, sort_by: str = "file_date", descending: bool = True, after: tuple | None = None, size: int = 20) -> DataFrame:
    """The page behind the row (value, case_id) ``after``, or the first one: each task keeps ``size`` rows, whatever the page,
    and rows before the page are told by a condition the scan can use."""
    size = min(size, MAX_PAGE)
    name = sort_by if sort_by in R.SORT_COLUMNS else "file_date"
    rows = cases if after is None else cases.where(_beyond(F.col(name), *after, descending))
    return rows.orderBy(_page_order(F.col(name), descending), "case_id").limit(size)


def page_ends(cases: DataFrame, folder: str, sort_by: str = "file_date", descending: bool = True, size: int = 20) -> DataFrame:
    """(page, value, case_id): the last row of every page, from one pass that sorts by ranges; with ``next_page`` any page can
    be opened at once. ``folder`` takes the sorted keys."""
    name = sort_by if sort_by in R.SORT_COLUMNS else "file_date"
    keys = cases.select(F.col(name).alias("value"), "case_id")
    order = [_page_order(F.col("value"), descending), F.col("case_id")]
    return numbered_rows(keys, order, folder).where((F.col("row") + 1) % min(size, MAX_PAGE) == 0).select(
        ((F.col("row") + 1) / min(size, MAX_PAGE)).cast("bigint").alias("page"), "value", "case_id")


def open_page(cases: DataFrame, ends: DataFrame, page: int, sort_by: str = "file_date", descending: bool = True, size: int = 20) -> DataFrame:
    """Page ``page`` by the row before it; past the last page there are no rows."""
    if page <= 1:
        return next_page(cases, sort_by, descending, None, size)
    before = ends.where(F.col("page") == page - 1).select("value", "case_id").first()
    return cases.limit(0) if before is None else next_page(cases, sort_by, descending, tuple(before), size)


def _page_order(column: Column, descending: bool) -> Column:
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def with_watch_flag(cases: DataFrame, watchlist: DataFrame, user_id: int) -> DataFrame:
    own = watchlist.where(F.col("user_id") == user_id).select("case_id", F.lit(True).alias("__w")).distinct()
    return cases.join(own, "case_id", "left").withColumn("is_watchlisted", F.coalesce("__w", F.lit(False))).drop("__w")


def case_list(cases: DataFrame, parties: DataFrame, watchlist: DataFrame, valuations: DataFrame, user_id: int, search: str = "",
              watched_only: bool = False, page: int = 1, size: int = 20, sort_by: str = "file_date", descending: bool = True,
              **filters) -> DataFrame:
    """The paged list: filters, search, watch list, value columns."""
    found = filter_cases(cases, **filters)
    if search.strip():
        found = search_cases(found, parties, search.strip())
    if watched_only:
        found = found.join(watchlist.where(F.col("user_id") == user_id).select("case_id"), "case_id", "left_semi")
    rows = case_page(found, sort_by, descending, page, size)
    rows = with_watch_flag(rows, watchlist, user_id).join(valuations, "property_address", "left")
    return rows.select(
        "case_id", "case_number", "county_code", "county_name", "style", "classification", "file_date", "property_address",
        present(F.col("current_bid_amount")).alias("current_bid_amount"), "next_bid_deadline", "is_watchlisted", "estimate",
        "total", "total_pages")


# --- board ---------------------------------------------------------------------------------------------------------


def upset_board(cases: DataFrame, enrichments: DataFrame, watchlist: DataFrame, user_id: int, as_of: datetime,
                county_code: str | None = None) -> DataFrame:
    """All upset_bid cases, the most pressing first."""
    rows = cases.where(F.col("classification") == R.UPSET_BID)
    if county_code:
        rows = rows.where(F.col("county_code") == county_code)
    rows = with_watch_flag(rows, watchlist, user_id).join(wide_enrichments(enrichments), "case_id", "left")
    deadline = F.col("next_bid_deadline")
    return rows.select(
        "case_id", "case_number", "county_code", "county_name", "property_address",
        present(F.col("current_bid_amount")).alias("current_bid_amount"),
        present(F.col("minimum_next_bid")).alias("minimum_next_bid"), "next_bid_deadline",
        days_left(deadline, as_of).alias("days_remaining"), urgency(deadline, as_of).alias("urgency"),
        days_label(days_left(deadline, as_of), urgency(deadline, as_of)).alias("label"), "sale_date", "is_watchlisted", "case_url",
        present(F.col("our_max_bid")).alias("our_max_bid"),
        est_profit(F.col("estimated_sale_price"), F.col("our_max_bid"), F.col("estimated_rehab_cost")).alias("estimated_profit"),
        case_kind(F.col("case_type"), F.col("style")).alias("case_kind"), *R.SOURCE_BY_COUNTY_CODE.values(), "interest_status",
    ).orderBy(F.asc_nulls_last("next_bid_deadline"), "case_id")


# --- nested detail -------------------------------------------------------------------------------------------------


def _chunk(number: str, rows: int) -> Column:
    """Chunk of a row number that is never NULL."""
    return F.floor((F.col(number) - 1) / rows).cast("int")


def _numbered(rows: DataFrame, bucket: list[str], order: str, placed: bool) -> DataFrame:
    """Row numbers inside each case. Where the table lies by case a case is in one task anyway, so a plain window does."""
    if placed:
        return rows.withColumn("__n", F.row_number().over(Window.partitionBy("case_id").orderBy(*bucket, order)))
    return group_rank(rows, ["case_id"], bucket, [F.col(order)], "__n")


def _by_chunk(rows: DataFrame, bucket: list[str], order: str, size: int, placed: bool, nest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nest`` of the rows with their ``chunk`` of ``size`` rows by rank inside the case.

    Cases of one chunk need no ranks, so only longer ones, and rows without a case, are ranked."""
    ranked = lambda part: nest(_numbered(part, bucket, order, placed).withColumn("chunk", _chunk("__n", size)))
    if placed:
        return ranked(rows)
    long = rows.where(F.col("case_id").isNotNull()).groupBy("case_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > size).select("case_id")
    short = rows.where(F.col("case_id").isNotNull()).join(long, "case_id", "left_anti").withColumn("chunk", F.lit(0))
    rest = rows.join(long, "case_id", "left_semi").unionByName(rows.where(F.col("case_id").isNull()))
    return nest(short).unionByName(ranked(rest))


def nested_events(events: DataFrame, rows: int = NEST_ROWS, placed: bool = False) -> DataFrame:
    """Events of a case as arrays, newest first, in chunks of ``rows`` by date and id: (case_id, chunk, ...)."""
    day = F.coalesce(F.unix_date("event_date"), F.lit(-10**8))
    item = F.struct((-day).alias("__o"), F.col("event_id"), F.col("event_date"), F.col("event_type"), F.col("event_description"))
    filed_by = F.col("filed_by") if "filed_by" in events.columns else F.lit(None).cast("string")
    bidder = F.struct((-day).alias("__o"), F.col("event_id"), F.col("event_date"), F.coalesce(filed_by, F.lit("Unknown")).alias("bidder"))
    is_bid = F.lower("event_type").contains("upset")
    nest = lambda chunked: chunked.groupBy("case_id", "chunk").agg(
        F.array_sort(F.collect_list(item)).alias("events"),
        F.array_sort(F.collect_list(F.when(is_bid, bidder))).alias("bidders"))
    return _by_chunk(events, ["event_date"], "event_id", rows, placed, nest)


def nested_parties(parties: DataFrame, rows: int = NEST_ROWS, placed: bool = False) -> DataFrame:
    """Party names by type as a map, in chunks of at most ``rows`` parties per case."""
    # Names with a common start are told apart by a hash, so a bucket stays a small part of a case.
    lead = parties.withColumn("__lead", F.pmod(F.xxhash64("party_name"), F.lit(1024)))

    def nest(chunked: DataFrame) -> DataFrame:
        per_type = chunked.groupBy("case_id", "chunk", "party_type").agg(F.array_sort(F.collect_list("party_name")).alias("names"))
        return per_type.groupBy("case_id", "chunk").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("party_type", "names")))).alias("parties"))

    return _by_chunk(lead, ["party_type", "__lead"], "party_name", rows, placed, nest)


def nested_hearings(hearings: DataFrame, rows: int = NEST_ROWS) -> DataFrame:
    chunk = F.floor((F.col("hearing_no") - 1) / rows).cast("int")
    item = F.struct("hearing_no", "hearing_date", "hearing_time", "hearing_type")
    return hearings.groupBy("case_id", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("hearings"))


def case_nested(parties: DataFrame, events: DataFrame, hearings: DataFrame, placed: int = 0) -> DataFrame:
    """(case_id, chunk) with parties, events, bidders and hearings; nearly every case has just chunk 0."""
    key = ["case_id", "chunk"]
    if placed:  # a full outer join would hide where its rows lie, and move each part on its own
        parts = nested_parties(parties, placed=True).unionByName(nested_events(events, placed=True), allowMissingColumns=True).unionByName(
            nested_hearings(hearings), allowMissingColumns=True)
        return parts.repartition(placed, "case_id").groupBy(*key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns if c not in key])
    return nested_parties(parties).join(nested_events(events), key, "full_outer").join(
        nested_hearings(hearings), key, "full_outer")


def case_detail(cases: DataFrame, parties: DataFrame, events: DataFrame, hearings: DataFrame, enrichments: DataFrame,
                watchlist: DataFrame, user_id: int, placed: int = 0) -> DataFrame:
    """Everything about a case on one row (per chunk).

    ``placed`` is the number of buckets in which all tables lie by ``case_id`` (``sources.tables.write_placed``), 0 if they do
    not. Then only the finished parts of the nested arrays move, once, if ``spark.sql.requireAllClusterKeysForCoPartition`` is
    off (see ``session.RUNTIME_SETTINGS``).
    """
    rows = with_watch_flag(cases, watchlist, user_id).join(wide_enrichments(enrichments), "case_id", "left")
    profit = est_profit(F.col("estimated_sale_price"), F.col("our_max_bid"), F.col("estimated_rehab_cost"))
    return rows.withColumn("estimated_profit", profit).join(case_nested(parties, events, hearings, placed), "case_id", "left")


def daily_review(cases: DataFrame, events: DataFrame, quarantined: DataFrame, day: date | str) -> DataFrame:
    """New unreviewed cases of a day with their events, and the pending quarantine of the seven days before."""
    today = as_day(day)
    new = cases.where((F.col("created_at").cast("date") == today) & F.col("reviewed_at").isNull())
    own = events.join(new.select("case_id"), "case_id", "left_semi")
    shown = new.join(nested_events(own).select("case_id", "chunk", "events"), "case_id", "left").select(
        F.lit("foreclosure").alias("kind"), F.col("case_id").alias("id"), "case_number", "chunk",
        F.to_json(F.transform("events", lambda e: F.struct(e["event_date"].cast("string").alias("event_date"), e["event_type"].alias("event_type")))).alias("events"))
    left = quarantined.where(F.col("review_action").isNull() & (F.col("scrape_date") >= F.date_sub(today, 7))).select(
        F.lit("skipped").alias("kind"), "id", "case_number", F.lit(0).alias("chunk"), F.col("events_json").alias("events"))
    return shown.unionByName(left)


def review_queue(log: DataFrame, cases: DataFrame, limit: int = 50) -> DataFrame:
    """Newest open review items with their case number."""
    top = log.where(F.col("resolved_at").isNull()).orderBy(F.desc("created_at"), "case_id").limit(limit)
    return top.join(cases.select("case_id", "case_number"), "case_id", "left")


def run_history(runs: DataFrame, tasks: DataFrame, limit: int = 20) -> DataFrame:
    """Newest runs with their tasks in order."""
    top = runs.orderBy(F.desc("run_day"), "run_id").limit(limit)
    item = F.struct("task_order", "task_name", "items_checked", "items_failed")
    nested = tasks.join(top.select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(F.array_sort(F.collect_list(item)).alias("tasks"))
    return top.join(nested, "run_id", "left")


def analysis_corpus(documents: DataFrame, cases: DataFrame, events: DataFrame, budget: int = R.CORPUS_CHARS,
                    per_document: int = R.DOCUMENT_CHARS, rows: int = NEST_ROWS) -> DataFrame:
    """Text handed to an analysis: (case_id, part, chunk, body).

    The document part is bounded by the budget; event lines come in chunks of ``rows`` by date and id.
    """
    chosen = select_corpus(documents, cases, budget, per_document).join(
        documents.select("document_id", "document_name", F.substring("ocr_text", 1, per_document).alias("__t")), "document_id")
    number = (F.col("position") + 1).cast("string")
    section = F.concat(F.lit("--- DOCUMENT "), number, F.lit(": "), "document_name", F.lit(" ---\n"), "__t", F.lit("\n--- END DOCUMENT "), number, F.lit(" ---"))
    texts = chosen.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("position", section.alias("s")))).alias("a")).select(
        "case_id", F.lit("documents").alias("part"), F.lit(0).alias("chunk"), F.array_join(F.col("a.s"), "\n\n").alias("body"))
    told = group_rank(events.where(F.col("event_type").isNotNull() & (F.length("event_description") > 0)),
                      ["case_id"], ["event_date"], [F.col("event_id")], "__n")
    line = F.concat(F.lit("- ["), F.coalesce(F.col("event_date").cast("string"), F.lit("Unknown date")), F.lit("] "), "event_type", F.lit(": "), "event_description")
    day = F.coalesce(F.unix_date("event_date"), F.lit(-10**8))
    lines = told.groupBy("case_id", _chunk("__n", rows).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct((-day).alias("o"), "event_id", line.alias("s")))).alias("a")).select(
        "case_id", F.lit("events").alias("part"), "chunk", F.array_join(F.col("a.s"), "\n").alias("body"))
    return texts.unionByName(lines)


def analysis_view(cases: DataFrame, analyses: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Analysis of each case (empty lists for missing ones) with its look-up status."""
    flags = F.coalesce(F.from_json("red_flags", "array<string>"), F.array().cast("array<string>"))
    looked = enrichments.select("case_id", F.when(F.col("error").isNotNull(), "error").otherwise("success").alias("lookup"))
    return cases.select("case_id").join(analyses.select("case_id", "status", flags.alias("red_flags")), "case_id", "left").join(
        looked, "case_id", "left").select(
        "case_id", F.coalesce("status", F.lit("not_found")).alias("status"),
        F.coalesce("red_flags", F.array().cast("array<string>")).alias("red_flags"), "lookup")
