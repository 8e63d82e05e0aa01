"""Registered queries: lists, boards, counts, queues, joins between tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import rules as R
from docketry.operators import timeline as TL
from docketry.operators.parcels import wide_enrichments
from docketry.operators.ranking import keep_first
from docketry.plans import serving as S
from docketry.plans.case_queries import _COPIES, _copies
from docketry.plans.registry import query
from docketry.plans.state_queries import CLASSIFY
from docketry.plans.value_queries import KIND_SQL, TIER_SQL, _urgency_sql
from docketry.session import shared_folder
from docketry.sources.sample_views import AS_OF
from docketry.sources.tables import conformed, read_table, write_table
from docketry.sources.versions import TableStore

# --- sources ---------------------------------------------------------------------------------------------------------


@query("scan_cases", "SELECT case_id, case_number, county_code, case_type, style, file_date, current_bid_amount FROM cases", money="current_bid_amount", days="file_date")
def scan_cases(t):
    return t.cases


@query("typed_scan", """SELECT c.case_id, case_number, file_date, is_finalized, closed_sold_at, coalesce(e.n,0) AS n_events, coalesce(d.n,0) AS n_documents FROM docket_cases c
    LEFT JOIN (SELECT case_id, count(event_date) AS n FROM case_events GROUP BY case_id) e ON e.case_id=c.case_id LEFT JOIN (SELECT case_id, count(*) AS n FROM docket_documents GROUP BY case_id) d ON d.case_id=c.case_id
    WHERE county_code='910'""", days="file_date", moments="closed_sold_at")
def typed_scan(t):
    """Tables written in their layout and read back by their fixed schemas, one county's folder only."""
    folder = shared_folder(t.spark, "tables")
    for name, df in {"cases": t.docket_cases, "case_events": t.case_events, "docket_documents": t.docket_documents}.items():
        write_table(conformed(df, name), folder, name)
    cases, events, documents = (read_table(t.spark, folder, n) for n in ("cases", "case_events", "docket_documents"))
    wake = cases.where(F.col("county_code") == "910").select("case_id", "case_number", "file_date", "is_finalized", "closed_sold_at")
    own = events.groupBy("case_id").agg(F.count("event_date").alias("n_events"))
    texts = documents.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return wake.join(own, "case_id", "left").join(texts, "case_id", "left").fillna(0, ["n_events", "n_documents"])


# --- counts ----------------------------------------------------------------------------------------------------------


@query("class_counts", """SELECT 'classification' AS kind, coalesce(classification,'unclassified') AS value, count(*) AS cases FROM docket_cases GROUP BY ALL
    UNION ALL SELECT 'county', county_name, count(*) FROM docket_cases GROUP BY ALL""")
def class_counts(t):
    return S.class_counts(t.docket_cases)


_WAITING = "classification='upset_bid' AND next_bid_deadline IS NOT NULL AND next_bid_deadline + INTERVAL 17 HOUR > TIMESTAMP '1998-06-15 12:00:00'"


@query("dashboard_stats", f"""SELECT count(*) AS total_cases, count(*) FILTER (file_date >= DATE '1998-06-08') AS recent_filings, count(*) FILTER (classification='upset_bid') AS upset_bid,
    count(*) FILTER ({_WAITING} AND next_bid_deadline < TIMESTAMP '1998-06-18 00:00:00') AS urgent, count(*) FILTER ({_WAITING} AND next_bid_deadline >= TIMESTAMP '1998-06-18 00:00:00') AS later FROM docket_cases""")
def dashboard_stats(t):
    return S.dashboard_stats(t.docket_cases, AS_OF)


_PER_CASE = "per_case AS (SELECT c.case_id, c.classification, count(d.document_id) AS documents FROM docket_cases c LEFT JOIN docket_documents d ON d.case_id=c.case_id GROUP BY ALL)"


@query("doc_totals", f"""WITH {_PER_CASE} SELECT count(*) AS cases, CAST(sum(documents) AS BIGINT) AS documents, count(*) FILTER (documents>0) AS with_documents, count(*) FILTER (documents=0) AS without_documents,
    round(sum(documents)/count(*), 4) AS average FROM per_case""")
def doc_totals(t):
    return S.document_totals(t.docket_cases, t.docket_documents)


@query("class_doc_stats", f"""WITH {_PER_CASE} SELECT coalesce(classification,'unknown') AS classification, count(*) AS cases, CAST(sum(documents) AS BIGINT) AS documents, count(*) FILTER (documents>0) AS with_documents,
    round(sum(documents)/count(*), 4) AS average, round(count(*) FILTER (documents>0)/count(*)*100, 4) AS percent FROM per_case GROUP BY ALL""")
def class_doc_stats(t):
    return S.class_document_stats(t.docket_cases, t.docket_documents)


@query("avg_over_count", f"WITH {_PER_CASE} SELECT case_id, documents, round(avg(documents) OVER (PARTITION BY classification), 4) AS class_average FROM per_case")
def avg_over_count(t):
    return S.class_averages(t.docket_cases, t.docket_documents)


@query("dup_docs", f"""WITH {_COPIES}, g AS (SELECT case_id, document_name, count(*) AS copies FROM copies GROUP BY ALL HAVING count(*)>1 ORDER BY copies DESC, case_id, document_name LIMIT 20)
    SELECT g.*, c.case_number, c.county_name FROM g JOIN docket_cases c ON c.case_id=g.case_id""")
def dup_docs(t):
    return S.duplicate_names(_copies(t), t.docket_cases)


@query("max_event_index", "SELECT c.case_id, coalesce(max(event_index),0) AS max_event_index FROM cases c LEFT JOIN case_events e ON e.case_id=c.case_id GROUP BY c.case_id")
def max_event_index(t):
    return S.max_event_index(t.cases, t.case_events)


@query("class_summary", CLASSIFY + " SELECT " + ", ".join(f"count(*) FILTER (new_state='{s}') AS {s}" for s in R.STATES)
       + ", count(*) FILTER (new_state IS NULL) AS null_state, count(*) AS total FROM step8")
def class_summary(t):
    return S.class_summary(TL.apply_state(t.docket_cases, t.case_events, AS_OF))


@query("queue_status", "SELECT " + ", ".join(f"count(*) FILTER (status='{s}') AS {s}" for s in ("pending", "processing", "completed", "failed")) + ", count(*) AS total FROM analyses")
def queue_status(t):
    return S.queue_status(t.analyses)


@query("run_summary", CLASSIFY + """, added AS (SELECT case_id, count(*) AS n FROM case_events WHERE event_index>3 GROUP BY case_id)
    SELECT count(*) AS cases_checked, CAST(coalesce(sum(n),0) AS BIGINT) AS events_added, count(*) FILTER (classification IS DISTINCT FROM new_state) AS classifications_changed,
      count(*) FILTER (s.case_id%13=0) AS bid_updates, count(*) FILTER (s.case_id%50=0) AS errors FROM step8 s LEFT JOIN added a ON a.case_id=s.case_id""")
def run_summary(t):
    added = t.case_events.where("event_index > 3").groupBy("case_id").agg(F.count(F.lit(1)).alias("events_added"))
    state = TL.apply_state(t.docket_cases, t.case_events, AS_OF)
    return S.run_summary(state.join(added, "case_id", "left").select(
        "events_added", (~F.col("old_classification").eqNullSafe(F.col("classification"))).alias("classification_changed"),
        (F.col("case_id") % 13 == 0).alias("bid_updated"), F.when(F.col("case_id") % 50 == 0, "timeout").alias("error")))


@query("interest_counts", """WITH u AS (SELECT * FROM docket_cases WHERE classification='upset_bid') SELECT coalesce(county_name,'all') AS county_name, count(*) AS all_cases,
    count(*) FILTER (interest_status='interested') AS interested, count(*) FILTER (interest_status IS NULL) AS needs_review FROM u GROUP BY GROUPING SETS ((county_name), ())""")
def interest_counts(t):
    return S.interest_counts(t.docket_cases)


@query("pending_review", """WITH a AS (SELECT count(*) AS foreclosures FROM docket_cases WHERE CAST(created_at AS DATE)=DATE '1998-06-15' AND reviewed_at IS NULL),
    b AS (SELECT count(*) AS skipped FROM quarantine WHERE review_action IS NULL AND scrape_date>=DATE '1998-06-08') SELECT foreclosures, skipped, foreclosures+skipped AS total FROM a, b""")
def pending_review(t):
    return S.pending_review(t.docket_cases, t.quarantine, AS_OF)


@query("unprocessed_docs", """SELECT c.case_id, c.case_number, count(*) AS unprocessed FROM docket_cases c JOIN docket_documents d ON d.case_id=c.case_id
    WHERE c.classification='upset_bid' AND d.document_id%3=0 GROUP BY ALL""")
def unprocessed_docs(t):
    seen = F.when(F.col("document_id") % 3 != 0, F.lit(AS_OF).cast("timestamp_ntz"))
    return S.unprocessed_documents(t.docket_cases, t.docket_documents.withColumn("vision_processed_at", seen))


_CHUNKS = """chunks AS (SELECT county_code, CAST(date_trunc('month', file_date) AS DATE) AS chunk_start, count(*) AS cases, count(*)%7<>0 AS success FROM cases GROUP BY ALL)"""


def _chunk_results(t):
    return t.cases.groupBy("county_code", F.trunc("file_date", "MM").alias("chunk_start")).agg(F.count(F.lit(1)).alias("cases")).withColumns({
        "success": F.col("cases") % 7 != 0, "chunk_end": F.last_day("chunk_start"), "chunk_no": F.lit(None).cast("int"), "error": F.lit("timeout")})


@query("chunk_summary", f"""WITH {_CHUNKS} SELECT count(*) AS chunks_processed, count(*) FILTER (success) AS chunks_succeeded, count(*) FILTER (NOT success) AS chunks_failed,
    CAST(sum(cases) FILTER (success) AS BIGINT) AS total_cases FROM chunks""")
def chunk_summary(t):
    return S.chunk_summary(_chunk_results(t))


@query("failed_chunks", f"WITH {_CHUNKS} SELECT chunk_start, last_day(chunk_start) AS chunk_end, county_code, 'timeout' AS error FROM chunks WHERE NOT success", days="chunk_start chunk_end")
def failed_chunks(t):
    return S.failed_chunks(_chunk_results(t)).drop("chunk_no")


# --- joins and sets --------------------------------------------------------------------------------------------------


@query("join_enrich", "SELECT c.case_id, c.case_number, e.source, e.ref_id, e.error FROM cases c LEFT JOIN enrichments_long e ON e.case_id=c.case_id")
def join_enrich(t):
    return t.cases.join(t.enrichments_long, "case_id", "left").select("case_id", "case_number", "source", "ref_id", "error")


@query("cases_with_text", "SELECT case_id, case_number FROM cases WHERE case_id IN (SELECT case_id FROM docket_documents WHERE ocr_text IS NOT NULL)")
def cases_with_text(t):
    return S.with_text(t.cases, t.docket_documents).select("case_id", "case_number")


@query("cases_no_docs", "SELECT case_id, case_number FROM cases c WHERE NOT EXISTS (SELECT 1 FROM docket_documents d WHERE d.case_id=c.case_id)")
def cases_no_docs(t):
    return S.without_documents(t.cases, t.docket_documents).select("case_id", "case_number")


@query("watch_semi", "SELECT case_id, case_number FROM cases WHERE case_id IN (SELECT case_id FROM watchlist WHERE user_id=2)")
def watch_semi(t):
    return t.cases.join(t.watchlist.where("user_id = 2"), "case_id", "left_semi").select("case_id", "case_number")


@query("null_type_cases", """SELECT case_id, EXISTS (SELECT 1 FROM case_events e WHERE e.case_id=c.case_id AND e.event_type IS NULL AND e.event_date IS NOT NULL) AS dated FROM docket_cases c
    WHERE case_url IS NOT NULL AND EXISTS (SELECT 1 FROM case_events e WHERE e.case_id=c.case_id AND e.event_type IS NULL)""")
def null_type_cases(t):
    dated = S.untyped_cases(t.docket_cases, t.case_events, dated=True).select("case_id", F.lit(True).alias("dated"))
    return S.untyped_cases(t.docket_cases, t.case_events).select("case_id").join(dated, "case_id", "left").fillna(False, ["dated"])


@query("missing_sets", """WITH b AS (SELECT case_id, case_number FROM docket_cases WHERE classification='upset_bid' AND current_bid_amount IS NULL), d AS (SELECT case_id, case_number FROM docket_cases WHERE classification='upset_bid' AND next_bid_deadline IS NULL)
    SELECT *, 'both' AS missing FROM (SELECT * FROM b INTERSECT SELECT * FROM d) UNION ALL SELECT *, 'bid only' FROM (SELECT * FROM b EXCEPT SELECT * FROM d) UNION ALL SELECT *, 'deadline only' FROM (SELECT * FROM d EXCEPT SELECT * FROM b)""")
def missing_sets(t):
    return S.missing_sets(t.docket_cases)


@query("union_sources", """SELECT case_id, 'document' AS source, count(*) AS n FROM docket_documents GROUP BY case_id UNION ALL SELECT case_id, 'event', count(*) FROM case_events WHERE event_description IS NOT NULL GROUP BY case_id
    UNION ALL SELECT case_id, 'second reading', count(*) FROM second_source GROUP BY case_id""")
def union_sources(t):
    count = lambda df, name: df.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(name))
    return count(t.docket_documents, "document").unionByName(count(t.case_events.where("event_description is not null"), "event")).unionByName(
        count(t.second_source, "second reading")).select("case_id", "source", "n")


# --- lists and boards ------------------------------------------------------------------------------------------------


@query("case_search", "SELECT case_id, case_number FROM docket_cases c WHERE case_number ILIKE '%00012%' OR property_address ILIKE '%00012%' OR style ILIKE '%00012%' OR EXISTS (SELECT 1 FROM parties p WHERE p.case_id=c.case_id AND party_name ILIKE '%00012%')")
def case_search(t):
    return S.search_cases(t.docket_cases, t.parties, "00012").select("case_id", "case_number")


@query("case_filter", "SELECT case_id, case_number FROM docket_cases WHERE classification IN ('upset_bid','blocked') AND county_code IN ('910','310') AND file_date >= DATE '1996-01-01'")
def case_filter(t):
    return S.filter_cases(t.docket_cases, ["upset_bid", "blocked"], ["910", "310"], "1996-01-01", "no date").select("case_id", "case_number")


@query("case_page", """WITH t AS (SELECT count(*) AS total FROM docket_cases) SELECT case_id, case_number, current_bid_amount, total, CAST(ceil(total/50) AS BIGINT) AS total_pages FROM docket_cases, t
    ORDER BY current_bid_amount DESC NULLS FIRST, case_id LIMIT 50 OFFSET 2150""", money="current_bid_amount")
def case_page(t):
    page = S.case_page(t.docket_cases, "current_bid_amount", True, page=44, size=50)
    return page.select("case_id", "case_number", "current_bid_amount", "total", "total_pages")


@query("case_page_seek", """SELECT case_id, case_number, current_bid_amount FROM docket_cases ORDER BY current_bid_amount DESC NULLS FIRST, case_id LIMIT 50 OFFSET 2150""", money="current_bid_amount")
def case_page_seek(t):
    """The same page found by the row that ends the page before it."""
    ends = S.page_ends(t.docket_cases, shared_folder(t.spark, "pages"), "current_bid_amount", True, 50)
    return S.open_page(t.docket_cases, ends, 44, "current_bid_amount", True, 50).select("case_id", "case_number", "current_bid_amount")


@query("page_ends", """WITH n AS (SELECT case_id, file_date AS value, row_number() OVER (ORDER BY file_date NULLS LAST, case_id) AS r FROM docket_cases) SELECT r//100 AS page, value, case_id FROM n WHERE r%100=0""", days="value")
def page_ends(t):
    return S.page_ends(t.docket_cases, shared_folder(t.spark, "pages"), "file_date", False, 100)


@query("topk_queue", """SELECT * FROM (SELECT 'pending analysis' AS queue, case_id, cast(requested_on AS STRING) AS at FROM analyses WHERE status='pending' ORDER BY requested_on, case_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'no documents', case_id, cast(file_date AS STRING) FROM cases c WHERE NOT EXISTS (SELECT 1 FROM docket_documents d WHERE d.case_id=c.case_id) ORDER BY file_date DESC, case_id LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'upcoming', case_id, cast(file_date AS STRING) FROM docket_cases WHERE classification='upcoming' AND case_url IS NOT NULL ORDER BY file_date DESC, case_id LIMIT 25)""")
def topk_queue(t):
    def top(df, name, at, descending, limit):
        order = F.col(at).desc() if descending else F.col(at).asc()
        return df.orderBy(order, "case_id").limit(limit).select(F.lit(name).alias("queue"), "case_id", F.col(at).cast("string").alias("at"))

    pending = top(t.analyses.where("status = 'pending'"), "pending analysis", "requested_on", False, 10)
    bare = top(S.without_documents(t.cases, t.docket_documents), "no documents", "file_date", True, 20)
    soon = top(t.docket_cases.where("classification = 'upcoming' AND case_url IS NOT NULL"), "upcoming", "file_date", True, 25)
    return pending.unionByName(bare).unionByName(soon)


@query("deadline_sort", "SELECT case_id, case_number, next_bid_deadline FROM docket_cases WHERE classification='upset_bid' ORDER BY next_bid_deadline ASC NULLS LAST, case_id", moments="next_bid_deadline")
def deadline_sort(t):
    return t.docket_cases.where("classification = 'upset_bid'").orderBy(F.asc_nulls_last("next_bid_deadline"), "case_id").select(
        "case_id", "case_number", "next_bid_deadline")


@query("recent_events", "SELECT case_id, event_id FROM case_events QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY event_id DESC) <= 3")
def recent_events(t):
    return keep_first(t.case_events, ["case_id"], [F.col("event_id").desc()], 3).select("case_id", "event_id")


_WIDE = "wide AS (SELECT case_id, " + ", ".join(f"max(ref_id) FILTER (source='{s}') AS {s}" for s in R.SOURCE_BY_COUNTY_CODE.values()) + " FROM enrichments_long GROUP BY case_id)"


@query("enrich_pivot", f"WITH {_WIDE} SELECT * FROM wide")
def enrich_pivot(t):
    return wide_enrichments(t.enrichments_long)


@query("case_list", """WITH f AS (SELECT * FROM docket_cases c WHERE classification IN ('upset_bid','upcoming') AND county_code='910' AND file_date<=DATE '1998-01-01' AND (case_number ILIKE '%1%' OR property_address ILIKE '%1%' OR style ILIKE '%1%'
      OR EXISTS (SELECT 1 FROM parties p WHERE p.case_id=c.case_id AND party_name ILIKE '%1%')) AND case_id IN (SELECT case_id FROM watchlist WHERE user_id=1)), t AS (SELECT count(*) AS total FROM f)
    SELECT f.case_id, case_number, county_code, county_name, style, classification, file_date, f.property_address, nullif(current_bid_amount,0) AS current_bid_amount, next_bid_deadline, true AS is_watchlisted, v.estimate, total,
      CAST(ceil(total/20) AS BIGINT) AS total_pages FROM (SELECT * FROM f ORDER BY file_date DESC NULLS FIRST, case_id LIMIT 20) f LEFT JOIN valuations v ON v.property_address=f.property_address, t""",
       money="current_bid_amount estimate", days="file_date", moments="next_bid_deadline")
def case_list(t):
    return S.case_list(t.docket_cases, t.parties, t.watchlist, t.valuations, user_id=1, search="1", watched_only=True,
                       classifications=["upset_bid", "upcoming"], counties=["910"], end="1998-01-01")


@query("upset_board", f"""WITH {_WIDE}, u AS (SELECT c.*, CAST(next_bid_deadline AS DATE) - DATE '1998-06-15' AS n, {_urgency_sql(AS_OF)} AS urgency FROM docket_cases c WHERE classification='upset_bid')
    SELECT u.case_id, case_number, county_code, county_name, property_address, nullif(current_bid_amount,0) AS current_bid_amount, nullif(minimum_next_bid,0) AS minimum_next_bid, next_bid_deadline, n AS days_remaining, urgency,
      CASE WHEN n IS NULL THEN 'No deadline' WHEN urgency='expired' THEN 'EXPIRED' WHEN n=0 THEN 'TODAY' WHEN n=1 THEN '1 day' ELSE concat(n,' days') END AS label, sale_date,
      EXISTS (SELECT 1 FROM watchlist w WHERE w.case_id=u.case_id AND w.user_id=1) AS is_watchlisted, case_url, nullif(our_max_bid,0) AS our_max_bid,
      CASE WHEN nullif(estimated_sale_price,0) IS NOT NULL AND nullif(our_max_bid,0) IS NOT NULL THEN estimated_sale_price-our_max_bid-coalesce(estimated_rehab_cost,0) END AS estimated_profit, {KIND_SQL} AS case_kind,
      {', '.join('wide.' + s for s in R.SOURCE_BY_COUNTY_CODE.values())}, interest_status FROM u LEFT JOIN wide ON wide.case_id=u.case_id""",
       money="current_bid_amount minimum_next_bid our_max_bid estimated_profit", days="sale_date", moments="next_bid_deadline")
def upset_board(t):
    return S.upset_board(t.docket_cases, t.enrichments_long, t.watchlist, 1, AS_OF)


_EVENTS_TEXT = "string_agg(concat(coalesce(cast(event_date AS VARCHAR),'-'),'/',coalesce(event_type,'-')), '|' ORDER BY event_date DESC NULLS LAST, event_id)"


def _shown_nested(df):
    show = lambda e: F.concat(F.coalesce(e["event_date"].cast("string"), F.lit("-")), F.lit("/"), F.coalesce(e["event_type"], F.lit("-")))
    return df.withColumns({
        "parties": F.array_join(F.transform(F.array_sort(F.map_entries("parties")), lambda p: F.concat(p["key"], F.lit(":"), F.array_join(p["value"], ","))), "|"),
        "hearings": F.array_join(F.transform("hearings", lambda h: F.concat(h["hearing_date"].cast("string"), F.lit(" "), h["hearing_time"])), "|"),
        "events": F.array_join(F.transform("events", show), "|"), "bidders": F.size("bidders")})


_NESTED = f"""ev AS (SELECT case_id, {_EVENTS_TEXT} AS events, count(*) FILTER (event_type ILIKE '%upset%') AS bidders FROM case_events GROUP BY case_id),
    pt AS (SELECT case_id, party_type, string_agg(party_name, ',' ORDER BY party_name) AS names FROM parties GROUP BY ALL), pp AS (SELECT case_id, string_agg(party_type||':'||names, '|' ORDER BY party_type) AS parties FROM pt GROUP BY case_id),
    hh AS (SELECT case_id, string_agg(cast(hearing_date AS VARCHAR)||' '||hearing_time, '|' ORDER BY hearing_no) AS hearings FROM hearings GROUP BY case_id),
    nested AS (SELECT case_id, 0 AS chunk, pp.parties, ev.events, ev.bidders, hh.hearings FROM pp FULL JOIN ev USING (case_id) FULL JOIN hh USING (case_id))"""


@query("case_nested", f"WITH {_NESTED} SELECT * FROM nested")
def case_nested(t):
    return _shown_nested(S.case_nested(t.parties, t.case_events, t.hearings))


_DETAIL = f"""WITH {_NESTED}, {_WIDE} SELECT c.case_id, c.case_number, c.current_bid_amount, EXISTS (SELECT 1 FROM watchlist w WHERE w.case_id=c.case_id AND w.user_id=1) AS is_watchlisted,
      CASE WHEN nullif(estimated_sale_price,0) IS NOT NULL AND nullif(our_max_bid,0) IS NOT NULL THEN estimated_sale_price-our_max_bid-coalesce(estimated_rehab_cost,0) END AS estimated_profit,
      wake_re, chunk, parties, events, bidders, hearings FROM docket_cases c LEFT JOIN wide ON wide.case_id=c.case_id LEFT JOIN nested ON nested.case_id=c.case_id"""


@query("case_detail", _DETAIL, money="current_bid_amount estimated_profit")
def case_detail(t):
    d = S.case_detail(t.docket_cases, t.parties, t.case_events, t.hearings, t.enrichments_long, t.watchlist, 1)
    return _shown_detail(d)


def _shown_detail(d):
    return _shown_nested(d).select("case_id", "case_number", "current_bid_amount", "is_watchlisted", "estimated_profit", "wake_re", "chunk",
                                   "parties", "events", "bidders", "hearings")


def placed_tables(t, buckets: int):
    """The tables of a case's page in a store, all by case in the same number of buckets."""
    store = TableStore(t.spark, shared_folder(t.spark, "placed"))
    tables = {"cases": t.docket_cases, "parties": t.parties, "events": t.case_events, "hearings": t.hearings, "enrichments": t.enrichments_long,
              "watchlist": t.watchlist}
    with store.begin() as tx:
        for name, df in tables.items():
            tx.write(name, df, buckets)
        made = tx.commit()
    return {name: store.read(name, made) for name in tables}


@query("case_detail_placed", _DETAIL, money="current_bid_amount estimated_profit")
def case_detail_placed(t):
    """Case detail over tables that lie by case: only finished parts of the nested arrays move."""
    return _shown_detail(S.case_detail(**placed_tables(t, 16), user_id=1, placed=16))


@query("daily_review", """WITH n AS (SELECT case_id, case_number FROM docket_cases WHERE CAST(created_at AS DATE)=DATE '1998-06-15' AND reviewed_at IS NULL),
    e AS (SELECT case_id, concat('[', string_agg(concat('{', CASE WHEN event_date IS NULL THEN '' ELSE concat('"event_date":"',event_date,'"', CASE WHEN event_type IS NULL THEN '' ELSE ',' END) END,
      CASE WHEN event_type IS NULL THEN '' ELSE concat('"event_type":"',event_type,'"') END, '}'), ',' ORDER BY event_date DESC NULLS LAST, event_id), ']') AS events FROM case_events GROUP BY case_id)
    SELECT 'foreclosure' AS kind, n.case_id AS id, n.case_number, CASE WHEN e.case_id IS NULL THEN NULL ELSE 0 END AS chunk, e.events FROM n LEFT JOIN e ON e.case_id=n.case_id
    UNION ALL SELECT 'skipped', id, case_number, 0, events_json FROM quarantine WHERE review_action IS NULL AND scrape_date>=DATE '1998-06-08'""")
def daily_review(t):
    return S.daily_review(t.docket_cases, t.case_events, t.quarantine, AS_OF)


@query("run_history", """WITH r AS (SELECT * FROM run_log ORDER BY run_day DESC LIMIT 20) SELECT r.run_id, r.found, (SELECT string_agg(task_name||'='||items_checked||'/'||items_failed, ',' ORDER BY task_order) FROM run_tasks k WHERE k.run_id=r.run_id) AS tasks FROM r""")
def run_history(t):
    show = lambda k: F.concat(k["task_name"], F.lit("="), k["items_checked"].cast("string"), F.lit("/"), k["items_failed"].cast("string"))
    return S.run_history(t.run_log, t.run_tasks).select("run_id", "found", F.array_join(F.transform("tasks", show), ",").alias("tasks"))


@query("analysis_corpus", f"""WITH u AS (SELECT * FROM docket_documents WHERE length(ocr_text)>0 QUALIFY row_number() OVER (PARTITION BY case_id, md5(ocr_text) ORDER BY document_id)=1),
    q AS (SELECT u.*, row_number() OVER (PARTITION BY u.case_id ORDER BY {TIER_SQL}, document_date NULLS FIRST, document_id) AS n FROM u JOIN cases c ON c.case_id=u.case_id)
    SELECT case_id, 'documents' AS part, 0 AS chunk, md5(string_agg(concat('--- DOCUMENT ',n,': ',document_name,' ---',chr(10),ocr_text,chr(10),'--- END DOCUMENT ',n,' ---'), chr(10)||chr(10) ORDER BY n)) AS body_md5 FROM q GROUP BY case_id
    UNION ALL SELECT case_id, 'events', 0, md5(string_agg(concat('- [',coalesce(cast(event_date AS VARCHAR),'Unknown date'),'] ',event_type,': ',event_description), chr(10) ORDER BY event_date DESC NULLS LAST, event_id)) FROM case_events
      WHERE event_type IS NOT NULL AND event_description<>'' GROUP BY case_id""")
def analysis_corpus(t):
    return S.analysis_corpus(t.docket_documents, t.cases, t.case_events).select("case_id", "part", "chunk", F.md5("body").alias("body_md5"))


@query("analysis_view", """SELECT c.case_id, coalesce(a.status,'not_found') AS status, CASE WHEN a.red_flags IS NULL THEN '' ELSE 'lien,heirs' END AS red_flags,
    CASE WHEN e.case_id IS NULL THEN NULL WHEN e.error IS NOT NULL THEN 'error' ELSE 'success' END AS lookup FROM cases c LEFT JOIN analyses a ON a.case_id=c.case_id LEFT JOIN enrichments_long e ON e.case_id=c.case_id""")
def analysis_view(t):
    return S.analysis_view(t.cases, t.analyses, t.enrichments_long).withColumn("red_flags", F.array_join("red_flags", ","))
