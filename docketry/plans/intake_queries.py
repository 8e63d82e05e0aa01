"""Registered queries: page ingest, incremental intake, stream and daily run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import rules as R

from docketry.operators import maintenance as M
from docketry.plans.extract_queries import read_steps
from docketry.plans.registry import SQL_CALENDAR, query
from docketry.plans.state_queries import _APPLY, _CLASSIFY
from docketry.session import shared_folder
from docketry.sources import pages as PG
from docketry.sources.sample_views import AS_OF, SampleTables
from docketry.sources.versions import TableStore
from docketry.streaming import intake as N
from docketry.streaming.daily import DailyRun

CHUNK = 500


# --- pages, marked up from the sample tables -----------------------------------------------------------------------------


def case_pages(t):
    """One docket page per case and chunk of entries."""
    line = lambda label, c: F.coalesce(F.concat(F.lit(label), c, F.lit("\n")), F.lit(""))
    block = F.concat(
        F.lit('<div ng-repeat="event in roa.events">\n'), line("", F.date_format("event_date", "MM/dd/yyyy")), line("", F.col("event_type")),
        line("", F.col("event_description")), F.lit("Filed By: The&nbsp;Clerk\nIndex # "), F.col("event_index").cast("string"),
        F.when(F.col("event_id") % 2 == 0, F.lit('\n<button aria-label="Open document">Click here to view the document</button>')).otherwise(F.lit("")), F.lit("\n</div>"))
    chunked = t.case_events.groupBy("case_id", F.floor((F.col("event_index") - 1) / CHUNK).alias("chunk")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("event_index", block.alias("b"))))["b"], "\n").alias("blocks"))
    info = lambda label, c: F.concat(F.lit(f"<tr><td>{label}</td><td>"), c, F.lit("</td></tr>"))
    p = t.cases.join(chunked, "case_id")
    html = F.concat(
        F.lit('<html><script>var ad="FORECLOSURE x";</script><table class="roa-caseinfo-info-rows">'), info("Case&nbsp;Type:", F.col("case_type")), info("Case Status:", F.lit("Open")),
        F.lit("</table>\n<div>"), F.col("style"), F.lit("</div>\nFiled on: "), F.date_format("file_date", "MM/dd/yyyy"), F.lit('\n<table class="roa-table td-pad-5">'),
        info("Respondent", F.concat(F.lit("Party&nbsp;"), F.col("case_id").cast("string"))), info("Bystander", F.lit("Nobody")), F.lit("</table>"),
        F.coalesce("blocks", F.lit("")), F.lit('<div ng-repeat="hearing in hearings">\n'), F.date_format(F.date_add("file_date", 20), "MM/dd/yyyy"),
        F.lit("\nForeclosure Hearing (2:30 PM)\n</div></html>"))
    # reading markup is the work here, so small pages must not be merged into a few tasks
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return p.select((F.col("case_id") * 1000 + F.col("chunk")).alias("page_id"), html.alias("html")).repartition(parts, "page_id")


@query("case_page_cases", """SELECT case_id, case_type, 'Open' AS case_status, file_date, CASE WHEN starts_with(style,'FORECLOSURE') THEN style END AS style FROM cases
    WHERE case_id IN (SELECT case_id FROM case_events)""", days="file_date")
def case_page_cases(t):
    return PG.ingest_case_pages(case_pages(t))["cases"].where("page_id % 1000 = 0").select(
        F.floor(F.col("page_id") / 1000).alias("case_id"), "case_type", "case_status", "file_date", "style")


@query("case_page_events", """SELECT case_id, event_index, event_date, event_type, CASE WHEN event_type IS NOT NULL THEN event_description END AS event_description, 'The Clerk' AS filed_by, event_id%2=0 AS has_document
    FROM case_events WHERE event_date IS NOT NULL OR event_type IS NOT NULL""", days="event_date")
def case_page_events(t):
    return PG.ingest_case_pages(case_pages(t))["events"].select(
        F.floor(F.col("page_id") / 1000).alias("case_id"), "event_index", "event_date", "event_type", "event_description", "filed_by", "has_document")


@query("case_page_parties", "SELECT case_id, 'Respondent' AS party_type, concat('Party ', case_id) AS party_name FROM cases WHERE case_id IN (SELECT case_id FROM case_events)")
def case_page_parties(t):
    return PG.ingest_case_pages(case_pages(t))["parties"].where("page_id % 1000 = 0").select(
        F.floor(F.col("page_id") / 1000).alias("case_id"), "party_type", "party_name")


@query("case_page_hearings", "SELECT case_id, file_date + 20 AS hearing_date, '2:30 PM' AS hearing_time, 'Foreclosure Hearing' AS hearing_type FROM cases WHERE case_id IN (SELECT case_id FROM case_events)", days="hearing_date")
def case_page_hearings(t):
    return PG.ingest_case_pages(case_pages(t))["hearings"].where("page_id % 1000 = 0").select(
        F.floor(F.col("page_id") / 1000).alias("case_id"), "hearing_date", "hearing_time", "hearing_type")


_PAGES = "(SELECT case_id, (event_index-1)//500 AS chunk FROM case_events GROUP BY ALL)"


@query("page_store", f"""SELECT 'first day' AS day, count(*) AS pages, count(*) AS pages_read, (SELECT count(*) FROM case_events WHERE event_date IS NOT NULL OR event_type IS NOT NULL) AS events FROM {_PAGES}
    UNION ALL SELECT 'second day', count(*), count(*) FILTER (case_id%50=0), (SELECT count(*) FROM case_events WHERE event_date IS NOT NULL OR event_type IS NOT NULL) FROM {_PAGES}
    UNION ALL SELECT 'again', count(*), 0, (SELECT count(*) FROM case_events WHERE event_date IS NOT NULL OR event_type IS NOT NULL) FROM {_PAGES}""")
def page_store(t):
    """Pages of two days through the store: the second day one case in fifty has another page, then nothing has."""
    store = PG.MarkupStore(t.spark, shared_folder(t.spark, "markup"))
    kept = shared_folder(t.spark, "pages")  # the store goes through pages more than once, so they are made once
    case_pages(t).write.parquet(kept)
    first = t.spark.read.parquet(kept)
    second = first.withColumn("html", F.when(F.floor(F.col("page_id") / 1000) % 50 == 0, F.concat("html", F.lit("<p>Seen</p>"))).otherwise(F.col("html")))
    rows = []
    for day, pages in (("first day", first), ("second day", second), ("again", second)):
        m = store.of(pages)
        rows.append((day, m.count(), store.read, PG.ingest_case_pages(m)["events"].count()))
    return t.spark.createDataFrame(rows, "day string, pages bigint, pages_read bigint, events bigint")


@query("reconcile_pages", """SELECT county_code, max(n) + CASE WHEN county_code='310' THEN 1 ELSE 0 END AS stated, max(n) AS ingested, county_code<>'310' AS is_complete FROM (SELECT county_code, count(*) AS n FROM docket_cases GROUP BY county_code) g GROUP BY county_code""")
def reconcile_pages(t):
    """The count each county's result pages state in their pager against the rows taken from them; Durham states one more than there are."""
    row = F.concat(F.lit('<tr><td><a class="caseLink" data-url="/Portal/Case/'), F.col("case_id").cast("string"), F.lit('" href="#"> '), F.col("case_number"), F.lit("</a></td><td>"),
                   F.col("style"), F.lit("</td><td>Pending</td><td>"), F.col("county_name"), F.lit("</td></tr>"))
    listed = t.docket_cases.select("county_code", "case_id", row.alias("row")).join(
        t.docket_cases.groupBy("county_code").agg(F.count(F.lit(1)).alias("n")), "county_code")
    pager = F.concat(F.lit('<span class="k-pager-info">1 - 10 of '), (F.col("n") + F.when(F.col("county_code") == "310", 1).otherwise(0)).cast("string"), F.lit(" items</span>"))
    pages = listed.groupBy("county_code", "n", F.floor(F.col("case_id") / CHUNK).alias("page")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("case_id", "row")))["row"], "").alias("r")).select(
        (F.col("county_code").cast("bigint") * 1_000_000_000 + F.col("page")).alias("page_id"),
        F.concat(F.lit("<table><tr><th>Case Number</th><th>Style</th></tr>"), "r", F.lit("</table>"), pager).alias("html"))
    m = PG.MarkupStore(t.spark, shared_folder(t.spark, "markup")).of(pages)
    county = F.floor(F.col("page_id") / 1_000_000_000).cast("string").alias("county_code")
    return M.reconcile(PG.stated_counts(m).withColumn("county_code", county), PG.ingest_search_pages(m).withColumn("county_code", county), "county_code")


@query("search_pages", """SELECT case_number, 'https://portal-nc.tylertech.cloud/Portal/Case/'||case_id AS case_url, style, 'Pending' AS status, county_name AS location FROM docket_cases""")
def search_pages(t):
    row = F.concat(F.lit('<tr><td><a class="caseLink" data-url="/Portal/Case/'), F.col("case_id").cast("string"), F.lit('" href="#"> '), F.col("case_number"), F.lit("</a></td><td>"),
                   F.col("style"), F.lit("</td><td>Pending</td><td>"), F.col("county_name"), F.lit("</td></tr>"))
    pages = t.docket_cases.groupBy(F.floor(F.col("case_id") / CHUNK).alias("page_id")).agg(F.array_join(F.collect_list(row), "\n").alias("r")).select(
        "page_id", F.concat(F.lit("<table><tr><td>Menu</td></tr></table><table><tr><th>Case Number</th><th>Style</th></tr>"), "r", F.lit("</table>")).alias("html"))
    return PG.ingest_search_pages(pages).drop("page_id")


def result_pages(parcels: DataFrame) -> DataFrame:
    """(page_id, html): result pages of at most ``CHUNK`` parcels. Account ids repeat without bound, so a page is a stretch
    of a task's rows."""
    cell = lambda c: F.concat(F.lit("<td> "), c, F.lit("</td>"))
    blank = cell(F.lit(""))
    row = F.concat(F.lit("<tr>"), cell(F.lit("1")), F.lit('<td><a href="Account.asp?id='), F.col("account_id"), F.lit('">x</a></td>'), cell(F.col("stnum")), blank, cell(F.col("prefix")),
                   cell(F.col("street_name")), cell(F.lit("ST")), blank, cell(F.col("etj")), cell(F.lit("Owner")), F.lit("</tr>"))
    return paged(parcels, row)


def paged(rows: DataFrame, row: Column) -> DataFrame:
    """(page_id, html): tables of at most ``CHUNK`` rows of markup."""
    numbered = rows.select(row.alias("row"), F.floor(F.monotonically_increasing_id() / CHUNK).alias("page_id"))
    return numbered.groupBy("page_id").agg(F.array_join(F.collect_list("row"), "").alias("r")).select(
        "page_id", F.concat(F.lit("<table>"), "r", F.lit("</table>")).alias("html"))


@query("parcel_pages", "SELECT account_id, stnum, prefix, street_name, etj FROM parcels")
def parcel_pages(t):
    return PG.ingest_parcel_pages(result_pages(t.parcels))["accounts"].select("account_id", "stnum", "prefix", "street_name", "etj")


@query("street_rows", "SELECT locid, prefix, street_name, street_type, suffix, etj, low_num, high_num FROM street_rows")
def street_rows(t):
    """Street ranges out of the street selection pages; a cell that holds no number is no bound."""
    cell = lambda c: F.concat(F.lit("<td> "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>"))
    row = F.concat(F.lit('<tr><td><input type="checkbox" name="c1" value="'), F.col("locid"), F.lit('"></td>'),
                   *[cell(c) for c in ("prefix", "street_name", "street_type", "suffix", "etj", "low_num")],
                   F.when(F.col("high_num").isNull() & (F.col("locid").cast("int") % 2 == 0), "<td>none</td>").otherwise(cell("high_num")), F.lit("</tr>"))
    return PG.ingest_parcel_pages(paged(t.street_rows, row))["streets"].drop("page_id")


@query("page_links", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages""")
def page_links(t):
    return PG.extract_links(t.pages, 'href="([^"]+)"')


@query("party_whitelist", "SELECT case_id, kind, party_name FROM (SELECT case_id, CASE WHEN case_id%5=0 THEN 'Heir' WHEN case_id%7=0 THEN concat('Substitute ',party_type) ELSE party_type END AS kind, party_name FROM parties) x WHERE kind<>'Heir'")
def party_whitelist(t):
    kind = F.when(F.col("case_id") % 5 == 0, "Heir").when(F.col("case_id") % 7 == 0, F.concat(F.lit("Substitute "), F.col("party_type"))).otherwise(F.col("party_type"))
    return t.parties.select("case_id", kind.alias("kind"), "party_name").where(PG.is_party_type(F.col("kind")))


@query("page_fallback_events", "WITH p AS (SELECT unnest([" + ",".join(f"'{x}'" for x in R.PAGE_FALLBACK_PHRASES) + """]) AS phrase)
    SELECT e.event_id, p.phrase AS event_type FROM case_events e JOIN p ON contains(lower(concat(coalesce(event_type,''),' ',coalesce(event_description,''))), p.phrase)""")
def page_fallback_events(t):
    text = F.concat_ws(" ", "event_type", "event_description")
    return t.case_events.select("event_id", F.explode(PG.fallback_phrases(text)).alias("event_type"))


# --- incremental intake ---------------------------------------------------------------------------------------------

_SIG = "coalesce({a}.event_date, DATE '0001-01-01')=coalesce({b}.event_date, DATE '0001-01-01') AND lower(trim(coalesce({a}.event_type,'')))=lower(trim(coalesce({b}.event_type,'')))"
_SAME = _SIG.format(a="s", b="p")
_NEW = f"""mx AS (SELECT case_id, max(event_index) AS m FROM case_events GROUP BY case_id), sh AS (SELECT case_id, max(event_index) AS top, bool_and(coalesce(event_index,0)<>0) AS idx FROM parsed_events GROUP BY case_id),
    added AS (SELECT p.* FROM parsed_events p JOIN sh ON sh.case_id=p.case_id LEFT JOIN mx ON mx.case_id=p.case_id WHERE CASE WHEN coalesce(m,0)>0 AND top>m THEN p.event_index>m WHEN coalesce(m,0)>0 AND idx THEN false
      ELSE coalesce(p.event_type,'')<>'' AND NOT EXISTS (SELECT 1 FROM case_events s WHERE s.case_id=p.case_id AND {_SAME}) END)"""


@query("new_events", f"WITH {_NEW} SELECT case_id, event_index, event_date, event_type FROM added", days="event_date")
def new_events(t):
    return N.new_events(t.case_events, t.parsed_events).select("case_id", "event_index", "event_date", "event_type")


def _last(value: str, keys: str, test: str) -> str:
    return f"(SELECT {value} FROM parsed_events p WHERE p.case_id=s.case_id AND {keys} AND {test} ORDER BY coalesce(event_index,0) DESC, {value} DESC LIMIT 1)"


_PD = """pd AS (SELECT case_id, coalesce(event_date, DATE '0001-01-01') AS d, lower(trim(coalesce(event_type,''))) AS k, {v} AS v FROM parsed_events WHERE {w}
    QUALIFY row_number() OVER (PARTITION BY case_id, coalesce(event_date, DATE '0001-01-01'), lower(trim(coalesce(event_type,''))) ORDER BY coalesce(event_index,0) DESC, {v} DESC)=1)"""


@query("fill_desc", "WITH " + _PD.format(v="event_description", w="event_description<>''") + """ SELECT s.event_id, coalesce(nullif(s.event_description,''), pd.v) AS event_description FROM case_events s
    LEFT JOIN pd ON pd.case_id=s.case_id AND pd.d=coalesce(s.event_date, DATE '0001-01-01') AND pd.k=lower(trim(coalesce(s.event_type,'')))""")
def fill_desc(t):
    return N.fill_descriptions(t.case_events, t.parsed_events).select("event_id", "event_description")


@query("sig_join", "WITH " + _PD.format(v="event_index", w="coalesce(event_index,0)<>0") + """ SELECT s.event_id, CASE WHEN s.event_id%2=0 THEN pd.v ELSE s.event_index END AS event_index FROM case_events s
    LEFT JOIN pd ON pd.case_id=s.case_id AND pd.d=coalesce(s.event_date, DATE '0001-01-01') AND pd.k=lower(trim(coalesce(s.event_type,'')))""")
def sig_join(t):
    unnumbered = t.case_events.withColumn("event_index", F.when(F.col("event_id") % 2 == 1, F.col("event_index")))
    return N.fill_indexes(unnumbered, t.parsed_events).select("event_id", "event_index")


@query("type_backfill", """WITH pt AS (SELECT case_id, event_date, event_type FROM parsed_events WHERE event_date IS NOT NULL AND event_type<>'' QUALIFY row_number() OVER (PARTITION BY case_id, event_date ORDER BY coalesce(event_index,0) DESC, event_type DESC)=1)
    SELECT s.event_id, coalesce(s.event_type, pt.event_type) AS event_type FROM case_events s LEFT JOIN pt ON pt.case_id=s.case_id AND pt.event_date=s.event_date""")
def type_backfill(t):
    return N.fill_types(t.case_events, t.parsed_events).select("event_id", "event_type")


@query("new_signatures", """SELECT case_id, event_date, lower(trim(coalesce(event_type,''))) AS event_type FROM parsed_events EXCEPT SELECT case_id, event_date, lower(trim(coalesce(event_type,''))) FROM case_events""", days="event_date")
def new_signatures(t):
    return N.new_signatures(t.case_events, t.parsed_events)


@query("incr_extract", "WITH late AS (SELECT event_id FROM case_events WHERE event_index>4), dt AS (SELECT document_id AS text_id, ocr_text AS body FROM docket_documents WHERE length(ocr_text)>0 AND event_id IN (SELECT event_id FROM late)), "
       + read_steps("dt") + " SELECT document_id, property_address, current_bid_amount, sale_date FROM docs_read", money="current_bid_amount", days="sale_date")
def incr_extract(t):
    return N.extract_new(t.docket_documents, t.case_events.where("event_index > 4")).select("document_id", "property_address", "current_bid_amount", "sale_date")


# --- stream and daily run --------------------------------------------------------------------------------------------


_KINDS = {"view": "Notice of Hearing", "click": "Upset Bid Filed", "error": "Notice of Bankruptcy", "purchase": "Report of Sale", "signup": "Foreclosure Case Initiated"}
# The classification of all cases over the mapped event table: every event is new, as ids are indexes and rise.
_STREAMED = "WITH " + SQL_CALENDAR + f""", streamed AS (SELECT event_id, user_id+1 AS case_id, cast(ts AS DATE) AS event_date,
    CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} END AS event_type FROM events),""" + _CLASSIFY.replace("FROM case_events", "FROM streamed") + _APPLY


@query("event_stream", _STREAMED + """ SELECT s.case_id, CASE WHEN e.case_id IS NULL THEN s.classification ELSE coalesce(new_state, s.classification) END AS classification,
    CASE WHEN e.case_id IS NULL THEN s.sale_date ELSE new_sale_date END AS sale_date,
    CASE WHEN e.case_id IS NULL THEN s.next_bid_deadline WHEN coalesce(new_state, s.classification)='upset_bid' AND new_sale_date IS NOT NULL AND (kept_deadline IS NULL OR CAST(kept_deadline AS DATE) < new_sale_date)
      THEN CAST(repaired AS TIMESTAMP) ELSE kept_deadline END AS next_bid_deadline
    FROM step10 s LEFT JOIN (SELECT DISTINCT case_id FROM streamed) e ON e.case_id=s.case_id""", days="sale_date", moments="next_bid_deadline")
def event_stream(t):
    """The sample event file as a stream of docket events; the case table after it is taken in."""
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair]), F.col("event_type"))
    stream = source.select(
        "event_id", (F.col("user_id") + 1).alias("case_id"), (F.col("event_id") + 1).cast("int").alias("event_index"), F.col("ts").cast("date").alias("event_date"),
        kind.alias("event_type"), F.concat(F.lit("Bid Amount $"), F.col("value").cast("decimal(12,2)").cast("string")).alias("event_description"))
    store = shared_folder(t.spark, "event-stream")
    taken = N.EventIntake(t.docket_cases, f"{store}/store", AS_OF)
    taken.start(stream, f"{store}/checkpoint").awaitTermination()
    return taken.states().select("case_id", "classification", "sale_date", "next_bid_deadline")


def day_tables(t: SampleTables, store: TableStore) -> dict[str, DataFrame]:
    """The tables of a day. Cases, events and what hangs on them are put into the store on the way, so that tables over them
    are made from the stored ones and the order lines are numbered once."""
    none = lambda kind: F.lit(None).cast(kind)
    with store.begin() as tx:
        made = {"case_events": tx.write("case_events", t.case_events)}
        cases = tx.write("cases", t.docket_cases.withColumns(
            {"case_status": none("string"), "updated_at": none("timestamp_ntz"), "attorney_name": none("string")}))
        made["cases"] = cases.select(*t.cases.columns)
        for name in ("docket_documents", "parties", "hearings"):
            made[name] = tx.write(name, getattr(t.given(**made), name))
        tx.commit({"kind": "input", "run": AS_OF})
    t = t.given(**made)
    # every case is seen again, with its number's year turned for one in fifty: those are new to the case table
    number = F.when(F.col("case_id") % 50 == 0, F.concat(F.lit("99"), F.substring("case_number", 3, 20))).otherwise(F.col("case_number"))
    seen = t.cases.withColumn("case_number", number)
    incoming = seen.select("case_number", F.upper("case_type").alias("case_type"), F.lit("Pending").alias("case_status"), "style")
    events = t.case_events.join(seen.where("case_id % 50 = 0").select("case_id", "case_number"), "case_id").select(
        "case_number", "event_date", "event_type", "event_description", none("string").alias("document_title"))
    parsed = t.parsed_events.withColumn("event_id", F.xxhash64("case_id", "event_index", "event_date", "event_type", "event_description"))
    numbered = lambda rows: rows.join(seen.select("case_id", "case_number"), "case_id").drop("case_id")
    return {"incoming": incoming, "incoming_events": events, "parsed_events": parsed, "analyses": t.analyses,
            "incoming_parties": numbered(t.parties), "incoming_hearings": numbered(t.hearings), "second_source": t.second_source}


@query("daily_run")
def daily_run(t):
    """A whole day over the sample tables; the case table as the day leaves it."""
    folder = shared_folder(t.spark, "daily-run")
    day = DailyRun(t.spark, day_tables(t, TableStore(t.spark, folder)), folder, AS_OF)
    failed = [r["task_name"] for r in day.run().where("status <> 'success'").collect()]  # a row a task
    if failed:
        raise RuntimeError(f"tasks failed: {failed}: {[a[4] for a in day.audit if a[4]]}")
    return day.tables["cases"].select("case_id", "case_number", "case_status", "classification", "sale_date", "current_bid_amount",
                                      "minimum_next_bid", "next_bid_deadline", "property_address", "is_finalized", "finalized_at", "finalized_event_id")
