"""Registered queries: keyed updates, quarantine, parcel look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.addresses import with_address_parts
from docketry.functions.dates import as_moment
from docketry.functions.jsontext import as_variant, json_shape, variant_objects
from docketry.operators import maintenance as M
from docketry.operators import parcels as P
from docketry.plans.registry import SQL_CALENDAR, query, sql_any
from docketry.plans.value_queries import _PARSE
from docketry.session import shared_folder
from docketry.sources.sample_views import AS_OF
from docketry.sources.versions import TableStore

# --- cases and quarantine ----------------------------------------------------------------------------------------------

_NEW_CASES = """incoming AS (SELECT CASE WHEN case_id%4=0 THEN replace(case_number,'SP','SX') ELSE case_number END AS case_number, upper(case_type) AS case_type, 'Pending' AS case_status, concat(style,' (renewed)') AS style,
    file_date FROM cases WHERE case_id%2=0)"""


def _incoming(t):
    return t.sql(f"SELECT * FROM ({_NEW_CASES[len('incoming AS ('):-1]}) i")


@query("upsert_cases", f"""WITH {_NEW_CASES} SELECT coalesce(c.case_number, i.case_number) AS case_number, c.case_id, CASE WHEN i.case_number IS NOT NULL THEN i.case_type ELSE c.case_type END AS case_type,
    CASE WHEN i.case_number IS NOT NULL THEN i.case_status END AS case_status, CASE WHEN i.case_number IS NOT NULL THEN i.style ELSE c.style END AS style, coalesce(c.file_date, i.file_date) AS file_date,
    CASE WHEN i.case_number IS NOT NULL THEN TIMESTAMP '1998-06-15 12:00:00' END AS updated_at FROM cases c FULL JOIN incoming i ON i.case_number=c.case_number""", days="file_date", moments="updated_at")
def upsert_cases(t):
    stored = t.cases.select("case_number", "case_id", "case_type", F.lit(None).cast("string").alias("case_status"), "style", "file_date",
                            F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    return M.upsert_cases(stored, _incoming(t), AS_OF)


@query("reject_cascade", """SELECT 'cases' AS tbl, count(*) AS n FROM cases WHERE case_id%9<>0 UNION ALL SELECT 'case_events', count(*) FROM case_events WHERE case_id%9<>0
    UNION ALL SELECT 'parties', count(*) FROM parties WHERE case_id%9<>0 UNION ALL SELECT 'docket_documents', count(*) FROM docket_documents WHERE case_id%9<>0""")
def reject_cascade(t):
    tables = {"cases": t.cases, "case_events": t.case_events, "parties": t.parties, "docket_documents": t.docket_documents}
    left = M.delete_cases(tables, t.cases.where("case_id % 9 = 0"))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


_CASE_TABLES = ("cases", "case_events", "parties", "hearings", "docket_documents", "user_notes")
_ROW_TEXT = {"cases": "case_number", "case_events": "event_id", "parties": "party_type||':'||party_name", "hearings": "hearing_no", "docket_documents": "document_id", "user_notes": "user_id||':'||note"}


@query("reject_rows", " UNION ALL ".join(f"SELECT '{n}' AS tbl, case_id, CAST({text} AS VARCHAR) AS item FROM {n} WHERE case_id%9<>0" for n, text in _ROW_TEXT.items()))
def reject_rows(t):
    """Cases taken out of a store with all that hangs on them, in one transaction; what is left, row by row."""
    store = TableStore(t.spark, shared_folder(t.spark, "reject"))
    with store.begin() as tx:
        for name in _CASE_TABLES:  # those over cases and events are made from the stored ones
            stored = {n: tx.read(n) for n in ("cases", "case_events") if tx.has(n)}
            tx.write(name, getattr(t.given(**stored), name))
        tx.commit()
    with store.begin() as tx:
        held = {name: tx.read(name) for name in _CASE_TABLES}
        for name, left in M.delete_cases(held, held["cases"].where("case_id % 9 = 0")).items():
            tx.write(name, left)
        tx.commit({"what": "reject"})
    newest, out = store.snapshot(), None
    for name, text in _ROW_TEXT.items():
        rows = store.read(name, newest).select(F.lit(name).alias("tbl"), "case_id", F.expr(f"CAST({text} AS STRING)").alias("item"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("quarantine_json", """WITH cand AS (SELECT case_number, file_date, strftime(file_date,'%m/%d/%Y') AS d FROM cases WHERE case_id%5=0)
    SELECT case_number, concat('[{"event_date":"',d,'","event_type":"Petition","document_title":null,"has_document":false},{"event_date":null,"event_type":"Affidavit","document_title":"Deed \\\"A\\\"","has_document":true}]') AS events_json
    FROM cand WHERE case_number NOT IN (SELECT case_number FROM cases WHERE case_id%15=0)""")
def quarantine_json(t):
    event = lambda d, k, title, has: F.struct(d.alias("event_date"), F.lit(k).alias("event_type"), F.lit(title).cast("string").alias("document_title"), F.lit(has).alias("has_document"))
    events = F.array(event(F.date_format("file_date", "MM/dd/yyyy"), "Petition", None, False), event(F.lit(None).cast("string"), "Affidavit", 'Deed "A"', True))
    found = t.cases.where("case_id % 5 = 0").select("case_number", events.alias("events"))
    known = t.cases.where("case_id % 15 = 0").select("case_number", F.lit("1998-06-15").cast("date").alias("scrape_date"))
    return M.quarantine(found, known, AS_OF).select("case_number", "events_json")


_ODD = """odd AS (SELECT id, CASE id%4 WHEN 1 THEN concat('"', replace(events_json, '"', concat(chr(92),'"')), '"') WHEN 3 THEN replace(events_json, '[{', '["junk",{') ELSE events_json END AS events_json FROM quarantine)"""


@query("quarantine_explode", """SELECT id, CASE WHEN events_json IS NULL THEN NULL ELSE '01/02/1998' END AS event_date, CASE WHEN events_json IS NULL THEN NULL ELSE CASE id%4 WHEN 0 THEN 'Petition To Sell' WHEN 1 THEN 'Name Change'
    WHEN 2 THEN 'Report of Sale' ELSE 'Petition' END END AS event_type, CASE WHEN events_json IS NULL THEN NULL ELSE false END AS has_document FROM quarantine""")
def quarantine_explode(t):
    odd = t.sql(f"SELECT * FROM ({_ODD[len('odd AS ('):-1]}) o")
    return M.explode_quarantine(odd).select("id", "event_date", "event_type", "has_document")


@query("candidate_rule", f"""WITH f AS (SELECT case_id, bool_or({sql_any('event_type', R.NON_PROPERTY)}) AS np, bool_or({sql_any('event_type', R.FORECLOSURE_EVENTS)}) AS fe, bool_or({sql_any('event_type', R.OPPORTUNITY_EVENTS)}) AS oe,
      bool_or({sql_any("CASE WHEN event_id%11=0 THEN 'Order for Sale' END", R.SALE_TITLES)}) AS ti, bool_or({sql_any('event_type', R.SALE_TITLES)} AND NOT {sql_any('event_type', ['motor vehicle'])}) AS ty,
      bool_or({sql_any('event_description', R.SALE_TITLES)} AND NOT {sql_any('event_description', ['motor vehicle'])}) AS de FROM case_events GROUP BY case_id),
    j AS (SELECT c.case_id, CASE WHEN c.case_id%17=0 THEN 'Adoption' ELSE c.case_type END AS case_type, f.* EXCLUDE (case_id) FROM cases c LEFT JOIN f ON f.case_id=c.case_id),
    r AS (SELECT case_id, CASE WHEN {sql_any('case_type', R.NON_PROPERTY)} OR coalesce(np,false) THEN 'non-property' WHEN contains(lower(case_type),'foreclosure') THEN 'case type' WHEN fe THEN 'foreclosure event' WHEN oe THEN 'sale event'
      WHEN ti THEN 'document title' WHEN ty THEN 'event type' WHEN de THEN 'event description' ELSE 'none' END AS rule FROM j)
    SELECT case_id, rule, rule NOT IN ('non-property','none') AS is_candidate FROM r""")
def candidate_rule(t):
    events = t.case_events.withColumn("document_title", F.when(F.col("event_id") % 11 == 0, "Order for Sale"))
    cases = t.cases.withColumn("case_type", F.when(F.col("case_id") % 17 == 0, "Adoption").otherwise(F.col("case_type")))
    return M.candidates(cases, events)


@query("reevaluate", """SELECT id, CASE WHEN review_action IS NULL AND events_json IS NOT NULL AND id%4 IN (0,2) THEN 'flagged_for_review' ELSE review_action END AS review_action FROM quarantine""")
def reevaluate(t):
    return M.reevaluate(t.quarantine).select("id", "review_action")


@query("promote_skipped", f"""WITH {SQL_CALENDAR}, q AS (SELECT id, case_number, case_type, CASE WHEN events_json IS NOT NULL AND id%4=2 THEN CASE WHEN id%8=2 THEN DATE '1998-06-10' ELSE DATE '1998-01-02' END END AS s FROM quarantine WHERE id%6<>0)
    SELECT case_number, case_type, s AS sale_date, d.deadline AS next_bid_deadline, CASE WHEN s IS NULL THEN 'upcoming' WHEN d.deadline >= DATE '1998-06-15' THEN 'upset_bid' ELSE 'closed_sold' END AS classification
    FROM q LEFT JOIN deadlines d ON d.day=s""", days="sale_date next_bid_deadline")
def promote_skipped(t):
    rows = t.quarantine.withColumn("events_json", F.when(F.col("id") % 8 == 2, F.replace("events_json", F.lit("01/02/1998"), F.lit("06/10/1998"))).otherwise(F.col("events_json")))
    return M.promote(rows, t.quarantine.where("id % 6 = 0").select("case_number"), AS_OF)


@query("reconcile_counts", """WITH g AS (SELECT county_code, count(*) AS n FROM cases GROUP BY county_code) SELECT county_code, n + CASE WHEN county_code IN ('310','910') THEN 1 ELSE 0 END AS stated, n AS ingested, county_code NOT IN ('310','910') AS is_complete FROM g""")
def reconcile_counts(t):
    n = t.cases.groupBy("county_code").agg(F.count(F.lit(1)).alias("n"))
    said = F.col("n") + F.when(F.col("county_code").isin("310", "910"), 1).otherwise(0)
    stated = n.select("county_code", F.format_string("1 - 10 of %d items", said).alias("pager_text"))
    return M.reconcile(stated, t.cases, "county_code")


@query("quarantine_retention", "SELECT id, scrape_date FROM quarantine WHERE NOT (coalesce(review_action,'')='dismissed' AND scrape_date < DATE '1998-06-08')", days="scrape_date")
def quarantine_retention(t):
    return M.retain(t.quarantine, 7, AS_OF).select("id", "scrape_date")


@query("review_apply", """SELECT case_id, CASE WHEN reviewed_at IS NOT NULL THEN reviewed_at WHEN CAST(created_at AS DATE)=DATE '1998-06-14' THEN TIMESTAMP '1998-06-15 12:00:00' END AS reviewed_at FROM docket_cases""", moments="reviewed_at")
def review_apply(t):
    that_day = t.docket_cases.where(F.col("created_at").cast("date") == F.lit("1998-06-14").cast("date"))
    return M.stamp_reviewed(t.docket_cases, that_day, "case_id", AS_OF).select("case_id", "reviewed_at")


@query("dismiss_apply", """SELECT id, CASE WHEN id%10=3 THEN 'dismissed' ELSE review_action END AS review_action, CASE WHEN id%10=3 THEN TIMESTAMP '1998-06-15 12:00:00' END AS reviewed_at FROM quarantine""", moments="reviewed_at")
def dismiss_apply(t):
    rows = t.quarantine.withColumn("reviewed_at", F.lit(None).cast("timestamp_ntz"))
    return M.stamp_reviewed(rows, rows.where("id % 10 = 3"), "id", AS_OF, "dismissed").select("id", "review_action", "reviewed_at")


@query("enqueue", """SELECT case_id, status, requested_on FROM analyses UNION ALL SELECT case_id, 'pending', DATE '1998-06-15' FROM cases WHERE case_id%4=1 AND case_id NOT IN (SELECT case_id FROM analyses)""", days="requested_on")
def enqueue(t):
    return M.enqueue(t.analyses, t.cases.where("case_id % 4 = 1"), AS_OF)


@query("requeue", """SELECT case_id, CASE WHEN case_id%4=2 THEN 'pending' ELSE status END AS status, CASE WHEN case_id%4=2 THEN DATE '1998-06-15' ELSE requested_on END AS requested_on FROM analyses
    UNION ALL SELECT case_id, 'pending', DATE '1998-06-15' FROM cases WHERE case_id%4=2 AND case_id NOT IN (SELECT case_id FROM analyses)""", days="requested_on")
def requeue(t):
    return M.enqueue(t.analyses, t.cases.where("case_id % 4 = 2"), AS_OF, rerun=True)


@query("watch_apply", """(SELECT user_id, case_id FROM watchlist UNION SELECT 1, case_id FROM cases WHERE case_id%22=0) EXCEPT SELECT 2, case_id FROM cases WHERE case_id%33=0""")
def watch_apply(t):
    pair = lambda user, rule: t.cases.where(rule).select(F.lit(user).cast("bigint").alias("user_id"), "case_id")
    return M.change_watchlist(t.watchlist, pair(1, "case_id % 22 = 0"), pair(2, "case_id % 33 = 0"))


# --- parcels ----------------------------------------------------------------------------------------------------------

_CODES = "MAP {" + ",".join(f"'{k}':'{v}'" for k, v in R.CITY_CODES.items()) + "}"
_SEARCH = f"""{_PARSE}, seek AS (SELECT case_id, stnum, upper(name) AS name, coalesce(prefix,'') AS prefix, {_CODES}[lower(city)] AS etj FROM parsed WHERE stnum IS NOT NULL AND name<>''),
    cand AS (SELECT s.case_id, p.account_id, p.prefix=s.prefix AS same_prefix, s.etj IS NULL OR p.etj=s.etj AS same_city FROM seek s JOIN parcels p ON p.stnum=s.stnum AND upper(p.street_name)=s.name AND (s.prefix='' OR p.prefix=s.prefix)),
    agg AS (SELECT case_id, count(*) AS n, min(account_id) AS only_id, min(account_id) FILTER (same_prefix AND same_city) AS lo, max(account_id) FILTER (same_prefix AND same_city) AS hi FROM cand GROUP BY case_id),
    matched AS (SELECT s.case_id, CASE WHEN lo=hi THEN lo WHEN n=1 THEN only_id END AS account_id, coalesce(n,0) AS matches_found FROM seek s LEFT JOIN agg a ON a.case_id=s.case_id)"""


@query("parcel_match", f"WITH {_SEARCH} SELECT * FROM matched")
def parcel_match(t):
    parsed = with_address_parts(t.docket_cases.select("case_id", "property_address"))
    found = P.match_parcels(parsed.where(F.col("stnum").isNotNull() & (F.length("name") > 0)), t.parcels)
    return found.select("case_id", "account_id", "matches_found")


@query("street_range", f"""WITH {_SEARCH} SELECT s.case_id, min(p.account_id) AS account_id FROM seek s LEFT JOIN parcels p ON upper(p.street_name)=s.name AND p.prefix=s.prefix
    AND (p.low_num IS NULL OR p.high_num IS NULL OR CAST(s.stnum AS BIGINT) BETWEEN p.low_num AND p.high_num) GROUP BY s.case_id""")
def street_range(t):
    parsed = with_address_parts(t.docket_cases.select("case_id", "property_address"))
    return P.match_street_ranges(parsed.where(F.col("stnum").isNotNull() & (F.length("name") > 0)), t.parcels)


@query("prefixed_match", f"""WITH {_SEARCH.replace('FROM docket_cases', 'FROM county_addresses')}, st AS (SELECT s.case_id, min(r.locid) AS locid FROM seek s LEFT JOIN street_rows r ON upper(r.street_name)=s.name AND r.prefix=s.prefix
    AND (r.low_num IS NULL OR r.high_num IS NULL OR CAST(s.stnum AS BIGINT) BETWEEN r.low_num AND r.high_num) WHERE s.prefix<>'' GROUP BY s.case_id)
    SELECT st.case_id, st.locid, CASE WHEN locid IS NOT NULL THEN m.account_id END AS account_id, CASE WHEN locid IS NOT NULL THEN m.matches_found ELSE 0 END AS matches_found FROM st JOIN matched m ON m.case_id=st.case_id""")
def prefixed_match(t):
    """Addresses with a direction: the street by its number range first, then the parcels on it."""
    parsed = with_address_parts(t.county_addresses.select("case_id", "property_address"))
    return P.match_prefixed(parsed.where(F.col("stnum").isNotNull() & (F.length("name") > 0)), t.street_rows, t.parcels)


@query("enrich_todo", """SELECT case_id, case_number, parcel_id, property_address, next_bid_deadline FROM docket_cases c WHERE county_code='910' AND classification='upset_bid'
    AND NOT EXISTS (SELECT 1 FROM enrichments_long e WHERE e.case_id=c.case_id AND e.source='wake_re' AND (ref_id IS NOT NULL OR error IS NOT NULL))""", moments="next_bid_deadline")
def enrich_todo(t):
    return P.enrich_todo(t.docket_cases, t.enrichments_long)


@query("enrich_route", """WITH n AS (SELECT case_id, CASE case_id%13 WHEN 0 THEN substring(case_number,1,10) WHEN 1 THEN concat(substring(case_number,1,10),'-777') ELSE case_number END AS case_number FROM cases),
    s AS (SELECT *, CASE WHEN contains(case_number,'-') THEN split_part(case_number,'-',2) END AS x FROM n),
    r AS (SELECT case_id, case_number, x, CASE x WHEN '910' THEN 'wake_re' WHEN '310' THEN 'durham_re' WHEN '420' THEN 'harnett_re' WHEN '520' THEN 'lee_re' WHEN '670' THEN 'orange_re' WHEN '180' THEN 'chatham_re' END AS source FROM s)
    SELECT case_id, case_number, source, CASE WHEN x IS NULL THEN 'Could not determine county code' WHEN source IS NULL THEN 'Unknown county code: '||x END AS error FROM r""")
def enrich_route(t):
    bare = F.substring("case_number", 1, 10)
    number = F.when(F.col("case_id") % 13 == 0, bare).when(F.col("case_id") % 13 == 1, F.concat(bare, F.lit("-777"))).otherwise(F.col("case_number"))
    return P.route(t.cases.select("case_id", number.alias("case_number")))


_IDS = "ids AS (SELECT lpad(cast(p_partkey%700 AS STRING),10,'0') AS parcel_id, lpad(cast(p_partkey%700 AS STRING),7,'0') AS account_id FROM part WHERE p_partkey%3<>0)"
_ENRICH = f"""{_SEARCH}, {_IDS}, byid AS (SELECT parcel_id, count(*) AS n, min(account_id) AS a FROM ids GROUP BY parcel_id),
    e AS (SELECT c.case_id, c.parcel_id, c.property_address, regexp_full_match(coalesce(c.parcel_id,''),'\\d{{10}}') AS by_id, coalesce(b.n,0) AS n, b.a, s.case_id IS NOT NULL AS can, m.account_id, m.matches_found
      FROM docket_cases c LEFT JOIN byid b ON b.parcel_id=c.parcel_id LEFT JOIN seek s ON s.case_id=c.case_id LEFT JOIN matched m ON m.case_id=c.case_id),
    outcome AS (SELECT case_id, CASE WHEN by_id THEN CASE WHEN n=1 THEN 'success' ELSE 'review' END WHEN property_address<>'' AND can THEN CASE WHEN account_id IS NOT NULL THEN 'success' ELSE 'review' END ELSE 'error' END AS status,
      CASE WHEN by_id THEN 'parcel_id' WHEN property_address<>'' THEN 'address' END AS method, CASE WHEN by_id THEN CASE WHEN n=1 THEN a END WHEN can THEN account_id END AS account_id,
      CASE WHEN by_id THEN n ELSE matches_found END AS matches_found,
      CASE WHEN by_id THEN CASE WHEN n=1 THEN NULL WHEN n=0 THEN 'No matches found' ELSE concat(n,' matches found') END WHEN property_address<>'' AND can THEN CASE WHEN account_id IS NULL THEN concat(matches_found,' matches found for address') END
        WHEN property_address<>'' THEN concat('Could not parse address: ',property_address) ELSE 'No parcel_id or property_address available' END AS message, CASE WHEN by_id THEN parcel_id ELSE property_address END AS search_value FROM e)"""


_SOURCES = "CASE x WHEN '910' THEN 'wake_re' WHEN '310' THEN 'durham_re' WHEN '420' THEN 'harnett_re' WHEN '520' THEN 'lee_re' WHEN '670' THEN 'orange_re' WHEN '180' THEN 'chatham_re' END"
_LINKS = """CASE source WHEN 'wake_re' THEN 'https://services.wake.gov/realestate/Account.asp?id='||account_id WHEN 'durham_re' THEN 'https://taxcama.dconc.gov/camapwa/PropertySummary.aspx?PARCELPK='||account_id
    WHEN 'harnett_re' THEN 'https://cama.harnett.org/itspublicht/AppraisalCard.aspx?prid='||account_id WHEN 'orange_re' THEN 'https://property.spatialest.com/nc/orange/#/property/'||account_id
    WHEN 'chatham_re' THEN 'https://chathamnc.devnetwedge.com/parcel/view/'||account_id||'/2025'
    WHEN 'lee_re' THEN 'https://taxaccess.leecountync.gov/PT/Datalets/Datalet.aspx?mode=&UseSearch=no&pin='||account_id||'&jur=000&taxyr=1998' END"""
_COUNTIES = f"""{_PARSE.replace('FROM docket_cases', 'FROM county_addresses')}, routed AS (SELECT *, {_SOURCES} AS source FROM (SELECT *, CASE WHEN contains(case_number,'-') THEN split_part(case_number,'-',2) END AS x FROM county_addresses)),
    seek AS (SELECT p.case_id, r.source, stnum, upper(name) AS name, coalesce(prefix,'') AS prefix, {_CODES}[lower(city)] AS etj FROM parsed p JOIN routed r ON r.case_id=p.case_id WHERE source IS NOT NULL AND stnum IS NOT NULL AND name<>''),
    cand AS (SELECT s.case_id, p.account_id, p.prefix=s.prefix AS same_prefix, s.etj IS NULL OR p.etj=s.etj AS same_city FROM seek s JOIN county_parcels p ON p.source=s.source AND p.stnum=s.stnum AND upper(p.street_name)=s.name AND (s.prefix='' OR p.prefix=s.prefix)),
    agg AS (SELECT case_id, count(*) AS n, min(account_id) AS only_id, min(account_id) FILTER (same_prefix AND same_city) AS lo, max(account_id) FILTER (same_prefix AND same_city) AS hi FROM cand GROUP BY case_id),
    ids AS (SELECT source, right(lpad(account_id,10,'0'),10) AS parcel_id, account_id FROM county_parcels WHERE CAST(account_id AS BIGINT)%700=CAST(account_id AS BIGINT)),
    byid AS (SELECT source, parcel_id, count(*) AS n, min(account_id) AS a FROM ids GROUP BY source, parcel_id),
    e AS (SELECT r.case_id, r.source, r.x, r.parcel_id, r.property_address, r.source='wake_re' AND regexp_full_match(coalesce(r.parcel_id,''),'\\d{{10}}') AS by_id, coalesce(b.n,0) AS idn, b.a, s.case_id IS NOT NULL AS can, coalesce(g.n,0) AS n, g.only_id, g.lo, g.hi
      FROM routed r LEFT JOIN byid b ON b.source=r.source AND b.parcel_id=r.parcel_id LEFT JOIN seek s ON s.case_id=r.case_id LEFT JOIN agg g ON g.case_id=r.case_id),
    m AS (SELECT *, CASE WHEN source IS NULL THEN NULL WHEN by_id THEN CASE WHEN idn=1 THEN a END WHEN can AND source='wake_re' AND lo=hi THEN lo WHEN can AND n=1 THEN only_id END AS account_id,
      CASE WHEN source IS NULL THEN NULL WHEN by_id THEN 'parcel_id' WHEN property_address<>'' THEN 'address' END AS method FROM e),
    outcome AS (SELECT case_id, source, CASE WHEN account_id IS NOT NULL THEN 'success' WHEN by_id OR (method='address' AND can) THEN 'review' ELSE 'error' END AS status, method, account_id, {_LINKS} AS url,
      CASE WHEN method='parcel_id' THEN idn WHEN method='address' AND can THEN n END AS matches_found,
      CASE WHEN x IS NULL THEN 'Could not determine county code' WHEN source IS NULL THEN 'Unknown county code: '||x WHEN account_id IS NOT NULL THEN NULL
        WHEN by_id THEN CASE WHEN idn=0 THEN 'No matches found' ELSE concat(idn,' matches found') END
        WHEN method='address' AND can THEN CASE WHEN source='wake_re' THEN concat(n,' matches found for address') WHEN n=0 THEN 'No matches found' ELSE concat(n,' matches found') END
        WHEN method='address' THEN concat('Could not parse address: ',property_address) WHEN source='wake_re' THEN 'No parcel_id or property_address available' ELSE 'No property_address available' END AS message,
      CASE WHEN source IS NULL THEN NULL WHEN by_id THEN parcel_id ELSE property_address END AS search_value FROM m)"""


def _counties(t):
    number = F.col("account_id").cast("bigint")
    ids = t.county_parcels.where(number % 700 == number).select("source", F.lpad("account_id", 10, "0").alias("parcel_id"), "account_id")
    return P.look_up_all(t.county_addresses, t.county_parcels, ids, AS_OF)


@query("county_status", f"WITH {_COUNTIES} SELECT * FROM outcome")
def county_status(t):
    """Every case looked up at its own county, by that county's policy."""
    return _counties(t).select("case_id", "source", "status", "method", "account_id", "url", "matches_found", "message", "search_value")


@query("county_reviews", f"""WITH {_COUNTIES} SELECT o.case_id, source AS enrichment_type, method AS search_method, search_value, matches_found, CASE WHEN method='address' THEN p.name END AS street,
    TIMESTAMP '1998-06-15 12:00:00' AS created_at, CASE WHEN o.case_id%2=0 THEN TIMESTAMP '1998-06-16 09:00:00' END AS resolved_at, CASE WHEN o.case_id%2=0 THEN 'by hand' END AS resolution_notes
    FROM outcome o LEFT JOIN parsed p ON p.case_id=o.case_id WHERE status='review'""", moments="created_at resolved_at")
def county_reviews(t):
    """The review log as stored, with its raw results as VARIANT, written and read back; half of it resolved."""
    path = shared_folder(t.spark, "reviews")
    P.with_raw_results(P.review_log(_counties(t)), AS_OF).write.parquet(path)
    log = t.spark.read.parquet(path)
    answers = t.cases.where("case_id % 2 = 0").select("case_id", F.lit(None).cast("string").alias("account_id"), F.lit("by hand").alias("resolution_notes"))
    done, _ = P.resolve_reviews(log, answers, "1998-06-16 09:00:00")
    raw = lambda path, kind: F.try_variant_get("raw_results", path, kind)
    return done.select("case_id", "enrichment_type", "search_method", raw("$.value", "string").alias("search_value"), raw("$.matches", "bigint").alias("matches_found"),
                       raw("$.parsed.name", "string").alias("street"), "created_at", "resolved_at", "resolution_notes")


@query("search_results", """SELECT source, stnum, street_name AS name, 0 AS chunk, count(*) AS n, min(account_id) AS first_account, max(account_id) AS last_account FROM county_parcels GROUP BY source, stnum, street_name""")
def search_results(t):
    """What each search of a county brings up, as VARIANT arrays, read back item by item."""
    path = shared_folder(t.spark, "search-results")
    P.search_results(t.county_parcels).write.parquet(path)
    items = variant_objects(t.spark.read.parquet(path), "results").select("source", "stnum", "name", "chunk", F.try_variant_get("results", "$.account_id", "string").alias("account_id"))
    return items.groupBy("source", "stnum", "name", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("account_id").alias("first_account"), F.max("account_id").alias("last_account"))


@query("raw_shapes", f"""WITH {_COUNTIES}, r AS (SELECT o.case_id, o.case_id%6 AS shape, search_value, matches_found FROM outcome o WHERE status='review')
    SELECT case_id, CASE shape WHEN 2 THEN 'broken' WHEN 3 THEN 'absent' WHEN 4 THEN 'array' WHEN 5 THEN 'value' ELSE 'object' END AS shape,
      CASE WHEN shape IN (0,1,4) THEN matches_found END AS matches_found, CASE WHEN shape IN (0,1,4) THEN search_value END AS search_value FROM r""")
def raw_shapes(t):
    """Raw results as older runs left them: an object, one encoded twice, cut off, missing, in an array beside junk, a bare number."""
    log = P.with_raw_results(P.review_log(_counties(t)), AS_OF).select("case_id", F.to_json("raw_results").alias("j"))
    shape = F.col("case_id") % 6
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.col("j"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = (F.when(shape == 1, quoted).when(shape == 2, F.substr("j", F.lit(1), F.length("j") - 1)).when(shape == 3, None)
            .when(shape == 4, F.concat(F.lit('["junk",'), "j", F.lit(",7]"))).when(shape == 5, "12").otherwise(F.col("j")))
    read = log.select("case_id", text.alias("text")).withColumn("v", as_variant(F.col("text"))).withColumn("shape", json_shape(F.col("text"), F.col("v")))
    return variant_objects(read, "v").select("case_id", "shape", F.try_variant_get("v", "$.matches", "bigint").alias("matches_found"),
                                             F.try_variant_get("v", "$.value", "string").alias("search_value"))


def _outcomes(t):
    ids = t.part.where("p_partkey % 3 <> 0").select(F.lpad((F.col("p_partkey") % 700).cast("string"), 10, "0").alias("parcel_id"),
                                                    F.lpad((F.col("p_partkey") % 700).cast("string"), 7, "0").alias("account_id"))
    return P.enrich(t.docket_cases, t.parcels, ids)


@query("enrich_status", f"WITH {_ENRICH} SELECT case_id, status, method, account_id, 'https://services.wake.gov/realestate/Account.asp?id='||account_id AS url, matches_found, message, search_value FROM outcome")
def enrich_status(t):
    return _outcomes(t)


@query("enrich_review", f"WITH {_ENRICH} SELECT case_id, 'wake_re' AS enrichment_type, method AS search_method, search_value, matches_found FROM outcome WHERE status='review'")
def enrich_review(t):
    return P.review_log(_outcomes(t), "wake_re")


def _open_log(t):
    return P.review_log(_outcomes(t), "wake_re").withColumns({
        "created_at": F.date_add(F.lit("1998-01-01").cast("date"), (F.col("case_id") % 150).cast("int")),
        "resolved_at": F.when(F.col("case_id") % 4 == 0, as_moment("1998-02-02 00:00:00"))})


@query("review_resolve", f"""WITH {_ENRICH}, l AS (SELECT case_id FROM outcome WHERE status='review') SELECT case_id, 'wake_re' AS source, lpad(cast(case_id AS STRING),7,'0') AS ref_id FROM l WHERE case_id%4<>0 AND case_id%3=0 AND case_id%2=1""")
def review_resolve(t):
    answers = t.cases.where("case_id % 3 = 0").select("case_id", F.when(F.col("case_id") % 2 == 1, F.lpad(F.col("case_id").cast("string"), 7, "0")).alias("account_id"))
    return P.resolve_reviews(_open_log(t), answers, AS_OF)[1].select("case_id", "source", "ref_id")


@query("review_queue", f"""WITH {_ENRICH}, l AS (SELECT *, CAST(DATE '1998-01-01' + CAST(case_id%150 AS INTEGER) AS DATE) AS created_at FROM outcome WHERE status='review' AND case_id%4<>0 ORDER BY created_at DESC, case_id LIMIT 50)
    SELECT l.case_id, c.case_number, l.matches_found, l.created_at FROM l JOIN cases c ON c.case_id=l.case_id""", days="created_at")
def review_queue(t):
    from docketry.plans.serving import review_queue as queue

    return queue(_open_log(t), t.cases).select("case_id", "case_number", "matches_found", "created_at")


@query("enrich_upsert", """WITH new AS (SELECT case_id, 'wake_re' AS source, concat('N',cast(case_id AS STRING)) AS ref_id, NULL AS error FROM cases WHERE case_id%4=0)
    SELECT e.case_id, e.source, e.ref_id, e.error FROM enrichments_long e WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.case_id=e.case_id AND n.source=e.source) UNION ALL SELECT * FROM new""")
def enrich_upsert(t):
    new = t.cases.where("case_id % 4 = 0").select("case_id", F.lit("wake_re").alias("source"), F.concat(F.lit("N"), F.col("case_id").cast("string")).alias("ref_id"), F.lit(None).cast("string").alias("error"))
    older = new.withColumn("ref_id", F.lit("older")).withColumn("seq", F.lit(1))
    return P.upsert_enrichments(t.enrichments_long, new.withColumn("seq", F.lit(2)).unionByName(older), "seq")


@query("valuation_join", """WITH d AS (SELECT * FROM docket_cases c WHERE NOT EXISTS (SELECT 1 FROM enrichments_long e WHERE e.case_id=c.case_id AND e.ref_id IS NOT NULL))
    SELECT d.case_id, v.estimate, CASE WHEN nullif(d.property_address,'') IS NULL THEN 'No property_address available' WHEN v.estimate IS NULL THEN 'No value found' END AS error FROM d LEFT JOIN valuations v ON v.property_address=d.property_address""", money="estimate")
def valuation_join(t):
    return P.join_valuations(t.docket_cases, t.valuations, t.enrichments_long)


@query("valuation_links", """WITH done AS (SELECT case_id FROM cases WHERE case_id%3=0), d AS (SELECT * FROM docket_cases c WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.case_id=c.case_id))
    SELECT d.case_id, v.url, v.estimate, v.price, CASE WHEN nullif(d.property_address,'') IS NULL THEN 'No property_address available' WHEN v.url IS NULL THEN 'No value found' END AS error
    FROM d LEFT JOIN listings v ON v.property_address=d.property_address""", money="estimate price")
def valuation_links(t):
    """Link, estimate and asking price of the cases that have no link yet."""
    linked = t.cases.select("case_id", F.when(F.col("case_id") % 3 == 0, "https://www.zillow.com/known").when(F.col("case_id") % 3 == 1, "").alias("url"))
    return P.join_valuations(t.docket_cases, t.listings, linked)


@query("deed_todo", """SELECT a.case_id, c.case_number, CASE county_code WHEN '910' THEN format('https://rodrecords.wake.gov/web/web/integration/search?field_BookPageID_DOT_Volume={}&field_BookPageID_DOT_Page={}', deed_book, deed_page)
    WHEN '420' THEN format('https://us6.courthousecomputersystems.com/HarnettNC/Image/ShowDocImage?booktype=Deed&tif2pdf=true&BookNum={}&PageNum={}', deed_book, deed_page)
    WHEN '670' THEN format('https://rod.orangecountync.gov/orangenc/Image/ShowDocImage?booktype=Deed&tif2pdf=true&BookNum={}&PageNum={}', deed_book, deed_page)
    WHEN '310' THEN 'https://rodweb.dconc.gov/web/search/DOCSEARCH5S1' WHEN '520' THEN 'https://www.leencrod.org/Opening.asp' ELSE 'https://www.chathamncrod.org/' END AS deed_url
    FROM analyses a JOIN cases c ON c.case_id=a.case_id WHERE deed_book IS NOT NULL AND deed_page IS NOT NULL AND status='completed' AND a.case_id%6<>0""")
def deed_todo(t):
    return P.deed_todo(t.analyses, t.cases, t.cases.where("case_id % 6 = 0"))
