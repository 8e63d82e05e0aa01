"""Registered queries: scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions import addresses as A
from docketry.functions import counties as C
from docketry.functions import dates as D
from docketry.functions import jsontext as J
from docketry.functions import links as L
from docketry.functions import money as M
from docketry.functions import predicates as P
from docketry.functions import text as T
from docketry.operators import calendar as CAL
from docketry.plans.registry import SQL_CALENDAR, query, sql_any
from docketry.sources.sample_views import AS_OF, AS_OF_EVENING

# --- amounts ---------------------------------------------------------------------------------------------------

_RAW = """raw AS (SELECT case_id, CASE case_id%6 WHEN 0 THEN concat('$ ',cast(case_id AS STRING),',00.50')
    WHEN 1 THEN concat('$1,',lpad(cast(case_id%1000 AS STRING),3,'0'),'.25') WHEN 2 THEN 'n/a' WHEN 3 THEN concat(cast(case_id%900+100 AS STRING),',00.00')
    WHEN 4 THEN concat(cast(case_id AS STRING),' .75') ELSE cast(case_id AS STRING) END AS raw FROM cases)"""


def _raw(t):
    return t.sql(f"SELECT * FROM ({_RAW[len('raw AS ('):-1]}) raw")


@query("clean_amount", f"""WITH {_RAW}, bare AS (SELECT case_id, raw, replace(replace(raw,'$',''),' ','') AS b FROM raw)
    SELECT case_id, raw, TRY_CAST(replace(CASE WHEN regexp_matches(b,'^\\d{{1,3}},\\d{{2}}\\.\\d{{2}}$')
      THEN concat(split_part(b,'.',1),'0.',split_part(b,'.',2)) ELSE b END, ',','') AS DECIMAL(18,2)) AS amount FROM bare""", money="amount")
def clean_amount(t):
    return _raw(t).select("case_id", "raw", M.clean_amount(F.col("raw")).alias("amount"))


@query("amount_strict", f"""WITH {_RAW}, bare AS (SELECT case_id, regexp_replace(raw,'[^0-9.]','','g') AS b FROM raw),
    num AS (SELECT *, TRY_CAST(b AS DECIMAL(18,2)) AS v FROM bare)
    SELECT case_id, CASE WHEN contains(b,'.') AND v BETWEEN 100 AND 100000000 THEN v END AS strict_amount,
      CASE WHEN v BETWEEN 100 AND 100000000 THEN v END AS loose_amount FROM num""", money="strict_amount loose_amount")
def amount_strict(t):
    return _raw(t).select("case_id", M.strict_amount(F.col("raw")).alias("strict_amount"),
                          M.loose_amount(F.col("raw")).alias("loose_amount"))


@query("min_next_bid", """SELECT case_id, CAST(round_even(current_bid_amount*CAST(1.05 AS DECIMAL(3,2)),2) AS DECIMAL(12,2)) AS min_next_bid
    FROM cases""", money="min_next_bid")
def min_next_bid(t):
    return t.cases.select("case_id", M.min_next_bid(F.col("current_bid_amount")).alias("min_next_bid"))


@query("bid_from_min", """SELECT case_id, CASE WHEN current_bid_amount IS NULL THEN NULL ELSE
    CAST((CAST(current_bid_amount*100 AS BIGINT)*40+21)//42 AS DOUBLE)/100 END AS bid FROM cases""", money="bid")
def bid_from_min(t):
    return t.cases.select("case_id", M.bid_from_min(F.col("current_bid_amount")).alias("bid"))


@query("est_profit", """SELECT case_id, CASE WHEN nullif(estimated_sale_price,0) IS NOT NULL AND nullif(our_max_bid,0) IS NOT NULL
    THEN estimated_sale_price-our_max_bid-coalesce(estimated_rehab_cost,0) END AS profit FROM docket_cases""", money="profit")
def est_profit(t):
    return t.docket_cases.select("case_id", M.est_profit(F.col("estimated_sale_price"), F.col("our_max_bid"),
                                                         F.col("estimated_rehab_cost")).alias("profit"))


# --- dates -----------------------------------------------------------------------------------------------------

_DATE_TEXT = """date_text AS (SELECT event_id, CASE event_id%6 WHEN 0 THEN concat(cast(month(event_date) AS STRING),'/',cast(day(event_date) AS STRING),'/',cast(year(event_date) AS STRING))
    WHEN 1 THEN concat('March ',cast(day(event_date) AS STRING),', ',cast(year(event_date) AS STRING)) WHEN 2 THEN concat('JUNE ',cast(day(event_date) AS STRING),' ',cast(year(event_date) AS STRING))
    WHEN 3 THEN concat('Jan ',cast(day(event_date) AS STRING),', ',cast(year(event_date) AS STRING)) WHEN 4 THEN concat('Feb ',cast(28+event_id%4 AS STRING),' 1997') ELSE '13/45/1998' END AS raw
    FROM case_events WHERE event_date IS NOT NULL)"""


@query("parse_dates", f"""WITH {_DATE_TEXT} SELECT event_id, raw,
    CAST(try_strptime(raw, ['%m/%d/%Y','%B %d, %Y','%B %d %Y','%b %d, %Y','%b %d %Y']) AS DATE) AS deadline_form,
    CAST(try_strptime(raw, ['%m/%d/%Y','%B %d, %Y','%B %d %Y']) AS DATE) AS sale_form FROM date_text""", days="deadline_form sale_form")
def parse_dates(t):
    raw = t.sql(f"SELECT * FROM ({_DATE_TEXT[len('date_text AS ('):-1]}) d")
    return raw.select("event_id", "raw", D.deadline_day(F.col("raw")).alias("deadline_form"),
                      D.sale_day(F.col("raw")).alias("sale_form"))


@query("court_holidays", f"""WITH {SQL_CALENDAR}, filed AS (SELECT file_date, count(*) AS n FROM cases GROUP BY file_date)
    SELECT o.y AS year, o.d AS holiday, o.day AS observed, coalesce(f.n, 0) AS filings FROM observed o
    LEFT JOIN filed f ON f.file_date=o.day WHERE o.y IN (SELECT DISTINCT year(file_date) FROM cases)""", days="holiday observed")
def court_holidays(t):
    filed = t.cases.groupBy("file_date").agg(F.count(F.lit(1)).alias("n"))
    years = t.cases.select(F.year("file_date").alias("year")).distinct()
    days = CAL.court_holidays(years)
    return days.join(filed, days.observed == filed.file_date, "left").select(
        "year", "holiday", "observed", F.coalesce("n", F.lit(0)).alias("filings"))


@query("next_business_day", f"""WITH {SQL_CALENDAR}, d AS (SELECT DISTINCT event_date FROM case_events WHERE event_date IS NOT NULL)
    SELECT event_date, EXISTS (SELECT 1 FROM business b WHERE b.day=event_date) AS is_business,
      (SELECT min(day) FROM business b WHERE b.day >= event_date AND b.day <= event_date + 7) AS next_business_day FROM d""",
       days="event_date next_business_day")
def next_business_day(t):
    return CAL.with_business_day(t.case_events.select("event_date").where("event_date IS NOT NULL").distinct(),
                                 F.col("event_date"))


@query("bid_deadline", f"""WITH {SQL_CALENDAR} SELECT event_id, event_date, deadline FROM case_events
    LEFT JOIN deadlines ON deadlines.day=event_date""", days="event_date deadline")
def bid_deadline(t):
    return CAL.with_deadline(t.case_events.select("event_id", "event_date"), F.col("event_date"), "deadline")


_SPANS = "spans AS (SELECT county_code, min(file_date) AS first_day, max(file_date) AS last_day FROM cases GROUP BY county_code)"


@query("date_chunks", f"""WITH {_SPANS}, days AS (SELECT county_code, first_day, last_day, CAST(d AS DATE) AS d FROM spans, range(first_day, last_day + 1, INTERVAL 1 DAY) r(d)),
    keyed AS (SELECT *, d AS k, 'daily' AS size FROM days
      UNION ALL SELECT *, first_day + CAST((d - first_day)//7*7 AS INTEGER), 'weekly' FROM days
      UNION ALL SELECT *, CAST(date_trunc('month', d) AS DATE), 'monthly' FROM days UNION ALL SELECT *, CAST(date_trunc('quarter', d) AS DATE), 'quarterly' FROM days
      UNION ALL SELECT *, CAST(date_trunc('year', d) AS DATE), 'yearly' FROM days)
    SELECT county_code, size, min(d) AS chunk_start, max(d) AS chunk_end FROM keyed GROUP BY county_code, size, k""", days="chunk_start chunk_end")
def date_chunks(t):
    spans = t.cases.groupBy("county_code").agg(F.min("file_date").alias("f"), F.max("file_date").alias("l"))
    sizes = ["daily", "weekly", "monthly", "quarterly", "yearly"]
    chunked = F.array(*[F.struct(F.lit(s).alias("size"), D.period_chunks(F.col("f"), F.col("l"), s).alias("c")) for s in sizes])
    return spans.select("county_code", F.inline(chunked)).select("county_code", "size", F.inline("c"))


@query("spine_cross", f"""WITH {_SPANS}, whole AS (SELECT min(first_day) AS f, max(last_day) AS l FROM spans),
    months AS (SELECT CAST(m AS DATE) AS m, f, l FROM whole, range(date_trunc('month', f), CAST(l AS TIMESTAMP) + INTERVAL 1 SECOND, INTERVAL 1 MONTH) r(m)),
    spine AS (SELECT greatest(m, f) AS chunk_start, least(last_day(m), l) AS chunk_end, c.county_code FROM months, (SELECT DISTINCT county_code FROM spans) c)
    SELECT s.*, count(k.case_id) AS filings FROM spine s LEFT JOIN cases k ON k.county_code=s.county_code AND k.file_date BETWEEN chunk_start AND chunk_end
    GROUP BY ALL""", days="chunk_start chunk_end")
def spine_cross(t):
    span = t.cases.agg(F.min("file_date").alias("f"), F.max("file_date").alias("l"))
    spine = span.select(F.inline(D.period_chunks(F.col("f"), F.col("l"), "monthly"))).select(
        "*", F.explode(F.array(*[F.lit(c) for c in R.COUNTY_BY_CODE])).alias("county_code"))
    filed = t.cases.groupBy("county_code", F.trunc("file_date", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return spine.withColumn("month", F.trunc("chunk_start", "MM")).join(filed, ["county_code", "month"], "left").select(
        "chunk_start", "chunk_end", "county_code", F.coalesce("n", F.lit(0)).alias("filings"))


@query("lookback_date", """SELECT DISTINCT file_date, CASE WHEN isodow(file_date)=1 THEN file_date-3 ELSE file_date-1 END AS target FROM cases""",
       days="file_date target")
def lookback_date(t):
    return t.cases.select("file_date", D.lookback_day(F.col("file_date")).alias("target")).distinct()


def _urgency_sql(now: str) -> str:
    return f"""CASE WHEN next_bid_deadline IS NULL THEN 'normal' WHEN TIMESTAMP '{now}' >= next_bid_deadline + INTERVAL 17 HOUR THEN 'expired'
      WHEN CAST(next_bid_deadline AS DATE) - DATE '1998-06-15' <= 2 THEN 'critical' WHEN CAST(next_bid_deadline AS DATE) - DATE '1998-06-15' <= 5 THEN 'warning' ELSE 'normal' END"""


@query("urgency", f"""SELECT case_id, CAST(next_bid_deadline AS DATE) - DATE '1998-06-15' AS days_remaining,
    {_urgency_sql(AS_OF)} AS at_noon, {_urgency_sql(AS_OF_EVENING)} AS at_evening FROM docket_cases""")
def urgency(t):
    d = F.col("next_bid_deadline")
    return t.docket_cases.select("case_id", D.days_left(d, AS_OF).alias("days_remaining"),
                                 D.urgency(d, AS_OF).alias("at_noon"), D.urgency(d, AS_OF_EVENING).alias("at_evening"))


@query("days_label", f"""WITH u AS (SELECT *, CAST(next_bid_deadline AS DATE) - DATE '1998-06-15' AS n, {_urgency_sql(AS_OF_EVENING)} AS u FROM docket_cases)
    SELECT case_id, CASE WHEN n IS NULL THEN 'No deadline' WHEN u='expired' THEN 'EXPIRED' WHEN n=0 THEN 'TODAY' WHEN n=1 THEN '1 day'
      ELSE concat(n,' days') END AS label, nullif(our_max_bid,0) AS shown_max_bid FROM u""", money="shown_max_bid")
def days_label(t):
    d = F.col("next_bid_deadline")
    return t.docket_cases.select(
        "case_id", D.days_label(D.days_left(d, AS_OF), D.urgency(d, AS_OF_EVENING)).alias("label"),
        M.present(F.col("our_max_bid")).alias("shown_max_bid"))


# --- counties, addresses, links -----------------------------------------------------------------------------------


@query("county_lookup", """WITH n AS (SELECT DISTINCT county_code, county_name FROM docket_cases UNION SELECT cast(n_nationkey AS STRING), n_name FROM nation)
    SELECT county_code, county_name, CASE county_code WHEN '180' THEN 'Chatham' WHEN '310' THEN 'Durham' WHEN '420' THEN 'Harnett' WHEN '520' THEN 'Lee'
      WHEN '670' THEN 'Orange' WHEN '910' THEN 'Wake' END AS name_of_code,
      CASE lower(county_name) WHEN 'chatham' THEN '180' WHEN 'durham' THEN '310' WHEN 'harnett' THEN '420' WHEN 'lee' THEN '520' WHEN 'orange' THEN '670'
      WHEN 'wake' THEN '910' END AS code_of_name, lower(county_name) IN ('chatham','durham','harnett','lee','orange','wake') AS is_county FROM n""")
def county_lookup(t):
    named = t.docket_cases.select("county_code", "county_name").union(
        t.nation.select(F.col("n_nationkey").cast("string"), "n_name")).distinct()
    return named.select("county_code", "county_name", C.county_name(F.col("county_code")).alias("name_of_code"),
                        C.county_code(F.col("county_name")).alias("code_of_name"), C.is_county(F.col("county_name")).alias("is_county"))


_PLACES = """places AS (SELECT case_id, CASE case_id%3 WHEN 0 THEN case_number WHEN 1 THEN substring(case_number,1,10) ELSE concat(substring(case_number,1,10),'-999') END AS case_number,
    CASE WHEN case_id%5=0 THEN NULL WHEN case_id%5=1 THEN 'Elsewhere' ELSE concat(county_name,' County District') END AS location FROM docket_cases)"""


@query("case_county", f"""WITH {_PLACES}, s AS (SELECT *, CASE WHEN contains(case_number,'-') THEN split_part(case_number,'-',2) END AS x FROM places)
    SELECT case_id, CASE WHEN x IN ('180','310','420','520','670','910') THEN x WHEN contains(lower(location),'chatham') THEN '180'
      WHEN contains(lower(location),'durham') THEN '310' WHEN contains(lower(location),'harnett') THEN '420' WHEN contains(lower(location),'lee') THEN '520'
      WHEN contains(lower(location),'orange') THEN '670' WHEN contains(lower(location),'wake') THEN '910' END AS county_code FROM s""")
def case_county(t):
    places = t.sql(f"SELECT * FROM ({_PLACES[len('places AS ('):-1]}) p")
    return places.select("case_id", C.case_county(F.col("case_number"), F.col("location")).alias("county_code"))


@query("year_prefix", "SELECT county_code, count(*) AS cases FROM cases WHERE case_number LIKE '97SP%' GROUP BY county_code")
def year_prefix(t):
    return t.cases.where(C.filed_in_year(F.col("case_number"), 1997)).groupBy("county_code").agg(F.count(F.lit(1)).alias("cases"))


@query("parcel_split", """SELECT case_id, CASE WHEN regexp_full_match(parcel_id,'\\d{10}') THEN substring(parcel_id,1,4) END AS map,
    CASE WHEN regexp_full_match(parcel_id,'\\d{10}') THEN substring(parcel_id,5,2) END AS block,
    CASE WHEN regexp_full_match(parcel_id,'\\d{10}') THEN substring(parcel_id,7,4) END AS lot FROM docket_cases""")
def parcel_split(t):
    p = A.parcel_split(F.col("parcel_id"))
    return t.docket_cases.select("case_id", p["map"].alias("map"), p["block"].alias("block"), p["lot"].alias("lot"))


_SQL_STREET = "upper(trim(regexp_replace(trim({}), '" + A.TRAILING_TYPES + "', '')))"
_SQL_STREETS = """streets AS (SELECT case_id, concat(CASE case_id%4 WHEN 0 THEN 'S. Salem' WHEN 1 THEN 'North Hills' WHEN 2 THEN 'NE. Old Mill' ELSE 'W Park Place' END,
    CASE case_id%7 WHEN 0 THEN ' Street' WHEN 1 THEN ' rd.' WHEN 2 THEN '' WHEN 3 THEN ' Way' WHEN 4 THEN ' LN' WHEN 5 THEN ' Lane Road' ELSE ' Dr Chapel Hill' END) AS street FROM cases)"""


def _streets(t):
    return t.sql(f"SELECT * FROM ({_SQL_STREETS[len('streets AS ('):-1]}) s")


@query("street_norm", f"WITH {_SQL_STREETS} SELECT case_id, street, {_SQL_STREET.format('street')} AS street_norm FROM streets")
def street_norm(t):
    return _streets(t).select("case_id", "street", A.street_norm(F.col("street")).alias("street_norm"))


_DIRECTIONS = "MAP {" + ",".join(f"'{k}':'{v}'" for k, v in R.DIRECTION_PREFIXES.items()) + "}"


@query("street_prefix", f"WITH {_SQL_STREETS} SELECT case_id, street, {_DIRECTIONS}[split_part(street,' ',1)] AS prefix FROM streets")
def street_prefix(t):
    return _streets(t).select("case_id", "street", A.street_prefix(F.col("street")).alias("prefix"))


@query("street_clean", f"""WITH {_SQL_STREETS}, u AS (SELECT case_id, street, regexp_replace(upper(street), ' {T.any_of(R.CLEANUP_CITIES)}$', '') AS b FROM streets),
    w AS (SELECT *, string_split(b,' ') AS words FROM u),
    k AS (SELECT *, CASE WHEN list_contains([{','.join(repr(x) for x in R.CLEANUP_STREET_TYPES)}], words[-1]) THEN words[:-2] ELSE words END AS kept FROM w)
    SELECT case_id, street, array_to_string(list_transform(kept, lambda x: concat(upper(x[1]), lower(x[2:]))), ' ') AS street_clean FROM k""")
def street_clean(t):
    return _streets(t).select("case_id", "street", A.street_clean(F.col("street")).alias("street_clean"))


_PARSE = f"""p1 AS (SELECT case_id, property_address, list_transform(string_split(nullif(property_address,''),','), lambda x: trim(x)) AS p FROM docket_cases),
    p2 AS (SELECT *, nullif(regexp_extract(p[1],'^(\\d+)\\s+.+$',1),'') AS stnum FROM p1),
    p3 AS (SELECT *, CASE WHEN stnum IS NOT NULL THEN regexp_extract(p[1],'^\\d+\\s+(.+)$',1) ELSE p[1] END AS s FROM p2),
    p4 AS (SELECT *, {_DIRECTIONS}[split_part(s,' ',1)] AS prefix FROM p3),
    p5 AS (SELECT *, {_SQL_STREET.format("CASE WHEN prefix IS NOT NULL THEN regexp_replace(s,'^\\S+\\s*','') ELSE s END")} AS n FROM p4),
    p6 AS (SELECT *, CASE WHEN regexp_full_match(p[2],'[A-Za-z]{{2}}') THEN list_filter([{','.join(repr(c) for c in R.KNOWN_CITIES)}], lambda c: ends_with(n, upper(c)))[1] END AS m FROM p5),
    parsed AS (SELECT case_id, property_address, stnum, prefix,
      CASE WHEN m IS NOT NULL THEN {_SQL_STREET.format("substring(n,1,length(n)-length(m))")} ELSE n END AS name, coalesce(m, p[2]) AS city,
      CASE WHEN regexp_full_match(p[3],'[A-Z]{{2}}\\s+\\d{{5}}(-\\d{{4}})?') THEN substring(p[3],1,2) WHEN regexp_full_match(p[3],'[A-Za-z]{{2}}') THEN upper(p[3])
        WHEN m IS NOT NULL THEN upper(p[2]) END AS state, nullif(regexp_extract(p[3],'^[A-Z]{{2}}\\s+(\\d{{5}}(?:-\\d{{4}})?)$',1),'') AS zipcode FROM p6)"""


@query("parse_address", f"WITH {_PARSE} SELECT * FROM parsed")
def parse_address(t):
    return A.with_address_parts(t.docket_cases.select("case_id", "property_address"))


@query("property_urls", f"""WITH {_PARSE}, j AS (SELECT parsed.*, c.parcel_id, e.source, e.ref_id FROM parsed JOIN docket_cases c ON c.case_id=parsed.case_id
      LEFT JOIN enrichments_long e ON e.case_id=c.case_id)
    SELECT case_id, CASE WHEN regexp_full_match(parcel_id,'\\d{{10}}') THEN format('https://services.wake.gov/realestate/PinList.asp?map={{}}&sheet=&block={{}}&lot={{}}&spg=', substring(parcel_id,1,4), substring(parcel_id,5,2), substring(parcel_id,7,4)) END AS parcel_url,
      CASE WHEN stnum IS NOT NULL THEN format('https://services.wake.gov/realestate/ValidateAddress.asp?stnum={{}}&stname={{}}&locidList=&spg=', stnum, replace(url_encode(lower(name)),'%20','+')) END AS check_url,
      CASE WHEN stnum IS NOT NULL AND prefix IS NOT NULL THEN format('https://services.wake.gov/realestate/AddressSearch.asp?stnum={{}}&stname={{}}&locidList=&spg=', stnum, replace(url_encode(lower(name)),'%20','+')) END AS search_url,
      CASE WHEN ref_id IS NULL THEN NULL ELSE CASE source WHEN 'wake_re' THEN 'https://services.wake.gov/realestate/Account.asp?id='||ref_id WHEN 'durham_re' THEN 'https://taxcama.dconc.gov/camapwa/PropertySummary.aspx?PARCELPK='||ref_id
        WHEN 'harnett_re' THEN 'https://cama.harnett.org/itspublicht/AppraisalCard.aspx?prid='||ref_id WHEN 'orange_re' THEN 'https://property.spatialest.com/nc/orange/#/property/'||ref_id
        WHEN 'chatham_re' THEN 'https://chathamnc.devnetwedge.com/parcel/view/'||ref_id||'/2025' WHEN 'lee_re' THEN 'https://taxaccess.leecountync.gov/PT/Datalets/Datalet.aspx?mode=&UseSearch=no&pin='||ref_id||'&jur=000&taxyr=1998' END END AS property_url FROM j""")
def property_urls(t):
    parts = A.with_address_parts(t.docket_cases.select("case_id", "property_address", "parcel_id"))
    j = parts.join(t.enrichments_long, "case_id", "left")
    return j.select(
        "case_id", L.parcel_list_url(F.col("parcel_id")).alias("parcel_url"),
        L.address_check_url(F.col("stnum"), F.col("name")).alias("check_url"),
        F.when(F.col("prefix").isNotNull(), L.address_search_url(F.col("stnum"), F.col("name"))).alias("search_url"),
        L.property_url(F.col("source"), F.col("ref_id"), AS_OF).alias("property_url"))


@query("deed_urls", """SELECT a.case_id, CASE WHEN deed_book IS NULL OR deed_page IS NULL THEN NULL ELSE CASE split_part(case_number,'-',2)
      WHEN '910' THEN format('https://rodrecords.wake.gov/web/web/integration/search?field_BookPageID_DOT_Volume={}&field_BookPageID_DOT_Page={}', deed_book, deed_page)
      WHEN '420' THEN format('https://us6.courthousecomputersystems.com/HarnettNC/Image/ShowDocImage?booktype=Deed&tif2pdf=true&BookNum={}&PageNum={}', deed_book, deed_page)
      WHEN '670' THEN format('https://rod.orangecountync.gov/orangenc/Image/ShowDocImage?booktype=Deed&tif2pdf=true&BookNum={}&PageNum={}', deed_book, deed_page)
      WHEN '310' THEN 'https://rodweb.dconc.gov/web/search/DOCSEARCH5S1' WHEN '520' THEN 'https://www.leencrod.org/Opening.asp' WHEN '180' THEN 'https://www.chathamncrod.org/' END END AS deed_url
    FROM analyses a JOIN cases c ON c.case_id=a.case_id""")
def deed_urls(t):
    j = t.analyses.join(t.cases.select("case_id", "case_number"), "case_id")
    return j.select("case_id", L.deed_url(F.col("case_number"), F.col("deed_book"), F.col("deed_page")).alias("deed_url"))


_COMPONENT = "replace(replace(replace(replace(replace(url_encode(property_address),'%21','!'),'%27',''''),'%28','('),'%29',')'),'%2A','*')"


@query("map_urls", f"""SELECT case_id, 'https://www.zillow.com/homes/'||replace({_COMPONENT},'%20','+')||'_rb/' AS listing_url,
    'https://www.google.com/maps/search/?api=1&query='||{_COMPONENT} AS map_url FROM docket_cases""")
def map_urls(t):
    a = F.col("property_address")
    return t.docket_cases.select("case_id", L.listing_url(a).alias("listing_url"), L.map_url(a).alias("map_url"))


_URL_TEXT = """link_text AS (SELECT case_id, CASE case_id%6 WHEN 0 THEN concat('https://x.example.org/s.aspx?PARCELPK=',cast(case_id AS STRING),'&y=1')
    WHEN 1 THEN concat('https://x.example.org/c.aspx?prid=',cast(case_id AS STRING)) WHEN 2 THEN concat('https://x.example.org/#/property/',lpad(cast(case_id AS STRING),10,'9'),CASE WHEN case_id%4=0 THEN '?q' ELSE '' END)
    WHEN 3 THEN concat('https://x.example.org/parcel/view/',lpad(cast(case_id AS STRING),7,'0'),'/2025') WHEN 4 THEN concat('ParID / PIN: ',cast(case_id AS STRING),' / x') ELSE concat('parid: ',cast(case_id AS STRING)) END AS body FROM cases)"""


@query("ids_from_url", f"""WITH {_URL_TEXT} SELECT case_id, nullif(regexp_extract(body,'PARCELPK=([^&]*)',1),'') AS durham, nullif(regexp_extract(body,'prid=([^&]*)',1),'') AS harnett,
    nullif(regexp_extract(body,'/property/(\\d{{10}})(?:/|$|\\?)',1),'') AS orange, nullif(regexp_extract(body,'/parcel/view/(\\d+)/',1),'') AS chatham,
    nullif(regexp_extract(body,'(?:ParID\\s*/\\s*PIN|PARID):\\s*(\\d+)',1,'i'),'') AS lee FROM link_text""")
def ids_from_url(t):
    x = t.sql(f"SELECT * FROM ({_URL_TEXT[len('link_text AS ('):-1]}) l")
    b = F.col("body")
    return x.select("case_id", L.durham_id(b).alias("durham"), L.harnett_id(b).alias("harnett"), L.orange_id(b).alias("orange"),
                    L.chatham_id(b).alias("chatham"), L.lee_id(b).alias("lee"))


# --- text --------------------------------------------------------------------------------------------------------


@query("norm_text", """SELECT doc_id, md5(trim(regexp_replace(lower(text),'\\s+',' ','g'))) AS normal_md5 FROM documents""")
def norm_text(t):
    return t.documents.select("doc_id", F.md5(T.norm_text(F.col("text"))).alias("normal_md5"))


@query("norm_event_type", """WITH k AS (SELECT event_id, concat(coalesce(event_type,''), CASE event_id%3 WHEN 0 THEN '_2' WHEN 1 THEN '  -  x' ELSE '' END) AS raw FROM case_events)
    SELECT event_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(raw,'_\\d+$',''),'[/\\-()]','','g'),'\\s+',' ','g'))) AS normal FROM k""")
def norm_event_type(t):
    raw = F.concat(F.coalesce("event_type", F.lit("")), F.when(F.col("event_id") % 3 == 0, "_2").when(F.col("event_id") % 3 == 1, "  -  x").otherwise(""))
    return t.case_events.select("event_id", T.norm_event_type(raw).alias("normal"))


@query("doc_name_parse", """SELECT document_id, CASE WHEN d IS NOT NULL THEN trim(regexp_extract(document_name,'^\\d{2}-\\d{2}-\\d{4}_(.+)\\.pdf$',1,'i')) END AS kind, d AS day
    FROM (SELECT *, CAST(try_strptime(nullif(regexp_extract(document_name,'^(\\d{2}-\\d{2}-\\d{4})_.+\\.pdf$',1,'i'),''),'%m-%d-%Y') AS DATE) AS d FROM docket_documents) x""", days="day")
def doc_name_parse(t):
    n = F.col("document_name")
    return t.docket_documents.select("document_id", T.document_kind(n).alias("kind"), T.document_date(n).alias("day"))


@query("doc_name_build", """SELECT event_id, concat(coalesce(strftime(event_date,'%m-%d-%Y'),'unknown'),'_',substring(regexp_replace(coalesce(event_type,'Unknown'),'[^\\w\\s-]','','g'),1,40),'.pdf') AS document_name FROM case_events""")
def doc_name_build(t):
    return t.case_events.select("event_id", T.document_name(F.col("event_date"), F.col("event_type")).alias("document_name"))


@query("respondent", """SELECT case_id, style, upper(string_split(trim(regexp_replace(regexp_replace(trim(style),'^FORECLOSURE\\s*-?\\s*','','i'),'^\\(HOA\\)\\s*-?\\s*','','i')),' ')[-1]) AS surname FROM cases""")
def respondent(t):
    return t.cases.select("case_id", "style", T.respondent_surname(F.col("style")).alias("surname"))


@query("token_cost", """SELECT doc_id, length(text)//4 AS tokens, CAST(trunc((length(text)//4/1000000.0::DOUBLE*3.0::DOUBLE + n_chars/1000000.0::DOUBLE*15.0::DOUBLE)*100) AS BIGINT) AS cents FROM documents""")
def token_cost(t):
    tokens = T.estimated_tokens(F.col("text"))
    dollars = tokens / F.lit(1_000_000.0) * F.lit(R.INPUT_DOLLARS_PER_MILLION) + F.col("n_chars") / F.lit(1_000_000.0) * F.lit(R.OUTPUT_DOLLARS_PER_MILLION)
    return t.documents.select("doc_id", tokens.alias("tokens"), (dollars * 100).cast("long").alias("cents"))


@query("json_from_text", """WITH b AS (SELECT reply_id, regexp_extract(reply,'\\{[^{}]*\\}') AS body FROM replies)
    SELECT reply_id, body->>'property_address' AS property_address, TRY_CAST(replace(replace(body->>'bid_amount','$',''),',','') AS DECIMAL(12,2)) AS bid_amount, body->>'confidence' AS confidence FROM b""", money="bid_amount")
def json_from_text(t):
    body = J.json_body(F.col("reply"))
    return t.replies.withColumn("body", body).select(
        "reply_id", J.text_field(F.col("body"), "property_address").alias("property_address"),
        J.money_field(F.col("body"), "bid_amount").alias("bid_amount"), J.text_field(F.col("body"), "confidence").alias("confidence"))


@query("json_required", f"""SELECT reply_id, array_to_string(list_filter({R.REQUIRED_KEYS}, lambda k: NOT list_contains(json_keys(analysis), k)), ',') AS missing_keys,
    array_to_string(list_filter({R.REQUIRED_SECTIONS}, lambda k: NOT list_contains(json_keys(analysis->'comprehensive_analysis'), k)), ',') AS missing_sections FROM replies""")
def json_required(t):
    a = F.col("analysis")
    return t.replies.select("reply_id", F.array_join(J.missing_keys(a), ",").alias("missing_keys"),
                            F.array_join(J.missing_sections(a), ",").alias("missing_sections"))


def _rank_sql(expr: str, words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({expr}),'{w}') THEN {i}" for i, w in enumerate(words)) + f" ELSE {len(words)} END"


@query("doc_rank", f"SELECT document_id, {_rank_sql('document_name', R.ADDRESS_DOCUMENT_ORDER)} AS doc_rank FROM docket_documents")
def doc_rank(t):
    return t.docket_documents.select("document_id", P.document_rank(F.col("document_name")).alias("doc_rank"))


TIER_SQL = ("CASE WHEN contains(lower(document_name),lower(case_number)) THEN 1 "
            + " ".join(f"WHEN contains(lower(document_name),'{w}') THEN {n}" for w, n in R.DOCUMENT_TIERS.items()) + " ELSE 3 END")


@query("doc_tier", f"SELECT d.document_id, {TIER_SQL} AS doc_tier FROM docket_documents d JOIN cases c ON c.case_id=d.case_id")
def doc_tier(t):
    j = t.docket_documents.join(t.cases.select("case_id", "case_number"), "case_id")
    return j.select("document_id", P.document_tier(F.col("document_name"), F.col("case_number")).alias("doc_tier"))


# --- predicates --------------------------------------------------------------------------------------------------

KIND_SQL = ("CASE WHEN contains(upper(style),'HOA') THEN 'HOA' WHEN case_type='Special Proceeding' AND "
            "NOT coalesce(contains(style,'Foreclosure'),false) THEN 'Estate' ELSE 'Mortgage' END")


@query("case_kind", f"SELECT case_id, {KIND_SQL} AS case_kind FROM cases")
def case_kind(t):
    return t.cases.select("case_id", P.case_kind(F.col("case_type"), F.col("style")).alias("case_kind"))


NOTICE_SQL = "coalesce(regexp_matches(body,'(?i)" + "|".join(R.NOTICE_MARKERS) + "'), false)"
REPORT_SQL = (f"({sql_any('body', R.REPORT_MARKERS)} OR "
              + " + ".join(f"CAST({sql_any('body', [w])} AS INTEGER)" for w in R.REPORT_WEAK_MARKERS) + " >= 2)")


@query("is_bid_notice", f"SELECT text_id, {NOTICE_SQL} AS is_notice FROM filing_texts")
def is_bid_notice(t):
    return t.filing_texts.select("text_id", P.is_bid_notice(F.col("body")).alias("is_notice"))


@query("is_sale_report", f"SELECT text_id, {REPORT_SQL} AS is_report FROM filing_texts")
def is_sale_report(t):
    return t.filing_texts.select("text_id", P.is_sale_report(F.col("body")).alias("is_report"))


@query("needs_reextract", f"""WITH n AS (SELECT text_id, body, CASE text_id%3 WHEN 0 THEN '01-02-1998_Report of Sale.pdf' WHEN 1 THEN 'Notice of Upset Bid.pdf' ELSE 'Affidavit.pdf' END AS name FROM filing_texts)
    SELECT text_id, {sql_any('name', R.SECOND_SOURCE_KINDS)} AND ((regexp_matches(body,'(?i)Amount\\s*(?:of\\s+)?Bid') AND NOT regexp_matches(body,'\\$\\s*[\\d,]+\\.?\\d*'))
      OR (regexp_matches(body,'(?i)Minimum\\s+Amount.*Next\\s+Upset') AND NOT regexp_matches(body,'(?i)Minimum\\s+Amount.*Next\\s+Upset[\\s\\S]{{0,100}}\\$\\s*[\\d,]+'))) AS needs FROM n""")
def needs_reextract(t):
    name = F.when(F.col("text_id") % 3 == 0, "01-02-1998_Report of Sale.pdf").when(F.col("text_id") % 3 == 1, "Notice of Upset Bid.pdf").otherwise("Affidavit.pdf")
    return t.filing_texts.select("text_id", P.needs_second_source(name, F.col("body"), F.lit(None)).alias("needs"))


@query("text_gate", """SELECT document_id, coalesce(length(trim(ocr_text)) > 100, false) AS direct_ok, coalesce(length(trim(ocr_text)) >= 50, false) AS ocr_ok FROM docket_documents""")
def text_gate(t):
    x = F.col("ocr_text")
    return t.docket_documents.select("document_id", P.usable_text(x).alias("direct_ok"), P.usable_text(x, ocr=True).alias("ocr_ok"))


@query("monitor_list", "SELECT case_id, case_number FROM docket_cases WHERE NOT is_finalized AND case_url IS NOT NULL")
def monitor_list(t):
    return t.docket_cases.where(~F.col("is_finalized") & F.col("case_url").isNotNull()).select("case_id", "case_number")


@query("doc_flags", f"""SELECT document_id, {sql_any('document_name', ['upset bid'])} AS is_upset_document,
    ({sql_any('document_name', ['report of'])} AND {sql_any('document_name', ['sale'])}) OR {sql_any('document_name', ['notice of sale'])} AS is_sale_document FROM docket_documents""")
def doc_flags(t):
    return t.docket_documents.select("document_id", *[c.alias(n) for n, c in P.document_flags(F.col("document_name")).items()])


@query("fix_addresses", "SELECT case_id, CASE WHEN property_address ILIKE '%summons submitted%' THEN NULL ELSE property_address END AS property_address FROM docket_cases")
def fix_addresses(t):
    a = F.col("property_address")
    return t.docket_cases.select("case_id", F.when(~P.is_form_residue(a), a).alias("property_address"))


FITS_SQL = "(" + sql_any("{a}", [", nc"]) + " OR " + " OR ".join(
    f"(county_code='{c}' AND {sql_any('{a}', v)})" for c, v in R.CITIES_BY_COUNTY_CODE.items()) + ")"


@query("addr_plausible", f"""SELECT s.document_id, s.case_id, {FITS_SQL.format(a='s.property_address')} AS plausible
    FROM second_source s JOIN cases c ON c.case_id=s.case_id""")
def addr_plausible(t):
    j = t.second_source.join(t.cases.select("case_id", "county_code"), "case_id")
    return j.select("document_id", "case_id", P.address_fits_county(F.col("property_address"), F.col("county_code")).alias("plausible"))
