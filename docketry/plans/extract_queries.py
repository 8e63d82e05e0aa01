"""Registered queries: extraction from document and event text."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions import text as T
from docketry.operators import extraction as X
from docketry.plans.registry import SQL_CALENDAR, query, sql_any
from docketry.plans.value_queries import NOTICE_SQL, REPORT_SQL


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def rx(expr: str, pattern: str, group: int = 1, flags: str = "i") -> str:
    head = f"(?{flags})" if flags else ""
    return f"nullif(regexp_extract({expr}, {_lit(head + pattern)}, {group}), '')"


def plain_sql(expr: str) -> str:
    return f"TRY_CAST(replace({expr}, ',', '') AS DECIMAL(18,2))"


def loose_sql(expr: str, dot: bool = False) -> str:
    bare = f"regexp_replace({expr}, '[^0-9.]', '', 'g')"
    more = f"contains({bare}, '.') AND " if dot else ""
    return f"CASE WHEN {more}TRY_CAST({bare} AS DECIMAL(18,2)) BETWEEN 100 AND 100000000 THEN TRY_CAST({bare} AS DECIMAL(18,2)) END"


def strict_sql(expr: str) -> str:
    return loose_sql(expr, dot=True)


def back_sql(expr: str) -> str:
    """min/1.05 to the cent: x cents * 20/21, and a tie cannot occur."""
    return f"CASE WHEN ({expr}) IS NOT NULL THEN CAST((CAST(({expr})*100 AS BIGINT)*40+21)//42 AS DECIMAL(18,2))/100 END"


def clean_sql(expr: str) -> str:
    b = f"replace(replace({expr},'$',''),' ','')"
    return (f"TRY_CAST(replace(CASE WHEN regexp_matches({b},'^\\d{{1,3}},\\d{{2}}\\.\\d{{2}}$') THEN concat(split_part({b},'.',1),'0.',"
            f"split_part({b},'.',2)) ELSE {b} END, ',','') AS DECIMAL(18,2))")


def day_sql(expr: str, forms: list[str]) -> str:
    return f"CAST(try_strptime({expr}, {forms}) AS DATE)"


_SALE_FORMS = ["%m/%d/%Y", "%B %d, %Y", "%B %d %Y"]
_DEADLINE_FORMS = _SALE_FORMS + ["%b %d, %Y", "%b %d %Y"]


def first_sql(expr: str, patterns: list[str], convert, flags: str = "i") -> str:
    return "coalesce(" + ", ".join(convert(rx(expr, p, 1, flags)) for p in patterns) + ")"


def _fold(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


# Address: prefix before the first match, groups, clean-up, checks, per pattern.
def _address_steps(source: str) -> str:
    hit, clean = [], []
    for i, (groups, p) in enumerate(R.ADDRESS_PATTERNS):
        whole = _lit("(?i)^(?s:(.*?))(?:" + p + ")")
        raw = _fold(f"regexp_extract(txt, {whole}, 2)")
        if groups == 2:
            raw = f"concat({raw}, ', ', {_fold(f'regexp_extract(txt, {whole}, 3)')})"
        for label in ("^commonly\\s+known\\s+as\\s+", "^known\\s+as\\s+"):
            raw = f"regexp_replace({raw}, '{label}', '', 'i')"
        raw = f"trim(regexp_replace({raw}, '^(.*?\\d{{5}}(?:-\\d{{4}})?).*$', '\\1'))"
        for residue in R.FORM_ARTIFACTS:
            raw = f"regexp_replace({raw}, '{residue}', '', 'gi')"
        hit.append(f"regexp_matches(txt, {_lit('(?i)' + p)}) AS h{i}, right(regexp_extract(txt, {whole}, 1), 300) AS x{i}, {_fold(raw)} AS a{i}")
        reject = _lit("(?i)" + "|".join(R.ADDRESS_REJECT_BEFORE + [T.any_of(R.ATTORNEY_MARKERS)]))
        clean.append(f"CASE WHEN h{i} AND NOT regexp_matches(x{i}, {reject}) AND length(a{i}) >= 10 AND NOT regexp_matches(a{i}, {_lit('|'.join(R.LEGAL_WORDS_IN_ADDRESS))}) THEN a{i} END AS ok{i}")
    n = len(R.ADDRESS_PATTERNS)
    return (f"hits AS (SELECT *, {', '.join(hit)} FROM {source}), good AS (SELECT *, {', '.join(clean)} FROM hits), "
            f"addressed AS (SELECT *, coalesce({', '.join(f'ok{i}' for i in range(n))}) AS address, "
            f"CASE {' '.join(f'WHEN ok{i} IS NOT NULL THEN {i}' for i in range(n))} END AS quality FROM good)")


@query("address_extract", "WITH src AS (SELECT text_id, body AS txt FROM filing_texts), " + _address_steps("src")
       + " SELECT text_id, address, quality FROM addressed")
def address_extract(t):
    a = X.address_of(F.col("body"))
    return t.filing_texts.withColumn("a", a).select("text_id", "a.address", "a.quality")


@query("address_concat", "WITH src AS (SELECT case_id, string_agg(ocr_text, chr(10)||chr(10) ORDER BY document_id) AS txt FROM docket_documents WHERE ocr_text IS NOT NULL GROUP BY case_id), "
       + _address_steps("src") + " SELECT case_id, address, quality FROM addressed WHERE address IS NOT NULL")
def address_concat(t):
    return X.joined_address(t.docket_documents)


@query("bid_generic", f"SELECT text_id, {first_sql('body', R.GENERIC_BID, plain_sql)} AS bid FROM filing_texts", money="bid")
def bid_generic(t):
    return t.filing_texts.select("text_id", X.generic_bid(F.col("body")).alias("bid"))


_NUM = r"\$?\s*(\d[\d,\.\s]+\.\d{2})"


def _after(label: str) -> str:
    return "regexp_extract(body, " + _lit("(?i)(?s:^.*?)(?:" + label + ")(?s:(.*))$") + ", 1)"


def _placed(label: str) -> str:
    rest = f"regexp_replace({_after(label)}, {_lit('^' + R.FORM_AMOUNT)}, '')"
    return (f"CASE WHEN regexp_matches(body, {_lit('(?i)' + label)}) THEN list_filter(list_transform(regexp_extract_all({rest}, {_lit(R.FORM_AMOUNT)}, 1), "
            f"lambda v: {strict_sql('v')}), lambda v: v IS NOT NULL) END")


def notice_steps(source: str) -> str:
    return f"""n1 AS (SELECT text_id, body, contains(body,'AmountofNew') OR contains(replace(body,'  ',' '),'Amount Of New') OR contains(upper(body),'NOTICE OF UPSET BID') AS form,
      {strict_sql(rx(f"substring({_after(R.FORM_MINIMUM_LABEL)},1,50)", _NUM, 1, ''))} AS stated,
      {strict_sql(f"regexp_extract_all(substring({_after(R.FORM_DEPOSIT_LABEL)},1,100), {_lit(_NUM)}, 1)[-1]")} AS stated_deposit,
      {strict_sql(rx('body', R.FORM_PREVIOUS))} AS former, {_placed(R.FORM_PREVIOUS_POSITION)} AS above, {_placed(R.FORM_MINIMUM_POSITION)} AS below FROM {source}),
    n2 AS (SELECT *, {back_sql('stated')} AS stated_bid FROM n1),
    n3 AS (SELECT *, CASE WHEN form THEN coalesce(stated, CASE WHEN stated_bid IS NULL THEN below[1] END) ELSE {first_sql('body', R.NOTICE_MINIMUM, strict_sql, 'is')} END AS minimum_next_bid,
      CASE WHEN form THEN coalesce(stated_bid, above[2]) ELSE {first_sql('body', R.NOTICE_NEW_BID, strict_sql, 'is')} END AS direct,
      CASE WHEN form THEN CASE WHEN stated_bid IS NULL THEN above[1] WHEN former < stated_bid THEN former END ELSE {first_sql('body', R.NOTICE_PREVIOUS_BID, strict_sql, 'is')} END AS previous_bid,
      CASE WHEN form THEN coalesce(CASE WHEN stated_bid IS NULL THEN below[2] END, stated_deposit) ELSE {first_sql('body', R.NOTICE_DEPOSIT, strict_sql, 'is')} END AS deposit_required,
      coalesce(CASE WHEN contains(body,'AmountofNew') OR contains(replace(body,'  ',' '),'Amount Of New') THEN
        {day_sql(rx(f"regexp_replace({_after(R.FORM_DEADLINE_LABEL)}, '^[0-9]+/[0-9]+/[0-9]+', '')", "(\\d{1,2}/\\d{1,2}/\\d{4})", 1, ''), ['%m/%d/%Y'])} END,
        {first_sql('body', R.DEADLINE_TEXT, lambda e: day_sql(e, _DEADLINE_FORMS))}) AS next_deadline FROM n2),
    notices AS (SELECT *, coalesce(direct, {back_sql('minimum_next_bid')}) AS current_bid FROM n3)"""


@query("bid_notice", f"WITH {notice_steps('filing_texts')} SELECT text_id, current_bid, previous_bid, minimum_next_bid, deposit_required, next_deadline FROM notices",
       money="current_bid previous_bid minimum_next_bid deposit_required", days="next_deadline")
def bid_notice(t):
    notice = t.filing_texts.withColumn("n", X.bid_notice(F.col("body")))
    return notice.select("text_id", "n.*", X.notice_deadline(F.col("body")).alias("next_deadline"))


REPORT_BID_SQL = f"coalesce({first_sql('body', R.REPORT_BID, loose_sql, 'is')}, {back_sql(loose_sql(rx('body', R.REPORT_MINIMUM, 1, 'is')))})"


@query("sale_report", f"""WITH {SQL_CALENDAR}, r AS (SELECT text_id, {REPORT_BID_SQL} AS initial_bid,
    {first_sql('body', R.REPORT_SALE_DATE, lambda e: day_sql(e, _SALE_FORMS))} AS sale_date FROM filing_texts)
    SELECT text_id, initial_bid, sale_date, deadline AS next_deadline FROM r LEFT JOIN deadlines ON deadlines.day=sale_date""",
       money="initial_bid", days="sale_date next_deadline")
def sale_report(t):
    return X.with_sale_report(t.filing_texts, "body").select(
        "text_id", "initial_bid", F.col("report_sale_date").alias("sale_date"), "next_deadline")


DEADLINE_SQL = first_sql("body", R.DEADLINE_TEXT, lambda e: day_sql(e, _DEADLINE_FORMS))
SALE_DATE_SQL = first_sql("body", R.SALE_DATE_TEXT, lambda e: day_sql(e, _SALE_FORMS))
LEGAL_SQL = first_sql("body", R.LEGAL_DESCRIPTION, _fold, "is")
TRUSTEE_SQL = first_sql("body", R.TRUSTEE_NAME, lambda e: f"trim({e})")
ATTORNEY_SQL = first_sql("body", R.ATTORNEY_NAME, lambda e: f"CASE WHEN NOT regexp_full_match({e}, '\\d+') THEN trim({e}) END")
PHONE_SQL = rx("body", R.PHONE, 1, "")
EMAIL_SQL = f"lower({rx('body', R.EMAIL, 1, '')})"


@query("deadline_text", f"SELECT text_id, {DEADLINE_SQL} AS deadline FROM filing_texts", days="deadline")
def deadline_text(t):
    return t.filing_texts.select("text_id", X.deadline_text(F.col("body")).alias("deadline"))


@query("sale_date_text", f"SELECT text_id, {SALE_DATE_SQL} AS sale_date FROM filing_texts", days="sale_date")
def sale_date_text(t):
    return t.filing_texts.select("text_id", X.sale_date_text(F.col("body")).alias("sale_date"))


@query("legal_desc", f"SELECT text_id, {LEGAL_SQL} AS legal_description FROM filing_texts")
def legal_desc(t):
    return t.filing_texts.select("text_id", X.legal_description(F.col("body")).alias("legal_description"))


@query("trustee", f"SELECT text_id, {TRUSTEE_SQL} AS trustee_name FROM filing_texts")
def trustee(t):
    return t.filing_texts.select("text_id", X.trustee_name(F.col("body")).alias("trustee_name"))


@query("contact_extract", f"SELECT text_id, {ATTORNEY_SQL} AS name, {PHONE_SQL} AS phone, {EMAIL_SQL} AS email FROM filing_texts")
def contact_extract(t):
    b = F.col("body")
    return t.filing_texts.select("text_id", X.attorney_name(b).alias("name"), X.phone(b).alias("phone"), X.email(b).alias("email"))


def read_steps(source: str) -> str:
    """CTEs ending in ``docs_read``: all fields per text of ``source(text_id, body)``."""
    own = lambda sql: sql.replace("body", "a.body")
    return f"""{notice_steps(source)}, src AS (SELECT text_id, body, body AS txt FROM {source}), {_address_steps('src')},
    docs_read AS (SELECT a.text_id AS document_id, a.address AS property_address, a.quality AS address_quality,
      coalesce(CASE WHEN {own(NOTICE_SQL)} THEN n.current_bid END, CASE WHEN {own(REPORT_SQL)} THEN {own(REPORT_BID_SQL)} END,
        {first_sql('a.body', R.GENERIC_BID, plain_sql)}) AS current_bid_amount,
      {own(DEADLINE_SQL)} AS next_bid_deadline, {own(SALE_DATE_SQL)} AS sale_date, {own(LEGAL_SQL)} AS legal_description,
      {own(TRUSTEE_SQL)} AS trustee_name, {own(ATTORNEY_SQL)} AS attorney_name, {own(PHONE_SQL)} AS attorney_phone, {own(EMAIL_SQL)} AS attorney_email
    FROM addressed a JOIN notices n ON n.text_id=a.text_id)"""


@query("doc_extract", f"WITH {read_steps('filing_texts')} SELECT * FROM docs_read", money="current_bid_amount", days="next_bid_deadline sale_date")
def doc_extract(t):
    return X.extract_documents(t.filing_texts.select(F.col("text_id").alias("document_id"), F.col("body").alias("ocr_text")))


_EVENT_BID = ("coalesce(" + ", ".join(f"CASE WHEN {clean_sql(rx('event_description', p, 1, ''))} > 0 THEN {clean_sql(rx('event_description', p, 1, ''))} END"
                                      for p in R.EVENT_BID) + ")")
EVENT_BIDS_SQL = f"""event_bids AS (SELECT case_id, bid AS event_bid FROM (SELECT e.case_id, e.event_date, e.event_id, {_EVENT_BID} AS bid FROM case_events e
      JOIN docket_cases c ON c.case_id=e.case_id WHERE {sql_any('event_type', R.EVENT_BID_KINDS)} AND (c.sale_date IS NULL OR e.event_date >= c.sale_date)) x
    WHERE bid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY event_date DESC NULLS LAST, event_id DESC)=1)"""


@query("event_bid", f"WITH {EVENT_BIDS_SQL} SELECT * FROM event_bids", money="event_bid")
def event_bid(t):
    return X.event_bids(t.docket_cases, t.case_events)


EVENT_ADDRESS_SQL = f"""event_addresses AS (SELECT case_id, address AS event_address FROM (SELECT case_id, event_date, event_id, trim({rx('trim(event_description)', R.EVENT_ADDRESS_PATTERN)}) AS address
      FROM case_events WHERE {sql_any('event_type', R.EVENT_ADDRESS_KINDS)}) x WHERE address IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY event_date DESC NULLS LAST, event_id DESC)=1)"""


@query("event_address", f"WITH {EVENT_ADDRESS_SQL} SELECT * FROM event_addresses")
def event_address(t):
    return X.event_addresses(t.case_events)


@query("min_next_text", f"SELECT text_id, {first_sql('body', R.REPORT_NEXT_MINIMUM, plain_sql)} AS minimum FROM filing_texts", money="minimum")
def min_next_text(t):
    return t.filing_texts.select("text_id", X.next_minimum(F.col("body")).alias("minimum"))


_PAGE_BID = "coalesce(" + ", ".join(
    f"list_filter(list_transform(regexp_extract_all(body, {_lit('(?i)' + p)}, 1), lambda v: {plain_sql('v')}), lambda v: v > 1000)[1]" for p in R.PAGE_BID) + ")"


@query("page_bid", f"SELECT text_id, {_PAGE_BID} AS bid FROM filing_texts", money="bid")
def page_bid(t):
    return t.filing_texts.select("text_id", X.page_bid(F.col("body")).alias("bid"))


CASE_NOS_SQL = r"""list_transform(regexp_extract_all({x}, '(?i)\b\d{{2}}\s*SP\s*0*\d{{3,6}}(?:-\d{{3}})?\b'), lambda h: concat(substring(h,1,2),'SP',
      lpad(regexp_extract(h,'(?i)^\d{{2}}\s*SP\s*0*(\d{{3,6}})',1),6,'0'), regexp_extract(h,'(-\d{{3}})$',1)))"""


@query("case_nos", f"SELECT text_id, array_to_string(list_sort(list_distinct({CASE_NOS_SQL.format(x='body')})), ',') AS case_nos FROM filing_texts")
def case_nos(t):
    return t.filing_texts.select("text_id", F.array_join(F.array_sort(T.case_numbers_in(F.col("body"))), ",").alias("case_nos"))
