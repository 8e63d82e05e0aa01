"""Registered queries: documents, merges, data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.dates import as_moment
from docketry.operators import casework as K
from docketry.operators import documents as DOC
from docketry.operators import extraction as X
from docketry.plans.extract_queries import (
    CASE_NOS_SQL,
    EVENT_ADDRESS_SQL,
    EVENT_BIDS_SQL,
    REPORT_BID_SQL,
    back_sql,
    first_sql,
    notice_steps,
    plain_sql,
    read_steps,
)
from docketry.plans.registry import SQL_CALENDAR, query, sql_any
from docketry.plans.value_queries import FITS_SQL, NOTICE_SQL, REPORT_SQL, TIER_SQL, _rank_sql
from docketry.sources.sample_views import AS_OF

# --- documents -----------------------------------------------------------------------------------------------------

_NAMED = """named AS (SELECT document_id, case_id, CAST(try_strptime(nullif(regexp_extract(document_name,'^(\\d{2}-\\d{2}-\\d{4})_.+\\.pdf$',1,'i'),''),'%m-%d-%Y') AS DATE) AS d,
      trim(regexp_extract(document_name,'^\\d{2}-\\d{2}-\\d{4}_(.+)\\.pdf$',1,'i')) AS k FROM docket_documents WHERE event_id IS NULL)"""


def _norm(expr: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce({expr},''),'_\\d+$',''),'[/\\-()]','','g'),'\\s+',' ','g')))"


_LINKS = f"""{_NAMED}, pairs AS (SELECT n.document_id, n.case_id, n.d, n.k, e.event_id,
      CASE WHEN e.event_type=n.k THEN 1 WHEN {_norm('e.event_type')}={_norm('n.k')} THEN 2
        WHEN length({_norm('n.k')})>=30 AND starts_with({_norm('e.event_type')}, substring({_norm('n.k')},1,30)) THEN 2
        WHEN length({_norm('e.event_type')})>=30 AND starts_with({_norm('n.k')}, substring({_norm('e.event_type')},1,30)) THEN 2 END AS r
    FROM named n LEFT JOIN case_events e ON e.case_id=n.case_id AND e.event_date=n.d AND n.k<>''),
    best AS (SELECT document_id, case_id, d, k, CASE WHEN r IS NOT NULL THEN event_id END AS event_id, r FROM pairs
      QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY r NULLS LAST, event_id)=1),
    links AS (SELECT document_id, case_id, event_id, CASE WHEN d IS NULL OR k='' THEN 'skipped' WHEN r=1 THEN 'exact' WHEN r=2 THEN 'fuzzy' ELSE 'unmatched' END AS match FROM best)"""


@query("doc_event_link", f"WITH {_LINKS} SELECT * FROM links")
def doc_event_link(t):
    return DOC.link_events(t.docket_documents, t.case_events)


@query("doc_event_link_start", f"""WITH {_NAMED}, p AS (SELECT n.document_id, n.case_id, e.event_id, CASE WHEN e.event_type=n.k THEN 1 WHEN contains(lower(e.event_type), lower(substring(n.k,1,20))) THEN 2 END AS r
      FROM named n LEFT JOIN case_events e ON e.case_id=n.case_id AND e.event_date=n.d WHERE n.d IS NOT NULL AND n.k<>'')
    SELECT document_id, case_id, CASE WHEN r IS NOT NULL THEN event_id END AS event_id FROM p QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY r NULLS LAST, event_id)=1""")
def doc_event_link_start(t):
    return DOC.link_by_start(t.docket_documents, t.case_events)


@query("link_rate", f"""WITH {_LINKS}, l AS (SELECT count(*) FILTER (match='exact') AS exact, count(*) FILTER (match='fuzzy') AS fuzzy,
      count(*) FILTER (match='unmatched') AS unmatched, count(*) FILTER (match='skipped') AS skipped FROM links)
    SELECT (SELECT count(*) FROM docket_documents) AS documents, (SELECT count(event_id) FROM docket_documents) AS linked_before, l.*,
      (SELECT count(event_id) FROM docket_documents)+exact+fuzzy AS linked_after FROM l""")
def link_rate(t):
    return DOC.link_report(t.docket_documents, DOC.link_events(t.docket_documents, t.case_events))


_COPIES = """copies AS (SELECT document_id, case_id, document_name, ocr_text, document_date FROM docket_documents UNION ALL
    SELECT document_id+1, case_id, document_name, CASE WHEN document_id%3=0 THEN NULL ELSE ocr_text END, document_date FROM docket_documents WHERE document_id%4=0 UNION ALL
    SELECT document_id+2, case_id, concat('copy of ', document_name), ocr_text, document_date FROM docket_documents WHERE document_id%5=0)"""


def _copies(t):
    d = t.docket_documents.select("document_id", "case_id", "document_name", "ocr_text", "document_date")
    i = F.col("document_id")
    a = d.where(i % 4 == 0).withColumn("ocr_text", F.when(i % 3 != 0, F.col("ocr_text"))).withColumn("document_id", i + 1)
    b = d.where(i % 5 == 0).withColumn("document_name", F.concat(F.lit("copy of "), "document_name")).withColumn("document_id", i + 2)
    return d.unionByName(a).unionByName(b)


@query("dedupe_docs", f"""WITH {_COPIES} SELECT document_id, case_id, document_name FROM copies
    QUALIFY row_number() OVER (PARTITION BY case_id, document_name ORDER BY CASE WHEN length(ocr_text)>0 THEN 0 ELSE 1 END, document_id)=1""")
def dedupe_docs(t):
    return DOC.dedupe_documents(_copies(t)).select("document_id", "case_id", "document_name")


@query("hash_dedupe", f"""WITH {_COPIES} SELECT document_id, case_id, md5(ocr_text) AS content_md5 FROM copies WHERE length(ocr_text)>0
    QUALIFY row_number() OVER (PARTITION BY case_id, md5(ocr_text) ORDER BY document_id)=1""")
def hash_dedupe(t):
    return DOC.distinct_texts(_copies(t)).select("document_id", "case_id", "content_md5")


@query("doc_budget", f"""WITH RECURSIVE {_COPIES}, u AS (SELECT * FROM copies WHERE length(ocr_text)>0 QUALIFY row_number() OVER (PARTITION BY case_id, md5(ocr_text) ORDER BY document_id)=1),
    q AS (SELECT u.case_id, u.document_id, least(length(ocr_text), 15000) AS size, row_number() OVER (PARTITION BY u.case_id ORDER BY {TIER_SQL}, document_date NULLS FIRST, document_id) AS n
      FROM u JOIN cases c ON c.case_id=u.case_id),
    walk AS (SELECT case_id, document_id, n, size <= 160 AS taken, CASE WHEN size <= 160 THEN size ELSE 0 END AS used FROM q WHERE n=1
      UNION ALL SELECT q.case_id, q.document_id, q.n, w.used+q.size <= 160, CASE WHEN w.used+q.size <= 160 THEN w.used+q.size ELSE w.used END FROM walk w JOIN q ON q.case_id=w.case_id AND q.n=w.n+1)
    SELECT case_id, document_id, row_number() OVER (PARTITION BY case_id ORDER BY n)-1 AS position FROM walk WHERE taken""")
def doc_budget(t):
    # The sample texts are short, so a small budget is what makes the rule bite.
    return DOC.select_corpus(_copies(t), t.cases, budget=160)


@query("doc_valid", """WITH j AS (SELECT text_id, body, substring(c.case_number,1,10) AS base FROM filing_texts f JOIN cases c ON c.case_id=f.case_id),
    f AS (SELECT text_id, base, list_transform(list_concat(regexp_extract_all(body,'(?i)\\b\\d{2}\\s*SP\\s*\\d{6}\\b'), regexp_extract_all(body,'(?i)\\b\\d{2}\\s*SP\\s*\\d{4}\\b')),
      lambda h: concat(substring(h,1,2),'SP',lpad(regexp_extract(h,'(\\d+)$',1),6,'0'))) AS found FROM j)
    SELECT text_id, len(found)=0 OR list_contains(found, base) AS belongs FROM f""")
def doc_valid(t):
    j = t.filing_texts.join(t.cases.select("case_id", "case_number"), "case_id")
    return j.select("text_id", DOC.document_belongs(F.col("body"), F.col("case_number")).alias("belongs"))


_REPORTS = """reports AS (SELECT text_id AS document_id, case_id, '01-02-1998_Report of Sale.pdf' AS document_name, body AS ocr_text FROM filing_texts WHERE template IN (12,17,20,22))"""


#: What a filing text of each template is called; the sale reports are those of ``_REPORTS`` and two more that name no case.
_FILING_NAMES = {
    **dict.fromkeys((12, 17, 20, 22), "Report of Sale"), 13: "Report of Private Sale", 19: "Report of Sale and Upset Bid",
    **dict.fromkeys((9, 10, 11, 15, 16, 21), "Notice of Upset Bid"), 14: "Notice of Sale", 18: "Deed of Trust",
    **dict.fromkeys((0, 1, 2, 3, 4, 5, 6, 7, 8), "Notice of Hearing"),
}


def named_filings(texts: DataFrame) -> DataFrame:
    """All filing texts as documents, named by their template."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in _FILING_NAMES.items() for x in pair]), F.col("template").cast("int"))
    return texts.select(F.col("text_id").alias("document_id"), "case_id", F.concat(F.lit("01-02-1998_"), kind, F.lit(".pdf")).alias("document_name"),
                        F.col("body").alias("ocr_text"))


@query("misfiled", f"""WITH {_REPORTS}, j AS (SELECT r.*, c.case_number, c.style, substring(c.case_number,1,10) AS base FROM reports r JOIN docket_cases c ON c.case_id=r.case_id AND c.classification='upset_bid'),
    k AS (SELECT *, upper(string_split(trim(regexp_replace(regexp_replace(trim(style),'^FORECLOSURE\\s*-?\\s*','','i'),'^\\(HOA\\)\\s*-?\\s*','','i')),' ')[-1]) AS surname,
      list_filter(list_distinct({CASE_NOS_SQL.format(x='ocr_text')}), lambda n: NOT contains(n, base)) AS others FROM j),
    m AS (SELECT *, length(surname)>3 AND NOT contains(upper(ocr_text), surname) AND regexp_matches(ocr_text,'(?:Respondent|Defendant):\\s*([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{1,3}})') AS name_mismatch FROM k)
    SELECT document_id, case_id, case_number, array_to_string(list_sort(others),',') AS other_numbers, name_mismatch FROM m WHERE len(others)>0 OR name_mismatch""")
def misfiled(t):
    return DOC.misfiled(named_filings(t.filing_texts), t.docket_cases).withColumn("other_numbers", F.array_join(F.array_sort("other_numbers"), ","))


# --- extraction per case ---------------------------------------------------------------------------------------------

_DOC_SOURCE = "doc_text AS (SELECT document_id AS text_id, ocr_text AS body FROM docket_documents WHERE length(ocr_text)>0)"
_RANKED = _rank_sql("d.document_name", R.ADDRESS_DOCUMENT_ORDER)
_BEST_ADDRESS = f"""best_addresses AS (SELECT d.case_id, r.property_address AS document_address, r.address_quality FROM docs_read r JOIN docket_documents d ON d.document_id=r.document_id
    WHERE r.property_address IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d.case_id ORDER BY {_RANKED}, d.document_id DESC)=1)"""


def _newest(field: str, cycle: bool) -> str:
    more = " AND NOT is_old" if cycle else ""
    return f"arg_max(r.{field}, r.document_id) FILTER (r.{field} IS NOT NULL{more}) AS {field}"


_MERGED = f"""dated AS (SELECT r.*, d.case_id, coalesce(c.sale_date IS NOT NULL AND (d.document_date < c.sale_date OR (d.document_date IS NULL AND starts_with(d.document_name,'unknown'))), false) AS is_old
      FROM docs_read r JOIN docket_documents d ON d.document_id=r.document_id JOIN docket_cases c ON c.case_id=d.case_id),
    merged AS (SELECT r.case_id, {', '.join(_newest(f, f in ('current_bid_amount', 'sale_date')) for f in K.MERGED_FIELDS)} FROM dated r GROUP BY r.case_id)"""
_CASE_EXTRACT = f"""{_DOC_SOURCE}, {read_steps('doc_text')}, {_BEST_ADDRESS}, {_MERGED}, {EVENT_BIDS_SQL}, {EVENT_ADDRESS_SQL},
    extracted AS (SELECT c.case_id, CASE WHEN c.case_type='Special Proceeding' AND event_address IS NOT NULL THEN event_address ELSE coalesce(document_address, event_address) END AS property_address,
      CASE WHEN c.case_type='Special Proceeding' AND event_address IS NOT NULL THEN 0 ELSE address_quality END AS address_quality, coalesce(event_bid, m.current_bid_amount) AS current_bid_amount,
      m.sale_date, m.next_bid_deadline, m.legal_description, m.trustee_name, m.attorney_name, m.attorney_phone, m.attorney_email
    FROM docket_cases c LEFT JOIN merged m ON m.case_id=c.case_id LEFT JOIN best_addresses b ON b.case_id=c.case_id LEFT JOIN event_bids e ON e.case_id=c.case_id
      LEFT JOIN event_addresses a ON a.case_id=c.case_id)"""
_STICKY = """sticky AS (SELECT c.* REPLACE (coalesce(nullif(c.property_address,''), x.property_address) AS property_address,
      CASE WHEN x.current_bid_amount<>0 AND x.current_bid_amount IS DISTINCT FROM c.current_bid_amount THEN x.current_bid_amount ELSE c.current_bid_amount END AS current_bid_amount,
      CASE WHEN x.current_bid_amount<>0 AND x.current_bid_amount IS DISTINCT FROM c.current_bid_amount THEN round_even(CAST(x.current_bid_amount AS DECIMAL(12,2))*CAST(1.05 AS DECIMAL(3,2)),2) ELSE c.minimum_next_bid END AS minimum_next_bid,
      coalesce(c.sale_date, x.sale_date) AS sale_date, coalesce(nullif(c.legal_description,''), x.legal_description) AS legal_description,
      coalesce(nullif(c.trustee_name,''), x.trustee_name) AS trustee_name) FROM docket_cases c LEFT JOIN extracted x ON x.case_id=c.case_id)"""


@query("best_address", f"WITH {_DOC_SOURCE}, {read_steps('doc_text')}, {_BEST_ADDRESS} SELECT * FROM best_addresses")
def best_address(t):
    return K.best_address(X.extract_documents(t.docket_documents))


@query("field_merge", f"WITH {_DOC_SOURCE}, {read_steps('doc_text')}, {_MERGED} SELECT * FROM merged",
       money="current_bid_amount", days="next_bid_deadline sale_date")
def field_merge(t):
    return K.merge_fields(X.extract_documents(t.docket_documents), t.docket_cases)


@query("case_extract", f"WITH {_CASE_EXTRACT} SELECT * FROM extracted", money="current_bid_amount", days="next_bid_deadline sale_date")
def case_extract(t):
    return K.extract_cases(t.docket_cases, t.case_events, t.docket_documents)


@query("sticky_apply", f"WITH {_CASE_EXTRACT}, {_STICKY} SELECT case_id, property_address, current_bid_amount, minimum_next_bid, sale_date, legal_description, trustee_name FROM sticky",
       money="current_bid_amount minimum_next_bid", days="sale_date")
def sticky_apply(t):
    return K.sticky_apply(t.docket_cases, K.extract_cases(t.docket_cases, t.case_events, t.docket_documents)).select(
        "case_id", "property_address", "current_bid_amount", "minimum_next_bid", "sale_date", "legal_description", "trustee_name")


@query("bid_crosscheck", f"""WITH {_DOC_SOURCE}, {read_steps('doc_text')}, {EVENT_BIDS_SQL} SELECT d.document_id, d.case_id, r.current_bid_amount AS document_bid, e.event_bid
    FROM docs_read r JOIN docket_documents d ON d.document_id=r.document_id JOIN event_bids e ON e.case_id=d.case_id WHERE abs(r.current_bid_amount-e.event_bid)*10 > e.event_bid""", money="document_bid event_bid")
def bid_crosscheck(t):
    return K.bid_crosscheck(t.docket_documents, X.event_bids(t.docket_cases, t.case_events))


def _attempted(t):
    done = F.when(F.col("document_id") % 3 != 0, as_moment(AS_OF))
    return t.docket_documents.withColumn("extraction_attempted_at", done)


@query("extract_todo", "SELECT DISTINCT case_id FROM docket_documents WHERE ocr_text IS NOT NULL AND document_id%3=0")
def extract_todo(t):
    return K.extraction_todo(_attempted(t))


@query("mark_attempted", """SELECT document_id, document_id%3<>0 OR (case_id%2=0 AND ocr_text IS NOT NULL) AS is_attempted FROM docket_documents""")
def mark_attempted(t):
    some = t.cases.where("case_id % 2 = 0")
    return K.mark_attempted(_attempted(t), some, as_moment(AS_OF)).select("document_id", F.col("extraction_attempted_at").isNotNull().alias("is_attempted"))


@query("reprocess", """SELECT c.case_id, CASE WHEN c.case_id%5=1 THEN NULL ELSE c.property_address END AS property_address,
    (SELECT count(*) FROM docket_documents d WHERE d.case_id=c.case_id AND d.document_id%3<>0 AND c.case_id%5<>1) AS attempted FROM docket_cases c""")
def reprocess(t):
    cases, docs = K.reset_for_reprocessing(t.docket_cases, _attempted(t), t.cases.where("case_id % 5 = 1"))
    done = docs.groupBy("case_id").agg(F.count("extraction_attempted_at").alias("attempted"))
    return cases.select("case_id", "property_address").join(done, "case_id", "left").fillna(0, ["attempted"])


def _missing(alias: str = "") -> str:
    text = ("case_number", "property_address")
    tests = [f"CASE WHEN {alias}{n} IS NULL" + (f" OR trim({alias}{n})=''" if n in text else "") + f" THEN '{n}' END" for n in R.REQUIRED_FIELDS]
    return "concat_ws(',', " + ", ".join(tests) + ")"


@query("completeness", f"SELECT case_id, {_missing()} AS missing FROM docket_cases WHERE classification='upset_bid'")
def completeness(t):
    upset = t.docket_cases.where(F.col("classification") == R.UPSET_BID)
    return upset.select("case_id", F.array_join(K.missing_fields(upset), ",").alias("missing"))


@query("heal_report", f"""WITH {_CASE_EXTRACT}, {_STICKY} SELECT c.case_id, c.case_number, {_missing('c.')} AS missing_before, {_missing('s.')} AS missing_after, {_missing('s.')}='' AS is_healed
    FROM docket_cases c JOIN sticky s ON s.case_id=c.case_id WHERE c.classification='upset_bid' AND {_missing('c.')}<>''""")
def heal_report(t):
    return K.heal_report(t.docket_cases, t.case_events, t.docket_documents).withColumns({
        "missing_before": F.array_join("missing_before", ","), "missing_after": F.array_join("missing_after", ",")})


_LEDGER = """ledger AS (SELECT case_id, 'extract' AS step FROM cases WHERE case_id%5>=1 UNION ALL SELECT case_id, 'second_text' FROM cases WHERE case_id%5 IN (2,4)
    UNION ALL SELECT case_id, 're_read' FROM cases WHERE case_id%5>=3 UNION ALL SELECT case_id, 'by hand' FROM cases WHERE case_id%5=0)"""
_DUE = f"""{_LEDGER}, a AS (SELECT case_id, case_number, {_missing()} AS missing FROM docket_cases WHERE classification='upset_bid' AND {_missing()}<>''),
    w AS (SELECT a.*, case_id IN (SELECT case_id FROM docket_documents WHERE case_id IS NOT NULL) AS has, coalesce((SELECT list(DISTINCT step) FROM ledger l WHERE l.case_id=a.case_id AND step<>'by hand'), []) AS done FROM a),
    due AS (SELECT case_id, case_number, missing, CASE WHEN NOT list_contains(done,'extract') THEN 'extract' WHEN has AND NOT list_contains(done,'second_text') THEN 'second_text'
      WHEN NOT list_contains(done,'re_read') THEN 're_read' ELSE 'exhausted' END AS step, len(done) AS attempts FROM w)"""


def _ledger(t):
    step = lambda name, rule: t.cases.where(rule).select("case_id", F.lit(name).alias("step"), F.lit(None).cast("timestamp_ntz").alias("attempted_at"))
    return step("extract", "case_id % 5 >= 1").unionByName(step("second_text", "case_id % 5 IN (2, 4)")).unionByName(step("re_read", "case_id % 5 >= 3")).unionByName(
        step("by hand", "case_id % 5 = 0"))


@query("heal_ladder", f"WITH {_DUE} SELECT * FROM due")
def heal_ladder(t):
    """The step of the healing ladder that is next for each incomplete case."""
    return K.heal_due(t.docket_cases, t.docket_documents, _ledger(t)).withColumn("missing", F.array_join("missing", ","))


@query("heal_counters", f"WITH {_DUE} SELECT step, count(*) AS cases, CAST(sum(attempts) AS BIGINT) AS attempts FROM due GROUP BY step")
def heal_counters(t):
    return K.heal_counters(K.heal_due(t.docket_cases, t.docket_documents, _ledger(t)))


@query("heal_attempts", f"WITH {_DUE} SELECT case_id, step, CASE WHEN n THEN TIMESTAMP '1998-06-15 12:00:00' END AS attempted_at FROM (SELECT case_id, step, false AS n FROM ledger UNION ALL SELECT case_id, step, true FROM due WHERE step<>'exhausted') x", moments="attempted_at")
def heal_attempts(t):
    """The attempt ledger after today's steps."""
    ledger = _ledger(t)
    return K.heal_recorded(ledger, K.heal_due(t.docket_cases, t.docket_documents, ledger), as_moment(AS_OF).cast("timestamp_ntz"))


@query("missing_bid_diag", """WITH l AS (SELECT * FROM docket_cases WHERE classification='upset_bid' AND current_bid_amount IS NULL),
    e AS (SELECT case_id, count(*) FILTER (event_type ILIKE '%report%sale%') AS s, count(*) FILTER (event_type ILIKE '%upset%bid%') AS u FROM case_events GROUP BY case_id),
    d AS (SELECT case_id, count(*) AS n, count(DISTINCT document_name) AS names FROM docket_documents WHERE ocr_text IS NOT NULL GROUP BY case_id)
    SELECT l.case_id, l.case_number, coalesce(s,0) AS sale_events, coalesce(u,0) AS upset_events, coalesce(n,0) AS texts,
      CASE WHEN coalesce(s,0)=0 THEN 'no sale event' WHEN coalesce(n,0)=0 THEN 'no text' WHEN names=1 THEN 'only the main filing' ELSE 'no bid in text' END AS reason
    FROM l LEFT JOIN e ON e.case_id=l.case_id LEFT JOIN d ON d.case_id=l.case_id""")
def missing_bid_diag(t):
    return K.missing_bid_diagnosis(t.docket_cases, t.case_events, t.docket_documents)


_STATED = back_sql(first_sql("d.ocr_text", R.REPORT_NEXT_MINIMUM, plain_sql))


@query("missing_bid_fix", f"""WITH {_DOC_SOURCE}, {notice_steps('doc_text')}, b AS (SELECT d.case_id, d.document_id,
      CASE WHEN {NOTICE_SQL.replace('body','d.ocr_text')} THEN n.current_bid END AS nb, CASE WHEN {REPORT_SQL.replace('body','d.ocr_text')} THEN {REPORT_BID_SQL.replace('body','d.ocr_text')} END AS rb,
      CASE WHEN {NOTICE_SQL.replace('body','d.ocr_text')} OR {REPORT_SQL.replace('body','d.ocr_text')} THEN {_STATED} END AS sb
      FROM docket_documents d JOIN notices n ON n.text_id=d.document_id JOIN docket_cases c ON c.case_id=d.case_id AND c.classification='upset_bid' AND c.current_bid_amount IS NULL),
    g AS (SELECT case_id, arg_min(nb, document_id) FILTER (nb IS NOT NULL) AS nb, min(document_id) FILTER (nb IS NOT NULL) AS ni, arg_max(rb, document_id) FILTER (rb IS NOT NULL) AS rb,
      max(document_id) FILTER (rb IS NOT NULL) AS ri, arg_min(sb, document_id) FILTER (sb IS NOT NULL) AS sb, min(document_id) FILTER (sb IS NOT NULL) AS si FROM b GROUP BY case_id)
    SELECT case_id, coalesce(nb, rb, sb) AS current_bid_amount, round_even(CAST(coalesce(nb, rb, sb) AS DECIMAL(12,2))*CAST(1.05 AS DECIMAL(3,2)),2) AS minimum_next_bid, coalesce(ni, ri, si) AS document_id
    FROM g WHERE coalesce(nb, rb, sb) IS NOT NULL""", money="current_bid_amount minimum_next_bid")
def missing_bid_fix(t):
    return K.missing_bid_repair(t.docket_cases, t.docket_documents)


@query("missing_addr_fix", f"""WITH {_DOC_SOURCE}, {read_steps('doc_text')}, {_BEST_ADDRESS} SELECT b.* FROM best_addresses b JOIN docket_cases c ON c.case_id=b.case_id
    WHERE coalesce(trim(c.property_address),'')=''""")
def missing_addr_fix(t):
    return K.missing_address_repair(t.docket_cases, t.docket_documents)


_BEST_BID = f"""{_DOC_SOURCE}, {notice_steps('doc_text')}, kinds AS (SELECT d.*, {REPORT_SQL.replace('body','d.ocr_text')} AS is_report, {NOTICE_SQL.replace('body','d.ocr_text')} AS is_bid, n.current_bid, n.minimum_next_bid AS stated,
      {REPORT_BID_SQL.replace('body','d.ocr_text')} AS rb, {first_sql('d.ocr_text', R.REPORT_SALE_DATE, lambda e: f"CAST(try_strptime({e}, ['%m/%d/%Y','%B %d, %Y','%B %d %Y']) AS DATE)")} AS rd
      FROM docket_documents d JOIN notices n ON n.text_id=d.document_id WHERE {sql_any('d.document_name', ['upset bid', 'report of', 'notice of sale'])}),
    bids AS (SELECT case_id, document_id, document_date, is_report, CASE WHEN is_report THEN rb ELSE current_bid END AS bid, CASE WHEN NOT is_report THEN stated END AS minimum, CASE WHEN is_report THEN rd END AS report_sale_date
      FROM kinds WHERE is_report OR is_bid),
    best_bids AS (SELECT case_id, document_id, NOT is_report AS is_notice, bid, minimum, report_sale_date FROM bids WHERE bid<>0
      QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY is_report, CASE WHEN NOT is_report THEN document_date END DESC NULLS LAST, CASE WHEN NOT is_report THEN document_id END DESC NULLS LAST, document_date ASC NULLS FIRST, document_id)=1)"""


@query("best_bid_doc", f"WITH {_BEST_BID} SELECT * FROM best_bids", money="bid minimum", days="report_sale_date")
def best_bid_doc(t):
    return K.best_bid_document(t.docket_documents)


@query("bid_update", f"""WITH {SQL_CALENDAR}, {_BEST_BID}, f AS (SELECT c.case_id, c.sale_date, max(e.event_date) AS cycle FROM docket_cases c LEFT JOIN case_events e ON e.case_id=c.case_id
      AND e.event_type ILIKE '%upset bid filed%' AND (c.sale_date IS NULL OR e.event_date >= c.sale_date) GROUP BY ALL)
    SELECT f.case_id, bid AS current_bid_amount, coalesce(minimum, round_even(CAST(bid AS DECIMAL(12,2))*CAST(1.05 AS DECIMAL(3,2)),2)) AS minimum_next_bid, d.deadline, coalesce(f.sale_date, report_sale_date) AS sale_date
    FROM f JOIN best_bids b ON b.case_id=f.case_id LEFT JOIN deadlines d ON d.day=coalesce(f.cycle, f.sale_date)""", money="current_bid_amount minimum_next_bid", days="deadline sale_date")
def bid_update(t):
    return K.bid_update(t.docket_cases, t.case_events, t.docket_documents)


# --- discrepancies, second source, patches ----------------------------------------------------------------------------


def _fold(x: str) -> str:
    return f"trim(regexp_replace(lower({x}),'\\s+',' ','g'))"


_DISCREPANCIES = f"""def AS (SELECT case_id, count(*) AS n, min(party_name) AS first_name, list(party_name) AS names FROM parties WHERE party_type ILIKE '%defendant%' AND party_name<>'' GROUP BY case_id),
    j AS (SELECT a.*, c.property_address, c.current_bid_amount, c.minimum_next_bid, def.n, def.first_name, def.names FROM analyses a JOIN docket_cases c ON c.case_id=a.case_id LEFT JOIN def ON def.case_id=a.case_id),
    disc AS (SELECT case_id, 'property_address' AS field, property_address AS db_value, proposed_address AS ai_value FROM j WHERE {_fold('proposed_address')}<>{_fold('property_address')}
      UNION ALL SELECT case_id, 'current_bid_amount', cast(current_bid_amount AS STRING), cast(proposed_bid AS STRING) FROM j WHERE proposed_bid<>0 AND current_bid_amount<>0 AND proposed_bid-current_bid_amount>0.01
      UNION ALL SELECT case_id, 'minimum_next_bid', cast(minimum_next_bid AS STRING), cast(proposed_minimum AS STRING) FROM j WHERE proposed_minimum<>0 AND minimum_next_bid<>0 AND proposed_minimum-minimum_next_bid>0.01
      UNION ALL SELECT case_id, 'defendant_name', CASE WHEN n>1 THEN concat(first_name,' and ',n-1,' more') ELSE first_name END, proposed_defendant FROM j
        WHERE proposed_defendant<>'' AND NOT coalesce(list_contains(list_transform(names, lambda x: {_fold('x')}), {_fold('proposed_defendant')}), false))"""


@query("discrepancies", f"WITH {_DISCREPANCIES} SELECT * FROM disc")
def discrepancies(t):
    return K.discrepancies(t.docket_cases, t.analyses, t.parties)


def _accepted(t):
    done = t.analyses.where("resolution = 'accepted'").select("case_id")
    return K.discrepancies(t.docket_cases, t.analyses, t.parties).join(done, "case_id", "left_semi")


@query("apply_accepted", f"""WITH {_DISCREPANCIES}, acc AS (SELECT * FROM disc WHERE case_id IN (SELECT case_id FROM analyses WHERE resolution='accepted')),
    w AS (SELECT case_id, max(ai_value) FILTER (field='property_address') AS a, max(ai_value) FILTER (field='current_bid_amount') AS b, max(ai_value) FILTER (field='minimum_next_bid') AS m, max(ai_value) FILTER (field='defendant_name') AS p FROM acc GROUP BY case_id)
    SELECT c.case_id, coalesce(w.a, c.property_address) AS property_address, coalesce(CAST(w.b AS DECIMAL(12,2)), c.current_bid_amount) AS current_bid_amount, coalesce(CAST(w.m AS DECIMAL(12,2)), c.minimum_next_bid) AS minimum_next_bid,
      (SELECT count(*) FROM parties x WHERE x.case_id=c.case_id) + CASE WHEN w.p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM parties y WHERE y.case_id=c.case_id AND y.party_name=w.p) THEN 1 ELSE 0 END AS parties
    FROM docket_cases c LEFT JOIN w ON w.case_id=c.case_id""", money="current_bid_amount minimum_next_bid")
def apply_accepted(t):
    cases, parties = K.apply_accepted(t.docket_cases, _accepted(t), t.parties)
    counts = parties.groupBy("case_id").agg(F.count(F.lit(1)).alias("parties"))
    return cases.select("case_id", "property_address", "current_bid_amount", "minimum_next_bid").join(counts, "case_id", "left")


_SECOND = """vals AS (SELECT case_id, arg_max(property_address, document_id) FILTER (property_address IS NOT NULL) AS a, arg_max(bid_amount, document_id) FILTER (bid_amount IS NOT NULL) AS b,
    arg_max(minimum_next_bid, document_id) FILTER (minimum_next_bid IS NOT NULL) AS m, arg_max(legal_description, document_id) FILTER (legal_description IS NOT NULL) AS l,
    arg_max(sale_date, document_id) FILTER (sale_date IS NOT NULL) AS s FROM second_source GROUP BY case_id)"""


@query("vision_merge", f"WITH {_SECOND} SELECT case_id, a AS property_address, b AS bid_amount, m AS minimum_next_bid FROM vals", money="bid_amount minimum_next_bid")
def vision_merge(t):
    return K.second_source_values(t.second_source, ["property_address", "bid_amount", "minimum_next_bid"])


@query("second_source", f"""WITH {_SECOND} SELECT c.case_id, CASE WHEN coalesce(length(a)>0 AND {FITS_SQL.format(a='a')}, false) THEN a ELSE property_address END AS property_address,
    coalesce(nullif(b,0), current_bid_amount) AS current_bid_amount, coalesce(nullif(m,0), minimum_next_bid) AS minimum_next_bid, coalesce(nullif(legal_description,''), l) AS legal_description,
    coalesce(sale_date, s) AS sale_date FROM docket_cases c JOIN vals ON vals.case_id=c.case_id""", money="current_bid_amount minimum_next_bid", days="sale_date")
def second_source(t):
    return K.merge_second_source(t.docket_cases, t.second_source)


def _patched(n: str, kind: str = "DECIMAL(12,2)") -> str:
    return f"CASE WHEN list_contains(json_keys(patch_json),'{n}') THEN TRY_CAST(patch_json->>'{n}' AS {kind}) ELSE {n} END"


_KNOWN = lambda n: f"coalesce(TRY_CAST(patch_json->>'{n}' AS DECIMAL(12,2)), {n})"
_PATCH_SQL = f"""pj AS (SELECT c.*, p.patch_json, p.patch_json->>'interest_status' AS st FROM docket_cases c JOIN case_patches p ON p.case_id=c.case_id),
    pn AS (SELECT *, {_patched('our_initial_bid')} AS n1, {_patched('our_second_bid')} AS n2, {_patched('our_max_bid')} AS n3, {_patched('estimated_rehab_cost')} AS n4, {_patched('team_notes', 'VARCHAR')} AS n5,
      CASE WHEN st IS NULL THEN interest_status ELSE nullif(st,'') END AS n6 FROM pj),
    pr AS (SELECT *, CASE WHEN st='interested' AND ({_KNOWN('estimated_sale_price')} IS NULL OR {_KNOWN('our_initial_bid')} IS NULL OR {_KNOWN('our_second_bid')} IS NULL OR {_KNOWN('our_max_bid')} IS NULL) THEN 'bid ladder incomplete'
      WHEN st='not_interested' AND trim(coalesce(patch_json->>'team_notes', team_notes, ''))='' THEN 'notes missing' WHEN st NOT IN ('interested','not_interested','') THEN 'unknown status'
      WHEN NOT (n1<=n2 AND n2<=n3) THEN 'bid ladder out of order' END AS reject_reason FROM pn)"""


@query("patch_rules", f"WITH {_PATCH_SQL} SELECT case_id, reject_reason FROM pr")
def patch_rules(t):
    return K.checked_patches(t.docket_cases, t.case_patches).select("case_id", "reject_reason")


@query("apply_patches", f"""WITH {_PATCH_SQL} SELECT c.case_id, CASE WHEN ok THEN n1 ELSE c.our_initial_bid END AS our_initial_bid, CASE WHEN ok THEN n3 ELSE c.our_max_bid END AS our_max_bid,
    CASE WHEN ok THEN n4 ELSE c.estimated_rehab_cost END AS estimated_rehab_cost, CASE WHEN ok THEN n5 ELSE c.team_notes END AS team_notes, CASE WHEN ok THEN n6 ELSE c.interest_status END AS interest_status
    FROM docket_cases c LEFT JOIN (SELECT *, reject_reason IS NULL AS ok FROM pr) pr ON pr.case_id=c.case_id""", money="our_initial_bid our_max_bid estimated_rehab_cost")
def apply_patches(t):
    return K.apply_patches(t.docket_cases, t.case_patches)[0].select(
        "case_id", "our_initial_bid", "our_max_bid", "estimated_rehab_cost", "team_notes", "interest_status")


@query("text_todo", f"""SELECT d.document_id, d.case_id, 'bid' AS wanted FROM docket_documents d JOIN docket_cases c ON c.case_id=d.case_id WHERE d.ocr_text IS NULL AND c.classification='upset_bid'
      AND c.current_bid_amount IS NULL AND {sql_any('document_name', K.SALE_PAPERS)}
    UNION ALL SELECT d.document_id, d.case_id, 'address' FROM docket_documents d JOIN docket_cases c ON c.case_id=d.case_id WHERE d.ocr_text IS NULL AND c.property_address IS NULL""")
def text_todo(t):
    return K.text_todo(t.docket_cases, t.docket_documents)
