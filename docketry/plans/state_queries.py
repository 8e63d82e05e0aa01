"""Registered queries: case-state engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.predicates import event_flags, event_matches, is_foreclosure_type, monitor_flags
from docketry.operators import timeline as TL
from docketry.plans.registry import SQL_CALENDAR, query, sql_any, sql_rule
from docketry.sources.sample_views import AS_OF

E_TYPE = "event_type"
_FLAG_SQL = {
    "is_sale": sql_rule(E_TYPE, R.SALE_REPORT),
    "is_sale_baseline": sql_rule(E_TYPE, R.SALE_BASELINE),
    "is_confirmed": sql_rule(E_TYPE, R.SALE_CONFIRMED, R.SALE_CONFIRMED_NOT),
    "is_set_aside": sql_rule(E_TYPE, R.SET_ASIDE),
    "is_bankruptcy": sql_rule(E_TYPE, R.BANKRUPTCY, R.BANKRUPTCY_NOT),
    "is_lifted": sql_rule(E_TYPE, R.LIFTED),
    "is_dismissal": sql_rule(E_TYPE, R.DISMISSAL, R.DISMISSAL_NOT),
    "is_reversed": sql_rule(E_TYPE, R.REVERSED),
    "is_upset": sql_rule(E_TYPE, R.UPSET_FILED),
    "is_upset_filed": sql_any(E_TYPE, ["upset bid filed"]),
    "is_initiated": sql_rule(E_TYPE, R.INITIATED, R.INITIATED_NOT),
    "is_legacy": "((" + " OR ".join(f"lower(coalesce(event_type,''))='{k}' OR starts_with(lower(coalesce(event_type,'')), '{k} ')" for k in R.LEGACY)
                 + f") AND NOT {sql_any(E_TYPE, R.LEGACY_NOT)})",
    "is_withdrawn": sql_rule(E_TYPE, ["withdrawn"], ["upset bid"]),
    "is_final": sql_rule(E_TYPE, R.FINALIZATION),
}
_FLAGS = "flagged AS (SELECT *, " + ", ".join(f"{c} AS {n}" for n, c in _FLAG_SQL.items()) + " FROM case_events)"


def _latest(name: str, flag: str) -> str:
    return (f"{name} AS (SELECT case_id, event_date, event_id, event_type FROM flagged WHERE {flag} QUALIFY "
            "row_number() OVER (PARTITION BY case_id ORDER BY event_date DESC NULLS FIRST, event_id DESC)=1)")


_KINDS = {"withdrawn": "is_withdrawn", "dismissed": "is_dismissal", "reversed": "is_reversed", "sale": "is_sale",
          "upset": "is_upset", "bankruptcy": "is_bankruptcy", "lifted": "is_lifted"}
_CLASSIFY = f"""
{_FLAGS},
{", ".join(_latest("k_" + n, f) for n, f in _KINDS.items())},
k_filed AS (SELECT case_id, max(event_date) AS event_date FROM flagged WHERE is_upset_filed GROUP BY case_id),
k_aside AS (SELECT case_id, max(event_date) AS event_date FROM flagged WHERE is_set_aside GROUP BY case_id),
k_base AS (SELECT case_id, count(*) AS n, min(event_date) AS first_date FROM flagged WHERE is_sale_baseline GROUP BY case_id),
k_any AS (SELECT case_id, bool_or(is_initiated) AS initiated, bool_or(is_legacy) AS legacy FROM flagged GROUP BY case_id),
step1 AS (SELECT c.*, {", ".join(f"k_{n}.case_id IS NOT NULL AS has_{n}, k_{n}.event_date AS {n}_day" for n in _KINDS)},
    k_filed.event_date AS filed_day, k_aside.event_date AS aside_day, k_base.n AS base_n, k_base.first_date AS base_day,
    k_any.initiated, k_any.legacy
  FROM docket_cases c {" ".join(f"LEFT JOIN k_{n} ON k_{n}.case_id=c.case_id" for n in [*_KINDS, "filed", "aside", "base", "any"])}),
step2 AS (SELECT *,
    has_withdrawn AND withdrawn_day IS NOT NULL AND (sale_day IS NULL OR withdrawn_day >= sale_day) AS is_out,
    has_dismissed AND NOT (has_reversed AND (reversed_day IS NULL OR dismissed_day IS NULL OR reversed_day > dismissed_day)) AS is_closed
  FROM step1),
step3 AS (SELECT *, NOT is_out AND NOT is_closed AND has_sale AS in_sale,
    coalesce(sale_date, CASE WHEN base_n > 1 THEN base_day END) AS base FROM step2),
step4 AS (SELECT *, coalesce(in_sale AND sale_day > base, false) AS is_resale,
    coalesce(in_sale AND aside_day > sale_day, false) AS is_set_aside FROM step3),
step5 AS (SELECT *, CASE WHEN is_set_aside THEN NULL WHEN is_resale THEN sale_day WHEN in_sale THEN coalesce(sale_date, sale_day)
      ELSE sale_date END AS new_sale_date,
    CASE WHEN is_resale OR is_set_aside THEN NULL ELSE next_bid_deadline END AS kept_deadline,
    CASE WHEN is_set_aside OR sale_day IS NULL THEN NULL WHEN upset_day > sale_day THEN upset_day ELSE sale_day END AS ref
  FROM step4),
step6 AS (SELECT step5.*, CASE WHEN new_sale_date IS NULL OR filed_day >= new_sale_date THEN filed_day END AS cycle FROM step5),
step7 AS (SELECT step6.*, dc.deadline AS cycle_deadline, dr.deadline AS ref_deadline FROM step6
  LEFT JOIN deadlines dc ON dc.day = cycle LEFT JOIN deadlines dr ON dr.day = ref),
step8 AS (SELECT *, CASE
    WHEN is_out THEN 'upcoming' WHEN is_closed THEN 'closed_dismissed'
    WHEN in_sale AND DATE '1998-06-15' <= cycle_deadline THEN 'upset_bid'
    WHEN in_sale AND TIMESTAMP '1998-06-15 12:00:00' <= kept_deadline THEN 'upset_bid'
    WHEN in_sale AND TIMESTAMP '1998-06-15 12:00:00' <= ref_deadline + INTERVAL 17 HOUR THEN 'upset_bid'
    WHEN in_sale AND bankruptcy_day > ref AND bankruptcy_day <= ref_deadline
      THEN CASE WHEN lifted_day > bankruptcy_day THEN 'upcoming' ELSE 'blocked' END
    WHEN in_sale AND NOT is_set_aside THEN 'closed_sold'
    WHEN has_bankruptcy AND NOT (has_lifted AND (lifted_day IS NULL OR bankruptcy_day IS NULL OR lifted_day > bankruptcy_day)) THEN 'blocked'
    WHEN initiated THEN 'upcoming'
    WHEN legacy AND (contains(lower(case_type),'foreclosure') OR lower(case_type)='special proceeding') THEN 'upcoming'
  END AS new_state FROM step7)"""
CLASSIFY = f"WITH {SQL_CALENDAR}, {_CLASSIFY}"
_APPLY = """,
step9 AS (SELECT step8.*, CASE WHEN filed_day >= new_sale_date THEN filed_day ELSE new_sale_date END AS repair_day FROM step8),
step10 AS (SELECT step9.*, dd.deadline AS repaired FROM step9 LEFT JOIN deadlines dd ON dd.day = repair_day)"""


@query("event_rules", f"""SELECT case_id, event_id, {sql_rule(E_TYPE, R.BANKRUPTCY, R.BANKRUPTCY_NOT)} AS plain_hit,
       {_FLAG_SQL['is_legacy']} AS strict_hit FROM case_events""")
def event_rules(t):
    e = F.col("event_type")
    return t.case_events.select(
        "case_id", "event_id", event_matches(e, R.BANKRUPTCY, R.BANKRUPTCY_NOT).alias("plain_hit"),
        event_matches(e, R.LEGACY, R.LEGACY_NOT, strict=True).alias("strict_hit"))


@query("event_flags", f"WITH {_FLAGS} SELECT event_id, {', '.join(_FLAG_SQL)} FROM flagged")
def flags(t):
    return t.case_events.select("event_id", *[c.alias(n) for n, c in event_flags(F.col("event_type")).items()])


@query("monitor_flags", f"""SELECT event_id, {sql_any(E_TYPE, R.SALE_REPORT)} AS is_sale,
       {sql_any(E_TYPE, R.UPSET_FILED)} AS is_upset, {sql_any(E_TYPE, R.BANKRUPTCY + R.DISMISSAL)} AS is_blocking
       FROM case_events""")
def monitor(t):
    return t.case_events.select("event_id", *[c.alias(n) for n, c in monitor_flags(F.col("event_type")).items()])


@query("fc_case_type", """SELECT case_type, contains(lower(case_type),'foreclosure') OR lower(case_type)='special proceeding'
       AS is_foreclosure, count(*) AS cases FROM cases GROUP BY ALL""")
def fc_case_type(t):
    return t.cases.groupBy("case_type", is_foreclosure_type(F.col("case_type")).alias("is_foreclosure")).agg(
        F.count(F.lit(1)).alias("cases"))


@query("latest_event", f"WITH {_FLAGS}, {_latest('k', 'is_sale')} SELECT case_id, event_date, event_id, event_type FROM k",
       days="event_date")
def latest_event(t):
    return TL.latest_event(t.case_events, event_flags(F.col("event_type"))["is_sale"])


@query("baseline_sale", f"""WITH {_FLAGS} SELECT case_id, count(*) AS sale_events, min(event_date) AS baseline_date
       FROM flagged WHERE is_sale_baseline GROUP BY case_id HAVING count(*) > 1""", days="baseline_date")
def baseline_sale(t):
    return TL.baseline_sale(t.case_events)


@query("cycle_upset", f"""WITH {_FLAGS}, f AS (SELECT c.case_id, max(event_date) AS cycle_upset FROM docket_cases c
       JOIN flagged e ON e.case_id=c.case_id AND is_upset_filed AND (c.sale_date IS NULL OR event_date >= c.sale_date)
       GROUP BY c.case_id) SELECT c.case_id, c.sale_date, f.cycle_upset FROM docket_cases c LEFT JOIN f ON f.case_id=c.case_id""",
       days="sale_date cycle_upset")
def cycle_upset(t):
    return TL.cycle_upset(t.docket_cases.select("case_id", "sale_date"), t.case_events)


@query("classify", CLASSIFY + " SELECT case_id, new_state, new_sale_date, is_resale, is_set_aside FROM step8",
       days="new_sale_date")
def classify(t):
    return TL.classify(t.docket_cases, t.case_events, AS_OF).select(
        "case_id", "new_state", "new_sale_date", "is_resale", "is_set_aside")


@query("withdrawn", CLASSIFY + " SELECT case_id, withdrawn_day AS withdrawn, is_out AS holds FROM step8 WHERE has_withdrawn AND withdrawn_day IS NOT NULL",
       days="withdrawn")
def withdrawn(t):
    day = lambda n: F.nullif(F.col(n), F.lit("9999-12-31").cast("date"))
    line = TL.case_timeline(t.case_events)
    return line.where(day("withdrawn").isNotNull()).select(
        "case_id", "withdrawn", (day("sale").isNull() | (day("withdrawn") >= day("sale"))).alias("holds"))


@query("resale", CLASSIFY + """ SELECT case_id, new_sale_date, CASE WHEN is_resale OR is_set_aside THEN NULL ELSE current_bid_amount END AS bid,
       kept_deadline AS deadline FROM step8 WHERE is_resale""", money="bid", days="new_sale_date", moments="deadline")
def resale(t):
    return TL.classify(t.docket_cases, t.case_events, AS_OF).where("is_resale").select(
        "case_id", "new_sale_date", F.col("kept_current_bid_amount").alias("bid"),
        F.col("kept_next_bid_deadline").alias("deadline"))


@query("set_aside", CLASSIFY + " SELECT case_id, aside_day AS set_aside, new_state FROM step8 WHERE is_set_aside", days="set_aside")
def set_aside(t):
    return TL.classify(t.docket_cases, t.case_events, AS_OF).where("is_set_aside").select(
        "case_id", "set_aside", "new_state")


@query("sale_branch", CLASSIFY + """ SELECT new_state, count(*) AS cases, count(cycle_deadline) AS with_cycle_deadline,
       min(cycle_deadline) AS first_cycle_deadline FROM step8 WHERE in_sale GROUP BY new_state""", days="first_cycle_deadline")
def sale_branch(t):
    day = lambda n: F.nullif(F.col(n), F.lit("9999-12-31").cast("date"))
    c = TL.classify(t.docket_cases, t.case_events, AS_OF)
    out = F.coalesce(day("withdrawn").isNotNull() & (day("sale").isNull() | (day("withdrawn") >= day("sale"))), F.lit(False))
    cured = F.col("reversed").isNotNull() & (
        day("dismissed").isNull() | day("reversed").isNull() | (day("reversed") > day("dismissed")))
    closed = F.col("dismissed").isNotNull() & ~F.coalesce(cured, F.lit(False))
    return c.where(F.col("sale").isNotNull() & ~out & ~closed).groupBy("new_state").agg(
        F.count(F.lit(1)).alias("cases"), F.count("cycle_deadline").alias("with_cycle_deadline"),
        F.min("cycle_deadline").alias("first_cycle_deadline"))


@query("block_window", CLASSIFY + """ SELECT case_id, new_state, bankruptcy_day AS bankruptcy FROM step8
       WHERE in_sale AND NOT is_set_aside AND new_state IN ('blocked','upcoming')""", days="bankruptcy")
def block_window(t):
    c = TL.classify(t.docket_cases, t.case_events, AS_OF)
    inside = F.col("new_state").isin(R.BLOCKED, R.UPCOMING) & F.col("sale").isNotNull() & ~F.col("is_set_aside")
    # A withdrawn foreclosure is upcoming too, without any sale test.
    day = lambda n: F.nullif(F.col(n), F.lit("9999-12-31").cast("date"))
    out = F.coalesce(day("withdrawn").isNotNull() & (day("sale").isNull() | (day("withdrawn") >= day("sale"))), F.lit(False))
    return c.where(inside & ~out).select("case_id", "new_state", "bankruptcy")


@query("temporal_flags", CLASSIFY + """ SELECT case_id, coalesce(aside_day > sale_day, false) AS aside_after_sale,
       coalesce(lifted_day > bankruptcy_day, false) AS lifted_after_block,
       coalesce(withdrawn_day >= sale_day, false) AS withdrawn_after_sale FROM step8""")
def temporal_flags(t):
    day = lambda n: F.nullif(F.col(n), F.lit("9999-12-31").cast("date"))
    line = t.docket_cases.select("case_id").join(TL.case_timeline(t.case_events), "case_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return line.select(
        "case_id", no(F.col("set_aside") > day("sale")).alias("aside_after_sale"),
        no(day("lifted") > day("bankruptcy")).alias("lifted_after_block"),
        no(day("withdrawn") >= day("sale")).alias("withdrawn_after_sale"))


_APPLIED = """ SELECT case_id, classification AS old_classification, new_state AS classification,
    CASE WHEN new_state='closed_sold' AND classification IS DISTINCT FROM 'closed_sold' THEN TIMESTAMP '1998-06-15 12:00:00'
         WHEN new_state IS DISTINCT FROM 'closed_sold' AND classification='closed_sold' THEN NULL
         WHEN is_resale OR is_set_aside THEN NULL ELSE closed_sold_at END AS closed_sold_at,
    CASE WHEN new_state='upset_bid' AND new_sale_date IS NOT NULL AND (kept_deadline IS NULL OR CAST(kept_deadline AS DATE) < new_sale_date)
         THEN CAST(repaired AS TIMESTAMP) ELSE kept_deadline END AS next_bid_deadline, new_sale_date AS sale_date FROM step10"""


@query("apply_state", CLASSIFY + _APPLY + _APPLIED, days="sale_date", moments="closed_sold_at next_bid_deadline")
def apply_state(t):
    return TL.apply_state(t.docket_cases, t.case_events, AS_OF).select(
        "case_id", "old_classification", "classification", "closed_sold_at", "next_bid_deadline", "sale_date")


@query("transitions", CLASSIFY + """ SELECT case_id, classification AS old_classification, new_state AS new_classification,
       'scrape' AS "trigger" FROM step8 WHERE classification IS DISTINCT FROM new_state""")
def transitions(t):
    return TL.transitions(TL.apply_state(t.docket_cases, t.case_events, AS_OF))


@query("keep_state", CLASSIFY + " SELECT case_id, coalesce(new_state, classification) AS classification FROM step8")
def keep_state(t):
    return TL.apply_state(t.docket_cases, t.case_events, AS_OF, keep_when_null=True).select(
        "case_id", "classification")


@query("trigger_rows", CLASSIFY + """ SELECT case_id, case_number FROM step8
       WHERE new_state='upset_bid' AND classification IS DISTINCT FROM 'upset_bid'""")
def trigger_rows(t):
    return TL.entered_state(TL.apply_state(t.docket_cases, t.case_events, AS_OF)).select("case_id", "case_number")


@query("stale_pass", CLASSIFY + """, stale AS (SELECT step8.*,
      CASE WHEN sale_date IS NULL OR filed_day >= sale_date THEN filed_day END AS stored_cycle FROM step8
      WHERE classification='upset_bid' AND next_bid_deadline < TIMESTAMP '1998-06-15 12:00:00')
    SELECT case_id, CASE WHEN DATE '1998-06-15' <= d.deadline THEN 'upset_bid' ELSE new_state END AS new_state,
      CASE WHEN DATE '1998-06-15' <= d.deadline THEN CAST(d.deadline AS TIMESTAMP) ELSE next_bid_deadline END AS next_bid_deadline,
      coalesce(DATE '1998-06-15' <= d.deadline, false) AS was_extended,
      TIMESTAMP '1998-06-15 12:00:00' > next_bid_deadline + INTERVAL 17 HOUR AS is_past_close
    FROM stale LEFT JOIN deadlines d ON d.day = stored_cycle""", moments="next_bid_deadline")
def stale_pass(t):
    return TL.stale_pass(t.docket_cases, t.case_events, AS_OF)


@query("finalize", f"""WITH {_FLAGS}, {_latest('k', 'is_final')}
       SELECT c.case_id, c.is_finalized OR k.case_id IS NOT NULL AS is_finalized,
         CASE WHEN NOT c.is_finalized THEN k.event_id END AS finalized_event_id,
         CASE WHEN NOT c.is_finalized AND k.case_id IS NOT NULL THEN TIMESTAMP '1998-06-15 12:00:00' END AS finalized_at
       FROM docket_cases c LEFT JOIN k ON k.case_id=c.case_id""", moments="finalized_at")
def finalize(t):
    return TL.finalize(t.docket_cases, t.case_events, AS_OF).select(
        "case_id", "is_finalized", "finalized_event_id", "finalized_at")


@query("sale_on_upcoming", f"""WITH {SQL_CALENDAR}, {_FLAGS.replace('FROM case_events', 'FROM parsed_events')},
       k AS (SELECT case_id, max(event_date) AS d FROM flagged WHERE is_sale AND event_date IS NOT NULL GROUP BY case_id)
       SELECT c.case_id, k.d AS sale_date, CAST(deadlines.deadline AS TIMESTAMP) AS next_bid_deadline
       FROM docket_cases c JOIN k ON k.case_id=c.case_id JOIN deadlines ON deadlines.day=k.d
       WHERE c.classification='upcoming'""", days="sale_date", moments="next_bid_deadline")
def sale_on_upcoming(t):
    return TL.sale_on_upcoming(t.docket_cases, t.parsed_events)


@query("fix_deadlines", f"""WITH {SQL_CALENDAR}, k AS (SELECT case_id, max(event_date) AS d FROM case_events
         WHERE event_date IS NOT NULL AND event_type ILIKE '%sale%' GROUP BY case_id)
       SELECT c.case_id, k.d AS sale_date, CAST(deadlines.deadline AS TIMESTAMP) AS next_bid_deadline
       FROM docket_cases c JOIN k ON k.case_id=c.case_id JOIN deadlines ON deadlines.day=k.d
       WHERE c.classification='upset_bid' AND c.next_bid_deadline IS NULL""", days="sale_date", moments="next_bid_deadline")
def fix_deadlines(t):
    return TL.repair_missing_deadlines(t.docket_cases, t.case_events)
