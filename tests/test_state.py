"""Case states, one case per branch, and the properties a run must have."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docketry.operators import timeline as TL
from docketry.operators.calendar import with_deadline

AS_OF = "2024-06-14 12:00:00"  # a Friday
CASE = "case_id bigint, case_type string, classification string, sale_date date, current_bid_amount decimal(12,2), minimum_next_bid decimal(12,2), next_bid_deadline timestamp_ntz, closed_sold_at timestamp_ntz"
EVENT = "event_id bigint, case_id bigint, event_date date, event_type string"
D = dt.date

# (events, stored sale date, stored deadline, case type, expected state)
BRANCHES = {
    "withdrawn after sale": ([(D(2024, 6, 1), "Report of Sale"), (D(2024, 6, 3), "Withdrawn")], None, None, "x", "upcoming"),
    "withdrawn before sale": ([(D(2024, 6, 10), "Report of Sale"), (D(2024, 5, 3), "Withdrawn")], None, None, "x", "upset_bid"),
    "withdrawal of an upset bid": ([(D(2024, 1, 1), "Report of Sale"), (D(2024, 1, 3), "Upset Bid withdrawn")], None, None, "x", "closed_sold"),
    "undated withdrawal": ([(None, "Withdrawn"), (D(2024, 1, 2), "Notice of Hearing")], None, None, "x", "upcoming"),
    "dismissed": ([(D(2024, 1, 1), "Voluntary Dismissal")], None, None, "x", None),
    "dismissed word": ([(D(2024, 1, 1), "Case Dismissed")], None, None, "x", "closed_dismissed"),
    "motion to dismiss": ([(D(2024, 1, 1), "Motion to Dismiss")], None, None, "x", "closed_dismissed"),
    "denied motion": ([(D(2024, 1, 1), "Order denying Motion to Dismiss")], None, None, "x", None),
    "dismissed then reopened": ([(D(2024, 1, 1), "Case Dismissed"), (D(2024, 2, 1), "Order to Reopen"), (D(2024, 1, 1), "Notice of Hearing")], None, None, "x", "upcoming"),
    "reopened the same day": ([(D(2024, 1, 1), "Case Dismissed"), (D(2024, 1, 1), "Order to Reopen")], None, None, "x", "closed_dismissed"),
    "reopened undated": ([(D(2024, 1, 1), "Case Dismissed"), (None, "Order to Reopen")], None, None, "x", None),
    "sale running": ([(D(2024, 6, 10), "Report of Sale")], None, None, "x", "upset_bid"),
    "sale on its last day at noon": ([(D(2024, 6, 4), "Report of Sale")], None, None, "x", "upset_bid"),
    "sale over": ([(D(2024, 1, 2), "Report of Sale")], None, None, "x", "closed_sold"),
    "upset bid renews": ([(D(2024, 5, 2), "Report of Sale"), (D(2024, 6, 6), "Upset Bid Filed")], None, None, "x", "upset_bid"),
    "stored deadline runs": ([(D(2024, 1, 2), "Report of Sale")], D(2024, 1, 2), dt.datetime(2024, 6, 20), "x", "upset_bid"),
    "stored deadline at midnight is over": ([(D(2024, 1, 2), "Report of Sale")], D(2024, 1, 2), dt.datetime(2024, 6, 14), "x", "closed_sold"),
    "undated sale": ([(None, "Report of Sale"), (D(2024, 6, 12), "Report of Sale")], None, None, "x", "closed_sold"),
    "resale drops the stored deadline": ([(D(2024, 2, 2), "Report of Sale")], D(2024, 1, 2), dt.datetime(2024, 6, 20), "x", "closed_sold"),
    "set aside": ([(D(2024, 1, 2), "Report of Sale"), (D(2024, 2, 2), "Order to Set Aside Sale"), (D(2023, 1, 1), "Notice of Hearing")], None, None, "x", "upcoming"),
    "set aside with a live upset bid": ([(D(2024, 5, 2), "Report of Sale"), (D(2024, 6, 7), "Order to Set Aside Sale"), (D(2024, 6, 6), "Upset Bid Filed")], None, None, "x", "upset_bid"),
    "blocked inside the window": ([(D(2024, 1, 2), "Report of Sale"), (D(2024, 1, 5), "Notice of Bankruptcy")], None, None, "x", "blocked"),
    "block inside lifted": ([(D(2024, 1, 2), "Report of Sale"), (D(2024, 1, 5), "Notice of Bankruptcy"), (D(2024, 3, 1), "Order to Reopen")], None, None, "x", "upcoming"),
    "block after the window": ([(D(2024, 1, 2), "Report of Sale"), (D(2024, 2, 5), "Notice of Bankruptcy")], None, None, "x", "closed_sold"),
    "bankruptcy": ([(D(2024, 1, 5), "Suggestion of Bankruptcy")], None, None, "x", "blocked"),
    "bankruptcy relief": ([(D(2024, 1, 5), "Relief from bankruptcy stay"), (D(2024, 1, 1), "Notice of Hearing")], None, None, "x", "upcoming"),
    "resale notice lifts": ([(D(2024, 1, 5), "Notice of Bankruptcy"), (D(2024, 2, 5), "Notice Of Sale/Resale"), (D(2024, 1, 1), "Notice of Hearing")], None, None, "x", "upcoming"),
    "legacy petition": ([(D(2024, 1, 5), "Petition")], None, None, "Special Proceeding", "upcoming"),
    "legacy without case type": ([(D(2024, 1, 5), "Petition")], None, None, "Civil", None),
    "petitioner is a party": ([(D(2024, 1, 5), "Petitioner Smith")], None, None, "Special Proceeding", None),
    "canceled hearing": ([(D(2024, 1, 5), "Notice of Hearing - canceled")], None, None, "x", None),
    "nothing": ([(D(2024, 1, 5), None)], None, None, "x", None),
}
BRANCHES["dismissed"] = (*BRANCHES["dismissed"][:4], "closed_dismissed")


def tables(spark, branches, partitions=None):
    cases, events = [], []
    for i, (evs, sold, deadline, kind, _) in enumerate(branches):
        cases.append((i, kind, None, sold, None, None, deadline, None))
        events += [(i * 100 + n, i, d, k) for n, (d, k) in enumerate(evs)]
    c, e = spark.createDataFrame(cases, CASE), spark.createDataFrame(events, EVENT)
    return (c.repartition(partitions), e.repartition(partitions)) if partitions else (c, e)


@pytest.mark.parametrize("partitions", [None, 7])
def test_branches(spark, partitions):
    names = list(BRANCHES)
    cases, events = tables(spark, BRANCHES.values(), partitions)
    got = {r["case_id"]: r["new_state"] for r in TL.classify(cases, events, AS_OF).collect()}
    wrong = {n: (got[i], BRANCHES[n][4]) for i, n in enumerate(names) if got[i] != BRANCHES[n][4]}
    assert not wrong


def test_five_o_clock(spark):
    cases, events = tables(spark, [BRANCHES["sale on its last day at noon"]])
    assert TL.classify(cases, events, "2024-06-14 17:00:00").first()["new_state"] == "upset_bid"
    assert TL.classify(cases, events, "2024-06-14 17:00:01").first()["new_state"] == "closed_sold"


def test_apply_is_idempotent(spark):
    cases, events = tables(spark, BRANCHES.values())
    once = TL.apply_state(cases, events, AS_OF)
    again = TL.apply_state(once.select(*cases.columns), events, AS_OF)
    assert TL.transitions(again).count() == 0
    key = lambda df: sorted(map(str, df.select("case_id", "classification", "sale_date", "next_bid_deadline").collect()))
    assert key(once) == key(again)


def test_deadline_skips_christmas(spark):
    days = spark.createDataFrame([(D(2024, 12, 14),), (D(2021, 12, 22),)], "day date")
    got = {r["day"]: r["deadline"] for r in with_deadline(days, days.day, "deadline").collect()}
    assert got[D(2024, 12, 14)] == D(2024, 12, 27)
    # New Year's Day kept on the 31st belongs to the next year's rules and is not seen.
    assert got[D(2021, 12, 22)] == D(2022, 1, 3)


def test_the_healing_ladder_takes_each_step_once(spark):
    from docketry.operators.casework import HEAL_LEDGER, heal_due, heal_recorded

    cases = spark.createDataFrame([(1, "A", "upset_bid"), (2, "B", "upset_bid"), (3, "C", "upcoming")], "case_id bigint, case_number string, classification string").selectExpr(
        "*", "CAST(NULL AS STRING) AS property_address", "CAST(NULL AS DECIMAL(12,2)) AS current_bid_amount", "CAST(NULL AS DECIMAL(12,2)) AS minimum_next_bid",
        "CAST(NULL AS TIMESTAMP_NTZ) AS next_bid_deadline", "CAST(NULL AS DATE) AS sale_date")
    documents = spark.createDataFrame([(7, 1)], "document_id bigint, case_id bigint")
    ledger, seen = spark.createDataFrame([], HEAL_LEDGER), []
    for day in range(5):
        due = heal_due(cases, documents, ledger)
        seen.append({r.case_id: (r.step, r.attempts) for r in due.collect()})
        ledger = spark.createDataFrame(heal_recorded(ledger, due, F.lit(f"2024-06-0{day + 1} 00:00:00").cast("timestamp_ntz")).collect(), HEAL_LEDGER)
    assert [s[1] for s in seen] == [("extract", 0), ("second_text", 1), ("re_read", 2), ("exhausted", 3), ("exhausted", 3)]
    assert [s[2][0] for s in seen] == ["extract", "re_read", "exhausted", "exhausted", "exhausted"]  # no text to read again
    steps = [(r.case_id, r.step) for r in ledger.collect()]
    assert len(steps) == len(set(steps)) == 5 and 3 not in {c for c, _ in steps}
