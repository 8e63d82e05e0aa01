"""A day's run on a few cases: every result must be in the case table."""

from datetime import date, datetime
from decimal import Decimal

from docketry.streaming.daily import DailyRun

CASE = """case_id bigint, case_number string, county_code string, county_name string, case_type string, case_status string, style string, classification string,
  sale_date date, current_bid_amount decimal(12,2), minimum_next_bid decimal(12,2), next_bid_deadline timestamp_ntz, closed_sold_at timestamp_ntz,
  property_address string, legal_description string, trustee_name string, attorney_name string, is_finalized boolean, updated_at timestamp_ntz"""
EVENT = "event_id bigint, case_id bigint, event_index int, event_date date, event_type string, event_description string"


def case(n, state, sale=None, deadline=None, bid=None, final=False, address="1 Elm Street, Cary, NC 27511"):
    return (n, f"24SP{n:06d}-910", "910", "Wake", "Foreclosure", "Open", f"FORECLOSURE - Ann Lee{n}", state, sale, bid, bid, deadline, None, address, None, None, None, final, None)


def test_a_day(spark, tmp_path):
    notice = "NOTICE OF UPSET BID\nMinimum Amount Of Next Upset Bid $10,500.00\nAmount Of Deposit For Next $750.00"
    cases = spark.createDataFrame([
        case(1, "upcoming"),  # a new sale sets date and deadline, its notice the bid
        case(2, "upset_bid", date(2024, 5, 1), datetime(2024, 5, 13), Decimal(100)),  # past its deadline
        case(3, "upcoming", final=True),  # finalized: left alone
        case(4, "upset_bid", date(2024, 6, 10), datetime(2024, 6, 20), Decimal(100)),  # finalized today
    ], CASE)
    events = spark.createDataFrame([(20, 2, 1, date(2024, 5, 1), "Report of Sale", None), (40, 4, 1, date(2024, 6, 10), "Report of Sale", None), (30, 3, 1, None, "Petition", None)], EVENT)
    parsed = spark.createDataFrame([(11, 1, 1, date(2024, 6, 11), "Report of Sale", None), (31, 3, 2, date(2024, 6, 11), "Report of Sale", None),
                                    (42, 4, 2, date(2024, 6, 12), "Order Confirming Sale", None), (43, 4, 3, date(2024, 6, 13), "Final Report and Account of Foreclosure Sale", None)], EVENT)
    documents = spark.createDataFrame([(1, 1, 11, "06-11-2024_Upset Bid Filed.pdf", notice, date(2024, 6, 11))],
                                      "document_id bigint, case_id bigint, event_id bigint, document_name string, ocr_text string, document_date date")
    incoming = spark.createDataFrame([("24SP000001-910", "Foreclosure", "Pending", "FORECLOSURE - Ann Lee1"), ("24SP000008-910", "Foreclosure", "New", "FORECLOSURE - New"),
                                      ("24SP000009-910", "Special Proceeding", "New", "Name change")], "case_number string, case_type string, case_status string, style string")
    fresh = spark.createDataFrame([("24SP000008-910", date(2024, 6, 1), "Foreclosure Case Initiated", None, None), ("24SP000009-910", date(2024, 6, 1), "Name Change", None, None)],
                                  "case_number string, event_date date, event_type string, event_description string, document_title string")
    analyses = spark.createDataFrame([], "case_id bigint, status string, requested_on date")
    day = DailyRun(spark, {"cases": cases, "case_events": events, "parsed_events": parsed, "docket_documents": documents, "incoming": incoming,
                           "incoming_events": fresh, "analyses": analyses}, str(tmp_path), "2024-06-14 12:00:00")
    audit = {r.task_name: r for r in day.run().collect()}
    assert all(audit[n].status == "success" for n in ("ingest", "extract", "monitor", "validate", "stale", "heal")), [a for a in day.audit if a[4]]
    got = {r.case_number[2:10].lstrip("SP0"): r for r in day.tables["cases"].collect()}
    assert set(got) == {"1", "2", "3", "4", "8"}
    assert (got["1"].case_status, got["1"].classification, got["1"].sale_date) == ("Pending", "upset_bid", date(2024, 6, 11))
    assert (got["1"].minimum_next_bid, got["1"].current_bid_amount, got["1"].next_bid_deadline) == (Decimal("10500.00"), Decimal("10000.00"), datetime(2024, 6, 21))
    assert got["2"].classification == "closed_sold" and got["2"].closed_sold_at is not None
    assert (got["3"].classification, got["3"].sale_date, got["3"].is_finalized) == ("upcoming", None, True)
    assert got["4"].is_finalized and got["4"].finalized_at is not None and got["4"].finalized_event_id is not None
    assert got["8"].case_id is not None and got["8"].classification == "upcoming"
    assert [r.case_number for r in day.tables["quarantine_added"].collect()] == ["24SP000009-910"]
    assert "event_type" in day.tables["quarantine_added"].first().events_json
    assert {r.case_id for r in day.tables["transitions"].collect() if r.changed_at} >= {1, 2}
    day.tables.pop("cases")
    again = DailyRun(spark, {}, str(tmp_path / "broken"), "2024-06-14 12:00:00")
    failed = again.run().collect()
    assert {r.status for r in failed} == {"failed"} and all(r.error_message for r in failed)


def small_day(spark, folder, **more):
    cases = spark.createDataFrame([case(1, "upcoming"), case(2, "upset_bid", date(2024, 6, 10), datetime(2024, 6, 20), Decimal(100), address=None)], CASE)
    events = spark.createDataFrame([(20, 2, 1, date(2024, 6, 10), "Report of Sale", None)], EVENT)
    parsed = spark.createDataFrame([(11, 1, 1, date(2024, 6, 11), "Report of Sale", None)], EVENT)
    documents = spark.createDataFrame([(1, 2, 20, "06-10-2024_Report of Sale.pdf", "REPORT OF SALE Amount Bid: $100.00", date(2024, 6, 10))],
                                      "document_id bigint, case_id bigint, event_id bigint, document_name string, ocr_text string, document_date date")
    incoming = spark.createDataFrame([("24SP000008-910", "Foreclosure", "New", "FORECLOSURE - New")], "case_number string, case_type string, case_status string, style string")
    tables = {"cases": cases, "case_events": events, "parsed_events": parsed, "docket_documents": documents, "incoming": incoming,
              "analyses": spark.createDataFrame([], "case_id bigint, status string, requested_on date")} | more
    return DailyRun(spark, tables, folder, "2024-06-14 12:00:00")


def statuses(run):
    return [(r.task_name, r.status) for r in sorted(run.run().collect(), key=lambda r: r.task_order)]


def test_a_day_started_again(spark, tmp_path, monkeypatch):
    """A task that dies between two tables leaves none of them; the next start goes on there, and then nothing is left to do."""
    from docketry.streaming import daily

    whole = daily.transitions
    monkeypatch.setattr(daily, "transitions", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    day = small_day(spark, str(tmp_path))
    first = dict(statuses(day))
    assert first["monitor"] == "failed" and first["ingest"] == first["extract"] == "success"
    assert not {"events_added", "transitions", "cases_monitored"} & set(day.tables)  # staged before the failure, never seen
    assert [r.event_id for r in day.tables["case_events"].collect()] == [20]
    monkeypatch.setattr(daily, "transitions", whole)
    again = DailyRun(spark, {}, str(tmp_path), "2024-06-14 12:00:00")
    second = statuses(again)
    assert [s for s in second if s[1] == "unchanged"] == [("ingest", "unchanged"), ("extract", "unchanged")]
    assert all(s in ("unchanged", "success") for _, s in second)
    assert {r.event_id for r in again.tables["case_events"].collect()} == {20, 11}
    before = sorted(map(str, again.tables["cases"].collect()))
    third = DailyRun(spark, {}, str(tmp_path), "2024-06-14 12:00:00")
    assert {s for _, s in statuses(third)} == {"unchanged"}
    assert sorted(map(str, third.tables["cases"].collect())) == before
    ledger = third.ledger().collect()
    assert [r.task_name for r in ledger if r.status == "failed"][0] == "monitor"
    assert all(r.outputs for r in ledger if r.status == "success" and r.task_name != "second_source")


def test_a_changed_input_is_taken_up_where_it_is_read_first(spark, tmp_path):
    day = small_day(spark, str(tmp_path))
    assert {s for _, s in statuses(day)} == {"success"}
    parsed = spark.createDataFrame([(11, 1, 1, date(2024, 6, 11), "Report of Sale", None), (12, 1, 2, date(2024, 6, 12), "Upset Bid Filed", None)], EVENT)
    again = DailyRun(spark, {"parsed_events": parsed}, str(tmp_path), "2024-06-14 12:00:00")
    second = dict(statuses(again))
    assert second["ingest"] == second["extract"] == "unchanged" and second["monitor"] == "success"
    # the monitor starts from the tables as they were before it, not from its own old results
    assert sorted(r.event_id for r in again.tables["case_events"].collect()) == [11, 12, 20]
    alone = small_day(spark, str(tmp_path / "alone"), parsed_events=parsed)
    statuses(alone)
    assert sorted(map(str, again.tables["cases"].collect())) == sorted(map(str, alone.tables["cases"].collect()))


def test_children_marks_and_second_source(spark, tmp_path):
    fresh = spark.createDataFrame([("24SP000008-910", date(2024, 6, 1), "Foreclosure Case Initiated", None, None)],
                                  "case_number string, event_date date, event_type string, event_description string, document_title string")
    parties = spark.createDataFrame([("24SP000008-910", "Respondent", "Ann New"), ("24SP000001-910", "Trustee", "Old")], "case_number string, party_type string, party_name string")
    hearings = spark.createDataFrame([("24SP000008-910", 1, date(2024, 7, 1), "2:30 PM", "Foreclosure")],
                                     "case_number string, hearing_no int, hearing_date date, hearing_time string, hearing_type string")
    readings = spark.createDataFrame([(1, 2, "5 Oak Street, Raleigh, NC 27601", Decimal(250), None, None, None)],
                                     "document_id bigint, case_id bigint, property_address string, bid_amount decimal(12,2), minimum_next_bid decimal(12,2), legal_description string, sale_date date")
    day = small_day(spark, str(tmp_path), incoming_events=fresh, incoming_parties=parties, incoming_hearings=hearings, second_source=readings)
    assert {s for _, s in statuses(day)} == {"success"}, [a[4] for a in day.audit if a[4]]
    new = {r.case_number: r.case_id for r in day.tables["cases"].collect()}["24SP000008-910"]
    assert [(r.case_id, r.party_name) for r in day.tables["parties"].collect()] == [(new, "Ann New")]
    assert [(r.case_id, r.hearing_time) for r in day.tables["hearings"].collect()] == [(new, "2:30 PM")]
    documents = day.tables["docket_documents"].collect()
    assert all(r.extraction_attempted_at and r.vision_processed_at for r in documents)
    merged = {r.case_id: r for r in day.tables["cases"].collect()}[2]
    assert (merged.property_address, merged.current_bid_amount) == ("5 Oak Street, Raleigh, NC 27601", Decimal("250.00"))


def test_a_days_texts_are_read_once_a_task(spark, tmp_path, monkeypatch):
    """Healing reads the texts of its cases once, for the report and for the case table."""
    from docketry.operators import casework
    from docketry.streaming import daily

    calls, whole = [], casework.extract_cases
    for module in (casework, daily):
        monkeypatch.setattr(module, "extract_cases", lambda *a: calls.append(a) or whole(*a))
    day = small_day(spark, str(tmp_path))
    assert {s for _, s in statuses(day)} == {"success"}
    assert len(calls) == 2  # extract and heal
    healed = {r.case_id: r for r in day.tables["healed"].collect()}
    assert set(healed) == {1, 2} and "property_address" in healed[2].missing_after


def test_order_lines_are_numbered_once(spark, tmp_path):
    from docketry.plans.intake_queries import day_tables
    from docketry.sources.sample_views import SampleTables
    from docketry.sources.versions import TableStore

    t = SampleTables(spark, "/root/testdata/sf0.001")
    store = TableStore(spark, str(tmp_path))
    made = day_tables(t, store)
    assert not [n for n, df in made.items() if "row_number" in df._jdf.queryExecution().optimizedPlan().toString()]
    newest = store.snapshot()
    assert set(newest.tables) == {"cases", "case_events", "docket_documents", "parties", "hearings"}
    for name in ("docket_documents", "hearings", "parties", "case_events"):
        stored, direct = store.read(name, newest), getattr(t, name)
        assert stored.columns == direct.columns and stored.exceptAll(direct).count() == direct.exceptAll(stored).count() == 0
    for name in ("parsed_events", "analyses", "second_source"):
        direct = getattr(t, name)
        assert made[name].select(*direct.columns).exceptAll(direct).count() == direct.exceptAll(made[name].select(*direct.columns)).count() == 0
