"""The store of several tables: all changes of a transaction are seen together, or none is."""

import pytest

from docketry.operators.maintenance import delete_cases, delete_events
from docketry.sources.versions import Conflict, TableStore


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


def table(spark, *values):
    return spark.createDataFrame([(v, f"t{v}") for v in values], "case_id long, name string")


def test_tables_change_together(spark, store):
    assert store.snapshot().number == 0
    with store.begin() as t:
        t.write("cases", table(spark, 1, 2))
        t.write("events", table(spark, 1), buckets=4)
        assert store.snapshot().number == 0  # nothing is seen before the commit
        t.commit({"what": "first"})
    first = store.snapshot()
    assert (first.number, first.note) == (1, {"what": "first"})
    with store.begin() as t:
        t.write("events", table(spark, 5))
        t.write("events", table(spark, 5, 6))  # staged again: the last one counts
        t.commit()
    second = store.snapshot()
    assert rows(store.read("events")) == [(5, "t5"), (6, "t6")] and rows(store.read("events", first)) == [(1, "t1")]
    assert second.folder("cases") == first.folder("cases")  # what is not written is not copied


def test_a_run_that_dies_leaves_the_old_version_whole(spark, store):
    with store.begin() as t:
        t.write("cases", table(spark, 1))
        t.write("events", table(spark, 1))
        t.commit()
    with pytest.raises(RuntimeError, match="killed"), store.begin() as t:
        t.write("cases", table(spark, 1, 2))
        raise RuntimeError("killed between two tables")
    dead = store.begin()
    dead.write("cases", table(spark, 9))  # a process that just ends: neither commit nor abort
    assert store.snapshot().number == 1
    assert rows(store.read("cases")) == rows(store.read("events")) == [(1, "t1")]
    store.vacuum()
    assert rows(dead.read("cases")) == [(9, "t9")]  # not named by a version, so it may still be under way


def test_two_transactions_on_one_version(spark, store):
    a, b = store.begin(), store.begin()
    a.write("cases", table(spark, 1))
    b.write("cases", table(spark, 2))
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert rows(store.read("cases")) == [(1, "t1")]


def test_vacuum_keeps_what_readers_may_hold(spark, store):
    for n in range(4):
        with store.begin() as t:
            t.write("cases", table(spark, n))
            if n == 0:
                t.write("users", table(spark, 7))
            t.commit()
    held = store.read("cases", store.snapshot(3))
    assert store.vacuum(keep=2) == 2
    assert store.numbers() == [3, 4] and rows(held) == [(2, "t2")] and rows(store.read("users")) == [(7, "t7")]


def test_another_session_reads_buckets(spark, store):
    with store.begin() as t:
        t.write("cases", table(spark, *range(50)), buckets=4)
        t.write("events", table(spark, *range(0, 50, 2)), buckets=4)
        t.commit()
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    again = TableStore(other, store.root)
    joined = again.read("cases").join(again.read("events").withColumnRenamed("name", "event"), "case_id")
    assert joined.count() == 25
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan


def test_cascades(spark):
    cases = spark.createDataFrame([(1, 11), (2, 21), (3, None)], "case_id long, finalized_event_id long")
    events = spark.createDataFrame([(11, 1), (21, 2), (22, 2), (31, 3)], "event_id long, case_id long")
    documents = spark.createDataFrame([(5, 1, 11), (6, 2, 21), (7, 2, None)], "document_id long, case_id long, event_id long")
    left = delete_cases({"cases": cases, "case_events": events, "docket_documents": documents}, cases.where("case_id = 1"))
    assert {n: df.count() for n, df in left.items()} == {"cases": 2, "case_events": 3, "docket_documents": 2}
    less = delete_events({"cases": cases, "case_events": events, "docket_documents": documents}, events.where("event_id = 21"))
    assert {r.document_id: r.event_id for r in less["docket_documents"].collect()} == {5: 11, 6: None, 7: None}
    assert {r.case_id: r.finalized_event_id for r in less["cases"].collect()} == {1: 11, 2: None, 3: None}
    assert {r.event_id for r in less["case_events"].collect()} == {11, 22, 31}


def test_case_detail_moves_once_over_placed_tables(spark):
    from docketry.plans import serving
    from docketry.plans.serve_queries import placed_tables
    from docketry.sources.sample_views import SampleTables

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        detail = serving.case_detail(**placed_tables(SampleTables(spark, "/root/testdata/sf0.001"), 8), user_id=1, placed=8)
        detail.collect()
        plan = detail._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") + final.count("Exchange rangepartitioning") <= 1
