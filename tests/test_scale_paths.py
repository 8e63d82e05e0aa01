"""The paths huge groups take, against brute force, and what must hold when work is repeated."""

import random
from datetime import date
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.operators.documents import link_by_start, select_corpus
from docketry.operators.extraction import joined_address
from docketry.operators.parcels import join_valuations, match_parcels, match_street_ranges
from docketry.operators.ranking import running_total
from docketry.plans.case_queries import named_filings
from docketry.plans.catalog import QUERIES
from docketry.plans.intake_queries import CHUNK, result_pages
from docketry.plans.serving import case_page
from docketry.streaming.intake import EventIntake, new_events


def test_bucketed_ranks_equal_plain_ones(spark):
    random.seed(1)
    rows = [(k, random.randrange(5), random.randrange(1000), i) for i in range(400) for k in ([1] if i % 3 else [1, 2])]
    df = spark.createDataFrame(rows, "k int, b int, v int, i int")
    got = running_total(df, ["k"], ["b"], [F.col("v"), F.col("i")], F.col("v"), "s")
    plain = Window.partitionBy("k").orderBy("b", "v", "i").rowsBetween(Window.unboundedPreceding, 0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.withColumn("s", F.sum("v").over(plain)).collect()))


def test_corpus_is_greedy(spark):
    random.seed(2)
    docs = [(i, i % 3, "order.pdf" if i % 2 else "receipt.pdf", "x" * random.choice([1, 3, 7, 20, 60]) + str(i), None) for i in range(300)]
    frame = spark.createDataFrame(docs, "document_id bigint, case_id bigint, document_name string, ocr_text string, document_date date")
    cases = spark.createDataFrame([(c, f"24SP00000{c}-910") for c in range(3)], "case_id bigint, case_number string")
    got = {}
    for r in select_corpus(frame, cases, budget=200, per_document=40).orderBy("case_id", "position").collect():
        got.setdefault(r["case_id"], []).append(r["document_id"])
    for case in range(3):
        used, want = 0, []
        for i, _, name, text, _ in sorted((d for d in docs if d[1] == case), key=lambda d: (2 if d[2] == "order.pdf" else 4, d[0])):
            size = min(len(text), 40)
            if used + size <= 200:
                used, want = used + size, want + [i]
        assert got[case] == want


def test_street_ranges(spark):
    random.seed(3)
    streets = [(f"{i:04d}", "", "OAK", *random.choice([(None, None), tuple(sorted(random.sample(range(1, 6000), 2)))])) for i in range(30)][1:]
    streets = [s for s in streets if s[3] is not None][:12]
    frame = spark.createDataFrame(streets, "account_id string, prefix string, street_name string, low_num int, high_num int")
    asked = [(n, str(n), None, "OAK") for n in range(1, 6100, 37)]
    got = {r["case_id"]: r["account_id"] for r in match_street_ranges(
        spark.createDataFrame(asked, "case_id bigint, stnum string, prefix string, name string"), frame).collect()}
    for n, *_ in asked:
        assert got[n] == min((s[0] for s in streets if s[3] <= n <= s[4]), default=None)


def test_context_reaches_over_documents(spark):
    docs = [(1, 7, "Address of Trustee"), (2, 7, "Property Address: 5 Elm Street, Cary, NC 27511"), (3, 7, "commonly known as 9 Oak Road, Apex, NC 27502 x"),
            (4, 8, "Trustee " + "z" * 300), (5, 8, "Property Address: 5 Elm Street, Cary, NC 27511")]
    frame = spark.createDataFrame(docs, "document_id bigint, case_id bigint, ocr_text string")
    got = {r["case_id"]: (r["address"], r["quality"]) for r in joined_address(frame, chunk_rows=2).collect()}
    assert got == {8: ("5 Elm Street, Cary, NC 27511", 10)}


def test_link_by_start(spark):
    events = spark.createDataFrame([(1, 1, "1998-01-02", "Amended Report of Foreclosure Sale Filed"), (2, 1, "1998-01-02", "Order")], "event_id bigint, case_id bigint, d string, event_type string").withColumn("event_date", F.to_date("d"))
    docs = spark.createDataFrame([(1, 1, None, "01-02-1998_Report of Foreclosure Sale (1).pdf"), (2, 1, None, "01-02-1998_order.pdf"), (3, 1, None, "01-02-1998_Deed.pdf")],
                                 "document_id bigint, case_id bigint, event_id bigint, document_name string")
    assert {r["document_id"]: r["event_id"] for r in link_by_start(docs, events).collect()} == {1: 1, 2: 2, 3: None}


def test_new_events_twice_adds_nothing(spark):
    schema = "case_id bigint, event_index int, event_date date, event_type string"
    stored = spark.createDataFrame([(1, 1, None, "A"), (2, None, None, "B")], schema)
    parsed = spark.createDataFrame([(1, 1, None, "A"), (1, 2, None, "C"), (2, None, None, " b "), (2, None, None, "D"), (2, None, None, None), (3, 5, None, "E")], schema)
    added = new_events(stored, parsed)
    assert sorted(r["event_type"] for r in added.collect()) == ["C", "D", "E"]
    assert new_events(stored.unionByName(added), parsed).count() == 0


def test_batch_run_again_changes_nothing(spark, tmp_path):
    cases = spark.createDataFrame([(1, "24SP000001-910", "Foreclosure", "upcoming", None, None, None, None, None)],
                                  "case_id bigint, case_number string, case_type string, classification string, sale_date date, current_bid_amount decimal(12,2), minimum_next_bid decimal(12,2), next_bid_deadline timestamp_ntz, closed_sold_at timestamp_ntz")
    batch = lambda i, kind: spark.createDataFrame([(i, 1, i, kind, None)], "event_id bigint, case_id bigint, event_index int, event_type string, event_description string").withColumn("event_date", F.to_date(F.lit("2024-01-02")))
    taken = EventIntake(cases, str(tmp_path / "store"), "2024-06-14 12:00:00")
    taken.take_batch(batch(1, "Notice of Hearing"), 0)
    taken.take_batch(batch(2, "Report of Sale"), 1)
    taken.take_batch(batch(2, "Report of Sale"), 1)
    assert taken.stored_events().count() == 2
    assert [(r.case_id, r.classification) for r in taken.states().collect()] == [(1, "closed_sold")]
    assert [(r.old_classification, r.new_classification) for r in taken.transitions().orderBy("batch_id").collect()][-1][1] == "closed_sold"


def test_a_resale_in_a_later_batch_clears_the_bids(spark, tmp_path):
    fields = "case_id bigint, case_number string, case_type string, classification string, sale_date date, current_bid_amount decimal(12,2), minimum_next_bid decimal(12,2), next_bid_deadline timestamp_ntz, closed_sold_at timestamp_ntz"
    cases = spark.createDataFrame([(n, f"24SP00000{n}-910", "Foreclosure", "upcoming", None, Decimal(100 * n), Decimal(105 * n), None, None) for n in (1, 2, 3)], fields)
    event = lambda i, case, day, kind: spark.createDataFrame([(i, case, i, day, kind, None)], "event_id bigint, case_id bigint, event_index int, event_date date, event_type string, event_description string")
    taken = EventIntake(cases, str(tmp_path / "store"), "2024-06-14 12:00:00", buckets=2)
    taken.take_batch(event(1, 1, date(2024, 3, 1), "Report of Sale"), 0)
    taken.take_batch(event(2, 2, date(2024, 6, 10), "Report of Sale"), 1)
    first = {r.case_id: r for r in taken.states().collect()}
    assert (first[1].classification, first[1].sale_date, first[1].current_bid_amount) == ("closed_sold", date(2024, 3, 1), 100)
    assert (first[2].classification, first[3].classification) == ("upset_bid", "upcoming") and first[1].closed_sold_at is not None
    taken.take_batch(event(3, 1, date(2024, 6, 12), "Report of Sale"), 2)
    taken.take_batch(event(3, 1, date(2024, 6, 12), "Report of Sale"), 2)
    again = {r.case_id: r for r in taken.states().collect()}
    assert (again[1].classification, again[1].sale_date, again[1].current_bid_amount, again[1].closed_sold_at) == ("upset_bid", date(2024, 6, 12), None, None)
    assert again[2] == first[2] and again[3] == first[3]
    assert sorted((r.batch_id, r.case_id, r.new_classification) for r in taken.transitions().collect()) == [(0, 1, "closed_sold"), (1, 2, "upset_bid"), (2, 1, "upset_bid")]
    assert sorted((r.batch_id, r.case_number) for r in taken.triggers().collect()) == [(1, "24SP000002-910"), (2, "24SP000001-910")]
    assert taken.compact() >= 1 and {r.case_id: r for r in taken.states().collect()} == again and taken.compact() == 0


def test_pages_cover_everything_once(spark):
    cases = spark.range(45).select(F.col("id").alias("case_id"), (F.col("id") % 4).cast("decimal(12,2)").alias("current_bid_amount"), F.lit(None).cast("date").alias("file_date"))
    seen = [r["case_id"] for p in range(1, 6) for r in case_page(cases, "current_bid_amount", page=p, size=10).collect()]
    assert len(seen) == 45 and len(set(seen)) == 45
    assert case_page(cases, "no such column", size=500).count() == 45


def test_event_views_read_the_fact_table_once(spark):
    plan = QUERIES["event_flags"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1
    executed = QUERIES["event_flags"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") <= 1


def test_parcels_counted_at_every_level(spark):
    parcels = spark.createDataFrame(
        [("a", "12", "N", "Oak", "RA"), ("a", "12", "N", "Oak", "CA"), ("b", "12", "S", "Oak", "CA"), ("c", "7", None, "Elm", None)],
        "account_id string, stnum string, prefix string, street_name string, etj string")
    addresses = spark.createDataFrame(
        [(1, "12", "N", "Oak", None), (2, "12", None, "Oak", "Cary"), (3, "12", "S", "oak", "Cary"), (4, "7", None, "Elm", "Apex"),
         (5, None, None, None, None)], "case_id long, stnum string, prefix string, name string, city string")
    got = {r.case_id: (r.account_id, r.matches_found) for r in match_parcels(addresses, parcels).collect()}
    assert got == {1: ("a", 2), 2: (None, 3), 3: ("b", 1), 4: ("c", 1), 5: (None, 0)}


def test_cases_without_an_address_are_spread_and_kept(spark):
    cases = spark.createDataFrame([(i, None if i % 3 else "1 Oak St") for i in range(300)] + [(300, "")],
                                  "case_id long, property_address string")
    values = spark.createDataFrame([("1 Oak St", 5.0), (None, 7.0)], "property_address string, estimate double")
    none = spark.createDataFrame([], "case_id long, ref_id string")
    got = join_valuations(cases, values, none)
    assert got.count() == 301 and got.where("estimate = 5").count() == 100
    assert got.where("error = 'No property_address available'").count() == 201 and got.where("estimate = 7").count() == 0


def test_parcel_pages_are_bounded_for_any_number_of_rows(spark):
    for n in (3_000, 60_000):  # all of one account
        parcels = spark.range(0, n, 1, 3).selectExpr("'0000064' AS account_id", "cast(id AS string) AS stnum", "'' AS prefix", "'ELM' AS street_name", "'RA' AS etj")
        rows = result_pages(parcels).select((F.size(F.split("html", "<tr>")) - 1).alias("n")).collect()
        assert max(r.n for r in rows) <= CHUNK and sum(r.n for r in rows) == n


def test_misfiled_is_given_every_filing_and_goes_by_name(spark):
    from types import SimpleNamespace

    from docketry.plans import case_queries

    bodies = [(i, 1, i, "97 SP 123") for i in range(23)]  # every kind of text names another case
    texts = spark.createDataFrame(bodies, "text_id long, case_id long, template long, body string")
    cases = spark.createDataFrame([(1, "24SP000001-910", "FORECLOSURE - Ann Smith", "upset_bid")], "case_id long, case_number string, style string, classification string")
    named = {r.document_id: r.document_name for r in named_filings(texts).collect()}
    assert len(named) == 23 and None not in named.values()
    got = {r.document_id for r in case_queries.misfiled(SimpleNamespace(filing_texts=texts, docket_cases=cases)).collect()}
    assert got == {12, 13, 17, 19, 20, 22}


def test_ranges_as_blocks(spark):
    """Every whole number lies in just the blocks of its range, and a range gives few of them whatever its bounds."""
    from docketry.functions.ranges import block_at, dyadic_blocks

    ranges = [(0, 0), (3, 17), (-9, 6), (1, 0), (100, 1_000_000_000_000), (7, 7), (-8, 7), (5, 1 << 61), (None, 4)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "i int, a long, b long").select(
        "i", dyadic_blocks(F.col("a"), F.col("b")).alias("blocks")).collect()
    blocks = {r.i: r.blocks for r in got}
    for i, (a, b) in enumerate(ranges):
        if a is None:
            assert blocks[i] is None
            continue
        spans = sorted((x.block << x.level, ((x.block + 1) << x.level) - 1) for x in blocks[i])
        assert all(s[1] + 1 == t[0] for s, t in zip(spans, spans[1:], strict=False))  # side by side, none twice
        assert (spans[0][0], spans[-1][1]) == (a, b) if a <= b else not spans
        assert len(spans) <= 2 * max(1, (b - a + 1).bit_length())
    assert len(blocks[4]) < 100
    numbers = spark.range(-20, 20).select("id", *[block_at(F.col("id"), F.lit(k)).alias(f"b{k}") for k in range(5)]).collect()
    for n in numbers:
        inside = any(n[f"b{x.level}"] == x.block for x in blocks[1] if x.level < 5)
        assert inside == (3 <= n.id <= 17)


def test_huge_street_ranges(spark):
    streets = spark.createDataFrame([("1", "N", "ELM", 100, 10**12), ("2", "N", "ELM", 5, 99), ("3", "N", "ELM", None, 4), ("4", "", "OAK", 9, 3)],
                                    "account_id string, prefix string, street_name string, low_num long, high_num long")
    addresses = spark.createDataFrame([(1, "100", "N", "Elm"), (2, "99", "N", "ELM"), (3, "999999999999", "N", "elm"), (4, "5", "", "OAK"), (5, "1000000000001", "N", "ELM")],
                                      "case_id long, stnum string, prefix string, name string")
    got = {r.case_id: r.account_id for r in match_street_ranges(addresses, streets).collect()}
    assert got == {1: "1", 2: "2", 3: "1", 4: None, 5: "3"}


def test_variants_of_any_shape(spark):
    from docketry.functions.jsontext import as_variant, json_shape, variant_objects

    texts = ['{"a":1}', '"{\\"a\\":2}"', '[{"a":3},4,{"a":5},"x"]', '{"a":', None, "12", "[]", "null", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("v", as_variant(F.col("t")))
    shapes = {r.i: r.s for r in df.select("i", json_shape(F.col("t"), F.col("v")).alias("s")).collect()}
    assert shapes == {0: "object", 1: "object", 2: "array", 3: "broken", 4: "absent", 5: "value", 6: "array", 7: "value", 8: "broken"}
    rows = sorted((r.i, r.a) for r in variant_objects(df, "v").select("i", F.try_variant_get("v", "$.a", "int").alias("a")).where("a IS NOT NULL").collect())
    assert rows == [(0, 1), (1, 2), (2, 3), (2, 5)]


def test_a_policy_is_data(spark):
    """A source whose policy changes is looked up by it; nothing about a county stands in the code."""
    from docketry.operators.parcels import county_policies, look_up

    cases = spark.createDataFrame([(1, "x", "lee_re", "0000000007", "100 N Elm St, Cary, NC 27511"), (2, "x", "lee_re", None, None)],
                                  "case_id long, case_number string, source string, parcel_id string, property_address string")
    parcels = spark.createDataFrame([("lee_re", "A1", "100", "N", "ELM", "CA"), ("lee_re", "A1", "100", "N", "ELM", "CA")],
                                    "source string, account_id string, stnum string, prefix string, street_name string, etj string")
    ids = spark.createDataFrame([("lee_re", "0000000007", "A9")], "source string, parcel_id string, account_id string")
    policies = county_policies(spark, "2024-01-01")
    first = {r.case_id: r for r in look_up(cases, parcels, ids, policies).collect()}
    assert (first[1].status, first[1].message, first[1].matches_found) == ("review", "2 matches found", 2)
    assert (first[2].status, first[2].message) == ("error", "No property_address available")
    changed = policies.withColumn("methods", F.array(F.lit("parcel_id"), F.lit("address"))).withColumn("absent_message", F.lit("Nothing"))
    second = {r.case_id: r for r in look_up(cases, parcels, ids, changed).collect()}
    assert second[1].url.endswith("pin=A9&jur=000&taxyr=2024") and second[2].message == "Nothing"


def test_pages_by_seeking(spark, tmp_path):
    """All pages together are the table, in order; a far page starts from its boundary and not from the rows before it."""
    from docketry.plans.serving import next_page, open_page, page_ends

    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(12)])) for i in range(530)]
    cases = spark.createDataFrame([(i, None if v is None else Decimal(v), str(i)) for i, v in rows], "case_id long, current_bid_amount decimal(12,2), case_number string").repartition(7)
    for descending in (True, False):
        order = sorted(rows, key=lambda r: ((r[1] is not None, -(r[1] or 0)) if descending else (r[1] is None, r[1] or 0), r[0]))
        ends = page_ends(cases, str(tmp_path / f"ends-{descending}"), "current_bid_amount", descending, 20)
        assert ends.count() == 530 // 20
        assert [r.case_id for r in open_page(cases, ends, 25, "current_bid_amount", descending, 20).collect()] == [i for i, _ in order[480:500]]
        assert open_page(cases, ends, 40, "current_bid_amount", descending, 20).count() == 0
        met, after = [], None
        while page := next_page(cases, "current_bid_amount", descending, after, 100).collect():
            met += [r.case_id for r in page]
            after = page[-1].current_bid_amount, page[-1].case_id
        assert met == [i for i, _ in order]
    path = str(tmp_path / "cases")
    cases.where("current_bid_amount IS NOT NULL").write.parquet(path)
    plan = next_page(spark.read.parquet(path), "current_bid_amount", False, (Decimal(11), 3), 20)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan or "GreaterThan(current_bid_amount" in plan  # the scan skips what lies before
    assert "TakeOrderedAndProject" in plan


def stream_batches(spark, seed, batches, cases):
    rng, out, n = random.Random(seed), [], 0
    for _ in range(batches):
        rows = []
        for _ in range(rng.randint(3, 9)):
            n += 1
            rows.append((n, rng.randrange(cases), n, date(2024, rng.randint(1, 6), rng.randint(1, 28)), rng.choice(["Report of Sale", "Upset Bid Filed", "Petition", "Order Confirming Sale"]), None))
        out.append(spark.createDataFrame(rows, "event_id bigint, case_id bigint, event_index int, event_date date, event_type string, event_description string"))
    return out


def test_a_store_grows_without_a_rewrite(spark, tmp_path, monkeypatch):
    """Two buckets first, then 256: old files stay as they are, small ones are merged by level, and the states are those of a
    store that had 256 from the start."""
    from docketry.streaming import intake

    monkeypatch.setattr(intake, "RUNS", 2)
    fields = "case_id bigint, case_number string, case_type string, classification string, sale_date date, current_bid_amount decimal(12,2), minimum_next_bid decimal(12,2), next_bid_deadline timestamp_ntz, closed_sold_at timestamp_ntz"
    cases = spark.createDataFrame([(n, f"24SP{n:06d}-910", "Foreclosure", "upcoming", None, None, None, None, None) for n in range(12)], fields)
    batches = stream_batches(spark, 5, 5, 12)
    small = EventIntake(cases, str(tmp_path / "grown"), "2024-06-14 12:00:00", buckets=2)
    for i in range(2):
        small.take_batch(batches[i], i)
    old = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "grown" / "states").rglob("*.parquet")}
    grown = EventIntake(cases, str(tmp_path / "grown"), "2024-06-14 12:00:00", buckets=256)
    for i in range(2, 5):
        grown.take_batch(batches[i], i)
    grown.take_batch(batches[4], 4)  # once more
    assert {p: m for p, m in old.items() if (tmp_path / p).stat().st_mtime_ns != m} == {}
    whole = EventIntake(cases, str(tmp_path / "whole"), "2024-06-14 12:00:00", buckets=256)
    for i, batch in enumerate(batches):
        whole.take_batch(batch, i)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(grown.states()) == rows(whole.states())
    ids = lambda taken: sorted(r.event_id for r in taken.stored_events().collect())
    assert ids(grown) == ids(whole)
    assert grown._live_runs() == [(0, 4, 4), (2, 0, 3)]
    # a bucket of today reads only what may hold its cases
    one = grown.stored_events(buckets=[5])
    assert {r.case_bucket for r in one.where("depth = 8").select("case_bucket").distinct().collect()} <= {5}
    assert grown.compact(keep=2) >= 0 and rows(grown.states()) == rows(whole.states())
    assert grown.compact() >= 1 and rows(grown.states()) == rows(whole.states())


def test_views_over_given_tables(spark):
    """Views are made from tables already at hand instead of from the base tables again (F11)."""
    from docketry.sources.sample_views import SampleTables

    folder = "/root/testdata/sf0.001"
    t = SampleTables(spark, folder)
    events = t.case_events.limit(0)
    assert t.given(case_events=events).hearings.count() == 0 and t.hearings.count() > 0
    plan = t.given(case_events=spark.createDataFrame([], events.schema)).hearings._jdf.queryExecution().analyzed().toString()
    assert "l_linenumber" not in plan


def test_only_long_cases_are_ranked(spark):
    """Chunks of long cases, of short ones and of rows without a case; a short case moves by its id alone (F8)."""
    import datetime as dt

    from docketry.plans import serving as S

    rows = [(n, case, dt.date(2024, 1, 1 + n % 3) if n % 4 else None, "Upset Bid Filed", "x")
            for n, case in enumerate([1] * 7 + [2] * 2 + [None] * 5 + [3])]
    events = spark.createDataFrame(rows, "event_id bigint, case_id bigint, event_date date, event_type string, event_description string")
    got = {(r.case_id, r.chunk): [e.event_id for e in r.events] for r in S.nested_events(events, rows=3).collect()}
    assert {k: len(v) for k, v in got.items()} == {(1, 0): 3, (1, 1): 3, (1, 2): 1, (2, 0): 2, (3, 0): 1, (None, 0): 3, (None, 1): 2}
    assert sorted(sum(got.values(), [])) == [r[0] for r in rows]
    parties = spark.createDataFrame([(1, "Heir", f"n{i}") for i in range(4)] + [(2, "Heir", "a"), (None, "Heir", "b")],
                                    "case_id bigint, party_type string, party_name string")
    names = {(r.case_id, r.chunk): r.parties for r in S.nested_parties(parties, rows=3).collect()}
    assert set(names) == {(1, 0), (1, 1), (2, 0), (None, 0)} and names[(2, 0)] == {"Heir": ["a"]}
    assert sorted(names[(1, 0)]["Heir"] + names[(1, 1)]["Heir"]) == ["n0", "n1", "n2", "n3"]
    plan = S.nested_events(events, rows=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


def test_variant_objects_reads_its_rows_once(spark):
    """What lies below is worked out once, and no row with an array is lost or doubled (F10)."""
    from docketry.functions.jsontext import as_variant, variant_objects

    texts = ['{"a":1}', '[{"a":2},7,{"a":3}]', "[]", "[1]", "12", None, "{", '"{\\"a\\":4}"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("v", as_variant(F.col("t")))
    found = variant_objects(df, "v")
    assert found.columns == ["i", "t", "v"]
    rows = sorted(((r.i, r.a) for r in found.select("i", F.try_variant_get("v", "$.a", "int").alias("a")).collect()), key=str)
    assert rows == [(0, 1), (1, 2), (1, 3), (4, None), (5, None), (6, None), (7, 4)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_page_store_makes_its_pages_once(spark, monkeypatch):
    """Pages go through the store as a stored table (F2)."""
    from docketry.plans import intake_queries

    made, seen = intake_queries.case_pages, []
    monkeypatch.setattr(intake_queries, "case_pages", lambda t: seen.append(1) or made(t))
    of = intake_queries.PG.MarkupStore.of
    monkeypatch.setattr(intake_queries.PG.MarkupStore, "of", lambda self, pages: seen.append(
        "Window" in pages._jdf.queryExecution().optimizedPlan().toString()) or of(self, pages))
    QUERIES["page_store"].run(spark, "/root/testdata/sf0.001")
    assert seen == [1, False, False, False]


def test_links_by_start_are_dealt_by_case_and_day(spark):
    """Both sides are dealt before they meet, the events once; types that differ in case keep the lowest event (F9)."""
    day = date(2024, 1, 5)
    documents = spark.createDataFrame(
        [(1, 7, None, "01-05-2024_Order.pdf"), (2, 7, None, "01-05-2024_ORDER.pdf"), (3, 7, None, "01-05-2024_rder O.pdf"),
         (4, None, None, "01-05-2024_Order.pdf"), (5, 7, 9, "01-05-2024_Order.pdf"), (1, 7, None, "01-05-2024_Order.pdf")],
        "document_id bigint, case_id bigint, event_id bigint, document_name string")
    events = spark.createDataFrame(
        [(12, 7, day, "Order"), (11, 7, day, "oRDER of sale"), (13, 7, day, "Order"), (10, 7, None, "Order"), (9, None, day, "Order")],
        "event_id bigint, case_id bigint, event_date date, event_type string")
    linked = link_by_start(documents, events)
    got = sorted((r.document_id, r.event_id) for r in linked.collect())
    assert got == [(1, 12), (1, 12), (2, 11), (3, 11), (4, None)]
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") >= 4
