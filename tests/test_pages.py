"""Docket, search and parcel markup."""

import datetime as dt

from docketry.sources import pages as P

CASE = """<html><head><script>FORECLOSURE of nothing</script></head><body>
<table class="roa-caseinfo-info-rows"><tr><td>Case&nbsp;Type:</td><td>Foreclosure&nbsp;(Special Proceeding)</td></tr><tr><td>Case Status:</td><td>Pending</td></tr></table>
<div>FORECLOSURE (HOA) -  Ann   Example</div>
Filed on: 01/05/2024
<table class="roa-table td-pad-5"><tr><td>Respondent</td><td>Ann Example</td><td></td></tr><tr><td>Bystander</td><td>Bob</td></tr></table>
<div ng-repeat="event in events">
01/19/2024
<roa-data label="Petition to Sell/Lease Ward's Estate">x</roa-data>
A note on it
Filed By: Clerk
Against: Ann Example
Index # 4
<a href="#">PETITION FOR SALE</a></div>
<div ng-repeat="event in events">
02/01/2024
Upset Bid Filed
Bid Amount $9,830.00 Deposit Amount $750.00
Created: 02/02/2024 3:15
<button aria-label="Document">Click here to view the document</button></div>
<div ng-repeat="event in events">
02/03/2024
Order
for Sale of Ward's
property
Index # 6</div>
<div ng-repeat="hearing in hearings">
03/01/2024 Created
Sale Hearing (2:30 PM)</div></body></html>"""


def frame(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")


def test_case_page(spark):
    t = P.ingest_case_pages(frame(spark, CASE))
    case = t["cases"].first()
    assert (case["case_type"], case["case_status"], case["file_date"], case["style"]) == (
        "Foreclosure (Special Proceeding)", "Pending", dt.date(2024, 1, 5), "FORECLOSURE (HOA) - Ann Example")
    assert [(r["party_type"], r["party_name"]) for r in t["parties"].collect()] == [("Respondent", "Ann Example")]
    a, b, c = t["events"].orderBy("event_no").collect()
    assert (a["event_type"], a["event_index"], a["filed_by"], a["filed_against"], a["document_title"]) == (
        "Petition to Sell/Lease Ward's Estate", 4, "Clerk", "Ann Example", "PETITION FOR SALE")
    assert (b["event_type"], b["event_description"], b["hearing_date"], b["has_document"]) == (
        "Upset Bid Filed", "Bid Amount $9,830.00 Deposit Amount $750.00", "02/02/2024 3:15", True)
    assert (c["event_type"], c["event_date"], c["event_index"]) == ("Order for Sale of Ward's property", dt.date(2024, 2, 3), 6)
    h = t["hearings"].first()
    assert (h["hearing_date"], h["hearing_time"], h["hearing_type"]) == (dt.date(2024, 3, 1), "2:30 PM", "Sale Hearing")


def test_fallback(spark):
    got = P.ingest_case_pages(frame(spark, "<p>An Upset Bid Filed here, Foreclosure Case Initiated</p>"))["events"].collect()
    assert {r["event_type"] for r in got} == {"foreclosure case initiated", "upset bid filed"}
    assert all(r["event_date"] is None for r in got)


def test_search_page(spark):
    grid = """<div id="CasesGrid"><table><tbody><tr class="k-master-row"><td><a class="caseLink" data-url="/Case/1" href="#">24SP000001-910</a></td><td>Style</td>
      <td>Open</td><td>Wake</td></tr></tbody></table></div><table><tr><th>Case Number</th></tr><tr><td><a href="/x">no</a></td></tr></table>
      <span class="k-pager-info">1 - 10 of 75 items</span>"""
    plain = '<table><tr><th>Case Number</th><th>Style</th></tr><tr><td><a href="http://h/Case/2">24SP000002-310</a></td></tr></table>'
    got = {r["case_number"]: r for r in P.ingest_search_pages(frame(spark, grid, plain)).collect()}
    assert set(got) == {"24SP000001-910", "24SP000002-310"}
    assert got["24SP000001-910"]["case_url"] == P.PORTAL + "/Case/1" and got["24SP000001-910"]["location"] == "Wake"
    assert got["24SP000002-310"]["case_url"] == "http://h/Case/2" and got["24SP000002-310"]["style"] is None
    assert P.stated_counts(frame(spark, grid)).first()["pager_text"] == "1 - 10 of 75 items"


def test_parcel_page(spark):
    cells = "".join(f"<td>{c}</td>" for c in ["1", '<a href="Account.asp?id=0379481">x</a>', "414", "", "S", "SALEM", "ST", "", "AP", "Owner"])
    street = "".join(f"<td>{c}</td>" for c in ['<input type="checkbox" name="c1" value="77"/>', "SE", "MAYNARD", "RD", "", "CA", "100", "900"])
    t = P.ingest_parcel_pages(frame(spark, f"<table><tr>{cells}</tr><tr>{street}</tr><tr><td>short</td></tr></table>"))
    a, s = t["accounts"].first(), t["streets"].first()
    assert (a["account_id"], a["stnum"], a["prefix"], a["street_name"], a["etj"], a["owner"]) == ("0379481", "414", "S", "SALEM", "AP", "Owner")
    assert (s["locid"], s["prefix"], s["low_num"], s["high_num"]) == ("77", "SE", 100, 900)


def test_pages_are_read_once(spark, tmp_path):
    """One reader in the plan of the events; through the store the second day reads only what has changed."""
    from docketry.sources.pages import MarkupStore, ingest_case_pages, stated_counts

    html = lambda n: f'<span class="k-pager-info">1 - 1 of {n} items</span><div ng-repeat="event in events">\n01/0{n}/2024\nReport of Sale\nIndex # {n}</div>'
    rows = [(1, html(1)), (2, html(2)), (3, html(2)), (4, None), (5, "plain text: notice of sale")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string")
    plan = ingest_case_pages(pages)["events"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
    store = MarkupStore(spark, str(tmp_path / "markup"))
    stored = ingest_case_pages(store.of(pages))
    assert store.read == 4  # equal pages count once
    for name, table in ingest_case_pages(pages).items():
        assert sorted(map(str, stored[name].collect())) == sorted(map(str, table.collect())), name
    again = store.of(pages.where("page_id < 4").unionByName(spark.createDataFrame([(9, html(7))], "page_id bigint, html string")))
    assert store.read == 1 and again.count() == 4
    store.of(pages)
    assert store.read == 0
    assert sorted((r.page_id, r.pager_text) for r in stated_counts(again).collect()) == [(n, f"1 - 1 of {k} items") for n, k in ((1, 1), (2, 2), (3, 2), (9, 7))]


def test_markup_comes_in_slices():
    """A task never holds the markup of a whole batch of pages (F4, F5)."""
    import pandas as pd

    batch = pd.DataFrame({"page_id": range(2000), "html": ["<table><tr><td>x</td></tr></table>"] * 2000})
    sizes = [len(part) for part in P.read_markup(iter([batch]))]
    assert max(sizes) <= 500 and sum(sizes) == 2000
    long = pd.DataFrame({"page_id": range(4), "html": ["<p>" + "x" * 1_500_000] * 4})
    assert max(len(part) for part in P.read_markup(iter([long]))) <= 2


def test_plain_pages_are_read_as_by_the_standard_parser():
    """Plain markup takes the short way, all other markup the standard parser; both see the same (F3, F7)."""
    other = ["<p>a < b<td>", "<a href=x>y</a>", "<template><td>no</td></template>yes", "<tr><td a='&lt;'>1</td", "<title>a</title>", "<?x>z"]
    plain = [CASE, "<table><tr><td>A &amp; B<br/>c</td></TR><tr class='k-master-row'><td>2</table></p>x", "<!-- c --><style>.a{}</style>t"]
    assert all(P._plain_page(html, {}) is None for html in other)
    for html in plain:
        quick, reader = P._plain_page(html, {}), P._Reader()
        reader.feed(html)
        reader.close()
        reader.page.finish()
        for name in ("tags", "attrs", "parent", "last", "first", "end", "pieces", "hidden"):
            assert getattr(quick, name) == getattr(reader.page, name), name
        assert P._rows(quick) == P._rows(reader.page)
