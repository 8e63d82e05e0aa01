"""Docket and parcel pages into typed tables.

Python only turns markup into rows and blocks of text, page by page inside ``mapInPandas``. What those mean (which row
is a party, which line is the event type, where a description ends) is decided by column expressions on the result.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect
from collections.abc import Iterator, Sequence
from functools import partial
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.text import folded, group_of
from docketry.operators.ranking import keep_first

# Fixed values of the portal's markup.
PORTAL = "https://portal-nc.tylertech.cloud"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "template"}
_DATE_LINE = r"^\d{2}/\d{2}/\d{4}$"
_META_WORDS = ["Index", "Created", "Filed By", "Against", "A document is available", "Click here", "Receipt #"]
_STOP_WORDS = ["Index", "Created", "Filed By", "Against"]
_FALLBACK = "text of the page"
_SKIP_WORDS = ["A document is available", "Click here", "document"]

LINK = "struct<text:string,href:string,data_url:string,css:string>"
ROW = f"struct<grid:boolean,table_no:int,table_class:string,row_no:int,heads:string,cells:array<string>,links:array<{LINK}>,box:string>"
BLOCK = "struct<repeat:string,text:string,label:string,link_text:string,near_link:string,has_document:boolean>"
_TYPES = {"text": "string", "pager": "string", "rows": f"array<{ROW}>", "blocks": f"array<{BLOCK}>"}
PARTS = tuple(_TYPES)


class _Page:
    """The elements of a page in document order, element 0 being the page itself.

    What lies in an element stands next to each other: elements ``i + 1 .. last[i]`` and pieces of text
    ``first[i] .. end[i] - 1``. ``hidden`` lists the pieces inside a silent element, with the innermost such.
    """

    __slots__ = ("tags", "attrs", "parent", "last", "first", "end", "pieces", "hidden", "here")

    def __init__(self) -> None:
        self.tags, self.attrs, self.parent, self.last, self.first, self.end = [""], [{}], [-1], [0], [0], [0]
        self.pieces, self.hidden, self.here = [], [], 0

    def add(self, tag: str, attrs: dict[str, str]) -> int:
        """An element without contents, inside the open one."""
        at, piece = len(self.tags), len(self.pieces)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.parent.append(self.here)
        self.last.append(at)
        self.first.append(piece)
        self.end.append(piece)
        return at

    def open(self, tag: str, attrs: dict[str, str]) -> None:
        at = self.add(tag, attrs)
        if tag not in _VOID:
            self.here = at

    def close(self, tag: str) -> None:
        """End the nearest open element of this name with all that is open inside it; nothing if there is none."""
        node = self.here
        while node and self.tags[node] != tag:
            node = self.parent[node]
        if node:
            self._end(node)
            self.here = self.parent[node]

    def finish(self) -> None:
        self._end(0)

    def _end(self, outer: int) -> None:
        node, last, end = self.here, len(self.tags) - 1, len(self.pieces)
        while True:
            self.last[node], self.end[node] = last, end
            if node == outer:
                break
            node = self.parent[node]

    def data(self, text: str) -> None:
        silent = next((n for n in self.above(self.here) if self.tags[n] in _SILENT), None)
        if silent is not None:
            self.hidden.append((len(self.pieces), silent))
        self.pieces.append(text)

    def above(self, node: int) -> Iterator[int]:
        """An element and those around it, innermost first."""
        while node >= 0:
            yield node
            node = self.parent[node]

    def inside(self, node: int) -> range:
        return range(node + 1, self.last[node] + 1)

    def strings(self, node: int) -> list[str]:
        first, end = self.first[node], self.end[node]
        if self.hidden:
            left_out = {at for at, silent in self.hidden if first <= at < end and silent > node}
            if left_out:
                return [self.pieces[i] for i in range(first, end) if i not in left_out]
        return self.pieces[first:end]

    def text(self, node: int) -> str:
        return "".join(self.strings(node))

    def squeezed(self, node: int, between: str = "") -> str:
        return between.join([s for s in [x.strip() for x in self.strings(node)] if s]).replace("\xa0", " ")


class _Reader(HTMLParser):
    """Any markup, by the rules of the standard parser."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = _Page()

    def handle_starttag(self, tag, attrs):
        self.page.open(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.page.add(tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag):
        self.page.close(tag)

    def handle_data(self, data):
        self.page.data(data)


_BLANK = r"[ \t\n\r\f]"
_ATTR = r"""([a-zA-Z_][a-zA-Z0-9_:.-]*)(?:=(?:"([^"<>&]*)"|'([^'<>&]*)'))?"""
_ATTRS = rf"(?:{_BLANK}+{re.sub(r'[(](?![?])', '(?:', _ATTR)})*+"
#: Text, a script or style, a start tag, an end tag, a comment; anything else is a sign of markup for the standard parser.
_TOKEN = re.compile(
    rf"([^<]+)|<(?:(script|style)({_ATTRS}){_BLANK}*>([^<]*)</\2>|([a-zA-Z][a-zA-Z0-9-]*)({_ATTRS}){_BLANK}*(/?)>"
    rf"|/([a-zA-Z][a-zA-Z0-9-]*){_BLANK}*>|!--[^<>-]*(?:-[^<>-]+)*-->)|(<)")
_ATTR = re.compile(_ATTR)
#: Elements whose contents a parser may not read as markup, or that are not shown.
_OWN_RULES = _SILENT | {"textarea", "title", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript"}


def _plain_page(html: str, known: dict[str, dict[str, str]]) -> _Page | None:
    """A page of plain well-formed tags, as the standard parser reads it; None for any page that has more to it.

    ``known`` keeps the attributes of tags met before."""

    def attributes(text: str) -> dict[str, str]:
        if text not in known:
            if len(known) > 1000:
                known.clear()
            known[text] = {name.lower(): double or single for name, double, single in _ATTR.findall(text)}
        return known[text]

    page = _Page()
    tags, all_attrs, parent, last, first, end, pieces = (
        page.tags, page.attrs, page.parent, page.last, page.first, page.end, page.pieces)
    here, at = 0, 0
    for text, raw, raw_attrs, raw_text, tag, attrs, closed, ended, other in _TOKEN.findall(html):
        if text:
            pieces.append(unescape(text) if "&" in text else text)
        elif ended:
            if tags[here] == ended:
                last[here], end[here] = at, len(pieces)
                here = parent[here]
            else:
                page.here = here
                page.close(ended.lower())
                here = page.here
        elif tag or raw:
            tag = raw or tag.lower()
            if tag in _OWN_RULES and not raw:
                return None
            at += 1
            tags.append(tag)
            all_attrs.append(known[attrs or raw_attrs] if (attrs or raw_attrs) in known else attributes(attrs or raw_attrs))
            parent.append(here)
            last.append(at)
            first.append(len(pieces))
            if raw_text:
                page.hidden.append((len(pieces), at))
                pieces.append(raw_text)
            end.append(len(pieces))
            if not (raw or closed or tag in _VOID):
                here = at
        elif other:
            return None
    page.here = here
    page.finish()
    return page


def _read(html: str, known: dict[str, dict[str, str]]) -> _Page:
    page = _plain_page(html, known)
    if page is None:
        reader = _Reader()
        reader.feed(html)
        reader.close()
        page = reader.page
        page.finish()
    return page


def _rows(page: _Page) -> list[tuple]:
    """The table rows of a page: ``ROW`` each."""
    rows = [n for n, tag in enumerate(page.tags) if tag == "tr"]
    if not rows:
        return []
    tables = {}
    for number, node in enumerate(n for n, tag in enumerate(page.tags) if tag == "table"):
        begin = bisect(rows, node)
        own = begin < len(rows) and rows[begin] <= page.last[node]
        heads = " ".join([page.squeezed(n) for n in page.inside(rows[begin]) if page.tags[n] in ("th", "td")]).lower() if own else ""
        tables[node] = (number, page.attrs[node].get("class", ""), begin, heads)
    out = []
    for at, node in enumerate(rows):
        table = next((n for n in page.above(page.parent[node]) if page.tags[n] == "table"), None)
        number, css, begin, heads = tables.get(table, (-1, "", at, ""))
        grid = "k-master-row" in page.attrs[node].get("class", "").split() and any(
            page.attrs[n].get("id") == "CasesGrid" for n in page.above(page.parent[node]))
        cells, links, box = [], [], None
        boxed = False
        for n in page.inside(node):
            tag = page.tags[n]
            if tag in ("td", "gridcell"):
                cells.append(page.squeezed(n))
            elif tag == "a":
                attrs = page.attrs[n]
                links.append((page.text(n).strip(), attrs.get("href"), attrs.get("data-url"), attrs.get("class", "")))
            elif tag == "input" and not boxed and page.attrs[n].get("type") == "checkbox":
                box, boxed = page.attrs[n].get("value"), True
        out.append((grid, number, css, at - begin, heads, cells, links, box))
    return out


def _block(page: _Page, node: int) -> tuple:
    """A repeated block: ``BLOCK``."""
    inner, label, button, link = page.inside(node), None, None, None
    for n in inner:
        attrs = page.attrs[n]
        if label is None and len(attrs.get("label", "")) > 3 and ":" not in attrs["label"]:
            label = attrs["label"].strip()
        if link is None and page.tags[n] == "a":
            link = n
        elif button is None and page.tags[n] == "button" and "document" in attrs.get("aria-label", "").lower():
            button = n
    link = button if link is None else link
    return (page.attrs[node]["ng-repeat"].lower(), page.text(node).replace("\xa0", " "), label,
            page.squeezed(link) if link is not None else None,
            page.squeezed(page.parent[link], " ") if link is not None else None, button is not None)


#: Pages are handed on in slices of so many rows or characters, so that a task never holds the markup of many pages.
_SLICE_PAGES, _SLICE_CHARS = 500, 2_000_000


def read_markup(batches: Iterator[pd.DataFrame], parts: Sequence[str] = PARTS) -> Iterator[pd.DataFrame]:
    """(page_id, html) -> text, pager, table rows and repeated blocks of each page, or those of them asked for."""
    making = {
        "text": lambda page: page.text(0).replace("\xa0", " "), "pager": _pager, "rows": _rows,
        "blocks": lambda page: [_block(page, n) for n, a in enumerate(page.attrs) if a.get("ng-repeat")]}
    makers = [making[part] for part in parts]
    known, out, chars = {}, [], 0
    frame = lambda: pd.DataFrame(out, columns=["page_id", *parts])
    for batch in batches:
        for page_id, html in zip(batch["page_id"], batch["html"]):
            page = _read(html or "", known)
            out.append((page_id, *[make(page) for make in makers]))
            chars += len(html or "")
            if len(out) >= _SLICE_PAGES or chars >= _SLICE_CHARS:
                yield frame()
                out, chars = [], 0
    if out:
        yield frame()


def _pager(page: _Page) -> str | None:
    node = next((n for n, a in enumerate(page.attrs) if "k-pager-info" in a.get("class", "").split()), None)
    return None if node is None else page.text(node).strip()


def _markup_schema(key: str, parts: Sequence[str] = PARTS) -> str:
    return ", ".join([key, *[f"{part} {_TYPES[part]}" for part in parts]])


def markup(pages: DataFrame, *parts: str) -> DataFrame:
    """What pages (page_id, html) say, or the parts of it asked for; rows that come with their markup already
    (``MarkupStore.of``) are taken as they are."""
    parts = parts or PARTS
    if set(PARTS) <= set(pages.columns):
        return pages.select("page_id", *parts)
    return pages.select("page_id", "html").mapInPandas(partial(read_markup, parts=parts), _markup_schema("page_id bigint", parts))


class MarkupStore:
    """Markup of pages by the hash of their contents, in a folder all executors see: a page is read once, however often it
    comes and whatever its id, and an unchanged page of a later day is not read again.

    New markup is written beside the old and appears by one rename, so a run that dies adds nothing and a repeated one reads
    only what is missing. ``read`` counts the pages the last call had to read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.read = spark, root.rstrip("/"), 0
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{self.root}/parts"))

    def _known(self) -> DataFrame:
        parts = [s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.root}/parts"))]
        schema = _markup_schema("digest string")
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/parts/{p}" for p in sorted(parts)])

    def of(self, pages: DataFrame) -> DataFrame:
        """(page_id, text, pager, rows, blocks) of the pages, those not known yet read first. A NULL page is an empty one.

        ``pages`` is gone through twice, so it must be a stored table or give the same contents each time."""
        html = F.coalesce("html", F.lit(""))
        keyed = pages.select("page_id", F.sha2(html.cast("binary"), 256).alias("digest"), html.alias("html"))
        new = keyed.join(self._known().select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("html").alias("html"))
        name = uuid.uuid4().hex
        read = new.withColumnRenamed("digest", "page_id").mapInPandas(read_markup, _markup_schema("page_id string"))
        read.withColumnRenamed("page_id", "digest").write.parquet(f"{self.root}/drafts/{name}")
        self.read = self.spark.read.parquet(f"{self.root}/drafts/{name}").count()
        if self.read:
            self._files.rename(self._path(f"{self.root}/drafts/{name}"), self._path(f"{self.root}/parts/{name}"))
        # two runs at a time may both have read a page
        known = self._known().dropDuplicates(["digest"]) if self._many() else self._known()
        return keyed.select("page_id", "digest").join(known, "digest").drop("digest")

    def _many(self) -> bool:
        known = self._known().select("digest")
        return not known.groupBy("digest").count().where("count > 1").isEmpty()


# --- search results --------------------------------------------------------------------------------------------------


def ingest_search_pages(pages: DataFrame) -> DataFrame:
    """(page_id, case_number, case_url, style, status, location); grid rows, else the table headed "case number".

    Of rows that repeat a case number the first by page and row stays.
    """
    m = markup(pages, "rows")
    grid = F.filter("rows", lambda r: r["grid"])
    listed = F.filter("rows", lambda r: F.contains(r["heads"], F.lit("case number")) & (r["row_no"] > 0))
    first_table = F.array_min(F.transform(listed, lambda r: r["table_no"]))
    chosen = F.when(F.size(grid) > 0, grid).otherwise(F.filter(listed, lambda r: r["table_no"] == first_table))
    r = m.select("page_id", F.posexplode(chosen).alias("__row", "r")).select("page_id", "__row", "r.*")
    pick = lambda test: F.get(F.filter("links", test), F.lit(0))
    link = F.coalesce(pick(lambda a: F.array_contains(F.split(a["css"], r"\s+"), F.lit("caseLink"))),
                      pick(lambda a: F.contains(a["href"], F.lit("Case"))), F.get("links", F.lit(0)))
    r = r.withColumn("link", link).where(F.length("link.text") > 0)
    url = F.coalesce(F.nullif(F.col("link.data_url"), F.lit("")), F.nullif(F.col("link.href"), F.lit("")))
    url = F.when(url == "#", None).when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit(PORTAL), url))
    cell = lambda i: F.get("cells", F.lit(i))
    listed = r.select("page_id", "__row", F.col("link.text").alias("case_number"), url.alias("case_url"), cell(1).alias("style"),
                      cell(2).alias("status"), cell(3).alias("location"))
    return keep_first(listed, ["case_number"], [F.col("page_id"), F.col("__row")]).drop("__row")


def stated_counts(pages: DataFrame) -> DataFrame:
    """(page_id, pager_text) for the reconciliation with the rows taken."""
    return markup(pages, "pager").select("page_id", F.col("pager").alias("pager_text"))


# --- case pages ------------------------------------------------------------------------------------------------------


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " "))), lambda x: x != "")


def _has(line: Column, words: list[str]) -> Column:
    out = F.contains(line, F.lit(words[0]))
    for word in words[1:]:
        out = out | F.contains(line, F.lit(word))
    return out


def _joined_type(after_date: Column) -> Column:
    """Event type the portal split over short lines: up to four fragments, the longest sensible joining."""

    def step(state: Column, line: Column) -> Column:
        parts = state["parts"]
        fragment = (F.length(line) <= 50) & ~line.rlike(r"^\d+$")
        stop = _has(line, _META_WORDS) | line.rlike(r"^\d{2}/\d{2}/\d{4}")
        ended = F.struct(F.lit(True).alias("done"), parts.alias("parts"))
        grown = F.struct((F.size(parts) >= 3).alias("done"), F.array_append(parts, line).alias("parts"))
        return (
            F.when(state["done"] | line.rlike(_DATE_LINE), state).when(stop, ended).when(fragment, grown)
            .when(F.size(parts) > 0, ended).otherwise(state))

    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("parts"))
    parts = F.aggregate(after_date, start, step, lambda s: s["parts"])
    joined = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " "))
    joined = F.when(F.size(parts) > 0, joined)
    fits = lambda x: x.rlike("^[A-Z]") & (F.length(x) > 5) & (F.length(x) < 150) & ~_has(x, _META_WORDS) & ~x.rlike(r"\d{5}$")
    return F.try_element_at(F.filter(joined, fits), F.lit(-1))


def _description(rest: Column) -> Column:
    """Up to two lines of substance after the event type, before the form labels begin."""

    def step(state: Column, line: Column) -> Column:
        kept = state["kept"]
        stop = _has(line, _STOP_WORDS) | line.rlike(r"^\d{2}/\d{2}/\d{4}\s+\d{1,2}:\d{2}")
        skip = _has(line, _SKIP_WORDS) | line.rlike(_DATE_LINE) | (F.length(line) <= 3) | (F.length(line) >= 500)
        return (
            F.when(state["done"] | (~stop & skip), state).when(stop, F.struct(F.lit(True).alias("done"), kept.alias("kept")))
            .otherwise(F.struct((F.size(kept) >= 1).alias("done"), F.array_append(kept, line).alias("kept"))))

    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("kept"))
    return F.nullif(F.array_join(F.aggregate(rest, start, step, lambda s: s["kept"]), " "), F.lit(""))


def _events(m: DataFrame) -> DataFrame:
    """Event blocks of a page; a page without any gives an undated event for each indicator phrase of its text."""
    own = F.filter("blocks", lambda b: F.contains(b["repeat"], F.lit("event")))
    none = F.lit(None).cast("string")
    found_in_text = F.transform(fallback_phrases(F.col("text")), lambda p: F.struct(
        F.lit(_FALLBACK).alias("repeat"), p.alias("text"), none.alias("label"), none.alias("link_text"), none.alias("near_link"),
        F.lit(False).alias("has_document")))
    e = m.select("page_id", F.posexplode(F.when(F.size(own) > 0, own).otherwise(found_in_text)).alias("event_no", "b")).select(
        "page_id", "event_no", "b.*")
    e = e.withColumn("lines", _lines(F.col("text")))
    labelled = F.when(~_has(F.col("label"), [":", "Filed", "Against", "Created", "Index"]), F.nullif(F.col("label"), F.lit("")))
    title = lambda x: x.rlike(r"^[A-Z][a-zA-Z\s()/\-0-9]+$") & (F.length(x) > 5) & (F.length(x) < 100) & ~_has(x, _META_WORDS)
    day_at = F.array_position(F.transform("lines", lambda x: x.rlike(_DATE_LINE)), F.lit(True)).cast("int")
    e = e.withColumn("after_date", F.when(day_at > 0, F.slice("lines", day_at + 1, F.size("lines"))).otherwise(F.array().cast("array<string>")))
    e = e.withColumn("event_type", F.coalesce(labelled, F.get(F.filter("lines", title), F.lit(0)), _joined_type(F.col("after_date"))))
    # The description starts after the line(s) that make up the type; a label that is no line leaves all after the date.
    ends = F.transform("lines", lambda x: F.endswith(F.col("event_type"), x) & (F.length(x) > 3))
    type_at = F.array_position(ends, F.lit(True)).cast("int")
    rest = F.when(type_at > 0, F.slice("lines", type_at + 1, F.size("lines"))).otherwise(F.col("after_date"))
    text = F.col("text")
    shown = F.when(F.col("link_text").isin("", "Click here to view the document"), F.get(F.filter(F.split("near_link", "\n"), lambda x: (
        ~F.contains(F.lower(x), F.lit("document is available")) & ~F.contains(F.lower(x), F.lit("click here"))
        & (F.length(x) > 5) & (F.length(x) < 200) & ~F.startswith(x, F.lit("Index")) & ~F.startswith(x, F.lit("Created")))), F.lit(0))
    ).otherwise(F.col("link_text"))
    hearing = r"(\d{2}/\d{2}/\d{4})\s+(\d{1,2}:\d{2})"
    phrase = F.col("repeat") == _FALLBACK
    told = lambda value, name, instead=None: F.when(phrase, instead).otherwise(value).alias(name)
    found = e.select(
        "page_id", "event_no", told(F.try_to_date(group_of(text, r"(\d{2}/\d{2}/\d{4})"), "MM/dd/yyyy"), "event_date"),
        told(F.col("event_type"), "event_type", text), told(group_of(text, r"Index\s*#\s*(\d+)", flags="").cast("int"), "event_index"),
        told(F.when(F.col("event_type").isNotNull(), _description(rest)), "event_description", F.concat(F.lit("Found in page text: "), text)),
        told(shown, "document_title"), told(F.trim(group_of(text, r"Filed By:\s*([^§\n]+)", flags="")), "filed_by"),
        told(F.trim(group_of(text, r"Against:\s*([^§\n]+)", flags="")), "filed_against"),
        told(F.concat(group_of(text, hearing), F.lit(" "), group_of(text, hearing, 2)), "hearing_date"), "has_document")
    return found.where(F.col("event_date").isNotNull() | F.col("event_type").isNotNull())


def fallback_phrases(text: Column) -> Column:
    """Indicator phrases found in a text, in list order."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(p) for p in R.PAGE_FALLBACK_PHRASES]), lambda p: F.contains(low, p))


def is_party_type(text: Column) -> Column:
    """Case-sensitive test against the party types the portal uses."""
    return F.coalesce(_has(text, R.PARTY_TYPES), F.lit(False))


def ingest_case_pages(pages: DataFrame) -> dict[str, DataFrame]:
    """Case pages to four tables: cases, parties, events, hearings, all keyed by page_id.

    Each table reads the pages when it is asked for; give the result of ``MarkupStore.of`` to have them read once.
    """
    def rows_of(*classes: str) -> Column:
        """Rows of the first table whose class names all of these, two cells at least."""
        named = lambda r: _all([F.contains(r["table_class"], F.lit(c)) for c in classes])
        first = F.array_min(F.transform(F.filter("rows", named), lambda r: r["table_no"]))
        return F.filter("rows", lambda r: (r["table_no"] == first) & (F.size(r["cells"]) >= 2))

    def info(word: str) -> Column:
        return F.try_element_at(F.filter(F.col("info"), lambda r: F.contains(F.lower(r["cells"][0]), F.lit(word))), F.lit(-1))["cells"][1]

    style = folded(group_of(F.col("text"), r"(FORECLOSURE[^§\n]{3,100})", flags=""))
    cases = markup(pages, "text", "rows").withColumn("info", rows_of("roa-caseinfo-info-rows")).select(
        "page_id", info("case type").alias("case_type"), info("case status").alias("case_status"),
        F.try_to_date(group_of(F.col("text"), r"Filed on:\s*(\d{2}/\d{2}/\d{4})", flags=""), "MM/dd/yyyy").alias("file_date"),
        F.when(F.length(style) < 150, style).alias("style"))
    parties = markup(pages, "rows").select("page_id", F.explode(rows_of("roa-table", "td-pad-5")).alias("r")).select(
        "page_id", F.col("r.cells")[0].alias("party_type"), F.col("r.cells")[1].alias("party_name")).where(
        is_party_type(F.col("party_type")) & (F.length("party_name") > 0))
    events = _events(markup(pages, "text", "blocks"))
    h = markup(pages, "blocks").select("page_id", F.posexplode(F.filter("blocks", lambda b: F.contains(b["repeat"], F.lit("hearing")))).alias("hearing_no", "b"))
    kind = F.transform(F.filter(_lines(F.col("b.text")), lambda x: ~x.rlike(r"^\d") & ~F.contains(x, F.lit("Created")) & (F.length(x) < 50)),
                       lambda x: F.trim(F.regexp_replace(x, r"\([^)]+\)", "")))
    hearings = h.select(
        "page_id", "hearing_no", F.try_to_date(group_of(F.col("b.text"), r"(\d{2}/\d{2}/\d{4})"), "MM/dd/yyyy").alias("hearing_date"),
        group_of(F.col("b.text"), r"\((\d{1,2}:\d{2}\s*(?:AM|PM)?)\)").alias("hearing_time"),
        F.get(F.filter(kind, lambda x: x != ""), F.lit(0)).alias("hearing_type")).where(F.col("hearing_date").isNotNull())
    return {"cases": cases, "parties": parties, "events": events, "hearings": hearings}


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


# --- parcel pages and links ----------------------------------------------------------------------------------------


def ingest_parcel_pages(pages: DataFrame) -> dict[str, DataFrame]:
    """Result pages to account rows (nine cells and a link to an account) and street ranges (seven and a check box)."""
    r = markup(pages, "rows").select("page_id", F.explode("rows").alias("r")).select("page_id", "r.*")
    account = r"Account\.asp\?id=(\d+)"
    cell = lambda i: F.get("cells", F.lit(i))
    linked = r.withColumn("link", F.explode("links")).withColumn("account_id", group_of(F.col("link.href"), account, flags=""))
    accounts = linked.where(F.col("account_id").isNotNull() & (F.size("cells") >= 9)).select(
        "page_id", "account_id", cell(2).alias("stnum"), cell(3).alias("st_misc"), cell(4).alias("prefix"), cell(5).alias("street_name"),
        cell(6).alias("street_type"), cell(7).alias("suffix"), cell(8).alias("etj"), cell(9).alias("owner"))
    streets = r.where((F.length("box") > 0) & (F.size("cells") >= 7)).select(
        "page_id", F.col("box").alias("locid"), cell(1).alias("prefix"), cell(2).alias("street_name"), cell(3).alias("street_type"),
        cell(4).alias("suffix"), cell(5).alias("etj"), cell(6).try_cast("bigint").alias("low_num"), cell(7).try_cast("bigint").alias("high_num"))
    return {"accounts": accounts, "streets": streets}


def extract_links(pages: DataFrame, pattern: str) -> DataFrame:
    """(page_id, link): every match of a one-group pattern in the markup."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("link"))
