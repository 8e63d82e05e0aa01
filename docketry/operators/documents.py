"""Documents: event links, duplicates, corpus selection, misfiling checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.predicates import document_tier
from docketry.functions.text import (
    case_numbers_in,
    document_date,
    document_kind,
    norm_event_type,
    plain_blanks,
    respondent_surname,
)
from docketry.operators.ranking import keep_first

PREFIX = 30
SHORT_PREFIX = 20


def _lowest_event(events: DataFrame, kind: Column, out: str) -> DataFrame:
    """Lowest event id per (case, date, kind): the join below never meets more than one row per key."""
    return events.groupBy("case_id", F.col("event_date").alias("__day"), kind.alias("__kind")).agg(
        F.min("event_id").alias(out))


def link_events(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Unlinked documents matched to an event of the same case and day.

    Exact type first, then the normal form; names of 30 characters and more agree when their first 30 do. Since both
    rules compare the same leading characters, each is an equality join on a key reduced to one event.
    """
    named = documents.where(F.col("event_id").isNull()).select(
        "document_id", "case_id", document_date(F.col("document_name")).alias("__day"),
        document_kind(F.col("document_name")).alias("__type"))
    usable = F.col("__day").isNotNull() & (F.length("__type") > 0)
    dated = events.where(F.col("event_date").isNotNull())
    exact = _lowest_event(dated.where(F.col("event_type").isNotNull()), F.col("event_type"), "exact_id")
    key = lambda c: F.substring(norm_event_type(c), 1, PREFIX)
    fuzzy = _lowest_event(dated, key(F.col("event_type")), "fuzzy_id")
    linked = (
        named.withColumn("__kind", F.when(usable, F.col("__type")))
        .join(exact, ["case_id", "__day", "__kind"], "left")
        .withColumn("__kind", F.when(usable, key(F.col("__type"))))
        .join(fuzzy, ["case_id", "__day", "__kind"], "left")
    )
    how = (
        F.when(~F.coalesce(usable, F.lit(False)), "skipped").when(F.col("exact_id").isNotNull(), "exact")
        .when(F.col("fuzzy_id").isNotNull(), "fuzzy").otherwise("unmatched")
    )
    return linked.select("document_id", "case_id", F.coalesce("exact_id", "fuzzy_id").alias("event_id"), how.alias("match"))


def link_by_start(documents: DataFrame, events: DataFrame) -> DataFrame:
    """The other link rule: exact type, else the first 20 characters occur anywhere in the event type.

    Containment becomes an equality join on substrings of the event type, cut only to the lengths asked for.
    """
    wanted = documents.where(F.col("event_id").isNull()).select(
        "document_id", "case_id", document_date(F.col("document_name")).alias("__day"),
        document_kind(F.col("document_name")).alias("__type")).where(
        F.col("__day").isNotNull() & (F.length("__type") > 0))
    # both sides are dealt by case and day, so that making them and joining them do not share a task's memory
    wanted = wanted.withColumn("__piece", F.lower(F.substring("__type", 1, SHORT_PREFIX))).repartition("case_id", "__day")
    sizes = wanted.groupBy("case_id", "__day").agg(F.collect_set(F.length("__piece")).alias("__sizes"))
    dated = events.where(F.col("event_date").isNotNull() & F.col("event_type").isNotNull())
    lowest = _lowest_event(dated, F.col("event_type"), "exact_id").repartition("case_id", "__day")
    exact = lowest.withColumnRenamed("__kind", "__type")
    types = lowest.select("case_id", "__day", F.lower("__kind").alias("__kind"), F.col("exact_id").alias("event_id")).join(
        sizes, ["case_id", "__day"])
    cuts = F.transform("__sizes", lambda n: F.when(
        n <= F.length("__kind"), F.transform(F.sequence(F.lit(1), F.length("__kind") - n + 1),
                                             lambda at: F.substring(F.col("__kind"), at, n))))
    pieces = (
        types.select("case_id", "__day", "event_id", F.explode(F.array_distinct(F.flatten(F.array_compact(cuts)))).alias("__piece"))
        .groupBy("case_id", "__day", "__piece").agg(F.min("event_id").alias("part_id"))
    )
    return (
        wanted.join(exact, ["case_id", "__day", "__type"], "left").join(pieces, ["case_id", "__day", "__piece"], "left")
        .select("document_id", "case_id", F.coalesce("exact_id", "part_id").alias("event_id"))
    )


def link_report(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Link rate before and after, with the counts per kind of match."""
    kinds = ("exact", "fuzzy", "unmatched", "skipped")
    before = documents.agg(F.count(F.lit(1)).alias("documents"), F.count("event_id").alias("linked_before"))
    per_kind = links.agg(*[F.count_if(F.col("match") == kind).alias(kind) for kind in kinds])
    whole = before.unionByName(per_kind, allowMissingColumns=True)
    totals = whole.agg(*[F.sum(c).alias(c) for c in ("documents", "linked_before", *kinds)])
    return totals.withColumn("linked_after", F.col("linked_before") + F.col("exact") + F.col("fuzzy"))


def dedupe_documents(documents: DataFrame) -> DataFrame:
    """Per case and name: the lowest id with text, else the lowest id."""
    has_text = F.coalesce(F.length("ocr_text") > 0, F.lit(False))
    return keep_first(documents, ["case_id", "document_name"], [has_text.desc(), F.col("document_id")])


def distinct_texts(documents: DataFrame) -> DataFrame:
    """One document per distinct text of a case, the lowest id."""
    hashed = documents.where(F.length("ocr_text") > 0).withColumn("content_md5", F.md5("ocr_text"))
    return keep_first(hashed, ["case_id", "content_md5"], [F.col("document_id")])


def select_corpus(documents: DataFrame, cases: DataFrame, budget: int = R.CORPUS_CHARS,
                  per_document: int = R.DOCUMENT_CHARS) -> DataFrame:
    """Documents chosen for the analysis of a case: (case_id, document_id, position).

    Greedy in (tier, date, id) order under a character budget; one that does not fit is skipped and later ones still
    may fit. The room left only shrinks, so once a size is refused all later documents of that size are: of any size
    only the first ``budget / size`` in order can ever be chosen. Cutting each (case, size) to that many is exact and
    bounds what a case brings into the final pass, however many documents it has.
    """
    tiered = (
        distinct_texts(documents).join(cases.select("case_id", "case_number"), "case_id")
        .select("case_id", "document_id", document_tier(F.col("document_name"), F.col("case_number")).alias("tier"),
                F.coalesce(F.date_format("document_date", "yyyy-MM-dd"), F.lit("")).alias("day"),
                F.least(F.length("ocr_text"), F.lit(per_document)).alias("size"))
    )
    order = [F.col("tier"), F.col("day"), F.col("document_id")]
    number = F.row_number().over(Window.partitionBy("case_id", "size").orderBy(*order))
    # A size is one character at least, so a constant limit holds for all sizes; Spark applies it before the shuffle.
    able = tiered.withColumn("__n", number).where(F.col("__n") <= budget).where(F.col("__n") <= F.floor(F.lit(budget) / F.col("size")))
    queue = F.array_sort(F.collect_list(F.struct(*order, F.col("size"))))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<bigint>").alias("chosen"))

    def take(state: Column, item: Column) -> Column:
        fits = state["used"] + item["size"] <= budget
        return F.when(fits, F.struct((state["used"] + item["size"]).alias("used"),
                                     F.array_append(state["chosen"], item["document_id"]).alias("chosen"))).otherwise(state)

    chosen = able.groupBy("case_id").agg(queue.alias("queue")).select(
        "case_id", F.aggregate("queue", start, take, lambda s: s["chosen"]).alias("chosen"))
    return chosen.select("case_id", F.posexplode("chosen").alias("position", "document_id"))


def document_belongs(text: Column, case_number: Column) -> Column:
    """No case number in the text, or one that equals the case's."""
    plain = plain_blanks(text)
    base = F.upper(F.regexp_replace(F.substring_index(case_number, "-", 1), r"\s+", ""))

    def numbers(pattern: str) -> Column:
        hits = F.regexp_extract_all(plain, F.lit("(?i)" + pattern), F.lit(0))
        return F.transform(hits, lambda h: F.concat(F.regexp_extract(h, r"^(\d{2})", 1), F.lit("SP"),
                                                    F.lpad(F.regexp_extract(h, r"(\d+)$", 1), 6, "0")))

    found = F.concat(numbers(R.CASE_NUMBER_SIX), numbers(R.CASE_NUMBER_FOUR))
    return F.coalesce((F.size(found) == 0) | F.array_contains(found, base), F.lit(True))


def misfiled(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """Sale reports of upset_bid cases that name other cases, or another respondent instead of the expected one."""
    looked_at = (
        documents.where(F.col("document_name").like("%Report%Sale%") & (F.length("ocr_text") > 0))
        .join(cases.where(F.col("classification") == R.UPSET_BID).select("case_id", "case_number", "style"), "case_id")
        .withColumn("base", F.substring_index("case_number", "-", 1))
        .withColumn("surname", respondent_surname(F.col("style")))
    )
    others = F.filter(case_numbers_in(plain_blanks(F.col("ocr_text"))), lambda n: ~F.contains(n, F.col("base")))
    absent = (F.length("surname") > 3) & ~F.contains(F.upper("ocr_text"), F.col("surname"))
    other_name = F.regexp_count("ocr_text", F.lit(R.NAMED_RESPONDENT)) > 0
    checked = looked_at.withColumns({
        "other_numbers": others, "name_mismatch": F.coalesce(absent & other_name, F.lit(False))})
    return checked.where((F.size("other_numbers") > 0) | F.col("name_mismatch")).select(
        "document_id", "case_id", "case_number", "other_numbers", "name_mismatch")
