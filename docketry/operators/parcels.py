"""County look-ups as joins to parcel tables, and what follows from their outcome."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.addresses import address_parts, parcel_split, with_address_parts
from docketry.functions.counties import county_source, number_suffix
from docketry.functions.dates import as_moment
from docketry.functions.links import deed_url
from docketry.functions.ranges import block_at, dyadic_blocks
from docketry.operators.ranking import group_rank, keep_first


def _accounts(parcels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows and accounts per key; the key is unique, so joins to it never multiply."""
    return parcels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{label}_rows"), F.min("account_id").alias(f"{label}_low"), F.max("account_id").alias(f"{label}_high"))


def _city_code(city: Column) -> Column:
    pairs = [F.lit(x) for pair in R.CITY_CODES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(city))


def _rolled_up(fine: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``_accounts`` of fewer keys out of those by city, which are far fewer rows than the parcels."""
    return fine.groupBy(*keys).agg(F.sum("city_rows").alias(f"{label}_rows"), F.min("city_low").alias(f"{label}_low"),
                                   F.max("city_high").alias(f"{label}_high"))


def _left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a text column. Rows of ``left`` without a key match nothing: a key of their own, which starts with a
    sign no key has, spreads them over all tasks."""
    own = F.concat(F.lit("\u0000"), F.col("case_id").cast("string"))
    return left.withColumn("__key", F.coalesce(F.col(key), own)).join(
        right.withColumnRenamed(key, "__key"), "__key", "left").drop("__key")


def match_parcels(addresses: DataFrame, parcels: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Account per parsed address (case_id, stnum, prefix, name, city): (case_id, account_id, single_id, matches_found).

    Number, direction and name must agree, and the city code where the city has one. One row, or several rows of one
    account, is a match; failing that, a search that brought up a single row is accepted whatever its city. ``single_id`` is
    the account of such a row alone. Columns named in ``also`` must agree as well.
    """
    p = parcels.select(*also, "account_id", "stnum", F.upper(F.coalesce(F.trim("prefix"), F.lit(""))).alias("prefix"),
                       F.upper("street_name").alias("name"), F.upper("etj").alias("etj"))
    key = [*also, "stnum", "name"]
    fine = _accounts(p, [*key, "prefix", "etj"], "city")
    a = addresses.select(*also, "case_id", "stnum", F.coalesce("prefix", F.lit("")).alias("prefix"), F.upper("name").alias("name"),
                         _city_code(F.col("city")).alias("etj"))
    t = (
        a.join(_rolled_up(fine, key, "wide"), key, "left")
        .join(_rolled_up(fine, [*key, "prefix"], "street"), [*key, "prefix"], "left")
        .join(fine, [*key, "prefix", "etj"], "left")
    )
    has_city, has_prefix = F.col("etj").isNotNull(), F.col("prefix") != ""
    low = F.when(has_city, F.col("city_low")).otherwise(F.col("street_low"))
    high = F.when(has_city, F.col("city_high")).otherwise(F.col("street_high"))
    found = F.coalesce(F.when(has_prefix, F.col("street_rows")).otherwise(F.col("wide_rows")), F.lit(0))
    only = F.when(found == 1, F.when(has_prefix, F.col("street_low")).otherwise(F.col("wide_low")))
    return t.select("case_id", F.coalesce(F.when(low == high, low), only).alias("account_id"), only.alias("single_id"), found.alias("matches_found"))


def match_prefixed(addresses: DataFrame, streets: DataFrame, parcels: DataFrame) -> DataFrame:
    """``match_parcels`` for addresses with a direction, which a county looks up in two steps: first the street whose
    direction, name and number range fit, then the parcels on it. Without such a street nothing is found.

    ``streets`` are rows of ``ingest_parcel_pages`` with ``locid`` as their id. Adds ``locid`` to the match.
    """
    named = addresses.where(F.length("prefix") > 0)
    a = named.select("case_id", "stnum", F.upper("prefix").alias("prefix"), F.upper("name").alias("name"), "city",
                     F.col("stnum").try_cast("bigint").alias("number"))
    found = _street_ids(a, streets.withColumnRenamed("locid", "account_id"), ["prefix", "name"])
    hits = match_parcels(found.where(F.col("street_id").isNotNull()), parcels)
    return found.select("case_id", F.col("street_id").alias("locid")).join(hits, "case_id", "left").select(
        "case_id", "locid", "account_id", F.coalesce("matches_found", F.lit(0)).alias("matches_found"))


def match_street_ranges(addresses: DataFrame, streets: DataFrame) -> DataFrame:
    """Lowest street id whose direction, name and number range fit each address; missing bounds fit any number.

    A range becomes aligned blocks of powers of two, two a level at most, whatever its bounds; an address meets one block of
    each level that occurs. Both sides join on equal keys, and every key has one row of ``streets``.
    """
    key = ["prefix", "name"]
    a = addresses.select("case_id", F.coalesce("prefix", F.lit("")).alias("prefix"), F.upper("name").alias("name"),
                         F.col("stnum").cast("bigint").alias("number"))
    return _street_ids(a, streets, key).select("case_id", F.col("street_id").alias("account_id"))


def _street_ids(addresses: DataFrame, streets: DataFrame, key: list[str]) -> DataFrame:
    """``addresses`` (key columns, number) with the lowest id of the streets that fit, NULL if none does."""
    s = streets.select("account_id", *[F.col(k) for k in key if k not in ("prefix", "name")],
                       F.upper(F.coalesce(F.trim("prefix"), F.lit(""))).alias("prefix"), F.upper("street_name").alias("name"),
                       F.col("low_num").cast("bigint").alias("low"), F.col("high_num").cast("bigint").alias("high"))
    bounded = F.col("low").isNotNull() & F.col("high").isNotNull()
    open_ended = s.where(~bounded).groupBy(*key).agg(F.min("account_id").alias("any_id"))
    blocks = s.where(bounded).select(*key, "account_id", F.inline(dyadic_blocks(F.col("low"), F.col("high")))).groupBy(
        *key, "level", "block").agg(F.min("account_id").alias("block_id"))
    levels = [r["level"] for r in blocks.select("level").distinct().collect()]  # 62 numbers at most
    met = addresses.select(*key, "number").distinct().withColumn("level", F.explode(F.array([F.lit(k) for k in levels]).cast("array<int>")))
    met = met.withColumn("block", block_at(F.col("number"), F.col("level"))).join(blocks, [*key, "level", "block"]).groupBy(
        *key, "number").agg(F.min("block_id").alias("block_id"))
    t = addresses.join(open_ended, key, "left").join(met, [*key, "number"], "left")
    return t.select(*addresses.columns, F.least("any_id", "block_id").alias("street_id"))


def route(cases: DataFrame) -> DataFrame:
    """County source per case number, or why there is none."""
    code = number_suffix(F.col("case_number"))
    source = county_source(code)
    error = F.when(code.isNull(), "Could not determine county code").when(source.isNull(), F.concat(F.lit("Unknown county code: "), code))
    return cases.select("case_id", "case_number", source.alias("source"), error.alias("error"))


def county_policies(spark: SparkSession, as_of: datetime | str = "") -> DataFrame:
    """One row per county source: how it is searched, what it says, and its link template with the year filled in."""
    links = R.PROPERTY_URLS | {"lee_re": R.LEE_PROPERTY_URL.replace("%s", "{}").format("%s", str(as_of)[:4])}
    rows = [(source, methods, rule, absent, none, many, links[source]) for source, methods, rule, absent, none, many in R.COUNTY_POLICIES]
    return spark.createDataFrame(rows, "source string, methods array<string>, rule string, absent_message string, none_message string, "
                                       "many_message string, link string")


def look_up(cases: DataFrame, parcels: DataFrame, parcel_ids: DataFrame, policies: DataFrame) -> DataFrame:
    """Outcome per case of ``cases`` (with its ``source``): success, review or error, with method, account, link, matches.

    The methods of the source's policy are tried in their order; the first the case has something to search for decides
    alone. ``parcels`` and ``parcel_ids`` (parcel_id, account_id) carry the source they belong to. Cases of a source
    without a policy have no row.
    """
    by_id = _accounts(parcel_ids, ["source", "parcel_id"], "id").select(
        F.concat_ws("\u0001", "source", "parcel_id").alias("id_key"), "id_rows", "id_low")
    own = cases.select("case_id", "case_number", "source", "parcel_id", "property_address")
    parsed = with_address_parts(own.join(F.broadcast(policies), "source"))  # a row a county
    searchable = F.col("stnum").isNotNull() & (F.length("name") > 0)
    can = F.array_contains("methods", "address") & searchable
    by_address = match_parcels(parsed.where(can), parcels, ("source",))
    valid = F.array_contains("methods", "parcel_id") & parcel_split(F.col("parcel_id")).isNotNull()
    t = (
        _left_join(parsed.withColumn("id_key", F.when(valid, F.concat_ws("\u0001", "source", F.trim("parcel_id")))), by_id, "id_key")
        .join(by_address, "case_id", "left")
    )
    has_id, has_address = F.col("id_key").isNotNull(), F.length("property_address") > 0
    usable = F.array(F.when(has_id, "parcel_id"), F.when(F.array_contains("methods", "address") & has_address, "address"))
    method = F.get(F.filter("methods", lambda m: F.array_contains(F.array_compact(usable), m)), F.lit(0))
    t = t.withColumn("method", method)
    ids, seeks = F.col("method") == "parcel_id", F.col("method") == "address"
    ids, seeks = F.coalesce(ids, F.lit(False)), F.coalesce(seeks, F.lit(False))
    rows = F.when(ids, F.coalesce("id_rows", F.lit(0))).when(seeks, F.col("matches_found"))
    account = F.when(ids, F.when(rows == 1, F.col("id_low"))).when(
        seeks & searchable, F.when(F.col("rule") == "account", F.col("account_id")).otherwise(F.col("single_id")))
    searched = ids | (seeks & searchable)
    said = F.when(ids, F.when(rows == 0, R.NOTHING_FOUND).otherwise("%s matches found")).otherwise(
        F.when(rows == 0, F.col("none_message")).otherwise(F.col("many_message")))
    message = (
        F.when(account.isNotNull(), None).when(searched, F.replace(said, F.lit("%s"), rows.cast("string")))
        .when(seeks, F.concat(F.lit("Could not parse address: "), "property_address")).otherwise(F.col("absent_message")))
    return t.select(
        "case_id", "source", F.when(account.isNotNull(), "success").when(searched, "review").otherwise("error").alias("status"), "method",
        account.alias("account_id"), F.replace("link", F.lit("%s"), account).alias("url"), rows.alias("matches_found"), message.alias("message"),
        F.when(ids, F.trim("parcel_id")).otherwise(F.col("property_address")).alias("search_value"))


def enrich(cases: DataFrame, parcels: DataFrame, parcel_ids: DataFrame, source: str = "wake_re", as_of: datetime | str = "") -> DataFrame:
    """``look_up`` of all cases in the tables of one county, whose rows carry no source."""
    of = lambda df: df.withColumn("source", F.lit(source))
    return look_up(of(cases), of(parcels), of(parcel_ids), county_policies(cases.sparkSession, as_of)).drop("source")


def look_up_all(cases: DataFrame, parcels: DataFrame, parcel_ids: DataFrame, as_of: datetime | str) -> DataFrame:
    """``look_up`` of every case at the county its number names; without a known county an error row, as ``route`` says."""
    routed = route(cases).select("case_id", "source", F.col("error").alias("route_error"))
    t = cases.drop("source").join(routed, "case_id")
    found = look_up(t.where(F.col("source").isNotNull()), parcels, parcel_ids, county_policies(cases.sparkSession, as_of))
    lost = t.where(F.col("source").isNull()).select("case_id", F.lit("error").alias("status"), F.col("route_error").alias("message"))
    return found.unionByName(lost, allowMissingColumns=True)


def upsert_enrichments(current: DataFrame, new: DataFrame, sequence: str) -> DataFrame:
    """Merge by (case_id, source); the last new row wins, cases without a new row keep theirs."""
    newest = keep_first(new, ["case_id", "source"], [F.col(sequence).desc()]).drop(sequence)
    kept = current.join(newest.select("case_id", "source"), ["case_id", "source"], "left_anti")
    return kept.unionByName(newest)


def review_log(outcomes: DataFrame, source: str | None = None) -> DataFrame:
    """Rows for manual review, of one source or of the one each outcome names."""
    return outcomes.where(F.col("status") == "review").select(
        "case_id", (F.lit(source) if source else F.col("source")).alias("enrichment_type"), F.col("method").alias("search_method"),
        "search_value", "matches_found")


def with_raw_results(log: DataFrame, as_of: datetime | str) -> DataFrame:
    """The log as it is stored: what was searched for as VARIANT, when it was logged, and no resolution yet.

    Accounts a search brought up are in ``search_results`` by search and value, once however many cases share a search.
    """
    parts = address_parts(F.when(F.col("search_method") == "address", F.col("search_value")))
    raw = F.to_json(F.struct(parts.alias("parsed"), F.col("search_value").alias("value"), F.col("matches_found").alias("matches")))
    return log.withColumns({"raw_results": F.parse_json(raw), "created_at": as_moment(as_of).cast("timestamp_ntz"),
                            "resolved_at": F.lit(None).cast("timestamp_ntz"), "resolution_notes": F.lit(None).cast("string")})


def search_results(parcels: DataFrame, rows: int = 500) -> DataFrame:
    """(source, stnum, name, chunk, results): the accounts at each number and street as VARIANT arrays of at most ``rows``."""
    numbered = group_rank(parcels.select("source", "stnum", F.upper("street_name").alias("name"), "account_id", "prefix", "etj"),
                          ["source", "stnum", "name"], ["account_id"], [F.col("prefix").asc_nulls_first(), F.col("etj").asc_nulls_first()], "__n")
    item = F.struct("account_id", "prefix", "etj")
    return numbered.groupBy("source", "stnum", "name", F.floor((F.col("__n") - 1) / rows).cast("int").alias("chunk")).agg(
        F.parse_json(F.to_json(F.array_sort(F.collect_list(item)))).alias("results"))


def resolve_reviews(log: DataFrame, resolutions: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(log with resolution stamps, enrichment rows that follow). Only open items resolve, and only with an account
    does an enrichment of the item's source follow. Notes of a resolution are kept if both sides have the column."""
    notes = "resolution_notes" in log.columns and "resolution_notes" in resolutions.columns
    said = [F.col("resolution_notes").alias("__notes")] if notes else []
    t = log.join(resolutions.select("case_id", "account_id", F.lit(True).alias("__hit"), *said), "case_id", "left")
    now = F.when(F.col("__hit") & F.col("resolved_at").isNull(), as_moment(as_of))
    stamped = t.withColumn("__new", now)
    if notes:
        stamped = stamped.withColumn("resolution_notes", F.when(F.col("__new").isNotNull(), F.col("__notes")).otherwise(F.col("resolution_notes")))
    follow = stamped.where(F.col("__new").isNotNull() & F.col("account_id").isNotNull())
    return (
        stamped.withColumn("resolved_at", F.coalesce("resolved_at", "__new")).select(*log.columns),
        follow.select("case_id", F.col("enrichment_type").alias("source"), F.col("account_id").alias("ref_id"), F.lit(None).cast("string").alias("error")),
    )


def join_valuations(cases: DataFrame, valuations: DataFrame, enriched: DataFrame, force: bool = False) -> DataFrame:
    """Value by address for cases not valued yet (or all, when forced).

    ``enriched`` says which are: by a ``url`` if it has that column, else by ``ref_id``. Link and asking price come along
    if the valuations have them.
    """
    mark = "url" if "url" in enriched.columns else "ref_id"
    todo = cases if force else cases.join(enriched.where(F.length(mark) > 0).select("case_id"), "case_id", "left_anti")
    t = _left_join(todo.select("case_id", F.nullif(F.col("property_address"), F.lit("")).alias("property_address")), valuations, "property_address")
    known = F.col("url") if "url" in valuations.columns else F.col("estimate")
    error = F.when(F.col("property_address").isNull(), "No property_address available").when(known.isNull(), "No value found")
    return t.select("case_id", *[c for c in ("url", "estimate", "price") if c in valuations.columns], error.alias("error"))


def deed_todo(analyses: DataFrame, cases: DataFrame, linked: DataFrame) -> DataFrame:
    """Completed analyses with book and page whose case has no deed link yet."""
    ready = analyses.where(F.col("deed_book").isNotNull() & F.col("deed_page").isNotNull() & (F.col("status") == "completed"))
    t = ready.join(linked.select("case_id"), "case_id", "left_anti").join(cases.select("case_id", "case_number"), "case_id")
    return t.select("case_id", "case_number", deed_url(F.col("case_number"), F.col("deed_book"), F.col("deed_page")).alias("deed_url"))


def enrich_todo(cases: DataFrame, enrichments: DataFrame, county_code: str = "910") -> DataFrame:
    """upset_bid cases of one county no look-up has been tried for, earliest deadline first."""
    tried = enrichments.where(F.col("source") == R.SOURCE_BY_COUNTY_CODE[county_code]).where(
        F.col("ref_id").isNotNull() | F.col("error").isNotNull())
    open_cases = cases.where((F.col("county_code") == county_code) & (F.col("classification") == R.UPSET_BID))
    return open_cases.join(tried.select("case_id"), "case_id", "left_anti").select(
        "case_id", "case_number", "parcel_id", "property_address", "next_bid_deadline").orderBy(F.asc_nulls_last("next_bid_deadline"), "case_id")


def wide_enrichments(enrichments: DataFrame) -> DataFrame:
    """One row per case with the reference id of each source."""
    return enrichments.groupBy("case_id").pivot("source", list(R.SOURCE_BY_COUNTY_CODE.values())).agg(F.first("ref_id", ignorenulls=True))
