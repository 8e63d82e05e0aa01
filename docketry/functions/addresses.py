"""Street addresses: parts, normal forms, parcel ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.text import any_of, let, quoted


def _trailing_types() -> str:
    """Street types at the end of a name. Longer types go first, and each may be taken off once."""
    ordered = sorted(R.STREET_TYPES, key=len, reverse=True)
    return "(?i)" + "".join(rf"(?:\s+{quoted(t)})?" for t in reversed(ordered)) + "$"


TRAILING_TYPES = _trailing_types()


def street_norm(name: Column) -> Column:
    """Street name without its type, upper case."""
    return F.upper(F.trim(F.regexp_replace(F.trim(name), TRAILING_TYPES, "")))


def street_prefix(name: Column) -> Column:
    """Direction abbreviation leading a street name; full words are no prefixes."""
    pairs = [F.lit(x) for pair in R.DIRECTION_PREFIXES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.get(F.split(F.trim(name), r"\s+"), F.lit(0)))


def parcel_split(parcel_id: Column) -> Column:
    """``struct<map, block, lot>`` of a ten-digit id, else NULL."""
    bare = F.trim(parcel_id)
    return F.when(
        bare.rlike(r"^\d{10}$"),
        F.struct(F.substring(bare, 1, 4).alias("map"), F.substring(bare, 5, 2).alias("block"),
                 F.substring(bare, 7, 4).alias("lot")))


def street_clean(name: Column) -> Column:
    """Street name for portals that want neither city nor type, in title case."""
    bare = F.regexp_replace(F.upper(name), " " + any_of(R.CLEANUP_CITIES) + "$", "")
    words = F.split(F.trim(bare), r"\s+")
    last = F.element_at(words, -1)
    kept = F.when(last.isin(R.CLEANUP_STREET_TYPES), F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    return F.initcap(F.array_join(kept, " "))


def address_parts(address: Column) -> Column:
    """``struct<stnum, prefix, name, city, state, zipcode>`` of an address.

    A city that ran into the street (``4317 Scaup Court Raleigh, NC, 27616``) is found again among the known ones.
    """
    two_letters = r"^[A-Za-z]{2}$"
    state_zip = r"^([A-Z]{2})\s+(\d{5}(?:-\d{4})?)$"

    def whole(parts: Column) -> Column:
        part = lambda i: F.get(parts, F.lit(i))
        stnum = F.nullif(F.regexp_extract(part(0), r"^(\d+)\s+.+$", 1), F.lit(""))
        street = F.coalesce(F.nullif(F.regexp_extract(part(0), r"^\d+\s+(.+)$", 1), F.lit("")), part(0))

        def named(s: Column) -> Column:
            bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(s["street"]), r"^\S+\s*", ""), r"\s+", " "))
            name = street_norm(F.when(s["prefix"].isNotNull(), bare).otherwise(s["street"]))
            return let(name, lambda n: finished(s, n))

        def finished(s: Column, name: Column) -> Column:
            known = F.coalesce(*[F.when(F.endswith(name, F.lit(c.upper())), F.lit(c)) for c in R.KNOWN_CITIES])
            return let(F.struct(F.when(part(1).rlike(two_letters), known).alias("city")), lambda m: result(s, name, m["city"]))

        def result(s: Column, name: Column, merged: Column) -> Column:
            cut = street_norm(F.substring(name, F.lit(1), F.length(name) - F.length(merged)))
            third = F.when(part(2).rlike(state_zip), F.regexp_extract(part(2), state_zip, 1)).when(
                part(2).rlike(two_letters), F.upper(part(2)))
            return F.struct(
                stnum.alias("stnum"), s["prefix"].alias("prefix"),
                F.when(merged.isNotNull(), cut).otherwise(name).alias("name"), F.coalesce(merged, part(1)).alias("city"),
                F.coalesce(third, F.when(merged.isNotNull(), F.upper(part(1)))).alias("state"),
                F.nullif(F.regexp_extract(part(2), state_zip, 2), F.lit("")).alias("zipcode"))

        return let(street, lambda x: let(F.struct(x.alias("street"), street_prefix(x).alias("prefix")), named))

    trimmed = F.transform(F.split(F.nullif(address, F.lit("")), ","), lambda x: F.trim(x))
    return let(trimmed, lambda parts: F.when(parts.isNotNull(), whole(parts)))


def with_address_parts(df: DataFrame, address: str = "property_address") -> DataFrame:
    """Add stnum, prefix, name, city, state and zipcode."""
    names = ("stnum", "prefix", "name", "city", "state", "zipcode")
    return df.withColumn("__a", address_parts(F.col(address))).select(*df.columns, *[F.col(f"__a.{n}").alias(n) for n in names])
