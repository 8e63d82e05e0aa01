"""JSON objects inside free text, and checks on their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import rules as R
from docketry.functions.money import MONEY


def json_body(text: Column) -> Column:
    """The object inside a fenced block, else the text itself when it is one, else the first flat object in it."""
    bare = F.trim(text)
    fenced = F.nullif(F.regexp_extract(bare, r"(?s)^```[^\n]*\n(.*)\n[^\n]*$", 1), F.lit(""))
    return F.coalesce(fenced, F.when(bare.rlike(r"(?s)^\{.*\}$"), bare), F.regexp_substr(bare, F.lit(r"\{[^{}]*\}")))


def text_field(body: Column, name: str) -> Column:
    return F.get_json_object(body, f"$.{name}")


def money_field(body: Column, name: str) -> Column:
    """Amount given as number or as ``$1,234.50``."""
    return F.regexp_replace(text_field(body, name), r"[$,\s]", "").try_cast(MONEY)


def missing_keys(body: Column) -> Column:
    """Required top-level keys a reply lacks; NULL when the text is no object."""
    return F.array_except(F.array(*[F.lit(k) for k in R.REQUIRED_KEYS]), F.json_object_keys(body))


def missing_sections(body: Column) -> Column:
    keys = F.json_object_keys(F.get_json_object(body, "$.comprehensive_analysis"))
    wanted = F.array(*[F.lit(k) for k in R.REQUIRED_SECTIONS])
    return F.array_except(wanted, F.coalesce(keys, F.array().cast("array<string>")))


def as_variant(text: Column) -> Column:
    """JSON of any shape as VARIANT; a text that holds JSON (doubly encoded) is unwrapped once. NULL if it cannot be read."""
    outer = F.try_parse_json(text)
    inner = F.when(F.schema_of_variant(outer) == "STRING", F.try_parse_json(F.try_variant_get(outer, "$", "string")))
    return F.coalesce(inner, outer)


def json_shape(text: Column, value: Column) -> Column:
    """``object``, ``array`` or ``value`` of a text and its VARIANT; ``broken`` if it cannot be read, ``absent`` without one."""
    kind = F.schema_of_variant(value)
    return (F.when(text.isNull(), "absent").when(value.isNull(), "broken").when(F.startswith(kind, F.lit("OBJECT")), "object")
            .when(F.startswith(kind, F.lit("ARRAY")), "array").otherwise("value"))


def variant_objects(df: DataFrame, name: str) -> DataFrame:
    """``df`` with one row per object that the VARIANT column holds: itself, or those in its array. Rows without one keep one
    row with NULL; other items of an array are dropped."""
    # one pass over the rows: two branches with a filter each would work out what lies below them twice, and in the filters again
    kind = df.withColumn("__kind", F.schema_of_variant(name))
    is_array = F.coalesce(F.startswith("__kind", F.lit("ARRAY")), F.lit(False))
    listed = kind.withColumn("__list", F.when(is_array, F.col(name)))
    items = listed.lateralJoin(
        df.sparkSession.tvf.variant_explode_outer(F.col("__list").outer()).select(F.col("value").alias("__item")))
    rows = items.where(F.col("__list").isNull() | F.startswith(F.schema_of_variant("__item"), F.lit("OBJECT")))
    own = F.when(F.startswith("__kind", F.lit("OBJECT")), F.col(name))
    return rows.withColumn(name, F.when(F.col("__list").isNull(), own).otherwise(F.col("__item"))).select(*df.columns)
