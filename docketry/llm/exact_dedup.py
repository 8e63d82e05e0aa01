"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut after every word whose hash ends in six zero bits, so equal passages give equal chunks wherever they stand.
Each chunk gets a 128-bit identifier. The chunk store (one row per different chunk, whatever the number of documents)
verifies that no two chunks share an identifier; if two ever do, all identifiers are made again with the next seed. A
document is then its ordered list of identifiers: texts are equal exactly when the lists are. Only these short lists are
grouped and joined; a chunk's text is moved once, after each task has dropped its repeats.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import cut, plain

CUT_ONE_IN = 64  # words
LONGEST_CHUNK = 1024  # words, for stretches without a cut


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(norm: Column) -> Column:
    """Pieces whose concatenation is ``norm``; a line feed cannot occur in ``norm`` and so marks the cuts."""
    marked = F.transform(
        F.split(norm, " "),
        lambda w, i: F.when((F.xxhash64(w) % CUT_ONE_IN == 0) | (i % LONGEST_CHUNK == LONGEST_CHUNK - 1),
                            F.concat(w, F.lit("\n"))).otherwise(w),
    )
    return F.split(F.array_join(marked, " "), "\n")


def _halves(chunk: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(seed), chunk), F.xxhash64(chunk, F.lit(seed))


def recipe(parts: Column, seed: int) -> Column:
    """First halves of all identifiers, then second halves: lists are equal exactly when all identifiers are."""
    return F.concat(F.transform(parts, lambda c: _halves(c, seed)[0]), F.transform(parts, lambda c: _halves(c, seed)[1]))


def identifiers_are_unique(docs: DataFrame, seed: int) -> bool:
    """Whether the chunk store has one text per identifier."""
    parts = docs.select(F.explode(chunks(normalised(F.col("text")))).alias("chunk"))
    first, second = _halves(F.col("chunk"), seed)
    store = parts.select(first.alias("a"), second.alias("b"), "chunk").distinct()
    return store.groupBy("a", "b").count().where(F.col("count") > 1).isEmpty()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each run of ASCII white space became one space. NULL counts as the empty
    text. The smallest id of a group stays; rows that repeat an id and a text share the decision (``drop_copies`` keeps one
    of them). NULL ids are never chosen while the group has another id; a group of NULL ids only keeps all its rows.
    An empty table gives an empty result; further columns of ``docs`` are not read.
    """
    docs = plain(docs, id_col, text_col)
    seed = next(s for s in count(1) if identifiers_are_unique(docs, s))
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    lists = cut(norm.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
                            recipe(chunks(F.col("norm")), seed).alias("recipe")))
    groups = lists.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return lists.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that tell rows apart by id and text."""
    parts = [doc_id.isNull(), doc_id, text.isNull(), text]
    return [F.xxhash64(F.lit(1), *parts).alias("row_a"), F.xxhash64(*reversed(parts), F.lit(1)).alias("row_b")]


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay. The row is chosen by text, not by id: the one
    with the smallest id, NULL ids last, so rows that share an id or have none are only dropped if their text stays. NULL
    counts as the empty text. Of rows that repeat an id and a text any one stays. An empty table stays empty.

    Only lists of identifiers and row keys are grouped; a document is moved once, when the rows that stay are picked.
    """
    seed = next(s for s in count(1) if identifiers_are_unique(plain(docs, id_col, text_col), s))
    own = _row_key(F.col(id_col), F.col(text_col).cast("string"))
    listed = docs.select(F.col(id_col).alias("doc_id"), *own, normalised(F.col(text_col).cast("string")).alias("norm"))
    listed = listed.select("doc_id", "row_a", "row_b", recipe(chunks(F.col("norm")), seed).alias("recipe"))
    listed = listed.withColumn("hash", F.xxhash64("recipe"))  # sorts faster than the list
    rows = listed.groupBy("hash", "recipe", "row_a", "row_b").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_a", "row_b", "times"))
    kept = cut(rows.groupBy("hash", "recipe").agg(first.alias("first")).select("first.row_a", "first.row_b", "first.times"))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *own)
    # a hashed join: whole documents are not sorted
    stay = tagged.join(kept.hint("shuffle_hash"), ["row_a", "row_b"])
    if not kept.where("times > 1").isEmpty():  # rows that stand in the table more than once
        again = stay.where("times > 1").groupBy("row_a", "row_b").agg(F.first("row").alias("row"))
        stay = stay.where("times = 1").select("row").unionByName(again.select("row"))
    return stay.select("row.*")
