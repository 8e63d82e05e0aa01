"""Documents to packed training sequences: the stages in order, each on what the one before it kept.

Every stage but the last returns the columns it got, further ones included, whatever their names. NULL ids and repeated ids
are no reason to drop a row; an empty table stays empty at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import decontamination, exact_dedup, language_id, near_dedup
from docketry.llm.queries import language_identifier, pack_documents, table


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a language the documents' own ``lang`` taught; NULL, empty and letterless texts have none."""
    return language_id.keep_known(docs, language_identifier(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space folded: that of the smallest id, NULL ids last."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id; rows with a NULL id stay."""
    return near_dedup.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words lie in passages of the benchmark; texts without words stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 4,096 tokens; an empty text is its end token alone."""
    return pack_documents(docs)


STAGES = [
    ("language", known_languages),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", into_sequences),
]
ORACLE_SQL = None  # the language model and the tokenizer have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
