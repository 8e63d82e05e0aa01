"""Small helpers the text operators share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without that setting only a single-machine session gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docketry-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: lost executors cost no more than what came after it."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names, so that no further column can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample_by_hash(df: DataFrame, doc_id: Column, rows: int) -> DataFrame:
    """About ``rows`` rows in the order of a hash of the id, whatever the partitioning. Only hashes are sorted; rows that
    share the last hash all come, so what must be bounded is limited again where it is gathered."""
    hashed = F.xxhash64(doc_id)
    last = df.select(hashed.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.where(hashed <= (F.lit(last) if last is not None else F.lit(0)))


_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What ``owner`` keeps in this Python worker from task to task. Workers are used again by the next stage, so what other
    owners kept goes, and Arrow gives its free memory back: a worker never holds more than one operator's cache."""
    others = [o for o in _CACHES if o != owner]
    for other in others:
        del _CACHES[other]
    if others:
        pa.default_memory_pool().release_unused()
    return _CACHES.setdefault(owner, {})
