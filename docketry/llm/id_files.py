"""Token-id files: documents in ascending id order, coded in blocks, written and read by Spark.

A row of the files is one block: shard (the place of its range of document ids), block, run, where its first id stands in
the shard, the documents that end in it and their last places, and the coded payload. A block holds whole documents; only
one longer than ``BLOCK`` ids goes on in further blocks, which share a run. Files are Parquet with the payload as binary, so
Spark's commit protocol guards them in any store, and a lost task writes or reads its blocks again. Memory is a block's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import plain
from docketry.llm.id_codec import decode_block, encode_block
from docketry.llm.tokens import ENCODED_CHARS, bounded, encoder

BLOCK = 1 << 21  # ids
COLUMNS = "shard int, block int, run int, start long, doc_ids array<{id_type}>, ends array<int>, payload binary"


def _block_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("run", pa.int32()), ("start", pa.int64()),
                      ("doc_ids", pa.list_(id_type)), ("ends", pa.list_(pa.int32())), ("payload", pa.binary())])


class _Blocks:
    """Gathers the documents of a shard into block rows."""

    def __init__(self, schema: pa.Schema, vocabulary: int, size: int):
        self.schema, self.vocabulary, self.size = schema, vocabulary, size
        self.shard = TaskContext.get().partitionId()
        self.block = self.start = self.held = 0
        self.parts, self.docs, self.ends = [], [], []

    def add(self, doc_id: object, ids: bytes) -> Iterator[pa.RecordBatch]:
        if self.held and self.held + len(ids) // 4 > self.size:
            yield self.close(self.block)
        run = self.block
        for at in range(0, len(ids), 4 * self.size):
            part = ids[at : at + 4 * self.size]
            self.parts.append(part)
            self.held += len(part) // 4
            if at + len(part) < len(ids):
                yield self.close(run)
        self.docs.append(doc_id)
        self.ends.append(self.held)
        if len(ids) > 4 * self.size:
            yield self.close(run)

    def close(self, run: int) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(self.parts), "<u4").astype(np.int64)
        row = {"shard": self.shard, "block": self.block, "run": run, "start": self.start, "doc_ids": self.docs, "ends": self.ends,
               "payload": encode_block(ids, self.vocabulary)}
        self.block += 1
        self.start += self.held
        self.held, self.parts, self.docs, self.ends = 0, [], [], []
        return pa.RecordBatch.from_pylist([row], self.schema)


def write_ids(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, keep_white: bool = True,
              id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> None:
    """Write the ids of all documents, each followed by ``end_id``, below ``path`` (a folder that all executors share).

    NULL and empty texts are the end id alone. NULL ids come first; rows that share an id follow each other in the order
    of a hash of their text. An empty table gives files without blocks.
    """
    docs = plain(docs, id_col, text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for batch in batches:
            blocks = blocks or _Blocks(_block_schema(batch.schema.field("doc_id").type), vocabulary, block)
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in bounded(texts, ENCODED_CHARS):
                for doc_id, ids in zip(doc_ids[a:b], encoder(tokenizer, keep_white).encode(texts[a:b]), strict=True):
                    yield from blocks.add(doc_id, ids + end)
        if blocks and blocks.held:
            yield blocks.close(blocks.block)

    order = ["doc_id", F.xxhash64("text")]
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(code, COLUMNS.format(id_type=id_type)).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    A damaged block fails the read.
    """
    files = spark.read.parquet(path)
    lengths = files.groupBy("shard").agg(F.max(F.struct("start", F.coalesce(F.array_max("ends"), F.lit(0)).alias("n"))).alias("last"))
    before, total = {}, 0
    for row in lengths.select("shard", "last.start", "last.n").orderBy("shard").collect():  # one short row a shard
        before[row["shard"]] = total
        total += row["start"] + row["n"]
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, start = [], None  # of a document that goes on
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = decode_block(row.column("payload")[0].as_py()).astype("<u4").tobytes()
                place = before[row.column("shard")[0].as_py()] + row.column("start")[0].as_py()
                doc_ids, ends = row.column("doc_ids").flatten(), row.column("ends")[0].as_py()
                first = place if start is None else start
                if not ends:
                    held.append(ids)
                    start = first
                    continue
                at, starts, sizes, parts = 0, [], [], []
                for end in ends:
                    held.append(ids[4 * at : 4 * end])
                    parts.append(b"".join(held))
                    starts.append(first)
                    sizes.append(len(parts[-1]) // 4)
                    at, held, first = end, [], place + end
                start = None
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    # a run's blocks meet in one task in their order; nearly all runs are one block
    runs = files.repartition("shard", "run").sortWithinPartitions("shard", "run", "block")
    return runs.mapInArrow(decode, f"doc_id {id_type}, start long, n_tokens long, ids binary")
