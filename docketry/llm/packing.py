"""Bounded-space online best-fit packing of token ids.

A task packs the documents of its partition as they come, without a shuffle. It holds a fixed number of open sequences,
found by free space through one bitset: the lowest set bit at or above a piece's length is the best fit, the lowest set
bit of all is the fullest sequence, which is closed when a further one must be opened. So memory is the same for any
number of documents, and a lost task can be done again from its own partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docketry.llm.common import plain
from docketry.llm.tokens import ENCODED_CHARS, bounded, encoder

LENGTH = 4096
OPEN_SEQUENCES = 512
SEQUENCES_PER_TASK = 1 << 40  # numbers a partition may use
PIECES = "doc_id {id_type}, piece int, start long, length long, ids binary, sequence_id long, offset long"


class BestFit:
    """``place(length)`` gives (sequence number, offset) of a piece of at most ``capacity`` tokens."""

    def __init__(self, capacity: int = LENGTH, open_sequences: int = OPEN_SEQUENCES):
        self._capacity, self._most = capacity, open_sequences
        self._by_space: dict[int, list[int]] = {}
        self._spaces = self._open = self._next = 0

    def place(self, length: int) -> tuple[int, int]:
        fitting = self._spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self._open == self._most:
                self._take((self._spaces & -self._spaces).bit_length() - 1)
            space, number = self._capacity, self._next
            self._next += 1
        left = space - length
        if left:
            self._by_space.setdefault(left, []).append(number)
            self._spaces |= 1 << left
            self._open += 1
        return number, self._capacity - space

    def _take(self, space: int) -> int:
        numbers = self._by_space[space]
        number = numbers.pop()
        if not numbers:
            self._spaces ^= 1 << space
        self._open -= 1
        return number


def packed(docs: DataFrame, encode: Callable[[list[str | None]], list[bytes]], end_id: int, id_col: str = "doc_id",
           text_col: str = "text", capacity: int = LENGTH, open_sequences: int = OPEN_SEQUENCES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    ``encode`` gives such ids of many texts; each document ends with ``end_id``. Only documents longer than ``capacity``
    are cut. NULL and empty texts are the end id alone; rows that repeat an id are packed once each; a NULL id stays NULL.
    """
    docs = plain(docs, id_col, text_col)
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(capacity, open_sequences)
        first = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in bounded(texts, ENCODED_CHARS):
                row, piece, start, length, ids, sequence, offset = [], [], [], [], [], [], []
                for i, coded in enumerate(encode(texts[a:b]), a):
                    coded += end
                    for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                        part = coded[at : at + 4 * capacity]
                        number, place = fit.place(len(part) // 4)
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        ids.append(part)
                        sequence.append(first + number)
                        offset.append(place)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(sequence, pa.int64()),
                     pa.array(offset, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return docs.mapInArrow(pack, PIECES.format(id_type=docs.schema["doc_id"].dataType.simpleString()))


def packed_with(docs: DataFrame, path: str, end_id: int, keep_white: bool = False, **options) -> DataFrame:
    """``packed`` with the tokenizer file at ``path``, which every executor must see."""
    return packed(docs, lambda texts: encoder(path, keep_white).encode(texts), end_id, **options)
