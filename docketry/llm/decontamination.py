"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

The automaton is built from the benchmark alone and sent to all tasks; a document is read once, without a shuffle. More
windows than ``WINDOWS_PER_AUTOMATON`` make further automata. A task then holds a group of documents, has each automaton
read the whole group, and adds their finds up: a worker has one automaton at a time and builds each once a group, so memory
stays bounded for any benchmark, time grows in proportion to it, and no window is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import plain, worker_cache
from docketry.llm.tokens import bounded

WINDOW = 13
WINDOWS_PER_AUTOMATON = 50_000
GROUP_CHARS = 32_000_000  # of the documents that several automata read in turn
HITS = ("doc_id {id_type}, n_words long, n_hit long, items array<string>, "
        "spans array<struct<start: long, end: long>>")
#: Byte by byte: A-Z lower-cased, digits, letters and everything outside ASCII kept, all else a space.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

Window = tuple[bytes, int, str]  # its words between spaces, their number, the item


def folded_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLDED).split()


def windows(item: str, text: str | None) -> Iterator[Window]:
    words = folded_words(text)
    for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
        part = words[i : i + WINDOW]
        yield b" " + b" ".join(part) + b" ", len(part), item


def automaton(found: list[Window]) -> ahocorasick.Automaton:
    items: dict[bytes, tuple[int, set[str]]] = {}
    for key, size, item in found:
        items.setdefault(key, (size, set()))[1].add(item)
    built = ahocorasick.Automaton()
    for key, value in items.items():
        built.add_word(key.decode("latin-1"), value)
    built.make_automaton()
    return built


class Scan:
    """What the automata find in one text: words, hit words, items, and hit stretches as offsets into the text as given."""

    def __init__(self, text: str | None):
        self.text, words = text, folded_words(text)
        self.n_words, self.items, self._edge = len(words), set(), None
        self._joined = (b" " + b" ".join(words) + b" ").decode("latin-1")

    def by(self, built: ahocorasick.Automaton) -> None:
        for end, (size, names) in built.iter(self._joined):
            if self._edge is None:
                self._spaces = np.flatnonzero(np.frombuffer(self._joined.encode("latin-1"), np.uint8) == 32)
                self._edge = np.zeros(self.n_words + 1, np.int64)
            stop = int(np.searchsorted(self._spaces, end))
            self._edge[stop - size] += 1
            self._edge[stop] -= 1
            self.items |= names

    def hits(self) -> np.ndarray:
        return np.cumsum(self._edge[:-1]) > 0 if self._edge is not None else np.zeros(0, bool)

    def spans(self) -> list[dict]:
        if self._edge is None:
            return []
        turns = np.flatnonzero(np.diff(np.concatenate(([False], self.hits(), [False])).astype(np.int8)))
        raw = self.text.encode("utf-8", "surrogatepass")
        places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLDED))]
        chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters begun up to and with each byte
        return [{"start": int(chars[places[a][0]]) - 1, "end": int(chars[places[b - 1][1] - 1])}
                for a, b in zip(turns[::2], turns[1::2], strict=True)]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[Window]]:
    block: list[Window] = []
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    for item, text in rows.toLocalIterator():
        for window in windows(item, text):
            block.append(window)
            if len(block) == WINDOWS_PER_AUTOMATON:
                yield block
                block = []
    yield block


def _automaton(sent: _Sent) -> ahocorasick.Automaton:
    """The one automaton a Python worker keeps."""
    kept = worker_cache("decontamination")
    if sent.id not in kept:
        kept.clear()
        kept[sent.id] = automaton(sent.value)
    return kept[sent.id]


def _scanned(batches: Iterator[pa.RecordBatch], column: int, blocks: list[_Sent]) -> Iterator[tuple[pa.RecordBatch, list[Scan]]]:
    """Parts of the batches with the scans of their texts: blocks outside, the texts of a group inside."""
    order = list(blocks)

    def read(group):
        for sent in order:
            built = _automaton(sent)
            for _, scans in group:
                for scan in scans:
                    if len(built) and scan.n_words:
                        scan.by(built)
        order.reverse()  # the next group starts with the automaton that is there
        return group

    group, size = [], 0
    for batch in batches:
        texts = batch.column(column).to_pylist()
        for a, b in bounded(texts):
            group.append((batch.slice(a, b - a), [Scan(t) for t in texts[a:b]]))
            size += sum(len(t or "") for t in texts[a:b])
            if len(blocks) == 1 or size >= GROUP_CHARS:
                yield from read(group)
                group, size = [], 0
    yield from read(group)


class _Sent:
    """A broadcast and the number by which a worker knows it again."""

    def __init__(self, broadcast):
        self.id, self.broadcast = broadcast._jbroadcast.id(), broadcast

    @property
    def value(self):
        return self.broadcast.value

    def __reduce__(self):
        return _received, (self.id, self.broadcast)


def _received(number: int, broadcast) -> _Sent:
    sent = object.__new__(_Sent)
    sent.id, sent.broadcast = number, broadcast
    return sent


def sent_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[_Sent]:
    context = benchmark.sparkSession.sparkContext
    return [_Sent(context.broadcast(block)) for block in _blocks(benchmark, item_col, text_col)]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids of the items met), spans (character offsets).

    NULL and empty texts have no words; items without words have no window; a NULL item id counts as the empty one, and
    items that repeat an id count once. Rows that repeat a document are each answered. Further columns are not read.
    """
    docs = plain(docs, id_col, text_col)
    blocks = sent_blocks(benchmark)
    schema = HITS.format(id_type=docs.schema["doc_id"].dataType.simpleString())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scans in _scanned(batches, 1, blocks):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.n_words for s in scans], pa.int64()), pa.array([int(s.hits().sum()) for s in scans], pa.int64()),
                 pa.array([sorted(s.items) for s in scans], pa.list_(pa.string())),
                 pa.array([s.spans() for s in scans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "items", "spans"])

    return docs.mapInArrow(read, schema)


def is_contaminated(n_hit, n_words):
    """A twentieth of the words or more lie inside benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, in one pass and without a shuffle; all columns stay. NULL and empty texts
    have no words, so they stay; rows that repeat an id are judged each, and an empty table stays empty."""
    blocks = sent_blocks(benchmark)
    column = docs.columns.index(text_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scans in _scanned(batches, column, blocks):
            yield batch.filter(pa.array([not is_contaminated(int(s.hits().sum()), s.n_words) for s in scans], pa.bool_()))

    return docs.mapInArrow(read, docs.schema)
