"""SimHash near-dedup with vantage-point trees.

Fingerprints are made in one pass; equal ones become one node, so copies cost nothing further. A vantage-point tree over
a bounded sample deals the nodes to shards: at each tree node they part by Hamming distance to a vantage point, and by the
triangle bound only those within ``RADIUS`` beyond the boundary go to both sides. Every pair within the radius therefore
meets in a shard, where the tree goes on in memory until blocks are small enough to compare exactly. A shard hands on a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut, plain, sample_by_hash, worker_cache
from docketry.llm.components import stars
from docketry.llm.tokens import bounded

WORDS = 3
RADIUS = 3
SAMPLE = 65_536  # fingerprints that place the vantage points
SHARD = 30_000  # nodes a shard should have
DEEPEST = 12  # levels, so 4,096 shards at most: larger shards go on in memory
BLOCK = 384  # nodes compared all with all
GAIN = 0.9  # a split must leave each side less than this share

_LOW = np.uint64(0x0101010101010101)
_EIGHT = np.arange(8, dtype=np.uint64)


def shingle_hashes(text: str | None) -> list[int]:
    """XXH64 of each run of ``WORDS`` words, or of the whole sequence of fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= WORDS:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts = [0, *[s + 1 for s in spaces]]
    ends = [*spaces[WORDS - 1 :], len(joined)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], 42) for s, e in zip(starts, ends, strict=False)]


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is in over half of the text's hashes; no words give zero."""
    hashes = [np.array(shingle_hashes(t), np.uint64) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    every = np.concatenate([hashes[i] for i in full])
    # eight counters to a word overflow after 255 hashes: add up stretches of that length, then the stretches of a text
    pieces = -(-sizes[full] // 255)
    first = np.cumsum(pieces) - pieces
    base = np.cumsum(sizes[full]) - sizes[full]
    starts = np.repeat(base, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    bits = np.zeros(len(full), np.uint64)
    for b in range(8):
        packed = np.add.reduceat((every >> np.uint64(b)) & _LOW, starts)
        counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * counts > sizes[full, None]).astype(np.uint64)
        bits |= (over << (8 * _EIGHT + np.uint64(b))).sum(axis=1, dtype=np.uint64)
    out[full] = bits
    return out


def _forest_by_search(points: np.ndarray) -> Iterator[np.ndarray]:
    """Links of a spanning forest, each point once against those not reached yet."""
    left = points
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue[-1]) <= RADIUS
            at = queue.pop()
            if near.any():
                found = left[near]
                yield np.stack([np.full(len(found), at), found])
                queue.extend(found)
                left = left[~near]


def _split(points: np.ndarray) -> tuple[np.uint64, int, np.ndarray, np.ndarray] | None:
    """Vantage point, boundary and the two overlapping sides; None if no vantage point tried parts them."""
    for i in range(4):
        vantage = points[(len(points) * (2 * i + 1)) // 8]
        away = np.bitwise_count(points ^ vantage)
        boundary = int(np.sort(away)[(len(points) - 1) // 2])
        inside, outside = points[away <= boundary + RADIUS], points[away > boundary]
        if max(len(inside), len(outside)) < GAIN * len(points):
            return vantage, boundary, inside, outside
    return None


def forest(points: np.ndarray) -> Iterator[np.ndarray]:
    """Links (2 x n arrays) that connect just what the pairs within ``RADIUS`` connect; ``points`` are distinct."""
    rest = [points]
    while rest:
        block = rest.pop()
        if len(block) > BLOCK and (parts := _split(block)):
            rest += parts[2:]
        elif len(block) > BLOCK:
            yield from _forest_by_search(block)
        elif len(block) > 1:
            a, b = np.nonzero(np.triu(np.bitwise_count(block[:, None] ^ block[None, :]) <= RADIUS, 1))
            if len(a) > 4 * len(block):
                yield from _forest_by_search(block)
            elif len(a):
                yield np.stack([block[a], block[b]])


class Tree:
    """The upper levels: ``shards`` numbers the leaves, each fingerprint goes to one or more."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.leaves = 0
        self._root = self._grow(sample, depth)

    def _grow(self, sample: np.ndarray, depth: int):
        parts = _split(sample) if depth and len(sample) > 16 else None
        if parts is None:
            self.leaves += 1
            return self.leaves - 1
        vantage, boundary, inside, outside = parts
        return vantage, boundary, self._grow(inside, depth - 1), self._grow(outside, depth - 1)

    def deal(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        rest = [(self._root, points)]
        while rest:
            node, some = rest.pop()
            if isinstance(node, int):
                yield node, some
            elif len(some):
                vantage, boundary, inner, outer = node
                away = np.bitwise_count(some ^ vantage)
                rest += [(inner, some[away <= boundary + RADIUS]), (outer, some[away > boundary])]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, further columns) with ``bits`` in place of the text."""
    further = docs.drop("doc_id", "text").schema
    names = ["doc_id", "bits", *further.names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near dedup")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts = [fingerprints(texts[a:b]) for a, b in bounded(texts)]
            bits = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits), *batch.columns[2:]], names)

    kinds = [f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", "bits long", *[f"{f.name} {f.dataType.simpleString()}" for f in further]]
    return docs.mapInArrow(read, ", ".join(kinds))


def near_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (``bits``) that connect what pairs within the radius connect."""
    number = nodes.count()
    depth = min(DEEPEST, max(0, int(np.ceil(np.log2(max(1, number) / SHARD)))))
    sample = sample_by_hash(nodes, F.col("bits"), SAMPLE).select("bits").limit(SAMPLE).toPandas()["bits"].to_numpy(np.int64).view(np.uint64)
    built = Tree(sample, depth)
    tree = nodes.sparkSession.sparkContext.broadcast(built)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, some in tree.value.deal(frame["bits"].to_numpy(np.int64).view(np.uint64)):
                yield pd.DataFrame({"shard": np.int32(shard), "bits": some.view(np.int64)})

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = list(forest(np.unique(frame["bits"].to_numpy(np.int64).view(np.uint64))))
        both = np.concatenate([np.zeros((2, 0), np.uint64), *found], axis=1).view(np.int64)
        return pd.DataFrame({"a": both[0], "b": both[1]})

    # a shard's rows are few and its work is not: a fixed number of partitions keeps small shards from being merged
    dealt = nodes.select("bits").mapInPandas(deal, "shard int, bits long").repartition(4 * built.leaves, "shard")
    return dealt.groupBy("shard").applyInPandas(compare, "a long, b long")


def _components(members: DataFrame, first: Column) -> DataFrame:
    """(bits, first) for each fingerprint: the smallest ``first`` of all rows in its component."""
    nodes = cut(members.groupBy("bits").agg(F.min(first).alias("own_first")))
    roots = stars(near_links(nodes)).select(F.col("a").alias("bits"), F.col("b").alias("root"))
    rooted = nodes.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    named = rooted.groupBy("root").agg(F.min("own_first").alias("first"))
    return rooted.join(named, "root").select("bits", "first")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id it can reach).

    Words are runs without ASCII white space, A-Z lower-cased. NULL and empty texts have fingerprint zero, which links like
    any other. Rows that repeat an id are fingerprinted each. NULL ids never name a component; one without other ids is
    NULL. An empty table gives an empty result; further columns are not read.
    """
    members = cut(fingerprinted(plain(docs, id_col, text_col)))
    found = _components(members, F.col("doc_id")).withColumnRenamed("first", "component_id")
    return members.join(found, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def _text_key(text: Column) -> Column:
    """Tells rows that share an id apart: 128 bits of the text."""
    return F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of each component; all columns stay, and so do rows with a NULL id. Rows
    are told apart by id and text, so a row is never dropped for another one that only shares its id."""
    key = _text_key(F.col("text"))
    rows = plain(docs, id_col, text_col).select("doc_id", "text", key["a"].alias("key_a"), key["b"].alias("key_b"))
    members = cut(fingerprinted(rows))
    row = F.struct("doc_id", "key_a", "key_b")
    found = members.join(_components(members, F.when(F.col("doc_id").isNotNull(), row)), "bits")
    dropped = found.where(F.col("doc_id").isNotNull() & (row != F.col("first"))).select("doc_id", "key_a", "key_b").distinct()
    own = _text_key(docs[text_col].cast("string"))
    same = (docs[id_col] == dropped["doc_id"]) & (own["a"] == dropped["key_a"]) & (own["b"] == dropped["key_b"])
    return docs.join(dropped.hint("shuffle_hash"), same, "left_anti")  # a hashed join: whole documents are not sorted
