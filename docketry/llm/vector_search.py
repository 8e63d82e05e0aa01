"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree searched best bin first.

One more coordinate makes the largest inner product the smallest distance, whatever the vectors' lengths: a vector x gets
``sqrt(m - |x|^2)`` with m the largest squared length of all, a query gets 0. The tree is fitted on a bounded sample of
different vectors; every vector of the table is dealt to the leaf it descends to. A query takes nodes from a priority
queue, nearest centre first, until it has seen a number of leaves. That number is widened until the pilot queries, which
are compared with every vector, find the share ``TARGET`` of their true neighbours.

Equal vectors are one entry with their smallest ids, so copies cost nothing. A leaf's vectors and the queries that visit it
meet in blocks of bounded size: a leaf with very many of either is dealt over several tasks, and nothing is left out. The
first ``NEAR`` leaves give each query a score to beat, so that the others only hand on what can still be among the nearest.

Where vectors have no structure, the share of leaves a query needs does not fall with their number; the work is then the
number of queries times that share of the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from docketry.llm.common import cut, sample_by_hash

SAMPLE = 131_072  # vectors the tree is fitted on, fewer if they are long:
SAMPLE_NUMBERS = 1 << 24  # numbers in the sample
BRANCH = 16  # children of a node
LEAF = 512  # sampled vectors a leaf has at most
ROUNDS = 8  # of k-means
PILOT = 256  # queries that calibrate the visits
TARGET = 0.95  # share of the pilots' true neighbours that must be found
NEAR = 4  # leaves that set the score to beat
VECTORS, QUERIES = 4_096, 2_048  # of a leaf that meet in one block
TOGETHER = 256  # queries a matrix product takes at once


class Tree:
    """Nodes in one array of centres; ``children[n]`` are node numbers, ``leaf[n]`` the number of a leaf or -1."""

    def __init__(self, points: np.ndarray):
        self.centres, self.children, self.leaf, self.leaves = [], [], [], 0
        random = np.random.default_rng(7)
        root = self._node(points.mean(axis=0) if len(points) else np.zeros(points.shape[1]))
        rest = [(root, points)]
        while rest:
            node, some = rest.pop()
            parts = _split(some, random) if len(some) > LEAF else None
            if parts is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for centre, part in parts:
                child = self._node(centre)
                self.children[node].append(child)
                rest.append((child, part))
        self.centres = np.array(self.centres)
        self.lengths = (self.centres ** 2).sum(axis=1)

    def _node(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def deal(self, points: np.ndarray) -> np.ndarray:
        """The leaf each point descends to."""
        out, rest = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while rest:
            node, rows = rest.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = (self.lengths[below] - 2 * points[rows] @ self.centres[below].T).argmin(axis=1)
                rest += [(child, rows[near == i]) for i, child in enumerate(below)]
        return out

    def visits(self, queries: np.ndarray, number: int) -> Iterator[list[int]]:
        """For each query the first ``number`` leaves, best bin first."""
        for start in range(0, len(queries), 256):
            for away in (self.lengths - 2 * queries[start : start + 256] @ self.centres.T).tolist():
                queue, seen = [(away[0], 0)], []
                while queue and len(seen) < number:
                    _, node = heapq.heappop(queue)
                    if self.children[node]:
                        for child in self.children[node]:
                            heapq.heappush(queue, (away[child], child))
                    else:
                        seen.append(self.leaf[node])
                yield seen


def _split(points: np.ndarray, random: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """k-means into ``BRANCH`` parts; None if all points are equal."""
    centres = np.unique(points[random.choice(len(points), min(len(points), BRANCH), replace=False)], axis=0)
    if len(centres) < 2:
        centres = np.unique(points, axis=0)[:BRANCH]
        if len(centres) < 2:
            return None
    for _ in range(ROUNDS):
        near = ((centres ** 2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        used = np.unique(near)
        centres = np.array([points[near == c].mean(axis=0) for c in used])
    near = ((centres ** 2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
    parts = [(c, points[near == i]) for i, c in enumerate(centres) if (near == i).any()]
    return parts if len(parts) > 1 else None


@dataclass
class Index:
    entries: DataFrame  # vector (bytes), ids (the smallest), leaf
    tree: Tree
    longest: float  # largest squared length
    kind: str  # of the numbers in a vector's bytes
    kept_ids: int  # of each entry


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(vec_id, vector as bytes, squared length) of the rows that take part, and the kind of number."""
    inner = vectors.schema[vector_col].dataType
    kind = "<f4" if isinstance(inner, ArrayType) and isinstance(inner.elementType, FloatType) else "<f8"
    numbers = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("vector"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, packed, lengths = [], [], []
            lists = batch.column(1)
            for i in range(len(batch)):
                item = lists[i].values if lists[i].is_valid else None
                if item is None or not len(item) or item.null_count:
                    continue
                row = item.to_numpy().astype(kind)
                length = float((row.astype(np.float64) ** 2).sum())
                if np.isfinite(row).all() and 0 < length < np.inf:
                    found.append(i)
                    packed.append(row.tobytes())
                    lengths.append(length)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found, pa.int32())), pa.array(packed, pa.binary()),
                                              pa.array(lengths, pa.float64())], ["vec_id", "vector", "length"])

    id_kind = vectors.schema[id_col].dataType.simpleString()
    known = numbers.where("vec_id IS NOT NULL").mapInArrow(read, f"vec_id {id_kind}, vector binary, length double")
    once = known.groupBy("vec_id").agg(F.min(F.struct("vector", "length")).alias("least")).select("vec_id", "least.*")
    return cut(once), kind


def _raised(packed: list[bytes], kind: str, longest: float) -> np.ndarray:
    """Entries with their further coordinate."""
    rows = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    return np.concatenate([rows, np.sqrt(np.maximum(0, longest - (rows ** 2).sum(axis=1)))[:, None]], axis=1)


def built(rows: DataFrame, kind: str, k: int) -> Index | None:
    """The index of ``usable`` rows for searches of ``k`` neighbours; None without rows."""
    size = F.length("vector")
    common = rows.groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return None
    rows = rows.where(size == common["size"])
    longest = rows.agg(F.max("length")).first()[0]
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    some = rows.select("vector", "vec_id", place.alias("place")).where(F.col("place") <= k + 1)
    entries = cut(some.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    number = max(1, min(SAMPLE, SAMPLE_NUMBERS // (common["size"] // np.dtype(kind).itemsize)))
    sample = sample_by_hash(entries, F.col("vector"), number).select("vector").limit(number).toPandas()["vector"].map(bytes)
    tree = Tree(_raised(sorted(sample), kind, longest))
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                leaf = sent.value.deal(_raised(batch.column(0).to_pylist(), kind, longest))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], ["vector", "ids", "leaf"])

    ids = entries.schema["ids"].dataType.simpleString()
    return Index(cut(entries.mapInArrow(deal, f"vector binary, ids {ids}, leaf int")), tree, longest, kind, k + 1)


def _matrix(packed: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)


def _flat(ids: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of a list column: where each list starts, all items, each list's length."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    offsets = ids.offsets.to_numpy()
    return offsets[:-1] - offsets[0], ids.flatten(), np.diff(offsets)


def _near(queries: np.ndarray, least: np.ndarray, entries: np.ndarray, ids: tuple, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, negative score, place in the flat ids, entry) of all that can be among a query's ``keep`` nearest: the best
    of these entries that reach the query's ``least`` score. The matrix product only chooses, with some slack; the scores
    are then taken number by number, the same in every block."""
    starts, _, lengths = ids
    slack = 1e-12 * np.abs(entries).max(initial=0) * np.abs(queries).max(initial=0) * (entries.shape[1] + 1)
    for first in range(0, len(queries), TOGETHER):
        block = queries[first : first + TOGETHER]
        about = block @ entries.T
        limit = least[first : first + TOGETHER]
        if len(entries) > keep and not np.isfinite(limit).all():
            limit = np.maximum(limit, np.partition(about, -keep, axis=1)[:, -keep])
        query, entry = np.nonzero(about >= (limit - 2 * slack)[:, None])
        away = -(entries[entry] * block[query]).sum(axis=1)
        times = lengths[entry]
        each = np.repeat(np.arange(len(entry)), times)
        place = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times) + starts[entry][each]
        yield first + query[each], away[each], place, entry[each]


def _order(index: Index, queries: list[bytes], number: int) -> list[list[int]]:
    flat = _matrix(queries, index.kind)
    return list(index.tree.visits(np.concatenate([flat, np.zeros((len(flat), 1))], axis=1), number))


def calibrated_visits(index: Index, queries: DataFrame, k: int, target: float = TARGET) -> tuple[int, float]:
    """How many leaves a query must visit, and the share of true neighbours the pilot queries find by that.

    ``queries``: vector, ids. The pilots are at most ``PILOT`` of them, by hash; each is compared with every entry.
    """
    rows = sample_by_hash(queries, F.col("vector"), PILOT).limit(PILOT).collect()
    if not rows:
        return 1, 1.0
    pilots, own = [bytes(r["vector"]) for r in rows], [r["ids"][0] for r in rows]
    sent = index.entries.sparkSession.sparkContext.broadcast(pilots)
    kind, keep = index.kind, index.kept_ids
    id_kind = index.entries.schema["ids"].dataType.elementType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = _matrix(sent.value, kind)
        for batch in batches:
            ids, leaf = _flat(batch.column(1)), batch.column(2).to_numpy()
            for pilot, away, place, entry in _near(flat, np.full(len(flat), -np.inf), _matrix(batch.column(0).to_pylist(), kind), ids, keep):
                yield pa.RecordBatch.from_arrays([pa.array(pilot.astype(np.int32)), pa.array(away), ids[1].take(pa.array(place)),
                                                  pa.array(leaf[entry].astype(np.int32))], ["pilot", "away", "vec_id", "leaf"])

    near = index.entries.mapInArrow(compare, f"pilot int, away double, vec_id {id_kind}, leaf int")
    place = F.row_number().over(Window.partitionBy("pilot").orderBy("away", "vec_id"))
    first: dict[int, list] = {}
    for r in near.select("*", place.alias("place")).where(F.col("place") <= keep).orderBy("pilot", "place").collect():
        if r["vec_id"] != own[r["pilot"]] and len(first.setdefault(r["pilot"], [])) < k:
            first[r["pilot"]].append(r["leaf"])
    ranks = []
    for n, seen in enumerate(_order(index, pilots, index.tree.leaves)):
        place_of = {leaf: i for i, leaf in enumerate(seen)}
        ranks += [place_of[leaf] for leaf in first.get(n, [])]
    ranks = np.array(ranks or [0])
    number = 1
    while (share := float((ranks < number).mean())) < target and number < index.tree.leaves:
        number += 1
    return number, share


def neighbours(vectors: DataFrame, queried: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
               target: float = TARGET) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the ``k`` nearest found of each row for whose id ``queried`` holds.

    ``queried`` is a condition on the column ``vec_id``. Candidates are all rows but those of the query's id. Score: inner
    product in double precision. Ties go to the smaller id. Vectors that are NULL, empty, zero or hold NULL or non-finite
    numbers take no part, nor do rows without an id and vectors of another size than the commonest (the larger of two). Rows
    that repeat an id count once, with the smallest vector. An empty table gives no rows; further columns are not read.
    """
    spark = vectors.sparkSession
    id_kind = vectors.schema[id_col].dataType.simpleString()
    rows, kind = usable(vectors, id_col, vector_col)
    index = built(rows, kind, k)
    if index is None:
        return spark.createDataFrame([], f"query_id {id_kind}, rank int, vec_id {id_kind}, score double")
    asked = rows.where(queried & (F.length("vector") == len(index.entries.select("vector").first()[0]))).select("vec_id", "vector")
    queries = cut(asked.groupBy("vector").agg(F.array(F.min("vec_id")).alias("ids")).withColumn("q", F.monotonically_increasing_id()))
    number, _ = calibrated_visits(index, queries, k, target)
    found = searched(index, queries, number)
    mine = asked.join(queries.select("vector", "q"), "vector").join(found, "q").select(
        F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("vec_id")), 1, k).alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("at", "one")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.away")).alias("score"))


def searched(index: Index, queries: DataFrame, number: int) -> DataFrame:
    """(q, near: negative scores and ids of the nearest entries) of each query (q, vector) after ``number`` leaves."""
    sent = queries.sparkSession.sparkContext.broadcast(index.tree)
    kind = index.kind

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), TOGETHER):
                part = batch.slice(a, TOGETHER)
                flat = _matrix(part.column(1).to_pylist(), kind)
                seen = list(sent.value.visits(np.concatenate([flat, np.zeros((len(flat), 1))], axis=1), number))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(seen, pa.list_(pa.int32()))], ["q", "vector", "leaves"])

    spread = queries.select("q", "vector").repartition(-(-queries.count() // QUERIES) + 1, "q")
    ways = cut(spread.mapInArrow(visit, "q long, vector binary, leaves array<int>"))
    nearest = lambda found: found.groupBy("q").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("away", "vec_id"))), 1, index.kept_ids).alias("near"))
    first = cut(nearest(_met(index, ways.select("q", "vector", F.slice("leaves", 1, NEAR).alias("leaves"), F.lit(float("-inf")).alias("least")))))
    full = F.size("near") == index.kept_ids
    known = first.select("q", F.when(full, -F.element_at("near", -1)["away"]).otherwise(float("-inf")).alias("least"))
    rest = ways.where(F.size("leaves") > NEAR).join(known, "q").select("q", "vector", F.slice("leaves", NEAR + 1, number).alias("leaves"), "least")
    return nearest(first.select("q", F.inline("near")).unionByName(_met(index, rest)))


def _met(index: Index, asked: DataFrame) -> DataFrame:
    """(q, away, vec_id) of what queries (q, vector, leaves, least score) find in their leaves."""
    kind, keep = index.kind, index.kept_ids
    visits = cut(asked.select("q", "vector", "least", F.explode("leaves").alias("leaf")))
    # at most one row per leaf of the tree, whose number the sample bounds
    shares = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks")).join(
        index.entries.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / VECTORS).cast("int").alias("chunks")), "leaf")
    shares = F.broadcast(cut(shares))
    part = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = index.entries.join(shares, "leaf").select("leaf", part("vector", "chunks").alias("chunk"), each("blocks").alias("block"), "vector", "ids")
    right = visits.join(shares, "leaf").select("leaf", each("chunks").alias("chunk"), part("q", "blocks").alias("block"), "q", "vector", "least")
    id_kind = index.entries.schema["ids"].dataType.elementType.simpleString()

    def meet(entries: pa.Table, asked: pa.Table) -> pa.Table:
        ids = _flat(entries.column("ids"))
        out = [[np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]]
        if len(entries) and len(asked):
            numbers = asked.column("q").to_numpy()
            flat = _matrix(asked.column("vector").to_pylist(), kind)
            for query, away, place, _ in _near(flat, asked.column("least").to_numpy(), _matrix(entries.column("vector").to_pylist(), kind), ids, keep):
                for to, values in zip(out, (numbers[query], away, place), strict=True):
                    to.append(values)
        q, away, place = (np.concatenate(o) for o in out)
        return pa.table({"q": pa.array(q, pa.int64()), "away": pa.array(away, pa.float64()), "vec_id": ids[1].take(pa.array(place, pa.int64()))})

    return left.groupBy("leaf", "chunk", "block").cogroup(right.groupBy("leaf", "chunk", "block")).applyInArrow(
        meet, f"q long, away double, vec_id {id_kind}")
