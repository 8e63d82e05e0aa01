"""Quality by nearest labelled neighbours in a latent-semantic space.

A text's terms are its words as they are written (runs without white space, hashed) and, beside them, shapes: signs reduced
to their class (lower letter, upper letter, digit, white space, each mark for itself), stretches of small letters to one
sign, read three at a time, and repeats of a word at once. Square-rooted frequencies, weighted by inverse document frequency
over all documents, make the sparse term-document matrix of a bounded sample of labelled rows; its truncated singular value
decomposition is the latent space. The labelled vectors of that sample, ``LABELLED`` at most, go to all tasks; each document's
exact cosines with all of them are one blocked matrix product, and its nearest neighbours vote by similarity. A logistic curve
from other labelled rows makes the vote a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import plain
from docketry.llm.tokens import bounded
from docketry.llm.votes import Curve, fitted_curve, labelled_texts

LABELLED = 4_000  # labelled rows to learn from, by hash of the id
VOTERS = 0.75  # of them are neighbours; the others fit the curve
WORDS = 32_768  # hashed words
SHAPES = 1_024  # hashed shape terms
RANK = 64
NEIGHBOURS = 15
SHARPNESS = 8.0  # a neighbour's weight is its cosine to this power
BLOCK = 256  # documents whose terms are in memory at once
REPEATS = 2  # further terms: a word equal to the one before, and the others
TERMS = WORDS + SHAPES + REPEATS
_PARTS = np.repeat([0, 1, 2], [WORDS, SHAPES, REPEATS])  # words, shapes and repeats are weighted each on their own

_CLASS = np.array([97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57
                   else 10 if c in (10, 13) else 32 if c <= 32 or c == 127 else c for c in range(256)], np.uint8)


@dataclass
class Rows:
    """Sparse rows: ``starts`` of each row in ``terms`` and ``values``, and where the last ends. Every row may be empty."""

    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.starts) - 1, TERMS

    def __matmul__(self, right: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.starts) - 1, right.shape[1]), np.float32)
        for a in range(0, len(out), BLOCK):
            b = min(len(out), a + BLOCK)
            part = slice(self.starts[a], self.starts[b])
            full = np.flatnonzero(np.diff(self.starts[a : b + 1]))
            if len(full):
                products = right[self.terms[part]] * self.values[part, None]
                out[a + full] = np.add.reduceat(products, self.starts[a:b][full] - self.starts[a], axis=0)
        return out

    def turned(self, right: np.ndarray) -> np.ndarray:
        """The transposed matrix times ``right``."""
        out = np.zeros((TERMS, right.shape[1]), np.float32)
        for a in range(0, len(self.starts) - 1, BLOCK):
            b = min(len(self.starts) - 1, a + BLOCK)
            part = slice(self.starts[a], self.starts[b])
            row = np.repeat(np.arange(a, b), np.diff(self.starts[a : b + 1]))
            by = np.argsort(self.terms[part], kind="stable")
            terms = self.terms[part][by]
            first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else terms
            if len(first):
                out[terms[first]] += np.add.reduceat(right[row[by]] * self.values[part][by, None], first, axis=0)
        return out


def counted(texts: list[str | None]) -> Rows:
    """Terms of each text, ascending, and how often it has them."""
    terms, counts, starts = [], [], [0]
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        if raw:
            found = np.bincount(np.fromiter((crc32(w) for w in words), np.int64, len(words)) % WORDS, minlength=WORDS)
            kind = _CLASS[np.frombuffer(raw, np.uint8)]
            kind = kind[np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] != 97)))].astype(np.uint32)
            three = kind[:-2] << 16 | kind[1:-1] << 8 | kind[2:]
            again = sum(a == b for a, b in zip(words, words[1:], strict=False))
            every = np.concatenate((found, np.bincount((three * np.uint32(2654435761)) >> np.uint32(22), minlength=SHAPES),
                                    [again, len(words) - again]))
            at = np.flatnonzero(every)
            terms.append(at)
            counts.append(every[at])
        starts.append(starts[-1] + (len(terms[-1]) if raw else 0))
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return Rows(np.array(starts), join(terms, np.int64), join(counts, np.int64).astype(np.float32))


def frequencies(docs: DataFrame) -> np.ndarray:
    """Documents that have each term; the last entry counts the documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in bounded(texts):
                seen[:-1] += np.bincount(counted(texts[a:b]).terms, minlength=TERMS)
            seen[-1] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen)), pa.array(seen[seen > 0])], ["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    sums = docs.select(F.col("text").cast("string")).mapInArrow(read, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # a row a term at most
        out[r["term"]] = r["n"]
    return out


def weighted(counts: Rows, idf: np.ndarray) -> Rows:
    """Square roots of shares times idf, words, shapes and repeats each of length one, rows of length one."""
    row = np.repeat(np.arange(len(counts.starts) - 1), np.diff(counts.starts))
    cell = 3 * row + _PARTS[counts.terms]
    cells = 3 * (len(counts.starts) - 1)
    values = np.sqrt(counts.values / np.bincount(cell, counts.values, cells)[cell]) * idf[counts.terms]
    values = values / np.sqrt(np.maximum(np.bincount(cell, values**2, cells), 1e-12))[cell]
    length = np.sqrt(np.maximum(np.bincount(row, values**2, len(counts.starts) - 1), 1e-12))
    return Rows(counts.starts, counts.terms, (values / length[row]).astype(np.float32))


def right_vectors(rows: np.ndarray | Rows, rank: int) -> np.ndarray:
    """The leading right singular vectors (columns), by subspace iteration from a fixed start."""
    turned = rows.turned if isinstance(rows, Rows) else lambda right: rows.T @ right
    rank = min(rank, *rows.shape)
    basis = np.random.default_rng(0).standard_normal((rows.shape[1], min(rank + 8, rows.shape[1]))).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(turned(rows @ basis))
    _, vectors = np.linalg.eigh((rows @ basis).T @ (rows @ basis))
    return basis @ vectors[:, ::-1][:, :rank]


@dataclass
class Quality:
    idf: np.ndarray
    projection: np.ndarray
    voters: np.ndarray  # rows of length one
    labels: np.ndarray
    curve: Curve

    def latent(self, counts: Rows) -> np.ndarray:
        z = weighted(counts, self.idf) @ self.projection
        return z / np.maximum(np.sqrt((z**2).sum(axis=1, keepdims=True)), 1e-12)

    def votes(self, latent: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest voters by weight; 0.5 without voters."""
        if not len(self.voters):
            return np.full(len(latent), 0.5)
        cosine = np.maximum(latent @ self.voters.T, 0)
        k = min(NEIGHBOURS, len(self.voters))
        near = np.argsort(-np.round(cosine, 5), axis=1, kind="stable")[:, :k] if cosine.shape[1] <= 2 * k else np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.take_along_axis(cosine, near, axis=1) ** SHARPNESS + 1e-9
        return (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for start in range(0, len(texts), BLOCK):
            out[start : start + BLOCK] = self.curve(self.votes(self.latent(counted(texts[start : start + BLOCK]))))
        return out


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Quality:
    """``labels`` (doc_id and the label column) must hold only rows to learn from; ``docs`` are all documents."""
    seen = frequencies(docs)
    idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1).astype(np.float32)
    rows = labelled_texts(docs, labels, label, LABELLED)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counted(batch.column(1).to_pylist())
            lists = [pa.array(np.split(v, found.starts[1:-1]) if len(batch) else [], kind)
                     for v, kind in ((found.terms.astype(np.int32), pa.list_(pa.int32())), (found.values, pa.list_(pa.float32())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, batch.column(2)], ["doc_id", "terms", "counts", "label"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(read, f"doc_id {kind}, terms array<int>, counts array<float>, label int").limit(LABELLED).toPandas()
    made = made.sort_values("doc_id", kind="stable")
    made = made.iloc[np.random.default_rng(0).permutation(len(made))]
    join = lambda name, kind: np.concatenate([np.zeros(0, kind), *made[name]])
    starts = np.concatenate(([0], np.cumsum([len(t) for t in made["terms"]]))).astype(np.int64)
    vectors = weighted(Rows(starts, join("terms", np.int32).astype(np.int64), join("counts", np.float32).astype(np.float32)), idf)
    ones = (made["label"].to_numpy() == 1).astype(np.float64)
    projection = right_vectors(vectors, RANK) if len(made) else np.zeros((TERMS, 1), np.float32)
    latent = vectors @ projection
    latent /= np.maximum(np.sqrt((latent**2).sum(axis=1, keepdims=True)), 1e-12)
    voters = int(VOTERS * len(made))
    found = Quality(idf, projection, latent[:voters], ones[:voters], Curve())
    if len(made) - voters >= 50:
        found.curve = fitted_curve(found.votes(latent[voters:]), ones[voters:])
    return found


def quality_scores(docs: DataFrame, model: Quality, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted.

    NULL and empty texts have the zero vector, whose neighbours all weigh the same. Ids may be NULL or repeated; an empty
    table gives an empty result; further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = plain(docs, id_col, text_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sent.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
