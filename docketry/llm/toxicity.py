"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are the words and beginnings of words that go with the label (chi-square over a bounded sample of labelled rows);
their document frequencies come from all documents. A further term that every text has once, with a fixed weight, makes
the number of telling terms count, not their proportions alone. Labelled examples, at most ``EXAMPLES``, make an inverted index in blocks: a term's postings lie
block by block, and each block has the largest weight of each term. A document visits blocks in the order of their upper
bound and stops once no block left can beat its k-th neighbour, so the neighbours are exact. Neighbours vote by distance;
a logistic curve from other labelled rows makes the vote a probability. The nearest examples and shared terms are the
evidence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import cut, plain
from docketry.llm.decontamination import folded_words
from docketry.llm.near_dedup import shingle_hashes
from docketry.llm.votes import Curve, fitted_curve, labelled_texts

LABELLED = 10_000  # rows to learn from, by hash of the id
EXAMPLES = 2_048  # of them in the index, half of each label as far as there are
INDEXED = 0.75  # most of a label's rows in the index; the others fit the curve
TERMS = 4_096
CHI_SQUARE = 30.0  # least association of a term
SEEN = 3  # least labelled documents with a term
BEGINNINGS = range(3, 8)  # characters
MARK = 8.0  # weight of the term that every text has
NEIGHBOURS = 15
BLOCK = 64
KNOWN_WORDS = 300_000  # kept by a Python worker


def terms_of(word: str) -> list[str]:
    """The word and its proper beginnings, these with a hyphen."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if k < len(word))]


def words_of(text: str | None) -> list[str]:
    return b" ".join(folded_words(text)).decode("utf-8", "surrogatepass").split(" ")


def without_repeats(rows: DataFrame) -> DataFrame:
    """One row of those with the same smallest hash of three words: copies of a text must not make its words telling."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [str(min(shingle_hashes(t), default=0)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], ["doc_id", "text", "label", "key"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.select("doc_id", "text", "label").mapInArrow(read, f"doc_id {kind}, text string, label int, key string")
    first = Window.partitionBy("key").orderBy("doc_id")
    return keyed.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "key")


def term_labels(rows: DataFrame) -> DataFrame:
    """(term, n, n1): labelled documents that have a word, and those of label 1."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, n1 = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                met = {t for w in set(words_of(text)) for t in terms_of(w)}
                n.update(met)
                if label == 1:
                    n1.update(met)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([n1[w] for w in n], pa.int64())],
                ["term", "n", "n1"])

    found = rows.select("text", "label").mapInArrow(read, "term string, n long, n1 long")
    return found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(F.col("n") >= SEEN)


def telling_terms(rows: DataFrame) -> list[str]:
    total, ones = rows.agg(F.count(F.lit(1)), F.sum((F.col("label") == 1).cast("long"))).first()
    if not total or not ones or ones == total:
        return []
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    off = n1 * total - n * F.lit(float(ones))
    chi = off * off * total / (n * (F.lit(float(total)) - n + 0.5) * float(ones) * float(total - ones))
    best = term_labels(rows).select("term", chi.alias("chi")).where(F.col("chi") >= CHI_SQUARE)
    return [r["term"] for r in best.orderBy(F.col("chi").desc(), "term").limit(TERMS).collect()]


class Terms:
    """Numbers of the terms: 0 is the one that every text has, then the telling ones."""

    def __init__(self, terms: list[str], frequencies: np.ndarray | None = None):
        self.terms = ["", *terms]
        self.at = {t: i for i, t in enumerate(terms, 1)}
        self.idf = np.ones(len(self.terms))
        if frequencies is not None:
            self.idf = np.log((1 + frequencies[0]) / (1 + frequencies)) + 1
        self._known: dict[str, tuple[int, ...]] = {}  # of words met, emptied when full

    def numbers(self, text: str | None) -> list[int]:
        """The text's telling terms, with repeats."""
        known, out = self._known, []
        for w in words_of(text):
            found = known.get(w)
            if found is None:
                found = tuple(self.at[t] for t in terms_of(w) if t in self.at)
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                known[w] = found
            if found:
                out += found
        return out

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers in order, and TF-IDF weights of length one."""
        counts = Counter(self.numbers(text))
        ids = np.array([0, *sorted(counts)], np.int64)
        weights = (1 + np.log([1, *(counts[i] for i in ids[1:].tolist())])) * self.idf[ids]
        weights[0] = MARK
        return ids, weights / np.sqrt((weights**2).sum())


def document_frequencies(docs: DataFrame, terms: list[str]) -> np.ndarray:
    """Over all documents, in the order of ``Terms``; so the first entry counts the documents."""
    known = docs.sparkSession.sparkContext.broadcast(Terms(terms))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[[0, *set(known.value.numbers(text))]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen)), pa.array(seen[seen > 0])], ["term", "n"])

    sums = docs.select(F.col("text").cast("string")).mapInArrow(read, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(terms) + 1, np.int64)
    for r in sums.collect():  # a row a term at most
        out[r["term"]] = r["n"]
    return out


class BlockMaxIndex:
    """Postings by term and block, with each block's largest weight of each term."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.block, self.size = block, len(vectors)
        blocks = max(1, -(-len(vectors) // block))
        doc = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        term = np.concatenate([np.zeros(0, np.int64), *[v[0] for v in vectors]])
        weight = np.concatenate([np.zeros(0), *[v[1] for v in vectors]])
        order = np.lexsort((doc, term))
        self.docs, self.weights = doc[order], weight[order]
        cell = term[order] * blocks + self.docs // block
        self.starts = np.searchsorted(cell, np.arange(n_terms * blocks + 1)).reshape(-1)
        self.most = np.zeros((n_terms, blocks))
        np.maximum.at(self.most.reshape(-1), cell, self.weights)
        self.blocks = blocks

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above zero; exact. Of equal ones those of the block with the higher bound come
        first, then by number."""
        bounds = weights @ self.most[ids]
        best, scores = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(best) == k and bounds[b] <= scores[-1] + 1e-12:
                break
            sums = np.zeros(self.block)
            for i, w in zip((ids * self.blocks + b).tolist(), weights, strict=True):
                s, e = self.starts[i], self.starts[i + 1]
                if s < e:
                    sums[self.docs[s:e] - b * self.block] += w * self.weights[s:e]
            hit = np.flatnonzero(sums > 0)
            best, scores = np.concatenate((best, hit + b * self.block)), np.concatenate((scores, sums[hit]))
            order = np.argsort(-np.round(scores, 12), kind="stable")[:k]
            best, scores = best[order], scores[order]
        return best, scores


@dataclass
class Toxicity:
    terms: Terms
    index: BlockMaxIndex
    ids: list  # of the examples
    vectors: list[tuple[np.ndarray, np.ndarray]]
    labels: np.ndarray
    curve: Curve
    _unmarked: tuple | None = None  # the answer for texts without a telling term

    def near(self, ids: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Vote (0 to 1; 0 without a neighbour), neighbours, their cosines."""
        if len(ids) == 1 and self._unmarked is not None:
            return self._unmarked
        near, cosine = self.index.nearest(ids, weights, NEIGHBOURS)
        if not len(near):
            return 0.0, near, cosine
        by = 1 / (1.05 - np.minimum(cosine, 1))
        found = float((by * self.labels[near]).sum() / by.sum()), near, cosine
        if len(ids) == 1:
            self._unmarked = found
        return found


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Toxicity:
    """``labels`` (doc_id and the label column) must hold only rows to learn from; ``docs`` are all documents."""
    rows = labelled_texts(docs, labels, label, LABELLED)
    names = telling_terms(cut(without_repeats(rows)))
    terms = Terms(names, document_frequencies(docs, names))
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.vector(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64())), batch.column(2)],
                ["doc_id", "ids", "weights", "label"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(read, f"doc_id {kind}, ids array<long>, weights array<double>, label int").limit(LABELLED).toPandas()
    made = made.sort_values("doc_id", kind="stable")
    made = made.iloc[np.random.default_rng(0).permutation(len(made))]
    label_of = (made["label"].to_numpy() == 1).astype(np.float64)
    chosen = np.zeros(len(made), bool)
    for value in (0.0, 1.0):
        own = np.flatnonzero(label_of == value)
        chosen[own[: min(EXAMPLES // 2, int(INDEXED * len(own)))]] = True
    vectors = [(np.asarray(i, np.int64), np.asarray(w, np.float64)) for i, w in zip(made["ids"], made["weights"], strict=True)]
    # examples with the same heaviest term lie together: tight block bounds
    order = sorted(np.flatnonzero(chosen).tolist(), key=lambda j: (label_of[j], int(vectors[j][0][1:][vectors[j][1][1:].argmax()]) if len(vectors[j][0]) > 1 else 0, j))
    own = [vectors[j] for j in order]
    found = Toxicity(terms, BlockMaxIndex(own, len(names) + 1), made["doc_id"].to_numpy()[order].tolist(), own, label_of[order], Curve())
    rest = np.flatnonzero(~chosen)
    if len(rest) >= 100:
        found.curve = fitted_curve(np.array([found.near(*vectors[j])[0] for j in rest]), label_of[rest])
    return found


def toxicity_scores(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text", shown: int = 3) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted, vote, evidence (nearest examples, cosine, label, shared terms).

    NULL and empty texts are like any text without a telling term. Without examples the vote is 0. Equal
    cosines go to the example listed first. Ids may be NULL or repeated; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = plain(docs, id_col, text_col)
    seen = pa.struct([("example", pa.string()), ("cosine", pa.float64()), ("label", pa.int32()), ("terms", pa.list_(pa.string()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            votes, evidence = [], []
            for text in batch.column(1).to_pylist():
                ids, weights = model.terms.vector(text)
                vote, near, cosine = model.near(ids, weights)
                votes.append(vote)
                evidence.append([
                    {"example": str(model.ids[n]), "cosine": float(c), "label": int(model.labels[n]),
                     "terms": [model.terms.terms[t] for t in np.intersect1d(ids, model.vectors[n][0]) if t]}
                    for n, c in zip(near[:shown].tolist(), cosine[:shown].tolist(), strict=True)])
            score = model.curve(np.array(votes, np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(votes, pa.float64()), pa.array(evidence, pa.list_(seen))],
                ["doc_id", "score", "predicted", "vote", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(read, f"doc_id {kind}, score double, predicted int, vote double, "
                                 "evidence array<struct<example: string, cosine: double, label: int, terms: array<string>>>")
