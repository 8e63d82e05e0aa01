"""The latent space and its vote against dense matrices and a plain search."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docketry.llm import quality
from docketry.llm.common import fold

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def dense(rows):
    out = np.zeros(rows.shape)
    for i in range(len(out)):
        part = slice(rows.starts[i], rows.starts[i + 1])
        out[i, rows.terms[part]] = rows.values[part]
    return out


def test_terms_hold_every_word():
    texts = [t for _, t in ODD] + ["The cat sat on the mat, and purred softly.", "A rude pig ate at our tip, but snored badly."]
    found = dense(quality.counted(texts))
    for row, text in zip(found, texts, strict=True):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        want = Counter(zlib.crc32(w) % quality.WORDS for w in words)
        assert {int(t): int(row[t]) for t in np.flatnonzero(row[: quality.WORDS])} == want
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
        assert row[-2:].tolist() == [repeats, len(words) - repeats]
    assert (np.abs(found[-2] - found[-1])[: quality.WORDS] > 0).sum() >= 15  # texts of one shape differ by their words


def test_sparse_rows_are_the_dense_ones():
    rng = np.random.default_rng(1)
    rows = quality.weighted(quality.counted([t for _, t in ODD] + ["a b c", "a a a"] * 200), rng.random(quality.TERMS) + 0.5)
    flat, right, left = dense(rows), rng.standard_normal((quality.TERMS, 3)), rng.standard_normal((rows.shape[0], 3))
    assert np.allclose(rows @ right, flat @ right, atol=1e-4) and np.allclose(rows.turned(left), flat.T @ left, atol=1e-3)
    lengths = np.sqrt((flat**2).sum(axis=1))
    assert np.allclose(lengths[lengths > 0], 1, atol=1e-5) and (lengths == 0).sum() == 3  # NULL twice, empty


def test_votes_by_a_plain_search(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    seen = np.zeros(quality.TERMS)
    for t in texts.values():
        seen += dense(quality.counted([t]))[0] > 0
    assert np.allclose(model.idf, np.log((1 + len(texts)) / (1 + seen)) + 1, atol=1e-5)  # document frequencies of all documents
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, model).collect()}
    for i, text in texts.items():
        z = dense(quality.weighted(quality.counted([text]), model.idf))[0] @ model.projection
        z /= max(np.sqrt((z**2).sum()), 1e-12)
        cosines = sorted(((float(max(z @ v, 0)), float(y)) for v, y in zip(model.voters, model.labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        weights = [c**quality.SHARPNESS + 1e-9 for c, _ in cosines]
        vote = sum(w * y for w, (_, y) in zip(weights, cosines, strict=True)) / sum(weights)
        assert abs(got[i] - float(model.curve(np.array([vote]))[0])) < 0.02
