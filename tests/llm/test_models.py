import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import language_id, quality, toxicity
from docketry.llm.common import fold
from docketry.llm.queries import QUERIES

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def slow_kneser_ney(text, order):
    """Probability function from the definition, over a text with zeros before its start."""
    padded = [0] * (order - 1) + text
    counts = Counter(tuple(padded[i : i + order]) for i in range(len(text)))
    by_order = {order: counts}
    for k in range(order - 1, 0, -1):
        by_order[k] = Counter(g[1:] for g in by_order[k + 1])
    signs = len(by_order[1]) + 1

    def p(gram):
        if not gram:
            return 1 / signs
        c = by_order[len(gram)]
        n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
        same = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        return p(gram[1:]) if not total else max(c[gram] - d, 0) / total + d * len(same) / total * p(gram[1:])

    return p


def test_kneser_ney_against_the_definition():
    text = "the cat sat on the mat and the dog sat too"
    signs, owners, _ = language_id.letters([text])
    found, n = np.unique(language_id.grams(signs, owners), return_counts=True)
    model = language_id.kneser_ney(found, n)
    p = slow_kneser_ney(signs.astype(int).tolist(), 4)
    for word in ("the", "dot", "zebra", "xyz"):
        s, o, _ = language_id.letters([word])
        g = language_id.grams(s, o)
        want = [math.log(p(tuple(int(x >> np.uint64(16 * k)) & 0xFFFF for k in (3, 2, 1, 0)))) for x in g]
        assert np.allclose(model.log_p(g), want)


def test_letters_and_slices(monkeypatch):
    signs, owners, count = language_id.letters(["Ab 1c", "", "ÉÉ", "..d"])
    assert [(chr(s), o) for s, o in zip(signs.tolist(), owners.tolist(), strict=True)] == [
        (" ", 0), ("a", 0), ("b", 0), (" ", 0), ("c", 0), (" ", 2), ("é", 2), ("é", 2), (" ", 3), ("d", 3)]
    assert count.tolist() == [3, 0, 2, 1]
    monkeypatch.setattr(language_id, "CHARS", 4)
    assert list(language_id._slices(["ab", None, "c", "dddddd", "e"])) == [(0, ["ab", "", "c"]), (3, ["dddd"]), (3, ["dd"]), (4, ["e"])]


@pytest.fixture(scope="module")
def identifier(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return language_id.learn(docs.where(fold(F.col("doc_id"), 5) != 0))


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_kneser_ney"](spark, SF).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 100
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert np.mean([r.accepted for r in rows]) > 0.995
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_odd_rows(spark, documents, identifier):
    texts = [*ODD, (30, "Это совсем другой язык, которого никто не учил"), (31, "123 ?!")]
    rows = language_id.identified(documents(texts), identifier).collect()
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == len(texts)
    assert all((found[i].lang_pred, found[i].score, found[i].accepted) == ("und", 0.0, False) for i in (1, 2, 7, 31))
    assert not found[30].accepted and found[30].lang_pred in identifier.names
    assert language_id.identified(documents([]), identifier).collect() == []
    kept = language_id.keep_known(documents(texts), identifier)
    assert kept.columns == documents([]).columns and not {1, 2, 7, 30, 31} & {r.doc_id for r in kept.collect()}
    nothing = language_id.learn(documents([(1, "text", None)]))
    assert {r.lang_pred for r in language_id.identified(documents(texts), nothing).collect()} == {"und"}


def rates(rows, label):
    held = [(r.score >= 0.5, r[label] == 1) for r in rows if r.held_out]
    return np.mean([a for a, b in held if b]), np.mean([not a for a, b in held if not b])


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op7_latent_neighbours"](spark, SF)
    assert rows.count() == 1000
    one, zero = rates(rows.join(labels, "doc_id").collect(), "quality")
    assert one > 0.9 and zero > 0.9


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    one, zero = rates(QUERIES["op9_block_max"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").collect(), "toxic")
    assert one > 0.8 and zero > 0.97


@pytest.mark.parametrize("learn,score", [(quality.learn, quality.quality_scores), (toxicity.learn, toxicity.toxicity_scores)])
def test_classifiers_odd_rows(spark, documents, learn, score):
    labels = spark.createDataFrame([(8, 1), (9, 0), (9, 1), (3, 0), (None, 1), (4, None)], "doc_id long, label int")
    for known in (labels, labels.where("false")):
        model = learn(documents(ODD), known, "label")
        rows = score(documents(ODD), model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert score(documents([]), model).collect() == []


def test_block_max_index_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(500):
        ids = np.array([0, *sorted(rng.choice(np.arange(1, 60), rng.integers(1, 8), replace=False))])
        w = rng.random(len(ids))
        vectors.append((ids, w / np.sqrt((w**2).sum())))
    dense = np.zeros((500, 60))
    for row, (ids, w) in zip(dense, vectors, strict=True):
        row[ids] = w
    index = toxicity.BlockMaxIndex(vectors, 60)
    for ids, w in vectors[::25]:
        near, cosine = index.nearest(ids, w, 10)
        want = np.sort(dense[:, ids] @ w)[::-1][:10]
        assert np.allclose(cosine, want) and np.allclose(dense[near][:, ids] @ w, cosine)


def test_right_vectors_match_a_full_decomposition():
    rng = np.random.default_rng(4)
    rows = (rng.standard_normal((200, 10)) @ rng.standard_normal((10, 60)) * np.linspace(1, 3, 60)).astype(np.float32)
    found = quality.right_vectors(rows, 5)
    want = np.linalg.svd(rows, full_matrices=False)[2][:5].T
    assert np.allclose(np.abs(found.T @ want), np.eye(5), atol=1e-2)
