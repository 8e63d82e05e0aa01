"""Language models made in Spark, decisions and rejections, against the definition."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import common, language_id
from docketry.llm.common import fold

from .test_models import slow_kneser_ney

TEXTS = {"en": "the cat sat on the mat and the dog sat too, then the cat left", "de": "der hund und die katze sind da und der hund ist hier",
         "fr": "le chat est sur la table et la souris est dessous", "xx": "zorp"}
ASKED = ["the dog", "der hund", "la table", "zorp zorp", "qq", "A cat, und le chat? 12", "thé über " * 30]


def training(spark, texts):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")


def slow_entropy(text, of):
    """Nats a sign by the definition, sign by sign."""
    signs = language_id.letters([text])[0].astype(int).tolist()
    p = slow_kneser_ney(language_id.letters([of])[0].astype(int).tolist(), 4)
    padded = [0, 0, 0, *signs]
    return -sum(math.log(p(tuple(padded[i : i + 4]))) for i in range(len(signs))) / max(1, len(signs))


def test_decisions_and_scores_by_the_definition(spark):
    found = language_id.learn(training(spark, TEXTS.items()))
    assert found.names == sorted(TEXTS)
    rows = {r.doc_id: r for r in language_id.identified(spark.createDataFrame(list(enumerate(ASKED)), "doc_id long, text string"), found).collect()}
    for i, text in enumerate(ASKED):
        h = {lang: slow_entropy(text, own) for lang, own in TEXTS.items()}
        best = min(sorted(h), key=h.get)
        n = min(sum(c.isalpha() for c in text), language_id.SHARPNESS)
        assert rows[i].lang_pred == best
        assert rows[i].cross_entropy == pytest.approx(h[best], abs=1e-9)
        assert rows[i].score == pytest.approx(1 / sum(math.exp((h[best] - x) * n) for x in h.values()), abs=1e-9)


def test_no_language_is_cut_away(spark, monkeypatch):
    """A budget far too small for all leaves every language its signs and most telling n-grams, and a proper distribution."""
    monkeypatch.setattr(language_id, "MOST_GRAMS", 40)
    monkeypatch.setattr(language_id, "LEAST_GRAMS", 12)
    rows = [("en", TEXTS["en"] * 5)] * 30 + [("de", TEXTS["de"]), ("xx", "zorp")]
    found = language_id.learn(training(spark, rows))
    assert found.names == ["de", "en", "xx"]
    for name, model in zip(found.names, found.models, strict=True):
        sizes = [len(level.grams) for level in model.levels]
        assert sizes[0] > 0 and sum(sizes[1:]) <= 13
        for context in ([0, 0, 0], [0, 0, 32], [32, ord("t"), ord("h")], [1, 2, 3]):  # all signs and the one never met
            packed = sum(s << (16 * (3 - k)) for k, s in enumerate(context))
            wanted = [packed | int(s) for s in model.levels[0].grams] + [packed | 65000]
            assert np.exp(model.log_p(np.array(wanted, np.uint64))).sum() == pytest.approx(1, abs=1e-6), name
    assert found.decide(["der hund und", "the cat sat", "zorp"])[0] == ["de", "en", "xx"]


def test_models_reach_the_driver_as_columns(spark):
    """In a session without Spark's Arrow setting too, no row object is made for each n-gram."""
    counts = spark.range(40_000).select(F.lit("en").alias("lang"), F.xxhash64("id").alias("gram"), (F.col("id") % 5 + 1).alias("n"))
    name = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    tracemalloc.start()
    try:
        names, models = language_id.models_of(counts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set(name, before)
    held = sum(len(level.grams) for level in models[0].levels)
    assert names == ["en"] and held > 100_000
    assert most < 150 * held


def test_a_worker_gives_arrow_memory_back(monkeypatch):
    """When another operator's cache goes, and only then, so does what Arrow holds unused."""
    given = []
    monkeypatch.setattr(common, "_CACHES", {})
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: given.append(1)})())
    common.worker_cache("tokens")["kept"] = 1
    assert common.worker_cache("tokens") == {"kept": 1} and not given
    assert common.worker_cache("language") == {} and given == [1]


def test_cuts_in_long_texts_do_not_show(spark, monkeypatch):
    found = language_id.learn(training(spark, TEXTS.items()))
    text = "the cat, 'sat' on a mat... é 12 the dog  sat" * 7
    whole, count, signs = found.entropies(["ab", text, None, "x"])
    wide = language_id.gram_counts(training(spark, [("en", text)]).withColumn("held", F.lit(False))).collect()
    for chars in (1, 2, 5, 17):
        monkeypatch.setattr(language_id, "CHARS", chars)
        again, count_, signs_ = found.entropies(["ab", text, None, "x"])
        assert np.allclose(whole, again) and (count == count_).all() and (signs == signs_).all()
        pieces = [f for _, _, f, _, _ in language_id.stretches([text])]
        at, n = np.unique(np.concatenate(pieces).view(np.int64), return_counts=True)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == {r.gram: r.n for r in wide}


def test_rejection_rates(spark):
    """Random letters and languages nobody taught are rejected; hardly any text of a learned one is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.learn(docs.where(fold(F.col("doc_id"), 5) != 0))
    rng = random.Random(4)
    for length, most in ((50, 0.05), (100, 0.01), (300, 0.0)):
        texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(length)) for _ in range(300)]
        assert found.decide(texts)[3].mean() <= most
    finnish = "hallitus kertoi tänään että uudet säännöt tulevat voimaan ensi viikolla kaikille maan asukkaille ja kouluille annetaan lisää rahaa"
    assert not found.decide([finnish])[3][0]
    held = [r.text for r in docs.where(fold(F.col("doc_id"), 5) == 0).collect() if r.text]
    assert found.decide(held)[3].mean() > 0.995


def test_odd_training_rows(spark):
    odd = spark.createDataFrame([(None, "some text", "en"), (1, None, "en"), (2, "", "de"), (3, "12 ?!", "fr"), (4, "text", None), (5, "x" * 70_000, "en")],
                                "doc_id long, text string, lang string")
    found = language_id.learn(odd)
    assert found.names == ["en"]  # a language without a letter has nothing to be learned from
    assert language_id.learn(odd.limit(0)).names == []


def test_what_is_not_held_in_memory_still_decides(spark, monkeypatch):
    """With a budget far too small, n-grams that were not sent are looked up: same numbers as with all of them in memory (F4)."""
    rows = [("en", TEXTS["en"] * 3)] * 25 + [("de", TEXTS["de"]), ("xx", "zorp"), ("zh", "訴訟事件 語言模型 訴訟 法院事件 \U0001f600 語言")]
    asked = [*ASKED, "法院 語言", "訴訟事件", *TEXTS.values()]
    whole = language_id.learn(training(spark, rows))
    assert all(model.files is None for model in whole.models)
    monkeypatch.setattr(language_id, "MOST_GRAMS", 8)
    monkeypatch.setattr(language_id, "LEAST_GRAMS", 2)
    monkeypatch.setattr(language_id, "FILE_GRAMS", 7)
    found = language_id.learn(training(spark, rows))
    assert all(sum(len(level.grams) for level in model.levels[1:]) <= 2 for model in found.models)
    assert found.names == whole.names and max(len(files) for model in found.models for files in model.files) > 1
    assert np.allclose(found.entropies(asked)[0], whole.entropies(asked)[0], atol=1e-9)
    assert np.allclose(found.limits, whole.limits)
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    seen = [sorted(map(tuple, language_id.identified(docs, i).collect())) for i in (found, whole)]
    assert [r[:2] + r[4:] for r in seen[0]] == [r[:2] + r[4:] for r in seen[1]]
    assert np.allclose([r[2:4] for r in seen[0]], [r[2:4] for r in seen[1]], atol=1e-9)
