import corpus_pipeline
from docketry.llm import decontamination, near_dedup

from .test_dedup import slow_components, slow_fingerprint
from .test_scans import slow_hits

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept = {r.doc_id for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            assert len(kept) >= 0.99 * len(before)
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(" ".join(before[i].split(" ")), i)
            assert kept == set(first.values())
        elif name == "near_dedup":
            bits = {i: slow_fingerprint(t) for i, t in before.items()}
            ids = sorted(bits)
            pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (bits[a] ^ bits[b]).bit_count() <= near_dedup.RADIUS]
            assert kept == set(slow_components(ids, pairs).values())
        elif name == "decontamination":
            assert kept == {i for i, t in before.items() if not decontamination.is_contaminated(slow_hits(t, items)[1] > 0, 1) or 20 * slow_hits(t, items)[1] < slow_hits(t, items)[0]}
        else:
            assert kept == set(before)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_on_odd_rows(spark, documents):
    from .conftest import ODD

    for rows in (ODD, []):
        docs = documents(ODD) if rows else documents([])
        docs = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()], "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.collect() is not None
            if name != "packing":
                assert out.columns == docs.columns


def test_stages_keep_further_columns(spark):
    """Columns with names the operators use themselves go through all stages but the last as they are."""
    from .conftest import ODD

    own = "row_a long, row string, recipe string, bits int, key string, first int, times int, grp string"
    docs = spark.createDataFrame([(i, t, "en", "s", 1, n, f"r{n}", "x", n, "k", 2, 3, None) for n, (i, t) in enumerate(ODD)],
                                 f"doc_id long, text string, lang string, source string, n_chars long, {own}")
    for name, stage in corpus_pipeline.STAGES:
        if name == "packing":
            break
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = {(r.doc_id, r.text, r.row_a, r["row"], r.bits, r.first, r.times) for r in docs.collect()}
        assert {(r.doc_id, r.text, r.row_a, r["row"], r.bits, r.first, r.times) for r in out.collect()} <= rows
