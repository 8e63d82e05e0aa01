import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.llm import exact_dedup, near_dedup
from docketry.llm.components import stars

from .conftest import ODD


def as_dict(rows, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows)


def test_exact_groups_odd_rows(documents):
    rows = exact_dedup.exact_groups(documents(ODD)).collect()
    want = []
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in ODD]
    for i, t in norm:
        ids = [j for j, other in norm if other == t]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((str(i), str(keep), len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in rows) == sorted(want)


def test_exact_empty_table(documents):
    assert exact_dedup.exact_groups(documents([])).collect() == []
    assert exact_dedup.drop_copies(documents([])).collect() == []


def test_drop_copies_keeps_all_columns_and_one_row(documents):
    docs = documents(ODD)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 3, 7, 8, 9, 10, 11]


def test_drop_copies_goes_by_text_not_by_id(documents):
    texts = [*ODD, (None, "alone without an id"), (None, "another without an id"), (1, "A"), (5, "A"), (5, "B"), (6, "C"), (6, "D")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    left = [(r.doc_id, norm(r.text)) for r in exact_dedup.drop_copies(documents(texts)).collect()]
    want = {}
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):
        want.setdefault(norm(t), i)
    assert sorted(left, key=str) == sorted(((i, t) for t, i in want.items()), key=str)


def test_drop_near_copies_tells_rows_of_one_id_apart(documents):
    text = " ".join(f"w{i}" for i in range(300))
    other = " ".join(f"v{i}" for i in range(300))
    rows = [(1, text), (5, text.upper()), (5, other), (None, "x y z"), (None, "p q r"), (7, "m n o"), (7, "M n  o")]
    left = near_dedup.drop_near_copies(documents(rows)).collect()
    found = sorted(((r.doc_id, r.text.lower().split()) for r in left), key=str)
    assert found == sorted([(1, text.split()), (5, other.split()), (None, ["x", "y", "z"]), (None, ["p", "q", "r"]), (7, ["m", "n", "o"])], key=str)


def test_chunks_join_to_the_text_and_are_cut_by_content(spark):
    rng = np.random.default_rng(3)
    words = " ".join(str(w) for w in rng.integers(0, 5000, 20_000))
    df = spark.createDataFrame([(words,), ("first words " + words,), ("a " * 5000,)], "text string")
    a, b, c = [r[0] for r in df.select(exact_dedup.chunks(F.col("text"))).collect()]
    assert "".join(a) == words and len(a) > 100
    assert len(set(a) & set(b)) >= 0.8 * len(a)  # an insertion changes the chunks around it, and cuts by length
    assert max(len(x.split(" ")) for x in c) <= exact_dedup.LONGEST_CHUNK + 1


def test_verification_sees_two_chunks_under_one_identifier(documents, monkeypatch):
    docs = documents([(1, "a b"), (2, "c d")]).select("doc_id", "text")
    assert exact_dedup.identifiers_are_unique(docs, 1)
    monkeypatch.setattr(exact_dedup, "_halves", lambda chunk, seed: (F.length(chunk).cast("long"), F.lit(0)))
    assert not exact_dedup.identifiers_are_unique(docs, 1)


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB c\n\té", max_size=60)), max_size=6))
def test_fingerprints_match_the_definition(texts):
    assert [int(f) for f in near_dedup.fingerprints(texts)] == [slow_fingerprint(t) for t in texts]


def test_fingerprint_of_more_than_255_shingles():
    text = " ".join(str(i % 700) for i in range(3000))
    assert int(near_dedup.fingerprints([text])[0]) == slow_fingerprint(text)


def slow_components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("dense", [False, True])
def test_forest_connects_what_all_pairs_connect(dense):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 1500, dtype=np.int64).astype(np.uint64)
    if dense:  # a ball of fingerprints around one, which no vantage point can part
        masks = [(1 << int(a)) | (1 << int(b)) | (1 << int(c)) for a, b, c in rng.integers(0, 24, (4000, 3))]
        base = np.concatenate([base[:300], base[0] ^ np.array(masks, np.uint64)])
    else:
        flips = [(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 64, (700, 2))]
        base = np.concatenate([base, base[:700] ^ np.array(flips, np.uint64)])
    points = np.unique(base)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    a, b = np.nonzero(np.triu(near, 1))
    nodes = [int(p) for p in points]
    want = slow_components(nodes, zip(points[a].tolist(), points[b].tolist(), strict=True))
    links = np.concatenate([np.zeros((2, 0), np.uint64), *near_dedup.forest(points)], axis=1)
    assert slow_components(nodes, zip(links[0].tolist(), links[1].tolist(), strict=True)) == want


def test_tree_brings_every_near_pair_into_a_shard():
    rng = np.random.default_rng(6)
    points = rng.integers(0, 2**63, 4000, dtype=np.int64).astype(np.uint64)
    other = points ^ np.array([(1 << int(a)) | (1 << int(b)) | (1 << int(c)) for a, b, c in rng.integers(0, 64, (4000, 3))], np.uint64)
    tree = near_dedup.Tree(points[:1000], 4)
    assert tree.leaves > 4
    meet = np.zeros(4000, bool)
    for (_, a), (_, b) in zip(sorted(tree.deal(points), key=lambda x: x[0]), sorted(tree.deal(other), key=lambda x: x[0]), strict=True):
        meet |= np.isin(points, a) & np.isin(other, b)
    assert meet.all()


def test_near_groups_against_all_pairs(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(near_dedup, "SHARD", 20)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rows = near_dedup.near_groups(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    bits = {i: slow_fingerprint(t) for i, t in texts.items()}
    ids = sorted(bits)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (bits[a] ^ bits[b]).bit_count() <= 3]
    want = slow_components(ids, pairs)
    assert len(set(want.values())) < len(ids)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{bits[i]:016x}", want[i]) for i in ids}


def test_near_groups_odd_rows(documents):
    rows = near_dedup.near_groups(documents(ODD)).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 7)} == {1}
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 7)} == {"0" * 16}
    assert {r.component_id for r in rows if r.doc_id in (3, 4)} == {3}
    assert near_dedup.near_groups(documents([])).collect() == []
    left = near_dedup.drop_near_copies(documents(ODD))
    assert "score" in left.columns and {r.doc_id for r in left.collect()} >= {1, 3, None}


def test_stars_on_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, i) for i in range(1001, 1400)] + [(1399, 5000), (7, 7)]
    found = stars(spark.createDataFrame(chain + hub, "a long, b long"))
    assert as_dict(found.collect(), "a", "b") == sorted([(i, 0) for i in range(1, 201)] + [(i, 1000) for i in [*range(1001, 1400), 5000]])
    assert stars(spark.createDataFrame([], "a long, b long")).collect() == []
