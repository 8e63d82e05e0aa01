import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from tokenizers import Tokenizer

from docketry.llm import id_files, packing, tokens
from docketry.llm.id_codec import decode_block, encode_block
from docketry.llm.tokens import Encoder, bounded, encoder, tokenizer_path

from .conftest import ODD

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def whole(path, text):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB  'sd\n\t\r\x0b\x0c\x1c\x85\xa0   　́éΣς1٣.!<|>endoftext中\U0001F600", max_size=40))
def test_pieces_give_the_ids_of_the_whole_text(text):
    for path, keep in ((BYTE, True), (WORD, False)):
        assert np.frombuffer(encoder(path, keep).encode([text])[0], "<u4").tolist() == whole(path, text)


def test_bounded_slices_cover_all():
    texts = ["a" * 10, None, "b" * 100, "", "c"]
    assert [texts[a:b] for a, b in bounded(texts, 20)] == [["a" * 10, None], ["b" * 100], ["", "c"]] and list(bounded([])) == []


@pytest.mark.parametrize("vocabulary", [1, 2, 300, 50_257])
@pytest.mark.parametrize("number", [0, 1, 63, 64, 129, 5000, 140_001])
def test_codec_round_trip(vocabulary, number):
    rng = np.random.default_rng(number)
    for ids in (rng.integers(0, vocabulary, number), rng.zipf(1.2, number) % vocabulary, np.full(number, vocabulary - 1), np.arange(number) // 3 % vocabulary):
        assert (decode_block(encode_block(ids, vocabulary)) == ids).all()


def test_codec_learns_and_notices_damage():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_257, 500), 400)
    block = encode_block(ids, 50_257)
    assert len(block) < len(ids)  # under 8 bits an id, of 15.6
    for at in (3, 10, 100, len(block) // 2, len(block) - 1):
        with pytest.raises(ValueError):
            decode_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])
    with pytest.raises(ValueError):
        decode_block(block[:10])


@pytest.mark.parametrize("block", [id_files.BLOCK, 1000])
def test_files_round_trip(spark, documents, tmp_path, block):
    docs = documents(ODD)
    path = str(tmp_path / "ids")
    id_files.write_ids(docs, path, BYTE, 50_257, end_id=0, block=block)
    rows = sorted(id_files.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert len(rows) == len(ODD) and [r.doc_id for r in rows] == sorted([i for i, _ in ODD], key=lambda i: -1 if i is None else i)
    at, left = 0, defaultdict(list)
    for i, t in ODD:
        left[i].append([*whole(BYTE, t), 0])
    for r in rows:
        assert r.start == at
        ids = np.frombuffer(r.ids, "<u4").tolist()
        left[r.doc_id].remove(ids)
        at += len(ids)
        assert r.n_tokens == len(ids)


def test_files_of_an_empty_table_and_a_damaged_file(spark, documents, tmp_path):
    path = str(tmp_path / "none")
    id_files.write_ids(documents([]), path, BYTE, 50_257, end_id=0)
    assert id_files.read_ids(spark, path).collect() == []
    path, bad = str(tmp_path / "some"), str(tmp_path / "bad")
    id_files.write_ids(documents([(1, "some words")]), path, BYTE, 50_257, end_id=0)
    spark.read.parquet(path).selectExpr("shard", "block", "run", "start", "doc_ids", "ends", "unhex(concat('00', substr(hex(payload), 3))) payload").write.parquet(bad)
    with pytest.raises(PythonException, match="checksum"):
        id_files.read_ids(spark, bad).collect()


def slow_best_fit(lengths, capacity, most):
    bins, out, number = [], [], 0
    for length in lengths:
        fits = [b for b in bins if b[1] >= length]
        if fits:
            least = min(b[1] for b in fits)
            best = [b for b in fits if b[1] == least][-1]
            bins.remove(best)
        else:
            if len(bins) == most:
                least = min(b[1] for b in bins)
                bins.remove([b for b in bins if b[1] == least][-1])
            best = [number, capacity]
            number += 1
        out.append((best[0], capacity - best[1]))
        best[1] -= length
        if best[1]:
            bins.append(best)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80), st.integers(1, 5))
def test_best_fit_against_a_list_of_bins(lengths, most):
    fit = packing.BestFit(32, most)
    assert [fit.place(n) for n in lengths] == slow_best_fit(lengths, 32, most)


def test_packed_sequences_are_gapless_and_whole(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(documents([(1000 + k if i else None, t) for k, (i, t) in enumerate(ODD)]).select("doc_id", "text"))
    rows = packing.packed_with(docs, WORD, end_id=1).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length <= 4 * 4096
        sequences[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    for d in docs.where("doc_id IS NOT NULL").collect():
        parts = sorted(pieces[d.doc_id], key=lambda r: r.piece)
        want = [*whole(WORD, d.text), 1]
        assert np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist() == want
        assert [r.start for r in parts] == list(range(0, len(want), 4096)) and [r.piece for r in parts] == list(range(len(parts)))
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.05 * total / 4096 + 20
    assert packing.packed_with(documents([]), WORD, end_id=1).collect() == []


def test_query_digests(spark):
    from docketry.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=lambda r: r.doc_id)
    rows = {r.doc_id: r for r in QUERIES["op5_context_mixing"](spark, folder).collect()}
    at = 0
    for d in docs:
        ids = np.array([*whole(BYTE, d.text), 0], "<u4")
        assert tuple(rows[d.doc_id]) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pieces_are_looked_up_once_a_slice(monkeypatch):
    """A slice's texts are cut as a whole, and a mark behind a word does not make another word of it."""
    made = Encoder(BYTE, True)
    asked, ids = [], made._ids
    monkeypatch.setattr(made, "_ids", lambda wanted: asked.append(set(wanted)) or ids(wanted))
    texts = ["one two, two\nthree two. one", None, " two  three! ", "", "\n", " ", "élan! 3.5 it's, x́, ", "a\t b", "end\n"]
    assert [np.frombuffer(b, "<u4").tolist() for b in made.encode(texts)] == [whole(BYTE, t) for t in texts]
    assert " two" in asked[0] and " two," not in asked[0] and " two." not in asked[0]
    assert made.encode([]) == [] and made.encode([None]) == [b""]


@pytest.mark.parametrize("path, keep", [(BYTE, True), (WORD, False)])
def test_signs_behind_a_word_and_kept_pieces(monkeypatch, path, keep):
    """Signs do not make another word of the one before them, runs of white space need no other path, and what a slice held is
    not asked for in the next one, however few pieces may be kept."""
    made = Encoder(path, keep)
    asked, ids = [], made._ids
    monkeypatch.setattr(made, "_ids", lambda wanted: asked.append(set(wanted)) or ids(wanted))
    texts = ["one two,&&& two... a\n\ntwo  it's\n two", "two\u3000two\u00a0 élan\u2003\n two×two 3.5 a\tb", None, " ", "\ntwo\ntwo!\n", "x" * 60, " ́e e ́", ".\t", "\nfoo"]
    for most in (tokens.CACHED_PIECES, 5, 0):
        monkeypatch.setattr(tokens, "CACHED_PIECES", most)
        for part in (texts, texts[:1], texts[::-1]):
            assert [np.frombuffer(b, "<u4").tolist() for b in made.encode(part)] == [whole(path, t) for t in part]
        assert most != 5 or 0 < len(made._places) <= 5
    assert {" two", ",&&&", "..."} <= asked[0] and not {" two,&&&", " two..."} & asked[0]
    assert asked[1] == set() and asked[2] == {"x" * 60} and len(made._places) == len(made._kept) == 0


def test_blocks_keep_their_bytes():
    """Blocks written before stay readable, and the same ids give the same block."""
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.zipf(1.2, 100_000) % 50_257, np.tile(rng.integers(0, 50_257, 300), 100)])
    assert zlib.crc32(encode_block(ids, 50_257)) == 558_161_692
