"""Ids of texts by a public tokenizer, with a cache of the words met before.

Both vocabularies in use cut a text at least before every run of white space that follows something else, and no merge
crosses such a cut; so they do between a letter and a sign behind it. So a text's ids are the ids of its pieces in order,
and a piece met before needs no second look.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docketry.llm.common import worker_cache

#: Unicode's White_Space property, as the tokenizers' own patterns mean it (Python's \s has four more characters).
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WHITE_SET = frozenset(WHITE)
_WIDE_WHITE = [int.from_bytes(chr(c).encode()) for c in WHITE if c > 127]
_SPACE, _LINE, _WORD_END = "\u0120", "\u010a", "</w>"  # fixed: how the vocabularies write a space, a line feed and the end of a word
CACHED_PIECES = 1_000_000  # in a Python worker
LONGEST_CACHED = 40
ENCODED_CHARS = 8_000_000  # encoded at once
JOINED = 200  # new pieces of one form that are looked up as one text
CALLED = 100  # such texts a call


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts(data: np.ndarray) -> np.ndarray:
    """Whether a piece begins at a byte of UTF-8: at a space or line feed behind another character than white space, and at an
    ASCII sign that is no letter behind a letter. Letters are those that every version of Unicode takes for letters."""
    cut = (data == 0x20) | (data == 0x0A)
    cut[1:] &= (data[:-1] != 0x20) & (data[:-1] - np.uint8(9) > 4)  # unsigned: what is below 9 wraps around
    wide = np.flatnonzero(cut[1:] & (data[:-1] > 127)) + 1
    code = sum(data[np.maximum(wide - k, 0)].astype(np.int32) << 8 * (k - 1) for k in (1, 2, 3))
    cut[wide[np.isin(code, _WIDE_WHITE) | np.isin(code & 0xFFFF, _WIDE_WHITE)]] = False
    letter = (data | 0x20) - np.uint8(ord("a")) < 26
    sign = (data < 128) & ~letter
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # of Latin-1; these two are signs
    cut[1:] |= letter[:-1] & sign[1:]
    return cut


class Encoder:
    """``keep_white``: whether white space before a word belongs to its piece (byte-level) or is dropped (word-level)."""

    def __init__(self, path: str, keep_white: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._keep_white = keep_white
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._edges = np.zeros((3, max(vocabulary.values()) + 1), bool)
        for token, number in vocabulary.items():
            self._edges[:, number] = token.startswith(_SPACE), token.startswith(_LINE), token.endswith(_WORD_END)
        self._places: dict[str, int] = {}  # of pieces met before, in what is kept
        self._kept = pa.array([], pa.large_binary())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; NULL counts as empty. Each distinct piece is looked up once."""
        column = pa.array(["", *texts], pa.large_string()).fill_null("")  # the first makes sure of buffers
        starts = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1)[1:]
        if not starts[-1]:
            return [b""] * len(texts)
        data = np.frombuffer(column.buffers()[2], np.uint8, starts[-1])
        cut = np.append(_cuts(data), True)
        cut[starts] = True
        at = np.flatnonzero(cut)
        del cut
        pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        ids = self._of(pieces.dictionary, pieces.indices.to_numpy())
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[np.searchsorted(at, starts)].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def _of(self, kinds: pa.LargeStringArray, codes: np.ndarray) -> pa.LargeBinaryArray:
        """Ids of the pieces that ``codes`` name. Pieces are kept for the next slices; when they get too many, only this one's."""
        names = kinds.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self._places.get, names, repeat(-1)), np.int32, len(names))
        gaps, before = np.flatnonzero(place < 0), len(self._kept)
        place[gaps] = np.arange(before, before + len(gaps))
        known = pa.concat_arrays([self._kept, self._ids([names[i] for i in gaps.tolist()])])
        if len(known) > CACHED_PIECES:
            self._places, gaps, before = {}, np.arange(len(names)), 0
        short = [i for i in gaps.tolist() if len(names[i]) <= LONGEST_CACHED][: CACHED_PIECES - before]
        self._places.update(zip([names[i] for i in short], range(before, before + len(short)), strict=True))
        self._kept = pa.concat_arrays([known[:before], known.take(pa.array(place[short], pa.int32()))])
        return known.take(pa.array(place[codes]))

    def _ids(self, pieces: list[str]) -> pa.LargeBinaryArray:
        """Ids of each piece by the tokenizer, of most forms many pieces a text: parted where ids begin with a space (form 0) or
        a line feed (1), or behind those that end a word of ASCII letters (2). Other pieces (3), and all of a text that does not
        part into as many, are texts by themselves."""
        forms = [[], [], [], []]
        if self._keep_white:
            heads = [p[:2] for p in pieces]
            form_of = {h: _form(h) for h in set(heads)}
            for i, h in enumerate(heads):
                forms[form_of[h]].append(i)
        else:
            for i, p in enumerate(pieces):
                forms[2 if p.isascii() and p.lstrip(" \n").isalpha() else 3].append(i)
        *joined, single = forms
        order, sizes, raw = [], [], []
        for form, members in enumerate(joined):
            groups = [members[k : k + JOINED] for k in range(0, len(members), JOINED)]
            for group, ids in zip(groups, self._looked_up([_glue(form, [pieces[i] for i in g]) for g in groups]), strict=True):
                edge = self._edges[form, ids]
                if np.count_nonzero(edge) != len(group):
                    single += group
                    continue
                if form == 2:
                    size = np.diff(np.flatnonzero(edge), prepend=-1)
                else:
                    size = np.diff(np.flatnonzero(edge), append=len(ids))
                    if form == 1:  # the line feed before it belongs to a piece that begins with it
                        own = np.array([pieces[i][0] == "\n" for i in group])
                        edge[edge] = ~own
                        ids, size = ids[~edge], size - ~own
                order += group
                sizes.append(size)
                raw.append(ids.tobytes())
        for i, ids in zip(single, self._looked_up([pieces[i] for i in single]), strict=True):
            order.append(i)
            sizes.append([len(ids)])
            raw.append(ids.tobytes())
        ends = 4 * np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int64)
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(raw))])
        return made.take(pa.array(np.argsort(order)))

    def _looked_up(self, texts: list[str]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), CALLED):
            for e in self._tokenizer.encode_batch_fast(texts[i : i + CALLED], add_special_tokens=False):
                yield np.array(e.ids, "<u4")


def _form(head: str) -> int:
    """Of a piece that keeps its white space, by its first two characters: 0 and 1 begin with no more of it than is said there."""
    signs = [ord(c) not in _WHITE_SET for c in head]
    if head[0] in " \n":
        return int(head[0] == "\n") if any(signs) else 3
    return 1 if signs[0] else 3


def _glue(form: int, pieces: list[str]) -> str:
    if form == 1:
        pieces = [p if p[0] == "\n" else "\n" + p for p in pieces]
    return (" " if form == 2 else "").join(pieces)


def encoder(path: str, keep_white: bool) -> Encoder:
    """One per Python worker."""
    kept = worker_cache("tokens")
    if (path, keep_white) not in kept:
        kept[path, keep_white] = Encoder(path, keep_white)
    return kept[path, keep_white]


def bounded(texts: list[str | None], chars: int = 4_000_000):
    """Consecutive slices of ``texts`` of about ``chars`` characters, at least one text each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > chars:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)
