"""Adaptive context-mixing range coder for blocks of token ids.

A block is coded by itself: header, lane sizes, words of the lanes, checksum. Its ids are cut into lanes that are coded
side by side, one id of each lane a step, with one model that learns from all lanes after each step. Two predictors, of
order 2 and order 1, name the id that last followed the same two ids or the same id. Whether the named id comes is a
binary decision; its probability mixes, in the logistic domain with weights that learn, the hit rates seen for the
confidence of either predictor and the order-0 share of the named id. An id that neither names is coded by the adaptive
order-0 frequencies. All arithmetic is the same in both directions, so a block decodes to just what was coded.

Format, little-endian: magic 4 bytes, vocabulary u32, ids u32, lanes u32, words of each lane u32, CRC32 of the ids u32, words u32.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"dkT1"
LANES = 16_384  # at most 65,536
SHORTEST_LANE = 64
SLOTS = 1 << 17  # of the order-2 predictor
STATES = 16  # levels of confidence
STEP = 24  # what an id's order-0 count grows by
SCALE = 1 << 16  # of a binary decision

_HIGH = np.uint64(1 << 32)
_LOW_WORD = np.uint64((1 << 32) - 1)
_0, _32 = np.uint64(0), np.uint64(32)
_BITS = np.uint64(16)  # of SCALE


#: ln(p / (1 - p)) in units of 1/256 for p in steps of 1/4096, and back to p out of SCALE: whole numbers, so that every
#: machine computes the same.
_STRETCH = np.array([round(256 * math.log((2 * i + 1) / (8191 - 2 * i))) for i in range(4096)], np.int32)
_FAR = 2_300  # beyond it p stays the same
_UNIT = 1 << 16  # of a weight
_LEAST, _MOST = -2 * _UNIT, 3 * _UNIT
_REACH = 9 * int(_STRETCH[-1]) + 1  # of three stretched inputs with weights of at most _MOST
_SQUASH = np.array([min(SCALE - 64, max(64, round(SCALE / (1 + math.exp(-max(-_FAR, min(_FAR, i)) / 256))))) for i in range(-_REACH, _REACH + 1)], np.int64)
#: Confidence after a miss and, STATES further, after a hit.
_SURE_NEXT = np.array([i >> 1 if i > 1 else 1 for i in range(STATES)] + [min(i + 1, STATES - 1) for i in range(STATES)], np.int32)
_SECOND = np.arange(STATES * STATES) & (STATES - 1)  # of a state, the lower predictor's confidence


class _Model:
    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary = vocabulary
        self.counts = np.ones(vocabulary, np.int64)
        self.sums = np.arange(vocabulary + 1, dtype=np.int64)
        # id named after an id (or two), times STATES, plus confidence
        self.one, self.two = np.zeros(vocabulary, np.int32), np.zeros(SLOTS, np.int32)
        self.rates = np.full((2, STATES * STATES), SCALE // 3)  # of hits by confidence, for either decision
        self.weights = [[_UNIT // 2, _UNIT * 2 // 5, _UNIT // 10], [0, _UNIT * 4 // 5, _UNIT // 5]]
        self.before, self.last = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)

    def name(self, n: int) -> None:
        """What the predictors say for the first ``n`` lanes."""
        last = self.last[:n]
        seen = self.before[:n].view(np.uint32) * np.uint32(2_654_435_761)
        seen ^= last.view(np.uint32) * np.uint32(2_246_822_519)
        seen >>= np.uint32(32 - 17)
        self.slot, self.key = seen.astype(np.intp), last.astype(np.intp)
        self.entry2, self.entry1 = self.two.take(self.slot), self.one.take(self.key)
        self.sure2, self.sure1 = self.entry2 & 15, self.entry1 & 15
        named2, self.named1 = self.entry2 >> 4, self.entry1 >> 4
        unsure = self.sure2 == 0
        self.first = named2 + self.named1 * unsure  # an entry without confidence names id 0
        self.state = ((self.sure2 << 4) + self.sure1 * ((self.named1 == named2) | unsure)).astype(np.intp)
        self.total = int(self.sums[-1])
        self.sure = _STRETCH[self.rates >> 4]

    def chance(self, which: int, state: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability out of ``SCALE`` that the named id comes, and the mixer's input from the id's own share.

        The other two inputs hang on the state alone, so they are mixed once for each state."""
        w = self.weights[which]
        known = w[0] * self.sure[which] + w[1] * self.sure[1][_SECOND] + (_REACH << 16)  # below 2**31, as all sums here
        share = self.counts.take(named)
        share *= 4095
        share //= self.total
        share = _STRETCH.take(share)
        mixed = share * np.int32(w[2])
        mixed += known.take(state)
        mixed >>= 16
        return _SQUASH.take(mixed), share

    def learn_hit(self, which: int, state: np.ndarray, p: np.ndarray, share: np.ndarray, hit: np.ndarray) -> None:
        if not len(state):
            return
        rates = self.rates[which]
        won = hit.astype(np.int64)
        won <<= 8  # STATES * STATES
        missed, hits = np.bincount(state + won, minlength=2 * STATES * STATES).reshape(2, -1)
        n = missed + hits
        expected = np.bincount(state, p, STATES * STATES).astype(np.int64)  # sums far below 2**53 are exact
        rates += (hits * SCALE - rates * n) // (n + 32)
        np.clip(rates, 64, SCALE - 64, out=rates)
        off = hits * SCALE - expected
        won <<= 8
        won -= p
        errors = (self.sure[which] * off).sum(), (self.sure[1][_SECOND] * off).sum(), np.dot(share, won)
        for i, error in enumerate(errors):
            moved = self.weights[which][i] + int(error) // (len(state) * 12_800)
            self.weights[which][i] = min(_MOST, max(_LEAST, moved))

    def at(self, values: np.ndarray) -> np.ndarray:
        """The ids whose order-0 stretches hold the values; searched in about ascending order, which stays in the cache."""
        order = np.argsort((values >> max(0, self.total.bit_length() - 16)).astype(np.uint16), kind="stable")  # by radix
        ids = np.empty(len(values), np.int64)
        ids[order] = np.searchsorted(self.sums, values[order], "right") - 1
        return ids

    def learn(self, ids: np.ndarray, missed: np.ndarray) -> None:
        n = len(ids)
        entries = ids << 4
        self.two[self.slot] = self._taught(entries, self.entry2, self.sure2)
        self.one[self.key] = self._taught(entries, self.entry1, self.sure1)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids
        if len(missed):
            np.add.at(self.counts, missed, STEP)
            np.cumsum(self.counts, out=self.sums[1:])

    @staticmethod
    def _taught(entries: np.ndarray, held: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """A firm entry stays, whether right or not; a right one is the same either way."""
        named = held - sure
        right = (named == entries) * np.int32(STATES)
        right += sure
        named -= entries
        named *= sure > 1
        named += entries
        named += _SURE_NEXT.take(right)
        return named


def _halves(room: np.ndarray, p: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of the part of a range that a decision leaves: up to its bound after a hit, from there on after a miss."""
    part = room >> _BITS
    bound = part * p.view(np.uint64)
    missed = (~hit).astype(np.uint64)
    begin = bound * missed
    part <<= _BITS
    part -= begin
    part *= missed
    bound -= begin
    part += bound
    return begin, part


class _Writer:
    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.lane, self.word = [], []

    def decide(self, at: np.ndarray | slice, p: np.ndarray, hit: np.ndarray) -> None:
        begin, room = _halves(self.range[at], p, hit)
        self.low[at] += begin
        self._narrow(at, room)

    def code(self, at: np.ndarray, start: np.ndarray, size: np.ndarray, total: int) -> None:
        part = self.range[at] // np.uint64(total)
        self.low[at] += part * start.view(np.uint64)
        self._narrow(at, part * size.view(np.uint64))

    def _narrow(self, at: np.ndarray | slice, room: np.ndarray) -> None:
        self.range[at] = room
        short = np.flatnonzero(room < _HIGH)
        if not isinstance(at, slice):
            short = at[short]
        if len(short):
            low, room = self.low[short], self.range[short]
            self.lane.append(short)
            self.word.append((low >> _32).astype(np.uint32))
            self.range[short] = _kept(low, room) << _32
            self.low[short] = low << _32

    def words(self, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        for shift in (_32, _0):
            self.lane.append(np.arange(lanes))
            self.word.append((self.low >> shift).astype(np.uint32))
        lane, word = np.concatenate(self.lane).astype(np.uint16), np.concatenate(self.word)  # short keys sort by radix
        return np.bincount(lane, minlength=lanes), word[np.argsort(lane, kind="stable")]


def _kept(low: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The range cut so that all of it shares its upper word: no carry is ever needed."""
    return np.minimum(_HIGH - (low & _LOW_WORD), room)


class _Reader:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.words = np.concatenate((words, np.zeros(2, np.uint32))).astype(np.uint64)
        self.at = np.cumsum(sizes) - sizes
        self.low, self.range = np.zeros(len(sizes), np.uint64), np.full(len(sizes), 2**64 - 1, np.uint64)
        self.off = self.words[self.at] << _32 | self.words[self.at + 1]  # code minus low
        self.at += 2

    def decide(self, at: np.ndarray | slice, p: np.ndarray) -> np.ndarray:
        room = self.range[at]
        hit = self.off[at] < (room >> _BITS) * p.view(np.uint64)
        self._narrow(at, *_halves(room, p, hit))
        return hit

    def value(self, at: np.ndarray, total: int) -> np.ndarray:
        self.part = self.range[at] // np.uint64(total)
        return np.minimum(self.off[at] // self.part, np.uint64(total - 1)).view(np.int64)

    def code(self, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self._narrow(at, self.part * start.view(np.uint64), self.part * size.view(np.uint64))

    def _narrow(self, at: np.ndarray | slice, begin: np.ndarray, room: np.ndarray) -> None:
        self.low[at] += begin
        self.off[at] -= begin
        self.range[at] = room
        short = np.flatnonzero(room < _HIGH)
        if not isinstance(at, slice):
            short = at[short]
        if len(short):
            low = self.low[short]
            self.range[short] = _kept(low, self.range[short]) << _32
            self.low[short] = low << _32
            self.off[short] = self.off[short] << _32 | self.words[np.minimum(self.at[short], len(self.words) - 1)]
            self.at[short] += 1


def _shape(number: int) -> tuple[int, int]:
    """Lanes and their length."""
    lanes = max(1, min(LANES, number // SHORTEST_LANE))
    return lanes, -(-number // lanes)


def _alive(step: int, number: int, lanes: int, length: int) -> int:
    """Lanes that still have an id at a step: all, or all but those past the end (the last ones)."""
    return lanes if step + (lanes - 1) * length < number else -(-(number - step) // length)


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    number = len(ids)
    lanes, length = _shape(number)
    table = np.zeros(lanes * length, np.int32)
    table[:number] = ids
    table = np.ascontiguousarray(table.reshape(lanes, length).T)
    model, out = _Model(vocabulary, lanes), _Writer(lanes)
    for step in range(length if number else 0):
        n = _alive(step, number, lanes, length)
        now = table[step, :n]
        model.name(n)
        p, x = model.chance(0, model.state, model.first)
        hit = now == model.first
        out.decide(slice(0, n), p, hit)
        left = ~hit
        second = np.flatnonzero(left & (model.named1 != model.first))
        state1, named1 = model.sure1.take(second).astype(np.intp), model.named1.take(second)
        p1, x1 = model.chance(1, state1, named1)
        hit1 = now.take(second) == named1
        out.decide(second, p1, hit1)
        left[second] = ~hit1
        missed = np.flatnonzero(left)
        sign = now.take(missed).astype(np.intp)
        out.code(missed, model.sums.take(sign), model.counts.take(sign), model.total)
        model.learn_hit(0, model.state, p, x, hit)
        model.learn_hit(1, state1, p1, x1, hit1)
        model.learn(now, sign)
    sizes, words = out.words(lanes)
    plain = zlib.crc32(np.asarray(ids, "<u4").tobytes())
    body = struct.pack("<4sIII", MAGIC, vocabulary, number, lanes) + sizes.astype("<u4").tobytes()
    body += struct.pack("<I", plain) + words.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(block: bytes) -> np.ndarray:
    """The ids; ValueError if the block is not whole."""
    if len(block) < 24 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("the block's checksum does not hold")
    magic, vocabulary, number, lanes = struct.unpack("<4sIII", block[:16])
    if magic != MAGIC:
        raise ValueError("not a block of ids")
    sizes = np.frombuffer(block, "<u4", lanes, 16).astype(np.int64)
    plain = struct.unpack_from("<I", block, 16 + 4 * lanes)[0]
    words = np.frombuffer(block[20 + 4 * lanes : -4], "<u4")
    _, length = _shape(number)
    table = np.zeros((length, lanes), np.int32)
    model, source = _Model(vocabulary, lanes), _Reader(sizes, words)
    for step in range(length if number else 0):
        n = _alive(step, number, lanes, length)
        model.name(n)
        now = table[step, :n]
        p, x = model.chance(0, model.state, model.first)
        hit = source.decide(slice(0, n), p)
        np.multiply(model.first, hit, out=now)
        left = ~hit
        second = np.flatnonzero(left & (model.named1 != model.first))
        state1, named1 = model.sure1.take(second).astype(np.intp), model.named1.take(second)
        p1, x1 = model.chance(1, state1, named1)
        hit1 = source.decide(second, p1)
        now[second] = named1 * hit1
        left[second] = ~hit1
        missed = np.flatnonzero(left)
        sign = model.at(source.value(missed, model.total))
        source.code(missed, model.sums.take(sign), model.counts.take(sign))
        now[missed] = sign
        model.learn_hit(0, model.state, p, x, hit)
        model.learn_hit(1, state1, p1, x1, hit1)
        model.learn(now, sign)
    ids = table.T.reshape(-1)[:number]
    if zlib.crc32(ids.astype("<u4").tobytes()) != plain:
        raise ValueError("the ids' checksum does not hold")
    return ids
