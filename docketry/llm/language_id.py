"""Language identification with interpolated Kneser-Ney character models.

Every language has a model of order ``ORDER`` over letters and single spaces, learned from all its training texts: tasks
count their n-grams; counts, continuation counts, discounts, probabilities and back-off weights are made in Spark over all of
them, and all of them decide. What is sent to the tasks are sorted arrays of packed n-grams, at most ``MOST_GRAMS`` over all
languages (``LEAST_GRAMS`` a language at least). Where a language has more, those that change its probabilities most are sent
with all its single signs, and the whole model lies in sorted files of the shared folder, which tasks map into memory and look
up what was not sent. So the two numbers bound what is held, not what is known: results are the same whatever they are.

A text goes to the language of lowest cross-entropy per sign. It is rejected when that exceeds what texts of the language and
of its length have: models that were not shown a tenth of the training texts score the pieces of that tenth, and the limit of
a language and length is ``MARGIN`` times the ``QUANTILE`` of its pieces.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut, shared_folder, worker_cache
from docketry.llm.ranks import ranked

ORDER = 4
MOST_GRAMS = 2_000_000
LEAST_GRAMS = 5_000
HELD = 10  # one training text in so many, by hash of its id, sets the rejection limits
BANDS = tuple(2**k for k in range(2, 13))  # signs of the pieces that stand for texts of that length and more
QUANTILE = 0.9995
MARGIN = 1.15
PIECES = 200  # a band with fewer takes the limit of the next shorter one
BIN = 0.01  # nats
SHARPNESS = 40.0  # characters that a text counts for in the score at most
FILE_GRAMS = 2_000_000  # n-grams of one file of a model: some 60 MB in the task that writes it
CHARS = 250_000  # read at once: their n-grams take some 150 bytes a character for a moment
SPACE = 32
_BITS = 16
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: 0 if it is not a letter, else its lower case folded into 16 bits."""
    if not _LETTERS:
        table = np.zeros(0x110000, np.uint16)
        for code in range(0x110000):
            char = chr(code)
            if char.isalpha():
                table[code] = max(33, ord(char.lower()[0]) % 65521)
        _LETTERS.append(table)
    return _LETTERS[0]


def letters(texts: list[str | None], within_word: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as folded letters with one space before each text's first letter and for each stretch of other signs;
    the text each belongs to; the letters of each text. ``within_word``: the first text goes on with a word."""
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t or "") for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    folded = _letters()[codes]
    is_letter = folded > 0
    # a text's own leading space: its first sign, if that is a letter, is preceded by nothing of the text
    first = np.zeros(len(codes), bool)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    first[starts] = True
    before = np.concatenate(([False], is_letter[:-1])) & ~first
    if within_word and len(before):
        before[0] = True
    begins = is_letter & ~before  # a space goes in front of each word
    out = np.zeros(int(is_letter.sum() + begins.sum()), np.uint64)
    at = np.cumsum(is_letter.astype(np.int64) + begins) - 1
    out[at[is_letter]] = folded[is_letter]
    out[at[begins] - 1] = SPACE
    owners = np.zeros(len(out), np.int64)
    owners[at[is_letter]] = owner[is_letter]
    owners[at[begins] - 1] = owner[begins]
    return out, owners, np.bincount(owner[is_letter], minlength=len(texts))


def grams(signs: np.ndarray, owners: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The packed n-gram that ends at each sign; before a text's start stand zeros."""
    out = signs.copy()
    for back in range(1, order):
        shifted = np.concatenate((np.zeros(back, np.uint64), signs[:-back])) if len(signs) > back else np.zeros(len(signs), np.uint64)
        same = np.zeros(len(signs), bool)
        same[back:] = owners[back:] == owners[:-back] if len(signs) > back else False
        out |= np.where(same, shifted, np.uint64(0)) << np.uint64(_BITS * back)
    return out


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(number of the first text, texts): many short ones, or a stretch of a long one (its number repeats)."""
    group, first, size = [], 0, 0
    for i, t in enumerate(texts):
        t = t or ""
        if len(t) > CHARS:
            if group:
                yield first, group
            for at in range(0, len(t), CHARS):
                yield i, [t[at : at + CHARS]]
            group, first, size = [], i + 1, 0
            continue
        if size + len(t) > CHARS and group:
            yield first, group
            group, first, size = [], i, 0
        group.append(t)
        size += len(t)
    if group:
        yield first, group


def stretches(texts: list[str | None], order: int = ORDER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, number of texts, the n-gram that ends at each sign, the text each belongs to, letters of each text), in
    slices. A slice that goes on with a long text knows the signs before it, so the cuts do not show."""
    last, tail, in_word = -1, np.zeros(0, np.uint64), False
    for first, some in _slices(texts):
        goes_on = first == last and len(some) == 1
        signs, owners, count = letters(some, goes_on and in_word)
        if not goes_on:
            tail = np.zeros(0, np.uint64)
        whole = np.concatenate((tail, signs))
        found = grams(whole, np.concatenate((np.zeros(len(tail), np.int64), owners)), order)[len(tail) :]
        yield first, len(some), found, owners, count
        last, tail = first, whole[-(order - 1) :] if len(some) == 1 else np.zeros(0, np.uint64)
        in_word = len(some) == 1 and bool(some[0]) and bool(_letters()[ord(some[0][-1])])


def gram_counts(training: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n, n_shown) over all texts of ``training`` (text, lang, held), rows with a NULL language left out;
    ``n_shown`` does without the texts that are held back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("language")
        for batch in batches:
            texts, langs, held = (np.array(batch.column(i).to_pylist(), object) for i in range(3))
            for lang, back in sorted(set(zip(langs.tolist(), held.tolist(), strict=True))):
                own = texts[(langs == lang) & (held == back)].tolist()
                for _, _, wanted, _, _ in stretches(own, order):
                    found, n = np.unique(wanted.view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n),
                                                      pa.array(n * (not back))], ["lang", "gram", "n", "n_shown"])

    rows = training.where(F.col("lang").isNotNull()).select("text", "lang", "held")
    counted = rows.mapInArrow(read, "lang string, gram long, n long, n_shown long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_shown").alias("n_shown"))


@dataclass
class Level:
    """Of one order: sorted n-grams with log probabilities, sorted contexts with log back-off weights."""

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    back_off: np.ndarray


@dataclass
class ModelFile:
    """Where a stretch of the sorted n-grams of one order lies, with log probabilities, their contexts and log back-off weights.

    Four arrays of 8-byte numbers follow each other. ``path`` is in the shared folder; where that is no folder of the machine,
    its tasks share one copy."""

    path: str
    grams: int
    contexts: int
    first_gram: int
    first_context: int
    _arrays: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_arrays": None}

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if self._arrays is None:
            words = np.memmap(_local(self.path), np.uint64, "r")
            keys, p, contexts, back = np.split(words, np.cumsum([self.grams, self.grams, self.contexts]))
            self._arrays = keys, p.view(np.float64), contexts, back.view(np.float64)
        return self._arrays


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path else os.path.abspath(path.removeprefix("file:")))


def _local(path: str) -> str:
    files, at = _place(path)
    if isinstance(files, fs.LocalFileSystem):
        return at
    copy = os.path.join(tempfile.gettempdir(), os.path.basename(at))  # named by a uuid
    if not os.path.exists(copy):
        draft = f"{copy}.{uuid.uuid4().hex}"
        with files.open_input_stream(at) as source, open(draft, "wb") as target:
            shutil.copyfileobj(source, target)
        os.replace(draft, copy)
    return copy


def _filed(files: list[ModelFile], wanted: np.ndarray, contexts: bool) -> tuple[np.ndarray, np.ndarray]:
    """(number, whether met) of n-grams or contexts, from the files of one order, which follow each other."""
    values, met = np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    firsts = np.array([f.first_context if contexts else f.first_gram for f in files], np.uint64)
    which = np.searchsorted(firsts, wanted, side="right") - 1
    for k in np.unique(which[which >= 0]):
        rows = np.flatnonzero(which == k)
        keys, numbers = files[k].arrays()[2:] if contexts else files[k].arrays()[:2]
        at, hit = _find(keys, wanted[rows])
        values[rows[hit]], met[rows[hit]] = numbers[at[hit]], True
    return values, met


@dataclass
class Model:
    levels: list[Level]  # from order 1
    unseen: float  # log probability of a sign never met
    files: list[list[ModelFile]] | None = None  # by order, of the whole model where ``levels`` have a part of it

    def log_p(self, wanted: np.ndarray) -> np.ndarray:
        """Log probability of the last sign of each packed n-gram, from the longest level that has it."""
        out = np.zeros(len(wanted))
        if self.files:  # the n-grams met most are in memory
            longest = self.levels[-1]
            at, met = _find(longest.grams, wanted)
            out[met] = longest.log_p[at[met]]
            out[~met] = self._log_p(wanted[~met], self._from_files)
            return out
        return self._log_p(wanted, self._from_levels)

    def _from_levels(self, order: int, wanted: np.ndarray, contexts: bool) -> tuple[np.ndarray, np.ndarray]:
        level = self.levels[order - 1]
        keys, numbers = (level.contexts, level.back_off) if contexts else (level.grams, level.log_p)
        at, met = _find(keys, wanted)
        return (numbers[at] if len(keys) else np.zeros(len(wanted))), met

    def _from_files(self, order: int, wanted: np.ndarray, contexts: bool) -> tuple[np.ndarray, np.ndarray]:
        return _filed(self.files[order - 1], wanted, contexts)

    def _log_p(self, wanted: np.ndarray, look_up) -> np.ndarray:
        out = np.zeros(len(wanted))
        open_ = np.ones(len(wanted), bool)
        for order in range(len(self.levels), 0, -1):
            keep = (np.uint64(1) << np.uint64(_BITS * order)) - np.uint64(1) if _BITS * order < 64 else np.uint64(2**64 - 1)
            part = wanted & keep
            number, met = look_up(order, part, False)
            hit = open_ & met
            out[hit] += number[hit]
            open_ &= ~met
            number, met = look_up(order, part >> np.uint64(_BITS), True)
            off = open_ & met
            out[off] += number[off]
        out[open_] += self.unseen
        return out


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, wanted), max(0, len(table) - 1))
    return at, (table[at] == wanted if len(table) else np.zeros(len(wanted), bool))


def kneser_ney(found: np.ndarray, n: np.ndarray, order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney from the counts of the n-grams of the highest order."""
    counts = {order: (found, n.astype(np.float64))}
    for k in range(order - 1, 0, -1):  # lower orders count the different signs before an n-gram
        mask = (np.uint64(1) << np.uint64(_BITS * k)) - np.uint64(1)
        shorter, different = np.unique(counts[k + 1][0] & mask, return_counts=True)
        counts[k] = shorter, different.astype(np.float64)
    signs = len(counts[1][0]) + 1
    levels: list[Level] = []
    for k in range(1, order + 1):
        keys, c = counts[k]
        once, twice = (c == 1).sum(), (c == 2).sum()
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        contexts, where = np.unique(keys >> np.uint64(_BITS), return_inverse=True)
        total, kinds = np.bincount(where, c), np.bincount(where)
        weight = discount * kinds / total
        lower = np.full(len(keys), 1 / signs) if k == 1 else np.exp(
            Model(levels, 0.0).log_p(keys & ((np.uint64(1) << np.uint64(_BITS * (k - 1))) - np.uint64(1))))
        p = np.maximum(c - discount, 0) / total[where] + weight[where] * lower
        levels.append(Level(keys, np.log(p), contexts, np.log(weight)))
    return Model(levels, float(np.log(1 / signs)))


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (_BITS * order)) - 1).cast("bigint"))


def _few(df: DataFrame) -> DataFrame:
    """Sent to all tasks if it has a row a language and languages are few, as they are."""
    return F.broadcast(df) if df.limit(10_001).count() <= 10_000 else df


def probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, size, gram, p, gain, weight) of the n-grams of all orders, interpolated Kneser-Ney over (lang, gram, n) of the highest.

    ``gain``: by how much the n-gram raises the log probability of what it was counted in, over backing off. ``weight``: the
    back-off weight of its context.
    """
    levels = {order: cut(counts)}
    for k in range(order - 1, 0, -1):  # lower orders count the different signs before an n-gram
        levels[k] = cut(levels[k + 1].groupBy("lang", _suffix(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    signs = _few(levels[1].groupBy("lang").agg((1 / (F.count(F.lit(1)) + 1)).alias("lower")))
    out, below = None, None
    for k in range(1, order + 1):
        context = F.shiftrightunsigned("gram", _BITS).alias("context")
        once, twice = F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))
        share = F.when(once > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), once / (once + 2 * twice)))).otherwise(0.5)
        discounts = _few(levels[k].groupBy("lang").agg(share.alias("d")))
        contexts = levels[k].groupBy("lang", context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        t = levels[k].select("lang", "gram", "n", context).join(contexts, ["lang", "context"]).join(discounts, "lang")
        t = t.join(signs, "lang") if k == 1 else t.withColumn("shorter", _suffix(F.col("gram"), k - 1)).join(
            below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("lower")), ["lang", "shorter"])
        weight = F.col("d") * F.col("kinds") / F.col("total")
        back = weight * F.col("lower")
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + back
        below = cut(t.select("lang", F.lit(k).alias("size"), "gram", p.alias("p"), (F.col("n") * (F.log(p) - F.log(back))).alias("gain"),
                             weight.alias("weight")))
        out = below if out is None else out.unionByName(below)
    return out


def split_by_size(grams_: DataFrame, most: int, least: int) -> tuple[DataFrame, DataFrame | None]:
    """What is held in memory: the single signs of every language and its most telling longer n-grams, ``most`` split evenly,
    ``least`` at the least; and all n-grams of the languages that have more, which must go into files (None if no language has)."""
    sizes = grams_.where("size > 1").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs, largest = grams_.select("lang").distinct().count(), sizes.agg(F.max("n")).first()[0] or 0
    each = max(least, most // max(1, langs))
    if largest <= each:
        return grams_, None
    longer = cut(grams_.where("size > 1").withColumn("loss", -F.col("gain")))
    kept = ranked(longer, ["lang"], ["loss", "size", "gram"], size="among").where(F.col("rank") < each)
    return (grams_.where("size = 1").unionByName(kept.select(*grams_.columns)),
            grams_.join(_few(sizes.where(F.col("n") > each).select("lang")), "lang"))


def filed(grams_: DataFrame) -> dict[str, list[list[ModelFile]]]:
    """Files of the whole models, by language and order. Tasks sort stretches and write them; the driver gets a row a file."""
    folder = shared_folder(grams_.sparkSession, "language-models")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("language")
        held, of, rows = [], None, 0

        def close() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _, _ in held])
            contexts, at = np.unique(keys >> np.uint64(_BITS), return_index=True)
            back = np.log(np.concatenate([w for _, _, w in held])[at])
            files, path = _place(f"{folder}/{uuid.uuid4().hex}")  # of a task that runs twice, only the files it names are read
            files.create_dir(os.path.dirname(path), recursive=True)
            with files.open_output_stream(path) as out:
                for part in (keys, np.log(np.concatenate([p for _, p, _ in held])), contexts, back):
                    out.write(part.tobytes())
            row = [*of, f"{folder}/{os.path.basename(path)}", len(keys), len(contexts), int(keys[:1].view(np.int64)[0]), int(contexts[0])]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["lang", "size", "path", "grams", "contexts", "first_gram", "first_context"])

        for batch in batches:
            langs, size = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            keys, p, weight = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            codes = langs.indices.to_numpy()
            starts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(size) != 0)) + 1).tolist(), len(keys)]
            for first, end in zip(starts, starts[1:], strict=False):
                for a in range(first, end, FILE_GRAMS):
                    b = min(a + FILE_GRAMS, end)
                    own = langs.dictionary[codes[a]].as_py(), int(size[a])
                    if held and (own != of or rows + b - a > FILE_GRAMS):
                        yield close()
                        held, rows = [], 0
                    held.append((keys[a:b].copy(), p[a:b].copy(), weight[a:b].copy()))
                    of, rows = own, rows + b - a
        if held:
            yield close()

    unsigned = F.col("gram").bitwiseXOR(F.lit(-(2**63)).cast("bigint"))  # the arrays are of unsigned numbers
    by = ["lang", "size", unsigned]
    dealt = grams_.select("lang", "size", "gram", "p", "weight").repartitionByRange(*by).sortWithinPartitions(*by)
    schema = "lang string, size long, path string, grams long, contexts long, first_gram long, first_context long"
    found: dict[str, list[list[ModelFile]]] = {}
    for r in dealt.mapInArrow(write, schema).collect():  # a row a file
        orders = found.setdefault(r["lang"], [[] for _ in range(ORDER)])
        orders[r["size"] - 1].append(ModelFile(r["path"], r["grams"], r["contexts"], r["first_gram"] % 2**64, r["first_context"]))
    for orders in found.values():
        for files in orders:
            files.sort(key=lambda f: f.first_gram)
    return found


def assembled(sizes: dict[int, tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model from the n-grams that are left and their probabilities, by order. A context's back-off weight spreads what its
    n-grams leave over the signs they do not name."""
    signs = len(sizes[1][0]) + 1
    levels: list[Level] = []
    for k in sorted(sizes):
        keys, p = sizes[k]
        shorter = keys & ((np.uint64(1) << np.uint64(_BITS * (k - 1))) - np.uint64(1))
        lower = np.full(len(keys), 1 / signs) if k == 1 else np.exp(Model(levels, -np.log(signs)).log_p(shorter))
        contexts, where = np.unique(keys >> np.uint64(_BITS), return_inverse=True)
        rest = np.maximum(1 - np.bincount(where, p, len(contexts)), 1e-9) / np.maximum(1 - np.bincount(where, lower, len(contexts)), 1e-9)
        levels.append(Level(keys, np.log(p), contexts, np.log(rest)))
    return Model(levels, float(-np.log(signs)))


def models_of(counts: DataFrame) -> tuple[list[str], list[Model]]:
    """Languages by name and their models. The n-grams that are held in memory come as Arrow columns, about 26 bytes each on the
    driver, and not as rows; those of languages that have more stay in files."""
    held, more = split_by_size(probabilities(counts), MOST_GRAMS, LEAST_GRAMS)
    files = {} if more is None else filed(more)
    kept = held.select("lang", "size", "gram", "p").toArrow()
    names, models = sorted(pc.unique(kept["lang"]).to_pylist()), []
    for name in names:
        own, sizes = kept.filter(pc.equal(kept["lang"], name)), {}
        for k in range(1, ORDER + 1):
            part = own.filter(pc.equal(own["size"], k))
            keys = part["gram"].to_numpy().view(np.uint64)
            by = np.argsort(keys)
            sizes[k] = keys[by], part["p"].to_numpy()[by]
        models.append(assembled(sizes))
        models[-1].files = files.get(name)
    return names, models


@dataclass
class Identifier:
    names: list[str]
    models: list[Model]
    limits: np.ndarray  # nats a sign by language and band

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats a sign by text and language; letters and signs by text."""
        nats, signs, count = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for first, number, found, owners, n in stretches(texts):
            rows = slice(first, first + number)
            count[rows] += n
            signs[rows] += np.bincount(owners, minlength=number)
            wanted, where = np.unique(found, return_inverse=True)
            for k, model in enumerate(self.models):
                nats[rows, k] -= np.bincount(owners, model.log_p(wanted)[where], minlength=number)
        return nats / np.maximum(signs, 1)[:, None], count, signs

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy, whether accepted."""
        if not self.names or not texts:
            none = np.zeros(len(texts))
            return ["und"] * len(texts), none, none, none.astype(bool)
        entropy, count, signs = self.entropies(texts)
        best = entropy.argmin(axis=1)
        weight = np.minimum(count, SHARPNESS)[:, None]
        score = 1 / np.exp((entropy.min(axis=1, keepdims=True) - entropy) * weight).sum(axis=1)
        lowest = entropy[np.arange(len(texts)), best]
        band = np.searchsorted(BANDS, signs, side="right") - 1  # below the shortest there is no limit
        limit = np.where(band < 0, np.inf, self.limits[best, np.maximum(band, 0)])
        known = count > 0
        names = [self.names[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
        return names, np.where(known, score, 0.0), np.where(known, lowest, 0.0), known & (lowest <= limit)


def piece_entropies(texts: list[str | None], model: Model) -> Iterator[tuple[int, np.ndarray]]:
    """(band, nats a sign) of the consecutive pieces of each band's length."""
    parts: dict[int, list[np.ndarray]] = {}
    for first, number, found, owners, _ in stretches(texts):
        wanted, where = np.unique(found, return_inverse=True)
        nats = -model.log_p(wanted)[where]
        for i in range(number):
            parts.setdefault(first + i, []).append(nats[owners == i] if number > 1 else nats)
    for some in parts.values():
        sums = np.concatenate(([0.0], np.cumsum(np.concatenate(some))))
        for band, size in enumerate(BANDS):
            ends = sums[::size]
            if len(ends) > 1:
                yield band, np.diff(ends) / size


def rejection_limits(training: DataFrame, names: list[str], shown: tuple[list[str], list[Model]]) -> np.ndarray:
    """Nats a sign by language and band, from the pieces of the texts that ``shown`` models were not shown. A band with few
    pieces has the limit of the next shorter one, a language without pieces that of all together."""
    sent = training.sparkSession.sparkContext.broadcast(dict(zip(*shown, strict=True)))
    del shown  # the workers' copies are enough

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("language")
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            texts = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs.tolist()) & set(sent.value)):
                found: dict[int, list[np.ndarray]] = {}
                for band, h in piece_entropies(texts[langs == lang].tolist(), sent.value[lang]):
                    found.setdefault(band, []).append(np.floor(h / BIN).astype(np.int64))
                for band, bins in found.items():
                    at, n = np.unique(np.concatenate(bins), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([band] * len(at), pa.int32()), pa.array(at),
                                                      pa.array(n)], ["lang", "band", "at", "n"])

    held = training.where(F.col("lang").isNotNull() & F.col("held")).select("text", "lang")
    sums = held.mapInArrow(read, "lang string, band int, at long, n long").groupBy("lang", "band", "at").agg(F.sum("n").alias("n"))
    rows = sums.toArrow().to_pandas()  # a row a bin, a few thousand a language
    sent.destroy()

    def limits(own) -> np.ndarray:
        out, last = np.full(len(BANDS), np.inf), np.inf
        for band in range(len(BANDS)):
            part = own[own["band"] == band].groupby("at")["n"].sum().sort_index()
            if part.sum() >= PIECES:
                share = part.cumsum().to_numpy() / part.sum()
                last = MARGIN * BIN * (part.index[min(int(np.searchsorted(share, QUANTILE)), len(part) - 1)] + 1)
            out[band] = last
        return out

    together = limits(rows)
    found = [limits(rows[rows["lang"] == name]) for name in names]
    return np.array([np.where(np.isinf(own), together, own) for own in found]).reshape(len(names), len(BANDS))


def learn(training: DataFrame) -> Identifier:
    """From ``training`` (doc_id, text, lang): models from all texts, limits from a tenth of them that their models had not seen."""
    held = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0, F.lit(False))
    marked = training.select(F.col("text").cast("string"), F.col("lang").cast("string"), held.alias("held"))
    counts = cut(gram_counts(marked))
    names, models = models_of(counts.select("lang", "gram", "n"))
    found = Identifier(names, models, np.full((len(names), len(BANDS)), np.inf))
    if names:
        found.limits = rejection_limits(marked, names, models_of(counts.where("n_shown > 0").select("lang", "gram", F.col("n_shown").alias("n"))))
    return found


def identified(docs: DataFrame, identifier: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1), cross_entropy (nats a character), accepted.

    ``und`` with score 0, not accepted: NULL, empty and letterless texts, and all texts if nothing was learned. Ties go to
    the first language by name. Ids may be NULL or repeated; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(identifier)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("language")
        for batch in batches:
            names, score, entropy, accepted = sent.value.decide(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(accepted)],
                ["doc_id", "lang_pred", "score", "cross_entropy", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(read, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, accepted boolean")


def keep_known(docs: DataFrame, identifier: Identifier, text_col: str = "text") -> DataFrame:
    """``docs`` without rejected documents, in one pass and without a shuffle; all columns stay.

    NULL, empty and letterless texts are rejected, as they have no language. Rows that repeat an id are judged each; an
    empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(identifier)

    column = docs.columns.index(text_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("language")
        for batch in batches:
            yield batch.filter(pa.array(sent.value.decide(batch.column(column).to_pylist())[3], pa.bool_()))

    return docs.mapInArrow(read, docs.schema)
