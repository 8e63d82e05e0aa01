"""Conversation structure repair by Wagner-Fischer alignment with the alternating grammar ``(s?(ua)+)?``.

Every string of the grammar is an alternation, so a target is given by its length (odd: it begins with a system turn) and
all targets that end alike share their suffixes. One Wagner-Fischer table, filled from the end of the conversation, thus
holds the cost of aligning the turns with every feasible length. A narrow pass finds an incumbent cost, whose Ukkonen band
bounds the exact pass. Every length that attains the least cost is traced back, and the audits are compared.

A conversation is aligned in segments of ``SEGMENT`` turns, so that a task holds one segment at a time however long a
conversation is. A segment is aligned from every phase of the grammar to every other; the phases where segments meet are
chosen afterwards over a few numbers a segment. As inserts stand before a turn, two different audits of a segment differ
at a place of both, so the least audit of the whole is made of least audits of segments: the result is the one a single
table gives. Texts are moved to their edits once, and hashed turn by turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut, shared_folder
from docketry.llm.merkle import group_key
from docketry.llm.ranks import ranked

SEGMENT_BITS = 10
SEGMENT = 1 << SEGMENT_BITS
WHITE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5  # costs; a truncated turn that stays costs its own
FAR = 1 << 29
NARROW = 8  # half the band of the pass that finds the incumbent
OWN_STEP = 1 << 30  # a turn's own place among the inserts before it

#: Phases of the grammar: nothing yet, after a system turn, after a user turn, after a whole pair.
NOTHING, SYSTEM, OPEN, PAIRED = range(4)

Way = tuple[int, int, int, str]  # phase before, phase after, cost, audit


class _Table:
    """``cost[i, k]``: the least cost of making the last ``k`` signs of a target that ends in ``last`` from the turns i on."""

    def __init__(self, initials: str, faults: str, last: str, final: bool, limit: int | None):
        n = len(initials)
        self.initials, self.faults, self.n, self.last = initials, faults, n, last
        self.other = "u" if last == "a" else "a"
        stay = np.array([f != "d" for f in faults], np.int64)
        left = np.concatenate([np.cumsum(stay[::-1])[::-1], [0]])  # turns from i on that may stay
        spare = NARROW if limit is None else max(0, limit - DELETE * int(n - left[0]))
        down, up = (spare, spare) if limit is None else (spare // DELETE, spare // INSERT)
        width = n + up + 1
        signs = np.arange(width)
        self.cost = np.full((n + 1, width), FAR, np.int64)
        self.cost[n, 0] = 0
        if final:
            self.cost[n, : min(width, up + 1)] = INSERT * signs[: min(width, up + 1)]
        is_last = signs % 2 == 1
        for i in range(n - 1, -1, -1):
            a, b = max(0, left[i] - down), min(width, left[i] + up + 1)
            here = self.cost[i + 1, a:b] + DELETE
            if stay[i]:
                keep = self.cost[i + 1, max(a - 1, 0) : b - 1] + (TRUNCATED if faults[i] == "t" else 0)
                sign = is_last[max(a, 1) : b]
                keep = keep + np.where(sign, initials[i] != last, initials[i] != self.other) * REROLE
                here[max(a, 1) - a :] = np.minimum(here[max(a, 1) - a :], keep)
            fall = INSERT * signs[a:b]
            self.cost[i, a:b] = np.minimum(np.minimum.accumulate(here - fall) + fall, FAR)

    def sign(self, k: int) -> str:
        return self.last if k % 2 else self.other

    def audit(self, i: int, k: int) -> str:
        """The ASCII-least cheapest edits from turn ``i`` on."""
        out, cost = [], self.cost
        while i < self.n or k:
            now = cost[i, k]
            if i < self.n and cost[i + 1, k] + DELETE == now:
                out.append("D")
                i += 1
            elif k and cost[i, k - 1] + INSERT == now:
                out.append("I")
                k -= 1
            else:
                out.append("K" if self.initials[i] == self.sign(k) else "R")
                i, k = i + 1, k - 1
        return "".join(out)


def _lengths(phase: int, table: _Table) -> np.ndarray:
    """Suffix lengths a target may still have after ``phase``: the first sign must fit, and NOTHING and SYSTEM need one."""
    k = np.arange(table.cost.shape[1])
    wanted = "a" if phase == OPEN else "u"
    fits = np.where(k % 2 == 1, table.last == wanted, table.other == wanted)
    return k[fits & ((k > 0) | (phase in (OPEN, PAIRED)))]


def _best(table: _Table, phase: int) -> tuple[int, str] | None:
    """Least cost and audit of all lengths from ``phase`` to the end of ``table``'s targets."""
    n, found = table.n, None
    k = _lengths(phase, table)
    cost = table.cost[0, k] if len(k) else np.zeros(0, np.int64)
    least = int(cost.min()) if len(k) else FAR
    if least < FAR:
        found = least, min(table.audit(0, int(j)) for j in k[cost == least])
    later = _lengths(SYSTEM, table)
    if phase == NOTHING and len(later):  # the first turn that stays is a system turn
        kept = [p for p in range(n) if table.initials[p] == "s" and table.faults[p] != "d"]
        costs = [DELETE * p + (TRUNCATED if table.faults[p] == "t" else 0) + int(table.cost[p + 1, later].min()) for p in kept]
        least = min(costs, default=FAR)
        if least < FAR and (found is None or least <= found[0]):
            p = max(p for p, c in zip(kept, costs, strict=True) if c == least)  # the audit with more leading deletions is the lesser
            rest = table.cost[p + 1, later]
            audit = "D" * p + "K" + min(table.audit(p + 1, int(j)) for j in later[rest == rest.min()])
            found = min(found, (least, audit)) if found else (least, audit)
    return found


def _deleted(initials: str, faults: str, phase: int) -> Iterator[Way]:
    """Ways that leave no user or assistant turn."""
    n = len(initials)
    if phase in (NOTHING, SYSTEM):
        yield phase, phase, DELETE * n, "D" * n
    if phase == NOTHING:
        kept = [(DELETE * (n - 1) + (TRUNCATED if faults[p] == "t" else 0), "D" * p + "K" + "D" * (n - p - 1))
                for p in range(n) if initials[p] == "s" and faults[p] != "d"]
        if kept:
            yield (NOTHING, SYSTEM, *min(kept))


@lru_cache(maxsize=20_000)
def aligned(code: str, first: bool, final: bool) -> list[Way]:
    """The least cost and audit of a segment from each phase to each. ``code``: an initial and a fault a turn, ``d`` for
    turns that must go, ``t`` for truncated ones. ``first``: it begins a conversation; ``final``: it ends one."""
    initials, faults = code[0::2], code[1::2]
    phases = (NOTHING,) if first else (NOTHING, SYSTEM, OPEN, PAIRED)
    ways = [w for p in phases for w in _deleted(initials, faults, p) if not final or w[1] == NOTHING]
    for end, last in ((PAIRED, "a"), (OPEN, "u")):
        if final and end == OPEN:
            continue
        limit = DELETE * len(initials) + 2 * INSERT  # all turns deleted, an insert or two
        if len(initials) > 2 * NARROW:
            narrow = _Table(initials, faults, last, final, None)
            met = [_best_cost(narrow, p) for p in phases]
            limit = max(min(limit, m) for m in met)
        table = _Table(initials, faults, last, final, limit)
        ways += [(p, end, *found) for p in phases if (found := _best(table, p))]
    return ways


def _best_cost(table: _Table, phase: int) -> int:
    k = _lengths(phase, table)
    return int(table.cost[0, k].min()) if len(k) else FAR


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


@dataclass
class Repair:
    summary: DataFrame  # one row per conversation that has turns
    turns: DataFrame  # one row per edit, with the repaired turn


_WAYS = pa.list_(pa.struct([("phase", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("order", pa.int32()), ("audit", pa.string())]))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        illegal, first, last, every = [], [], [], []
        for segment, final, code in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            ways = aligned(code, segment == 0, final)
            order = {}
            for phase in {w[0] for w in ways}:
                order |= {w: i for i, w in enumerate(sorted((w for w in ways if w[0] == phase), key=lambda w: w[3]))}
            every.append([{"phase": w[0], "end": w[1], "cost": w[2], "order": order[w], "audit": w[3]} for w in ways])
            illegal.append(illegal_pairs(code[0::2]))
            first.append(code[0])
            last.append(code[-2])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(illegal, pa.int64()),
                                          pa.array(first, pa.string()), pa.array(last, pa.string()), pa.array(every, _WAYS)],
                                         ["key", "segment", "code", "illegal", "first", "last", "ways"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phases between segments: from the last segment back, the least cost, then the lesser audit."""
    path = pa.list_(pa.struct([("segment", pa.int64()), ("phase", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        cost, illegal, paths = [], [], []
        for parts in batch.column(1).to_pylist():
            after, choices = {NOTHING: 0, PAIRED: 0}, []
            for part in reversed(parts):
                best: dict[int, tuple[int, int, int]] = {}
                for w in part["ways"]:
                    if w["end"] in after:
                        found = (w["cost"] + after[w["end"]], w["order"], w["end"])
                        best[w["phase"]] = min(best.get(w["phase"], found), found)
                after = {p: f[0] for p, f in best.items()}
                choices.append({p: f[2] for p, f in best.items()})
            cost.append(after[NOTHING])
            phase, way = NOTHING, []
            for part, choice in zip(parts, reversed(choices), strict=True):
                way.append({"segment": part["segment"], "phase": phase, "end": choice[phase]})
                phase = choice[phase]
            paths.append(way)
            seams = sum(illegal_pairs(a["last"] + b["first"]) for a, b in zip(parts, parts[1:], strict=False))
            illegal.append(sum(p["illegal"] for p in parts) + seams)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(illegal, pa.int64()), pa.array(cost, pa.int64()), pa.array(paths, path)],
                                         ["key", "illegal", "cost", "path"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sign of a segment's audit with its turn and its new role; inserts stand before the turn that follows them."""
    made = pa.list_(pa.struct([("pos", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("role", pa.string())]))
    for batch in batches:
        out = []
        for start, phase, code, audit in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
            row, inserted, edits = 0, 0, []
            for sign in audit:
                role = ("assistant" if phase == OPEN else "user") if sign in "RI" else None
                edits.append({"pos": start + row, "step": inserted if sign == "I" else OWN_STEP, "edit": sign, "role": role})
                if sign == "K" and code[2 * row] == "s":
                    phase = SYSTEM
                elif sign != "D":
                    phase = PAIRED if phase == OPEN else OPEN
                inserted = inserted + 1 if sign == "I" else 0
                row += sign != "I"
            out.append(edits)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, made)], ["key", "edits"])


def _own_id(key: Column, kind) -> Column:
    return F.when(key == "", F.lit(None)).otherwise(F.substr(key, F.lit(2))).cast(kind)


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """The cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

    ``summary`` has one row per conversation: conv_id, gaps (missing turn numbers), blank, duplicate, truncated (rows by their
    first fault), illegal (neighbours whose initials are not su, ua or au), cost and audit (an initial per edit: Delete,
    Insert, Keep, Rerole). ``turns`` has one row per edit: conv_id, pos, step (the order), turn, edit, role and text after the
    edit; what was deleted is there with its old role and text, an insert has an empty text and no turn.

    A NULL role or text is one space, so a NULL text is blank. Turns stand by their number, NULL first; turns that share a
    number by role and digest of the text, so repeated rows stand side by side and all but the first are duplicates. Rows
    with a NULL id are a conversation of their own. An empty table gives empty results; further columns are not read.
    """
    spark, kind = conversations.sparkSession, conversations.schema[id_col].dataType
    folder = shared_folder(spark, "conversations")
    conversations.select(group_key(F.col(id_col)).alias("key"), F.col(turn_col).alias("turn"),
                         F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
                         F.monotonically_increasing_id().alias("uid")).write.parquet(f"{folder}/turns")
    rows = spark.read.parquet(f"{folder}/turns")
    tail = F.rtrim("text", F.lit(WHITE))
    fault = F.when(tail == "", "b").when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), "t").otherwise("k")
    initial = F.substring("role", 1, 1)
    narrow = cut(rows.select("key", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "uid", fault.alias("fault"),
                             F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial")))
    placed = cut(ranked(narrow, ["key"], ["turn", "role", "digest"], "pos"))
    firsts = placed.groupBy("key", "role", "digest").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("new"))
    marked = cut(placed.join(firsts, ["key", "pos"], "left").withColumn(
        "fault", F.when((F.col("fault") != "b") & F.col("new").isNull(), "r").otherwise(F.col("fault"))).select(
        "key", "pos", "uid", "turn", "initial", "fault"))
    number = lambda letter: F.count(F.when(F.col("fault") == letter, 1))
    counts = cut(marked.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        number("b").alias("blank"), number("r").alias("duplicate"), number("t").alias("truncated"), F.count(F.lit(1)).alias("n")))
    code = F.concat("initial", F.when(F.col("fault").isin("b", "r"), "d").otherwise(F.col("fault")))
    segments = marked.groupBy("key", F.shiftright("pos", SEGMENT_BITS).alias("segment")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", code.alias("code")))), lambda t: t["code"]), "").alias("code"))
    ended = segments.join(counts.select("key", F.shiftright(F.col("n") - 1, SEGMENT_BITS).alias("last")), "key")
    ways = cut(ended.select("key", "segment", (F.col("segment") == F.col("last")).alias("final"), "code").mapInArrow(_align, (
        "key string, segment long, code string, illegal long, first string, last string, "
        "ways array<struct<phase: int, end: int, cost: long, order: int, audit: string>>")))
    short = F.transform("ways", lambda w: F.struct(*[w[c].alias(c) for c in ("phase", "end", "cost", "order")]))
    parts = ways.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("segment", "illegal", "first", "last", short.alias("ways")))).alias("parts"))
    chained = cut(parts.mapInArrow(_chain, "key string, illegal long, cost long, path array<struct<segment: long, phase: int, end: int>>"))
    taken = F.filter("ways", lambda w: (w["phase"] == F.col("phase")) & (w["end"] == F.col("end")))[0]["audit"]
    picked = cut(chained.select("key", F.inline("path")).join(ways, ["key", "segment"]).select(
        "key", "segment", "phase", "code", taken.alias("audit")))
    in_order = F.sort_array(F.collect_list(F.struct("segment", "audit")))
    audits = picked.groupBy("key").agg(F.array_join(F.transform(in_order, lambda p: p["audit"]), "").alias("audit"))
    summary = counts.join(chained.select("key", "illegal", "cost"), "key").join(audits, "key").select(
        _own_id(F.col("key"), kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    starts = picked.select("key", F.shiftleft("segment", SEGMENT_BITS).alias("start"), "phase", "code", "audit")
    edits = starts.mapInArrow(_edits, "key string, edits array<struct<pos: long, step: int, edit: string, role: string>>").select(
        "key", F.inline("edits"))
    old = marked.select("key", "pos", "uid", "turn").join(rows.select("uid", F.col("role").alias("old_role"), "text"), "uid")
    stood = edits.where("edit != 'I'").join(old, ["key", "pos"]).select(
        "key", "pos", "step", "turn", "edit", F.coalesce("role", "old_role").alias("role"), "text")
    added = edits.where("edit = 'I'").select("key", "pos", "step", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), "edit", "role",
                                             F.lit("").alias("text"))
    turns = stood.unionByName(added).select(_own_id(F.col("key"), kind).alias("conv_id"), "pos", "step", "turn", "edit", "role", "text")
    return Repair(summary, turns)


def joined_sha256(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256 of the turns that are left as ``role:text`` lines). A conversation's turns stream through its hash in
    their order and are never gathered; a NULL id is a conversation of its own."""
    left = turns.where("edit != 'D'").withColumn("key", group_key(F.col("conv_id")))
    lines = left.select("key", "conv_id", "pos", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    kind = turns.schema["conv_id"].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, state = None, None, None
        for batch in batches:
            done = []
            for key, conv, line in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
                if state is None or key != now:
                    if state is not None:
                        done.append((own, state.hexdigest()))
                    now, own, state = key, conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.column(1).type), pa.array([d[1] for d in done], pa.string())],
                                             ["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], batch.column(1).type), pa.array([state.hexdigest()], pa.string())], ["conv_id", "sha256"])

    return lines.repartition("key").sortWithinPartitions("key", "pos", "step").mapInArrow(read, f"conv_id {kind.simpleString()}, sha256 string")
