"""Merkle manifest, conversation repair and vector search against plain versions of themselves."""

import hashlib
import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import conversations, merkle, queries, vector_search

from .conftest import ODD

SF = "/root/testdata/sf0.001"


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def slow_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode('utf-8', 'surrogatepass'))}:{v}" for v in (row[f] for f in merkle.FIELDS)])


def slow_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def slow_siblings(levels, place):
    out = []
    for nodes in levels[:-1]:
        start = place // 8 * 8
        out.append(["".join(nodes[start:place]), "".join(nodes[place + 1 : start + 8])])
        place //= 8
    return out


def slow_manifest(rows):
    """(root, sorted (id, leaf, subroot, siblings))."""
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append((row["doc_id"], slow_leaf(row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(leaves, key=lambda x: (x[0] is not None, x[0] or 0, x[1])),) for g, leaves in groups.items()}
    trees = {g: (t[0], slow_levels([leaf for _, leaf in t[0]])) for g, t in trees.items()}
    top = slow_levels([trees[g][1][-1][0] for g in order]) if order else None
    found = [(i, leaf, trees[g][1][-1][0], slow_siblings(trees[g][1], k) + slow_siblings(top, n))
             for n, g in enumerate(order) for k, (i, leaf) in enumerate(trees[g][0])]
    return (top[-1][0] if top else None), found


def by_text(rows):
    return sorted(rows, key=str)


LEAF_ROWS = [(i, t, ("en", "de", None, "é", "")[n % 5], None if n % 3 else "s", n) for n, (i, t) in enumerate(ODD)]


def leaf_table(spark, rows):
    wide = [(*r, "clash", 7, [1]) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, leaf string, rank int, children array<int>")


@pytest.mark.parametrize("extra", [0, 1, 8, 9, 70, 600])
def test_manifest_against_plain_trees(spark, extra):
    rows = LEAF_ROWS + [(100 + i, f"text {i}", "en", "x", i) for i in range(extra)]
    docs = leaf_table(spark, rows)
    root, want = slow_manifest([r.asDict() for r in docs.collect()])
    plan = merkle.manifest(docs)
    assert plan.root == root
    got = merkle.proofs(plan, plan.leaves).collect()
    assert by_text([r.id, r.found, r.subroot, [[s.before, s.after] for s in r.siblings]] for r in got) == by_text(map(list, want))
    assert all(r.found == r.leaf for r in got)


def test_manifest_odd_sizes(spark):
    assert merkle.manifest(leaf_table(spark, [])).root is None
    one = leaf_table(spark, [(1, "only", "en", None, None)])
    plan = merkle.manifest(one)
    assert plan.root == slow_leaf(one.first().asDict())
    assert merkle.proofs(plan, plan.leaves).first().siblings == []
    same = merkle.manifest(leaf_table(spark, [(1, "again", "en", None, 3)] * 100))
    assert same.records().count() < 6  # equal contents share their records
    assert len({str(r.siblings) for r in merkle.proofs(same, same.leaves).collect()}) >= 1


def test_manifest_answers_a_few_requests_and_shows_tampering(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = merkle.manifest(docs)
    some = plan.leaves.where("id % 50 = 0")
    found = merkle.proofs(plan, some)
    checked = found.select("id", "leaf", "found", merkle.folded(F.col("leaf"), F.col("siblings")).alias("ok"),
                           merkle.folded(F.sha2(F.lit("x").cast("binary"), 256), F.col("siblings")).alias("bad")).collect()
    assert len(checked) == docs.where("doc_id % 50 = 0").count()
    assert all(r.ok == plan.root and r.bad != plan.root and r.leaf == r.found for r in checked)


def test_manifest_query(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    root, want = slow_manifest([r.asDict() for r in rows.values()])
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    expect = {}
    for i, leaf, subroot, siblings in want:
        row = rows[i].asDict()
        if zlib.crc32(str(i).encode()) % 3 == 0:
            row["text"] = row["text"] and row["text"].translate(low)
        node = slow_leaf(row)
        for before, after in siblings:
            node = sha(before, node, after)
        expect[i] = (leaf, subroot, root, sha(*[b + a for b, a in siblings]), node, node == root)
    got = queries.op11_dag_descent(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == expect
    assert len(got) == len(rows) and {r.verified for r in got} == {True, False}


# Conversation repair


def slow_repair(rows):
    """All edit sequences with at most one insert at a place, by phases: (cost, audit, repaired lines)."""
    ways, seen = {"": (0, "", ())}, set()
    faults = []
    for role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not end else "r" if (role, text) in seen else "k" if end[-1] in ".!?" else "t")
        seen.add((role, text))

    def put(to, so_far, cost, audit, lines):
        to[so_far] = min(to.get(so_far, (cost, audit, lines)), (cost, audit, lines))

    def after(so_far, sign):  # phases: nothing, s, u, p(air)
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "p", ("p", "u"): "u"}.get((so_far, sign))

    def inserted(ways):
        out = dict(ways)
        for phase, (c, a, lines) in ways.items():
            for sign, role in (("u", "user"), ("a", "assistant")):
                if after(phase, sign):
                    put(out, after(phase, sign), c + 5, a + "I", (*lines, f"{role}:"))
        return out

    for (role, text), fault in zip(rows, faults, strict=True):
        now = {}
        for phase, (c, a, lines) in inserted(ways).items():
            put(now, phase, c + 2, a + "D", lines)
            if fault in "kt":
                own = after(phase, role[:1])
                if own:
                    put(now, own, c + 5 * (fault == "t"), a + "K", (*lines, f"{role}:{text}"))
                for sign, new in (("u", "user"), ("a", "assistant")):
                    if after(phase, sign):
                        put(now, after(phase, sign), c + 1 + 5 * (fault == "t"), a + "R", (*lines, f"{new}:{text}"))
        ways = now
    cost, audit, lines = min(w for p, w in inserted(ways).items() if p in ("", "p"))
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return {"blank": faults.count("b"), "duplicate": faults.count("r"), "truncated": faults.count("t"),
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "lines": list(lines)}


def random_turns(seed, conversations_, longest):
    rng, rows = random.Random(seed), []
    for conv in range(conversations_):
        roles = rng.choice([("user", "assistant"), ("system", "user", "assistant"), ("", "user", "tool", "User", "assistant")])
        for turn in range(rng.randint(1, longest)):
            role = roles[turn % len(roles)] if rng.random() < 0.8 else rng.choice(["user", "assistant", "system", "tool"])
            rows.append((conv, turn, role, rng.choice(["Fine.", "Yes!", "cut off", "", " \t", f"Turn {turn}?", "same. \n"])))
    return rows


@pytest.mark.parametrize(("seed", "number", "longest", "bits"), [(1, 120, 9, 10), (2, 12, 60, 10), (3, 12, 60, 3), (4, 2, 400, 6)])
def test_repair_against_plain_search(spark, monkeypatch, seed, number, longest, bits):
    monkeypatch.setattr(conversations, "SEGMENT_BITS", bits)
    rows = random_turns(seed, number, longest)
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, pos int")
    made = conversations.repair(table.repartition(5))
    hashes = {r.conv_id: r.sha256 for r in conversations.joined_sha256(made.turns).collect()}
    summary = {r.conv_id: r.asDict() for r in made.summary.collect()}
    for conv in range(number):
        want = slow_repair([(r[2], r[3]) for r in rows if r[0] == conv])
        assert {k: summary[conv][k] for k in want if k != "lines"} == {k: v for k, v in want.items() if k != "lines"}
        assert hashes.get(conv, sha("")) == sha("\n".join(want["lines"]))


def test_alignment_from_every_phase():
    """Segments are aligned from each phase to each as a plain search over all targets does it."""
    rng = random.Random(5)
    for _ in range(300):
        n = rng.choice([1, 2, 3, 5])
        code = "".join(rng.choice("suax") + rng.choice("kktd") for _ in range(n))
        for phase, end, cost, audit in conversations.aligned(code, False, False):
            least = None
            for edits in product("DIKR", repeat=len(audit)):
                pass_cost, now, row = 0, phase, 0
                for sign in edits:
                    if sign != "I" and row == n or sign in "KR" and code[2 * row + 1] == "d":
                        break
                    is_open = now == conversations.OPEN
                    if sign == "K":
                        if code[2 * row] == "s" and now == conversations.NOTHING:
                            now = conversations.SYSTEM
                        elif code[2 * row] == ("a" if is_open else "u"):
                            now = conversations.PAIRED if is_open else conversations.OPEN
                        else:
                            break
                    elif sign in "RI":
                        now = conversations.PAIRED if is_open else conversations.OPEN
                    pass_cost += {"D": 2, "I": 5, "K": 0, "R": 1}[sign] + 5 * (sign in "KR" and code[2 * row + 1] == "t")
                    row += sign != "I"
                else:
                    if row == n and now == end and edits[-1] != "I":
                        least = min(least or (pass_cost, edits), (pass_cost, edits))
            assert least == (cost, tuple(audit))


def test_repair_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    odd = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "First."), (1, 5, "assistant", "Ok. " * 50_000),
                                 (1, 5, "assistant", "Ok. " * 50_000), (2, 0, "", "x"), (3, 2, "user", None), (3, 9, "", "")], schema)
    made = conversations.repair(odd)
    got = {r.conv_id: tuple(r)[1:] for r in made.summary.collect()}
    assert got == {None: (0, 1, 0, 0, 1, 4, "DD"), 1: (0, 0, 1, 0, 1, 2, "KKD"), 2: (0, 0, 0, 1, 0, 2, "D"), 3: (6, 2, 0, 0, 1, 4, "DD")}
    turns = made.turns.where("conv_id = 1").orderBy("pos", "step").collect()
    assert [(t.edit, t.role, len(t.text)) for t in turns] == [("K", "user", 6), ("K", "assistant", 200_000), ("D", "assistant", 200_000)]
    empty = conversations.repair(spark.createDataFrame([], schema))
    assert empty.summary.count() == empty.turns.count() == conversations.joined_sha256(empty.turns).count() == 0


def test_repair_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = {r.conv_id: r.asDict() for r in queries.op12_grammar_alignment(spark, SF).collect()}
    assert set(got) == {r.conv_id for r in rows}
    for conv, found in got.items():
        kept = []
        for r in sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.turn):
            kind = zlib.crc32(f"{conv}:{r.turn}".encode()) % 20
            text = "" if kind == 1 else r.text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else r.text
            kept += [("user" if kind == 4 else r.role, text)] * {0: 0, 3: 2}.get(kind, 1)
        want = slow_repair(kept)
        assert {k: found[k] for k in want if k != "lines"} == {k: v for k, v in want.items() if k != "lines"}
        assert found["repaired_sha256"] == sha("\n".join(want["lines"]))


# Vector search


def slow_neighbours(rows, query, k):
    own, vector = query
    scored = [(-sum(float(a) * float(b) for a, b in zip(vector, v, strict=True)), i) for i, v in rows if i != own]
    return [i for _, i in sorted(scored)[:k]]


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], f"vec_id long, embedding array<{kind}>, rank int, score string")


def test_search_query_reaches_its_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in table.collect()]
    ids, flat = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in queries.op13_kmeans_tree(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = total = 0
    for i, vector in rows:
        if i % 20 == 0:
            scores = flat @ vector
            order = ids[np.lexsort((ids, -scores))]
            want = [j for j in order.tolist() if j != i][:20]
            assert sorted(got[i]) == list(range(1, 21))
            assert [got[i][k][1] for k in range(1, 21)] == sorted((got[i][k][1] for k in range(1, 21)), reverse=True)
            assert all(abs(score - scores[ids == j][0]) < 1e-9 for j, score in got[i].values())
            hits += len({j for j, _ in got[i].values()} & set(want))
            total += 20
    assert hits / total >= 0.9


def test_search_is_exact_when_all_leaves_are_seen(spark, monkeypatch):
    """Vectors of any length, copies, ties and blocks smaller than a leaf's vectors and queries."""
    for name, value in (("LEAF", 20), ("VECTORS", 16), ("QUERIES", 4)):
        monkeypatch.setattr(vector_search, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 4) * (1 + i % 5)).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]
    rows = [(i, [float(x) for x in v]) for i, v in rows if any(v)]
    got = {}
    for r in vector_search.neighbours(vectors(spark, rows, "double"), F.col("vec_id") % 20 == 0, k=7, target=2.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for query in rows:
        if query[0] % 20 == 0:
            assert [j for _, j in sorted(got[query[0]])] == slow_neighbours(rows, query, 7)


def test_search_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0]),
            (7, []), (None, [9.0, 9.0]), (8, [0.5, -3.0]), (20, [float("inf"), 1.0])]
    got = vector_search.neighbours(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 0.5), (0, 2, 8, 0.5)]
    for none in ([], [(0, None)], [(1, [1.0])], [(0, [1.0])]):
        assert vector_search.neighbours(vectors(spark, none), F.col("vec_id") % 20 == 0).count() == 0
