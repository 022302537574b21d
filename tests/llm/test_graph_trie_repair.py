"""Graph search, prefix trie and structure repair against plain Python, on odd rows and small blocks."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import graph_search, prefix_trie, turn_repair
from recordloom.llm.turns import numbered

TURNS = "conv_id long, turn long, role string, text string"
CLASHING = "pos key bytes block name chain depth node size shard ids vector start code tail kind lead n i".split()


def with_clashes(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def digest(role, text):
    return hashlib.sha256((str(len(role.encode())) + ":" + role + text).encode()).hexdigest()[:32]


# ---- graph search


def exact(rows, k, every=20):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, vector in rows:
        if q % every == 0:
            for c, other in rows:
                if c != q and len(other) == len(vector):
                    score = float((np.array(other) * np.array(vector)).sum())
                    best = out.setdefault(q, {})
                    best[c] = max(score, best.get(c, score))
    return {q: sorted(((-s, c) for c, s in best.items()))[:k] for q, best in out.items()}


def answers(df):
    out = defaultdict(list)
    for q, rank, c, s in sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()):
        assert rank == len(out[q]) + 1
        out[q].append((-s, c))
    return dict(out)


def test_graph_search_odd_rows(spark):
    rng = np.random.RandomState(2)
    rows = [(i, rng.randn(6).tolist()) for i in range(60)]
    rows += [(100, None), (120, []), (140, [0.0] * 6), (160, [1.0, None] * 3), (180, [float("nan")] * 6), (200, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(20, rows[20][1]), (20, rng.randn(6).tolist()), (220, [1.0, 2.0]), (221, [3.0, 1.0]), (240, [1.0, 1.0, 1.0])]
    # One vector under many ids, more than are asked for: ties go to the smaller ids.
    rows += [(1000 + i, rows[3][1]) for i in range(90)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for shard_rows in (1000, 40):
        assert answers(graph_search.nearest_neighbours(df, k=20, shard_rows=shard_rows)) == exact(rows, 20)
    assert graph_search.nearest_neighbours(df.limit(0), k=20).count() == 0


@pytest.mark.parametrize("shard_rows", [10_000, 600])
def test_graph_search_recall(spark, shard_rows):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r[0], list(r[1])) for r in df.collect()]
    table, ids = np.array([v for _, v in rows], dtype=np.float64), np.array([i for i, _ in rows])
    got = answers(graph_search.nearest_neighbours(df, k=20, shard_rows=shard_rows))
    hits = 0
    for at in np.nonzero(ids % 20 == 0)[0]:
        scores = table @ table[at]
        scores[at] = -np.inf
        best = set(ids[np.argsort(-scores)[:20]])
        found = got[ids[at]]
        assert len(found) == 20
        hits += len(best & {c for _, c in found})
    assert hits >= 0.9 * 20 * len(got)


def test_graph_points_all_reachable():
    # Two far clusters and many copies nearby: every point is still reached from the start.
    rng = np.random.RandomState(4)
    points = np.concatenate([rng.randn(700, 8), rng.randn(700, 8) * 0.01 + 50]).astype(np.float32)
    graph, start = graph_search.build_graph(points, degree=8, beam=16)
    seen, front = {start}, [start]
    while front:
        front = [x for x in set(graph[front].ravel().tolist()) - seen if x >= 0]
        seen.update(front)
    assert len(seen) == len(points)


# ---- prefix trie


def trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, digest(r or "", x or ""), r or "", x or ""))
    convs = {c: [z[3:] for z in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = convs.get(c - c % 5, [])[:h] + v[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    out, leaves, saved = [], {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) if kids[n] else 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
        ends = ",".join(str(c) for c in sorted(c for c in members[n] if len(rebuilt[c]) == len(n)))
        parent = min(members[n[:-1]]) if n else None
        out.append((min(members[n]), len(n), parent, len(members[n]), len(kids[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(df, block):
    turns, convs = prefix_trie.rebuilt_turns(prefix_trie.ordered_turns(df))
    nodes = prefix_trie.prefix_trie(turns, convs, block)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in nodes.select(names).collect()), key=str)


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(40), None, -7, 10**10]:
        for t in range(rng.choice([0, 1, 3, 6, 9, 14, 33])):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["x", "yy", None, "é"])))
    rows += rows[:9]
    rows.append((3, 2, "user", "long " * 50_000))
    return rows, with_clashes(spark.createDataFrame(rows, TURNS))


@pytest.mark.parametrize("block", [2, 4, 32])
def test_trie_equals_plain_python(talks, block):
    rows, df = talks
    assert trie_of(df, block) == trie(rows)


def test_trie_of_equal_conversations_and_of_none(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(700) for t in range(7)]
    df = spark.createDataFrame(rows, TURNS)
    assert trie_of(df, 4) == trie(rows)
    assert trie_of(df.limit(0), 4) == []


def test_positions_of_a_group_over_many_ranges(spark):
    """One group holds nearly all rows, equal ones too; positions have no gap whatever the ranges."""
    rows = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.col("id")).alias("g"), (F.col("id") % 7).alias("o"))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = numbered(rows, "g", ["o"]).groupBy("g").agg(F.count("*").alias("n"), F.max("pos").alias("m"), F.countDistinct("pos").alias("d"), F.max(F.col("o") * 10_000 - F.col("pos")).alias("x")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 101 and all(r["n"] == r["m"] + 1 == r["d"] for r in got)
    placed = numbered(rows, "g", ["o"]).filter("g IS NULL").orderBy("pos").select("o").collect()
    assert [r[0] for r in placed] == sorted(r[0] for r in placed)


# ---- structure repair


def damage(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out[c] += [] if kind == 0 else [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def repaired(rows):
    """Every cheapest audit per state is kept, so that ties are broken on whole audits."""
    result, ahead, names = [], {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}

    def cheapest(states):
        return {s: {k: v for k, v in d.items() if k[0] == min(x[0] for x in d)} for s, d in states.items()}

    def inserted(states):
        todo = [(s, k, v) for s, d in states.items() for k, v in d.items()]
        while todo:
            s, (cost, audit), pieces = todo.pop()
            to, key = ahead[s], (cost + 5, audit + "I")
            if key[0] <= min((x[0] for x in states.get(to, {})), default=10**9) and key not in states.get(to, {}):
                states.setdefault(to, {})[key] = pieces + (names[to] + ":",)
                todo.append((to, key, states[to][key]))
        return cheapest(states)

    for c, v in damage(rows).items():
        v = sorted(v, key=lambda z: (z[0] is not None, z[0] or 0, digest(z[1], z[2])))
        turns, seen, faults = [z[0] for z in v if z[0] is not None], set(), []
        for _, r, x in v:
            s = x.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not s else "d" if (r, x) in seen else "t" if s[-1] not in ".!?" else "")
            seen.add((r, x))
        initials = [r[:1] for _, r, _ in v]
        states = inserted({0: {(0, ""): ()}})
        for (_, r, x), fault, initial in zip(v, faults, initials):
            new = defaultdict(dict)
            for s, d in states.items():
                for (cost, audit), pieces in d.items():
                    new[s][cost + 2, audit + "D"] = pieces
                    if fault in ("b", "d"):
                        continue
                    cost += 5 * (fault == "t")
                    new[ahead[s]][cost + 1, audit + "R"] = pieces + (f"{names[ahead[s]]}:{x}",)
                    to = 1 if initial == "s" and s == 0 else ahead[s] if initial == {2: "u", 3: "a"}[ahead[s]] else None
                    if to is not None:
                        new[to][cost, audit + "K"] = pieces + (f"{r}:{x}",)
            states = inserted(cheapest(new))
        (cost, audit), pieces = min((k, p) for s in (0, 3) for k, p in states.get(s, {}).items())
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        result.append((c, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(pieces).encode()).hexdigest()))
    return sorted(result, key=str)


def repair_of(df, block):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = turn_repair.repair(turn_repair.damaged(df), df.select("conv_id"), block)
    return sorted((tuple(r) for r in found.select(names).collect()), key=str)


@pytest.fixture(scope="module")
def broken(spark):
    rng = random.Random(8)
    texts = ["x.", "yy? ", "a", "b!", None, "é.\n", " \t", "long " * 20_000 + "."]
    rows = []
    for c in [*range(90), None, -7, 10**10]:
        for t in range(rng.choice([1, 1, 2, 3, 6, 9, 12])):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            rows.append((c, t if rng.random() < 0.95 else None, role, rng.choice(texts + [f"t{rng.randrange(99)}."] * 8)))
    rows += rows[:12]
    return rows, with_clashes(spark.createDataFrame(rows, TURNS))


@pytest.mark.parametrize("block", [2, 3, 512])
def test_repair_equals_plain_python(broken, block):
    rows, df = broken
    assert repair_of(df, block) == repaired(rows)


def test_repair_of_a_long_conversation_in_blocks(spark):
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"turn {t}" + rng.choice([".", ".", ""])) for t in range(1500)]
    df = spark.createDataFrame(rows, TURNS)
    whole = repair_of(df, 4096)
    assert repair_of(df, 64) == whole and len(whole[0][7]) >= 1400
    assert repair_of(df.limit(0), 64) == []
