import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions.similarity import lcs_length, ratio, within
from recordloom.operators import fuzzy, normalize
from recordloom.operators.components import connected_components


def naive_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", max_size=40), st.text("abcé", max_size=90))
def test_lcs(a, b):
    assert lcs_length(a, b) == lcs_length(b, a) == naive_lcs(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=14), st.text("ab", max_size=14), st.sampled_from([0.6, 0.7, 0.8, 0.85, 0.9]))
def test_variants_find_exactly_the_neighbours(a, b, t):
    total = len(a) + len(b)
    near = total == 0 or within(total - 2 * lcs_length(a, b), total, t)
    lengths = sorted({len(a), len(b)})
    va = fuzzy._variants(a, fuzzy.useful_variant_lengths(len(a), lengths, t))
    vb = fuzzy._variants(b, fuzzy.useful_variant_lengths(len(b), lengths, t))
    shared = any(total == 0 or within(total - 2 * len(v), total, t) for v in va & vb)
    assert shared == near


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=30), st.data(), st.sampled_from([0.6, 0.7, 0.8, 0.85, 0.9]))
def test_token_bounds_lose_no_neighbour(a, data, t):
    b = list(a)
    for _ in range(data.draw(st.integers(0, 6))):
        at = data.draw(st.integers(0, len(b)))
        if data.draw(st.booleans()):
            b.insert(at, data.draw(st.sampled_from("abc")))
        elif b:
            del b[at % len(b)]
    b = "".join(b)
    total = len(a) + len(b)
    if not b or not within(total - 2 * lcs_length(a, b), total, t):
        return
    start = fuzzy.bigrams_from(t)
    for q in (1, 2):
        if q == 1 or min(len(a), len(b)) >= start:
            grams = [Counter(s[i : i + q] for i in range(len(s) - q + 1)) for s in (a, b)]
            shared = sum((grams[0] & grams[1]).values())
            assert shared >= max(1, fuzzy._min_shared(len(a), t, q))
            assert shared >= max(1, fuzzy._min_shared(len(b), t, q))


def token_sorted(v):
    return " ".join(sorted(v.split()))


def brute_pairs(values, t):
    out = {}
    values = sorted(set(values))
    for i, x in enumerate(values):
        for y in values[i + 1 :]:
            a, b = token_sorted(x), token_sorted(y)
            total = len(a) + len(b)
            d = total - 2 * naive_lcs(a, b)
            if within(d, total, t):
                out[x, y] = round(ratio(d, total), 9)
    return out


def brute_dbscan(values, t, min_samples):
    """Grow clusters in value order, as the density clustering of a distance matrix does."""
    values = sorted(set(values))
    near = defaultdict(set)
    for x, y in brute_pairs(values, t):
        near[x].add(y)
        near[y].add(x)
    core = {v for v in values if len(near[v]) + 1 >= min_samples}
    labels = {}
    for v in values:
        if v in core and v not in labels:
            labels[v] = v
            stack = [v]
            while stack:
                u = stack.pop()
                if u in core:
                    for w in near[u]:
                        if w not in labels:
                            labels[w] = v
                            stack.append(w)
    groups = defaultdict(set)
    for v, c in labels.items():
        groups[c].add(v)
    return {frozenset(g) for g in groups.values() if len(g) >= min_samples}


def variants_of(seed, words, copies, edits):
    rng = random.Random(seed)
    out = []
    for _ in range(words):
        base = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 4)))
        for _ in range(copies):
            chars = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(chars) + 1)
                if rng.random() < 0.5 or not chars:
                    chars.insert(at, rng.choice("abcdefg "))
                else:
                    del chars[at % len(chars)]
            parts = "".join(chars).split()
            rng.shuffle(parts)
            if parts:
                out.append(" ".join(parts))
    return sorted(set(out))


@pytest.mark.parametrize("seed, t", [(2, 0.7), (3, 0.8), (4, 0.6)])
def test_pairs_equal_brute_force(pairs, seed, t):
    values = variants_of(seed, 25, 6, 4)
    expected = brute_pairs(values, t)
    table = pairs(values)
    found = {(r.value_a, r.value_b): round(r.similarity, 9) for r in fuzzy.similar_pairs(table, t).collect()}
    assert found == expected


def test_pairs_do_not_depend_on_block_size(pairs):
    table = fuzzy.forms(pairs(variants_of(5, 10, 10, 3)))
    whole = set(map(tuple, fuzzy.similar_forms(table, 0.8).collect()))
    assert whole == set(map(tuple, fuzzy.similar_forms(table, 0.8, block_rows=3).collect()))


@pytest.mark.parametrize("budget, block_rows", [(600, 512), (0, 4), (40, 7)])
def test_spanning_edges_keep_components(pairs, budget, block_rows):
    values = variants_of(6, 30, 6, 3)
    table = fuzzy.forms(pairs(values))
    edges = fuzzy.spanning_edges(table, 0.8, budget, block_rows)
    allowed = {(r.a, r.b) for r in fuzzy.similar_forms(table, 0.8).collect()}
    assert {(r.a, r.b) for r in edges.collect()} <= allowed
    parts = defaultdict(set)
    for r in connected_components(edges, "key_name", "a", "b").collect():
        parts[r.component].add(r.node)
    forms = {token_sorted(v) for v in values}
    assert {frozenset(p) for p in parts.values()} == {g for g in brute_dbscan(forms, 0.8, 2)}


@pytest.mark.parametrize("min_size", [2, 3])
def test_clusters_equal_brute_force(pairs, min_size):
    values = variants_of(7, 25, 7, 4)
    found = defaultdict(set)
    for r in normalize.text_clusters(pairs(values), 0.8, min_size).collect():
        found[r.cluster].add(r.value)
    assert {frozenset(g) for g in found.values()} == brute_dbscan(values, 0.8, min_size)


def test_chain_and_border(pairs):
    # a-b and b-c are neighbours, a-c is not; b is the only core at three samples.
    values = ["abcdefghij", "abcdefghijkl", "cdefghijkl"]
    assert set(brute_pairs(values, 0.9)) == {(values[0], values[1]), (values[1], values[2])}
    got = {r.value for r in normalize.text_clusters(pairs(values), 0.9, 3).collect()}
    assert got == set(values)


def test_swapped_words_are_one_form(pairs):
    got = normalize.text_clusters(pairs(["north gate", "gate north", "other"]), 0.95).collect()
    assert {r.value for r in got} == {"north gate", "gate north"}


def test_many_near_identical_codes(pairs):
    """One key of near-identical codes: edges stay linear and the cluster is whole."""
    values = [f"Customer#{i:09d}" for i in range(3000)]
    table = fuzzy.forms(pairs(values))
    assert fuzzy.spanning_edges(table, 0.85).count() < 200 * len(values)
    assert normalize.text_clusters(pairs(values), 0.85).groupBy("cluster").count().collect()[0]["count"] == 3000


def reference_gaps(numbers, min_size):
    order = sorted(numbers)
    if len(order) < 2:
        return [order]
    gaps = np.diff(order)
    limit = gaps.mean() + 2 * gaps.std()
    groups = [[order[0]]]
    for x, g in zip(order[1:], gaps):
        if g > limit:
            groups.append([])
        groups[-1].append(x)
    return [g for g in groups if len(g) >= min_size]


@pytest.mark.parametrize("rows_per_range", [500_000, 7])
def test_gap_clusters_equal_reference(pairs, monkeypatch, rows_per_range):
    from recordloom.operators import ordering

    original = ordering.with_ranges
    monkeypatch.setattr(normalize, "with_ranges", lambda df, g, n: original(df, g, n, rows_per_range))
    rng = random.Random(3)
    numbers = [rng.randint(0, 30) + 1000 * rng.randint(0, 3) + rng.choice([0, 0, 5000]) for _ in range(80)]
    distinct = sorted(set(numbers))
    found = defaultdict(list)
    for r in normalize.gap_clusters(pairs([str(n) for n in distinct])).collect():
        found[r.cluster].append(float(r.value))
    assert sorted(sorted(g) for g in found.values()) == reference_gaps(distinct, 2)


def test_equal_numbers_count_as_zero_gaps(pairs):
    values = ["1,000", "1000", "1001", "1002", "5000", "5001"]
    found = defaultdict(set)
    for r in normalize.gap_clusters(pairs(values)).collect():
        found[r.cluster].add(r.value)
    numbers = [1000, 1000, 1001, 1002, 5000, 5001]
    sizes = sorted(len(g) for g in found.values())
    assert sizes == sorted(len(g) for g in reference_gaps(numbers, 2))


def test_numeric_keys(spark):
    rows = [("a", "1,000"), ("a", " 5 "), ("b", "1"), ("b", "5d"), ("c", "1"), ("c", "nan"), ("d", "1_0")]
    got = normalize.numeric_keys(spark.createDataFrame(rows, "key_name string, value string")).collect()
    assert {r.key_name: r.is_numeric for r in got} == {"a": True, "b": False, "c": False, "d": True}


def test_representative_rules(spark):
    kv = spark.createDataFrame(
        [("k", "blue bolt")] * 2 + [("k", "blue bolts")] * 2 + [("k", "blue-bolt")] * 1, "key_name string, value string"
    )
    links = normalize.normalize_all(kv, 0.8)
    assert {r.normalized_value for r in links.collect()} == {"blue bolts"}
    assert {r.norm_id for r in links.collect()} == {"k:normalized:blue bolts"}
    counts = normalize.normalized_values(links).first()
    assert counts.member_count == 3
    given = spark.createDataFrame([("k", "blue bolt", "BOLT")], "key_name string, cluster string, normalized_value string")
    assert {r.normalized_value for r in normalize.normalize_all(kv, 0.8, overrides=given).collect()} == {"BOLT"}


def test_done_values_are_left_alone(spark):
    kv = spark.createDataFrame([("k", "aaaa"), ("k", "aaab"), ("k", "aaac")], "key_name string, value string")
    done = spark.createDataFrame([("k", "aaaa")], "key_name string, value string")
    assert {r.value for r in normalize.normalize_all(kv, 0.7, done=done).collect()} == {"aaab", "aaac"}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [("g", f"{i:04d}", f"{i + 1:04d}") for i in range(300) if i % 50]
    edges += [("h", "0000", f"{i:04d}") for i in range(1, 200)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "g string, a string, b string")
    got = {(r.g, r.node): r.component for r in connected_components(df, "g", "a", "b").collect()}
    assert got["g", "0050"] == "0001" and got["g", "0051"] == "0051"
    assert all(c == "0000" for (g, _), c in got.items() if g == "h")
    assert len({c for (g, _), c in got.items() if g == "g"}) == 6
    again = connected_components(df.repartition(3).orderBy(F.rand(1)), "g", "a", "b").collect()
    assert {(r.g, r.node): r.component for r in again} == got


def test_signatures_are_not_broadcast(spark):
    """Grams and blocks outgrow their source, so their joins are told to sort."""
    table = spark.range(9).selectExpr("'k' as key_name", "cast(id as string) as form", "cast(1 as int) as n", "'s' as sig")
    for joined in (fuzzy._prefixes(table, 0.85), fuzzy._block_pairs(table, 512)):
        assert "strategy=merge" in joined._jdf.queryExecution().analyzed().toString()
