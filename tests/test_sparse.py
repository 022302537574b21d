"""Sparse nearest neighbours against all products."""

import math
import random
from collections import defaultdict

import pytest

from recordloom.operators import sparse

SCHEMA = "{} string, feature string, weight double"


def brute(queries, corpus, k):
    def unit(rows):
        vectors = defaultdict(lambda: defaultdict(float))
        for name, f, w in rows:
            if w > 0:
                vectors[name][f] += w
        return {n: {f: w / math.sqrt(sum(x * x for x in v.values())) for f, w in v.items()} for n, v in vectors.items()}

    q, c, out = unit(queries), unit(corpus), {}
    for name, v in q.items():
        scores = {i: round(min(1.0, sum(w * o[f] for f, w in v.items() if f in o)), 9) for i, o in c.items() if any(f in o for f in v)}
        out[name] = sorted((-s, i) for i, s in scores.items())[:k]
    return {n: v for n, v in out.items() if v}


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((-round(r["score"], 9), r["id"]))
    return dict(out)


@pytest.mark.parametrize("k", [1, 3, 200])
def test_sparse_top_k_equals_all_products(spark, k):
    rng = random.Random(9)
    # Common features, rare ones, weights over several levels, and one in all vectors.
    features = [f"f{i}" for i in range(40)]

    def vectors(count, prefix):
        rows = []
        for i in range(count):
            rows.append((f"{prefix}{i:03}", "all", rng.choice([0.01, 0.5, 3.0])))
            rows += [(f"{prefix}{i:03}", f, rng.choice([0.1, 1.0, 7.0, 0.003])) for f in rng.sample(features, rng.randint(0, 6))]
        return rows

    queries = vectors(25, "q") + [("alone", "nowhere", 1.0), ("zero", "f1", 0.0), ("q001", "f1", 1.0), ("q001", "f1", 1.0)]
    corpus = vectors(120, "c") + [("c000", "f2", 0.0), ("copy1", "f3", 2.0), ("copy2", "f3", 2.0)]
    q, c = spark.createDataFrame(queries, SCHEMA.format("query_id")), spark.createDataFrame(corpus, SCHEMA.format("id"))
    got, want = answers(sparse.sparse_top_k(q, c, k)), brute(queries, corpus, k)
    assert got.keys() == want.keys()
    for name in want:
        assert [s for s, _ in got[name]] == pytest.approx([s for s, _ in want[name]], abs=1e-8)
        assert {i for s, i in got[name] if s < got[name][-1][0] - 1e-8} == {i for s, i in want[name] if s < want[name][-1][0] - 1e-8}


def test_sparse_top_k_of_nothing(spark):
    q = spark.createDataFrame([("q", "f", 1.0)], SCHEMA.format("query_id"))
    c = spark.createDataFrame([("c", "g", 1.0)], SCHEMA.format("id"))
    assert sparse.sparse_top_k(q, c, 3).count() == sparse.sparse_top_k(q, c.limit(0), 3).count() == sparse.sparse_top_k(q.limit(0), c, 3).count() == 0


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    rows = [(i, f"f{j}", float(j + 1)) for i in range(60) for j in (i % 3, 5)]
    corpus = spark.createDataFrame(rows, "id long, feature string, weight double")
    sizes, real = [], sparse._search
    monkeypatch.setattr(sparse, "_search", lambda asked, postings, k: sizes.append((asked.count(), postings.count())) or real(asked, postings, k))
    found = sparse.sparse_top_k(corpus.withColumnRenamed("id", "query_id"), corpus, 4).collect()
    assert sizes == [(6, 6)]
    assert len(found) == 60 * 4
    for r in found:
        assert r.id == r.query_id % 3 + 3 * (r["rank"] - 1) and r.score == 1.0
