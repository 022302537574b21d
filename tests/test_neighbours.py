import collections
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks import ALL_QUERIES
from recordloom.functions import binarize, cosine, ngram_vector
from recordloom.functions.vectors import _hash_ngrams
from recordloom.operators import knn, label, nearest, ordering


def frame(spark, ids, vectors, name, groups=None):
    rows = [(i, v, g) for i, v, g in zip(ids, vectors, groups or ["g"] * len(ids))]
    return spark.createDataFrame(rows, f"{name} string, embedding array<double>, grp string")


def brute(queries, corpus, k):
    out = {}
    for qid, qv, qg in queries:
        scored = []
        for cid, cv, cg in corpus:
            if cv is None or qv is None or qg != cg:
                continue
            q, c = np.array(qv), np.array(cv)
            norm = np.linalg.norm(q) * np.linalg.norm(c)
            score = round(min(1.0, max(0.0, float(q @ c / norm) if norm else 0.0)), 12)
            scored.append((-score, cid))
        out[qid] = [(cid, -s) for s, cid in sorted(scored)[:k]]
    return {q: found for q, found in out.items() if found}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    points = [(centres[i % 6] + 0.1 * rng.normal(size=8)).tolist() for i in range(150)]
    points += [points[0]] * 40  # one vector many times
    points += [[0.0] * 8, [-x for x in points[1]], None]
    return points


@pytest.mark.parametrize("options", [{}, {"broadcast_queries": 0, "block_rows": 40}])
@pytest.mark.parametrize("k", [1, 60])
def test_both_ways_are_exact(spark, vectors, options, k):
    ids = [f"v{i:03d}" for i in range(len(vectors))]
    groups = ["a" if i % 3 else "b" for i in range(len(vectors))]
    corpus = frame(spark, ids, vectors, "id", groups)
    queries = frame(spark, ids, vectors, "query_id", groups)
    found = knn.knn(queries, corpus, k, groups=["grp"], **options).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.id, r.score))
    expected = brute(list(zip(ids, vectors, groups)), list(zip(ids, vectors, groups)), k)
    assert got.keys() == expected.keys()
    for q in got:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in expected[q]], abs=1e-9), q
        assert [i for i, _ in got[q]] == [i for i, _ in expected[q]], q


def test_empty_sides(spark, vectors):
    ids = [f"v{i:03d}" for i in range(len(vectors))]
    corpus = frame(spark, ids, vectors, "id")
    nothing = frame(spark, [], [], "query_id")
    assert knn.knn(nothing, corpus, 3).count() == 0
    queries = frame(spark, ids, vectors, "query_id")
    assert knn.knn(queries, corpus.limit(0), 3, broadcast_queries=0).count() == 0


def test_vector_columns(spark):
    df = spark.createDataFrame([([1.0, 0.0, -2.0], [0.0, 0.0, 0.0], [-1.0, 0.0, 2.0])], "a array<double>, z array<double>, o array<double>")
    row = df.select(cosine("a", "z").alias("z"), cosine("a", "o").alias("o"), cosine("a", "o", clamp=False).alias("r"),
                    binarize("a").alias("t"), binarize("a", "sign").alias("s")).first()
    assert (row.z, row.o, round(row.r, 9)) == (0.0, 0.0, -1.0)
    assert row.t == [1.0, 0.0, 0.0] and row.s == [1.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        binarize("a", "other")


def test_encoder(spark):
    df = spark.createDataFrame([("north gate",), ("north gates",), ("qqqq",)], "t string").select("t", ngram_vector("t").alias("v"))
    v = {r.t: np.array(r.v) for r in df.collect()}
    assert all(abs(np.linalg.norm(x) - 1) < 1e-5 for x in v.values())
    assert v["north gate"] @ v["north gates"] > 0.7 > v["north gate"] @ v["qqqq"]
    with pytest.raises(PySparkException):
        spark.createDataFrame([(" ",)], "t string").select(ngram_vector("t")).collect()


def test_blank_documents_do_not_end_the_embedding(spark, tmp_path):
    rows = [(1, "north gate"), (2, None), (3, ""), (4, " \t\n\u3000"), (5, "x"), (5, "x"), (None, "y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r["size"], r.norm) for r in ALL_QUERIES["embed"](spark, str(tmp_path)).collect()}
    assert got == {1: (64, 1.0), 2: (0, None), 3: (0, None), 4: (0, None), 5: (128, 1.4142), None: (64, 1.0)}
    assert ALL_QUERIES["embed_distinct"](spark, str(tmp_path)).first().texts == 3


def test_radius_edges_in_blocks(spark):
    rng = np.random.default_rng(2)
    points = [(f"p{i:02d}", (rng.normal(size=3) + [3 * (i % 4), 0, 3 * (i % 3)]).tolist()) for i in range(60)]
    df = spark.createDataFrame([("k", n, v) for n, v in points], "key_name string, label string, embedding array<double>")
    whole = label.cluster_labels(df, 0.3)
    monkey = knn.radius_edges(df, "key_name", "label", 0.3, block_rows=7)
    from recordloom.operators.components import connected_components

    def parts(edges):
        found = {}
        for r in connected_components(edges, "key_name", "a", "b").collect():
            found.setdefault(r.component, set()).add(r.node)
        return {frozenset(p) for p in found.values()}

    assert parts(monkey) == parts(knn.radius_edges(df, "key_name", "label", 0.3))
    assert whole.count() == 60 - sum(len(p) - 1 for p in parts(monkey))


@pytest.mark.parametrize("rows_per_range", [500_000, 9])
def test_nearest_numbers(spark, rows_per_range):
    rng = random.Random(5)
    stock = [(g, float(rng.randint(-50, 50))) for g in "ab" for _ in range(60)] + [("c", 1.0)]
    asked = [(g, float(rng.randint(-60, 60))) for g in "abcd" for _ in range(20)]
    df = lambda rows: spark.createDataFrame(rows, "g string, number double")
    got = {}
    for r in nearest.nearest_numbers(df(asked), df(stock), ["g"], 4, rows_per_range).collect():
        got.setdefault((r.g, r.number), set()).add(r.near)
    expected = {}
    for g, a in set(asked):
        near = sorted({b for h, b in stock if h == g}, key=lambda b: (abs(a - b), b))[:4]
        if near:
            expected[g, a] = set(near)
    assert got == expected


@pytest.mark.parametrize("rows_per_range", [1_000_000, 7])
def test_ranges_keep_order(spark, rows_per_range):
    rng = random.Random(6)
    rows = [("hot", float(int(rng.paretovariate(1)))) for _ in range(300)] + [("cold", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    ranged = ordering.with_ranges(df, ["g"], "x", rows_per_range).toPandas()
    assert len(ranged) == len(rows)
    for _, part in ranged.groupby("g"):
        assert (part.groupby("x")["_range"].nunique() == 1).all()
        assert part.sort_values("x")["_range"].is_monotonic_increasing
    if rows_per_range == 7:
        assert ranged["_range"].nunique() > 5


def test_thousands_of_ranges_in_one_group(spark):
    """A group that needs more ranges than one level has is cut in two levels."""
    df = spark.range(10_000).select(F.lit("hot").alias("g"), (F.col("id") * 7 % 10_000).cast("double").alias("x"))
    df = df.unionByName(spark.createDataFrame([("cold", 1.0)], "g string, x double"))
    ranged = ordering.with_ranges(df, ["g"], "x", 2).toPandas()
    hot = ranged[ranged["g"] == "hot"].sort_values("x")
    assert len(ranged) == 10_001 and hot["_range"].is_monotonic_increasing
    sizes = hot.groupby("_range").size()
    assert len(sizes) > 4_000 and sizes.max() <= 12
    offsets = ordering.range_offsets(ordering.with_ranges(df, ["g"], "x", 2), ["g"], F.count("*"), "before").toPandas()
    assert offsets["before"].max() < 10_000 and len(offsets) == len(sizes) + 1


@pytest.mark.parametrize("rows_per_range", [1_000_000, 10])
@pytest.mark.parametrize("keys", [["a"], ["s"], ["s", "a"]])
def test_global_index(spark, rows_per_range, keys):
    rng = random.Random(7)
    numbers = rng.sample(range(10_000), 200)
    rows = [(n, f"s{n % 13}" if len(keys) > 1 else f"s{n:05d}") for n in numbers]
    got = ordering.global_index(spark.createDataFrame(rows, "a bigint, s string"), keys, "i", rows_per_range).toPandas()
    assert got.sort_values(keys)["i"].tolist() == list(range(200))


def test_quantised_index_reads_few_vectors(spark):
    """Recall of at least 0.9 with full vectors of at most 5 % of the corpus per query."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    corpus = rows.select(F.col("vec_id").alias("id"), "embedding")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = knn.quantize(corpus)
    assert index.table.count() == corpus.count() and index.table.filter("length(codes) <> 32").isEmpty()
    found = {(r.query_id, r.id): r.score for r in knn.knn_approx(asked, corpus, 10, shortlist=100, index=index).collect()}
    exact = {(r.query_id, r.id): r.score for r in knn.knn(asked, corpus, 10).collect()}
    assert len(found) == len(exact) == 1000
    common = found.keys() & exact.keys()
    assert len(common) >= 900 and all(abs(found[p] - exact[p]) < 1e-9 for p in common)


def test_sparse_cosine_of_strangers_is_zero(spark):
    a = spark.createDataFrame([("x", "f", 2.0), ("x", "g", 1.0)], "id string, feature string, weight double")
    b = spark.createDataFrame([("y", "h", 1.0), ("z", "f", 4.0)], "id string, feature string, weight double")
    pairs = spark.createDataFrame([("x", "y"), ("x", "z"), ("x", "none")], "id_a string, id_b string")
    got = {r.id_b: round(r.score, 6) for r in knn.sparse_cosine(pairs, a, b).collect()}
    assert got == {"y": 0.0, "z": round(2 / 5**0.5, 6), "none": 0.0}


def test_keyword_rules_in_order(spark):
    rules = spark.createDataFrame([(0, "a", "first"), (1, "ab", "second"), (2, "b", "third")], "rule_pos int, keyword string, label string")
    taxonomy = spark.createDataFrame([("k", "second"), ("k", "third")], "key_name string, label string")
    values = spark.createDataFrame([("k", "xab"), ("k", "b"), ("k", "a"), ("m", "ab")], "key_name string, value string")
    for most in (256, 0):
        got = {r.value: r.label for r in label.label_by_keyword(values, rules, taxonomy, most).collect()}
        assert got == {"xab": "second", "b": "third"}
    labels = label.label_fallback(values, label.label_by_keyword(values, rules, taxonomy))
    assert {r.value for r in labels.filter("label = '기타'").collect()} == {"a", "ab"}
    checked = label.validate_labels(values.selectExpr("key_name", "value", "'first' as label"), taxonomy)
    assert {r.label for r in checked.collect()} == {label.OTHER}


def test_vectors_of_other_lengths_never_meet(spark):
    rows = [(f"a{i}", [float(i), 1.0]) for i in range(6)] + [(f"b{i}", [1.0, float(i), 2.0]) for i in range(6)] + [("none", None), ("void", [])]
    asked = spark.createDataFrame(rows, "query_id string, embedding array<double>")
    corpus = asked.withColumnRenamed("query_id", "id")
    plans = [knn.knn(asked, corpus, 3, broadcast_queries=n).collect() for n in (0, 100)]
    assert sorted(map(tuple, plans[0])) == sorted(map(tuple, plans[1]))
    assert len(plans[0]) == 36 and all(r.query_id[0] == r.id[0] for r in plans[0])


def test_approximate_search_is_exact_over_all_cells(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)] + [(200, [0.0] * 4)]
    asked = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    corpus = asked.withColumnRenamed("query_id", "id")
    exact = {(r.query_id, r.id) for r in knn.knn(asked, corpus, 4).collect()}
    assert {(r.query_id, r.id) for r in knn.knn_approx(asked, corpus, 4, share=1.0).collect()} == exact
    found = knn.knn_approx(asked, corpus, 4, share=0.05).groupBy("query_id").count().collect()
    assert len(found) == 201 and all(r["count"] == 4 for r in found)
    assert knn.knn_approx(asked, corpus.limit(0), 4).count() == 0


def test_query_is_sent_once_a_bin(spark, monkeypatch):
    """Without structure a query visits nearly all cells; its vector travels once for those of a block."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 8)).tolist()
    rows = spark.createDataFrame([(f"{i:03d}", v) for i, v in enumerate(vectors)], "id string, embedding array<float>")
    asked = rows.withColumnRenamed("id", "query_id")
    sent, real = [], knn._blocks_of
    monkeypatch.setattr(knn, "_blocks_of", lambda placed, probes, *rest: sent.append(probes.count()) or real(placed, probes, *rest))
    order = ["query_id", "rank"]
    want = knn.knn(asked, rows, 3).orderBy(*order).collect()
    assert knn.knn(asked, rows, 3, broadcast_queries=0).orderBy(*order).collect() == want
    assert knn.knn_approx(asked, rows, 3, share=1.0, shortlist=300).orderBy(*order).collect() == want
    assert sent == [300, 300]
    assert knn.knn(asked, rows, 3, broadcast_queries=0, block_rows=40).orderBy(*order).collect() == want
    assert sent[-1] > 300


def test_short_lists_of_a_query_meet_in_large_blocks(spark, monkeypatch):
    """A query's codes are scored part by part in one task, which returns one short list."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(900, 8)).tolist() + [[0.0] * 8] * 3
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    asked = rows.filter("id < 40").withColumnRenamed("id", "query_id")
    lists, real = [], knn._blocks_of
    monkeypatch.setattr(knn, "BLOCK_VALUES", 256 * 8)
    monkeypatch.setattr(knn, "_blocks_of", lambda *args: lists.append(real(*args)) or lists[-1])
    found = knn.knn_approx(asked, rows, 3, share=1.0, shortlist=60)
    assert lists[0].count() == 40 * 60
    exact = {(r.query_id, r.id) for r in knn.knn(asked, rows, 3).collect()}
    assert len(exact) == 120 and len(exact & {(r.query_id, r.id) for r in found.collect()}) >= 114
    some = {(r.query_id, r.id): r.score for r in knn.knn_approx(asked, rows, 3, share=0.3, shortlist=900).collect()}
    unit = [np.array(v) / max(np.linalg.norm(v), 1e-12) for v in vectors]
    assert len(some) == 120 and all(abs(max(0.0, unit[a] @ unit[b]) - s) < 1e-6 for (a, b), s in some.items())


@pytest.mark.parametrize("kind", ["apart", "ties", "opposite", "alike", "missing"])
def test_few_products_are_computed_twice(kind):
    rng = np.random.default_rng(7)
    corpus = rng.normal(size=(3_000, 16))
    if kind == "ties":
        corpus[100:900], corpus[1_500:1_600] = corpus[7], 0.0
    elif kind == "opposite":
        corpus[:] = -np.abs(corpus)
    elif kind == "alike":
        corpus = corpus[rng.integers(0, 30, 3_000)] + 1e-7 * corpus
    corpus = knn._matrix(corpus)
    queries = np.abs(corpus[:200]) if kind == "opposite" else corpus[:200].copy()
    if kind == "missing":
        corpus[5, 3] = np.nan
    for k in (1, 7, 40):
        scores = np.round(np.clip(queries @ corpus.T, 0.0, 1.0), 12)
        want = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        r, c, s = knn._best(queries, corpus, k)
        order = np.argsort(r, kind="stable")
        if kind != "missing":
            assert (c[order].reshape(200, k) == want).all() and np.allclose(s[order].reshape(200, k), np.take_along_axis(scores, want, axis=1))
        else:  # a product that is no number is never among the best
            assert 5 not in c[np.isin(r, np.arange(6, 200))] and not np.isnan(s).any()
        if kind == "apart":
            assert sum(len(x[0]) for x in knn._pairs(queries, corpus, k, True)) <= 1.5 * k * 200


def test_positions_are_stored_in_small_files(spark):
    """A few large files would make the tasks that melt and count records as large as the table."""
    df = ordering.global_index(spark.range(250_000).select((F.col("id") * 7 % 250_000).alias("x")), ["x"], "at")
    assert len(df.inputFiles()) >= 5
    assert df.filter("at <> x").count() == 0


def test_numbers_travel_once_a_block(spark):
    """Queries meet blocks of numbers: no row per position is joined, and none is ranked by a window."""
    stock = spark.range(3_000).select(F.lit("g").alias("g"), (F.col("id") * 3).cast("double").alias("number"))
    asked = spark.range(-50, 9_100).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("number"))
    found = nearest.nearest_numbers(asked, stock, ["g"], 20, rows_per_range=700)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number" not in plan and "sequence((_seen" not in plan
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r["number"]].add(r["near"])
    every = [3.0 * i for i in range(3_000)]
    for q in [-50, -1, 0, 1, 63, 95, 96, 190, 191, 192, 193, 4_444, 5_759, 5_760, 8_900, 8_996, 8_997, 9_099]:
        assert got[q] == set(sorted(every, key=lambda x: (abs(x - q), x))[:20])
    assert len(got) == 9_150 and all(len(x) == 20 for x in got.values())


def test_cut_points_of_one_group_are_sent(spark):
    """Rows of a single large group aren't shuffled by it to meet its cut points; a null group stays out."""
    df = spark.range(5_000).select(F.when(F.col("id") > 0, "hot").alias("g"), F.col("id").cast("double").alias("x"))
    ranged = ordering.with_ranges(df, ["g"], "x", 100)
    assert "strategy=broadcast" in ranged._jdf.queryExecution().analyzed().toString()
    assert ranged.count() == 4_999 and ranged.select("_range").distinct().count() >= 40


def test_vectors_of_long_texts_take_bounded_memory(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(2_000_000))
    tracemalloc.start()
    try:
        _hash_ngrams(text, 64, 3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20
    short = text[:150_000]
    grams = collections.Counter(zlib.crc32(f" {short} "[i : i + 3].encode()) for i in range(len(short)))
    want = np.zeros(64)
    for h, c in grams.items():
        want[(h >> 1) % 64] += c if h & 1 else -c
    got = spark.createDataFrame([(short,)], "t string").select(ngram_vector("t")).first()[0]
    assert np.allclose(got, want / np.linalg.norm(want), atol=1e-6)
