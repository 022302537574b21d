import pytest
from pyspark.sql import functions as F

from recordloom.operators import relate, search
from recordloom.plans import workflow

HIT = (
    "src_doc string, cand_doc string, key_name string, feature_class string, value_pos int, hit_rank int, source_value string,"
    " cand_value string, dataset string, typed_score double, key_alignment double, matched_keys array<string>"
)


def test_accumulation_rules(spark):
    hits = spark.createDataFrame(
        [
            ("a", "b", "k", "identity", 0, 1, "v", " v ", "t", 1.0, 0.9, ["k", "k2"]),
            ("a", "b", "k", "identity", 0, 2, "v", "w", "t", 0.4, 0.9, ["k", "k2"]),
            ("a", "b", "m", "numeric", 0, 1, "1", "2", "t", 0.2, 0.5, ["m", "k"]),
            ("a", "a", "k", "identity", 0, 1, "v", "v", "t", 1.0, 0.9, ["k"]),  # itself
            ("a", "c", "k", "identity", 0, 3, "v", "x", "t", 0.0, 0.9, ["k"]),  # score 0
        ],
        HIT,
    )
    row, = relate.accumulate(hits).collect()
    assert (row.cand_doc, round(row.aligned, 9), round(row.typed, 9)) == ("b", 2.3, 1.6)
    assert row.matched_keys == ["k", "k2", "m"]
    assert {m.key: m.value for m in row.matched_values} == {"k": "w", "m": "2"}  # last hit, not best
    assert row.exact_keys == ["k"] and row.identity_match and row.strong_match
    important = spark.createDataFrame([("a", "k"), ("a", "m"), ("a", "none"), ("a", "never")], "doc_id string, key_name string")
    scored, = relate.average_scores(relate.accumulate(hits), important).collect()
    assert (round(scored.aligned_attribute, 9), round(scored.typed_value_match, 9)) == (0.575, 0.4)


@pytest.mark.parametrize(
    "strong, identity, score, expected",
    [(True, True, 0.9, "SAME_AS"), (True, False, 0.9, "SAME_AS"), (True, True, 0.89, "REFERENCES"), (True, False, 0.5, "RELATED_TO"), (False, False, 1.0, "RELATED_TO")],
)
def test_relation_types(spark, strong, identity, score, expected):
    df = spark.createDataFrame([(strong, identity, score)], "strong_match boolean, identity_match boolean, score double")
    assert relate.relation_type(df).first().relation_type == expected


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("shop", "shop.json", i, {"name": n, "region": r, "beds": b}) for i, (n, r, b) in enumerate(
        [("north clinic", "seoul", "100"), ("north clinic", "seoul", "120"), ("south clinic", "busan", "900"), ("river spa", "seoul", "110")])]
    rows += [("visit", "visit.json", 0, {"name": "north clinic", "region": "seoul", "beds": "100"}), ("far", "far.json", 0, {"name": "north clinic", "region": "seoul", "beds": "100"})]
    records = spark.createDataFrame(rows, "dataset string, source_file string, record_index bigint, raw map<string,string>")
    return workflow.build_graph(records, "test").materialize(), workflow.document_vectors(records)


def _important(spark, doc):
    return spark.createDataFrame(
        [(doc, "name", "identity", 0.9, ""), (doc, "region", "location", 0.9, ""), (doc, "beds", "numeric", 0.8, "")],
        "doc_id string, key_name string, feature_class string, importance double, reason string",
    )


def test_discovery(spark, graph):
    tables, vectors = graph
    sources = spark.createDataFrame([("shop_0000",), ("unknown_0000",)], "doc_id string")
    links = spark.createDataFrame([("visit", "shop")], "table_a string, table_b string")
    found = workflow.discover_relations(tables, sources, links, vectors, _important(spark, "shop_0000")).orderBy("rank").collect()
    docs = [r.doc_id for r in found]
    assert "shop_0000" not in docs and "far_0000" not in docs  # itself, and an unconnected dataset
    best = found[0]
    assert best.doc_id == "visit_0000" and best.relation_type == "REFERENCES" and best.score == 0.8
    assert best.breakdown.aligned_attribute == 1.0 and best.matched_values["beds"] == "100"
    assert {r.doc_id: r.relation_type for r in found}["shop_0003"] == "RELATED_TO"
    free = workflow.discover_relations(tables, sources, None, vectors, _important(spark, "shop_0000"), gated=False)
    assert "far_0000" in {r.doc_id for r in free.collect()}
    alone = workflow.discover_relations(tables, sources, None, vectors, _important(spark, "shop_0000"))
    assert {r.table_name for r in alone.collect()} == {"shop"}


def test_gating(spark):
    links = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "a"), ("b", "d")], "table_a string, table_b string")
    docs = spark.createDataFrame([("a",), ("x",)], "dataset string")
    got = {(r.dataset, r.other) for r in relate.allowed_datasets(docs, links).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("x", "x")}


@pytest.mark.parametrize(
    "tests, expected",
    [
        ([("region", "=", "seoul")], {"shop_0000", "shop_0001", "shop_0003", "visit_0000", "far_0000"}),
        ([("beds", ">", "110")], {"shop_0001", "shop_0002"}),
        ([("beds", ">=", "110"), ("beds", "<", "900")], {"shop_0001", "shop_0003"}),
        ([("beds", "<=", "100"), ("name", "contains", "clinic")], {"shop_0000", "visit_0000", "far_0000"}),
        ([("region", "in", '["busan", "daegu"]')], {"shop_0002"}),
        ([("region", "=", "seoul"), ("region", "=", "busan")], set()),
        ([("name", ">", "q")], {"shop_0002", "shop_0003"}),
    ],
)
def test_search(spark, graph, tests, expected):
    filters = spark.createDataFrame(tests, "key_name string, operator string, value string")
    found = search.key_value_search(graph[0].values, filters, limit=None)
    assert {r.doc_id for r in found.collect()} == expected
    assert search.key_value_search(graph[0].values, filters, limit=1).count() == min(1, len(expected))


def test_search_by_normalized_value(spark, graph):
    links = spark.createDataFrame([("name", "north clinic", "CLINIC"), ("name", "south clinic", "CLINIC")], "key_name string, value string, normalized_value string")
    filters = spark.createDataFrame([("name", "=", "south clinic")], "key_name string, operator string, value string")
    assert search.key_value_search(graph[0].values, filters, links, limit=None).count() == 5
    assert search.key_value_search(graph[0].values, filters, links, use_normalized=False, limit=None).count() == 1


def test_counts(spark, graph):
    listed = spark.createDataFrame([("shop",), ("none",)], "dataset string")
    assert {r.dataset: r.documents for r in search.count_documents_by_table(graph[0].documents, listed).collect()} == {"shop": 4, "none": 0}
    counts = search.feature_counts(graph[0].values, 1).filter("dataset = 'shop'")
    assert {(r.feature, r.occurrences) for r in counts.collect()} == {("key:beds", 4), ("value:seoul", 3)}


def test_workflow(spark, graph):
    tables, _ = graph
    normalized = workflow.normalize_graph(tables, 0.8)
    links = {(r.key_name, r.value, r.normalized_value) for r in normalized.same_as.collect()}
    assert ("name", "south clinic", "north clinic") in links and ("name", "north clinic", "north clinic") in links
    reached = normalized.has_normalized_value.filter(F.col("norm_id") == "name:normalized:north clinic")
    assert {r.doc_id for r in reached.collect()} == {"shop_0000", "shop_0001", "shop_0002", "visit_0000", "far_0000"}
    summary = {r.dataset: (r.total_records, r.total_keys, r.total_values) for r in tables.summary.collect()}
    assert summary["shop"] == (4, 12, 12)


def test_hits_are_dealt_once(spark):
    """Line items and the counts per order are shuffled, and nothing after them."""
    from checks.relations import candidate_rows

    plan = candidate_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FileScan parquet") == 2


def test_discovery_asks_for_every_fiftieth_customer(spark):
    from checks.relations import QUERIES

    found = QUERIES["discover_relations"](spark, "/root/testdata/sf0.001").select("src_doc", "rank").collect()
    asked = {int(r.src_doc.rsplit("_", 1)[1]) for r in found}
    assert asked == set(range(0, 150, 50))
    assert len(found) == 10 * len(asked)
