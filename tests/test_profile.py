import pytest
from pyspark.sql import functions as F

from recordloom.operators import profile
from recordloom.plans.schema import analyze_schema


def by_field(df):
    return {r["field"]: r for r in df.collect()}


def test_statistics_of_unlike_records(records):
    rows = [{"a": "x", "b": ""}, {"a": "y", "c": "1"}, {"a": "x"}, {}, {"a": " ", "b": None}]
    stats = by_field(profile.field_statistics(records(rows)))
    assert set(stats) == {"a", "b", "c"}
    a, b, c = stats["a"], stats["b"], stats["c"]
    assert (a.total_count, a.unique_count, a.null_count, a.null_ratio) == (5, 3, 1, 0.2)
    assert a.samples == ["x", "y", " "]  # frequency, then first seen
    assert a.value_lengths == {"min": 1, "max": 1, "avg": 1}
    assert (b.unique_count, b.null_count, b.samples) == (0, 5, [])
    assert b.value_lengths == {"min": 0, "max": 0, "avg": 0}
    assert (c.null_count, c.null_ratio) == (4, 0.8)


def test_ratio_rounds_half_to_even(records):
    rows = [{"a": None}] + [{"a": "x"}] * 15
    assert by_field(profile.field_statistics(records(rows)))["a"].null_ratio == 0.062


def test_average_length_is_floored(records):
    rows = [{"a": "xx"}, {"a": "xxx"}]
    assert by_field(profile.value_lengths(records(rows)))["a"].avg_length == 2


@pytest.mark.parametrize(
    "samples, expected",
    [
        ([], "text"),
        (["https://x.y"], "url"),
        (["a@b.c"], "email"),
        (["010-1234-5678"], "phone"),
        (["2020-01-15"], "phone"),  # ten characters of digits and dashes
        (["2020/01/15"], "date"),
        (["2020.1.5"], "date"),
        (["12345678"], "number"),
        (["123456789"], "phone"),
        (["1,234.5", "7", "8", "no"], "number"),  # three samples count
        (["1", "x"], "text"),
        (["서울시 강남구"], "address"),
        (["plain"], "text"),
    ],
)
def test_type_rules(spark, samples, expected):
    df = spark.createDataFrame([(samples,)], "samples array<string>")
    assert df.select(profile.infer_data_type("samples")).first()[0] == expected


def test_strict_dates(spark):
    df = spark.createDataFrame([(["2020-01-15"],)], "samples array<string>")
    assert df.select(profile.infer_data_type("samples", strict_dates=True)).first()[0] == "date"


def test_sample_positions(records):
    picked = profile.systematic_sample(records([{"a": str(i)} for i in range(13)]), 5)
    assert sorted(r.record_index for r in picked.collect()) == [0, 2, 4, 6, 8]
    assert profile.systematic_sample(records([{"a": "1"}] * 3), 5).count() == 3


def test_truncation(records):
    text = "a" * 250 + "b" * 251
    rows = records([{"t": text, "s": "short"}, {"t": "c" * 300}])
    long = profile.long_text_fields(records=rows, context="schema_analysis")
    assert [r.field for r in long.collect()] == ["t"]
    cut = {r.record_index: r.raw for r in profile.truncate_long_text(rows, long, "schema_analysis").collect()}
    assert cut[0]["t"] == "a" * 200 + "\n...(중략)...\n" + "b" * 100
    assert cut[0]["s"] == "short" and cut[1]["t"] == "c" * 300
    auto = profile.truncate_auto(records([{"t": "x" * 5000}, {"t": "x" * 5001}]), "key_value_extract")
    lengths = sorted(auto.select(F.length(F.col("raw")["t"])).toPandas().iloc[:, 0])
    assert lengths == [3000 + len(profile.CUT_MARKER), 5000]


def test_schema_report(records, spark):
    report = analyze_schema(records([{"user_name": "kim"}, {"user_name": "lee"}])).first()
    assert report.fields["user_name"].display_name == "user name"
    assert report.analyzed_count == 2 and report.confidence == 0.0
    with pytest.raises(ValueError):
        analyze_schema(records([]))
    given = spark.createDataFrame(
        [("d", "people", "persons", 1.7, "n")],
        "dataset string, domain string, centrality_name string, confidence double, notes string",
    )
    named = analyze_schema(records([{"a": "1"}]), given).first()
    assert (named.domain, named.centrality_name, named.confidence) == ("people", "persons", 1.0)


def test_sample_counts_over_files(spark):
    rows = [("d", f"f{i:02}.json", 0, {"a": str(i)}) for i in range(40)]
    frame = spark.createDataFrame(rows, "dataset string, source_file string, record_index bigint, raw map<string,string>")
    picked = profile.systematic_sample(frame, 5).collect()
    assert sorted(r.raw["a"] for r in picked) == ["0", "16", "24", "32", "8"]


def test_fields_of_one_name_share_statistics(spark, records):
    mapping = spark.createDataFrame([("a", "n"), ("b", "n")], "raw_field string, display_name string")
    stats = by_field(profile.field_statistics(records([{"a": "x", "b": "y"}, {"a": "x"}, {"c": "z"}]), mapping=mapping))
    assert set(stats) == {"n", "c"}
    assert (stats["n"].total_count, stats["n"].unique_count, stats["n"].null_count, stats["n"].samples) == (3, 2, 0, ["x", "y"])


def test_samples_follow_files_and_long_values(spark):
    """First seen goes by file, then record; long values are counted whole, whatever they begin with."""
    long = ["x" * 500 + end for end in "ab"]
    rows = [
        ("d", "a.json", 0, {"f": "x", "t": long[0]}), ("d", "a.json", 1, {"f": "A", "t": long[1]}), ("d", "a.json", 2, {"t": long[1]}),
        ("d", "b.json", 0, {"f": "B", "t": "short"}), ("d", "b.json", 1, {"t": None}), ("d", "b.json", 2, {"t": ""}),
    ]
    df = spark.createDataFrame(rows, "dataset string, source_file string, record_index bigint, raw map<string,string>")
    got = {r.field: r for r in profile.field_statistics(df).collect()}
    assert got["f"].samples == ["x", "A", "B"] and got["t"].samples == [long[1], long[0], "short"]
    assert got["t"].unique_count == 3 and got["t"].null_count == 2 and got["t"].value_lengths == {"min": 5, "max": 501, "avg": 377}
    mapping = spark.createDataFrame([("f", "both"), ("t", "both")], "raw_field string, display_name string")
    assert {r.field: r.samples for r in profile.top_samples(df, 2, mapping=mapping).collect()} == {"both": [long[1], long[0]]}
