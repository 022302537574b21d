import json
import random
import re

import pytest

from pyspark.sql import functions as F

from recordloom.functions import file_stem, iri_encode, safe_double, strip
from recordloom.operators import extract, graph, label
from recordloom.sources import readers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_json_files(spark, tmp_path):
    rows = [{"a": "1", "b": True, "c": 1.0, "d": 1e3, "e": None, "f": {"g": [1, 2]}}, {"a": ""}]
    write(tmp_path / "in" / "many.json", json.dumps(rows))
    write(tmp_path / "in" / "one.json", '{"a": "solo", "a": "last"}')
    write(tmp_path / "in" / "broken.json", '[{"a": 1}, {')
    write(tmp_path / "in" / "empty.json", "[]")
    found = readers.read_records(spark, str(tmp_path / "in"))
    got = {(r.dataset, r.record_index): r.raw for r in found.collect()}
    assert set(got) >= {("many", 0), ("many", 1), ("one", 0)}
    assert got["many", 0]["c"] == "1.0" and got["many", 0]["b"] == "true" and got["many", 0]["e"] is None
    assert json.loads(got["many", 0]["f"]) == {"g": [1, 2]}
    assert got["one", 0] == {"a": "last"}
    assert ("empty", 0) not in got


@pytest.mark.parametrize("size", [40, 333, 1 << 20])
def test_array_files_are_read_in_ranges(spark, tmp_path, size):
    """Ranges of any size give the same records: borders fall into strings, escapes, nested values and between elements."""
    texts = ["plain", 'quote " and \\', "{[brace]}", "a,b", "tail\\\\", "", "é\u2028\u0000", '"}', "]}]"]
    rows = [{"i": i, "t": texts[i % 9] * (i % 4), "n": {"x": [1, {"y": texts[(i + 1) % 9]}], "z": []}} for i in range(60)]
    mixed = [1, *rows[:5], None, "s,}{", [{"a": 1}, 2], *rows[5:], []]
    write(tmp_path / "in" / "many.json", json.dumps(mixed))
    write(tmp_path / "in" / "spread.json", json.dumps(rows, indent=3, ensure_ascii=False) + "\n\n")
    write(tmp_path / "in" / "one.json", "  " + json.dumps(rows[8]) + "\n")
    write(tmp_path / "in" / "deeper" / "many.json", json.dumps([{"other": "file"}]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = [
            (r.source_file, r.record_index, {k: json.loads(v) if k == "n" else v for k, v in r.raw.items()})
            for folder in ("in", "in/deeper")
            for r in readers.read_records(spark, str(tmp_path / folder)).collect()
        ]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    text = lambda row: {"i": str(row["i"]), "t": row["t"], "n": row["n"]}
    want = [("many.json", i, text(r)) for i, r in enumerate(mixed) if isinstance(r, dict)] + [("spread.json", i, text(r)) for i, r in enumerate(rows)]
    want += [("one.json", 0, text(rows[8])), ("many.json", 0, {"other": "file"})]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_broken_json_is_an_empty_record(spark):
    df = spark.createDataFrame([('{"a": "1", "b": "2", "a": "3"}',), ("{oops",), (None,)], "t string")
    assert [r[0] for r in df.select(readers.parse_json_object("t")).collect()] == [{"b": "2", "a": "3"}, {}, {}]


def test_json_lines_keep_their_order(spark, tmp_path):
    path = write(tmp_path / "rows.jsonl", "\n".join(json.dumps({"n": str(i)}) for i in range(50)))
    rows = readers.read_json_lines(spark, path).collect()
    assert sorted((r.record_index, r.raw["n"]) for r in rows) == [(i, str(i)) for i in range(50)]


def test_document_ids_grow_past_four_digits(spark):
    df = spark.createDataFrame([("dir/a.b.json", 7), ("x.json", 123456)], "f string, i bigint")
    assert [r[0] for r in df.select(extract.document_id("f", "i")).collect()] == ["a.b_0007", "x_123456"]


def test_strings(spark):
    df = spark.createDataFrame([("　 a b\t\n",)], "s string")
    assert df.select(strip("s")).first()[0] == "a b"
    stems = spark.createDataFrame([("/p/q.tar.gz",), ("plain",), (".hidden",)], "f string")
    assert [r[0] for r in stems.select(file_stem("f")).collect()] == ["q.tar", "plain", ".hidden"]
    raw = spark.createDataFrame([("a b*~/\"\\é",)], "s string")
    assert raw.select(iri_encode("s")).first()[0] == "a%20b%2A~%2F%22%5C%C3%A9"
    assert raw.select(iri_encode("s", keep_slash=True)).first()[0] == "a%20b%2A~/%22%5C%C3%A9"


def test_numbers_parse_as_in_python(spark):
    texts = ["1", " 5 ", "5d", "1_0", "1__0", "_1", "nan", "-inf", "Infinity", "1e3", ".5", "5.", "", "1,0", "0x1", "1e", "+7"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(safe_double("t")).collect()]
    for text, value in zip(texts, got):
        try:
            expected = float(text)
        except ValueError:
            expected = None
        assert str(value) == str(expected), text


def test_last_of_two_fields_with_one_name_wins(spark, records):
    mapping = spark.createDataFrame([("a", "n"), ("b", "n"), ("c", "m")], "raw_field string, display_name string")
    rows = records([{"a": "1", "b": "2", "c": "3", "d": "4"}, {"a": "1", "b": " "}, {"m": "own", "c": "mapped"}])
    kv = extract.extract(rows, mapping)
    got = {(r.record_index, r.key_name): (r.field, r.value) for r in kv.collect()}
    assert got == {
        (0, "n"): ("b", "2"), (0, "m"): ("c", "3"), (0, "d"): ("d", "4"),
        (1, "n"): ("a", "1"),  # the blank one does not count
        (2, "m"): ("c", "mapped"),
    }
    strict = extract.extract(rows, mapping, strict=True)
    assert {r.key_name for r in strict.collect()} == {"n", "m"}


def test_multi_values(records):
    kv = extract.extract(records([{"t": "a, b,,c ,a", "u": "x,y"}, {"t": " , ,"}]), multi_keys=["t"])
    got = sorted((r.record_index, r.key_name, r.value_pos, r.value, r.is_repeat) for r in kv.collect())
    assert got == [
        (0, "t", 0, "a", False), (0, "t", 1, "b", False), (0, "t", 2, "c", False), (0, "t", 3, "a", True),
        (0, "u", 0, "x,y", False),
    ]
    counts = extract.build_counts(kv).first()
    assert (counts.keys_count, counts.values_count) == (2, 5)


def test_triples_follow_set_semantics(records):
    kv = extract.extract(records([{"t": "a,b,a"}]), multi_keys=["t"])
    keys = label.classify_keys(graph.key_registry(kv))
    assert keys.first().sample_values == ["a", "b", "a"]
    values = graph.value_index(kv, keys)
    triples = graph.value_triples(values)
    assert triples.count() == triples.distinct().count() == 12
    hidden = graph.graph_triples(graph.document_index(records([{"t": "a"}]), "x"), keys, values, "c", create_document=False)
    assert hidden.filter(F.col("p").endswith("documentId")).count() == 0


def test_first_record_gives_the_samples_all_values_the_type(records):
    kv = extract.extract(records([{"k": "2020-01-01"}, {"k": "text"}]))
    key = label.classify_keys(graph.key_registry(kv)).first()
    assert (key.key_type, key.sample_values) == ("semantic", ["2020-01-01"])
    assert label.classify_keys(graph.key_registry(kv), share=0.5).first().key_type == "numeric_date"


def test_phone_is_semantic(records):
    kv = extract.extract(records([{"p": "031-123-4567", "n": "123456789"}]))
    types = {r.key_name: r.key_type for r in label.classify_keys(graph.key_registry(kv)).collect()}
    assert types == {"p": "semantic", "n": "numeric_date"}


def test_registry_of_many_files_samples_one_record(spark):
    rows = [("d", f"f{i:02}.json", 0, {"a": str(i)}) for i in range(40)]
    frame = spark.createDataFrame(rows, "dataset string, source_file string, record_index bigint, raw map<string,string>")
    key = graph.key_registry(extract.extract(frame)).first()
    assert key.sample_values == ["0"] and key.value_count == key.quantity_count == 40


def test_key_type_rests_on_all_values(records):
    rows = [{"a": "1", "b": "x"}] + [{"a": f"word {i}", "b": str(i)} for i in range(30)]
    types = {r.key_name: r.key_type for r in label.classify_keys(graph.key_registry(extract.extract(records(rows)))).collect()}
    assert types == {"a": "semantic", "b": "numeric_date"}


def test_many_rules_are_automata(spark):
    """100,000 rules: the first by position whose keyword is contained, also among nested and overlapping keywords."""
    rng = random.Random(12)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(130_000)})[:100_000]
    rng.shuffle(words)
    rules = [(i, w, f"l{i % 7}") for i, w in enumerate(words)]
    values = ["".join(rng.choice("abcdeéf") for _ in range(rng.randint(0, 12))) for _ in range(150)] + ["", "zzz", "f" * 30_000 + "a"]
    taxonomy = spark.createDataFrame([("k", f"l{i}") for i in range(5)] + [("other", "l6")], "key_name string, label string")
    table = spark.createDataFrame(rules, "rule_pos int, keyword string, label string")
    rows = spark.createDataFrame([(k, v) for k in ("k", "other", "none") for v in values + values[:3]] + [("k", None)], "key_name string, value string")
    got = {(r.key_name, r.value): r.label for r in label.label_by_keyword(rows, table, taxonomy, rules_per_block=30_000, values_per_block=40).collect()}
    at = {w: i for i, w in enumerate(words)}
    want = {}
    for key, allowed in (("k", {f"l{i}" for i in range(5)}), ("other", {"l6"})):
        for v in values:
            hits = [at[v[i:j]] for i in range(max(0, len(v) - 15), len(v)) for j in range(i + 1, min(len(v), i + 9) + 1) if v[i:j] in at]
            hits = [i for i in hits if f"l{i % 7}" in allowed]
            if hits:
                want[key, v] = f"l{min(hits) % 7}"
    assert got == want


def test_values_of_keys_without_rules_are_dropped_first(spark):
    """Only the values of keys with rules are gathered, whichever way the rules are read."""
    values = spark.createDataFrame([("k", "ab"), ("k", None), ("other", "ab"), ("bare", "ab")], "key_name string, value string")
    rules = spark.createDataFrame([(0, "a", "x"), (1, "b", "y")], "rule_pos int, keyword string, label string")
    taxonomy = spark.createDataFrame([("k", "y"), ("other", "none")], "key_name string, label string")
    for most in (0, 256):
        found = label.label_by_keyword(values, rules, taxonomy, most)
        assert [tuple(r) for r in found.collect()] == [("k", "ab", "y")]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Join LeftSemi, .*rightHint=\(strategy=broadcast\)", plan)
