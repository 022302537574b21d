import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordloom.operators.extract import extract
from recordloom.operators.graph import relation_triples, upsert_relations
from recordloom.operators.normalize import normalize_all
from recordloom.sources import archive, tables
from recordloom.streaming import ingest


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def test_upsert_touches_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "value_id string, dataset string, x int")
    first = tables.write_values(df([("a", "p", 1), ("b", "p", 1), ("c", "q", 1)]), path).first()
    assert (first.success, first.failed) == (3, 0)
    before = {f.name for f in (tmp_path / "t" / "dataset=q").iterdir()}
    tables.write_values(df([("b", "p", 2), ("d", "p", 2), ("d", "p", 2)]), path)
    assert sorted((r.value_id, r.x) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("c", 1), ("d", 2)]
    assert before == {f.name for f in (tmp_path / "t" / "dataset=q").iterdir()}


def test_triple_lines(spark):
    rows = [("s", "p", 'a "b"\\\n\r\t', "literal", None), ("s", "p", "u", "uri", None), ("s", "p", "3", "literal", "int")]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string")
    assert [r.value for r in tables.triple_lines(df).collect()] == [
        '<s> <p> "a \\"b\\"\\\\\\n\\r\\t" .', "<s> <p> <u> .", '<s> <p> "3"^^<int> .',
    ]


def test_archive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my file(1).json").write_bytes(b"[1]")
    at = F.lit("2024-03-05 06:07:08").cast("timestamp")
    row = archive.archive_raw(spark, str(tmp_path / "in"), str(tmp_path / "out"), "my table!", at).first()
    assert row.storage_key == "mytable/2024/03/05/20240305T060708Z_myfile1.json"
    loaded = archive.load_raw(spark, str(tmp_path / "out"), row.storage_key).first()
    assert bytes(loaded.content) == b"[1]"
    assert archive.load_raw(spark, str(tmp_path / "out"), "mytable/2024/03/06/x").count() == 0
    assert archive.load_raw(spark, str(tmp_path / "out"), "").count() == 0


RELATION = "src_doc string, dst_doc string, relation_type string, score double, method string, reason string, created_at timestamp"


def test_newest_relation_stays(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    old = spark.createDataFrame([("a", "b/c", "RELATED_TO", 0.1, "rule", "", at(1)), ("a", "d", "RELATED_TO", 0.1, "rule", "", at(5))], RELATION)
    new = spark.createDataFrame([("a", "b/c", "SAME_AS", 0.9, "rule", "", at(2)), ("a", "d", "SAME_AS", 0.9, "rule", "", at(4))], RELATION)
    got = upsert_relations(old, new)
    assert {r.rel_id: r.relation_type for r in got.collect()} == {"docrelation/a--b/c": "SAME_AS", "docrelation/a--d": "RELATED_TO"}
    triples = relation_triples(got)
    assert triples.count() == 18 and triples.filter("s like '%docrelation/a--b/c'").count() == 9


@pytest.fixture
def source(spark, tmp_path):
    """Writes rows as one more file of a streamed folder."""
    folder = tmp_path / "source"
    folder.mkdir()

    def add(rows):
        frame = spark.createDataFrame([(i, n) for i, n in rows], "id bigint, name string")
        frame.coalesce(1).write.mode("append").parquet(str(folder))

    def read():
        stream = spark.readStream.schema("id bigint, name string").parquet(str(folder))
        return extract(ingest.records_from_stream(stream, "s", "id"))

    return add, read


def test_stream_equals_batch(spark, source, tmp_path):
    add, read = source
    names = ["north gate", "north gates", "south", "south", "river", "rivers", "north gate x"]
    rows = list(enumerate(names))
    out = str(tmp_path)
    for part in (rows[:3], rows[3:5], rows[5:]):
        add(part)
        run(ingest.stream_keys(read(), f"{out}/keys", f"{out}/c1"))
        run(ingest.stream_values(read(), f"{out}/keys", f"{out}/values", f"{out}/c2"))
        kv = read().filter("key_name = 'name'")
        run(ingest.stream_normalize(kv, f"{out}/seen", f"{out}/links", f"{out}/c3"))
        run(ingest.stream_normalize(kv, f"{out}/seen2", f"{out}/fresh", f"{out}/c4", full_refresh=True))
    keys = spark.read.parquet(f"{out}/keys")
    assert sorted(r.key_name for r in keys.collect()) == ["id", "name"]
    values = spark.read.parquet(f"{out}/values")
    assert values.select("value_id").distinct().count() == values.count() == 14
    whole = spark.createDataFrame([("name", n) for n in names], "key_name string, value string")
    expected = {(r.value, r.normalized_value) for r in normalize_all(whole).collect()}
    assert {(r.value, r.normalized_value) for r in spark.read.parquet(f"{out}/fresh").collect()} == expected
    stepwise = spark.read.parquet(f"{out}/links")
    assert stepwise.groupBy("value").count().filter("count > 1").count() == 0


def test_stream_writes_are_repeatable(spark, source, tmp_path):
    add, read = source
    add([(0, "a"), (1, "b")])
    stream = spark.readStream.schema("id bigint, name string").parquet(str(tmp_path / "source"))
    records = ingest.records_from_stream(stream, "s", "id")
    for attempt in ("c1", "c2"):  # the same first batch, processed twice
        run(ingest.stream_kv(records, str(tmp_path / "kv"), str(tmp_path / attempt)))
    assert spark.read.parquet(str(tmp_path / "kv")).count() == 4


def test_stream_dedup(spark, source, tmp_path):
    add, _ = source
    out = str(tmp_path / "ids")
    for part in ([(1, "a"), (2, "a")], [(3, "a"), (4, "b")]):
        add(part)
        stream = spark.readStream.schema("id bigint, name string").parquet(str(tmp_path / "source"))
        rows = stream.select(F.timestamp_seconds("id").alias("ts"), F.col("name").alias("value_id"))
        run(ingest.stream_dedup(rows, "ts", "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c"))
    assert sorted(r.value_id for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_stream_relations(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    folder = str(tmp_path / "rel")
    for rows in ([("a", "b", "RELATED_TO", 0.5, "rule", "", at(2))], [("a", "b", "SAME_AS", 0.9, "rule", "", at(1)), ("a", "c", "SAME_AS", 0.9, "rule", "", at(1))]):
        spark.createDataFrame(rows, RELATION).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(RELATION).parquet(folder)
        run(ingest.stream_relations(stream, str(tmp_path / "out"), str(tmp_path / "c")))
    got = {r.rel_id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"docrelation/a--b": 0.5, "docrelation/a--c": 0.9}


def test_rows_are_replaced_one_by_one(spark, tmp_path):
    """An upsert of 1 % of the ids writes about 1 % of the table; tombstones, repeats and compaction keep the rows right."""
    path = str(tmp_path / "nodes")
    size = lambda folder: sum(f.stat().st_size for f in (tmp_path / "nodes" / "changes" / folder).rglob("*.parquet"))
    want = {i: f"first {i * 7919}" for i in range(20_000)}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "id bigint, v string")
    tables.upsert_rows(frame(want), path, "id")
    some = {i: f"second {i}" for i in range(0, 20_000, 100)} | {99_999: "new"}
    tables.upsert_rows(frame(some), path, "id", gone=spark.createDataFrame([(1,), (100,), (77_777,)], "id bigint"))
    want = {k: v for k, v in (want | some).items() if k != 1}
    read = lambda: {r["id"]: r["v"] for r in tables.read_rows(spark, path, "id").collect()}
    assert read() == want and tables.read_rows(spark, path, "id").count() == len(want)
    assert size("_set=1") * 25 < size("_set=0")
    assert tables.compact_rows(spark, path, "id") == 2 and read() == want
    tables.upsert_rows(frame({5: "third", 1: "again"}), path, "id", gone=spark.createDataFrame([(7,)], "id bigint"))
    want = {k: v for k, v in (want | {5: "third", 1: "again"}).items() if k != 7}
    assert read() == want


def test_values_meet_the_small_key_table_by_broadcast(spark):
    """Streams have no adaptive plans: a join by sorting would bring all values of a key to one task."""
    from recordloom.operators.graph import value_index

    kv = spark.range(9).selectExpr("'d' as doc_id", "'s' as dataset", "'k' as key_name", "cast(id as string) as value", "0 as value_pos", "false as is_repeat")
    keys = spark.range(1).selectExpr("'k' as key_name", "'i' as key_id", "'numeric_date' as key_type")
    rows = value_index(kv, keys)
    assert "strategy=broadcast" in rows._jdf.queryExecution().analyzed().toString()
    assert sorted(r.numeric_value for r in rows.collect()) == [float(i) for i in range(9)]
