"""Streaming ingest driven over the given tables, with SQL on what it must leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import scratch
from recordloom.operators.extract import extract
from recordloom.operators.graph import value_id
from recordloom.streaming import ingest

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # A pattern, because a stream takes a plain path for a folder.
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def run(writer) -> None:
    """Work through what is there, then stop."""
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


def _event_kv(spark: SparkSession, sf: str) -> DataFrame:
    events = stream(spark, sf, "events")
    rows = ingest.records_from_stream(events, "events", "event_id", ["event_id", "event_type", "user_id", "value"])
    return extract(rows)


_KV_SQL = (
    "kv AS (SELECT printf('events_%04d', event_id) AS doc_id, f AS key_name, CASE f WHEN 'event_id' THEN CAST(event_id AS VARCHAR) WHEN 'event_type' THEN event_type"
    " WHEN 'user_id' THEN CAST(user_id AS VARCHAR) ELSE CAST(CAST(\"value\" AS DECIMAL(18,2)) AS VARCHAR) END AS v FROM events, (SELECT unnest(['event_id', 'event_type', 'user_id', 'value']) AS f))"
)


@query("stream_kv", f"WITH {_KV_SQL} SELECT doc_id, key_name, v AS \"value\" FROM kv WHERE v IS NOT NULL")
def stream_kv(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark)
    events = stream(spark, sf, "events")
    rows = ingest.records_from_stream(events, "events", "event_id", ["event_id", "event_type", "user_id", "value"])
    run(ingest.stream_kv(rows, f"{out}/kv", f"{out}/state"))
    return spark.read.parquet(f"{out}/kv").select("doc_id", "key_name", "value")


@query("stream_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def stream_json(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark)
    events = stream(spark, sf, "events").withColumn("file", F.lit("events.jsonl"))
    rows = ingest.records_from_json_stream(events, None, "props", "event_id", "file")
    run(ingest.stream_kv(rows, f"{out}/kv", f"{out}/state"))
    kv = spark.read.parquet(f"{out}/kv")
    return kv.select(F.col("record_index").alias("event_id"), F.col("value").alias("k"))


@query("stream_dedup", "SELECT DISTINCT 'events_' || user_id || '_' || event_type AS value_id FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark)
    events = stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        value_id(F.lit("events"), F.col("user_id").cast("string"), "event_type").alias("value_id"),
    )
    unique = ingest.stream_dedup(events, "ts", "60 days")
    run(unique.writeStream.format("parquet").option("path", f"{out}/ids").option("checkpointLocation", f"{out}/state"))
    return spark.read.parquet(f"{out}/ids").select("value_id")


@query(
    "stream_keys",
    "SELECT * FROM (VALUES ('event_id', 'numeric_date'), ('event_type', 'semantic'), ('user_id', 'numeric_date'), ('value', 'numeric_date')) t(key_name, key_type)"
    " WHERE EXISTS (SELECT 1 FROM events)",
)
def stream_keys(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark)
    run(ingest.stream_keys(_event_kv(spark, sf), f"{out}/keys", f"{out}/state1"))
    run(ingest.stream_keys(_event_kv(spark, sf), f"{out}/keys", f"{out}/state1"))
    return spark.read.parquet(f"{out}/keys").select("key_name", "key_type")


@query("stream_values", f"WITH {_KV_SQL} SELECT key_name, count(*) AS n, count(try_cast(v AS DOUBLE)) AS numbers FROM kv WHERE v IS NOT NULL GROUP BY key_name")
def stream_values(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark)
    run(ingest.stream_keys(_event_kv(spark, sf), f"{out}/keys", f"{out}/state1"))
    run(ingest.stream_values(_event_kv(spark, sf), f"{out}/keys", f"{out}/values", f"{out}/state2"))
    return spark.read.parquet(f"{out}/values").groupBy("key_name").agg(F.count("*").alias("n"), F.count("numeric_value").alias("numbers"))


@query("stream_values_first", f"WITH {_KV_SQL} SELECT key_name, count(*) AS n, count(try_cast(v AS DOUBLE)) AS numbers FROM kv WHERE v IS NOT NULL GROUP BY key_name")
def stream_values_first(spark: SparkSession, sf: str) -> DataFrame:
    """Values that come before any key is registered are kept and typed."""
    out = scratch(spark)
    run(ingest.stream_values(_event_kv(spark, sf), f"{out}/keys", f"{out}/values", f"{out}/state"))
    return spark.read.parquet(f"{out}/values").groupBy("key_name").agg(F.count("*").alias("n"), F.count("numeric_value").alias("numbers"))


@query(
    "stream_normalize",
    # Event types are too unlike each other to form a cluster.
    f"WITH {_KV_SQL}, v AS (SELECT DISTINCT key_name, v, try_cast(v AS DOUBLE) AS x FROM kv WHERE v IS NOT NULL AND key_name <> 'event_type'),"
    " g AS (SELECT *, x - lag(x) OVER (PARTITION BY key_name ORDER BY x) AS gap FROM v),"
    " s AS (SELECT key_name, avg(gap) + 2 * stddev_pop(gap) AS lim FROM g GROUP BY key_name),"
    " c AS (SELECT g.key_name, v, sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY g.key_name ORDER BY x) AS cl FROM g JOIN s USING (key_name))"
    " SELECT key_name, v AS \"value\" FROM c QUALIFY count(*) OVER (PARTITION BY key_name, cl) >= 2",
)
def stream_normalize(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark)
    kv = _event_kv(spark, sf).select("key_name", "value")
    run(ingest.stream_normalize(kv, f"{out}/seen", f"{out}/links", f"{out}/state"))
    return spark.read.parquet(f"{out}/links").select("key_name", "value")


@query(
    "stream_relations",
    "WITH n AS (SELECT o_custkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)"
    " SELECT 'docrelation/' || o_custkey || '--' || o_orderstatus AS rel_id, o_totalprice AS score FROM n WHERE rn = 1",
)
def stream_relations(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark)
    at = F.col("o_orderdate").cast("timestamp").cast("long") * 1_000_000 + F.col("o_orderkey")
    rows = stream(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("src_doc"), F.col("o_orderstatus").alias("dst_doc"), F.lit("RELATED_TO").alias("relation_type"),
        F.col("o_totalprice").alias("score"), F.lit("rule").alias("method"), F.col("o_orderpriority").alias("reason"),
        F.timestamp_micros(at).alias("created_at"),
    )
    run(ingest.stream_relations(rows, f"{out}/relations", f"{out}/state"))
    return ingest.current_relations(spark, f"{out}/relations").select("rel_id", "score")
