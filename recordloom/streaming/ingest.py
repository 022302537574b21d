"""Record-at-a-time ingest as streams.

Ids are deterministic, and every micro-batch writes its own ``batch_id`` partition or upserts
by id, so a repeated batch leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.utils import AnalysisException

from recordloom.operators.extract import extract
from recordloom.operators.graph import key_registry, relation_id, value_index
from recordloom.operators.label import classify_keys
from recordloom.operators.normalize import normalize_all
from recordloom.session import cut_lineage
from recordloom.sources.readers import as_text, dataset_name, parse_json_object
from recordloom.sources.tables import latest_by_id

def records_from_stream(rows: DataFrame, dataset: str, index: str, columns: list[str] | None = None) -> DataFrame:
    """Records from a stream of rows; ``index`` is a unique integer column of the source."""
    pairs = [item for c in columns or rows.columns for item in (F.lit(c), as_text(rows, c))]
    return rows.select(
        F.lit(dataset).alias("dataset"),
        F.lit(dataset).alias("source_file"),
        F.col(index).cast("bigint").alias("record_index"),
        F.create_map(*pairs).alias("raw"),
    )


def records_from_json_stream(rows: DataFrame, dataset: str | None, text: str, index: str, source_file: str) -> DataFrame:
    """Records from a stream of JSON texts; broken text gives an empty record."""
    return rows.select(
        dataset_name(dataset, source_file).alias("dataset"),
        F.col(source_file).alias("source_file"),
        F.col(index).cast("bigint").alias("record_index"),
        parse_json_object(text).alias("raw"),
    )


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id").parquet(path)


def _before(table: DataFrame | None, batch_id: int) -> DataFrame | None:
    """Rows of earlier batches; what a failed attempt of this batch wrote does not count."""
    return None if table is None else table.filter(F.col("batch_id") < batch_id)


def _each(stream: DataFrame, checkpoint: str, body: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(body)


def stream_kv(
    records: DataFrame, path: str, checkpoint: str, mapping: DataFrame | None = None,
    strict: bool = False, multi_keys: Iterable[str] = (),
) -> DataStreamWriter:
    """Extract key-values of each record and append them."""
    multi_keys = list(multi_keys)

    def body(batch: DataFrame, batch_id: int) -> None:
        _write_batch(extract(batch, mapping, strict, multi_keys), path, batch_id)

    return _each(records, checkpoint, body)


def stream_dedup(rows: DataFrame, event_time: str, delay: str = "1 hour", id_column: str = "value_id") -> DataFrame:
    """Drop repeats of an id; the watermark bounds the ids kept in state."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([id_column])


def stream_keys(
    kv: DataFrame, path: str, checkpoint: str, taxonomy: DataFrame | None = None, overrides: DataFrame | None = None
) -> DataStreamWriter:
    """Classify each key once, when it is first seen."""

    def body(batch: DataFrame, batch_id: int) -> None:
        known = _before(stored(batch.sparkSession, path), batch_id)
        fresh = batch if known is None else batch.join(known.select("key_name"), "key_name", "left_anti")
        _write_batch(classify_keys(key_registry(fresh), taxonomy, overrides), path, batch_id)

    return _each(kv, checkpoint, body)


def stream_values(
    kv: DataFrame, keys_path: str, path: str, checkpoint: str, taxonomy: DataFrame | None = None, overrides: DataFrame | None = None
) -> DataStreamWriter:
    """Value rows of each batch. Keys not registered yet are classified from the batch, as T3 will do, so no value is lost."""

    def body(batch: DataFrame, batch_id: int) -> None:
        known = stored(batch.sparkSession, keys_path)
        if known is None:
            keys = classify_keys(key_registry(batch), taxonomy, overrides)
        else:
            fresh = batch.join(known.select("key_name"), "key_name", "left_anti")
            columns = ["key_name", "key_id", "key_type"]
            keys = known.select(*columns).unionByName(classify_keys(key_registry(fresh), taxonomy, overrides).select(*columns))
        _write_batch(value_index(batch, keys), path, batch_id)

    return _each(kv, checkpoint, body)


def stream_normalize(
    kv: DataFrame, values_path: str, links_path: str, checkpoint: str,
    threshold: float = 0.85, min_size: int = 2, full_refresh: bool = False,
) -> DataStreamWriter:
    """T4: cluster the values that have no normalized value yet.

    Clusters depend on batch borders; ``full_refresh`` clusters everything seen so far anew and
    then equals the batch result. The distinct values seen are kept at ``values_path``.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = batch.groupBy("key_name", "value").agg(F.count("*").alias("frequency"))
        _write_batch(counts, values_path, batch_id)
        seen = spark.read.parquet(values_path).filter(F.col("batch_id") <= batch_id)
        done = None if full_refresh else _before(stored(spark, links_path), batch_id)
        links = cut_lineage(normalize_all(seen, threshold, min_size, done))
        if full_refresh:
            links.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
                "partitionOverwriteMode", "static"
            ).partitionBy("batch_id").parquet(links_path)
        else:
            _write_batch(links, links_path, batch_id)

    return _each(kv, checkpoint, body)


def stream_relations(relations: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """T5: append the relations of each batch, the newest of each document pair; ``current_relations`` reads them.

    A batch costs its own rows, however many are stored.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        named = batch.select(relation_id("src_doc", "dst_doc").alias("rel_id"), "*")
        _write_batch(latest_by_id(named, "rel_id", "created_at"), path, batch_id)

    return _each(relations, checkpoint, body)


def current_relations(spark: SparkSession, path: str) -> DataFrame:
    """T5: one relation per document pair, the newest of all batches."""
    return latest_by_id(spark.read.parquet(path), "rel_id", "created_at").drop("batch_id")


def compact_relations(spark: SparkSession, path: str, out: str) -> None:
    """Write the current relations to a new table, to be read in place of the batches up to now."""
    current_relations(spark, path).write.parquet(out)
