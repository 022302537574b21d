"""Keeping and re-reading uploaded files as they came."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _safe(text: Column, fallback: str) -> Column:
    kept = F.regexp_replace(text, r"(?U)[^\p{L}\p{N}._-]", "")
    return F.when(kept == "", fallback).otherwise(kept)


def storage_key(table: Column, file_name: Column, at: Column) -> Column:
    """``table/YYYY/MM/DD/stamp_file`` with names reduced to letters, digits and ``._-``."""
    return F.concat(
        _safe(table, "dataset"),
        F.date_format(at, "/yyyy/MM/dd/yyyyMMdd'T'HHmmss'Z'_"),
        _safe(file_name, "upload"),
    )


def archive_raw(spark: SparkSession, path: str, out: str, dataset: str, at: Column | None = None) -> DataFrame:
    """Copy files under ``path`` into the archive, partitioned by table and day.

    Returns the rows of these files without their content.
    """
    at = F.lit(datetime.now(timezone.utc)) if at is None else at
    files = (
        spark.read.format("binaryFile")
        .load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content", at.alias("archived_at"))
        .withColumn("storage_key", storage_key(F.lit(dataset), F.col("file_name"), F.col("archived_at")))
        .withColumn("table", F.split_part("storage_key", F.lit("/"), F.lit(1)))
        .withColumn("year", F.year("archived_at"))
        .withColumn("month", F.month("archived_at"))
        .withColumn("day", F.dayofmonth("archived_at"))
    )
    files.write.mode("append").partitionBy("table", "year", "month", "day").parquet(out)
    return files.drop("content")


def load_raw(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The archived file with this key, no row if there is none; reads one day's partition."""
    stored = spark.read.parquet(out)
    parts = key.split("/")
    if len(parts) != 5:
        return stored.filter(F.lit(False))
    table, year, month, day, _ = parts
    return stored.filter(
        (F.col("table") == table)
        & (F.col("year") == int(year))
        & (F.col("month") == int(month))
        & (F.col("day") == int(day))
        & (F.col("storage_key") == key)
    )
