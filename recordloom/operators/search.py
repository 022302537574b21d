"""Searching documents by key predicates, and counts over the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.text import safe_double

OPERATORS = ("=", ">", "<", ">=", "<=", "contains", "in")


def key_value_search(
    values: DataFrame,
    filters: DataFrame,
    links: DataFrame | None = None,
    use_normalized: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Documents that satisfy every filter ``(key_name, operator, value)``.

    The value of ``in`` is a JSON array of strings. Order comparisons are numeric where both
    sides are numbers, else by text. With ``use_normalized`` both sides are replaced by their
    normalized value where they have one. Returns (doc_id, matched_values, score).
    """
    wanted = F.when(F.col("operator") == "in", F.from_json("value", "array<string>")).otherwise(F.array("value"))
    tests = filters.select(
        F.xxhash64("key_name", "operator", "value").alias("filter_id"), "key_name", "operator", wanted.alias("wanted")
    ).distinct()
    rows = values.select("doc_id", "key_name", "value_pos", F.col("value_content").alias("value"))
    if use_normalized and links is not None:
        named = links.select("key_name", "value", "normalized_value")
        rows = rows.join(named, ["key_name", "value"], "left").withColumn(
            "value", F.coalesce("normalized_value", "value")
        ).drop("normalized_value")
        each = tests.select("filter_id", "key_name", "operator", F.explode("wanted").alias("value"))
        tests = (
            each.join(named, ["key_name", "value"], "left")
            .groupBy("filter_id", "key_name", "operator")
            .agg(F.collect_set(F.coalesce("normalized_value", "value")).alias("wanted"))
        )
    given = F.get("wanted", F.lit(0))
    a, b = safe_double("value"), safe_double(given)
    numeric = a.isNotNull() & b.isNotNull()

    def compare(numbers, texts):
        return F.when(numeric, numbers).otherwise(texts)

    holds = (
        F.when(F.col("operator") == "=", F.col("value") == given)
        .when(F.col("operator") == ">", compare(a > b, F.col("value") > given))
        .when(F.col("operator") == "<", compare(a < b, F.col("value") < given))
        .when(F.col("operator") == ">=", compare(a >= b, F.col("value") >= given))
        .when(F.col("operator") == "<=", compare(a <= b, F.col("value") <= given))
        .when(F.col("operator") == "contains", F.col("value").contains(given))
        .when(F.col("operator") == "in", F.array_contains("wanted", F.col("value")))
    )
    total = tests.agg(F.count_distinct("filter_id")).scalar()
    matched = (
        rows.join(tests, "key_name")
        .filter(holds)
        .groupBy("doc_id", "filter_id", "key_name")
        .agg(F.min_by("value", "value_pos").alias("value"))
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("met"),
            F.map_from_entries(F.array_distinct(F.collect_list(F.struct("key_name", "value")))).alias("matched_values"),
        )
        .filter(F.col("met") == total)
        .select("doc_id", "matched_values", F.lit(1.0).alias("score"))
    )
    return matched if limit is None else matched.orderBy("doc_id").limit(limit)


def feature_counts(values: DataFrame, size: int | None = 500) -> DataFrame:
    """Per dataset its ``size`` most frequent key names and values (None: all) with their counts."""

    def best(column: str, tag: str) -> DataFrame:
        counts = values.groupBy("dataset", F.col(column).alias("name")).agg(F.count("*").alias("occurrences"))
        if size is not None:
            order = Window.partitionBy("dataset").orderBy(F.desc("occurrences"), "name")
            counts = counts.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= size)
        return counts.select("dataset", F.concat(F.lit(f"{tag}:"), "name").alias("feature"), "occurrences")

    return best("key_name", "key").unionByName(best("value_content", "value"))


def count_documents_by_table(documents: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Documents per dataset; listed datasets without any count 0."""
    counts = documents.groupBy("dataset").agg(F.count("*").alias("documents"))
    if datasets is None:
        return counts
    return datasets.select("dataset").distinct().join(counts, "dataset", "left").withColumn(
        "documents", F.coalesce("documents", F.lit(0))
    )
