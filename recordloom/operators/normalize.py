"""Clustering the spelling variants and the numbers of every key into canonical values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.text import safe_double, strip, token_sort
from recordloom.operators.components import connected_components, dbscan
from recordloom.operators.fuzzy import forms, similar_forms, spanning_edges
from recordloom.operators.ordering import range_offsets, with_ranges
from recordloom.session import cut_lineage


def pending_values(kv: DataFrame, same_as: DataFrame | None = None) -> DataFrame:
    """Distinct values per key with their frequency, without those already normalized.

    Rows may already be counted, in a column ``frequency``.
    """
    weight = F.sum("frequency") if "frequency" in kv.columns else F.count("*")
    values = kv.groupBy("key_name", "value").agg(weight.alias("frequency"))
    if same_as is None:
        return values
    return values.join(same_as.select("key_name", "value"), ["key_name", "value"], "left_anti")


def parse_number(value: Column | str) -> Column:
    """Number of a text after removing commas; null where it is none."""
    column = F.col(value) if isinstance(value, str) else value
    return safe_double(strip(F.replace(column, F.lit(","), F.lit(""))))


def numeric_keys(values: DataFrame) -> DataFrame:
    """(key_name, value_count, is_numeric): numeric if every value parses.

    A key with non-finite numbers has no usable gaps and counts as text.
    """
    number = parse_number("value")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return values.groupBy("key_name").agg(
        F.count("*").alias("value_count"), F.bool_and(finite).alias("is_numeric")
    )


def key_plan(values: DataFrame, min_size: int = 2) -> DataFrame:
    """(key_name, method): how each key is clustered ("gap", "text"); fewer than ``min_size`` values can't form a cluster."""
    return numeric_keys(values).select(
        "key_name",
        F.when(F.col("value_count") < min_size, "skipped: few values").when(F.col("is_numeric"), "gap").otherwise("text").alias("method"),
    )


def gap_clusters(values: DataFrame, min_size: int = 2) -> DataFrame:
    """Sort the numbers of a key; a gap above mean + 2 standard deviations starts a cluster.

    Equal numbers (``1,000`` and ``1000``) are separate values with a gap of zero between
    them. Returns (key_name, value, cluster) with ``cluster`` counted from 0 before small
    clusters are dropped.
    """
    points = cut_lineage(values.select("key_name", "value", parse_number("value").alias("number")))
    distinct = points.groupBy("key_name", "number").agg(F.count("*").alias("copies"))
    ranged = cut_lineage(with_ranges(distinct, ["key_name"], "number"))
    edges = ranged.groupBy("key_name", "_range").agg(F.max("number").alias("_last"))
    by_range = Window.partitionBy("key_name").orderBy("_range")
    edges = edges.select("key_name", "_range", F.lag("_last").over(by_range).alias("_carried"))
    inside = Window.partitionBy("key_name", "_range").orderBy("number")
    gaps = ranged.join(edges, ["key_name", "_range"]).withColumn(
        "gap", F.col("number") - F.coalesce(F.lag("number").over(inside), "_carried")
    )
    gaps = cut_lineage(gaps.drop("_carried"))  # limits, offsets and clusters read it
    # The gaps between equal numbers are zeros: they count in the mean and the deviation.
    stats = gaps.groupBy("key_name").agg(
        F.sum("copies").alias("n"),
        F.sum("gap").alias("total"),
        F.stddev_pop("gap").alias("spread"),
        F.avg("gap").alias("mean_gap"),
        F.count("gap").alias("real"),
    )
    count = F.col("n") - 1
    mean = F.col("total") / count
    # Pooled with the zeros: deviations of the real gaps around the common mean, plus zeros.
    centred = F.col("real") * (F.pow("spread", F.lit(2)) + F.pow(F.col("mean_gap") - mean, F.lit(2)))
    deviation = F.sqrt((centred + (count - F.col("real")) * mean * mean) / count)
    limits = stats.select("key_name", F.when(count > 0, mean + 2 * deviation).alias("limit"))
    flagged = gaps.join(limits, "key_name").withColumn(
        "starts", F.coalesce((F.col("gap") > F.col("limit")).cast("int"), F.lit(0))
    )
    before = range_offsets(flagged, ["key_name"], F.sum("starts"), "_before")
    numbered = flagged.join(before, ["key_name", "_range"]).withColumn(
        "cluster", F.col("_before") + F.sum("starts").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    placed = points.join(numbered.select("key_name", "number", "cluster"), ["key_name", "number"])
    return cluster_members(placed.select("key_name", "value", "cluster"), min_size)


def cluster_members(labels: DataFrame, min_size: int = 2) -> DataFrame:
    """Drop noise (null cluster) and clusters with fewer than ``min_size`` values."""
    kept = labels.filter("cluster is not null")
    big = kept.groupBy("key_name", "cluster").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_size)
    return kept.join(big.drop("_n"), ["key_name", "cluster"], "left_semi")


def text_clusters(values: DataFrame, threshold: float, min_size: int = 2) -> DataFrame:
    """Density clusters of the text values of every key.

    Returns (key_name, value, cluster); ``cluster`` is the smallest core value. With
    ``min_size`` 2 every neighbour pair is core, so clusters are connected components and
    spanning edges suffice.
    """
    named = cut_lineage(values.select("key_name", "value", token_sort("value").alias("form")))
    table = cut_lineage(forms(named))
    if min_size <= 2:
        parts = connected_components(spanning_edges(table, threshold), "key_name", "a", "b")
        joined = table.join(
            parts.withColumnRenamed("node", "form"), ["key_name", "form"], "left"
        ).withColumn("component", F.coalesce("component", "form"))
        first = joined.groupBy("key_name", "component").agg(
            F.min("first_value").alias("cluster"), F.sum("weight").alias("_n")
        )
        labels = joined.join(first.filter(F.col("_n") >= min_size), ["key_name", "component"]).select(
            "key_name", "form", "cluster"
        )
    else:
        nodes = table.select("key_name", F.col("form").alias("node"), "weight", "first_value")
        labels = dbscan(cut_lineage(similar_forms(table, threshold)), nodes, min_size).withColumnRenamed("node", "form")
    return cluster_members(
        named.join(labels, ["key_name", "form"]).select("key_name", "value", "cluster"), min_size
    )


def representative(members: DataFrame, values: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One value per cluster: most frequent, then longest, then first in order.

    ``overrides(key_name, cluster, normalized_value)`` wins where given.
    """
    best = (
        members.join(values.select("key_name", "value", "frequency"), ["key_name", "value"])
        .groupBy("key_name", "cluster")
        .agg(F.min_by("value", F.struct(-F.col("frequency"), -F.length("value"), F.col("value"))).alias("normalized_value"))
    )
    if overrides is None:
        return best
    given = overrides.select("key_name", "cluster", F.col("normalized_value").alias("_given"))
    return best.join(given, ["key_name", "cluster"], "left").select(
        "key_name", "cluster", F.coalesce("_given", "normalized_value").alias("normalized_value")
    )


def normalized_id(key_name: Column | str, value: Column | str) -> Column:
    return F.concat_ws(":", key_name, F.lit("normalized"), value)


def same_as(members: DataFrame, representatives: DataFrame) -> DataFrame:
    """(key_name, value, norm_id, normalized_value), one row per clustered value."""
    return members.join(representatives, ["key_name", "cluster"]).select(
        "key_name", "value", normalized_id("key_name", "normalized_value").alias("norm_id"), "normalized_value"
    )


def normalized_values(links: DataFrame) -> DataFrame:
    """Normalized values with their number of members."""
    return links.groupBy("norm_id", "key_name", "normalized_value").agg(F.count("*").alias("member_count"))


def has_normalized_value(kv: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, norm_id), once per pair."""
    return kv.join(links, ["key_name", "value"]).select("doc_id", "norm_id").distinct()


def normalize_by_dictionary(kv: DataFrame, rules: DataFrame) -> DataFrame:
    """Replace values by ``rules(key_name, value, canonical)``; others stay as they are."""
    known = rules.select("key_name", "value", "canonical")
    return kv.join(known, ["key_name", "value"], "left").withColumn(
        "normalized_value", F.coalesce("canonical", "value")
    ).drop("canonical")


def normalize_all(
    kv: DataFrame,
    threshold: float = 0.85,
    min_size: int = 2,
    done: DataFrame | None = None,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """``same_as`` links of all keys in one job; ``key_plan`` tells which keys take part."""
    values = cut_lineage(pending_values(kv, done))
    plan = cut_lineage(key_plan(values, min_size))
    numeric = values.join(plan.filter("method = 'gap'"), "key_name", "left_semi")
    text = values.join(plan.filter("method = 'text'"), "key_name", "left_semi")
    members = (
        gap_clusters(numeric, min_size)
        .withColumn("cluster", F.col("cluster").cast("string"))
        .unionByName(text_clusters(text, threshold, min_size))
    )
    members = cut_lineage(members)
    return same_as(members, representative(members, values, overrides))


def normalize_key(kv: DataFrame, key_name: str, threshold: float = 0.80, min_size: int = 2, **options) -> DataFrame:
    """N2 for one key, with its own default threshold."""
    return normalize_all(kv.filter(F.col("key_name") == key_name), threshold, min_size, **options)


def normalize_stats(kv: DataFrame, links: DataFrame) -> DataFrame:
    """Number of keys, clusters, normalized values and failures (always 0: one job or none)."""
    keys = kv.agg(F.count_distinct("key_name").alias("n")).scalar()
    return links.agg(
        F.count_distinct("norm_id").alias("clusters_count"), F.count("*").alias("normalized_count")
    ).select(
        keys.alias("keys_count"), "clusters_count", "normalized_count", F.lit(0).cast("bigint").alias("failed_keys")
    )
