"""Connected components and density clustering over long edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import cut_lineage


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """Smallest neighbour per ``u``; partial aggregation runs before the shuffle."""
    return edges.groupBy("g", "u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of node and neighbours."""
    both = edges.unionByName(edges.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
    least = _min_neighbour(both).withColumn("m", F.least("u", "m"))
    return (
        both.join(least, ["g", "u"])
        .filter("v > u")
        .select("g", F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select("g", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _min_neighbour(down)
    moved = down.join(least, ["g", "u"]).select("g", F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("g", "u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(
    edges: DataFrame, group: str, a: str, b: str
) -> DataFrame:
    """(group, node, component) with the smallest node as component id; isolated nodes are absent.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in
    MapReduce and Beyond"), which need O(log^2 n) rounds. Joins carry the hot centres, so
    adaptive skew handling can split them; no neighbour list is ever collected. Each round
    is checkpointed; rounds go on until nothing changes.
    """
    current = cut_lineage(
        edges.select(F.col(group).alias("g"), F.col(a).alias("u"), F.col(b).alias("v"))
        .filter("u <> v")
        .select("g", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    fingerprint = None
    while True:
        current = cut_lineage(_small_star(_large_star(current)))
        row = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("g", "u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if (row["n"], row["h"]) == fingerprint:
            members = current.select("g", F.col("u").alias("node"), F.col("v").alias("component"))
            roots = current.select("g", F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return members.unionByName(roots).withColumnRenamed("g", group)
        fingerprint = (row["n"], row["h"])


def dbscan(pairs: DataFrame, nodes: DataFrame, min_samples: int) -> DataFrame:
    """Density clusters from neighbour pairs.

    ``pairs(key_name, a, b)``: unordered neighbour pairs of nodes.
    ``nodes(key_name, node, weight, first_value)``: ``weight`` equal points share a node;
    ``first_value`` is the smallest of them. A node is core when its own and its neighbours'
    weights reach ``min_samples``. Clusters are numbered by their smallest core point, and a
    border node joins the smallest adjacent cluster.

    Returns (key_name, node, cluster); noise is absent.
    """
    both = pairs.select("key_name", F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        pairs.select("key_name", F.col("b").alias("node"), F.col("a").alias("other"))
    )
    weights = nodes.select("key_name", F.col("node").alias("other"), F.col("weight").alias("other_weight"))
    around = (
        both.join(weights, ["key_name", "other"])
        .groupBy("key_name", "node")
        .agg(F.sum("other_weight").alias("around"))
    )
    core = (
        nodes.join(around, ["key_name", "node"], "left")
        .filter(F.col("weight") + F.coalesce("around", F.lit(0)) >= min_samples)
        .select("key_name", "node", "first_value")
    )
    core = cut_lineage(core)
    core_ids = core.select("key_name", "node")
    core_edges = both.filter("node < other").join(core_ids, ["key_name", "node"], "left_semi").join(
        core_ids.withColumnRenamed("node", "other"), ["key_name", "other"], "left_semi"
    )
    parts = connected_components(core_edges, "key_name", "node", "other")
    rooted = core.join(parts, ["key_name", "node"], "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    names = rooted.groupBy("key_name", "component").agg(F.min("first_value").alias("cluster"))
    cores = rooted.join(names, ["key_name", "component"]).select("key_name", "node", "cluster")
    border = (
        both.join(core_ids, ["key_name", "node"], "left_anti")
        .join(cores.withColumnRenamed("node", "other"), ["key_name", "other"])
        .groupBy("key_name", "node")
        .agg(F.min("cluster").alias("cluster"))
    )
    return reduce(DataFrame.unionByName, [cores, border])
