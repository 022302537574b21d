"""Nearest numbers within groups, by sorted position instead of a range join.

A range join around each number meets every corpus number inside the range, which is half the
table for wide ranges. The k nearest of a number are among the k before and the k after its
place in sorted order, so 2k positions per query are enough. Sorted numbers are stored in blocks
that overlap by k at either end: a query meets the one block that holds all its positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.vectors import clamp01
from recordloom.operators.ordering import range_offsets, with_ranges
from recordloom.session import cut_lineage

# Numbers of a block, without what it shares with its neighbours.
BLOCK = 64


def numeric_scale(a: Column) -> Column:
    """Distance at which two numbers stop being alike."""
    return F.greatest(F.abs(a) * 0.5, F.lit(100.0))


def score_numeric(a: Column, b: Column) -> Column:
    """1 at equality, falling to 0 at ``numeric_scale`` of the source number ``a``."""
    return clamp01(F.lit(1.0) - F.abs(a - b) / numeric_scale(a))


def nearest_numbers(queries: DataFrame, corpus: DataFrame, groups: list[str], k: int, rows_per_range: int = 500_000) -> DataFrame:
    """The k nearest distinct corpus numbers per (group, query number).

    ``queries`` and ``corpus`` hold (groups..., number). Returns (groups..., number, near);
    at equal distance the smaller number comes first.
    """
    kind = lambda df, flag: df.select(*groups, F.col("number").cast("double")).distinct().withColumn("asks", F.lit(flag))
    both = kind(corpus, 0).unionByName(kind(queries, 1)).filter("number is not null")
    ranged = cut_lineage(with_ranges(both, groups, "number", rows_per_range))
    offsets = range_offsets(ranged, groups, F.count_if(F.col("asks") == 0), "_before")
    inside = (
        Window.partitionBy(*groups, "_range")
        .orderBy("number", "asks")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = ranged.join(offsets, [*groups, "_range"]).withColumn(
        "_seen", F.col("_before") + F.sum(F.lit(1) - F.col("asks")).over(inside)
    )
    size = max(BLOCK, 4 * k)
    at = F.col("_seen") - 1
    block_of = lambda place: F.floor(place / size).cast("long")
    # Block b holds the positions from b * size - k to b * size + size + k - 2.
    blocks = (
        placed.filter("asks = 0")
        .select(*groups, "number", F.explode(F.sequence(F.greatest(block_of(at - k + 1), F.lit(0)), block_of(at + k))).alias("_block"))
        .groupBy(*groups, "_block")
        .agg(F.array_sort(F.collect_list("number")).alias("_near"))
    )
    asked = placed.filter("asks = 1").select(*groups, "number", "_seen", block_of(F.col("_seen")).alias("_block"))
    # Cut, so that a block which many queries meet can be split by them.
    met = asked.join(cut_lineage(blocks), [*groups, "_block"])
    first = F.greatest(F.col("_seen") - k, F.lit(0))
    held = F.greatest(F.col("_block") * size - k, F.lit(0))
    around = F.slice("_near", (first - held + 1).cast("int"), (F.least("_seen", F.lit(k)) + k).cast("int"))
    by_distance = F.array_sort(F.transform(around, lambda x: F.struct(F.abs(x - F.col("number")).alias("distance"), x.alias("near"))))
    return met.select(*groups, "number", F.explode(F.slice(by_distance, 1, k)["near"]).alias("near"))
