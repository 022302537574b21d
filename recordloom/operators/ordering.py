"""Ordered operations on groups of any size.

A window sorts each of its groups in one task, so one hot group becomes one slow task.
Here every group is first cut into value ranges of bounded size; windows then run inside
a range, and small per-range tables carry counts and edges from one range to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import cut_lineage, stored

# Ranges that one level of cut points makes.
MAX_RANGES = 1024
ROWS_PER_RANGE = 500_000
INDEX_ROWS_PER_RANGE = 20_000
# Positions are numbered by sorted tasks of at most about this many rows, one file each. What reads
# the files opens each at a cost, so its tasks take a bounded number of rows, too.
INDEX_ROWS_PER_TASK = 50_000
_ROW_BITS = 33

# Strides of a binary search over fewer than 1024 cut points.
_STRIDES = [512, 256, 128, 64, 32, 16, 8, 4, 2, 1]


def _range_of(value: Column, cuts: Column) -> Column:
    """Number of cut points below ``value`` (binary search, cuts ascending)."""
    return F.aggregate(
        F.array(*[F.lit(s) for s in _STRIDES]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) < value), at + step
        ).otherwise(at),
    )


def with_ranges(
    df: DataFrame, groups: list[str], number: str, rows_per_range: int = ROWS_PER_RANGE, max_ranges: int = MAX_RANGES
) -> DataFrame:
    """Add ``_range``: equal numbers share one, and ranges of a group follow the numbers' order.

    Cut points are approximate quantiles per group, so skewed numbers still spread evenly.
    Groups of at most ``rows_per_range`` rows keep a single range. A group that needs more than
    ``max_ranges`` is cut in levels: each of its ranges becomes a group of its own, so ranges
    stay of that size however large the group.
    """
    df = cut_lineage(df)  # each level of cut points reads it, and so does the join with them
    ranged, most = _cut(df, groups, number, rows_per_range, max_ranges)
    inner = 1
    while most > rows_per_range:
        # Only ranges that are still too large are cut again, and only if that moves anything.
        ranged, left = _cut(ranged.withColumnRenamed("_range", "_outer"), [*groups, "_outer"], number, rows_per_range, max_ranges)
        ranged = ranged.withColumn("_range", F.col("_outer") * max_ranges + F.col("_range")).drop("_outer")
        inner += 1
        if left >= most:
            break
        most = left
    return ranged


def _cut(df: DataFrame, groups: list[str], number: str, rows_per_range: int, max_ranges: int) -> tuple[DataFrame, int]:
    """``df`` with ``_range``, and about how many rows the fullest range may hold."""
    quantiles = [i / max_ranges for i in range(1, max_ranges)]
    wanted = F.least(F.lit(max_ranges), F.ceil(F.col("_n") / rows_per_range)).cast("int")
    cuts = (
        df.groupBy(*groups)
        .agg(F.count("*").alias("_n"), F.percentile_approx(number, quantiles).alias("_q"))
        .withColumn("_step", F.lit(max_ranges) / wanted)
        .select(
            *groups,
            "_n",
            F.when(wanted <= 1, F.array().cast("array<double>"))
            .otherwise(
                F.array_distinct(
                    F.transform(
                        F.sequence(F.lit(1), wanted - 1),
                        lambda i: F.get(F.col("_q"), (i * F.col("_step")).cast("int") - 1),
                    )
                )
            )
            .alias("_cuts"),
        )
    )
    cuts = cut_lineage(cuts)
    # A range of a group that was cut into all it may be holds this share; others are small enough.
    full = F.when(F.col("_n") > max_ranges * rows_per_range, F.ceil(F.col("_n") / (F.size("_cuts") + 1))).otherwise(0)
    most = cuts.agg(F.max(full)).first()[0] or 0
    # Only groups of more than one range have cut points, one for each further range: few enough to be sent.
    several = F.broadcast(cuts.drop("_n").filter(F.size("_cuts") > 0))
    place = F.coalesce(_range_of(F.col(number), F.col("_cuts")), F.lit(0)).cast("long")
    for group in groups:
        df = df.filter(F.col(group).isNotNull())
    ranged = df.join(several, groups, "left").withColumn("_range", place).drop("_cuts")
    return ranged, most


def range_offsets(df: DataFrame, groups: list[str], amount: Column, name: str) -> DataFrame:
    """Per (group, range), the summed ``amount`` of all earlier ranges of the group.

    The windowed table has one row per range.
    """
    earlier = (
        Window.partitionBy(*groups)
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.groupBy(*groups, "_range")
        .agg(amount.alias("_amount"))
        .select(*groups, "_range", F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias(name))
    )


def global_index(
    df: DataFrame, order_by: list[str], name: str, rows_per_range: int = INDEX_ROWS_PER_RANGE
) -> DataFrame:
    """0-based position of every row in the order of ``order_by`` (which must be unique).

    Large inputs are ranged by key, sorted within the ranges and stored with their place in
    them, so the split is the same for every reader; counts of the ranges, one row for each,
    then shift the places.
    """
    order = [F.col(c) for c in order_by]
    total = df.count()
    if total <= rows_per_range:
        only = Window.partitionBy(F.lit(0)).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(only) - 1).cast("bigint"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(parts, -(-total // rows_per_range)), -(-total // INDEX_ROWS_PER_TASK))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS).cast("int")
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))  # one row a range
    inside = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, (F.col("_before") + inside).cast("bigint")).drop("_part", "_at", "_before")
