"""Contiguous shards of nearly equal bytes, from prefix sums over key ranges.

Defined cases: a null text has no bytes (crc32 0); rows with a null id come first; repeated
rows are placed one after another; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import map_batches
from recordloom.session import cut_lineage


def shard_by_bytes(docs: DataFrame, shards: int = 24, overhead: int = 8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): documents in id order, cut at equal byte targets.

    A row belongs to the shard in which the middle of its bytes falls, so a shard misses its
    target by at most half of the largest row at either end. The texts are read once; what
    moves is 24 bytes a row. Rows are ranged by id (equal ids by checksum, size and position in
    the scan, so one id may hold many rows) and kept; only the totals of the ranges, one row for
    each, and the first position of each shard go through the driver.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.col(id_column).alias("id"),
            (F.octet_length(body) + overhead).cast("long").alias("size"),
            F.crc32(body.cast("binary")).cast("long").alias("crc"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["id", "crc", "size", "at"]
    ranged = cut_lineage(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "size", "crc", F.spark_partition_id().alias("part"))
    )
    totals = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("size"), F.count("*")).collect())
    before = dict(zip([t[0] for t in totals], zip(accumulate([0] + [t[1] for t in totals]), accumulate([0] + [t[2] for t in totals]))))
    total = max(1, sum(t[1] for t in totals))

    def task():
        state = {}

        def handle(columns):
            part = columns["part"].to_numpy()
            if not len(part):
                return
            # A partition holds one range; batches of it come in order.
            done = state.setdefault(int(part[0]), list(before[int(part[0])]))
            size = columns["size"].to_numpy().astype(np.int64)
            start = done[0] + np.cumsum(size) - size
            position = done[1] + np.arange(len(size), dtype=np.int64)
            done[0] += int(size.sum())
            done[1] += len(size)
            # Exact integers: floor(shards * (start + size / 2) / total) without overflow.
            middle = 2 * start + size
            whole, rest = np.divmod(middle, 2 * total)
            shard = np.minimum(shards - 1, whole * shards + _scaled(rest, shards, 2 * total))
            yield {"id": columns["id"], "size": columns["size"], "crc": columns["crc"], "shard": shard.astype(np.int32), "position": position}

        return handle

    placed = map_batches(ranged, f"id {rows.schema['id'].dataType.simpleString()}, size long, crc long, shard int, position long", task)
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("position")).collect()}
    starts = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)])
    return placed.select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("position") - F.get(starts, F.col("shard"))).alias("slot"),
    )


def _scaled(rest: np.ndarray, factor: int, whole: int) -> np.ndarray:
    """floor(rest * factor / whole) for rest < whole, in Python integers where 64 bits don't do."""
    if whole < 2**62 // max(1, factor):
        return rest * factor // whole
    return np.array([int(r) * factor // whole for r in rest], dtype=np.int64)
