"""Turns of conversations in order, whatever the length of a conversation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import map_batches, stored
from recordloom.session import spread

NAME_BYTES = 16


def short_digest(*parts: Column) -> Column:
    """The first bytes of a SHA-256 over binary or text columns, enough to name what is hashed."""
    return F.unhex(F.substring(F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256), 1, 2 * NAME_BYTES))


def turn_key(role: Column, text: Column) -> Column:
    """One name per (role, text)."""
    return short_digest(F.octet_length(role).cast("string"), F.lit(":"), role, text)


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "pos") -> DataFrame:
    """``rows`` with the 0-based position of each in its group, by ``order`` (nulls first).

    All rows are ranged by group and order (identical ones also by their place in the scan), so
    a group of any size is dealt to as many tasks as it fills. Each range numbers its rows; only
    the group that a range begins with can have come from an earlier one, so what is added to
    the numbers is a table of at most one row a range.
    """
    at = stored(rows.withColumn("_at", F.monotonically_increasing_id()))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "_at"]
    ranged = at.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_at").withColumn("_range", F.spark_partition_id())

    def task():
        state = {"row": 0, "start": 0, "last": None}

        def handle(columns):
            ids = columns[group]
            count = len(ids)
            if not count:
                return
            valid, value = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            changed = np.empty(count, dtype=bool)
            changed[0] = state["last"] != (valid[0], value[0])
            changed[1:] = (value[1:] != value[:-1]) | (valid[1:] != valid[:-1])
            index = state["row"] + np.arange(count, dtype=np.int64)
            start = np.maximum.accumulate(np.where(changed, index, state["start"]))
            state.update(row=state["row"] + count, start=int(start[-1]), last=(valid[-1], value[-1]))
            yield {**columns, "_place": index - start}

        return handle

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    placed = stored(map_batches(ranged, f"{schema}, _place long", task))
    sizes = placed.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    added = sizes.select(F.col(group).alias("_group"), F.col("_range").alias("_part"), F.sum("_n").over(earlier).alias("_before")).filter("_before > 0")
    joined = placed.join(F.broadcast(added), placed[group].eqNullSafe(added["_group"]) & (placed["_range"] == added["_part"]), "left")
    return joined.withColumn(name, F.col("_place") + F.coalesce("_before", F.lit(0))).drop("_range", "_place", "_group", "_part", "_before")


def joined_digests(rows: DataFrame, key: str, order: list[str], text: str, separator: str) -> DataFrame:
    """(key, sha256): the lowercase hex SHA-256 of each key's texts in order, with a separator between them.

    Texts stream through the digest in sorted batches and are never held together.
    """
    import hashlib

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = spread(rows.select(key, *order, text), key).sortWithinPartitions(key, *order).select(key, text)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, sha256 string"
    target = to_arrow_schema(rows.select(F.col(key), F.lit("").alias("sha256")).schema)
    between = separator.encode()

    def run(batches):
        current = None
        for batch in batches:
            names, digests = [], []
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if current is None or current[0] != name:
                    if current is not None:
                        names.append(current[0])
                        digests.append(current[1].hexdigest())
                    current = (name, hashlib.sha256())
                else:
                    current[1].update(between)
                current[1].update(part.encode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(names, target.field(0).type), pa.array(digests, pa.string())], schema=target)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current[0]], target.field(0).type), pa.array([current[1].hexdigest()], pa.string())], schema=target)

    return wanted.mapInArrow(run, schema)
