"""Node tables: idempotent writes, deletes and triple files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from recordloom.functions.text import escape_literal
from recordloom.session import cut_lineage


def latest_by_id(rows: DataFrame, ids: str | list[str], version: str | Column) -> DataFrame:
    """The row with the highest ``version`` per id; among equals always the same one, by its content."""
    keys = [ids] if isinstance(ids, str) else ids
    newest = Window.partitionBy(*keys).orderBy(F.desc(version), F.to_json(F.struct("*")))
    return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def _existing(df: DataFrame, path: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def upsert(
    df: DataFrame, path: str, ids: str | list[str], partition: str = "dataset", version: str | None = None
) -> DataFrame:
    """Insert rows, replacing those with the same id, or only older ones if ``version`` is named.

    Only partitions the new rows touch are read and rewritten. The merged rows are
    checkpointed first, because a table cannot be overwritten while it is being read.
    Returns one row (success, failed).
    """
    keys = [ids] if isinstance(ids, str) else ids
    fresh = cut_lineage(latest_by_id(df, keys, F.lit(0) if version is None else version))
    stored = _existing(df, path)
    merged = fresh
    if stored is not None:
        touched = fresh.select(partition).distinct()
        kept = stored.join(touched, partition, "left_semi")
        if version is None:
            merged = kept.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)
        else:
            merged = latest_by_id(kept.unionByName(fresh), keys, version)
    merged = cut_lineage(merged)
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    return fresh.agg(F.count("*").alias("success"), F.lit(0).cast("bigint").alias("failed"))


def write_documents(df: DataFrame, path: str) -> DataFrame:
    return upsert(df, path, "doc_id")


def write_keys(df: DataFrame, path: str) -> DataFrame:
    return upsert(df, path, "key_id", partition="domain")


def write_values(df: DataFrame, path: str) -> DataFrame:
    return upsert(df, path, "value_id")


def upsert_rows(df: DataFrame, path: str, ids: str | list[str], gone: DataFrame | None = None) -> int:
    """S6 by rows: write the new versions of the given ids, and tombstones for those of ``gone``, as one change set.

    Nothing that is there is read or rewritten but the numbers of earlier change sets, so an
    upsert costs what it brings. ``read_rows`` merges; ``compact_rows`` folds the changes in.
    A row wins over a tombstone of its own set. Returns the number of the set.
    """
    keys = [ids] if isinstance(ids, str) else ids
    fresh = latest_by_id(df, keys, F.lit(0)).withColumn("_gone", F.lit(False)).withColumn("_whole", F.lit(False))
    if gone is not None:
        dead = gone.select(*keys).distinct().join(df.select(*keys), keys, "left_anti")
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in keys]
        fresh = fresh.unionByName(dead.select(*keys, *nothing, F.lit(True).alias("_gone"), F.lit(False).alias("_whole")))
    changes = _changes(df.sparkSession, path)
    last = None if changes is None else changes.agg(F.max("_set")).first()[0]
    number = 0 if last is None else last + 1
    fresh.withColumn("_set", F.lit(number)).write.mode("append").partitionBy("_set").parquet(f"{path}/changes")
    return number


def _changes(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/changes")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_rows(spark: SparkSession, path: str, ids: str | list[str]) -> DataFrame:
    """The current rows of a table of change sets: the newest of each id, without those that are gone.

    The last compacted set is a whole table in itself; its rows that no later set names are read
    as they are. Only the later sets are sorted out by id.
    """
    keys = [ids] if isinstance(ids, str) else ids
    changes = spark.read.parquet(f"{path}/changes")
    whole = changes.filter("_whole").agg(F.max("_set")).first()[0]
    plain = [c for c in changes.columns if c not in ("_set", "_gone", "_whole")]
    later = changes if whole is None else changes.filter(F.col("_set") > whole)
    newest = latest_by_id(later.select(*plain, "_gone", "_set"), keys, "_set")
    current = newest.filter("NOT _gone").select(plain)
    if whole is None:
        return current
    return changes.filter(F.col("_set") == whole).select(plain).join(newest.select(*keys), keys, "left_anti").unionByName(current)


def compact_rows(spark: SparkSession, path: str, ids: str | list[str]) -> int:
    """Write the current rows as a set that stands for the whole table. Earlier sets are no longer read."""
    number = spark.read.parquet(f"{path}/changes").agg(F.max("_set")).first()[0] + 1
    rows = read_rows(spark, path, ids).withColumn("_gone", F.lit(False)).withColumn("_whole", F.lit(True))
    rows.withColumn("_set", F.lit(number)).write.mode("append").partitionBy("_set").parquet(f"{path}/changes")
    return number


def delete_nodes(nodes: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """The table without the listed ids."""
    return nodes.join(ids.select(id_column), id_column, "left_anti")


def triple_lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple."""
    iri = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    quoted = F.concat(F.lit('"'), escape_literal("o"), F.lit('"'))
    typed = F.concat(quoted, F.lit("^^<"), F.col("o_datatype"), F.lit(">"))
    node = F.when(F.col("o_kind") == "uri", iri("o")).when(F.col("o_datatype").isNull(), quoted).otherwise(typed)
    return triples.select(F.concat_ws(" ", iri("s"), iri("p"), node, F.lit(".")).alias("value"))


def write_triples(triples: DataFrame, path: str) -> None:
    """Triples as Parquet and as N-Triples text."""
    triples.write.mode("overwrite").parquet(f"{path}/parquet")
    triple_lines(triples).write.mode("overwrite").text(f"{path}/ntriples")
