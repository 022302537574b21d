"""Schema report of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.profile import auto_fields, field_statistics


def analyze_schema(
    records: DataFrame,
    overrides: DataFrame | None = None,
    fields: DataFrame | None = None,
    metadata: DataFrame | None = None,
) -> DataFrame:
    """One row per dataset: domain, central node, fields, metadata, confidence, notes, size.

    ``overrides(dataset, domain, centrality_name, confidence, notes)`` carries what statistics
    cannot tell; ``fields`` overrides field descriptions; ``metadata(dataset, name,
    display_name, source_field, data_type, description, examples)`` lists further
    extractable values. Lists are bounded by the number of fields.
    """
    if records.isEmpty():
        raise ValueError("no records to analyse")
    described = auto_fields(field_statistics(records), fields)
    field_map = described.groupBy("dataset").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("field", F.struct("display_name", "description", "data_type"))))
        ).alias("fields")
    )
    report = records.groupBy("dataset").agg(F.count("*").alias("analyzed_count")).join(field_map, "dataset")
    extra = "struct<display_name:string,source_field:string,data_type:string,description:string,examples:array<string>>"
    if metadata is None:
        report = report.withColumn("metadata", F.lit(None).cast(f"map<string,{extra}>"))
    else:
        names = ["display_name", "source_field", "data_type", "description", "examples"]
        maps = metadata.groupBy("dataset").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct(*names))))).alias("metadata")
        )
        report = report.join(maps, "dataset", "left")
    if overrides is None:
        report = report.select(
            "*", F.col("dataset").alias("domain"), F.col("dataset").alias("centrality_name"), F.lit(0.0).alias("confidence"), F.lit("").alias("notes")
        )
    else:
        report = report.join(overrides, "dataset", "left").withColumns(
            {
                "domain": F.coalesce("domain", "dataset"),
                "centrality_name": F.coalesce("centrality_name", "dataset"),
                "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))),
                "notes": F.coalesce("notes", F.lit("")),
            }
        )
    return report.select("dataset", "domain", "centrality_name", "fields", "metadata", "confidence", "notes", "analyzed_count")
