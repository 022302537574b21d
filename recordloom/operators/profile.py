"""Field profiling of records whose schema is unknown.

Records are rows ``(dataset, source_file, record_index, raw map<string,string>)``; records of
one dataset need not share fields. Every function profiles all datasets in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LongText:
    threshold: int
    prefix: int
    suffix: int


# Thresholds per context, the cut marker, address syllables and tag texts.
LONG_TEXT = {
    "schema_analysis": LongText(500, 200, 100),
    "key_value_extract": LongText(5000, 2000, 1000),
    "default": LongText(500, 200, 100),
}
CUT_MARKER = "\n...(중략)...\n"
ADDRESS_KEYWORDS = ("시", "구", "동", "로", "길")
AUTO_DESCRIPTION = "자동 생성된 필드 (타입: {})"

# Stands for the fields of a record that has none.
NO_FIELD = "\u0000"

# Values of more characters are counted by digest.
LONG_VALUE = 64


def long_text_settings(context: str) -> LongText:
    return LONG_TEXT.get(context, LONG_TEXT["default"])


def melt(records: DataFrame) -> DataFrame:
    """One row per (record, field), nulls and empty strings included."""
    return records.select(
        "dataset", "source_file", "record_index", F.posexplode(F.map_entries("raw")).alias("field_pos", "_e")
    ).select("dataset", "source_file", "record_index", "field_pos", F.col("_e.key").alias("field"), F.col("_e.value").alias("value"))


def field_union(records: DataFrame) -> DataFrame:
    """Field names seen in any record of a dataset."""
    return records.select("dataset", F.explode(F.map_keys("raw")).alias("field")).distinct()


def _field_rows(records: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """(dataset, at, field_pos, field, value) of all fields, under display names if there is a mapping; "" is null."""
    rows = records.select(
        F.coalesce("dataset", F.lit("")).alias("dataset"), F.struct("source_file", "record_index").alias("at"), F.posexplode_outer(F.map_entries("raw")).alias("field_pos", "_e")
    )
    rows = rows.select(
        "dataset",
        "at",
        F.coalesce("field_pos", F.lit(0)).alias("field_pos"),
        F.coalesce("_e.key", F.lit(NO_FIELD)).alias("field"),
        F.nullif("_e.value", F.lit("")).alias("value"),
    )
    if mapping is not None:
        names = mapping.select(F.col("raw_field").alias("field"), "display_name")
        rows = rows.join(names, "field", "left").withColumn("field", F.coalesce("display_name", "field")).drop("display_name")
    return rows


def _digest(value: Column) -> Column:
    """What a long value travels as; null for short ones."""
    return F.when(F.length(value) > LONG_VALUE, F.sha2(value, 256))


def value_counts(records: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Occurrences, length and first position of every distinct field value; "" counts as null.

    With ``mapping(raw_field, display_name)`` fields count under their display names, those of
    one name together.

    The one wide shuffle of profiling: statistics, samples and lengths all derive from it,
    and repeated values are combined before it. Values of over LONG_VALUE characters travel as
    digests (``value`` is null then, ``digest`` is not). ``leading`` counts the rows that stand
    for whole records (their first field, or NO_FIELD for a record without any), so the number
    of records needs no second scan.
    """
    rows = _field_rows(records, mapping).withColumn("digest", _digest(F.col("value")))
    short = F.when(F.col("digest").isNull(), F.col("value"))
    return (
        rows.groupBy("dataset", "field", short.alias("value"), "digest", F.length("value").alias("n_chars"))
        .agg(
            F.count("*").alias("occurrences"),
            F.min("at").alias("first_at"),
            F.count_if(F.col("field_pos") == 0).alias("leading"),
        )
    )


def value_lengths(records: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Minimum, maximum and floor-average length of the non-empty values; zeros if none."""
    counts = value_counts(records) if counts is None else counts
    found = _lengths(counts).filter("named")
    return found.select("dataset", "field", "min_length", "max_length", "avg_length")


def _lengths(counts: DataFrame) -> DataFrame:
    size = F.col("n_chars")
    present = F.sum(F.when(size.isNotNull(), F.col("occurrences")).otherwise(0))
    return counts.groupBy("dataset", "field").agg(
        F.sum("leading").alias("leading"),
        F.min("first_at").alias("first_at"),
        F.count(F.coalesce("value", "digest")).alias("unique_count"),
        F.bool_or(F.col("field") != NO_FIELD).alias("named"),
        present.alias("present"),
        F.coalesce(F.min(size), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_length"),
        F.coalesce(F.expr("sum(n_chars * occurrences) div nullif(sum(if(n_chars is null, 0, occurrences)), 0)"), F.lit(0))
        .cast("int")
        .alias("avg_length"),
    )


def top_samples(records: DataFrame, k: int = 5, counts: DataFrame | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """The k most frequent values per field; ties go to the value seen first, by file and record.

    Long values are fetched from the records where the winners were first seen.
    """
    counts = value_counts(records, mapping) if counts is None else counts
    # Nulls are ranked last and dropped after the window: a filter before it would be pushed into
    # the counting, and the counts could no longer be shared with the other statistics.
    order = Window.partitionBy("dataset", "field").orderBy(
        F.col("n_chars").isNull(), F.desc("occurrences"), "first_at", "value", "digest"
    )
    best = (
        counts.withColumn("rank", F.row_number().over(order))
        .filter((F.col("rank") <= k) & F.col("n_chars").isNotNull() & (F.col("leading") >= 0))
        .select("dataset", "field", "rank", "value", "digest", "first_at")
    )
    # At most k rows a field; they decide which records are read again.
    long = best.filter("digest IS NOT NULL").select(F.col("first_at.source_file").alias("_file"), F.col("first_at.record_index").alias("_index")).distinct()
    seen = records.join(long, records["source_file"].eqNullSafe(long["_file"]) & (records["record_index"] == long["_index"]), "left_semi")
    texts = _field_rows(seen, mapping).withColumn("digest", _digest(F.col("value"))).filter("digest IS NOT NULL")
    texts = texts.groupBy("dataset", "field", "digest").agg(F.first("value").alias("whole"))
    best = best.join(texts, ["dataset", "field", "digest"], "left").withColumn("value", F.coalesce("value", "whole"))
    return best.groupBy("dataset", "field").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("samples")
    )


def field_statistics(records: DataFrame, k: int = 5, mapping: DataFrame | None = None) -> DataFrame:
    """P2 to P4 in one table. A field missing from a record counts as null there.

    ``mapping`` gives display names; fields of one name share their statistics, and a record
    that fills several of them has no null to spare (never less than 0 in all).
    """
    counts = value_counts(records, mapping)
    # One row per field. Both uses of the counts have to read the same shuffle, so they need the
    # same columns (the comparison of first_at always holds) and no filter on a count's key.
    fields = _lengths(counts).filter("first_at IS NOT NULL").withColumn(
        "total_count", F.sum("leading").over(Window.partitionBy("dataset"))
    )
    nulls = F.greatest(F.col("total_count") - F.col("present"), F.lit(0))
    return (
        fields.filter("named")
        .join(top_samples(records, k, counts, mapping), ["dataset", "field"], "left")
        .select(
            "dataset",
            "field",
            "total_count",
            "unique_count",
            nulls.alias("null_count"),
            F.bround(nulls / F.col("total_count"), 3).alias("null_ratio"),
            F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
            F.create_map(
                F.lit("min"), F.col("min_length"), F.lit("max"), F.col("max_length"), F.lit("avg"), F.col("avg_length")
            ).alias("value_lengths"),
        )
    )


def systematic_sample(records: DataFrame, k: int = 5) -> DataFrame:
    """P5: records ``i * (n // k)`` of a dataset for i < k; all records if there are at most k.

    Records are numbered over the files of a dataset in their order; within a file the index
    counts from 0. The window runs over one row per file.
    """
    files = records.groupBy("dataset", "source_file").agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy("dataset")
    earlier = whole.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(
        "dataset", "source_file", F.sum("_rows").over(whole).alias("_n"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    step, position = F.expr(f"_n div {k}"), F.col("_before") + F.col("record_index")
    keep = (F.col("_n") <= k) | ((position % step == 0) & (position < step * k))
    return records.join(files, ["dataset", "source_file"]).filter(keep).select(*records.columns)


def infer_data_type(
    samples: Column | str,
    address_keywords: tuple[str, ...] = ADDRESS_KEYWORDS,
    strict_dates: bool = False,
) -> Column:
    """Type tag from the most frequent values; the first rule that holds wins.

    The default order tests phone before date, so a dashed ISO date is a "phone";
    ``strict_dates`` tests date first.
    """
    samples = F.col(samples) if isinstance(samples, str) else samples
    first = F.get(samples, F.lit(0))
    address = F.lit(False)
    for keyword in address_keywords:
        address = address | first.contains(keyword)
    phone = (first.rlike(r"(?U)^[\d\-\s\(\)]+$") & (F.length(first) >= 9), "phone")
    date = (first.rlike(r"(?U)^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"), "date")
    numeric = F.forall(F.slice(samples, 1, 3), lambda s: s.rlike(r"(?U)^[\d.,]+$") | (s == ""))
    rules = [
        (F.size(samples) == 0, "text"),
        (first.rlike("^https?://"), "url"),
        (first.contains("@") & first.contains("."), "email"),
        *((date, phone) if strict_dates else (phone, date)),
        (numeric, "number"),
        (address, "address"),
    ]
    (condition, tag), *rest = rules
    chosen = F.when(condition, tag)
    for condition, tag in rest:
        chosen = chosen.when(condition, tag)
    return chosen.otherwise("text")


def auto_fields(stats: DataFrame, overrides: DataFrame | None = None, **typing) -> DataFrame:
    """Display name, description and type per field.

    ``overrides(dataset, field, display_name, description, data_type)`` wins where given.
    """
    kind = infer_data_type("samples", **typing)
    before, after = AUTO_DESCRIPTION.split("{}")
    fields = stats.select(
        "dataset",
        "field",
        F.replace("field", F.lit("_"), F.lit(" ")).alias("display_name"),
        F.concat(F.lit(before), kind, F.lit(after)).alias("description"),
        kind.alias("data_type"),
    )
    if overrides is None:
        return fields
    names = ["display_name", "description", "data_type"]
    given = overrides.select("dataset", "field", *[F.col(n).alias(f"_{n}") for n in names])
    return fields.join(given, ["dataset", "field"], "left").select(
        "dataset", "field", *[F.coalesce(f"_{n}", n).alias(n) for n in names]
    )


def long_text_fields(
    stats: DataFrame | None = None,
    records: DataFrame | None = None,
    context: str = "default",
    threshold: int | None = None,
) -> DataFrame:
    """Fields whose average length (statistics) or any value's length (records) is too long."""
    limit = long_text_settings(context).threshold if threshold is None else threshold
    if stats is not None:
        return stats.filter(F.col("value_lengths")["avg"] > limit).select("dataset", "field")
    return melt(records).filter(F.length("value") > limit).select("dataset", "field").distinct()


def _shorten(value: Column, prefix: int, suffix: int) -> Column:
    cut = F.concat(F.substring(value, 1, prefix), F.lit(CUT_MARKER), F.substring(value, -suffix, suffix))
    return F.when(F.length(value) > prefix + suffix, cut).otherwise(value)


def truncate_long_text(
    records: DataFrame,
    fields: DataFrame,
    context: str = "default",
    prefix: int | None = None,
    suffix: int | None = None,
) -> DataFrame:
    """Shorten the values of ``fields(dataset, field)`` to head, marker and tail."""
    settings = long_text_settings(context)
    if prefix is None or suffix is None:
        prefix, suffix = settings.prefix, settings.suffix
    # One row per dataset; its list is as long as the dataset has fields.
    chosen = fields.groupBy("dataset").agg(F.collect_set("field").alias("_long"))
    shortened = F.transform_values(
        "raw",
        lambda k, v: F.when(F.array_contains("_long", k), _shorten(v, prefix, suffix)).otherwise(v),
    )
    return (
        records.join(chosen, "dataset", "left")
        .withColumn("raw", F.when(F.col("_long").isNull(), F.col("raw")).otherwise(shortened))
        .drop("_long")
    )


def truncate_auto(records: DataFrame, context: str = "default") -> DataFrame:
    """P10: per record, shorten each value over the context's threshold."""
    s = long_text_settings(context)
    return records.withColumn(
        "raw",
        F.transform_values(
            "raw",
            lambda _, v: F.when(F.length(v) > s.threshold, _shorten(v, s.prefix, s.suffix)).otherwise(v),
        ),
    )
