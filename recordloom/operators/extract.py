"""From records to long key-value rows.

Key-value rows are ``(dataset, source_file, record_index, doc_id, field, field_pos, key_name,
value, value_pos, is_repeat)``. ``is_repeat`` marks a value that the same document already
holds under the same key, so distinct value nodes need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.text import file_stem, is_blank, safe_double, strip
from recordloom.operators.profile import melt

# Key-name keywords that mark numeric and date values.
NUMERIC_KEYWORDS = ("수", "면적", "좌표", "위도", "경도")
DATE_KEYWORDS = ("일자", "날짜")

_RECORD = ["dataset", "source_file", "record_index"]


def document_id(source_file: Column | str, record_index: Column | str) -> Column:
    """K7: file stem, underscore, index of at least four digits."""
    index = F.col(record_index) if isinstance(record_index, str) else record_index
    return F.format_string("%s_%04d", file_stem(source_file), index)


def map_keys(kv: DataFrame, mapping: DataFrame, strict: bool = False) -> DataFrame:
    """K1/K2: rename fields by ``mapping(raw_field, display_name)``.

    Strict drops unmapped fields, lenient keeps them under their own name; ``field`` stays as
    the original. When two fields of a record get one name, the last one wins. Only names
    that can collide are ranked; the rest pass without a shuffle.
    """
    names = mapping.select(F.col("raw_field").alias("field"), "display_name")
    renamed = kv.join(names, "field", "inner" if strict else "left").withColumn(
        "key_name", F.coalesce("display_name", "field")
    ).drop("display_name")
    shared = names.groupBy(F.col("display_name").alias("key_name")).agg(F.count("*").alias("_n"))
    if not strict:  # an unmapped field may already bear a display name
        unmapped = names.select(F.col("display_name").alias("field")).join(
            names.select("field"), "field", "left_anti"
        )
        shared = shared.unionByName(unmapped.distinct().select(F.col("field").alias("key_name"), F.lit(2).alias("_n")))
    shared = shared.filter("_n > 1").select("key_name").distinct()
    last = Window.partitionBy(*_RECORD, "key_name").orderBy(F.desc("field_pos"))
    settled = (
        renamed.join(shared, "key_name", "left_semi")
        .withColumn("_best", F.max("field_pos").over(last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .filter("field_pos = _best")
        .drop("_best")
    )
    return renamed.join(shared, "key_name", "left_anti").unionByName(settled)


def merge_mappings(fields: DataFrame, metadata: DataFrame) -> DataFrame:
    """K3: one mapping from detected fields and extractable metadata; metadata wins."""
    both = fields.select("raw_field", "display_name", F.lit(1).alias("_p")).unionByName(
        metadata.select("raw_field", "display_name", F.lit(0).alias("_p"))
    )
    return both.groupBy("raw_field").agg(F.min_by("display_name", "_p").alias("display_name"))


def drop_blank(kv: DataFrame) -> DataFrame:
    """K4: drop null and white-space values, trim the others."""
    return kv.withColumn("value", strip("value")).filter("value is not null and value <> ''")


def _pieces(value: Column, multi: Column) -> Column:
    parts = F.filter(F.transform(F.split(value, ",", -1), strip), lambda p: p != "")
    return F.when(multi & value.contains(","), parts).otherwise(F.array(value))


def split_multi(kv: DataFrame, keys: Iterable[str]) -> DataFrame:
    """K5/K6: comma-split the values of ``keys``; keys left without a value vanish."""
    keys = list(keys)
    if not keys:
        return kv.withColumn("value_pos", F.lit(0)).withColumn("is_repeat", F.lit(False))
    listed = F.col("key_name").isin(*keys)
    keep = [c for c in kv.columns if c not in ("value", "value_pos", "is_repeat")]
    return (
        kv.withColumn("_parts", _pieces(F.col("value"), listed))
        .select(*keep, "_parts", F.posexplode("_parts").alias("value_pos", "value"))
        .withColumn("is_repeat", F.array_position("_parts", F.col("value")) <= F.col("value_pos"))
        .drop("_parts")
    )


def skip_empty_lists(lists: DataFrame, column: str = "values") -> DataFrame:
    """K6: drop keys whose list of values is null or empty."""
    return lists.filter(F.coalesce(F.size(column), F.lit(0)) > 0)


def with_document_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", document_id("source_file", "record_index"))


def extract(
    records: DataFrame,
    mapping: DataFrame | None = None,
    strict: bool = False,
    multi_keys: Iterable[str] = (),
) -> DataFrame:
    """Records to key-value rows: drop blanks, rename, split (K1 to K7).

    Without a mapping the whole chain is one narrow stage; with one, the mapping joins in.
    """
    kv = with_document_id(drop_blank(melt(records))).withColumn("key_name", F.col("field"))
    if mapping is not None:
        kv = map_keys(kv, mapping, strict)
    return split_multi(kv, multi_keys)


def infer_value_type(
    key: Column | str,
    value: Column | str,
    numeric_keywords: tuple[str, ...] = NUMERIC_KEYWORDS,
    date_keywords: tuple[str, ...] = DATE_KEYWORDS,
) -> Column:
    """K8: number / date by keyword in the key name, else text."""
    key = F.col(key) if isinstance(key, str) else key

    def mentions(words: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | key.contains(word)
        return found

    return (
        F.when(mentions(numeric_keywords) & safe_double(value).isNotNull(), "number")
        .when(mentions(date_keywords), "date")
        .otherwise("text")
    )


def all_keys(kv: DataFrame) -> DataFrame:
    """Distinct key names, sorted."""
    return kv.select("key_name").distinct().orderBy("key_name")


def build_counts(kv: DataFrame) -> DataFrame:
    """Keys and values per document. Each key of a document has exactly one value 0."""
    return kv.groupBy("dataset", "doc_id").agg(
        F.count_if(F.col("value_pos") == 0).alias("keys_count"), F.count("*").alias("values_count")
    )


def batch_summary(counts: DataFrame, records: DataFrame) -> DataFrame:
    """Totals per dataset. A record without any key still succeeded, with zero counts."""
    totals = records.groupBy("dataset").agg(F.count("*").alias("total_records"))
    sums = counts.groupBy("dataset").agg(
        F.sum("keys_count").alias("total_keys"), F.sum("values_count").alias("total_values")
    )
    return totals.join(sums, "dataset", "left").select(
        "dataset",
        "total_records",
        F.col("total_records").alias("success"),
        F.lit(0).cast("bigint").alias("failed"),
        F.coalesce("total_keys", F.lit(0)).alias("total_keys"),
        F.coalesce("total_values", F.lit(0)).alias("total_values"),
    )


def extract_with_overrides(
    kv: DataFrame, extracted: DataFrame, records: DataFrame | None = None, mapping: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Add values found by an external extractor, ``extracted(doc_id, field, values)``.

    They replace what the same document holds under that key, as a later extraction would.
    With ``records`` a document needs no key-values of its own; ``mapping`` renames the fields
    as K1 and K2 do (strict drops unmapped ones; of a document's fields of one name the last
    in order wins).
    """
    found = skip_empty_lists(extracted).withColumn("original", F.col("field"))
    if mapping is not None:
        names = mapping.select(F.col("raw_field").alias("original"), "display_name")
        last = Window.partitionBy("doc_id", "field").orderBy(F.desc("original"))
        found = (
            found.join(names, "original", "inner" if strict else "left")
            .withColumn("field", F.coalesce("display_name", "field")).drop("display_name")
            .withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank")
        )
    kept = kv.join(
        found.select("doc_id", F.col("field").alias("key_name")).distinct(), ["doc_id", "key_name"], "left_anti"
    )
    if records is None:
        place = F.min(F.struct("dataset", "source_file", "record_index")).alias("_p")
        documents = kv.filter("value_pos = 0").groupBy("doc_id").agg(place).select("doc_id", "_p.*")
    else:
        documents = records.select(document_id("source_file", "record_index").alias("doc_id"), *_RECORD)
    new = (
        found.join(documents, "doc_id")
        .select("*", F.posexplode("values").alias("value_pos", "value"))
        .withColumn("is_repeat", F.array_position("values", F.col("value")) <= F.col("value_pos"))
        .withColumn("key_name", F.col("field"))
        .withColumn("field", F.col("original"))
        .withColumn("field_pos", F.lit(None).cast("int"))
        .drop("values")
    )
    return kept.unionByName(new.select(*kept.columns))
