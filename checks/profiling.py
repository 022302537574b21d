"""Queries over sources and field profiling, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import TABLES, melted_sql, records, scratch, table
from recordloom.operators import profile
from recordloom.plans.schema import analyze_schema
from recordloom.functions import iri_encode
from recordloom.sources import archive, readers, tables

PROFILED = ("customer", "supplier", "part", "nation", "orders")
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


_COUNTS = melted_sql(*PROFILED) + (
    ", vc AS (SELECT dataset, field, nullif(value, '') AS value, count(*) AS occurrences, min(record_index) AS first_index"
    " FROM melted GROUP BY ALL)"
)
_SAMPLES = (
    ", ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset, field ORDER BY occurrences DESC, first_index, value) AS rn"
    " FROM vc WHERE value IS NOT NULL),"
    " samples AS (SELECT dataset, field, list(value ORDER BY rn) AS samples FROM ranked WHERE rn <= 5 GROUP BY ALL)"
)
_LENGTHS = (
    ", lengths AS (SELECT dataset, field, count(value) AS unique_count,"
    " CAST(sum(CASE WHEN value IS NULL THEN 0 ELSE occurrences END) AS BIGINT) AS present,"
    " coalesce(min(length(value)), 0) AS min_length, coalesce(max(length(value)), 0) AS max_length,"
    " CAST(coalesce(sum(length(value) * occurrences) // nullif(sum(CASE WHEN value IS NULL THEN 0 ELSE occurrences END), 0), 0) AS INTEGER) AS avg_length"
    " FROM vc GROUP BY ALL)"
)


@query("read_json_lines", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def read_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    table(spark, sf, "customer").select(F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("value")).write.text(path)
    rows = readers.read_json_lines(spark, path, "customer")
    return rows.select(*[F.col("raw")[c].alias(c) for c in ("c_custkey", "c_name", "c_mktsegment")])


def _array_files(spark: SparkSession, sf: str) -> str:
    """The customers as JSON array files of a thousand objects each."""
    path = scratch(spark)
    chunk = F.floor(F.col("c_custkey") / 1000)
    (
        table(spark, sf, "customer")
        .groupBy(chunk.alias("chunk"))
        .agg(F.to_json(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal")))).alias("value"))
        .select("value")
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )
    return path


@query(
    "read_records",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_custkey % 1000 AS BIGINT) AS record_index FROM customer",
)
def read_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = readers.read_records(spark, _array_files(spark, sf), "customer")
    return rows.select(F.col("raw")["c_custkey"].alias("c_custkey"), F.col("raw")["c_name"].alias("c_name"), "record_index")


@query(
    "dataset_name",
    "SELECT regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '(.)\\.[^.]+$', '\\1') AS dataset, count(*) AS n FROM pages GROUP BY 1",
)
def dataset_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(readers.dataset_name(None, "url").alias("dataset")).agg(F.count("*").alias("n"))


@query(
    "records_from_table",
    f"WITH {melted_sql(*PROFILED)} SELECT dataset, record_index, field_pos, field, value FROM melted",
)
def records_from_table(spark: SparkSession, sf: str) -> DataFrame:
    return profile.melt(records(spark, sf, *PROFILED)).select("dataset", "record_index", "field_pos", "field", "value")


_ARCHIVE_SQL = (
    "SELECT 'customer' AS \"table\", 2024 AS \"year\", 1 AS \"month\", 30 AS \"day\","
    " count(DISTINCT c_custkey // 1000) AS files FROM customer"
)


@query("archive_raw", _ARCHIVE_SQL)
def archive_raw(spark: SparkSession, sf: str) -> DataFrame:
    at = F.lit("2024-01-30 10:00:00").cast("timestamp")
    stored = archive.archive_raw(spark, f"{_array_files(spark, sf)}/*.txt", scratch(spark), "customer", at)
    return stored.groupBy("table", "year", "month", "day").agg(F.count("*").alias("files"))


@query("load_raw", "SELECT max(n) AS records FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey // 1000)")
def load_raw(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark)
    at = F.lit("2024-01-30 10:00:00").cast("timestamp")
    archive.archive_raw(spark, f"{_array_files(spark, sf)}/*.txt", out, "customer", at)
    largest = F.max_by("storage_key", F.length("content"))
    key = spark.read.parquet(out).agg(largest).first()[0]
    content = archive.load_raw(spark, out, key).select(F.col("content").cast("string").alias("text"))
    return content.select(F.explode(F.from_json("text", "array<map<string,string>>"))).agg(F.count("*").alias("records"))


_UPSERT_SQL = (
    "SELECT c_custkey AS node_id, c_mktsegment AS dataset, CASE WHEN c_acctbal > 0 THEN 'new' ELSE 'old' END AS state FROM customer"
)


@query("upsert_nodes", _UPSERT_SQL)
def upsert_nodes(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("dataset"), F.lit("old").alias("state"), "c_acctbal"
    )
    tables.upsert(rows.drop("c_acctbal"), path, "node_id")
    fresh = rows.filter("c_acctbal > 0").withColumn("state", F.lit("new")).drop("c_acctbal")
    tables.upsert(fresh, path, "node_id")
    return spark.read.parquet(path)


@query(
    "write_triples",
    "SELECT '<http://example.org/kv#page/' || url_encode(url) || '> <http://example.org/kv#html> \"' ||"
    " replace(replace(replace(replace(replace(html, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    " || '\" .' AS \"value\" FROM pages",
)
def write_triples(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    triples = table(spark, sf, "pages").select(
        F.concat(F.lit("http://example.org/kv#page/"), iri_encode("url")).alias("s"),
        F.lit("http://example.org/kv#html").alias("p"),
        F.col("html").alias("o"),
        F.lit("literal").alias("o_kind"),
        F.lit(None).cast("string").alias("o_datatype"),
    )
    tables.write_triples(triples, path)
    return spark.read.text(f"{path}/ntriples")


@query("delete_nodes", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_nodes(spark: SparkSession, sf: str) -> DataFrame:
    bad = table(spark, sf, "labels").filter("toxic = 1")
    return tables.delete_nodes(table(spark, sf, "documents"), bad, "doc_id").select("doc_id", "lang")


@query("field_union", f"WITH {melted_sql(*PROFILED)} SELECT DISTINCT dataset, field FROM melted")
def field_union(spark: SparkSession, sf: str) -> DataFrame:
    return profile.field_union(records(spark, sf, *PROFILED))


@query(
    "field_statistics",
    f"WITH {_COUNTS}{_SAMPLES}{_LENGTHS}, totals AS (SELECT dataset, count(*) AS total_count FROM"
    " (SELECT DISTINCT dataset, record_index FROM melted) GROUP BY dataset)"
    " SELECT dataset, field, total_count, unique_count, total_count - present AS null_count,"
    " round((total_count - present) / total_count, 3) AS null_ratio, array_to_string(samples, '|') AS samples,"
    " min_length, max_length, avg_length FROM lengths JOIN totals USING (dataset) JOIN samples USING (dataset, field)",
)
def field_statistics(spark: SparkSession, sf: str) -> DataFrame:
    stats = profile.field_statistics(records(spark, sf, *PROFILED))
    lengths = F.col("value_lengths")
    return stats.select(
        "dataset", "field", "total_count", "unique_count", "null_count", "null_ratio",
        F.array_join("samples", "|").alias("samples"),
        lengths["min"].alias("min_length"), lengths["max"].alias("max_length"), lengths["avg"].alias("avg_length"),
    )


@query(
    "field_statistics_nulls",
    "WITH j AS (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),"
    " m AS (SELECT 'lang' AS field, CAST(lang AS VARCHAR) AS v FROM j UNION ALL SELECT 'quality', CAST(quality AS VARCHAR) FROM j"
    " UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR) FROM j)"
    " SELECT field, count(*) AS total_count, count(DISTINCT v) AS unique_count, count(*) - count(v) AS null_count,"
    " round((count(*) - count(v)) / count(*), 3) AS null_ratio FROM m GROUP BY field",
)
def field_statistics_nulls(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = readers.records_from_table(joined, "labelled", "doc_id", ["lang", "quality", "toxic"])
    return profile.field_statistics(rows).select("field", "total_count", "unique_count", "null_count", "null_ratio")


@query(
    "top_samples",
    f"WITH {_COUNTS}{_SAMPLES} SELECT dataset, field, array_to_string(samples, '|') AS samples FROM samples",
)
def top_samples(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_samples(records(spark, sf, *PROFILED)).withColumn("samples", F.array_join("samples", "|"))


@query(
    "value_lengths",
    f"WITH {_COUNTS}{_LENGTHS} SELECT dataset, field, min_length, max_length, avg_length FROM lengths",
)
def value_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_lengths(records(spark, sf, *PROFILED))


def _sample_sql(name: str) -> str:
    return (
        f"SELECT '{name}' AS dataset, record_index FROM (SELECT row_number() OVER (ORDER BY {TABLES[name][0]}) - 1 AS record_index,"
        f" count(*) OVER () AS n FROM {name}) WHERE n <= 7 OR (record_index % (n // 7) = 0 AND record_index < (n // 7) * 7)"
    )


@query("systematic_sample", " UNION ALL ".join(_sample_sql(n) for n in (*PROFILED, "region")))
def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    return profile.systematic_sample(records(spark, sf, *PROFILED, "region"), 7).select("dataset", "record_index")


@query(
    "sample_two_files",
    "WITH p AS (SELECT 'customer' AS source_file, row_number() OVER (ORDER BY c_custkey) - 1 AS record_index FROM customer"
    " UNION ALL SELECT 'supplier', row_number() OVER (ORDER BY s_suppkey) - 1 FROM supplier),"
    " n AS (SELECT *, row_number() OVER (ORDER BY source_file, record_index) - 1 AS pos, count(*) OVER () AS n FROM p)"
    " SELECT source_file, record_index FROM n WHERE n <= 7 OR (pos % (n // 7) = 0 AND pos < (n // 7) * 7)",
)
def sample_two_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf, "customer", "supplier").withColumn("dataset", F.lit("people"))
    return profile.systematic_sample(rows, 7).select("source_file", "record_index")


@query(
    "merged_fields",
    f"WITH {melted_sql('customer', 'supplier')}, m AS (SELECT dataset, record_index, CASE WHEN field IN ('c_name', 'c_mktsegment') THEN 'label' ELSE field END AS field,"
    " nullif(value, '') AS v FROM melted), t AS (SELECT dataset, count(DISTINCT record_index) AS total_count FROM m GROUP BY dataset)"
    " SELECT dataset, field, total_count, count(DISTINCT v) AS unique_count, greatest(total_count - count(v), 0) AS null_count"
    " FROM m JOIN t USING (dataset) GROUP BY dataset, field, total_count",
)
def merged_fields(spark: SparkSession, sf: str) -> DataFrame:
    mapping = spark.createDataFrame([("c_name", "label"), ("c_mktsegment", "label")], "raw_field string, display_name string")
    stats = profile.field_statistics(records(spark, sf, "customer", "supplier"), mapping=mapping)
    return stats.select("dataset", "field", "total_count", "unique_count", "null_count")


_TYPED = ("customer", "part", "orders", "documents", "pages")
_TYPE_CASE = (
    "CASE WHEN len(samples) = 0 THEN 'text' WHEN regexp_matches(samples[1], '^https?://') THEN 'url'"
    " WHEN contains(samples[1], '@') AND contains(samples[1], '.') THEN 'email'"
    " {first} {second}"
    " WHEN len(list_filter(samples[1:3], lambda s: NOT regexp_matches(s, '^[\\d.,]+$'))) = 0 THEN 'number'"
    " WHEN regexp_matches(samples[1], '[시구동로길]') THEN 'address' ELSE 'text' END"
)
_PHONE = "WHEN regexp_matches(samples[1], '^[\\d\\-\\s\\(\\)]+$') AND length(samples[1]) >= 9 THEN 'phone'"
_DATE = "WHEN regexp_matches(samples[1], '^\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}') THEN 'date'".replace("{{", "{").replace("}}", "}")
_TYPE_SQL = _TYPE_CASE.replace("{first}", _PHONE).replace("{second}", _DATE)
_STRICT_SQL = _TYPE_CASE.replace("{first}", _DATE).replace("{second}", _PHONE)
_TYPED_SAMPLES = (
    melted_sql(*_TYPED)
    + ", vc AS (SELECT dataset, field, nullif(value, '') AS value, count(*) AS occurrences, min(record_index) AS first_index"
    " FROM melted GROUP BY ALL)" + _SAMPLES
)


@query(
    "infer_data_type",
    f"WITH {_TYPED_SAMPLES} SELECT dataset, field, {_TYPE_SQL} AS data_type, {_STRICT_SQL} AS strict_type FROM samples",
)
def infer_data_type(spark: SparkSession, sf: str) -> DataFrame:
    samples = profile.top_samples(records(spark, sf, *_TYPED))
    return samples.select(
        "dataset", "field",
        profile.infer_data_type("samples").alias("data_type"),
        profile.infer_data_type("samples", strict_dates=True).alias("strict_type"),
    )


@query(
    "auto_fields",
    f"WITH {_TYPED_SAMPLES}, t AS (SELECT dataset, field, {_TYPE_SQL} AS data_type FROM samples)"
    " SELECT dataset, field, CASE WHEN field = 'url' THEN 'Address of the page' ELSE replace(field, '_', ' ') END AS display_name,"
    " '자동 생성된 필드 (타입: ' || data_type || ')' AS description, data_type FROM t",
)
def auto_fields(spark: SparkSession, sf: str) -> DataFrame:
    given = spark.createDataFrame(
        [("pages", "url", "Address of the page", None, None)],
        "dataset string, field string, display_name string, description string, data_type string",
    )
    return profile.auto_fields(profile.field_statistics(records(spark, sf, *_TYPED)), given)


@query(
    "long_text_fields",
    f"WITH {melted_sql('documents', 'pages', 'customer')}"
    " SELECT 'average' AS mode, dataset, field FROM melted WHERE value <> '' GROUP BY dataset, field HAVING sum(length(value)) // count(*) > 500"
    " UNION ALL SELECT 'longest', dataset, field FROM melted GROUP BY dataset, field HAVING max(length(value)) > 5000",
)
def long_text_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf, "documents", "pages", "customer")
    average = profile.long_text_fields(stats=profile.field_statistics(rows), context="schema_analysis")
    longest = profile.long_text_fields(records=rows, context="key_value_extract")
    return average.select(F.lit("average").alias("mode"), "*").unionByName(longest.select(F.lit("longest").alias("mode"), "*"))


_CUT = "CASE WHEN {when} THEN left({c}, {p}) || chr(10) || '...(중략)...' || chr(10) || right({c}, {s}) ELSE {c} END"


@query(
    "truncate_long_text",
    "SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, "
    + _CUT.format(c="text", when="length(text) > 300", p=200, s=100)
    + " AS t FROM documents)",
)
def truncate_long_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf, "documents")
    long = profile.long_text_fields(stats=profile.field_statistics(rows), context="schema_analysis")
    return _digest(profile.truncate_long_text(rows, long, "schema_analysis"))


@query(
    "truncate_auto",
    "SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, "
    + _CUT.format(c="text", when="length(text) > 5000", p=2000, s=1000)
    + " AS t FROM documents)",
)
def truncate_auto(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(profile.truncate_auto(records(spark, sf, "documents"), "key_value_extract"))


def _digest(rows: DataFrame) -> DataFrame:
    text = F.col("raw")["text"]
    return rows.select(F.col("raw")["doc_id"].cast("bigint").alias("doc_id"), F.length(text).alias("n"), F.md5(text).alias("digest"))


@query(
    "analyze_schema",
    f"WITH {_COUNTS}{_SAMPLES}, t AS (SELECT dataset, field, {_TYPE_SQL} AS data_type FROM samples),"
    " n AS (SELECT dataset, count(DISTINCT record_index) AS analyzed_count FROM melted GROUP BY dataset)"
    " SELECT dataset, dataset AS \"domain\", dataset AS centrality_name, CAST(0 AS DOUBLE) AS confidence, '' AS notes, analyzed_count, field,"
    " replace(field, '_', ' ') AS display_name, '자동 생성된 필드 (타입: ' || data_type || ')' AS description, data_type FROM t JOIN n USING (dataset)",
)
def schema_report(spark: SparkSession, sf: str) -> DataFrame:
    report = analyze_schema(records(spark, sf, *PROFILED))
    named = ["dataset", "domain", "centrality_name", "confidence", "notes", "analyzed_count"]
    return report.select(*named, F.explode("fields").alias("field", "f")).select(*named, "field", "f.display_name", "f.description", "f.data_type")
