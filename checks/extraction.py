"""Queries over key-value extraction and graph tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import key_values, kv_sql, melted_sql, records, table, values_sql
from recordloom.functions import escape_literal, iri_encode
from recordloom.operators import extract, graph, label, profile
from recordloom.plans.workflow import build_graph
from recordloom.sources.readers import parse_json_object

QUERIES, SQL = {}, {}
_NS = graph.NAMESPACE
_RDF = graph.RDF


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


# Two fields of customers share a display name, so the later one wins.
_MAPPING = [
    ("c_name", "customer name"), ("c_nationkey", "area"), ("c_mktsegment", "area"), ("s_name", "supplier name"),
    ("p_size", "병상수"), ("o_orderdate", "주문일자"), ("o_totalprice", "총면적"), ("o_orderstatus", "상태 수"),
]
_MAPPING_SQL = f"mapping(raw_field, display_name) AS ({values_sql(_MAPPING)})"


def _mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_MAPPING, "raw_field string, display_name string")


def _melted(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    kv = extract.with_document_id(extract.drop_blank(profile.melt(records(spark, sf, *names))))
    return kv.withColumn("key_name", F.col("field"))


@query(
    "map_keys_strict",
    f"WITH {melted_sql('customer', 'supplier')}, {_MAPPING_SQL}, j AS (SELECT dataset, record_index, display_name AS key_name, value, field_pos"
    " FROM melted JOIN mapping ON field = raw_field)"
    " SELECT dataset, record_index, key_name, arg_max(value, field_pos) AS value FROM j GROUP BY ALL",
)
def map_keys_strict(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.map_keys(_melted(spark, sf, "customer", "supplier"), _mapping(spark), strict=True)
    return rows.select("dataset", "record_index", "key_name", "value")


@query(
    "map_keys_lenient",
    f"WITH {melted_sql('customer', 'supplier')}, {_MAPPING_SQL}, j AS (SELECT dataset, record_index, coalesce(display_name, field) AS key_name,"
    " field, value, field_pos FROM melted LEFT JOIN mapping ON field = raw_field)"
    " SELECT dataset, record_index, key_name, arg_max(field, field_pos) AS original, arg_max(value, field_pos) AS value FROM j"
    " GROUP BY dataset, record_index, key_name",
)
def map_keys_lenient(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.map_keys(_melted(spark, sf, "customer", "supplier"), _mapping(spark))
    return rows.select("dataset", "record_index", "key_name", F.col("field").alias("original"), "value")


@query(
    "merge_mappings",
    "SELECT DISTINCT p_name AS raw_field, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size > 45) THEN upper(p_name)"
    " ELSE 'part ' || p_name END AS display_name FROM part",
)
def merge_mappings(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    fields = part.select(F.col("p_name").alias("raw_field"), F.concat(F.lit("part "), "p_name").alias("display_name")).distinct()
    extra = part.filter("p_size > 45").select(F.col("p_name").alias("raw_field"), F.upper("p_name").alias("display_name")).distinct()
    return extract.merge_mappings(fields, extra)


@query(
    "drop_blank",
    "SELECT conv_id, turn, role, md5(v) AS digest FROM (SELECT conv_id, turn, role, regexp_replace(regexp_replace("
    "CASE WHEN role = 'system' THEN '  ' || chr(9) WHEN turn = 1 THEN NULL ELSE ' ' || text || chr(10) END, '^\\s+', ''), '\\s+$', '') AS v"
    " FROM conversations) WHERE v IS NOT NULL AND v <> ''",
)
def drop_blank(spark: SparkSession, sf: str) -> DataFrame:
    value = (
        F.when(F.col("role") == "system", F.lit("  \t"))
        .when(F.col("turn") == 1, F.lit(None))
        .otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    )
    rows = extract.drop_blank(table(spark, sf, "conversations").withColumn("value", value))
    return rows.select("conv_id", "turn", "role", F.md5("value").alias("digest"))


@query(
    "split_multi",
    "WITH l AS (SELECT p_partkey, list_filter(list_transform(string_split(p_name || ', ' || p_type || ' ,,' || p_type, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM part)"
    " SELECT p_partkey, CAST(pos - 1 AS INTEGER) AS value_pos, parts[pos] AS value, list_position(parts, parts[pos]) < pos AS is_repeat"
    " FROM (SELECT p_partkey, parts, unnest(range(1, len(parts) + 1)) AS pos FROM l)"
    " UNION ALL SELECT p_partkey, 0, p_brand || ',' || p_type, false FROM part",
)
def split_multi(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    tags = part.select("p_partkey", F.lit("tags").alias("key_name"), F.concat("p_name", F.lit(", "), "p_type", F.lit(" ,,"), "p_type").alias("value"))
    whole = part.select("p_partkey", F.lit("code").alias("key_name"), F.concat("p_brand", F.lit(","), "p_type").alias("value"))
    return extract.split_multi(tags.unionByName(whole), ["tags"]).drop("key_name")


@query(
    "skip_empty_lists",
    "SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
)
def skip_empty_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = table(spark, sf, "conversations").select(
        "conv_id", F.filter(F.array("role"), lambda r: r == "assistant").alias("values")
    )
    return extract.skip_empty_lists(lists).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("document_id", "SELECT o_orderkey, printf('orders_%04d', row_number() OVER (ORDER BY o_orderkey) - 1) AS doc_id FROM orders")
def document_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf, "orders")
    return rows.select(
        F.col("raw")["o_orderkey"].cast("bigint").alias("o_orderkey"), extract.document_id("source_file", "record_index").alias("doc_id")
    )


@query(
    "infer_value_type",
    f"WITH {melted_sql('part', 'orders')}, {_MAPPING_SQL} SELECT dataset, record_index, field, CASE"
    " WHEN regexp_matches(k, '수|면적|좌표|위도|경도') AND try_cast(value AS DOUBLE) IS NOT NULL THEN 'number'"
    " WHEN regexp_matches(k, '일자|날짜') THEN 'date' ELSE 'text' END AS value_type"
    " FROM (SELECT *, coalesce(display_name, field) AS k FROM melted LEFT JOIN mapping ON field = raw_field)",
)
def infer_value_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.map_keys(_melted(spark, sf, "part", "orders"), _mapping(spark))
    return rows.select("dataset", "record_index", "field", extract.infer_value_type("key_name", "value").alias("value_type"))


@query(
    "parse_json_records",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS fields, CASE WHEN event_id % 3 = 0 THEN NULL"
    " ELSE json_extract_string(props, '$.k') END AS k FROM events",
)
def parse_json_records(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    raw = parse_json_object(text)
    return table(spark, sf, "events").select("event_id", F.size(raw).alias("fields"), F.try_element_at(raw, F.lit("k")).alias("k"))


@query("all_keys", f"WITH {kv_sql('customer', 'supplier', 'part', 'orders')} SELECT DISTINCT key_name FROM kv")
def all_keys(spark: SparkSession, sf: str) -> DataFrame:
    return extract.all_keys(key_values(spark, sf, "customer", "supplier", "part", "orders"))


@query(
    "build_counts",
    f"WITH {kv_sql('customer', 'part')} SELECT dataset, doc_id, count(DISTINCT key_name) AS keys_count, count(*) AS values_count FROM kv GROUP BY ALL",
)
def build_counts(spark: SparkSession, sf: str) -> DataFrame:
    return extract.build_counts(key_values(spark, sf, "customer", "part"))


@query(
    "batch_summary",
    f"WITH {kv_sql('customer', 'part', 'orders')} SELECT dataset, count(DISTINCT doc_id) AS total_records, count(DISTINCT doc_id) AS success,"
    " CAST(0 AS BIGINT) AS failed, count(DISTINCT (doc_id, key_name)) AS total_keys, count(*) AS total_values FROM kv GROUP BY dataset",
)
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf, "customer", "part", "orders")
    return extract.batch_summary(extract.build_counts(extract.extract(rows)), rows)


@query(
    "extract_with_overrides",
    f"WITH {kv_sql('part')}, w AS (SELECT printf('part_%04d', row_number() OVER (ORDER BY p_partkey) - 1) AS doc_id, string_split(p_name, ' ') AS words FROM part)"
    " SELECT doc_id, key_name, value, CAST(0 AS INTEGER) AS value_pos FROM kv WHERE key_name <> 'p_name'"
    " UNION ALL SELECT doc_id, 'p_name', words[pos], CAST(pos - 1 AS INTEGER) FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM w)",
)
def extract_with_overrides(spark: SparkSession, sf: str) -> DataFrame:
    kv = key_values(spark, sf, "part")
    found = kv.filter("key_name = 'p_name'").select("doc_id", F.lit("p_name").alias("field"), F.split("value", " ").alias("values"))
    return extract.extract_with_overrides(kv, found).select("doc_id", "key_name", "value", "value_pos")


@query(
    "extract_without_keys",
    f"WITH {kv_sql('customer')}, r AS (SELECT printf('customer_%04d', row_number() OVER (ORDER BY c_custkey) - 1) AS doc_id, c_mktsegment, c_name FROM customer)"
    " SELECT doc_id, key_name, value, CAST(0 AS INTEGER) AS value_pos FROM kv WHERE record_index % 2 = 0"
    " UNION ALL SELECT doc_id, 'segment', c_mktsegment, 0 FROM r UNION ALL SELECT doc_id, 'segment', c_name, 1 FROM r",
)
def extract_without_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold no key-values get the extracted ones too, under their display name."""
    rows = records(spark, sf, "customer")
    raw = F.col("raw")
    found = rows.select(
        extract.document_id("source_file", "record_index").alias("doc_id"), F.lit("c_mktsegment").alias("field"),
        F.array(raw["c_mktsegment"], raw["c_name"]).alias("values"),
    )
    mapping = spark.createDataFrame([("c_mktsegment", "segment")], "raw_field string, display_name string")
    kv = extract.extract(rows).filter("record_index % 2 = 0")
    return extract.extract_with_overrides(kv, found, rows, mapping).select("doc_id", "key_name", "value", "value_pos")


# --- graph -----------------------------------------------------------------------------

_GRAPH = ("customer", "supplier", "part")
_T = "'" + _RDF + "type'"


def _enc(expr: str) -> str:
    return f"url_encode({expr})"


def _uri(s: str, p: str, o: str) -> str:
    return f"SELECT {s} AS s, {p} AS p, {o} AS o, 'uri' AS o_kind, '' AS o_datatype"


def _lit(s: str, p: str, o: str, t: str = "''") -> str:
    return f"SELECT {s} AS s, {p} AS p, {o} AS o, 'literal' AS o_kind, {t} AS o_datatype"


def _node(kind: str, expr: str) -> str:
    return f"'{_NS}{kind}/' || {_enc(expr)}"


_CENTRAL = f"'{_NS}centrality/trade%20data'"
_SQL_CENTRAL = " UNION ALL ".join(
    [
        _uri(_CENTRAL, _T, f"'{_NS}Centrality'"),
        _lit(_CENTRAL, f"'{_NS}name'", "'trade data'"),
        f"SELECT DISTINCT {_CENTRAL}, '{_NS}hasKey', {_node('key', 'key_name')}, 'uri', '' FROM kv",
    ]
)
_SQL_KEYS = " UNION ALL ".join(
    [
        _uri(_node("key", "key_name"), _T, f"'{_NS}Key'") + " FROM k",
        _lit(_node("key", "key_name"), f"'{_NS}keyName'", "key_name") + " FROM k",
    ]
)
_DOC = _node("document", "doc_id")
_SQL_DOCS = " UNION ALL ".join(
    [
        _uri(_DOC, _T, f"'{_NS}Document'") + " FROM d",
        _lit(_DOC, f"'{_NS}documentId'", "doc_id") + " FROM d",
        _lit(_DOC, f"'{_NS}sourceFile'", "dataset") + " FROM d",
        _lit(_DOC, f"'{_NS}recordIndex'", "CAST(record_index AS VARCHAR)", f"'{graph.XSD}integer'") + " FROM d",
        _lit(_DOC, f"'{_NS}tableName'", "dataset") + " FROM d",
    ]
)
_VAL = _node("value", "value_id")
_SQL_VALUES = " UNION ALL ".join(
    [
        _uri(_VAL, _T, f"'{_NS}Value'") + " FROM v",
        _lit(_VAL, f"'{_NS}valueId'", "value_id") + " FROM v",
        _lit(_VAL, f"'{_NS}valueContent'", "value") + " FROM v",
        _lit(_VAL, f"'{_NS}valueType'", "'text'") + " FROM v",
        _uri(_node("key", "key_name"), f"'{_NS}hasValue'", _VAL) + " FROM v",
        _uri(_VAL, f"'{_NS}extractedFrom'", _DOC) + " FROM v",
    ]
)
_CTES = (
    f"WITH {kv_sql(*_GRAPH)}, k AS (SELECT DISTINCT key_name FROM kv), d AS (SELECT DISTINCT dataset, record_index, doc_id FROM kv),"
    " v AS (SELECT *, doc_id || '_' || key_name || '_' || value AS value_id FROM kv) "
)


def _graph(spark: SparkSession, sf: str):
    return build_graph(records(spark, sf, *_GRAPH), "trade", "trade data")


def _flat(triples: DataFrame) -> DataFrame:
    return triples.withColumn("o_datatype", F.coalesce("o_datatype", F.lit("")))


@query("centrality_triples", f"WITH {kv_sql(*_GRAPH)} {_SQL_CENTRAL}")
def centrality_triples(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(graph.centrality_triples(key_values(spark, sf, *_GRAPH), "trade data"))


@query("document_triples", _CTES + _SQL_DOCS)
def document_triples(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(graph.document_triples(_graph(spark, sf).documents))


@query("key_triples", _CTES + _SQL_KEYS)
def key_triples(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(graph.key_triples(_graph(spark, sf).keys))


@query("value_triples", _CTES + _SQL_VALUES)
def value_triples(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(graph.value_triples(_graph(spark, sf).values))


@query("graph_triples", f"{_CTES} SELECT * FROM ({_SQL_CENTRAL} UNION ALL {_SQL_KEYS} UNION ALL {_SQL_DOCS} UNION ALL {_SQL_VALUES})")
def graph_triples(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_graph(spark, sf).triples())


@query(
    "triple_set",
    f"SELECT DISTINCT 'order' AS s, 'status' AS p, o_orderstatus || o_orderpriority AS o, 'literal' AS o_kind, '' AS o_datatype FROM orders",
)
def triple_set(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        F.lit("order").alias("s"), F.lit("status").alias("p"), F.concat("o_orderstatus", "o_orderpriority").alias("o"),
        F.lit("literal").alias("o_kind"), F.lit("").alias("o_datatype"),
    )
    return graph.triple_set(rows)


_FIRST = (
    "f AS (SELECT key_name, min(dataset) AS dataset FROM kv GROUP BY 1), g AS (SELECT kv.key_name, kv.dataset, min(record_index) AS record_index"
    " FROM kv JOIN f USING (key_name, dataset) GROUP BY ALL), h AS (SELECT kv.* FROM kv JOIN g USING (key_name, dataset, record_index))"
)


@query(
    "key_registry",
    f"WITH {kv_sql(*_GRAPH)}, {_FIRST} SELECT sha256(key_name) AS key_id, key_name, key_name AS original_key_name, dataset, record_index, value AS samples FROM h",
)
def key_registry(spark: SparkSession, sf: str) -> DataFrame:
    keys = graph.key_registry(key_values(spark, sf, *_GRAPH))
    return keys.withColumn("samples", F.array_join("sample_values", "|")).drop("sample_values", "value_count", "phone_count", "quantity_count")


@query(
    "key_registry_two_files",
    f"WITH {kv_sql('customer', 'supplier')}, k AS (SELECT regexp_replace(key_name, '^[cs]_', '') AS key_name, key_name AS field, dataset AS source_file, record_index, value FROM kv)"
    " SELECT key_name, field AS original_key_name, record_index, value AS samples FROM k QUALIFY row_number() OVER (PARTITION BY key_name ORDER BY source_file, record_index) = 1",
)
def key_registry_two_files(spark: SparkSession, sf: str) -> DataFrame:
    kv = key_values(spark, sf, "customer", "supplier").withColumn("dataset", F.lit("people"))
    keys = graph.key_registry(kv.withColumn("key_name", F.regexp_replace("key_name", "^[cs]_", "")))
    return keys.select("key_name", "original_key_name", "record_index", F.array_join("sample_values", "|").alias("samples"))


_TYPE_CASE = (
    "CASE WHEN try_cast(replace({v}, ',', '') AS DOUBLE) IS NOT NULL OR regexp_matches({v}, '^\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}')"
    " THEN 'numeric_date' WHEN key_name IN ('p_name', 'c_name') THEN 'proper_noun' ELSE 'semantic' END"
)


@query(
    "classify_keys",
    f"WITH {kv_sql(*_GRAPH, 'orders')}, {_FIRST}, t AS (SELECT key_name, {_TYPE_CASE.format(v='value')} AS key_type FROM h)"
    " SELECT key_name, CASE WHEN key_name = 'p_brand' THEN 'proper_noun' ELSE key_type END AS key_type,"
    " CASE WHEN key_name = 'p_brand' THEN 0.75 WHEN key_type = 'semantic' THEN 0.5 ELSE 0.9 END AS key_type_confidence FROM t",
)
def classify_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = graph.key_registry(key_values(spark, sf, *_GRAPH, "orders"))
    taxonomy = spark.createDataFrame([("p_name", "tool"), ("c_name", "client")], "key_name string, label string")
    given = spark.createDataFrame([("p_brand", "proper_noun", 0.75)], "key_name string, field_type string, confidence double")
    return label.classify_keys(keys, taxonomy, given).select("key_name", "key_type", "key_type_confidence")


@query(
    "value_index",
    f"WITH {kv_sql(*_GRAPH)}, {_FIRST}, t AS (SELECT key_name, CASE WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN 'numeric_date' ELSE 'semantic' END AS key_type FROM h)"
    " SELECT doc_id || '_' || key_name || '_' || value AS value_id, doc_id, dataset, sha256(key_name) AS key_id, key_name, key_type,"
    " value AS value_content, CAST(0 AS INTEGER) AS value_pos, 'text' AS value_type,"
    " CASE WHEN key_type = 'numeric_date' THEN try_cast(value AS DOUBLE) END AS numeric_value FROM kv JOIN t USING (key_name)",
)
def value_index(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).values.drop("is_repeat")


@query(
    "document_index",
    "SELECT printf('nation_%04d', row_number() OVER (ORDER BY n_nationkey) - 1) AS doc_id, 'nation' AS dataset, 'geo' AS \"domain\", 'nations' AS centrality,"
    " '{\"n_nationkey\":\"' || n_nationkey || '\",\"n_name\":\"' || n_name || '\",\"n_regionkey\":\"' || n_regionkey || '\"}' AS \"content\" FROM nation"
    " UNION ALL SELECT printf('customer_%04d', row_number() OVER (ORDER BY c_custkey) - 1), 'customer', 'geo', 'nations',"
    " '{\"c_custkey\":\"' || c_custkey || '\",\"c_name\":\"' || c_name || '\",\"c_nationkey\":\"' || c_nationkey || '\",\"c_acctbal\":\"' ||"
    " CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '\",\"c_mktsegment\":\"' || c_mktsegment || '\"}' FROM customer",
)
def document_index(spark: SparkSession, sf: str) -> DataFrame:
    return graph.document_index(records(spark, sf, "nation", "customer"), "geo", "nations").drop("source_file", "record_index")


@query(
    "graph_counts",
    f"WITH {kv_sql(*_GRAPH)} SELECT 'Document' AS node_type, count(DISTINCT doc_id) AS nodes FROM kv UNION ALL"
    " SELECT 'Key', count(DISTINCT key_name) FROM kv UNION ALL SELECT 'Value', count(*) FROM kv",
)
def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_counts(_graph(spark, sf).triples())


@query(
    "values_of_key",
    f"{_CTES} SELECT {_node('key', 'key_name')} AS key, {_VAL} AS \"value\", {_DOC} AS document FROM v",
)
def values_of_key(spark: SparkSession, sf: str) -> DataFrame:
    return graph.values_of_key(_graph(spark, sf).triples())


@query(
    "get_document",
    "SELECT 'customer_0007' AS id, 'customer_0007' AS document_id, 'customer' AS table_name, '7' AS record_index"
    " FROM customer WHERE c_custkey = (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 7)",
)
def get_document(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.get_document(_graph(spark, sf).triples(), "customer_0007")
    p = F.col("properties")
    return found.select("id", p["documentId"].alias("document_id"), p["tableName"].alias("table_name"), p["recordIndex"].alias("record_index"))


def _order_relations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.concat(F.lit("customer_"), "o_custkey").alias("src_doc"),
        F.concat(F.lit("status "), "o_orderstatus").alias("dst_doc"),
        F.when(F.col("o_orderstatus") == "F", "REFERENCES").otherwise("RELATED_TO").alias("relation_type"),
        F.round(F.col("o_totalprice") / 1000000, 4).alias("score"),
        F.lit("rule").alias("method"),
        F.concat(F.lit('says "'), "o_orderpriority", F.lit('"')).alias("reason"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") % 86400)).alias("created_at"),
        "o_orderkey",
    )


_RELATIONS_SQL = (
    "r AS (SELECT 'customer_' || o_custkey AS src_doc, 'status ' || o_orderstatus AS dst_doc, CASE WHEN o_orderstatus = 'F' THEN 'REFERENCES'"
    " ELSE 'RELATED_TO' END AS relation_type, round(o_totalprice / 1000000, 4) AS score, 'says \"' || o_orderpriority || '\"' AS reason,"
    " o_orderdate + to_seconds(o_orderkey % 86400) AS created_at, o_orderkey FROM orders)"
)


@query(
    "document_relations",
    f"WITH {_RELATIONS_SQL} SELECT '{_NS}' || {_enc('src_doc')} AS s, '{_NS}' || relation_type AS p, '{_NS}' || {_enc('dst_doc')} AS o, 'uri' AS o_kind FROM r"
    f" UNION ALL SELECT '{_NS}' || {_enc('src_doc')}, '{_NS}hasRelationReason', reason, 'literal' FROM r",
)
def document_relations(spark: SparkSession, sf: str) -> DataFrame:
    triples = graph.document_relations(_order_relations(spark, sf))
    return triples.filter(~F.col("p").endswith("Confidence")).drop("o_datatype")


_NEWEST = f"{_RELATIONS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY src_doc, dst_doc ORDER BY created_at DESC) AS rn FROM r)"


@query(
    "upsert_relations",
    f"WITH {_NEWEST} SELECT 'docrelation/' || src_doc || '--' || dst_doc AS rel_id, relation_type, score, reason, created_at FROM n WHERE rn = 1",
)
def upsert_relations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _order_relations(spark, sf)
    merged = graph.upsert_relations(rows.filter("o_orderkey < 5000"), rows.filter("o_orderkey >= 5000"))
    return merged.select("rel_id", "relation_type", "score", "reason", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(
    "relation_triples",
    f"WITH {_NEWEST} SELECT '{_NS}docrelation/' || {_enc('src_doc')} || '--' || {_enc('dst_doc')} AS s, p, count(*) AS n FROM n,"
    " (SELECT unnest(['type','subject','predicate','object','relationType','relationScore','relationMethod','relationReason','createdAt']) AS p)"
    " WHERE rn = 1 GROUP BY ALL",
)
def relation_triples(spark: SparkSession, sf: str) -> DataFrame:
    triples = graph.relation_triples(graph.upsert_relations(None, _order_relations(spark, sf)))
    return triples.groupBy("s", F.regexp_extract("p", r"#(\w+)$", 1).alias("p")).agg(F.count("*").alias("n"))


@query(
    "edges",
    f"{_CTES} SELECT key_name AS src, 'HAS_VALUE' AS predicate, value_id AS dst FROM v UNION ALL SELECT value_id, 'EXTRACTED_FROM', doc_id FROM v"
    " UNION ALL SELECT doc_id, 'HAS_KEY', key_name FROM v UNION ALL"
    " SELECT value_id, 'SAME_AS', 'p_type:normalized:' || lower(value) FROM v WHERE key_name = 'p_type'",
)
def edges(spark: SparkSession, sf: str) -> DataFrame:
    values = _graph(spark, sf).values
    lower = F.lower("value_content")
    links = (
        values.filter("key_name = 'p_type'")
        .select("key_name", F.col("value_content").alias("value"), F.concat(F.lit("p_type:normalized:"), lower).alias("norm_id"))
        .distinct()
    )
    return graph.edges(values, links)


@query(
    "iri_and_literal",
    "SELECT doc_id, md5(url_encode(text)) AS iri, md5(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'),"
    " chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) AS \"literal\" FROM documents",
)
def iri_and_literal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(iri_encode("text")).alias("iri"), F.md5(escape_literal("text")).alias("literal")
    )
