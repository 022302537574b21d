"""Graph tables and triples from key-value rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import iri_encode, safe_double
from recordloom.operators.extract import document_id, infer_value_type
from recordloom.operators.normalize import parse_number
from recordloom.sources.tables import latest_by_id

NAMESPACE = "http://example.org/kv#"

# Public RDF and XML Schema names.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
XSD = "http://www.w3.org/2001/XMLSchema#"

_MAX_SAMPLES = 5


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def key_registry(kv: DataFrame) -> DataFrame:
    """One row per key; its first record gives the original name and up to 5 samples.

    The first record is that of the smallest (dataset, source_file, record_index). Counts of
    all, phone-like and number- or date-like values cover every value of the key and combine
    before the shuffle. Only the rows of the first records are read again; the pool of one key
    is never gathered.
    """
    value = F.col("value")
    phone = value.rlike(r"^\(?\d[\d\s()]*[-\s)][\d\-\s()]*$") & ~value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & (F.length(value) >= 9)
    quantity = parse_number(value).isNotNull() | value.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}")
    first = kv.groupBy("key_name", "dataset", "source_file").agg(
        F.min("record_index").alias("record_index"), F.count("value").alias("n"),
        F.count_if(phone).alias("phones"), F.count_if(quantity).alias("quantities"),
    ).groupBy("key_name").agg(
        F.min(F.struct("dataset", "source_file", "record_index")).alias("_f"), F.sum("n").alias("value_count"),
        F.sum("phones").alias("phone_count"), F.sum("quantities").alias("quantity_count"),
    )
    counts = first.select("key_name", "value_count", "phone_count", "quantity_count")
    first = first.select("key_name", "_f.dataset", "_f.source_file", "_f.record_index")
    rows = kv.filter(F.col("value_pos") < _MAX_SAMPLES).join(first, ["key_name", "dataset", "source_file", "record_index"], "left_semi")
    return rows.groupBy("key_name").agg(
        F.min("field").alias("original_key_name"),
        F.min("dataset").alias("dataset"),
        F.min("record_index").alias("record_index"),
        F.transform(F.array_sort(F.collect_list(F.struct("value_pos", "value"))), lambda s: s["value"]).alias("sample_values"),
    ).join(counts, "key_name").select(
        F.sha2("key_name", 256).alias("key_id"), "key_name", "original_key_name", "dataset", "record_index", "sample_values",
        "value_count", "phone_count", "quantity_count",
    )


def value_id(doc_id: Column | str, key_name: Column | str, value: Column | str) -> Column:
    return F.concat_ws("_", doc_id, key_name, value)


def value_index(kv: DataFrame, keys: DataFrame, **value_typing) -> DataFrame:
    """Value rows with their key's id and type; numbers only for numeric_date keys."""
    # A row a key. A join by sorting would bring all rows of a key to one task, as streams have no adaptive plans.
    typed = F.broadcast(keys.select("key_name", "key_id", "key_type"))
    numeric = F.when(F.col("key_type") == "numeric_date", safe_double("value"))
    return kv.join(typed, "key_name").select(
        value_id("doc_id", "key_name", "value").alias("value_id"),
        "doc_id",
        "dataset",
        "key_id",
        "key_name",
        "key_type",
        F.col("value").alias("value_content"),
        "value_pos",
        "is_repeat",
        infer_value_type("key_name", "value", **value_typing).alias("value_type"),
        numeric.alias("numeric_value"),
    )


def document_index(records: DataFrame, domain: str, centrality: str | None = None) -> DataFrame:
    """One row per document with its JSON content."""
    return records.select(
        document_id("source_file", "record_index").alias("doc_id"),
        "dataset",
        F.lit(domain).alias("domain"),
        F.lit(centrality or domain).alias("centrality"),
        "source_file",
        "record_index",
        F.to_json("raw", {"ignoreNullFields": "false"}).alias("content"),
    )


def _iri(ns: str, kind: str, name: Column | str) -> Column:
    return F.concat(F.lit(f"{ns}{kind}/"), iri_encode(name))


def _uri(s: Column, p: str, o: Column) -> Column:
    return F.struct(
        s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype")
    )


def _literal(s: Column, p: str, o: Column, datatype: str | None = None) -> Column:
    return F.struct(
        s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit("literal").alias("o_kind"),
        F.lit(datatype).cast("string").alias("o_datatype"),
    )


def _triples(df: DataFrame, *items: Column) -> DataFrame:
    return df.select(F.inline(F.array(*items)))


def centrality_triples(kv: DataFrame, name: str, ns: str = NAMESPACE) -> DataFrame:
    """G1: the central node, its name, and its edges to every key."""
    keys = kv.select("key_name").distinct().select(F.lit(name).alias("name"), "key_name")
    node = _iri(ns, "centrality", "name")
    own = _triples(
        keys.select("name").distinct(),
        _uri(node, RDF_TYPE, F.lit(f"{ns}Centrality")),
        _literal(node, f"{ns}name", F.col("name")),
    )
    return _union(own, _triples(keys, _uri(node, f"{ns}hasKey", _iri(ns, "key", "key_name"))))


def document_triples(documents: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """Type and properties of documents; the table name only where it is not empty."""
    node = _iri(ns, "document", "doc_id")
    triples = _triples(
        documents,
        _uri(node, RDF_TYPE, F.lit(f"{ns}Document")),
        _literal(node, f"{ns}documentId", F.col("doc_id")),
        _literal(node, f"{ns}sourceFile", F.col("source_file")),
        _literal(node, f"{ns}recordIndex", F.col("record_index"), f"{XSD}integer"),
        _literal(node, f"{ns}tableName", F.nullif("dataset", F.lit(""))),
    )
    return triples.filter("o is not null")


def key_triples(keys: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """Type and name of keys."""
    node = _iri(ns, "key", "key_name")
    return _triples(keys, _uri(node, RDF_TYPE, F.lit(f"{ns}Key")), _literal(node, f"{ns}keyName", F.col("key_name")))


def value_triples(values: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """Value nodes with their edges; repeats inside a document are one node."""
    node = _iri(ns, "value", "value_id")
    return _triples(
        values.filter("not is_repeat"),
        _uri(node, RDF_TYPE, F.lit(f"{ns}Value")),
        _literal(node, f"{ns}valueId", F.col("value_id")),
        _literal(node, f"{ns}valueContent", F.col("value_content")),
        _literal(node, f"{ns}valueType", F.col("value_type")),
        _uri(_iri(ns, "key", "key_name"), f"{ns}hasValue", node),
        _uri(node, f"{ns}extractedFrom", _iri(ns, "document", "doc_id")),
    )


def triple_set(triples: DataFrame) -> DataFrame:
    """Set semantics."""
    return triples.distinct()


def graph_triples(
    documents: DataFrame, keys: DataFrame, values: DataFrame, centrality: str,
    create_document: bool = True, ns: str = NAMESPACE,
) -> DataFrame:
    """All triples of a graph. Each part is free of duplicates, so no set shuffle is needed."""
    parts = [centrality_triples(keys, centrality, ns), key_triples(keys, ns), value_triples(values, ns)]
    if create_document:
        parts.append(document_triples(documents, ns))
    return _union(*parts)


def graph_counts(triples: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """Number of documents, keys and values."""
    kinds = [f"{ns}{k}" for k in ("Document", "Key", "Value")]
    return (
        triples.filter((F.col("p") == RDF_TYPE) & F.col("o").isin(*kinds))
        .groupBy(F.replace("o", F.lit(ns), F.lit("")).alias("node_type"))
        .agg(F.count("*").alias("nodes"))
    )


def values_of_key(triples: DataFrame, key_name: str | None = None, ns: str = NAMESPACE) -> DataFrame:
    """The path key -> value -> document, for one key or all."""
    has = triples.filter(F.col("p") == f"{ns}hasValue")
    if key_name is not None:
        has = has.filter(F.col("s") == _iri(ns, "key", F.lit(key_name)))
    source = triples.filter(F.col("p") == f"{ns}extractedFrom").select(F.col("s").alias("value"), F.col("o").alias("document"))
    return has.select(F.col("s").alias("key"), F.col("o").alias("value")).join(source, "value")


def get_document(triples: DataFrame, doc_id: str, ns: str = NAMESPACE) -> DataFrame:
    """One row (id, properties) for a document; its few triples are found by filter."""
    node = _iri(ns, "document", F.lit(doc_id))
    own = triples.filter((F.col("s") == node) & F.col("p").startswith(ns))
    return (
        own.groupBy("s")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.replace("p", F.lit(ns), F.lit("")), "o"))).alias("properties"))
        .select(F.lit(doc_id).alias("id"), "properties")
    )


def document_relations(relations: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """A plain typed edge with reason and confidence per pair."""
    node = lambda c: F.concat(F.lit(ns), iri_encode(c, keep_slash=True))
    source = node("src_doc")
    return _triples(
        relations,
        F.struct(
            source.alias("s"), F.concat(F.lit(ns), "relation_type").alias("p"), node("dst_doc").alias("o"),
            F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"),
        ),
        _literal(source, f"{ns}hasRelationReason", F.col("reason")),
        _literal(source, f"{ns}hasRelationConfidence", F.col("score"), f"{XSD}float"),
    )


def relation_id(src: Column | str, dst: Column | str) -> Column:
    return F.concat(F.lit("docrelation/"), src, F.lit("--"), dst)


def upsert_relations(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """One relation per document pair; the newest replaces the older."""
    columns = ["src_doc", "dst_doc", "relation_type", "score", "method", "reason", "created_at"]
    fresh = new.select(*columns)
    both = fresh if existing is None else existing.select(*columns).unionByName(fresh)
    named = both.select(relation_id("src_doc", "dst_doc").alias("rel_id"), "*")
    return latest_by_id(named, "rel_id", "created_at")


def relation_triples(relations: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """The reified form of ``upsert_relations``' rows."""
    node = F.concat(F.lit(ns), iri_encode("rel_id", keep_slash=True))
    document = lambda c: F.concat(F.lit(f"{ns}document/"), iri_encode(c, keep_slash=True))
    return _triples(
        relations,
        _uri(node, RDF_TYPE, F.lit(RDF + "Statement")),
        _uri(node, RDF + "subject", document("src_doc")),
        _uri(node, RDF + "predicate", F.lit(f"{ns}relatedTo")),
        _uri(node, RDF + "object", document("dst_doc")),
        _literal(node, f"{ns}relationType", F.col("relation_type")),
        _literal(node, f"{ns}relationScore", F.col("score"), f"{XSD}float"),
        _literal(node, f"{ns}relationMethod", F.col("method")),
        _literal(node, f"{ns}relationReason", F.col("reason")),
        _literal(node, f"{ns}createdAt", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), f"{XSD}dateTime"),
    )


def edges(values: DataFrame, same_as: DataFrame | None = None) -> DataFrame:
    """HAS_KEY, HAS_VALUE, EXTRACTED_FROM and SAME_AS edges."""
    kept = values.filter("not is_repeat")
    long = kept.select(
        F.inline(
            F.array(
                F.struct(F.col("key_name").alias("src"), F.lit("HAS_VALUE").alias("predicate"), F.col("value_id").alias("dst")),
                F.struct(F.col("value_id").alias("src"), F.lit("EXTRACTED_FROM").alias("predicate"), F.col("doc_id").alias("dst")),
            )
        )
    )
    has_key = kept.filter("value_pos = 0").select(
        F.col("doc_id").alias("src"), F.lit("HAS_KEY").alias("predicate"), F.col("key_name").alias("dst")
    )
    parts = [long, has_key]
    if same_as is not None:
        parts.append(
            kept.join(same_as.select("key_name", F.col("value").alias("value_content"), "norm_id"), ["key_name", "value_content"])
            .select(F.col("value_id").alias("src"), F.lit("SAME_AS").alias("predicate"), F.col("norm_id").alias("dst"))
        )
    return _union(*parts)
