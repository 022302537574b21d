"""Ingest to graph in one call, and relation discovery over the result."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import is_blank
from recordloom.functions.vectors import ngram_vector
from recordloom.operators import relate
from recordloom.operators.extract import batch_summary, build_counts, extract, extract_with_overrides, merge_mappings
from recordloom.operators.graph import document_index, graph_triples, key_registry, relation_triples, upsert_relations, value_index
from recordloom.operators.label import classify_keys, label_values
from recordloom.operators.normalize import has_normalized_value, normalize_all, normalized_values
from recordloom.operators.profile import field_statistics
from recordloom.plans.schema import analyze_schema
from recordloom.session import cut_lineage


@dataclass
class Graph:
    """Tables of a key-value graph. All are lazy unless the caller persists them."""

    documents: DataFrame
    keys: DataFrame
    values: DataFrame
    statistics: DataFrame
    summary: DataFrame
    centrality: str

    def materialize(self) -> Graph:
        """The same graph with every table computed once, for use by several jobs."""
        tables = {n: cut_lineage(getattr(self, n)) for n in ("documents", "keys", "values", "statistics", "summary")}
        return replace(self, **tables)

    def triples(self) -> DataFrame:
        return graph_triples(self.documents, self.keys, self.values, self.centrality)


@dataclass
class Normalized:
    same_as: DataFrame
    normalized_values: DataFrame
    has_normalized_value: DataFrame


def build_graph(
    records: DataFrame,
    domain: str,
    centrality: str | None = None,
    mapping: DataFrame | None = None,
    multi_keys: Iterable[str] = (),
    taxonomy: DataFrame | None = None,
    key_overrides: DataFrame | None = None,
    extracted: DataFrame | None = None,
) -> Graph:
    """Profile records, extract key-values, and build node tables.

    ``extracted(doc_id, field, values)`` are values that an external extractor found in the records.
    """
    kv = extract(records, mapping, multi_keys=multi_keys)
    if extracted is not None:
        kv = cut_lineage(extract_with_overrides(kv, extracted, records, mapping))
    keys = classify_keys(key_registry(kv), taxonomy, key_overrides).withColumn("domain", F.lit(domain))
    return Graph(
        documents=document_index(records, domain, centrality),
        keys=keys,
        values=value_index(kv, keys),
        statistics=field_statistics(records, mapping=mapping),
        summary=batch_summary(build_counts(kv), records),
        centrality=centrality or domain,
    )


def normalize_graph(graph: Graph, threshold: float = 0.85, min_size: int = 2, **options) -> Normalized:
    """Cluster the values of every key and link values and documents to canonical values."""
    kv = graph.values.select("doc_id", "key_name", F.col("value_content").alias("value"))
    links = normalize_all(kv, threshold, min_size, **options)
    return Normalized(links, normalized_values(links), has_normalized_value(kv, links))


def run_workflow(records: DataFrame, domain: str, threshold: float = 0.85, min_size: int = 2, **options) -> tuple[Graph, Normalized]:
    """Ingest, profile, extract and normalize."""
    graph = build_graph(records, domain, **options).materialize()
    return graph, normalize_graph(graph, threshold, min_size)


def embed_distinct(texts: DataFrame, column: str, encoder=ngram_vector) -> DataFrame:
    """V1: (column, embedding) per distinct non-blank text, so repeated texts are encoded once."""
    distinct = texts.select(column).distinct().filter(~is_blank(column))
    return distinct.withColumn("embedding", encoder(column))


def document_vectors(records: DataFrame, encoder=ngram_vector) -> DataFrame:
    """(doc_id, embedding) of the documents' whole content."""
    documents = document_index(records, "")
    return documents.select("doc_id", encoder("content").alias("embedding"))


def discover_relations(
    graph: Graph,
    sources: DataFrame,
    relations: DataFrame | None,
    vectors: DataFrame | None = None,
    overrides: DataFrame | None = None,
    k: int = 10,
    gated: bool = True,
    encoder=ngram_vector,
) -> DataFrame:
    """The k best relation candidates of every document in ``sources(doc_id)``.

    Unknown documents give no rows. ``relations`` gates by connected datasets; ``vectors``
    holds document vectors; ``overrides`` names important keys per document.
    """
    rows = relate.document_key_values(graph.values, sources)
    important = relate.important_keys(rows, relate.feature_class(graph.statistics), overrides)
    important = cut_lineage(important)
    asked = cut_lineage(rows.join(important.select("doc_id", "key_name", "feature_class"), ["doc_id", "key_name"]))
    keys = graph.keys.select("key_id", "key_name", "key_type", encoder("key_name").alias("embedding"))
    key_hits = cut_lineage(relate.similar_keys(important, keys))
    alignment = relate.key_alignment(key_hits)
    allowed = relate.allowed_datasets(rows, relations) if gated else None
    allowed = cut_lineage(allowed) if gated else None

    text = asked.filter("key_type <> 'numeric_date'")
    value_vectors = cut_lineage(embed_distinct(graph.values.filter("key_type <> 'numeric_date'"), "value_content", encoder))
    source = ["src_dataset", "key_name", "source_value"]
    of_text = (
        text.select(F.col("doc_id").alias("src_doc"), F.col("dataset").alias("src_dataset"), "key_name", "key_type",
                    "feature_class", "value_pos", F.col("value_content").alias("source_value"))
        .join(relate.text_hits(text, graph.values, value_vectors, key_hits, allowed), source)
        .withColumn("typed_score", relate.typed_score("key_type", "score", "source_value", "cand_value"))
    )
    first = F.min_by("numeric_value", "value_pos")
    numbers = asked.filter("key_type = 'numeric_date'")
    leading = numbers.filter("numeric_value is not null").groupBy("doc_id", "key_name").agg(first.alias("source_number"))
    numbers = numbers.join(leading, ["doc_id", "key_name"])
    of_numbers = (
        numbers.select(F.col("doc_id").alias("src_doc"), F.col("dataset").alias("src_dataset"), "key_name", "key_type",
                       "feature_class", "value_pos", F.col("value_content").alias("source_value"), "source_number")
        .join(relate.number_hits(numbers, graph.values, key_hits, allowed), ["src_dataset", "key_name", "source_number"])
        .drop("source_number")
        .withColumn("typed_score", F.col("score"))
    )
    hits = of_text.unionByName(of_numbers).join(alignment, "key_name")
    pairs = relate.average_scores(relate.accumulate(hits), important)
    if vectors is None:
        pairs = pairs.withColumn("document_semantic", F.lit(0.0))
    else:
        pairs = relate.document_semantic(pairs, vectors)
    scored = relate.relation_type(relate.final_score(pairs))
    return relate.candidate_rows(relate.top_candidates(scored, k))


@dataclass
class Result:
    """What ``run_all`` makes; relations and their triples only if sources were given."""

    report: DataFrame
    mapping: DataFrame
    graph: Graph
    normalized: Normalized
    labels: DataFrame | None
    relations: DataFrame | None

    def relation_triples(self) -> DataFrame:
        return relation_triples(self.relations)


def field_mapping(report: DataFrame) -> DataFrame:
    """K3 over the schema report: (raw_field, display_name) of all fields and extractable metadata."""
    fields = report.select(F.explode("fields").alias("raw_field", "f")).select("raw_field", "f.display_name").distinct()
    metadata = report.select(F.explode("metadata").alias("name", "m")).select(F.col("m.source_field").alias("raw_field"), "m.display_name")
    return merge_mappings(fields, metadata.filter("raw_field is not null and display_name is not null").distinct())


def relation_rows(candidates: DataFrame, method: str, created_at) -> DataFrame:
    """Candidates as relations to store: the reason names the matched keys."""
    return candidates.select(
        "src_doc", F.col("doc_id").alias("dst_doc"), "relation_type", "score", F.lit(method).alias("method"),
        F.array_join("matched_keys", ", ").alias("reason"), created_at.alias("created_at"),
    )


def run_all(
    records: DataFrame,
    domain: str,
    metadata: DataFrame | None = None,
    extracted: DataFrame | None = None,
    rules: DataFrame | None = None,
    standard: DataFrame | None = None,
    given_labels: DataFrame | None = None,
    label_vectors: DataFrame | None = None,
    sources: DataFrame | None = None,
    dataset_relations: DataFrame | None = None,
    stored_relations: DataFrame | None = None,
    created_at=None,
    threshold: float = 0.85,
    min_size: int = 2,
) -> Result:
    """R23 with all of its steps: schema report, mapping, extraction, graph, canonical values,
    labels (if ``rules`` and a ``standard`` taxonomy are given), and relations of the documents
    in ``sources(doc_id)``, merged into those stored before.
    """
    report = cut_lineage(analyze_schema(records, metadata=metadata))
    mapping = cut_lineage(field_mapping(report))
    graph = build_graph(records, domain, mapping=mapping, taxonomy=standard, extracted=extracted).materialize()
    normalized = normalize_graph(graph, threshold, min_size)
    labels = relations = None
    if rules is not None and standard is not None:
        values = graph.values.select("key_name", F.col("value_content").alias("value"))
        labels = label_values(values, rules, standard, given_labels, label_vectors)
    if sources is not None:
        found = discover_relations(graph, sources, dataset_relations, document_vectors(records))
        at = F.current_timestamp() if created_at is None else created_at
        relations = upsert_relations(stored_relations, relation_rows(found, "discovery", at))
    return Result(report, mapping, graph, normalized, labels, relations)
