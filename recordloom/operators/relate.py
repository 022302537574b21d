"""Scoring relation candidates between records.

Value rows are those of ``value_index``. All functions take any number of source documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.text import strip
from recordloom.functions.vectors import clamp01, cosine
from recordloom.operators.knn import knn
from recordloom.operators.nearest import nearest_numbers, score_numeric

# Fan-outs, weights, thresholds, relation types and feature classes.
KEY_SEARCH_K = 5
VALUE_SEARCH_K = 20
SAME_AS_THRESHOLD = 0.9
WEIGHT_KEYS, WEIGHT_VALUES, WEIGHT_STRUCTURE, WEIGHT_DOCUMENT = 0.40, 0.30, 0.20, 0.10
PROPER_NOUN_BOOST = 1.5
SAME_AS, RELATED_TO, REFERENCES = "SAME_AS", "RELATED_TO", "REFERENCES"

# Default importance per feature class; a table of overrides replaces them.
IMPORTANCE = {"location": 0.95, "categorical": 0.85, "numeric": 0.80, "identity": 0.30, "free-text": 0.20}
LOCATION_KEYWORDS = ("지역", "소재지", "주소", "시군", "location", "region", "nation", "city", "address")

_SEP = "\u0001"


def document_key_values(values: DataFrame, docs: DataFrame, size: int | None = None) -> DataFrame:
    """Value rows of the given documents, at most ``size`` per document if given."""
    rows = values.join(docs.select("doc_id"), "doc_id", "left_semi")
    if size is None:
        return rows
    order = Window.partitionBy("doc_id").orderBy("key_name", "value_pos")
    return (
        rows.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= size)
        .drop("_rank")
    )


def source_profile(rows: DataFrame) -> DataFrame:
    """R2: per (document, key) its type, values and numbers in value order (bounded by R1)."""
    ordered = F.array_sort(F.collect_list(F.struct("value_pos", "key_type", "value_content", "numeric_value")))
    return (
        rows.groupBy("doc_id", "dataset", "key_name")
        .agg(ordered.alias("_v"))
        .select(
            "doc_id",
            "dataset",
            "key_name",
            F.get("_v", F.lit(0))["key_type"].alias("key_type"),
            F.transform("_v", lambda v: v["value_content"]).alias("values"),
            F.filter(F.transform("_v", lambda v: v["numeric_value"]), lambda x: x.isNotNull()).alias("numeric_values"),
        )
    )


def feature_class(stats: DataFrame, location_keywords: tuple[str, ...] = LOCATION_KEYWORDS) -> DataFrame:
    """Class of every (dataset, key) from its field statistics."""
    present = F.col("total_count") - F.col("null_count")
    numeric = (F.size("samples") > 0) & F.forall("samples", lambda s: s.rlike(r"^[+-]?[\d.,]+$"))
    place = F.lit(False)
    for word in location_keywords:
        place = place | F.lower("field").contains(word)
    return stats.select(
        "dataset",
        F.col("field").alias("key_name"),
        F.when((present > 1) & (F.col("unique_count") >= present * 0.95), "identity")
        .when(numeric & ~place, "numeric")
        .when(F.col("value_lengths")["avg"] > 500, "free-text")
        .when(place, "location")
        .otherwise("categorical")
        .alias("feature_class"),
    )


def important_keys(
    rows: DataFrame, classes: DataFrame, overrides: DataFrame | None = None, min_importance: float = 0.0
) -> DataFrame:
    """(doc_id, key_name, feature_class, importance, reason) of the documents' keys.

    A document listed in ``overrides`` (same columns) takes its keys from there.
    """
    level = F.create_map(*[F.lit(x) for pair in IMPORTANCE.items() for x in pair])[F.col("feature_class")]
    chosen = (
        rows.select("doc_id", "dataset", "key_name")
        .distinct()
        .join(classes, ["dataset", "key_name"])
        .select("doc_id", "key_name", "feature_class", level.alias("importance"), F.concat(F.lit("class "), "feature_class").alias("reason"))
        .filter(F.col("importance") >= min_importance)
    )
    if overrides is None:
        return chosen
    given = overrides.select(*chosen.columns)
    return chosen.join(given.select("doc_id"), "doc_id", "left_anti").unionByName(given)


def connected_datasets(relations: DataFrame) -> DataFrame:
    """(dataset, other) one hop apart, both ways, without the dataset itself."""
    there = relations.select(F.col("table_a").alias("dataset"), F.col("table_b").alias("other"))
    back = relations.select(F.col("table_b").alias("dataset"), F.col("table_a").alias("other"))
    return there.unionByName(back).filter("dataset <> other").distinct()


def allowed_datasets(datasets: DataFrame, relations: DataFrame | None) -> DataFrame:
    """(dataset, other): connected datasets and the dataset itself."""
    own = datasets.select("dataset").distinct()
    self_pair = own.select("dataset", F.col("dataset").alias("other"))
    if relations is None:
        return self_pair
    return connected_datasets(relations).join(own, "dataset", "left_semi").unionByName(self_pair).distinct()


def document_table(docs: DataFrame, documents: DataFrame, values: DataFrame) -> DataFrame:
    """Dataset of each document: its own, else that of one of its values, else null."""
    own = documents.select("doc_id", F.nullif("dataset", F.lit("")).alias("_own"))
    found = values.groupBy("doc_id").agg(F.min(F.nullif("dataset", F.lit(""))).alias("_found"))
    return (
        docs.select("doc_id")
        .join(own, "doc_id", "left")
        .join(found, "doc_id", "left")
        .select("doc_id", F.coalesce("_own", "_found").alias("dataset"))
    )


def key_alignment(key_hits: DataFrame) -> DataFrame:
    """Per key its best clamped similarity and the names of its similar keys (at most k)."""
    return key_hits.groupBy("key_name").agg(
        clamp01(F.max("score")).alias("key_alignment"), F.array_sort(F.collect_set("hit_key_name")).alias("matched_keys")
    )


def similar_keys(names: DataFrame, keys: DataFrame, k: int = KEY_SEARCH_K) -> DataFrame:
    """(key_name, key_id, hit_key_name, score): the k nearest keys of each key name.

    ``keys(key_id, key_name, key_type, embedding)``. Numeric keys look among numeric keys,
    the others among the others.
    """
    side = (F.col("key_type") == "numeric_date").alias("numeric")
    table = keys.select("key_id", "key_name", "embedding", side)
    asked = table.join(names.select("key_name").distinct(), "key_name", "left_semi")
    hits = knn(asked.withColumnRenamed("key_name", "query_id"), table, k, corpus_id="key_id", groups=["numeric"])
    return hits.join(table.select("key_id", F.col("key_name").alias("hit_key_name")), "key_id").select(
        F.col("query_id").alias("key_name"), "key_id", "hit_key_name", "score"
    )


def _postings(values: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The first k value rows per distinct value. No search takes more of equal rows."""
    order = Window.partitionBy(*columns).orderBy("value_id")
    return (
        values.filter("not is_repeat")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= k)
        .select(*columns, "value_id", "doc_id", *[c for c in ("value_content",) if c not in columns])
    )


def _scopes(asked: DataFrame, key_hits: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Each distinct question with the keys, and datasets if gated, it may look into."""
    scoped = asked.join(key_hits.select("key_name", "key_id"), "key_name")
    if allowed is None:
        return scoped
    gate = allowed.select(F.col("dataset").alias("src_dataset"), F.col("other").alias("dataset"))
    return scoped.join(gate, "src_dataset")


def text_hits(
    sources: DataFrame, values: DataFrame, vectors: DataFrame, key_hits: DataFrame,
    allowed: DataFrame | None, k: int = VALUE_SEARCH_K,
) -> DataFrame:
    """Value search for text keys, once per distinct (source dataset, key, value).

    ``vectors(value_content, embedding)``. Returns (src_dataset, key_name, source_value,
    hit_rank, cand_doc, cand_value, dataset, score). Hits are ordered by score, then key,
    dataset, value and value id.
    """
    asked = sources.select(F.col("dataset").alias("src_dataset"), "key_name", F.col("value_content").alias("source_value")).distinct()
    groups = ["key_id"] if allowed is None else ["key_id", "dataset"]
    question = F.concat_ws(_SEP, "src_dataset", "key_name", "source_value")
    queries = (
        _scopes(asked, key_hits, allowed)
        .join(vectors.withColumnRenamed("value_content", "source_value"), "source_value")
        .select(question.alias("query_id"), *groups, "embedding")
    )
    stock = values.filter("key_type <> 'numeric_date'")
    item = F.concat_ws(_SEP, "key_id", "dataset", "value_content")
    corpus = (
        stock.select("key_id", "dataset", "value_content")
        .distinct()
        .join(vectors, "value_content")
        .select(item.alias("id"), *groups, "embedding")
    )
    postings = _postings(stock, ["key_id", "dataset", "value_content"], k).withColumn("id", item)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "value_id")
    part = F.split("query_id", _SEP, 3)
    return (
        knn(queries, corpus, k, groups=groups)
        .drop("rank")
        .join(postings, "id")
        .withColumn("hit_rank", F.row_number().over(order))
        .filter(F.col("hit_rank") <= k)
        .select(
            part[0].alias("src_dataset"), part[1].alias("key_name"), part[2].alias("source_value"),
            "hit_rank", F.col("doc_id").alias("cand_doc"), F.col("value_content").alias("cand_value"), "dataset", "score",
        )
    )


def number_hits(
    sources: DataFrame, values: DataFrame, key_hits: DataFrame, allowed: DataFrame | None, k: int = VALUE_SEARCH_K
) -> DataFrame:
    """Nearest numbers for numeric keys, once per distinct (source dataset, key, number).

    Returns the columns of ``text_hits`` with ``source_number`` for ``source_value``; hits of
    score 0 are dropped.
    """
    asked = sources.select(F.col("dataset").alias("src_dataset"), "key_name", "source_number").distinct()
    groups = ["key_id"] if allowed is None else ["key_id", "dataset"]
    scoped = _scopes(asked, key_hits, allowed)
    stock = values.filter("key_type = 'numeric_date' and numeric_value is not null")
    near = nearest_numbers(
        scoped.withColumnRenamed("source_number", "number"),
        stock.withColumnRenamed("numeric_value", "number"),
        groups,
        k,
    )
    postings = _postings(stock, ["key_id", "dataset", "numeric_value"], k)
    distance = F.abs(F.col("source_number") - F.col("numeric_value"))
    order = Window.partitionBy("src_dataset", "key_name", "source_number").orderBy(
        distance, "numeric_value", "key_id", "dataset", "value_id"
    )
    found = scoped.join(near.withColumnRenamed("number", "source_number"), [*groups, "source_number"]).withColumnRenamed("near", "numeric_value")
    return (
        found.join(postings, [*groups, "numeric_value"])
        .withColumn("hit_rank", F.row_number().over(order))
        .filter(F.col("hit_rank") <= k)
        .select(
            "src_dataset", "key_name", "source_number", "hit_rank", F.col("doc_id").alias("cand_doc"),
            F.col("value_content").alias("cand_value"), "dataset",
            score_numeric(F.col("source_number"), F.col("numeric_value")).alias("score"),
        )
        .filter("score > 0")
    )


def typed_score(key_type: Column | str, score: Column | str, source_value: Column | str, cand_value: Column | str) -> Column:
    """Clamped similarity; proper nouns gain when the trimmed values are equal."""
    kind = F.col(key_type) if isinstance(key_type, str) else key_type
    base = clamp01(F.col(score) if isinstance(score, str) else score)
    boosted = clamp01(base * PROPER_NOUN_BOOST)
    return F.when((kind == "proper_noun") & (strip(source_value) == strip(cand_value)), boosted).otherwise(base)


def accumulate(hits: DataFrame) -> DataFrame:
    """Per (source, candidate) the summed scores and what matched.

    ``hits(src_doc, cand_doc, key_name, feature_class, value_pos, hit_rank, source_value,
    cand_value, dataset, typed_score, key_alignment, matched_keys)``. The reported value of a
    key is that of its last hit. Lists are bounded by the number of important keys.
    """
    exact = strip("source_value") == strip("cand_value")
    per_key = (
        hits.filter("src_doc <> cand_doc and typed_score > 0")
        .groupBy("src_doc", "cand_doc", "key_name")
        .agg(
            F.sum("key_alignment").alias("aligned"),
            F.sum("typed_score").alias("typed"),
            F.max_by("cand_value", F.struct("value_pos", "hit_rank")).alias("cand_value"),
            F.bool_or(exact).alias("exact"),
            F.max("feature_class").alias("feature_class"),
            F.max("matched_keys").alias("matched_keys"),
            F.max("dataset").alias("dataset"),
        )
    )
    return per_key.groupBy("src_doc", "cand_doc").agg(
        F.sum("aligned").alias("aligned"),
        F.sum("typed").alias("typed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_keys")))).alias("matched_keys"),
        F.array_sort(F.collect_list(F.struct(F.col("key_name").alias("key"), F.col("cand_value").alias("value")))).alias("matched_values"),
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("key_name")))).alias("exact_keys"),
        F.bool_or(F.col("exact") & (F.col("feature_class") == "identity")).alias("identity_match"),
        F.bool_or(F.col("exact") & F.col("feature_class").isin("identity", "location")).alias("strong_match"),
        F.max("dataset").alias("dataset"),
    )


def average_scores(pairs: DataFrame, important: DataFrame) -> DataFrame:
    """Divide by the source's number of important keys, with or without values; clamp."""
    counts = important.groupBy(F.col("doc_id").alias("src_doc")).agg(F.count("*").alias("_keys"))
    n = F.greatest(F.coalesce("_keys", F.lit(1)), F.lit(1))
    return (
        pairs.join(counts, "src_doc", "left")
        .withColumn("aligned_attribute", clamp01(F.col("aligned") / n))
        .withColumn("typed_value_match", clamp01(F.col("typed") / n))
        .drop("_keys", "aligned", "typed")
    )


def document_semantic(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Clamped cosine of the two documents' vectors, 0 where one is missing."""
    a = vectors.select(F.col("doc_id").alias("src_doc"), F.col("embedding").alias("_a"))
    b = vectors.select(F.col("doc_id").alias("cand_doc"), F.col("embedding").alias("_b"))
    score = F.coalesce(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), cosine("_a", "_b")), F.lit(0.0))
    return (
        pairs.join(a, "src_doc", "left").join(b, "cand_doc", "left").withColumn("document_semantic", score).drop("_a", "_b")
    )


def final_score(pairs: DataFrame, structure: str | None = None) -> DataFrame:
    """Weighted sum of the four scores; structure is 0 unless a column is named."""
    graph = F.col(structure) if structure else F.lit(0.0)
    return pairs.withColumn("graph_structure", graph).withColumn(
        "score",
        F.lit(WEIGHT_KEYS) * F.col("aligned_attribute")
        + F.lit(WEIGHT_VALUES) * F.col("typed_value_match")
        + F.lit(WEIGHT_STRUCTURE) * F.col("graph_structure")
        + F.lit(WEIGHT_DOCUMENT) * F.col("document_semantic"),
    )


def relation_type(pairs: DataFrame, threshold: float = SAME_AS_THRESHOLD) -> DataFrame:
    """Type from exactly matching identity and location keys and the final score."""
    return pairs.withColumn(
        "relation_type",
        F.when(F.col("strong_match") & (F.col("score") >= threshold), SAME_AS)
        .when(F.col("identity_match"), REFERENCES)
        .otherwise(RELATED_TO),
    )


def top_candidates(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k best candidates per source; ties go to the smaller document id."""
    order = Window.partitionBy("src_doc").orderBy(F.desc(F.round("score", 9)), "cand_doc")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def candidate_rows(pairs: DataFrame, *more: str) -> DataFrame:
    """Presentation form, scores rounded to 3 digits; ``more`` names further columns to keep."""
    parts = ["aligned_attribute", "typed_value_match", "graph_structure", "document_semantic"]
    return pairs.select(
        "src_doc",
        "rank",
        F.col("cand_doc").alias("doc_id"),
        F.col("dataset").alias("table_name"),
        "relation_type",
        F.bround("score", 3).alias("score"),
        F.struct(*[F.bround(p, 3).alias(p) for p in parts]).alias("breakdown"),
        "matched_keys",
        F.map_from_entries("matched_values").alias("matched_values"),
        *more,
    )
