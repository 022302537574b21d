"""Key types and taxonomy labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.components import connected_components
from recordloom.operators.density import density_clusters
from recordloom.operators.knn import radius_edges
from recordloom.session import cut_lineage, stored

# Fixed value: the label of what fits no category.
OTHER = "기타"

# Rules up to this many per key travel as one array with the key; more become automata.
MAX_RULES_IN_ROW = 256
# Sizes of the blocks in which an automaton's rules and values come.
RULES_PER_BLOCK, VALUES_PER_BLOCK = 10_000, 50_000


def classify_keys(keys: DataFrame, taxonomy: DataFrame | None = None, overrides: DataFrame | None = None, share: float = 0.9) -> DataFrame:
    """key_type and confidence from the counts of ``key_registry``, which cover all values.

    Keys of phone numbers (at least ``share`` of the values) are semantic, those of numbers and
    ISO dates numeric_date, keys with a taxonomy proper_noun, all else semantic.
    ``overrides(key_name, field_type, confidence)`` wins.
    """
    some = F.col("value_count") > 0
    phone = F.col("phone_count") >= F.col("value_count") * share
    quantity = F.col("quantity_count") >= F.col("value_count") * share
    listed = F.lit(False)
    if taxonomy is not None:
        names = taxonomy.select("key_name").distinct().withColumn("_listed", F.lit(True))
        keys = keys.join(names, "key_name", "left")
        listed = F.col("_listed").isNotNull()
    typed = keys.withColumn(
        "key_type",
        F.when(some & phone, "semantic").when(some & quantity, "numeric_date").when(listed, "proper_noun").otherwise("semantic"),
    ).withColumn(
        "key_type_confidence",
        F.when(some & phone, 0.8).when(some & quantity, 0.9).when(listed, 0.9).otherwise(0.5),
    )
    if "_listed" in typed.columns:
        typed = typed.drop("_listed")
    if overrides is None:
        return typed
    given = overrides.select("key_name", F.col("field_type").alias("_t"), F.col("confidence").alias("_c"))
    return (
        typed.join(given, "key_name", "left")
        .withColumn("key_type", F.coalesce("_t", "key_type"))
        .withColumn("key_type_confidence", F.coalesce("_c", "key_type_confidence"))
        .drop("_t", "_c")
    )


def _automaton(rules: list[tuple]) -> tuple[list[dict], list[int], list[tuple | None]]:
    """Aho-Corasick over (rule_pos, keyword, label): transitions, fallbacks, and per state the first rule that ends there."""
    steps, back, first = [{}], [0], [None]
    for pos, keyword, label in sorted(rules):
        at = 0
        for c in keyword:
            if c not in steps[at]:
                steps[at][c] = len(steps)
                steps.append({})
                back.append(0)
                first.append(None)
            at = steps[at][c]
        first[at] = first[at] or (pos, label)
    queue = list(steps[0].values())
    for at in queue:
        for c, to in steps[at].items():
            fall = back[at]
            while fall and c not in steps[fall]:
                fall = back[fall]
            back[to] = steps[fall].get(c, 0)
            queue.append(to)
        # Shorter keywords that end here, too.
        first[at] = min((f for f in (first[at], first[back[at]]) if f is not None), default=None)
    return steps, back, first


def _scan_keywords(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The first rule of a block that each value of a block contains; one pass per value."""
    if left.empty or right.empty:
        return pd.DataFrame()
    steps, back, first = _automaton(list(zip(right["rule_pos"], right["keyword"], right["label"])))
    values, found = [], []
    for value in left["value"]:
        at, best = 0, first[0]
        for c in value:
            while at and c not in steps[at]:
                at = back[at]
            at = steps[at].get(c, 0)
            if first[at] is not None and (best is None or first[at] < best):
                best = first[at]
        if best is not None:
            values.append(value)
            found.append(best)
    if not values:
        return pd.DataFrame()
    return pd.DataFrame({"key_name": left["key_name"].iloc[0], "value": values, "rule_pos": [f[0] for f in found], "label": [f[1] for f in found]})


def label_by_keyword(
    values: DataFrame, rules: DataFrame, taxonomy: DataFrame, max_rules_in_row: int = MAX_RULES_IN_ROW,
    rules_per_block: int = RULES_PER_BLOCK, values_per_block: int = VALUES_PER_BLOCK,
) -> DataFrame:
    """Label of the first rule whose keyword the value contains, within the key's taxonomy.

    ``values(key_name, value)``, ``rules(rule_pos, keyword, label)``, ``taxonomy(key_name, label)``.
    Keys with few rules scan them in place. The rules of other keys are dealt to blocks of
    bounded size, each an automaton that passes once over every value of the key, itself in
    blocks. Values without a match are absent.
    """
    wanted = rules.filter("keyword IS NOT NULL").join(taxonomy.select("key_name", "label").distinct(), "label")
    counted = wanted.groupBy("key_name").agg(F.count("*").alias("_n"))
    small = counted.filter(F.col("_n") <= max_rules_in_row).select("key_name")
    large = counted.filter(F.col("_n") > max_rules_in_row).select("key_name", F.ceil(F.col("_n") / rules_per_block).cast("int").alias("_rules"))
    # Values of keys without rules are dropped before anything is gathered; the key table has a row a key.
    ruled = F.broadcast(counted.select("key_name"))
    distinct = values.filter("value IS NOT NULL").join(ruled, "key_name", "left_semi").select("key_name", "value").distinct()
    lists = (
        wanted.join(small, "key_name", "left_semi")
        .groupBy("key_name")
        .agg(F.array_sort(F.collect_list(F.struct("rule_pos", "keyword", "label"))).alias("_rules"))
    )
    scanned = distinct.join(F.broadcast(lists), "key_name").select(
        "key_name",
        "value",
        F.get(F.filter("_rules", lambda r: F.col("value").contains(r["keyword"])), F.lit(0))["label"].alias("label"),
    ).filter("label is not null")
    sizes = distinct.groupBy("key_name").agg(F.ceil(F.count("*") / values_per_block).cast("int").alias("_values"))
    sizes = cut_lineage(large.join(sizes, "key_name"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = distinct.join(F.broadcast(sizes), "key_name").select("key_name", "value", own("value", "_values").alias("_i"), every("_rules").alias("_j"))
    right = wanted.join(sizes, "key_name").select(
        F.col("key_name").alias("_key"), "rule_pos", "keyword", "label", every("_values").alias("_i"), own("keyword", "_rules").alias("_j")
    )
    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in ("rule_pos", "label"))
    found = left.groupBy("key_name", "_i", "_j").cogroup(right.groupBy("_key", "_i", "_j")).applyInPandas(_scan_keywords, f"key_name string, value string, {kinds}")
    return scanned.unionByName(found.groupBy("key_name", "value").agg(F.min_by("label", "rule_pos").alias("label")))


def label_fallback(values: DataFrame, labels: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Keyword label, else the external label, else "other"."""
    found = values.select("key_name", "value").distinct().join(labels, ["key_name", "value"], "left")
    if overrides is None:
        return found.withColumn("label", F.coalesce("label", F.lit(OTHER)))
    given = overrides.select("key_name", "value", F.col("label").alias("_given"))
    return (
        found.join(given, ["key_name", "value"], "left")
        .withColumn("label", F.coalesce("label", "_given", F.lit(OTHER)))
        .drop("_given")
    )


def validate_labels(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """C4: a label outside the key's taxonomy becomes "other"."""
    known = taxonomy.select("key_name", "label").distinct().withColumn("_known", F.lit(True))
    return (
        labels.join(known, ["key_name", "label"], "left")
        .withColumn("label", F.when(F.col("_known").isNotNull(), F.col("label")).otherwise(OTHER))
        .drop("_known")
        .select(*labels.columns)
    )


def cluster_labels(labels: DataFrame, max_distance: float | None = None) -> DataFrame:
    """One label per group of close labels, and every label that belongs to none.

    ``labels(key_name, label, embedding)``. Groups are hierarchical density clusters of at least
    two labels; each keeps its first label. With ``max_distance``, labels whose unit vectors lie
    within it are linked instead, and each component keeps its first label.
    """
    if max_distance is None:
        found = density_clusters(labels, "key_name", "label")
        return found.select("key_name", F.coalesce("cluster", "label").alias("label")).distinct()
    edges = radius_edges(labels, "key_name", "label", max_distance)
    parts = connected_components(edges, "key_name", "a", "b")
    members = labels.select("key_name", "label").join(
        parts.withColumnRenamed("node", "label"), ["key_name", "label"], "left"
    )
    return members.select("key_name", F.coalesce("component", "label").alias("label")).distinct()


def build_taxonomy(
    labels: DataFrame, vectors: DataFrame, sample: int | None = None, most: int = 0, max_distance: float | None = None
) -> DataFrame:
    """The distinct labels of each key, clustered if there are more than ``most``.

    ``labels(key_name, value, label)``, ``vectors(label, embedding)``. ``sample`` limits them to
    those of a key's first values.
    """
    if sample is not None:
        first = Window.partitionBy("key_name").orderBy("value")
        labels = labels.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= sample)
    # Read for the counts and again for the vectors, whatever it takes to make the labels.
    sampled = stored(labels.select("key_name", "label").distinct())
    counts = sampled.groupBy("key_name").agg(F.count("*").alias("_n"))
    sized = cut_lineage(sampled.join(counts, "key_name"))
    few = sized.filter(F.col("_n") <= most).select("key_name", "label")
    many = sized.filter(F.col("_n") > most).join(vectors, "label").select("key_name", "label", "embedding")
    return few.unionByName(cluster_labels(many, max_distance))


def taxonomy_of(keys: DataFrame, standard: DataFrame, built: DataFrame | None = None) -> DataFrame:
    """The taxonomy of each key: the standard one where there is one, else the built one."""
    own = cut_lineage(keys.select("key_name").distinct())
    chosen = own.join(standard.select("key_name", "label"), "key_name").withColumn("source", F.lit("standard"))
    if built is None:
        return chosen
    rest = own.join(standard.select("key_name"), "key_name", "left_anti")
    return chosen.unionByName(
        rest.join(built.select("key_name", "label"), "key_name").withColumn("source", F.lit("built"))
    )


def label_values(
    kv: DataFrame, rules: DataFrame, standard: DataFrame, given: DataFrame | None = None, vectors: DataFrame | None = None
) -> DataFrame:
    """C2 to C7 in a row: a valid label for every value of the keys that have a taxonomy.

    ``given(key_name, value, label)`` are labels from elsewhere. With ``vectors(label,
    embedding)`` they also build the taxonomy of keys without a standard one. Returns
    (key_name, value, label).
    """
    built = None if given is None or vectors is None else build_taxonomy(given, vectors)
    taxonomy = cut_lineage(taxonomy_of(kv, standard, built))
    listed = F.broadcast(taxonomy.select("key_name").distinct())
    values = stored(kv.join(listed, "key_name", "left_semi").select("key_name", "value").distinct())
    found = label_fallback(values, label_by_keyword(values, rules, taxonomy), given)
    return validate_labels(found, taxonomy)
