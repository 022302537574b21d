"""Queries over labels and value normalization, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import key_values, kv_sql, table, values_sql
from recordloom.functions import indel_similarity, ngram_vector, safe_double, token_sort
from recordloom.operators import fuzzy, label, normalize
from recordloom.operators.components import connected_components
from recordloom.session import stored

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


# --- labels ------------------------------------------------------------------------------

_RULES = [(0, "ol", "fastener"), (1, "old", "used"), (2, "gear", "drive"), (3, "e", "misc"), (4, "LOW", "slow"), (5, "-", "ranked")]
_TAXONOMY = [("p_name", "used"), ("p_name", "drive"), ("p_name", "fastener"), ("o_orderpriority", "slow"), ("o_orderpriority", "ranked"), ("p_type", "drive")]
_RULES_SQL = (
    f"rules(rule_pos, keyword, label) AS ({values_sql(_RULES)}), taxonomy(key_name, label) AS ({values_sql(_TAXONOMY)})"
)
_LABELS_SQL = (
    f"WITH {kv_sql('part', 'orders')}, {_RULES_SQL}, v AS (SELECT DISTINCT key_name, value FROM kv),"
    " labels AS (SELECT v.key_name, v.value, arg_min(r.label, r.rule_pos) AS label FROM v JOIN taxonomy t ON v.key_name = t.key_name"
    " JOIN rules r ON r.label = t.label AND contains(v.value, r.keyword) GROUP BY ALL)"
)


def _rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (
        spark.createDataFrame(_RULES, "rule_pos int, keyword string, label string"),
        spark.createDataFrame(_TAXONOMY, "key_name string, label string"),
    )


@query("label_by_keyword", f"{_LABELS_SQL} SELECT key_name, value, label FROM labels")
def label_by_keyword(spark: SparkSession, sf: str) -> DataFrame:
    return label.label_by_keyword(key_values(spark, sf, "part", "orders"), *_rules(spark))


@query("label_by_keyword_joined", f"{_LABELS_SQL} SELECT key_name, value, label FROM labels")
def label_by_keyword_joined(spark: SparkSession, sf: str) -> DataFrame:
    return label.label_by_keyword(key_values(spark, sf, "part", "orders"), *_rules(spark), max_rules_in_row=0)


@query(
    "label_fallback",
    f"{_LABELS_SQL} SELECT v.key_name, v.value, coalesce(label, CASE WHEN v.key_name = 'p_brand' THEN 'maker' END, '기타') AS label"
    " FROM v LEFT JOIN labels USING (key_name, value)",
)
def label_fallback(spark: SparkSession, sf: str) -> DataFrame:
    kv = key_values(spark, sf, "part", "orders")
    given = kv.filter("key_name = 'p_brand'").select("key_name", "value", F.lit("maker").alias("label")).distinct()
    return label.label_fallback(kv, label.label_by_keyword(kv, *_rules(spark)), given)


@query(
    "validate_labels",
    f"WITH {kv_sql('part')}, {_RULES_SQL} SELECT DISTINCT k.key_name, k.value, CASE WHEN t.label IS NULL THEN '기타' ELSE 'drive' END AS label"
    " FROM kv k LEFT JOIN taxonomy t ON t.key_name = k.key_name AND t.label = 'drive'",
)
def validate_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = key_values(spark, sf, "part").select("key_name", "value", F.lit("drive").alias("label")).distinct()
    return label.validate_labels(rows, _rules(spark)[1])


@query(
    "taxonomy_of",
    f"WITH {kv_sql('part', 'orders')}, {_RULES_SQL}, k AS (SELECT DISTINCT key_name FROM kv) SELECT key_name, label, 'standard' AS source FROM k JOIN taxonomy USING (key_name)"
    " UNION ALL SELECT DISTINCT key_name, value, 'built' FROM kv WHERE key_name IN ('p_brand', 'o_orderstatus')",
)
def taxonomy_of(spark: SparkSession, sf: str) -> DataFrame:
    kv = key_values(spark, sf, "part", "orders")
    built = kv.filter(F.col("key_name").isin("p_brand", "o_orderstatus", "p_type")).select("key_name", F.col("value").alias("label")).distinct()
    return label.taxonomy_of(kv, _rules(spark)[1], built)


def _own_labels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    kv = key_values(spark, sf, "part", "nation", "customer")
    rows = kv.filter(F.col("key_name").isin("p_name", "n_name", "c_mktsegment", "p_type"))
    # The vectors are made of the labels, so both read them.
    labels = stored(rows.select("key_name", "value", F.col("value").alias("label")).distinct())
    return labels, labels.select("label").distinct().withColumn("embedding", ngram_vector("label"))


@query("build_taxonomy")
def build_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return label.build_taxonomy(*_own_labels(spark, sf))


@query("cluster_labels")
def cluster_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels, vectors = _own_labels(spark, sf)
    return label.cluster_labels(labels.select("key_name", "label").distinct().join(vectors, "label"))


_NEAR_LABELS = (
    "WITH RECURSIVE e AS (SELECT 'class ' || label AS key_name, 'v' || vec_id AS label, embedding FROM embeddings),"
    " p AS (SELECT a.key_name, a.label AS a, b.label AS b FROM e a JOIN e b ON a.key_name = b.key_name AND a.label <> b.label"
    " WHERE sqrt(greatest(0, 2 - 2 * list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) <= 1.12),"
    " r AS (SELECT key_name, label, label AS root FROM e UNION SELECT r.key_name, p.b, r.root FROM r JOIN p ON p.key_name = r.key_name AND p.a = r.label)"
    " SELECT DISTINCT key_name, label FROM (SELECT key_name, min(root) AS label FROM r GROUP BY key_name, r.label)"
)


def _vector_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("class "), F.col("label")).alias("key_name"), F.concat(F.lit("v"), F.col("vec_id")).alias("label"), "embedding"
    )


@query("cluster_label_vectors", _NEAR_LABELS)
def cluster_label_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return label.cluster_labels(_vector_labels(spark, sf), 1.12)


@query("build_taxonomy_vectors", _NEAR_LABELS)
def build_taxonomy_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vector_labels(spark, sf)
    labels = rows.select("key_name", F.col("label").alias("value"), "label")
    return label.build_taxonomy(labels, rows.select("label", "embedding"), max_distance=1.12)


@query(
    "label_values",
    f"{_LABELS_SQL} SELECT v.key_name, v.value, coalesce(label, '기타') AS label FROM v LEFT JOIN labels USING (key_name, value)"
    " WHERE v.key_name IN (SELECT key_name FROM taxonomy) AND v.key_name <> 'p_brand'"
    " UNION ALL SELECT 'p_brand', value, CASE WHEN value > 'Brand#3' THEN 'high' ELSE 'low' END FROM v WHERE key_name = 'p_brand'",
)
def label_values(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain: taxonomies, keyword rules, given labels, validation."""
    kv = key_values(spark, sf, "part", "orders")
    brand = F.when(F.col("value") > "Brand#3", "high").otherwise("low")
    given = kv.filter("key_name = 'p_brand'").select("key_name", "value", brand.alias("label")).distinct()
    vectors = given.select("label").distinct().withColumn("embedding", F.when(F.col("label") == "high", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    rules, standard = _rules(spark)
    return label.label_values(kv, rules, standard, given, vectors)


# --- normalization -----------------------------------------------------------------------


@query(
    "pending_values",
    f"WITH {kv_sql('customer', 'part')} SELECT key_name, value, count(*) AS frequency FROM kv WHERE NOT (key_name = 'p_brand' AND value > 'Brand#2')"
    " GROUP BY ALL",
)
def pending_values(spark: SparkSession, sf: str) -> DataFrame:
    kv = key_values(spark, sf, "customer", "part")
    done = kv.filter("key_name = 'p_brand' and value > 'Brand#2'").select("key_name", "value").distinct()
    return normalize.pending_values(kv, done)


@query(
    "numeric_keys",
    f"WITH {kv_sql('customer', 'part', 'orders')}, v AS (SELECT DISTINCT key_name, value FROM kv) SELECT key_name, count(*) AS value_count,"
    " bool_and(try_cast(replace(value, ',', '') AS DOUBLE) IS NOT NULL) AS is_numeric FROM v GROUP BY key_name",
)
def numeric_keys(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.numeric_keys(normalize.pending_values(key_values(spark, sf, "customer", "part", "orders")))


_GAPS_SQL = (
    f"WITH {kv_sql('customer', 'supplier', 'orders', 'part')}, nk AS (SELECT key_name FROM kv GROUP BY key_name HAVING bool_and(try_cast(replace(value, ',', '') AS DOUBLE) IS NOT NULL)),"
    " v AS (SELECT DISTINCT key_name, value, try_cast(value AS DOUBLE) AS number FROM kv JOIN nk USING (key_name)),"
    " g AS (SELECT *, number - lag(number) OVER (PARTITION BY key_name ORDER BY number, value) AS gap FROM v),"
    " s AS (SELECT key_name, avg(gap) + 2 * stddev_pop(gap) AS lim FROM g GROUP BY key_name),"
    " c AS (SELECT g.key_name, value, CAST(sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY g.key_name ORDER BY number, value) AS BIGINT) AS cluster FROM g JOIN s USING (key_name)),"
    " kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY key_name, cluster) AS n FROM c) WHERE n >= 2)"
)


def _gap_values(spark: SparkSession, sf: str) -> DataFrame:
    values = normalize.pending_values(key_values(spark, sf, "customer", "supplier", "orders", "part"))
    return values.join(normalize.numeric_keys(values).filter("is_numeric"), "key_name", "left_semi")


@query("gap_clusters", f"{_GAPS_SQL} SELECT key_name, value, cluster FROM kept")
def gap_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.gap_clusters(_gap_values(spark, sf))


@query(
    "cluster_members",
    "SELECT p_type AS key_name, p_name AS value, p_brand AS cluster FROM (SELECT DISTINCT p_type, p_name, p_brand FROM part)"
    " QUALIFY count(*) OVER (PARTITION BY p_type, p_brand) >= 3",
)
def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_type").alias("key_name"), F.col("p_name").alias("value"), F.col("p_brand").alias("cluster"))
    return normalize.cluster_members(rows.distinct(), 3)


# LCS as a recursive table: one row of the dynamic programme per step.
_SORT = "array_to_string(list_sort(string_split({c}, ' ')), ' ')"
_LCS = (
    " dp AS (SELECT a, b, 0 AS i, list_transform(range(1, length(b) + 1), lambda j: 0) AS r FROM todo"
    " UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda q:"
    " greatest(r[q], CASE WHEN substr(a, CAST(i + 1 AS BIGINT), 1) = substr(b, q, 1) THEN coalesce(CASE WHEN q > 1 THEN r[q - 1] END, 0) + 1 ELSE 0 END)))) FROM dp WHERE i < length(a)),"
    " sim AS (SELECT a, b, (1.0 - CAST(length(a) + length(b) - 2 * r[length(b)] AS DOUBLE) / (length(a) + length(b))) * 100.0 / 100.0 AS similarity FROM dp WHERE i = length(a))"
)


@query(
    "token_sort_ratio",
    f"WITH RECURSIVE p AS (SELECT p_partkey, {_SORT.format(c='p_name')} AS x, {_SORT.format(c='p_type || chr(32) || p_brand')} AS y FROM part),"
    f" todo AS (SELECT DISTINCT x AS a, y AS b FROM p),{_LCS} SELECT p_partkey, round(similarity, 6) AS similarity FROM p JOIN sim ON x = a AND y = b",
)
def token_sort_ratio(spark: SparkSession, sf: str) -> DataFrame:
    pair = indel_similarity(token_sort("p_name"), token_sort(F.concat_ws(" ", "p_type", "p_brand")))
    return table(spark, sf, "part").select("p_partkey", F.round(pair, 6).alias("similarity"))


_FUZZY = ("part", "nation", "customer", "orders")
_FUZZY_KEYS = ("p_name", "p_brand", "p_type", "n_name", "c_mktsegment", "o_orderpriority")
_FUZZY_LIST = ", ".join(f"'{k}'" for k in _FUZZY_KEYS)


def _fuzzy_sql(threshold: float) -> str:
    """CTEs: v (distinct values), neighbour pairs of values in both directions."""
    return (
        f"WITH RECURSIVE {kv_sql(*_FUZZY)}, v AS (SELECT DISTINCT key_name, value, {_SORT.format(c='value')} AS form FROM kv WHERE key_name IN ({_FUZZY_LIST})),"
        f" todo AS (SELECT DISTINCT x.form AS a, y.form AS b FROM v x JOIN v y ON x.key_name = y.key_name AND x.form <> y.form),{_LCS},"
        " near AS (SELECT x.key_name, x.value AS va, y.value AS vb, coalesce(similarity, 1.0) AS similarity FROM v x JOIN v y ON x.key_name = y.key_name AND x.value <> y.value"
        " LEFT JOIN sim ON x.form = a AND y.form = b),"
        f" nb AS (SELECT * FROM near WHERE 1.0 - similarity <= 1.0 - CAST({threshold} AS DOUBLE))"
    )


def _fuzzy_values(spark: SparkSession, sf: str) -> DataFrame:
    kv = key_values(spark, sf, *_FUZZY)
    return normalize.pending_values(kv.filter(F.col("key_name").isin(*_FUZZY_KEYS)))


@query(
    "similar_pairs",
    f"{_fuzzy_sql(0.7)} SELECT key_name, va AS value_a, vb AS value_b, round(similarity, 6) AS similarity FROM nb WHERE va < vb",
)
def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return fuzzy.similar_pairs(_fuzzy_values(spark, sf), 0.7).withColumn("similarity", F.round("similarity", 6))


def _dbscan_sql(threshold: float, min_samples: int) -> str:
    """CTEs ending in ``labels(key_name, value, cluster)``."""
    return (
        f"{_fuzzy_sql(threshold)}, deg AS (SELECT v.key_name, v.value, 1 + count(vb) AS d FROM v LEFT JOIN nb ON v.key_name = nb.key_name AND v.value = va GROUP BY ALL),"
        f" core AS (SELECT key_name, value FROM deg WHERE d >= {min_samples}),"
        " reach AS (SELECT key_name, value, value AS root FROM core UNION SELECT r.key_name, c.value, r.root FROM reach r"
        " JOIN nb ON nb.key_name = r.key_name AND nb.va = r.value JOIN core c ON c.key_name = nb.key_name AND c.value = nb.vb),"
        " cores AS (SELECT key_name, value, min(root) AS cluster FROM reach GROUP BY ALL),"
        " border AS (SELECT nb.key_name, nb.va AS value, min(cluster) AS cluster FROM nb JOIN cores c ON c.key_name = nb.key_name AND c.value = nb.vb"
        " WHERE NOT EXISTS (SELECT 1 FROM cores k WHERE k.key_name = nb.key_name AND k.value = nb.va) GROUP BY ALL),"
        " labels AS (SELECT * FROM cores UNION ALL SELECT * FROM border)"
    )


def _members_sql(threshold: float, min_samples: int) -> str:
    return (
        _dbscan_sql(threshold, min_samples)
        + f", members AS (SELECT key_name, value, cluster FROM labels QUALIFY count(*) OVER (PARTITION BY key_name, cluster) >= {min_samples})"
    )


_FREQ_SQL = (
    ", freq AS (SELECT key_name, value, count(*) AS f FROM kv GROUP BY ALL),"
    " best AS (SELECT key_name, cluster, value AS normalized_value FROM (SELECT m.*, row_number() OVER (PARTITION BY m.key_name, cluster"
    " ORDER BY f DESC, length(m.value) DESC, m.value) AS rn FROM members m JOIN freq USING (key_name, value)) WHERE rn = 1),"
    " links AS (SELECT m.key_name, m.value, m.key_name || ':normalized:' || normalized_value AS norm_id, normalized_value FROM members m JOIN best USING (key_name, cluster))"
)


@query("dbscan_components", f"{_members_sql(0.7, 2)} SELECT key_name, value, cluster FROM members")
def dbscan_components(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.text_clusters(_fuzzy_values(spark, sf), 0.7, 2)


@query("dbscan_dense", f"{_members_sql(0.7, 4)} SELECT key_name, value, cluster FROM members")
def dbscan_dense(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.text_clusters(_fuzzy_values(spark, sf), 0.7, 4)


@query(
    "connected_components",
    "WITH RECURSIVE o AS (SELECT o_orderstatus AS g, o_orderkey AS k, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS n, lead(o_orderstatus) OVER (ORDER BY o_orderkey) AS s FROM orders),"
    " e AS (SELECT g, printf('%012d', k) AS a, printf('%012d', n) AS b FROM o WHERE n = k + 1 AND s = g),"
    " r AS (SELECT g, a AS node, a AS root FROM e WHERE (g, a) NOT IN (SELECT g, b FROM e) UNION ALL SELECT r.g, e.b, r.root FROM r JOIN e ON e.g = r.g AND e.a = r.node)"
    " SELECT g, node, root AS component FROM r",
)
def components(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of consecutive orders of one status: long and short chains in one graph."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("g"))
    following = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), "g")
    chained = orders.join(following, ["o_orderkey", "g"])
    name = lambda c: F.format_string("%012d", c)
    edges = chained.select("g", name(F.col("o_orderkey")).alias("a"), name(F.col("o_orderkey") + 1).alias("b"))
    return connected_components(edges, "g", "a", "b")


@query("representative", f"{_members_sql(0.7, 2)}{_FREQ_SQL} SELECT key_name, cluster, normalized_value FROM best")
def representative(spark: SparkSession, sf: str) -> DataFrame:
    values = _fuzzy_values(spark, sf)
    return normalize.representative(normalize.text_clusters(values, 0.7, 2), values)


def _links(spark: SparkSession, sf: str) -> DataFrame:
    kv = key_values(spark, sf, *_FUZZY).filter(F.col("key_name").isin(*_FUZZY_KEYS))
    return normalize.normalize_all(kv, 0.7, 2)


@query("same_as", f"{_members_sql(0.7, 2)}{_FREQ_SQL} SELECT key_name, value, norm_id, normalized_value FROM links")
def same_as(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf)


@query(
    "normalized_values",
    f"{_members_sql(0.7, 2)}{_FREQ_SQL} SELECT norm_id, key_name, normalized_value, count(*) AS member_count FROM links GROUP BY ALL",
)
def normalized_values(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalized_values(_links(spark, sf))


@query(
    "has_normalized_value",
    f"{_members_sql(0.7, 2)}{_FREQ_SQL} SELECT DISTINCT doc_id, norm_id FROM kv JOIN links USING (key_name, value)",
)
def has_normalized_value(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.has_normalized_value(key_values(spark, sf, *_FUZZY), _links(spark, sf))


@query(
    "normalize_key",
    f"{_members_sql(0.8, 2)}{_FREQ_SQL} SELECT key_name, value, norm_id FROM links WHERE key_name = 'p_name'",
)
def normalize_key(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize_key(key_values(spark, sf, "part"), "p_name").select("key_name", "value", "norm_id")


@query(
    "normalize_stats",
    f"{_members_sql(0.7, 2)}{_FREQ_SQL} SELECT (SELECT count(DISTINCT key_name) FROM v) AS keys_count, count(DISTINCT norm_id) AS clusters_count,"
    " count(*) AS normalized_count, CAST(0 AS BIGINT) AS failed_keys FROM links",
)
def normalize_stats(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize_stats(_fuzzy_values(spark, sf), _links(spark, sf))


_DICTIONARY = [("o_orderstatus", "F", "finished"), ("o_orderstatus", "O", "open"), ("o_orderpriority", "1-URGENT", "urgent"), ("o_orderpriority", "2-HIGH", "urgent")]


@query(
    "normalize_by_dictionary",
    f"WITH {kv_sql('orders')}, rules(key_name, value, canonical) AS ({values_sql(_DICTIONARY)}) SELECT doc_id, key_name, value,"
    " coalesce(canonical, value) AS normalized_value FROM kv LEFT JOIN rules USING (key_name, value)",
)
def normalize_by_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(_DICTIONARY, "key_name string, value string, canonical string")
    return normalize.normalize_by_dictionary(key_values(spark, sf, "orders"), rules).select("doc_id", "key_name", "value", "normalized_value")


@query("normalize_all")
def normalize_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every key of customers, suppliers and parts, near-identical names included."""
    return normalize.normalize_all(key_values(spark, sf, "customer", "supplier", "part"))


@query(
    "safe_double",
    "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 4) THEN \"value\" END AS number FROM events",
)
def parse_double(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("value").cast("decimal(18,2)").cast("string")
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit(" "), number, F.lit("\t")))
        .when(kind == 1, F.concat(number, F.lit("e0")))
        .when(kind == 2, F.concat(number, F.lit("d")))
        .when(kind == 3, F.concat(F.lit("0x"), number))
        .otherwise(F.concat(F.lit("0_0"), number))
    )
    return table(spark, sf, "events").select("event_id", safe_double(text).alias("number"))
