"""Queries over vectors and nearest neighbours, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import table
from recordloom.functions import binarize, cosine, ngram_vector
from recordloom.operators import knn
from recordloom.operators import sparse as sparse_vectors
from recordloom.plans.workflow import embed_distinct

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _cos(a: str, b: str) -> str:
    return f"({_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})))"


@query("embed")
def embed(spark: SparkSession, sf: str) -> DataFrame:
    # A blank text has no vector: its document is listed with size 0 and no norm.
    rows = table(spark, sf, "documents").select("doc_id", F.explode_outer(ngram_vector("text", blank="null")).alias("x"))
    return rows.groupBy("doc_id").agg(F.count("x").alias("size"), F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 4).alias("norm"))


@query("embed_distinct", "SELECT count(*) AS texts, 64 AS size FROM (SELECT DISTINCT text FROM documents)")
def embed_once(spark: SparkSession, sf: str) -> DataFrame:
    rows = embed_distinct(table(spark, sf, "documents"), "text")
    return rows.agg(F.count("*").alias("texts"), F.max(F.size("embedding")).alias("size"))


_BITS = "array_to_string(list_transform(embedding, lambda x: CASE WHEN x {op} 0 THEN '1' ELSE '0' END), '')"


@query(
    "binarize",
    f"SELECT vec_id, {_BITS.format(op='>')} AS threshold_bits, {_BITS.format(op='>=')} AS sign_bits FROM embeddings",
)
def binary(spark: SparkSession, sf: str) -> DataFrame:
    bits = lambda m: F.array_join(F.transform(binarize("embedding", m), lambda x: x.cast("int").cast("string")), "")
    return table(spark, sf, "embeddings").select("vec_id", bits("threshold").alias("threshold_bits"), bits("sign").alias("sign_bits"))


@query(
    "cosine",
    f"SELECT a.vec_id, round({_cos('a.embedding', 'b.embedding')}, 6) AS raw, round(greatest(0.0, least(1.0, {_cos('a.embedding', 'b.embedding')})), 6) AS clamped"
    " FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def cosines(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = table(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select(
        "vec_id", F.round(cosine("a", "b", clamp=False), 6).alias("raw"), F.round(cosine("a", "b"), 6).alias("clamped")
    )


_SPARSE = "s AS (SELECT p_brand AS id, p_name AS feature, CAST(count(*) AS DOUBLE) AS weight FROM part GROUP BY ALL)"


@query(
    "sparse_cosine",
    f"WITH {_SPARSE}, n AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM s GROUP BY id),"
    " pairs AS (SELECT DISTINCT a.p_brand AS id_a, b.p_brand AS id_b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),"
    " d AS (SELECT id_a, id_b, sum(x.weight * y.weight) AS dot FROM pairs JOIN s x ON x.id = id_a JOIN s y ON y.id = id_b AND y.feature = x.feature GROUP BY ALL)"
    " SELECT pairs.id_a, pairs.id_b, round(coalesce(dot / (p.norm * q.norm), 0), 6) AS score FROM pairs LEFT JOIN d USING (id_a, id_b)"
    " JOIN n p ON p.id = pairs.id_a JOIN n q ON q.id = pairs.id_b",
)
def sparse(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    weights = part.groupBy(F.col("p_brand").alias("id"), F.col("p_name").alias("feature")).agg(F.count("*").cast("double").alias("weight"))
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("id_b"))
    pairs = part.join(following, "p_partkey").select(F.col("p_brand").alias("id_a"), "id_b").distinct()
    return knn.sparse_cosine(pairs, weights, weights).withColumn("score", F.round("score", 6))


@query(
    "mean_vector",
    "SELECT label, pos, round(avg(CAST(embedding[pos] AS DOUBLE)), 6) AS x FROM embeddings, range(1, 65) t(pos) GROUP BY ALL",
)
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    rows = knn.mean_vector(table(spark, sf, "embeddings"), "label")
    return rows.select("label", F.posexplode("centroid").alias("pos", "x")).select(
        "label", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("x")
    )


def _knn_sql(k: int, condition: str = "true", names: tuple[str, str] = ("query_id", "id"), extra: str = "") -> str:
    return (
        f"WITH s AS (SELECT q.vec_id AS q_id, c.vec_id AS c_id, round(greatest(0.0, least(1.0, {_cos('q.embedding', 'c.embedding')})), 12) AS score"
        f" FROM embeddings q, embeddings c WHERE {condition}), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id) AS rank FROM s)"
        f" SELECT q_id AS {names[0]}, c_id AS {names[1]}, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank{extra} FROM r WHERE rank <= {k}"
    )


def _vectors(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias(name), "embedding", "label")


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))


@query("knn_documents", _knn_sql(5, names=("query_id", "doc_id")))
def knn_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(knn.knn_documents(_vectors(spark, sf, "query_id"), _vectors(spark, sf, "doc_id")))


@query("knn_documents_listed", _knn_sql(5, "c.label < 5", ("query_id", "doc_id")))
def knn_documents_listed(spark: SparkSession, sf: str) -> DataFrame:
    documents = _vectors(spark, sf, "doc_id")
    return _rounded(knn.knn_documents(_vectors(spark, sf, "query_id"), documents, 5, documents.filter("label < 5")))


@query("knn_keys", _knn_sql(3, names=("query_id", "key_id")))
def knn_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(knn.knn_keys(_vectors(spark, sf, "query_id"), _vectors(spark, sf, "key_id")))


_VALUE_SCOPE = "c.label = q.label AND c.vec_id % 2 = q.vec_id % 2 OR c.label = (q.label + 1) % 10 AND c.vec_id % 2 = 0"


@query("knn_values", _knn_sql(10, _VALUE_SCOPE, ("query_id", "value_id")))
def knn_values(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _vectors(spark, sf, "value_id").select(
        "value_id", "embedding", F.col("label").alias("key_id"), F.concat(F.lit("set"), F.col("value_id") % 2).alias("dataset")
    )
    asked = _vectors(spark, sf, "query_id")
    own = asked.select("query_id", "embedding", F.col("label").alias("key_id"), F.concat(F.lit("set"), F.col("query_id") % 2).alias("dataset"))
    other = asked.select("query_id", "embedding", ((F.col("label") + 1) % 10).alias("key_id"), F.lit("set0").alias("dataset"))
    return _rounded(knn.knn_values(own.unionByName(other), corpus))


@query("knn_by_cells", _knn_sql(5))
def knn_by_cells(spark: SparkSession, sf: str) -> DataFrame:
    found = knn.knn(_vectors(spark, sf, "query_id"), _vectors(spark, sf, "id"), 5, broadcast_queries=0)
    return _rounded(found)


# Recall of the approximate search: 90 % of the exact neighbours, and k of them for every query.
@query("knn_approx", "SELECT count(*) AS queries, true AS complete, true AS enough FROM embeddings")
def knn_approx(spark: SparkSession, sf: str) -> DataFrame:
    asked, corpus = _vectors(spark, sf, "query_id"), _vectors(spark, sf, "id")
    found = knn.knn_approx(asked, corpus, 5)
    exact = knn.knn(asked, corpus, 5).select("query_id", "id", F.lit(1).alias("hit"))
    per_query = found.join(exact, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    return per_query.agg(
        F.count("*").alias("queries"), (F.min("n") == 5).alias("complete"), (F.sum("hits") >= 0.9 * 5 * F.count("*")).alias("enough")
    )


# Character 3-grams of part names as sparse vectors; every 50th part asks for its nearest others.
_GRAMS_SQL = (
    "WITH t AS (SELECT p_partkey AS id, ' ' || lower(p_name) || ' ' AS x FROM part), g AS (SELECT id, substr(x, i, 3) AS feature FROM (SELECT id, x, unnest(range(1, length(x) - 1)) AS i FROM t)),"
    " w AS (SELECT id, feature, CAST(count(*) AS DOUBLE) AS weight FROM g GROUP BY ALL), u AS (SELECT id, feature, weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS weight FROM w),"
    " s AS (SELECT a.id AS query_id, b.id, round(least(sum(a.weight * b.weight), 1.0), 9) AS score FROM u a JOIN u b ON a.feature = b.feature WHERE a.id % 50 = 0 GROUP BY a.id, b.id),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, round(sum(score), 5) AS total, count(*) AS found FROM r WHERE rank <= 10 GROUP BY query_id"
)


@query("sparse_top_k", _GRAMS_SQL)
def sparse_top_k(spark: SparkSession, sf: str) -> DataFrame:
    grams = sparse_vectors.gram_weights(table(spark, sf, "part"), "p_partkey", "p_name")
    corpus = grams.withColumnRenamed("p_partkey", "id")
    asked = grams.filter("p_partkey % 50 = 0").withColumnRenamed("p_partkey", "query_id")
    found = sparse_vectors.sparse_top_k(asked, corpus, 10)
    return found.groupBy("query_id").agg(F.round(F.sum("score"), 5).alias("total"), F.count("*").alias("found"))
