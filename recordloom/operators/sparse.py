"""Exact nearest neighbours of sparse non-negative vectors by upper bounds (MaxScore).

Corpus entries are inverted lists, one per feature and weight level: a list's entries lie within
a factor of two, so its greatest weight bounds them well. A query's lists are ordered by the most
they can add to a score. As long as that adds up to less than the query's k-th best score so far,
no vector found in those lists alone can be among the k best: only the other, essential lists are
read, and what they leave open is bounded again before scores are completed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import cut_lineage, merged

# Weight levels per feature; the last takes all smaller weights.
LEVELS = 4
# Postings read per query, as a multiple of k, to find a first bound.
PROBE = 4
_SLACK = 1e-9


def gram_weights(df: DataFrame, id_column: str, text: str, n: int = 3) -> DataFrame:
    """(id, feature, weight): counts of the character n-grams of a lower-cased text, one blank added at either end."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, n))
    return df.filter(F.col(text).isNotNull()).select(id_column, F.explode(grams).alias("feature")).groupBy(id_column, "feature").agg(F.count("*").cast("double").alias("weight"))


def _summed(vectors: DataFrame, name: str) -> DataFrame:
    """(id, feature, weight); a feature given twice counts with the sum of its weights."""
    return vectors.filter("weight > 0").groupBy(F.col(name).alias("id"), "feature").agg(F.sum("weight").alias("weight"))


def _classes(summed: DataFrame) -> DataFrame:
    """(id, first): rows of equal vectors share the smallest of their ids."""
    vector = F.array_sort(F.collect_list(F.struct("feature", "weight")))
    keys = cut_lineage(summed.groupBy("id").agg(F.sha2(F.to_json(vector), 256).alias("key")))
    return cut_lineage(keys.join(keys.groupBy("key").agg(F.min("id").alias("first")), "key").select("id", "first"))


def _unit(summed: DataFrame, classes: DataFrame) -> DataFrame:
    """One vector of length one per class."""
    once = summed.join(classes.filter("id = first").select("id"), "id", "left_semi")
    norms = once.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return once.join(norms, "id").select("id", "feature", (F.col("weight") / F.col("norm")).alias("weight"))


def _level(weight: Column, top: Column) -> Column:
    return F.least(F.floor(-F.log2(weight / top)), F.lit(LEVELS - 1)).cast("int")


def sparse_top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", corpus_id: str = "id") -> DataFrame:
    """(query_id, corpus_id, score, rank): the k best cosines above 0, ties to the smaller id.

    Both sides are long tables (id, feature, weight) of non-negative weights. Equal vectors are
    searched once, by the smallest of their ids: the k best of these, with the k smallest ids of
    each, hold the k best rows.
    """
    asked, known = cut_lineage(_summed(queries, query_id)), cut_lineage(_summed(corpus, corpus_id))
    askers, holders = _classes(asked), _classes(known)
    best = Window.partitionBy("first").orderBy("id")
    holders_k = holders.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k).select("first", "id")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = _search(_unit(asked, askers).withColumnRenamed("id", "q"), _unit(known, holders), k).withColumnRenamed("id", "first")
    found = merged(found, holders_k, ["first"]).select("q", "id", "score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return merged(found, askers.select(F.col("id").alias("asker"), F.col("first").alias("q")), ["q"]).select(
        F.col("asker").alias(query_id), F.col("id").alias(corpus_id), "score", "rank"
    )


def _search(asked: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(q, id, score): the k best of unit vectors."""
    asked = cut_lineage(asked)
    tops = postings.groupBy("feature").agg(F.max("weight").alias("top"))
    postings = cut_lineage(postings.join(tops, "feature").select("id", "feature", "weight", _level(F.col("weight"), F.col("top")).alias("level")))
    lists = cut_lineage(postings.groupBy("feature", "level").agg(F.max("weight").alias("bound"), F.count("*").alias("size")))

    wanted = asked.join(lists, "feature").withColumn("most", F.col("weight") * F.col("bound"))
    # A feature adds its highest level that is read; a higher one adds only what it has more.
    levels = Window.partitionBy("q", "feature").orderBy(F.desc("level"))
    wanted = wanted.withColumn("more", F.col("most") - F.coalesce(F.lag("most").over(levels), F.lit(0.0)))
    short = Window.partitionBy("q").orderBy("size", "feature", "level").rowsBetween(Window.unboundedPreceding, -1)
    light = Window.partitionBy("q").orderBy("most", "feature", F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    wanted = wanted.withColumn("read", F.coalesce(F.sum("size").over(short), F.lit(0))).withColumn("upto", F.sum("more").over(light))
    wanted = cut_lineage(wanted.select("q", "feature", "level", "weight", "read", "upto"))

    found = lambda part: part.join(postings.select("id", "feature", "level", F.col("weight").alias("w")), ["feature", "level"])
    product = F.sum(F.col("weight") * F.col("w")).alias("part")
    first = found(wanted.filter(F.col("read") < PROBE * k)).groupBy("q", "id").agg(product)
    best = Window.partitionBy("q").orderBy(F.desc("part"), "id")
    least = first.withColumn("at", F.row_number().over(best)).filter(F.col("at") == k).select("q", F.col("part").alias("least"))

    split = wanted.join(least, "q", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    split = cut_lineage(split.withColumn("essential", F.col("upto") >= F.col("least") - _SLACK))
    rest = split.groupBy("q").agg(F.max(F.when(~F.col("essential"), F.col("upto"))).alias("rest"), F.max("least").alias("least"))
    some = found(split.filter("essential").select("q", "feature", "level", "weight")).groupBy("q", "id").agg(product)
    open_ = some.join(rest, "q").filter(F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.col("least") - _SLACK).select("q", "id", "part")
    open_ = cut_lineage(open_)
    # Scores are completed by the lists that were not read.
    left = split.filter(~F.col("essential")).select("q", "feature", "level", "weight")
    others = open_.select("q", "id").join(left, "q").join(postings.select("id", "feature", "level", F.col("weight").alias("w")), ["id", "feature", "level"])
    scores = open_.unionByName(others.groupBy("q", "id").agg(product)).groupBy("q", "id").agg(F.round(F.least(F.sum("part"), F.lit(1.0)), 12).alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("q", "id", "score")
