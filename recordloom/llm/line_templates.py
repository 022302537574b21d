"""Line dedup by a log-template tree, in DataFrame functions only.

Lines are parsed down a tree of fixed depth: by their number of tokens, then by their leading
tokens, where a token with a digit counts as variable. The different lines of a leaf are then
generalised in up to ``LEVELS`` levels. A token that over half of a node's lines have in a
position is its constant, other positions are variable; lines that agree with the constants in at
least ``similarity`` of all positions share the node's template. The others are split by their
token in the node's most regular position that is no constant everywhere (that of the fewest
different tokens), and generalised among themselves. A line that joins no template is one of its
own, with its digits masked. A template found in enough documents is recurring, and all its lines
but the very first are dropped.

Defined cases: a null text has no lines and stays null; lines without tokens are never
dropped; rows of one id and text are one document and lose the same lines; rows of one id and
different texts are different documents; a null id is an id; an emptied text is an empty
string; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import stored, words_of

VARIABLE = "<*>"
LEVELS = 3


def parsed_lines(docs: DataFrame, id_column: str, text: str, depth: int) -> DataFrame:
    """One row per line with tokens: (id, body, pos, n, leaf, form, marks).

    ``body`` is the hash of the text; ``form`` that of the masked line, which is only compared
    within its leaf; ``marks`` holds 16 bits of every token's hash, for comparing positions.
    """
    lines = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(F.col(text)).alias("body"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")
    )
    masked = lambda w: F.when(w.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(w)
    tokens = lines.select("id", "body", "pos", words_of(F.col("line")).alias("w")).filter(F.size("w") > 0)
    tokens = tokens.withColumn("w", F.transform("w", masked))
    return tokens.select(
        "id", "body", "pos", F.size("w").alias("n"),
        F.xxhash64(F.size("w"), F.slice("w", 1, depth)).alias("leaf"),
        F.xxhash64("w").alias("form"),
        F.transform("w", lambda t: (F.xxhash64(t).bitwiseAND(F.lit(65535)) - 32768).cast("smallint")).alias("marks"),
    )


def leaf_templates(lines: DataFrame, similarity: float) -> DataFrame:
    """(leaf, form, template) of the lines that share a template with others of their leaf.

    Only leaves with different lines matter; they are told by the extremes of their narrow keys.
    Tokens are counted per position with partial sums before the shuffle, so a leaf with a third
    of all lines is no single task's burden.
    """
    mixed = lines.groupBy("leaf").agg(F.min("form").alias("low"), F.max("form").alias("high")).filter("low <> high").select("leaf")
    marked = lines.select("leaf", "form", "marks").join(stored(mixed), "leaf", "left_semi")
    forms = stored(marked.groupBy("leaf", "form").agg(F.first("marks").alias("marks")).withColumn("node", F.col("leaf")))
    found = []
    for level in range(LEVELS):
        at = forms.select("node", F.posexplode("marks").alias("pos", "mark"))
        counts = at.groupBy("node", "pos", "mark").agg(F.count("*").alias("seen"))
        places = counts.groupBy("node", "pos").agg(F.max(F.struct("seen", "mark")).alias("top"), F.sum("seen").alias("forms"), F.count("*").alias("kinds"))
        constant = F.when(F.col("top.seen") * 2 > F.col("forms"), F.col("top.mark"))
        template = places.filter("forms > 1").groupBy("node").agg(
            F.sort_array(F.collect_list(F.struct("pos", constant.alias("mark")))).alias("constants"),
            F.min(F.when(F.col("kinds") > 1, F.struct("kinds", "pos")))["pos"].alias("split"),
        )
        agree = F.aggregate(
            F.zip_with("marks", "constants", lambda a, b: F.when(a == b["mark"], 1).otherwise(0)), F.lit(0), lambda s, x: s + x
        )
        told = stored(forms.join(template, "node").select("leaf", "form", "marks", "node", "split", (agree >= F.lit(similarity) * F.size("marks")).alias("follows")))
        found.append(told.filter("follows").select("leaf", "form", F.xxhash64("node", F.lit(level)).alias("template")))
        rest = told.filter("NOT follows AND split IS NOT NULL")
        forms = rest.select("leaf", "form", "marks", F.xxhash64("node", "split", F.get("marks", F.col("split"))).alias("node"))
    return reduce(DataFrame.unionByName, found)


def recurring_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", depth: int = 4, similarity: float = 0.8,
    min_docs: int = 2, short_tokens: int = 5, short_min_docs: int = 10,
) -> DataFrame:
    """(id, body, drops, n_lines): positions of the lines to drop, per document that loses any.

    A template of fewer than ``short_tokens`` tokens needs ``short_min_docs`` documents, any
    other ``min_docs``. Hashes and positions are shuffled, never lines.
    """
    lines = stored(parsed_lines(docs, id_column, text, depth))
    shared = stored(leaf_templates(lines, similarity))
    keyed = lines.select("id", "body", "pos", "n", "leaf", "form").join(shared, ["leaf", "form"], "left").select(
        "id", "body", "pos", "n", "leaf", F.coalesce("template", "form").alias("form"), F.col("template").isNotNull().alias("shared")
    )
    key = ["leaf", "shared", "form"]
    per_doc = keyed.groupBy(*key, "n", "id", "body").agg(F.min("pos").alias("pos"))
    found = (
        per_doc.groupBy(*key, "n")
        .agg(F.count("*").alias("docs"), F.min(F.struct("id", "body", "pos")).alias("first"))
        .filter(F.col("docs") >= F.when(F.col("n") < short_tokens, short_min_docs).otherwise(min_docs))
        .drop("n")
    )
    dropped = keyed.join(found, key).filter(~F.struct("id", "body", "pos").eqNullSafe(F.col("first")))
    return dropped.groupBy("id", "body").agg(F.collect_set("pos").alias("drops"))


def drop_recurring_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", detail: bool = False, **options) -> DataFrame:
    """``docs`` with the recurring lines removed from ``text``; ``detail`` adds n_lines and n_dropped.

    The one wide exchange brings each text to the positions it loses. Those are the hashed side
    of the join, so texts are not sorted.
    """
    names = {c: f"_col{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn("_body", F.xxhash64(names[text]))
    drops = recurring_lines(docs.select(id_column, text), id_column, text, **options).hint("shuffle_hash")
    joined = rows.join(drops, rows[names[id_column]].eqNullSafe(drops["id"]) & (rows["_body"] == drops["body"]), "left")
    lines = F.split(F.col(names[text]), "\n")
    joined = joined.withColumn("_lines", lines)
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("drops"))
    shorter = F.when(F.col("drops").isNull(), F.col(names[text])).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    kept = [(shorter if c == text else F.col(n)).alias(c) for c, n in names.items()]
    if detail:
        kept += [
            F.when(F.col(names[text]).isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
            F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        ]
    return joined.select(*kept)
