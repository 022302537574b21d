"""Quality rules whose cutoffs carry a guarantee, in DataFrame functions only.

Each signal of a text (symbol share, repeated windows, ...) may reject it above a cutoff. The
cutoffs are chosen per stratum on labelled documents: a cutoff is admitted only if an exact
binomial test rejects, for it, the hypothesis that more than ``alpha`` of the good documents
would be lost. ``alpha`` is shared by the signals, so their union keeps it, and the level
``delta`` is divided by the number of tests (strata x signals x grid points), so all
guarantees hold together with probability 1 - delta.

Defined cases: a null text has no words and fails the base rules; a null stratum is a stratum
of its own; without labels, or with too few good ones, nothing beyond the base rules rejects;
a document labelled both ways counts as good; repeated rows are judged alike; extra columns
are ignored (or kept by ``filter_quality``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import SPACES, words_of
from recordloom.session import cut_lineage

# The signals, each with the grid of cutoffs that may be admitted.
GRIDS = {
    "symbols": [0.1, 0.2, 0.3, 0.5, 0.75, 1.0],
    "repeats": [0.1, 0.15, 0.2, 0.3, 0.4, 0.5],
    "dup_lines": [0.05, 0.1, 0.2, 0.3, 0.5],
    "capitals": [0.2, 0.3, 0.4, 0.5, 0.7],
    "exclamations": [0.1, 0.2, 0.3, 0.5, 1.0],
    "word_length": [8.0, 9.0, 10.0, 12.0, 15.0],
}
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def add_counts(docs: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """Add the counts of a text to each row, under names with ``prefix``.

    Repeated 3-word windows are found inside the row: window hashes are packed with their
    position into longs and sorted; neighbours of equal hash are then compared as text. The
    cost is that of sorting the words of one text.
    """
    p = prefix
    c = lambda name: F.col(f"`{p}{name}`")
    body = F.coalesce(text, F.lit(""))
    shift = F.length(F.bin(F.greatest(F.size(c("w")), F.lit(1)).cast("long")))
    positions = F.when(F.size(c("w")) >= 3, F.sequence(F.lit(0), F.size(c("w")) - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(
        positions,
        lambda i: F.call_function("shiftleft", F.xxhash64(F.get(c("w"), i), F.get(c("w"), i + 1), F.get(c("w"), i + 2)), c("shift")).bitwiseOR(i.cast("long")),
    )
    high = lambda x: F.call_function("shiftrightunsigned", x, c("shift"))
    maybe = F.filter(
        c("s"), lambda x, j: (high(x) == high(F.get(c("s"), j - 1))) | (high(x) == high(F.get(c("s"), j + 1)))
    )
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), c("shift")) - 1
    named = F.transform(
        c("m"),
        lambda x: F.struct(
            F.concat_ws(" ", *[F.get(c("w"), x.bitwiseAND(c("mask")).cast("int") + k) for k in range(3)]).alias("t"),
            x.bitwiseAND(c("mask")).cast("int").alias("i"),
        ),
    )
    twice = F.transform(
        F.filter(c("v"), lambda x, j: (x["t"] == F.get(c("v"), j - 1)["t"]) | (x["t"] == F.get(c("v"), j + 1)["t"])), lambda x: x["i"]
    )
    covered = F.aggregate(
        F.sort_array(c("at")),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return (
        docs.withColumn(f"{p}w", words_of(text))
        .withColumn(f"{p}shift", shift)
        .withColumn(f"{p}s", F.sort_array(packed))
        .withColumn(f"{p}m", maybe)
        .withColumn(f"{p}mask", mask)
        .withColumn(f"{p}v", F.sort_array(named))
        .withColumn(f"{p}at", twice)
        .withColumn(f"{p}lines", lines)
        .withColumn(f"{p}n_words", F.size(c("w")).cast("long"))
        .withColumn(f"{p}n_repeat_words", covered)
        .withColumn(f"{p}n_lines", F.size(c("lines")).cast("long"))
        .withColumn(f"{p}n_dup_lines", c("n_lines") - F.size(F.array_distinct(c("lines"))))
        .withColumn(f"{p}word_chars", (F.length(body) - _count_of(body, SPACES)).cast("long"))
        .withColumn(f"{p}n_symbols", _count_of(body, "#*$%&|<>"))
        .withColumn(f"{p}n_capitals", _count_of(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .withColumn(f"{p}n_exclamations", _count_of(body, "!"))
        .drop(*[f"{p}{x}" for x in ("w", "shift", "s", "m", "mask", "v", "at", "lines")])
    )


def base_failed(prefix: str = "") -> Column:
    n, repeats = F.col(f"`{prefix}n_words`"), F.col(f"`{prefix}n_repeat_words`")
    return (n < 50) | (100 * repeats > 50 * n)


def signals(prefix: str = "") -> dict[str, Column]:
    """Signal values in the same order as the grids; zero words give zeros."""
    c = lambda name: F.col(f"`{prefix}{name}`")
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    return {
        "symbols": share("n_symbols", "n_words"),
        "repeats": share("n_repeat_words", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "capitals": share("n_capitals", "word_chars"),
        "exclamations": share("n_exclamations", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }


def stratum_of(column: str) -> Column:
    """Text key of a stratum; null is a stratum too."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit(""))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed term by term in logarithms; k up to n * p is meant."""
    step = math.log(p / (1 - p))
    start = F.struct((n * F.lit(math.log1p(-p))).alias("log"), F.exp(n * F.lit(math.log1p(-p))).alias("sum"))
    return F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        start,
        lambda a, j: F.struct(
            (a["log"] + F.log((n - j + 1) / j) + F.lit(step)).alias("log"),
            (a["sum"] + F.exp(a["log"] + F.log((n - j + 1) / j) + F.lit(step))).alias("sum"),
        ),
        lambda a: a["sum"],
    )


def choose_cutoffs(calibration: DataFrame, alpha: float = 0.05, delta: float = 0.05, cost: float = 20.0) -> DataFrame:
    """(stratum, signal, cutoff) of the admitted rules, from ``calibration(stratum, good, <signals>)``.

    Among the admitted cutoffs the one with the largest (bad rejected - cost * good rejected) is
    taken, the highest among equals, and none if no bad document is gained. Counts per grid
    point come from one aggregation that combines before its shuffle; what remains has at most
    one row per stratum, signal and grid point.
    """
    each = []
    for name, grid in GRIDS.items():
        above = sum((F.when(F.col(name) > g, 1).otherwise(0) for g in grid[1:]), F.when(F.col(name) > grid[0], 1).otherwise(0))
        each.append(F.struct(F.lit(name).alias("signal"), above.alias("above")))
    counts = (
        calibration.select("stratum", "good", F.explode(F.array(*each)).alias("x"))
        .groupBy("stratum", "x.signal", "x.above")
        .agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    )
    grid_rows = F.create_map(*[y for k, g in GRIDS.items() for y in (F.lit(k), F.array(*[F.lit(v) for v in g]))])
    strata = counts.groupBy("stratum", "signal").agg(F.sum("good").alias("n"))
    tests = strata.select("stratum", "signal", "n", F.posexplode(grid_rows[F.col("signal")]).alias("at", "cutoff"))
    counted = counts.groupBy("stratum", "signal").agg(F.collect_list(F.struct("above", "good", "bad")).alias("bins"))
    over = lambda what: F.aggregate(
        F.filter("bins", lambda b: b["above"] > F.col("at")), F.lit(0).cast("long"), lambda s, b: s + b[what]
    )
    tested = tests.join(counted, ["stratum", "signal"]).select("stratum", "signal", "n", "cutoff", over("good").alias("k"), over("bad").alias("gain"))
    m = tested.agg(F.count("*")).scalar()
    rate = alpha / len(GRIDS)
    tail = F.when(F.col("k") <= F.col("n") * rate, binomial_tail(F.col("n"), F.col("k"), rate)).otherwise(F.lit(1.0))
    best = Window.partitionBy("stratum", "signal").orderBy(F.desc("value"), F.desc("cutoff"))
    return (
        tested.withColumn("tail", tail)
        .filter(F.col("tail") * m <= delta)
        .withColumn("value", F.col("gain") - cost * F.col("k"))
        .filter("value > 0")
        .withColumn("rank", F.row_number().over(best))
        .filter("rank = 1")
        .select("stratum", "signal", "cutoff")
    )


def reject_above(cutoffs: list[tuple[str, str, float]], stratum: Column, values: dict[str, Column]) -> Column:
    """Whether any signal is above its admitted cutoff in the row's stratum."""
    rejected = F.lit(False)
    for name, value in values.items():
        own = [(s, c) for s, n, c in cutoffs if n == name]
        if own:
            table = F.create_map(*[F.lit(y) for pair in own for y in pair])
            rejected = rejected | F.coalesce(value > F.try_element_at(table, stratum), F.lit(False))
    return rejected


def good_labels(labels: DataFrame, id_column: str, label: str) -> DataFrame:
    """(id, good) per labelled document; a null id or label is no label."""
    return (
        labels.select(F.col(id_column).alias("_label_id"), F.col(label).alias("_label"))
        .dropna().groupBy("_label_id").agg((F.max("_label") >= 1).alias("good"))
    )


MAX_STRATA = 1000


def certified(counted: DataFrame, labels: DataFrame, id_column: str, label: str, **options) -> list[tuple[str, str, float]]:
    """Admitted cutoffs of ``counted(_id, stratum, counts)`` as a short list.

    A stratum needs hundreds of good labels to admit anything, and at most MAX_STRATA strata
    with admitted cutoffs are supported; more is an error, not a cut.
    """
    rows = counted.join(good_labels(labels, id_column, label), F.col("_id") == F.col("_label_id")).filter(~base_failed())
    calibration = rows.select("stratum", "good", *[v.alias(k) for k, v in signals().items()])
    limit = MAX_STRATA * len(GRIDS)
    found = choose_cutoffs(calibration, **options).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"over {MAX_STRATA} strata have cutoffs; use a coarser stratum")
    return sorted(tuple(r) for r in found)


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", **options
) -> DataFrame:
    """(id, counts, base_failed, kept, stratum, signals) for every document.

    The counts are written once (a hundred bytes a document) and serve both the calibration and
    the verdicts; texts are read once and never shuffled.
    """
    rows = docs.select(F.col(id_column).alias("_id"), stratum_of(stratum).alias("stratum"), F.col(text).alias("_text"))
    counted = cut_lineage(add_counts(rows, F.col("_text")).drop("_text"))
    cutoffs = certified(counted, labels, id_column, label, **options)
    failed = base_failed()
    return counted.select(
        F.col("_id").alias(id_column), *BASE_COUNTS, failed.alias("base_failed"),
        (~failed & ~reject_above(cutoffs, F.col("stratum"), signals())).alias("kept"), "stratum",
        *[v.alias(f"share_{k}") for k, v in signals().items()],
    )


def filter_quality(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", **options
) -> DataFrame:
    """The rows of ``docs`` (all columns) that are kept.

    Counting twice, once for the calibration, costs less than moving or storing every text.
    """
    p = "__quality_"
    rows = docs.select(F.col(id_column).alias("_id"), stratum_of(stratum).alias("stratum"), F.col(text).alias("_text"))
    counted = cut_lineage(add_counts(rows, F.col("_text")).drop("_text"))
    cutoffs = certified(counted, labels, id_column, label, **options)
    judged = add_counts(docs, F.col(text), p).withColumn(f"{p}stratum", stratum_of(stratum))
    kept = ~base_failed(p) & ~reject_above(cutoffs, F.col(f"{p}stratum"), signals(p))
    # A filter on plain columns would be pushed below the counting and repeat all of it in itself.
    judged = judged.withColumn(f"{p}row", F.monotonically_increasing_id())
    return judged.filter(kept & (F.col(f"{p}row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
