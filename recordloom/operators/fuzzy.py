"""Similarity joins of strings within a key, without comparing all pairs.

Values are first reduced to *forms* (token-sorted strings), so equal forms meet by hashing.
Two filters then bring similar forms together, and both lose nothing:

* Deletion variants, for short forms. Two strings have indel distance d exactly when deleting
  d characters in total makes them equal, so neighbours share a variant. The test is also
  sufficient: strings that share a variant of length l have LCS >= l.
* Token prefixes, for the rest. Neighbours share a known minimum of bigrams (of characters
  where strings are too short, or the threshold too low, for bigrams), so they share one
  among the rarest few of each (prefix filtering, as in Vernica, Carey and Li, "Efficient
  Parallel Set-Similarity Joins Using MapReduce").

Forms that meet at a signature are compared inside tasks. A hot signature is cut into blocks,
and each task gets one pair of blocks, so no task holds an unbounded group.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.similarity import lcs_length, ratio, within
from recordloom.functions.text import token_sort
from recordloom.session import cut_lineage, merged, spread

# Variants a form may have before the token filter takes over.
VARIANT_BUDGET = 600
# Up to this length variants are cheap at every threshold.
SHORT_FORM = 6
BLOCK_ROWS = 512


def forms(values: DataFrame) -> DataFrame:
    """(key_name, form, n, weight, first_value) from distinct (key_name, value)."""
    return (
        values.select("key_name", "value", token_sort("value").alias("form"))
        .groupBy("key_name", "form")
        .agg(F.count("*").alias("weight"), F.min("value").alias("first_value"))
        .withColumn("n", F.length("form"))
    )


def useful_variant_lengths(n: int, lengths: list[int], threshold: float) -> list[int]:
    """Variant lengths at which a form of length ``n`` can meet a partner of a present length."""
    useful = set()
    for m in lengths:
        for size in range(min(m, n), -1, -1):
            if not within(m + n - 2 * size, m + n, threshold):
                break
            useful.add(size)
    return sorted(useful)


def variant_count(n: int, sizes: list[int]) -> int:
    return sum(math.comb(n, n - size) for size in sizes)


def _variants(form: str, sizes: list[int]) -> set[str]:
    found: set[str] = set()
    for size in sizes:
        found.update("".join(pick) for pick in combinations(form, size))
    return found


def _min_shared(n: int, threshold: float, q: int) -> int:
    """q-grams a form of length ``n`` shares with any neighbour, whatever its length.

    With LCS = l, going from n to m characters deletes n - l (each breaks at most q q-grams)
    and inserts m - l (each breaks at most q - 1). The bound is linear in m, so only the
    extreme partner lengths count.
    """
    bounds = []
    for m in (n * threshold / (2 - threshold), n * (2 - threshold) / threshold):
        common = threshold * (m + n) / 2
        bounds.append((n - q + 1) - q * (n - common) - (q - 1) * (m - common))
    return math.ceil(min(bounds) - 1e-6)


def bigrams_from(threshold: float) -> float:
    """Smallest length from which neighbours surely share a bigram; infinite at low thresholds."""
    if threshold <= 2 / 3 + 1e-9:
        return math.inf
    n = 1
    while _min_shared(n, threshold, 2) < 1:
        n += 1
    return n


def _length_plan(table: DataFrame, threshold: float, budget: int) -> DataFrame:
    """Per (key, n): variant lengths to emit, or an empty list where tokens are cheaper."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for n, lengths in zip(batch["n"], batch["lengths"]):
                useful = useful_variant_lengths(n, list(lengths), threshold)
                cheap = n <= SHORT_FORM or variant_count(n, useful) <= budget
                sizes.append(useful if cheap else [])
            yield pd.DataFrame({"key_name": batch["key_name"], "n": batch["n"], "sizes": sizes})

    present = table.select("key_name", "n").distinct()
    # A partner of length m needs m between t/(2-t) and (2-t)/t of n.
    high = (2 - threshold) / threshold
    lengths = present.groupBy("key_name").agg(F.array_sort(F.collect_set("n")).alias("all_lengths"))
    near = present.join(lengths, "key_name").select(
        "key_name",
        "n",
        F.filter("all_lengths", lambda m: (m <= F.col("n") * high + 1) & (m * high + 1 >= F.col("n"))).alias("lengths"),
    )
    return near.mapInPandas(plan, "key_name string, n int, sizes array<int>")


def _emit_variants(planned: DataFrame) -> DataFrame:
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, sigs, whole = [], [], []
            for key, form, sizes in zip(batch["key_name"], batch["form"], batch["sizes"]):
                for variant in _variants(form, list(sizes)):
                    keys.append(key)
                    sigs.append(variant)
                    whole.append(form)
                if len(keys) > 100_000:
                    yield pd.DataFrame({"key_name": keys, "sig": sigs, "form": whole})
                    keys, sigs, whole = [], [], []
            yield pd.DataFrame({"key_name": keys, "sig": sigs, "form": whole})

    return spread(planned.select("key_name", "form", "sizes"), "form").mapInPandas(
        emit, "key_name string, sig string, form string"
    )


def _emit_tokens(table: DataFrame, threshold: float) -> DataFrame:
    """Numbered q-grams, so that a repeated one counts as often as it occurs.

    Pairs of forms that both reach ``bigrams_from`` meet by bigrams, all others by
    characters; a form takes part in each space in which it can have a partner.
    """
    start = bigrams_from(threshold)
    reach = threshold / (2 - threshold)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, spaces, grams, whole = [], [], [], []
            for key, form in zip(batch["key_name"], batch["form"]):
                n = len(form)
                wanted = [q for q, fits in ((1, n * reach - 1 < start), (2, n >= start)) if fits]
                for q in wanted:
                    seen: Counter[str] = Counter()
                    for i in range(n - q + 1):
                        gram = form[i : i + q]
                        seen[gram] += 1
                        keys.append(key)
                        spaces.append(q)
                        grams.append(f"{q}{gram}{seen[gram]}")
                        whole.append(form)
            yield pd.DataFrame({"key_name": keys, "space": spaces, "gram": grams, "form": whole})

    return spread(table.select("key_name", "form"), "form").mapInPandas(
        emit, "key_name string, space int, gram string, form string"
    )


def _prefixes(table: DataFrame, threshold: float) -> DataFrame:
    """(key_name, sig, form, prefix): the rarest q-grams of every form, rarest first."""
    grams = _emit_tokens(table, threshold)
    counts = grams.groupBy("key_name", "gram").agg(F.count("*").alias("holders"))
    # As many entries per form as it has characters.
    ranked = (
        merged(grams, counts, ["key_name", "gram"])
        .groupBy("key_name", "form", "space")
        .agg(F.array_sort(F.collect_list(F.struct("holders", "gram"))).alias("grams"))
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, sigs, whole, prefixes = [], [], [], []
            for key, form, q, ordered in zip(batch["key_name"], batch["form"], batch["space"], batch["grams"]):
                shared = _min_shared(len(form), threshold, q)
                keep = ordered[: len(ordered) - shared + 1]
                prefix = [g["gram"] for g in keep]
                for g in keep:
                    if g["holders"] > 1:
                        keys.append(key)
                        sigs.append(g["gram"])
                        whole.append(form)
                        prefixes.append(prefix)
            yield pd.DataFrame({"key_name": keys, "sig": sigs, "form": whole, "prefix": prefixes})

    return ranked.mapInPandas(cut, "key_name string, sig string, form string, prefix array<string>")


def _block_pairs(pieces: DataFrame, block_rows: int) -> DataFrame:
    """Send every signature's forms to pairs of bounded blocks; lone forms go nowhere."""
    counts = (
        pieces.groupBy("key_name", "sig")
        .agg(F.count("*").alias("_n"))
        .filter("_n > 1")
        .withColumn("_blocks", F.ceil(F.col("_n") / block_rows).cast("int"))
        .drop("_n")
    )
    own = F.pmod(F.xxhash64("form"), F.col("_blocks")).cast("int")
    return (
        merged(pieces, counts, ["key_name", "sig"])
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            *pieces.columns,
            F.least("_own", "_other").alias("low"),
            F.greatest("_own", "_other").alias("high"),
            F.col("_own").alias("own"),
        )
    )


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal ``keys``, also across batch borders."""
    pending: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        marks = batch[keys].ne(batch[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        if pending and (batch[keys].iloc[0] == pending[-1][keys].iloc[-1]).all():
            marks = marks[1:]
            if not marks:
                pending.append(batch)
                continue
            pending.append(batch.iloc[: marks[0]])
            yield pd.concat(pending)
        elif pending:
            yield pd.concat(pending)
        for start, end in zip(marks, marks[1:]):
            yield batch.iloc[start:end]
        pending = [batch.iloc[marks[-1] :]]
    if pending:
        yield pd.concat(pending)


class _Comparer:
    """Neighbour test of two forms at one signature, cheapest checks first."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.bags: dict[str, Counter[str]] = {}

    def bag(self, form: str) -> Counter[str]:
        if form not in self.bags:
            self.bags[form] = Counter(form)
        return self.bags[form]

    def similarity(self, a: str, b: str) -> float | None:
        total = len(a) + len(b)
        if not within(abs(len(a) - len(b)), total, self.threshold):
            return None
        common = sum((self.bag(a) & self.bag(b)).values())
        if not within(total - 2 * common, total, self.threshold):
            return None
        distance = total - 2 * lcs_length(a, b)
        return ratio(distance, total) if within(distance, total, self.threshold) else None


def _first_shared(prefix: list[str], other: set[str]) -> str | None:
    return next((gram for gram in prefix if gram in other), None)


def _verified(threshold: float, spanning: bool):
    """Task body: all neighbour pairs of a block pair, or only edges that span its components."""

    def pairs_of(group: pd.DataFrame) -> Iterator[tuple[str, str, float]]:
        compare = _Comparer(threshold)
        sig = group["sig"].iloc[0]
        cross = group["low"].iloc[0] != group["high"].iloc[0]
        rows = sorted(
            {f: (o, list(p), set(p)) for f, o, p in zip(group["form"], group["own"], group["prefix"])}.items()
        )

        def meets(x, y) -> bool:
            # A pair is compared at its first shared token only, and once per block pair.
            if cross and not spanning and x[1][0] == y[1][0]:
                return False
            return not x[1][1] or _first_shared(x[1][1], y[1][2]) == sig

        if not spanning:
            for i, x in enumerate(rows):
                for y in rows[i + 1 :]:
                    if meets(x, y):
                        found = compare.similarity(x[0], y[0])
                        if found is not None:
                            yield x[0], y[0], found
            return
        waiting = rows
        while waiting:  # breadth-first: a form once reached is not compared again
            queue, waiting = [waiting[0]], waiting[1:]
            while queue and waiting:
                x = queue.pop()
                rest = []
                for y in waiting:
                    found = compare.similarity(x[0], y[0]) if meets(x, y) else None
                    if found is None:
                        rest.append(y)
                    else:
                        queue.append(y)
                        yield min(x[0], y[0]), max(x[0], y[0]), found
                waiting = rest

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["key_name", "sig", "low", "high"]):
            if len(group) > 1:
                found = list(pairs_of(group))
                if found:
                    a, b, s = zip(*found)
                    yield pd.DataFrame({"key_name": group["key_name"].iloc[0], "a": a, "b": b, "similarity": s})

    return run


def _compare(pieces: DataFrame, threshold: float, spanning: bool, block_rows: int) -> DataFrame:
    keys = ["key_name", "sig", "low", "high"]
    blocks = spread(_block_pairs(pieces, block_rows), *keys).sortWithinPartitions(*keys)
    return blocks.mapInPandas(
        _verified(threshold, spanning), "key_name string, a string, b string, similarity double"
    )


def _split_by_plan(table: DataFrame, threshold: float, budget: int) -> tuple[DataFrame, DataFrame]:
    """Forms with their plan, once for the variants and once for the token filter.

    A pair with at least one planless form is the token filter's; the other form may have a
    plan, so every form long enough to be its partner also goes there.
    """
    plan = cut_lineage(_length_plan(table, threshold, budget))
    shape = table.join(plan, ["key_name", "n"])
    reach = threshold / (2 - threshold)
    first = (
        plan.filter("size(sizes) = 0")
        .groupBy("key_name")
        .agg(F.min("n").alias("from_n"))
    )
    longer = shape.join(first, "key_name").filter(F.col("n") + 1 >= F.col("from_n") * reach)
    return shape.filter("size(sizes) > 0"), longer


def similar_forms(table: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All neighbour pairs (key_name, a, b, similarity) of forms, a < b."""
    short, long = _split_by_plan(table, threshold, budget=0)
    variants = _emit_variants(short).withColumn("prefix", F.array().cast("array<string>"))
    grams = _prefixes(long, threshold)
    return (
        _compare(variants, threshold, False, block_rows)
        .unionByName(_compare(grams, threshold, False, block_rows))
        .groupBy("key_name", "a", "b")
        .agg(F.max("similarity").alias("similarity"))
    )


def spanning_edges(
    table: DataFrame, threshold: float, budget: int = VARIANT_BUDGET, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Edges (key_name, a, b) whose components are those of the full neighbour graph.

    At a variant, the shortest form is a neighbour of every form that has a neighbour there:
    if |a| + |b| is small enough for the shared length, so is |shortest| + |a|. So one star
    per variant replaces all pairs, and the number of edges stays linear.
    """
    short, long = _split_by_plan(table, threshold, budget)
    variants = _emit_variants(short)
    leaders = variants.groupBy("key_name", "sig").agg(
        F.min(F.struct(F.length("form").alias("n"), F.col("form").alias("leader"))).alias("_l"),
        F.count("*").alias("_n"),
    )
    total = F.length("form") + F.length("leader")
    distance = total - 2 * F.length("sig")
    score = (F.lit(1.0) - distance / total) * F.lit(100.0) / F.lit(100.0)
    stars = (
        merged(variants, leaders.filter("_n > 1").select("key_name", "sig", "_l.leader"), ["key_name", "sig"])
        .filter((F.col("form") != F.col("leader")) & (F.lit(1.0) - score <= F.lit(1.0 - threshold)))
        .select("key_name", F.least("form", "leader").alias("a"), F.greatest("form", "leader").alias("b"))
    )
    trees = _compare(_prefixes(long, threshold), threshold, True, block_rows).select("key_name", "a", "b")
    return stars.unionByName(trees).distinct()


def similar_pairs(values: DataFrame, threshold: float) -> DataFrame:
    """All neighbour pairs (key_name, value_a, value_b, similarity) of distinct values."""
    table = forms(values)
    named = values.select("key_name", "value", token_sort("value").alias("form"))
    left = named.select("key_name", F.col("form").alias("a"), F.col("value").alias("x"))
    right = named.select("key_name", F.col("form").alias("b"), F.col("value").alias("y"))
    across = (
        similar_forms(table, threshold)
        .join(left, ["key_name", "a"])
        .join(right, ["key_name", "b"])
        .select("key_name", F.least("x", "y").alias("value_a"), F.greatest("x", "y").alias("value_b"), "similarity")
    )
    same = (
        named.join(table.filter("weight > 1").select("key_name", "form"), ["key_name", "form"], "left_semi")
        .select("key_name", "form", F.col("value").alias("value_a"))
        .join(right.select("key_name", F.col("b").alias("form"), F.col("y").alias("value_b")), ["key_name", "form"])
        .filter("value_a < value_b")
        .select("key_name", "value_a", "value_b", F.lit(1.0).alias("similarity"))
    )
    return across.unionByName(same)
