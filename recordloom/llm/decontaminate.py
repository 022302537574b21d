"""Benchmark decontamination: Wu-Manber search for windows of test items in documents.

Defined cases: a null or wordless text has no words and no hit; an item without words has no
window; items with one id count as one; an item with a null id hits words but isn't listed;
repeated documents are judged alike; empty tables give empty or clean results; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import map_batches

# Fixed rule: words are runs of ASCII letters and digits, and of anything beyond ASCII.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def windows(words: list, length: int) -> list[tuple]:
    """All runs of ``length`` words; a shorter item is one window, none has none."""
    if len(words) < length:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + length]) for i in range(len(words) - length + 1)]


class WuManber:
    """Windows of one length over word numbers, by shift table and suffix buckets.

    ``block`` words are looked at together. ``shift`` tells how far the window may move when it
    ends on a block; blocks that end a pattern lead to the bucket of the patterns to compare.
    """

    def __init__(self, patterns: dict[tuple, set], length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(dict)
        for pattern, items in patterns.items():
            for end in range(self.block - 1, length):
                key = self._key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.default), length - 1 - end)
            self.buckets[self._key(pattern, length - 1)][pattern] = items

    def _key(self, words, end: int):
        return words[end] if self.block == 1 else (words[end - 1], words[end])

    def search(self, words: list[int]):
        """(start, items) of every occurrence."""
        length, shift, default = self.length, self.shift, self.default
        at, n = length - 1, len(words)
        while at < n:
            key = words[at] if self.block == 1 else (words[at - 1], words[at])
            step = shift.get(key, default)
            if step:
                at += step
                continue
            items = self.buckets[key].get(tuple(words[at - length + 1 : at + 1]))
            if items is not None:
                yield at - length + 1, items
            at += 1


def build_tables(items: list[tuple], window: int) -> tuple[dict[bytes, int], list[WuManber]]:
    """Word numbers (from 1; other words are 0) and a search table per window length."""
    numbers: dict[bytes, int] = {}
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        for run in windows(plain_words(text), window):
            key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in run)
            by_length[len(key)][key].add(item)
    return numbers, [WuManber(patterns, length) for length, patterns in sorted(by_length.items())]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_chars: int):
    """The items as lists whose texts have about ``block_chars`` characters at most."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-2 * size // block_chars) if size > block_chars else 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for b in range(blocks):
        yield [tuple(r) for r in items.filter(block == b).collect()]


def _find(docs: DataFrame, items: list[tuple], window: int) -> DataFrame:
    tables = docs.sparkSession.sparkContext.broadcast(items)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def task():
        numbers, machines = build_tables(tables.value, window)
        number = numbers.get

        def one(text):
            words = plain_words(text)
            ids = [number(w, 0) for w in words]
            spans, found = [], set()
            for machine in machines:
                for start, items in machine.search(ids):
                    found |= items
                    spans.append((start, start + machine.length))
            merged: list[list[int]] = []
            for start, end in sorted(spans):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            return len(words), merged, sorted(str(x) for x in found if x is not None)

        def handle(columns):
            results = [one(t.as_py()) for t in columns["text"]]
            yield {k: columns[k] for k in columns if k != "text"} | {
                "n_words": [r[0] for r in results],
                "spans": [[{"from": a, "to": b} for a, b in r[1]] for r in results],
                "items": [r[2] for r in results],
            }

        return handle

    kept = ", ".join(f"`{k}` {v}" for k, v in types.items() if k != "text")
    return map_batches(docs, f"{kept}, n_words long, spans array<struct<`from`:long,`to`:long>>, items array<string>", task)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_chars: int = 8_000_000,
) -> DataFrame:
    """(id, text_hash, n_words, spans, items): word spans hit in each document, and the items found.

    Benchmarks of up to ``block_chars`` characters are one table, sent to every task. A larger
    one is cut into blocks of at most that size in sum (and at least one item); each block is
    searched by itself and the spans of a document meet by its id and text hash.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    parts = [_find(rows, block, window) for block in _blocks(benchmark, item_id, item_text, block_chars)]
    blocks, found = len(parts), parts[0]
    if blocks > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        found = _merge_blocks(found, blocks)
    return found.withColumnRenamed("id", id_column)


def _merge_blocks(found: DataFrame, blocks: int) -> DataFrame:
    """One row per document from the rows of several blocks; copies of a row keep their number.

    The copies of one row (same id and text) all bring the same spans, so sets of spans and
    items stay within what one document can hold.
    """
    key = ["id", "text_hash", "n_words"]
    copies = found.groupBy(*key).agg((F.count("*") / blocks).cast("int").alias("copies"))
    spans = (
        found.select(*key, F.explode_outer("spans").alias("span")).distinct()
        .groupBy(*key).agg(F.sort_array(F.collect_list("span")).alias("all_spans"))
    )
    items = (
        found.select(*key, F.explode_outer("items").alias("item")).distinct()
        .groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    merged = copies
    for other in (spans, items):
        named = other.select(*[F.col(k).alias(f"_{k}") for k in key], *[c for c in other.columns if c not in key])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        merged = merged.join(named, same).drop(*[f"_{k}" for k in key])
    merged = merged.select(*key, "all_spans", "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    # Spans are in order of their start: extend the last one or open a new one.
    joined = F.aggregate(
        "all_spans",
        F.array().cast("array<struct<`from`:long,`to`:long>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["from"] <= F.element_at(done, -1)["to"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["from"].alias("from"), F.greatest(F.element_at(done, -1)["to"], x["to"]).alias("to"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return merged.select("id", "text_hash", "n_words", joined.alias("spans"), "items")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_chars: int = 8_000_000,
) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no window of an item occurs. Narrow: one pass per block of items."""
    names = {c: f"_col{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    for block in _blocks(benchmark, item_id, item_text, block_chars):
        rows = _find(rows.withColumn("text", F.col(names[text])), block, window).filter(F.size("spans") == 0)
        rows = rows.select(*names.values())
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def digest(items: list[str]) -> str:
    """SHA-256 of the sorted ids joined by commas."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document."""
    found = contamination(docs, benchmark, **options)
    id_column = options.get("id_column", "doc_id")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return found.select(
        id_column, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
