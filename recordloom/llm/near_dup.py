"""SimHash near-duplicates by segment popcounts.

A fingerprint is embedded as the bit counts of its segments. The Manhattan distance of two
such points is never more than the Hamming distance of the fingerprints, so pairs within
distance d lie within d on the grid. Two grid points within 2 share a grid point at most 1
away from both: each fingerprint is sent to its own cell and the cells next to it, and pairs
that meet in a cell are verified bit by bit.

``keep_one`` takes these links, and adds those of a Jaccard similarity of five-word shingles. Texts of
similarity 0.8 are up to 11 bits apart, too far for the grid, so it finds such candidates by bands of
minimum hashes.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other;
documents with a null id take part and get the smallest id of their component (null if it has
none); repeated rows are answered alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import lower_words, map_batches, stored
from recordloom.operators.components import connected_components
from recordloom.session import cut_lineage

SEGMENT_BITS = 4
# Bands of minimum hashes, by which keep_one finds candidates.
BANDS, BAND_ROWS = 24, 5
EXACT_SIZES = 128


def majority_bits(hashes: np.ndarray) -> int:
    """Unsigned 64-bit number whose bit is 1 if set in over half of the hashes; in blocks of bounded memory."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 32768):
        part = np.ascontiguousarray(hashes[at : at + 32768], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text, as a signed long with the 64 bits."""
    import xxhash

    words = lower_words(text)
    if not words:
        return 0
    if len(words) <= shingle:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    return _signed(majority_bits(np.array([digest(r, seed) for r in runs], dtype=np.uint64)))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, body, bits): the SimHash of every document, as a signed long with the 64 bits; body is the text's hash."""
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))

    def task():
        def handle(columns):
            yield {"id": columns["id"], "body": columns["body"], "bits": [fingerprint(t.as_py(), shingle, seed) for t in columns["text"]]}

        return handle

    return map_batches(rows, f"id {rows.schema['id'].dataType.simpleString()}, body long, bits long", task)


def segment_counts(bits: Column) -> list[Column]:
    """Bit count of each segment, lowest first."""
    mask = (1 << SEGMENT_BITS) - 1
    return [F.bit_count(F.shiftrightunsigned(bits, s).bitwiseAND(F.lit(mask))) for s in range(0, 64, SEGMENT_BITS)]


def cells(bits: Column) -> Column:
    """The grid cell of a fingerprint and its neighbours at Manhattan distance 1, each packed into a long."""
    counts = segment_counts(bits)
    places = [1 << (3 * i) for i in range(len(counts))]
    own = sum((c.cast("long") * F.lit(p).cast("long") for c, p in zip(counts[1:], places[1:])), counts[0].cast("long"))
    near = [F.lit(0).cast("long")]
    for count, place in zip(counts, places):
        near.append(F.when(count < SEGMENT_BITS, F.lit(place).cast("long")))
        near.append(F.when(count > 0, F.lit(-place).cast("long")))
    return F.transform(F.filter(F.array(*near), lambda x: x.isNotNull()), lambda x: x + own)


def close_pairs(prints: DataFrame, hot_cell: int = 32) -> DataFrame:
    """Edges (a, b) between distinct ``prints(bits)`` at most 2 bits apart, enough to connect all that are.

    Cells of up to ``hot_cell`` fingerprints are joined with themselves, so a row meets a bounded
    number of others. The fingerprints of a fuller cell are verified without pairs: two of them
    are within 2 bits exactly if flipping at most one bit of each gives one number, so each is
    sent to its 65 flips and all that share one are linked to the smallest.
    """
    placed = prints.select("bits", F.explode(cells(F.col("bits"))).alias("cell"))
    filled = placed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    placed = placed.join(filled, "cell")
    left = placed.filter(F.col("n") <= hot_cell).select("cell", F.col("bits").alias("a"))
    right = left.withColumnRenamed("a", "b")
    cold = left.join(right, "cell").filter("a < b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b").distinct()

    hot = placed.filter(F.col("n") > hot_cell).select("bits").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)])
    flipped = hot.select("bits", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("bits")))).alias("meet"))
    # At most 65 fingerprints share a number.
    stars = (
        flipped.groupBy("meet").agg(F.collect_list("bits").alias("members")).filter(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a <> b").distinct()
    )
    return cold.unionByName(stars)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _components(docs: DataFrame, id_column: str, text: str, **options) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all documents, and (bits, root, component_id) of the different ones."""
    prints = cut_lineage(fingerprints(docs, id_column=id_column, text=text, **options))
    nodes = cut_lineage(prints.groupBy("bits").agg(F.min("id").alias("least")))
    links = connected_components(close_pairs(nodes.select("bits")).withColumn("g", F.lit(0)), "g", "a", "b")
    rooted = nodes.join(links.select(F.col("node").alias("bits"), F.col("component").alias("root")), "bits", "left").withColumn(
        "root", F.coalesce("root", "bits")
    )
    # Roots first get their least id, then hand it to their members.
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, rooted.join(roots, "root").select("bits", "root", "component_id")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, bits, component_id): one row per document with the smallest id reachable over links.

    Equal fingerprints are one node, whatever the number of copies; only ids, text hashes and
    fingerprints (24 bytes a document) are shuffled.
    """
    prints, labels = _components(docs, id_column, text, **options)
    return prints.join(labels, "bits").select(F.col("id").alias(id_column), "bits", "component_id")


def shingle_set(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the different shingles; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = lower_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) > shingle else [b" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(r, seed) for r in runs], dtype=np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One number per band, equal for two sets if all BAND_ROWS minima of the band are; in blocks of bounded memory."""
    if not len(shingles):
        return np.empty(0, dtype=np.int64)
    draws = np.random.RandomState(20).randint(0, 1 << 32, (4, BANDS * BAND_ROWS), dtype=np.uint64)
    flips, factors = draws[0] << np.uint64(32) | draws[1], draws[2] << np.uint64(32) | draws[3] | np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[at : at + 2048, None] ^ flips) * factors).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _signatures(docs: DataFrame, shingle: int, id_column: str, text: str) -> DataFrame:
    """(id, body, bits, node, n, buckets): texts of equal shingle sets are one node; n is the size of the set."""
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))

    def task():
        import xxhash

        def handle(columns):
            sets = [shingle_set(t.as_py(), shingle) for t in columns["text"]]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            yield {
                "id": columns["id"], "body": columns["body"], "bits": [fingerprint(t.as_py()) for t in columns["text"]],
                "node": nodes, "n": [len(s) for s in sets], "buckets": [band_keys(s) for s in sets],
            }

        return handle

    return map_batches(rows, f"id {rows.schema['id'].dataType.simpleString()}, body long, bits long, node long, n int, buckets array<long>", task)


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): the shingle set of each of ``texts(node, text)``, once per node."""

    def task():
        def handle(columns):
            yield {"node": columns["node"], "shingles": [shingle_set(t.as_py(), shingle).view(np.int64) for t in columns["text"]]}

        return handle

    return map_batches(texts, "node long, shingles array<long>", task)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` whose ``sets(node, shingles)`` have at least the Jaccard similarity."""
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b"
    )

    def task():
        def close(one, other):
            one, other = one.values.to_numpy(), other.values.to_numpy()
            both = len(np.intersect1d(one, other, assume_unique=True))
            return both >= similarity * (len(one) + len(other) - both) - 1e-9

        def handle(columns):
            yield {"a": columns["a"], "b": columns["b"], "close": [close(x, y) for x, y in zip(columns["set_a"], columns["set_b"])]}

        return handle

    return map_batches(rows, "a long, b long, close boolean", task).filter("close").select("a", "b")


def _close_nodes(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes of ``prints(bits, node)`` that connect those whose fingerprints are linked."""
    held = cut_lineage(prints.groupBy("bits").agg(F.min("node").alias("first")))
    same = prints.join(held, "bits").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    one, other = (held.select(F.col("bits").alias(x), F.col("first").alias(f"_{x}")) for x in "ab")
    near = close_pairs(held.select("bits")).join(one, "a").join(other, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return same.unionByName(near)


def _roots(links: DataFrame) -> DataFrame:
    return connected_components(links.withColumn("g", F.lit(0)), "g", "a", "b").select("node", F.col("component").alias("root"))


def _size_class(n: Column) -> Column:
    """Sizes below EXACT_SIZES are classes of their own, larger ones share a class within about one percent."""
    return F.when(n < EXACT_SIZES, n).otherwise(F.floor(F.log2(n / EXACT_SIZES) * 64) + EXACT_SIZES).cast("int")


def _least_size(size_class: int) -> int:
    return size_class if size_class < EXACT_SIZES else int(EXACT_SIZES * 2 ** ((size_class - EXACT_SIZES) / 64))


def _prefix_pairs(crowd: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``crowd(node, root, shingles)`` that may be similar, from different roots, by positional prefix filters.

    Shingles are ordered from rare to common in the crowd. Two similar sets of sizes n and m share
    at least o = s / (1 + s) * (n + m) shingles, so their first common one has at least o - 1 others
    behind it in both. A set thus offers, for each size it may be similar to, only the shingles
    that are so placed, and pairs meet by offered shingle and sizes. Shingles that occur under
    one root alone come first and are never offered: copies that were edited apart, whose own
    edits are the rare shingles, offer nothing.
    """
    tokens = crowd.select("node", "root", F.explode("shingles").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("seen"), F.min("root").alias("low"), F.max("root").alias("high"))
    shared = shared.filter("low <> high").select("token", "seen")
    listed = tokens.join(shared, "token").groupBy("node", "root").agg(F.array_sort(F.collect_list(F.struct("seen", "token"))).alias("tokens"))
    size_class = _size_class(F.size("shingles"))
    sized = listed.select("node", "root", F.col("tokens.token").alias("tokens")).join(crowd.select("node", size_class.alias("own")), "node")
    sized = stored(sized)
    present = sorted(r[0] for r in sized.select("own").distinct().collect())  # sizes in classes, some hundreds at most
    least = {c: _least_size(c) for c in present}
    factor = similarity / (1 + similarity)

    def task():
        def handle(columns):
            out = {"node": [], "root": [], "own": [], "other": [], "token": []}
            for node, root, own, tokens in zip(columns["node"].to_pylist(), columns["root"].to_pylist(), columns["own"].to_pylist(), columns["tokens"]):
                tokens = tokens.values.to_numpy()
                for other in present:
                    # One more than the class at either end, whose members are up to a percent larger.
                    if similarity * least[other] * 0.98 <= least[own] * 1.02 and similarity * least[own] * 0.98 <= least[other] * 1.02:
                        offered = len(tokens) - int(np.ceil(factor * (least[own] + least[other]) - 1e-9)) + 1
                        for token in tokens[: max(0, offered)].tolist():
                            for name, value in zip(out, (node, root, own, other, token)):
                                out[name].append(value)
            yield out

        return handle

    offers = map_batches(sized.select("node", "root", "own", "tokens"), "node long, root long, own int, other int, token long", task)
    keys = ["token", "low", "high"]
    offers = stored(offers.select("node", "root", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "token"))
    met = offers.groupBy(*keys).agg(F.min("root").alias("one"), F.max("root").alias("two")).filter("one <> two").select(*keys)
    offers = offers.join(met, keys, "left_semi")
    left = offers.filter("own = low").select(*keys, F.col("node").alias("x"), F.col("root").alias("root_x"))
    right = offers.filter("own = high").select(*keys, F.col("node").alias("y"), F.col("root").alias("root_y"))
    pairs = left.join(right, keys).filter("root_x <> root_y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _similar_components(docs: DataFrame, id_column: str, text: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Signatures of all documents, and (least, root) of their different shingle sets.

    Linked are texts of close fingerprints, as in ``near_duplicates``, and similar shingle sets. Candidates
    for the latter share a band of minimum hashes. The members of a bucket are first verified against
    one of them, another one per band. Members of buckets that no chain of links has joined by
    then meet again by prefix filters, and only their offered pairs are verified. What moves are
    shingle hashes, made once per text, never texts in pairs.
    """
    prints = cut_lineage(_signatures(docs, shingle, id_column, text))
    nodes = cut_lineage(prints.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "body")).alias("least")))
    placed = prints.select("node", "n", F.explode("buckets").alias("bucket")).distinct()
    centre = F.min(F.struct(F.xxhash64("bucket", "node").alias("at"), "node", "n")).alias("centre")
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size"), centre).filter("size > 1").select("bucket", "centre")
    crowds = cut_lineage(placed.join(shared, "bucket").select("bucket", "node", "n", F.col("centre.node").alias("other"), F.col("centre.n").alias("m")))

    alike = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9
    ordered = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    tried = cut_lineage(crowds.filter("node <> other").filter(alike).select(*ordered).distinct())
    wanted = crowds.select("node").distinct().join(nodes, "node").select("node", "least.id", "least.body")
    rows = docs.select(F.col(id_column).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    texts = rows.join(wanted, rows["doc"].eqNullSafe(wanted["id"]) & (rows["hash"] == wanted["body"])).select("node", "text")
    sets = stored(_shingle_sets(texts, shingle).dropDuplicates(["node"]))
    links = cut_lineage(_close_nodes(prints.select("bits", "node")).unionByName(_similar(tried, sets, similarity)))
    roots = _roots(links)

    rooted = crowds.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("one"), F.max("root").alias("two")).filter("one <> two").select("bucket")
    crowd = rooted.join(mixed, "bucket", "left_semi").select("node", "root").distinct()
    crowd = stored(crowd.join(sets, "node"))
    if not crowd.isEmpty():
        apart = _prefix_pairs(crowd, similarity).join(tried, ["a", "b"], "left_anti")
        more = cut_lineage(_similar(apart, crowd.select("node", "shingles"), similarity))
        if not more.isEmpty():
            roots = _roots(links.unionByName(more))
    return prints, nodes.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` (all columns) with one row of each group of similar texts: that of the smallest id (nulls last), then of the smallest text hash.

    Linked are texts that ``near_duplicates`` links, and texts whose sets of ``shingle`` words have a
    Jaccard ``similarity`` of at least that value; groups are what links connect. Two similar texts share
    a band with a chance of 0.9999 at 0.8 and more above, so bands suit a similarity of 0.8 or higher.
    """
    prints, labels = _similar_components(docs, id_column, text, shingle, similarity)
    first = labels.groupBy("root").agg(F.min("least").alias("least")).select("least.id", "least.body")
    names = {c: f"_col{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn("_body", F.xxhash64(names[text]))
    kept = rows.join(first, rows[names[id_column]].eqNullSafe(first["id"]) & (rows["_body"] == first["body"]), "left_semi")
    # Rows of one id and text are the same document: one of them stays.
    repeated = prints.groupBy("id", "body").count().filter("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([names[id_column], "_body"])
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def fingerprint_text(bits: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
