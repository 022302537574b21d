"""Nearest neighbours by cosine, and vector aggregates.

Queries are rows with an id and a vector, corpora likewise. Optional group columns restrict a
query to corpus rows of equal group; a query may occur with several groups and still gets
its k best overall.

A small query set (its size is checked) is sent to every task and the corpus is scanned once,
without a shuffle. Beyond that, both sides are cut into cells around pivots, and the triangle
inequality decides which cells a query must visit (as in Lu et al., "Efficient Processing of
k Nearest Neighbor Joins using MapReduce"). Both ways are exact and give the same rows: score
is the cosine clamped to [0, 1], ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from recordloom.functions.vectors import clamp01
from recordloom.session import cut_lineage, stored

# Largest query side that is broadcast: rows, and vector bytes in total.
BROADCAST_QUERIES = 2048
BROADCAST_BYTES = 64 << 20
PIVOTS = 48
ZERO_CELL = -1
# Numbers in a block of corpus vectors; a block of queries has half as many rows.
BLOCK_VALUES = 1 << 21
# A block of codes has so many times the rows, scored part by part, and a block of its queries the same number less.
CODE_BLOCKS = 4
# Products held at once, and columns of which only the largest product is compared at first.
BLOCK_PAIRS = 4_000_000
SLICE_ROWS = 32
_DECIMALS = 12
# More than rounding can move two scores.
_TIE = 2e-12
_SLACK = 1e-6


def _matrix(vectors) -> np.ndarray:
    """Unit rows; a zero vector stays zero, so its cosine is 0."""
    out = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _flat_matrix(vectors: pa.Array) -> np.ndarray:
    """As ``_matrix``, of an Arrow column of vectors of one length."""
    out = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _pairs(queries: np.ndarray, corpus: np.ndarray, k: int, clamped: bool, hide: Callable | None = None) -> Iterator[tuple]:
    """(rows, columns, products) with every pair that can be among the k best of its row, some rows at a time.

    Products are taken in single precision first. The k-th of the largest products of slices of the
    columns is at most a row's k-th product, and only pairs that reach it, less what rounding can
    move, are computed in double precision. Rows with too many of them, or without a limit, are
    computed whole. ``clamped``: products count as within [0, 1]; ``hide(table, rows, columns)`` takes
    pairs out, where ``columns`` has the column of the corpus at each place of ``table``, or is None.
    """
    n, size = corpus.shape
    slices = min(SLICE_ROWS, n // (4 * max(1, k)))
    quick = slices > 1 and np.isfinite(queries).all() and np.isfinite(corpus).all()
    if quick:
        width = -(-n // slices)
        single = np.zeros((width * slices, size), dtype=np.float32)
        single[:n] = corpus
        asked = queries.astype(np.float32)
        lengths = np.sqrt((corpus * corpus).sum(axis=1).max()), np.sqrt((queries * queries).sum(axis=1).max(initial=0.0))
        slack = (size + 4) * 2.0**-22 * lengths[0] * lengths[1]
    step = max(1, BLOCK_PAIRS // max(1, n))
    for start in range(0, len(queries), step):
        rows = np.arange(start, min(len(queries), start + step))
        if quick:
            table = asked[rows[0] : rows[-1] + 1] @ single.T
            table[:, n:] = -np.inf
            if hide:
                hide(table, rows)
            cut = table.reshape(len(rows), slices, width)
            peaks = cut.max(axis=1)
            limit = np.partition(peaks, width - k, axis=1)[:, width - k].astype(np.float64)
            limit = np.minimum(limit, 1.0) - slack - _TIE if clamped else limit - slack
            known = limit > (slack + _TIE if clamped else -np.inf)
            row, at = np.nonzero((peaks >= limit[:, None]) & known[:, None])
            heavy = np.bincount(row, minlength=len(rows)) > width // 2
            known &= ~heavy
            row, at = row[known[row]], at[known[row]]
            some, which = np.nonzero(cut[row, :, at] >= limit[row][:, None])
            r, c = rows[row[some]], which * width + at[some]
            products = np.empty(len(r))
            piece = max(1, BLOCK_VALUES // (2 * size))
            for low in range(0, len(r), piece):
                products[low : low + piece] = np.einsum("ij,ij->i", queries[r[low : low + piece]], corpus[c[low : low + piece]])
            yield r, c, products
            rows = rows[~known]
        if len(rows):
            table = queries[rows] @ corpus.T
            if hide:
                hide(table, rows)
            if n > k:
                limit = np.partition(table, n - k, axis=1)[:, n - k, None]
                if clamped:
                    # Scores are rounded and clamped, so near limits tie, and all non-positive ones do.
                    limit = np.where(limit <= _TIE, -np.inf, np.minimum(limit, 1.0) - _TIE)
                r, c = np.nonzero((table >= limit) & (table > -np.inf) if hide else table >= limit)
            else:
                r, c = np.nonzero(table > -np.inf) if hide else (x.ravel() for x in np.indices(table.shape))
            yield rows[r], c, table[r, c]


def _first(r: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest ``s`` of each ``r``, best first; ties go to the smaller ``c``."""
    order = np.lexsort((c, -s, r))
    r, c, s = r[order], c[order], s[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep], s[keep]


def _best(queries: np.ndarray, corpus: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, corpus row, score) of the k best per query; corpus rows come in id order.

    Only products that can be among the k best are rounded and sorted.
    """
    found = [_first(r, c, np.round(np.clip(s, 0.0, 1.0), _DECIMALS), k) for r, c, s in _pairs(queries, corpus, k, True)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _usable(df: DataFrame, id_column: str, groups: list[str], vector: str, prefix: str) -> DataFrame:
    # Floats travel as they are; tasks compute in double precision.
    kind = "array<float>" if df.schema[vector].dataType == ArrayType(FloatType()) else "array<double>"
    return df.select(
        F.col(id_column).alias(f"{prefix}_id"), *groups, F.col(vector).cast(kind).alias(f"{prefix}_vec"), F.size(vector).alias("size_of_vector")
    ).filter(F.col("size_of_vector") > 0)


def _types(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def _scan(queries: pd.DataFrame, corpus: DataFrame, groups: list[str], k: int, schema: str) -> DataFrame:
    """Best k of each corpus partition for every query of the bounded query side."""
    members: dict[tuple, list[int]] = {}
    for i, tag in enumerate(queries[groups].itertuples(index=False, name=None)):
        members.setdefault(tag, []).append(i)
    vectors = queries["q_vec"].tolist()
    packed = {tag: (np.asarray(rows), _matrix([vectors[i] for i in rows])) for tag, rows in members.items()}
    shipped = corpus.sparkSession.sparkContext.broadcast((queries["q_id"].tolist(), packed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, packed = shipped.value
        kept = pd.DataFrame({"row": [], "c_id": [], "score": []})
        for batch in batches:
            batch = batch.sort_values("c_id", kind="stable")
            found = [kept] if len(kept) else []
            for tag, part in batch.groupby(groups, sort=False):
                if tag in packed:
                    rows, vectors = packed[tag]
                    q, c, s = _best(vectors, _matrix(part["c_vec"]), k)
                    # "row" tells apart the groups of one query.
                    found.append(pd.DataFrame({"row": rows[q], "c_id": part["c_id"].to_numpy()[c], "score": s}))
            if not found:
                continue
            kept = pd.concat(found).sort_values(["row", "score", "c_id"], ascending=[True, False, True])
            kept = kept.groupby("row", sort=False).head(k)
        if len(kept):
            yield pd.DataFrame({"q_id": [ids[i] for i in kept["row"]], "c_id": kept["c_id"].to_numpy(), "score": kept["score"].to_numpy()})

    return corpus.mapInPandas(run, schema)


def _place(df: DataFrame, prefix: str, pivots: np.ndarray) -> DataFrame:
    """Vectors with their nearest pivot and the distance of their unit vector to it; zero vectors get an own cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = _matrix(batch[f"{prefix}_vec"])
                away = _distances(unit, pivots)
                cell = away.argmin(axis=1)
                away = away[np.arange(len(unit)), cell]
                cell[~unit.any(axis=1)] = ZERO_CELL
                yield batch.assign(cell=cell.astype("int32"), away=away)

    return df.mapInPandas(run, f"{_types(df, *df.columns)}, cell int, away double")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(squared, 0.0))


def _probes(queries: DataFrame, cells: DataFrame, groups: list[str], pivots: np.ndarray, k: int) -> DataFrame:
    """The cells each query has to visit.

    For unit vectors, cosine order is distance order. A query's k-th neighbour is no farther
    than theta: walk the cells by their farthest possible point until k points are covered.
    A cell is skipped when even its nearest possible point lies beyond theta. Scores are
    clamped at 0, so when theta exceeds sqrt(2) all non-positive cosines tie and every cell
    counts. Zero vectors score 0 against all, like a right angle; as queries they tie with
    everything. A query is sent once to each bin with such cells; bit c + 1 of ``visits`` stands
    for cell c.
    """
    # At most PIVOTS cells per group, and the zero cell.
    table = cells.groupBy(*groups).agg(
        F.collect_list(F.struct("cell", "points", "near", "far")).alias("_cells"), F.collect_list(F.struct("bin", _bit("cell").alias("bit"))).alias("_bits")
    )
    joined = queries.join(F.broadcast(table), groups)
    columns = ["q_id", *groups, "q_vec"]
    listed = ["_cell", "_points", "_near", "_far"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            unit = _matrix(batch["q_vec"])
            away = _distances(unit, pivots)
            chosen = []
            for row, zero, cell, points, near, far in zip(away, ~unit.any(axis=1), *(batch[x] for x in listed)):
                right = cell == ZERO_CELL
                upper = np.where(right, np.sqrt(2.0), row[cell] + far)
                order = np.argsort(upper)
                covered = np.searchsorted(np.cumsum(points[order]), k)
                theta = upper[order][covered] if covered < len(order) else np.inf
                if zero or theta >= np.sqrt(2.0) - _SLACK:
                    theta = np.inf
                lower = np.where(right, np.sqrt(2.0), np.maximum(row[cell] - far, near - row[cell]))
                chosen.append(int((1 << (cell[lower <= theta + _SLACK].astype(np.int64) + 1)).sum()))
            yield batch[[*columns, "_bins", "_bit"]].assign(visits=chosen)

    # A list a field: plain arrays pass through tasks cheaply, lists of structs become an object an entry.
    flat = joined.select(*columns, *(F.col(f"_cells.{x[1:]}").alias(x) for x in listed), F.col("_bits.bin").alias("_bins"), F.col("_bits.bit").alias("_bit"))
    probes = flat.mapInPandas(run, f"{_types(queries, *columns)}, _bins array<int>, _bit array<bigint>, visits bigint")
    met = F.filter(F.arrays_zip("_bins", "_bit"), lambda x: x["_bit"].bitwiseAND(F.col("visits")) != 0)
    return probes.select(*columns, "visits", F.explode(F.array_distinct(F.transform(met, lambda x: x["_bins"]))).alias("bin"))


def _bit(cell: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(cell) + 1)


def _packed(cells: DataFrame, groups: list[str], block_rows: int) -> DataFrame:
    """Cells with the bin of about ``block_rows`` points that they share with others of their group.

    A query is sent once a bin, however many of its cells it visits.
    """
    earlier = Window.partitionBy(*groups).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("bin", F.floor(F.coalesce(F.sum("points").over(earlier), F.lit(0)) / block_rows).cast("int"))


def _by_cells(queries: DataFrame, corpus: DataFrame, groups: list[str], k: int, schema: str, block_rows: int | None) -> DataFrame:
    sample = corpus.select("c_vec").orderBy(F.xxhash64("c_id")).limit(PIVOTS).toPandas()
    if sample.empty:
        return corpus.sparkSession.createDataFrame([], schema)
    pivots = _matrix(sample["c_vec"])
    block_rows = block_rows or max(256, BLOCK_VALUES // pivots.shape[1])
    placed = _place(corpus, "c", pivots)
    cells = placed.groupBy(*groups, "cell").agg(
        F.count("*").alias("points"), F.min("away").alias("near"), F.max("away").alias("far")
    )
    cells = cut_lineage(_packed(cells, groups, block_rows))
    probes = _probes(queries, cells, groups, pivots, k)
    placed = placed.drop("away").join(F.broadcast(cells.select(*groups, "cell", "bin")), [*groups, "cell"])
    return _meet(placed, probes, cells, [*groups, "bin"], k, schema, block_rows)


def _meet(placed: DataFrame, probes: DataFrame, cells: DataFrame, keys: list[str], k: int, schema: str, block_rows: int) -> DataFrame:
    """The best k of every block of a bin for the queries that visit cells of the bin."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame()
        right = right.sort_values("c_id", kind="stable")
        asked, known = _matrix(left["q_vec"]), _matrix(right["c_vec"])
        visits, cell = left["visits"].to_numpy(), right["cell"].to_numpy()
        here = np.unique(cell)
        all_bits = (1 << (here.astype(np.int64) + 1)).sum()
        whole = (visits & all_bits) == all_bits
        parts = [(np.flatnonzero(whole), np.arange(len(cell)))]
        parts += [(np.flatnonzero(~whole & (visits >> (int(c) + 1) & 1 == 1)), np.flatnonzero(cell == c)) for c in here]
        found = []
        for rows, cols in parts:
            if len(rows):
                q, c, s = _best(asked[rows], known[cols], k)
                found.append((rows[q], cols[c], s))
        if not found:
            return pd.DataFrame()
        q, c, s = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return pd.DataFrame({"q_id": left["q_id"].to_numpy()[q[keep]], "c_id": right["c_id"].to_numpy()[c[keep]], "score": s[keep]})

    return _blocks_of(placed, probes, cells, keys, run, schema, block_rows)


def _blocks_of(
    placed: DataFrame, probes: DataFrame, cells: DataFrame, keys: list[str], run: Callable, schema: str, block_rows: int, visitor_rows: int | None = None
) -> DataFrame:
    """``run(visitors, points)`` for every pair of blocks of a bin's visitors and its points.

    Blocks have a bounded size on both sides (half as many visitors as points, unless given); a hot
    bin or group becomes many tasks.
    """
    visitor_rows = visitor_rows or max(1, block_rows // 2)
    c_blocks = cells.groupBy(*keys).agg(F.ceil(F.sum("points") / block_rows).alias("c_blocks"))
    q_blocks = probes.groupBy(*keys).agg(F.ceil(F.count("*") / visitor_rows).alias("q_blocks"))
    # A row a bin. Spark takes exploded vectors for smaller than that, and would broadcast them.
    sizes = F.broadcast(c_blocks.join(q_blocks, keys))
    c_side = placed.join(sizes, keys).withColumn("c_block", F.pmod(F.xxhash64("c_id"), "c_blocks")).withColumn(
        "q_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("q_blocks") - 1))
    )
    q_side = probes.join(sizes, keys).withColumn("q_block", F.pmod(F.xxhash64("q_id"), "q_blocks")).withColumn(
        "c_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c_blocks") - 1))
    )
    block = [*keys, "c_block", "q_block"]
    return q_side.drop("c_blocks", "q_blocks").groupBy(*block).cogroup(c_side.drop("c_blocks", "q_blocks").groupBy(*block)).applyInPandas(run, schema)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    corpus_id: str = "id",
    vector: str = "embedding",
    groups: list[str] | None = None,
    broadcast_queries: int = BROADCAST_QUERIES,
    block_rows: int | None = None,
) -> DataFrame:
    """(query_id, corpus_id, score, rank): the k nearest corpus rows of each query.

    Unless given, ``block_rows`` follows the vectors' length.
    """
    groups = list(groups or [])
    q = _usable(queries, query_id, groups, vector, "q")
    c = _usable(corpus, corpus_id, groups, vector, "c")
    # Only vectors of one length are compared, whatever the plan.
    groups.append("size_of_vector")
    schema = f"{_types(q, 'q_id')}, {_types(c, 'c_id')}, score double"
    # At most one row more than the limit ever reaches the driver.
    local = q.limit(broadcast_queries + 1).toPandas()
    size = 8 * int(local["q_vec"].map(len).sum())
    if len(local) <= broadcast_queries and size <= BROADCAST_BYTES:
        found = _scan(local, c, groups, k, schema) if len(local) else corpus.sparkSession.createDataFrame([], schema)
    else:
        lengths = [r[0] for r in q.select("size_of_vector").distinct().join(c.select("size_of_vector").distinct(), "size_of_vector").collect()]
        parts = [_by_cells(q.filter(F.col("size_of_vector") == n), c.filter(F.col("size_of_vector") == n), groups, k, schema, block_rows) for n in lengths]
        found = reduce(DataFrame.unionByName, parts) if parts else corpus.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "c_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("q_id").alias(query_id), F.col("c_id").alias(corpus_id), "score", "rank")
    )


def knn_documents(queries: DataFrame, documents: DataFrame, k: int = 5, ids: DataFrame | None = None) -> DataFrame:
    """V6: nearest documents, optionally only among ``ids(doc_id)``."""
    if ids is not None:
        documents = documents.join(ids.select("doc_id"), "doc_id", "left_semi")
    return knn(queries, documents, k, corpus_id="doc_id")


def knn_keys(queries: DataFrame, keys: DataFrame, k: int = 3) -> DataFrame:
    """V7: nearest keys that have a vector."""
    return knn(queries, keys, k, corpus_id="key_id")


def knn_values(queries: DataFrame, values: DataFrame, k: int = 10) -> DataFrame:
    """V8: nearest values; each query row names one allowed (key_id, dataset)."""
    return knn(queries, values, k, corpus_id="value_id", groups=["key_id", "dataset"])


@dataclass
class QuantizedIndex:
    """A corpus as codes: ``table(id, cell, codes)`` holds every row, the rest has a fixed size.

    A vector is the centre of its cell plus, for each slice of the dimensions, the code word
    nearest to what is left.
    """

    table: DataFrame
    centres: np.ndarray
    words: np.ndarray
    points: dict[int, int]


def quantize(
    corpus: DataFrame, cells: int | None = None, train: int = 20_000, slice_size: int = 2, words: int = 256,
    corpus_id: str = "id", vector: str = "embedding",
) -> QuantizedIndex | None:
    """A residual product quantisation of all vectors (of one length); None without any.

    Centres (about sqrt(n)) and code words are learned from the ``train`` vectors of smallest hash.
    """
    c = _usable(corpus, corpus_id, [], vector, "c")
    total = c.count()
    wanted = cells or max(1, min(2048, round(total**0.5)))
    sample = c.select("c_vec").orderBy(F.xxhash64("c_id")).limit(max(wanted, train)).toPandas()
    if sample.empty:
        return None
    unit = _matrix(sample["c_vec"])
    centres = _learned(unit, wanted)
    rest = unit - centres[_distances(unit, centres).argmin(axis=1)]
    size = unit.shape[1]
    edges = list(range(0, size, slice_size)) + [size]
    book = np.zeros((len(edges) - 1, words, slice_size))
    for j, (low, high) in enumerate(zip(edges, edges[1:])):
        learned = _words(rest[:, low:high], words)
        book[j, : len(learned), : high - low] = learned
        book[j, len(learned) :] = book[j, 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = _matrix(batch["c_vec"])
                zero = ~unit.any(axis=1)
                cell = _distances(unit, centres).argmin(axis=1)
                rest = np.where(zero[:, None], 0.0, unit - centres[cell])
                codes = [_distances(rest[:, low:high], book[j, :, : high - low]).argmin(axis=1) for j, (low, high) in enumerate(zip(edges, edges[1:]))]
                cell[zero] = ZERO_CELL
                yield pd.DataFrame({"c_id": batch["c_id"], "cell": cell.astype("int32"), "codes": [x.tobytes() for x in np.stack(codes, axis=1).astype(np.uint8)]})

    table = stored(c.mapInPandas(run, f"{_types(c, 'c_id')}, cell int, codes binary"))
    points = {r["cell"]: r["points"] for r in table.groupBy("cell").agg(F.count("*").alias("points")).collect()}  # one row a centre
    return QuantizedIndex(table, centres, book, points)


def _words(rows: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Code words of a slice: k-means in plain distance, started from spread-out rows."""
    distinct = np.unique(rows, axis=0)
    words = distinct[np.linspace(0, len(distinct) - 1, min(count, len(distinct))).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([_distances(rows[i : i + 4096], words).argmin(axis=1) for i in range(0, len(rows), 4096)])
        sums, held = np.zeros_like(words), np.bincount(near, minlength=len(words))
        np.add.at(sums, near, rows)
        words = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], words)
    return words


def knn_approx(
    queries: DataFrame, corpus: DataFrame, k: int, share: float = 0.8, shortlist: int | None = None, index: QuantizedIndex | None = None,
    query_id: str = "query_id", corpus_id: str = "id", vector: str = "embedding", block_rows: int | None = None,
) -> DataFrame:
    """V9: like ``knn`` (all vectors of one length), from a quantised index and a short list.

    A query walks the cells nearest to it until they hold ``share`` of the corpus and at least k
    vectors, and scores the vectors that their codes stand for. Only the
    ``shortlist`` best (6 k + 32 unless given) are scored anew on their vectors, exactly.
    """
    q, c = _usable(queries, query_id, [], vector, "q"), _usable(corpus, corpus_id, [], vector, "c")
    index = index or quantize(corpus, corpus_id=corpus_id, vector=vector)
    kinds = f"{_types(q, 'q_id')}, {_types(c, 'c_id')}"
    if index is None:
        return corpus.sparkSession.createDataFrame([], f"{kinds}, score double, rank int").toDF(query_id, corpus_id, "score", "rank")
    short = max(k, shortlist or 6 * k + 32)
    centres, book, points = index.centres, index.words, index.points
    part_rows = block_rows or max(256, BLOCK_VALUES // centres.shape[1])
    # Codes are small: in larger blocks fewer short lists of a query have to meet.
    visitor_rows, block_rows = (None, block_rows) if block_rows else (max(64, part_rows // CODE_BLOCKS), part_rows * CODE_BLOCKS)
    cell = np.array(sorted(points))
    held = np.array([points[i] for i in cell])
    bins = (np.cumsum(held) - held) // block_rows

    def away_from(unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        away = _distances(unit, centres[np.maximum(cells, 0)])
        away[:, cells == ZERO_CELL] = np.sqrt(2.0)
        return away

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The bins with cells that a query walks, and the distance of the last one."""
        for batch in batches:
            if len(batch):
                away = away_from(_matrix(batch["q_vec"]), cell)
                order = np.argsort(away, axis=1, kind="stable")
                last = (np.cumsum(held[order], axis=1) < max(k, share * held.sum())).sum(axis=1)
                last = np.minimum(last, len(cell) - 1)
                upto = np.take_along_axis(away, np.take_along_axis(order, last[:, None], axis=1), axis=1)[:, 0]
                yield batch[["q_id", "q_vec"]].assign(upto=upto, bin=[np.unique(bins[o[: n + 1]]).tolist() for o, n in zip(order, last)])

    probes = q.mapInPandas(visit, f"{_types(q, 'q_id', 'q_vec')}, upto double, bin array<int>").withColumn("bin", F.explode("bin"))

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The short list of every visitor among a block's codes, by the vectors the codes stand for."""
        if left.empty or right.empty:
            return pd.DataFrame()
        right = right.sort_values("c_id", kind="stable")
        here, place = np.unique(right["cell"].to_numpy(), return_inverse=True)
        asked = _matrix(left["q_vec"])
        hidden = away_from(asked, here) > left["upto"].to_numpy()[:, None] + _SLACK
        by_cell = np.argsort(place, kind="stable")
        found = []
        for low in range(0, len(right), part_rows):
            # Columns come cell by cell, so that a cell which a query does not visit is one stretch.
            columns = by_cell[low : low + part_rows]
            codes = np.stack([np.frombuffer(x, dtype=np.uint8) for x in right["codes"].iloc[columns]])
            known = np.concatenate([book[j][codes[:, j]] for j in range(len(book))], axis=1)[:, : asked.shape[1]]
            own = here[place[columns]]
            known += np.where(own[:, None] == ZERO_CELL, 0.0, centres[np.maximum(own, 0)])
            met, begin = np.unique(place[columns], return_index=True)
            ends = [*begin[1:].tolist(), len(columns)]

            def hide(table: np.ndarray, rows: np.ndarray) -> None:
                for i, begins, ended in zip(met, begin.tolist(), ends):
                    table[np.flatnonzero(hidden[rows, i]), begins:ended] = -np.inf

            for r, c, rough in _pairs(asked, known, min(short, len(known)), False, hide):
                found.append(_first(r, columns[c], rough, short))
        r, c, rough = _first(*(np.concatenate(x) for x in zip(*found)), short)
        return pd.DataFrame({"q_id": left["q_id"].to_numpy()[r], "c_id": right["c_id"].to_numpy()[c], "rough": rough})

    spark = corpus.sparkSession
    cells = spark.createDataFrame(list(zip(cell.tolist(), bins.tolist(), held.tolist())), "cell int, bin int, points long")
    coded = index.table.join(F.broadcast(cells.select("cell", "bin")), "cell")
    rough = _blocks_of(coded, probes, cells, ["bin"], scored, f"{kinds}, rough double", block_rows, visitor_rows)
    first = Window.partitionBy("q_id").orderBy(F.desc("rough"), "c_id")
    listed = rough.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= short).select("q_id", "c_id")
    pairs = listed.join(c.select("c_id", "c_vec"), "c_id").join(q.select("q_id", "q_vec"), "q_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                products = (_flat_matrix(batch["q_vec"]) * _flat_matrix(batch["c_vec"])).sum(axis=1)
                score = pa.array(np.round(np.clip(products, 0.0, 1.0), _DECIMALS))
                yield pa.RecordBatch.from_arrays([batch["q_id"], batch["c_id"], score], ["q_id", "c_id", "score"])

    found = pairs.mapInArrow(exact, f"{kinds}, score double")
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "c_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select(F.col("q_id").alias(query_id), F.col("c_id").alias(corpus_id), "score", "rank")
    )


def _learned(unit: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Centres of k-means over a sample, started from its first rows."""
    centres = unit[:cells]
    for _ in range(rounds):
        nearest = np.concatenate([(unit[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(unit), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return centres


def sparse_cosine(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """V4: cosine of sparse vectors for the given ``pairs(id_a, id_b)``.

    ``a`` and ``b`` are long tables (id, feature, weight).
    """
    length = lambda df, name: df.groupBy(F.col("id").alias(name)).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(f"norm_{name}"))
    left = a.select(F.col("id").alias("id_a"), "feature", F.col("weight").alias("w_a"))
    right = b.select(F.col("id").alias("id_b"), "feature", F.col("weight").alias("w_b"))
    dots = (
        pairs.join(left, "id_a")
        .join(right, ["id_b", "feature"])
        .groupBy("id_a", "id_b")
        .agg(F.sum(F.col("w_a") * F.col("w_b")).alias("dot"))
    )
    norms = F.col("norm_id_a") * F.col("norm_id_b")
    return (
        pairs.join(dots, ["id_a", "id_b"], "left")
        .join(length(a, "id_a"), "id_a", "left")
        .join(length(b, "id_b"), "id_b", "left")
        .select("id_a", "id_b", clamp01(F.coalesce(F.when(norms > 0, F.col("dot") / norms), F.lit(0.0))).alias("score"))
    )


def mean_vector(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """V5: centroid per group. Averages combine before the shuffle, so hot groups are fine."""
    parts = df.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    averages = parts.groupBy(group, "pos").agg(F.avg("x").alias("x"))
    return averages.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid")
    )


def radius_edges(
    df: DataFrame, group: str, name: str, radius: float, vector: str = "embedding", block_rows: int = 1024
) -> DataFrame:
    """Edges (group, a, b) that span the components of "unit vectors at most ``radius`` apart".

    Every pair of blocks of a group is one task; it emits a spanning forest of its close
    pairs, so edges stay linear in the rows however many pairs are close.
    """
    rows = df.select(group, F.col(name).alias("name"), F.col(vector).cast("array<double>").alias("vec"))
    blocks = rows.groupBy(group).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("name"), F.col("_blocks")).cast("int")
    spread = (
        rows.join(blocks, group)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(group, "name", "vec", F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["name"].tolist()
        unit = _matrix(pdf["vec"])
        waiting = np.arange(len(names))
        left, right = [], []
        while len(waiting):
            queue, waiting = [waiting[0]], waiting[1:]
            while queue and len(waiting):
                at = queue.pop()
                close = _distances(unit[at : at + 1], unit[waiting])[0] <= radius
                queue.extend(waiting[close])
                left.extend([names[at]] * int(close.sum()))
                right.extend(names[i] for i in waiting[close])
                waiting = waiting[~close]
        if not left:
            return pd.DataFrame()
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(left), "a": left, "b": right})

    kind = df.schema[group].dataType.simpleString()
    schema = f"{group} {kind}, a string, b string"
    return spread.groupBy(group, "low", "high").applyInPandas(run, schema).distinct()
