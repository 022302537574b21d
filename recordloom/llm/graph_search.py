"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Rows are dealt to shards of bounded size by hash. A shard is one graph: points enter in growing
batches, a greedy search of the graph so far proposes their neighbours, and relaxed distance
pruning keeps a diverse few, in both directions (Subramanya et al., "DiskANN", 2019). A query
walks every shard's graph with a beam of bounded width; its candidates are scored anew on the
original vectors in double precision, and the best of all shards are ranked.

Largest inner products become smallest distances by one more component: a shard's vectors are
lifted to the length of its longest one, a query gets a zero there.

Defined cases: rows whose vector is null, empty, zero or holds a null or non-finite component
take no part, nor do rows without an id; repeated rows are one row; equal vectors of one shard
are one point of its graph with all their ids, so copies never crowd out other neighbours; rows
that share an id but not the vector count as one candidate with the better score; only vectors of
one length are compared; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import stored

# Edges kept per point, slack before a point is pruned again, and how much shorter a detour must be.
DEGREE, SLACK, ALPHA = 32, 16, 1.2
BUILD_BEAM, SEARCH_BEAM = 64, 128
SHARD_ROWS, QUERY_ROWS = 16_384, 8_192
_STEP_ROWS, _EXPAND, _SEED_POINTS = 256, 4, 256


def usable(vector: Column) -> Column:
    """Whether a vector has a length and only finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0), F.lit(False))


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Nearest points found by a beam: (ids, squared distances less |query|^2, ids expanded step by step).

    All queries advance in step; rows of the result are sorted by distance and padded with -1.
    """
    count, found = len(queries), np.full((len(queries), beam), -1, dtype=np.int32)
    away = np.full((count, beam), np.inf, dtype=np.float32)
    lengths = np.einsum("ij,ij->i", points, points)
    found[:, 0] = start
    away[:, 0] = lengths[start] - 2 * queries @ points[start]
    fresh = np.zeros((count, beam), dtype=bool)
    fresh[:, 0] = True
    seen = np.zeros((count, len(points)), dtype=bool)
    seen[:, start] = True
    expanded = []
    active = np.arange(count)
    while len(active):
        waiting = fresh[active]
        turn = waiting & (np.cumsum(waiting, axis=1) <= _EXPAND)
        row, place = np.nonzero(turn)
        nodes = found[active[row], place]
        fresh[active[row], place] = False
        expanded.append((active[row], nodes))
        # Slots of one query's expanded nodes lie side by side.
        slot = np.arange(len(row)) - np.searchsorted(row, np.arange(len(active)))[row]
        near = np.full((len(active), _EXPAND, graph.shape[1]), -1, dtype=np.int32)
        near[row, slot] = graph[nodes]
        near = np.sort(near.reshape(len(active), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        new = (near >= 0) & ~seen[active[:, None], near]
        width = int(new.sum(axis=1).max()) if len(active) else 0
        if width:
            order = np.argsort(~new, axis=1, kind="stable")[:, :width]
            near, new = np.take_along_axis(near, order, 1), np.take_along_axis(new, order, 1)
            r, c = np.nonzero(new)
            seen[active[r], near[r, c]] = True
            dots = np.matmul(points[near], queries[active][:, :, None])[:, :, 0]
            reach = np.where(new, lengths[near] - 2 * dots, np.inf)
            ids = np.concatenate([found[active], np.where(new, near, -1)], axis=1)
            space = np.concatenate([away[active], reach], axis=1)
            todo = np.concatenate([fresh[active], new], axis=1)
            best = np.argsort(space, axis=1, kind="stable")[:, :beam]
            found[active], away[active], fresh[active] = (np.take_along_axis(x, best, 1) for x in (ids, space, todo))
        active = active[fresh[active].any(axis=1)]
    return found, away, expanded


def robust_prune(points: np.ndarray, own: np.ndarray, choices: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse choices per own point: the nearest stays, and drops whatever it is nearer to by ``alpha``.

    ``choices`` is padded with -1; so is the result.
    """
    kept = np.full((len(own), degree), -1, dtype=np.int32)
    step = max(1, 6_000_000 // max(1, choices.shape[1] ** 2 + choices.shape[1] * points.shape[1]))
    for at in range(0, len(own), step):
        some = np.sort(choices[at : at + step], axis=1)
        me = own[at : at + step]
        alive = (some >= 0) & (some != me[:, None])
        alive[:, 1:] &= some[:, 1:] != some[:, :-1]
        spots = points[some]
        away = np.where(alive, ((spots - points[me][:, None]) ** 2).sum(-1), np.inf)
        sizes = np.einsum("ijk,ijk->ij", spots, spots)
        between = np.maximum(sizes[:, :, None] + sizes[:, None, :] - 2 * np.matmul(spots, spots.transpose(0, 2, 1)), 0)
        rows = np.arange(len(me))
        for place in range(degree):
            reach = np.where(alive, away, np.inf)
            pick = reach.argmin(axis=1)
            some_left = np.isfinite(reach[rows, pick])
            if not some_left.any():
                break
            kept[at + rows[some_left], place] = some[rows[some_left], pick[some_left]]
            alive &= alpha * alpha * between[rows, pick] > away
            alive[rows, pick] = False
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(neighbours of every point padded with -1, start point) of a directed graph in which the start reaches all."""
    n, wide = len(points), degree + SLACK
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.RandomState(11).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    graph = np.full((n, wide), -1, dtype=np.int32)
    seed = order[:_SEED_POINTS]
    graph[seed, :degree] = robust_prune(points, seed, np.broadcast_to(seed, (len(seed), len(seed))), degree, alpha)
    done = len(seed)
    while done < n:
        batch = order[done : done + min(done, 2048)]
        choices = []
        for at in range(0, len(batch), _STEP_ROWS):
            part = batch[at : at + _STEP_ROWS]
            found, _, expanded = beam_search(points, graph, start, points[part], beam)
            rows, nodes = (np.concatenate(x) for x in zip(*expanded))
            sort = np.argsort(rows, kind="stable")
            rows, nodes = rows[sort], nodes[sort]
            slot = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(part)))[rows]
            table = np.full((len(part), slot.max() + 1), -1, dtype=np.int32)
            table[rows, slot] = nodes
            choices.append(robust_prune(points, part, np.concatenate([found, table], axis=1), degree, alpha))
        graph[batch, :degree] = np.concatenate(choices)
        _add_reverse(points, graph, batch, degree, alpha)
        done += len(batch)
    crowded = np.nonzero((graph >= 0).sum(axis=1) > degree)[0]
    graph[crowded, :degree] = robust_prune(points, crowded, graph[crowded], degree, alpha)
    graph[crowded, degree:] = -1
    return _reachable(points, graph, start), start


def _add_reverse(points: np.ndarray, graph: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Edges back to the batch; a point whose slots are full is pruned again."""
    wide = graph.shape[1]
    source, target = np.repeat(batch, degree), graph[batch, :degree].ravel()
    source, target = source[target >= 0], target[target >= 0]
    sort = np.argsort(target, kind="stable")
    source, target = source[sort].astype(np.int32), target[sort]
    nodes, begin, more = np.unique(target, return_index=True, return_counts=True)
    held = (graph[nodes] >= 0).sum(axis=1)
    group = np.repeat(np.arange(len(nodes)), more)
    slot = np.arange(len(target)) - begin[group] + held[group]
    free = (held + more <= wide)[group]
    graph[target[free], slot[free]] = source[free]
    full = np.nonzero(held + more > wide)[0]
    # Points with like numbers of edges are pruned together.
    for some in np.array_split(full[np.argsort((held + more)[full], kind="stable")], max(1, len(full) // 512)):
        if len(some):
            table = np.full((len(some), int((held + more)[some].max())), -1, dtype=np.int32)
            table[:, :wide] = graph[nodes[some]]
            place = np.full(len(nodes), -1)
            place[some] = np.arange(len(some))
            mine = place[group] >= 0
            table[place[group[mine]], slot[mine]] = source[mine]
            graph[nodes[some], :degree] = robust_prune(points, nodes[some], table, degree, alpha)
            graph[nodes[some], degree:] = -1


def _reachable(points: np.ndarray, graph: np.ndarray, start: int) -> np.ndarray:
    """The graph with edges added until the start reaches every point; usually none is missing."""
    while True:
        reached = np.zeros(len(graph), dtype=bool)
        front = np.array([start])
        while len(front):
            reached[front] = True
            front = np.unique(graph[front])
            front = front[(front >= 0) & ~reached[np.maximum(front, 0)]]
        lost = np.nonzero(~reached)[0]
        if not len(lost):
            return graph
        there = np.nonzero(reached)[0]
        one = lost[0]
        near = there[((points[there] - points[one]) ** 2).sum(axis=1).argmin()]
        room = np.nonzero(graph[near] < 0)[0]
        if not len(room):
            graph = np.concatenate([graph, np.full((len(graph), 1), -1, dtype=np.int32)], axis=1)
            room = [graph.shape[1] - 1]
        graph[near, room[0]] = one


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(size, shard, node, ids, vector, neighbours, start): one row per point of a shard's graph.

    Shards hold about ``shard_rows`` rows, whatever the corpus; identical rows are merged before
    they are dealt, so no id or vector can fill one shard.
    """
    own = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    own = own.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).distinct().withColumn("size", F.size("vector"))
    own = stored(own)
    shards = {r["size"]: -(-r["n"] // shard_rows) for r in own.groupBy("size").agg(F.count("*").alias("n")).collect()}  # one row per vector length
    wanted = F.coalesce(*[F.when(F.col("size") == s, F.lit(n)) for s, n in shards.items()]) if shards else F.lit(1)
    dealt = own.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), wanted).cast("int"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        table = np.stack(part["vector"].to_numpy())
        _, first, which = np.unique(table, axis=0, return_index=True, return_inverse=True)
        which = which.ravel()
        sort = np.argsort(which, kind="stable")
        ids = np.split(part["vec_id"].to_numpy()[sort], np.cumsum(np.bincount(which))[:-1])
        vectors = table[first]
        squares = (vectors * vectors).sum(axis=1)
        lifted = np.concatenate([vectors, np.sqrt(squares.max() - squares)[:, None]], axis=1).astype(np.float32)
        graph, start = build_graph(lifted)
        size = len(vectors)
        return pd.DataFrame({
            "size": [part["size"].iloc[0]] * size, "shard": [part["shard"].iloc[0]] * size, "node": np.arange(size, dtype=np.int32), "ids": list(ids),
            "vector": list(vectors), "neighbours": [g[g >= 0] for g in graph], "start": [start] * size,
        })

    return dealt.groupBy("size", "shard").applyInPandas(
        run, "size int, shard int, node int, ids array<long>, vector array<double>, neighbours array<int>, start int"
    )


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best found of other ids per row of ``queries(query_id, vector)``.

    Queries travel in blocks; every pair of a block and a shard is one task, which holds that
    shard and that block only.
    """
    q = queries.filter(F.col("query_id").isNotNull() & usable(F.col("vector"))).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    q = q.distinct().withColumn("size", F.size("vector"))
    blocks = max(1, -(-q.count() // query_rows))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)).cast("int"))
    shards = index.select(F.col("size").alias("length"), F.col("shard").alias("part")).distinct()  # one row per shard
    q = q.join(shards, q["size"] == shards["length"]).drop("length")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    wide = max(beam, k + 1)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame()
        right = right.sort_values("node", kind="stable")
        vectors, asked = np.stack(right["vector"].to_numpy()), np.stack(left["vector"].to_numpy())
        squares = (vectors * vectors).sum(axis=1)
        lifted = np.concatenate([vectors, np.sqrt(squares.max() - squares)[:, None]], axis=1).astype(np.float32)
        graph = np.full((len(right), max(1, max(map(len, right["neighbours"])))), -1, dtype=np.int32)
        for row, near in zip(graph, right["neighbours"]):
            row[: len(near)] = near
        ids, start = right["ids"].to_numpy(), int(right["start"].iloc[0])
        plain = np.concatenate([asked, np.zeros((len(asked), 1))], axis=1).astype(np.float32)
        names = left["query_id"].to_numpy()
        out = []
        for at in range(0, len(plain), _STEP_ROWS):
            found = beam_search(lifted, graph, start, plain[at : at + _STEP_ROWS], wide)[0]
            for name, query, nodes in zip(names[at : at + _STEP_ROWS], asked[at : at + _STEP_ROWS], found):
                nodes = nodes[nodes >= 0]
                scores = (vectors[nodes] * query).sum(axis=1)
                # A point answers with at most k ids besides the query's own.
                members = [ids[x][: k + 1] for x in nodes]
                every, marks = np.concatenate(members), np.repeat(scores, [len(m) for m in members])
                other = every != name
                every, marks = every[other], marks[other]
                best = np.lexsort((every, -marks))[:k]
                out.append(pd.DataFrame({"query_id": name, "vec_id": every[best], "score": marks[best]}))
        return pd.concat(out)

    found = q.groupBy("size", "part", "block").cogroup(held.groupBy("size", "shard", "block")).applyInPandas(run, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(
    rows: DataFrame, k: int = 20, every: int = 20, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest other rows, by inner product, of each row whose id is divisible by ``every``; the index is stored first."""
    index = stored(build_index(rows, shard_rows, id_column, vector))
    asked = rows.select(F.col(id_column).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    return search(index, asked.filter(F.col("query_id") % every == 0), k, beam)
