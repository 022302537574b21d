"""Hierarchical density clusters of vectors (as HDBSCAN finds them), per group and of any size.

1. Every vector gets a list of its nearest neighbours; cells around pivots and the triangle
   inequality decide which cells it has to visit.
2. The minimum spanning tree of the mutual reachability distances grows by Boruvka rounds. A
   component takes its least outgoing edge from the lists; where an edge that no list holds could
   be shorter, its points search the cells that may hold a nearer foreign point.
3. The tree's edges are merged in ranges of ascending length. What is known of a component between
   ranges has a fixed size, so a range is merged by tasks of bounded size, one per component.
4. Clusters are selected by their excess of mass, from the bottom up during the merging; what a
   point belongs to is the topmost selected cluster around it, found by doubling pointers.

All steps are exact. Equal vectors are one node with a weight. Lengths below ``_SHORTEST`` count
as that, so that densities stay finite.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.components import connected_components
from recordloom.operators.ordering import with_ranges
from recordloom.session import stored

LIST_SIZE = 8
BLOCK_ROWS = 2048
# Points of a group per squared number of its cells.
CELL_SHARE = 256
# Tree edges that one task merges.
MERGE_EDGES = 200_000
_SHORTEST = 1e-9
_SLACK = 1e-7
_PART = 1 << 30


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(squared, 0.0))


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for a cogroup of two tables that share an origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _weighted(points: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (g, nid, weight, vec, n, least, blocks, block) of different vectors, and (g, name, nid) of all points.

    A group's nodes are dealt to blocks of about ``block_rows``.
    """
    nodes = stored(points.groupBy("g", "vec").agg(F.count("*").alias("weight")).withColumn("nid", F.monotonically_increasing_id()))
    sizes = nodes.groupBy("g").agg(F.count("*").alias("n"), F.min("nid").alias("least"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    members = points.join(nodes.select("g", "vec", "nid"), ["g", "vec"]).select("g", "name", "nid")
    return stored(nodes.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))), members


def _against(rows: DataFrame, table: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(rows, table)`` for the blocks of a group's ``rows(g, block, ...)`` and the whole of its small ``table(g, blocks, ...)``."""
    copies = _fresh(table.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return rows.groupBy("g", "block").cogroup(copies.groupBy("g", "block")).applyInPandas(run, schema)


def _place(nodes: DataFrame, kind: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with the nearest pivot of their group and their part of its cell, and the pivots (g, pivot, centre, blocks).

    A group of n has about sqrt(n / CELL_SHARE) pivots, picked by hash; a cell has parts of about
    ``block_rows``.
    """
    wanted = F.ceil(F.sqrt(F.col("n") / CELL_SHARE))
    picked = (wanted > 1) & (F.pmod(F.xxhash64("nid"), F.lit(_PART)) * F.col("n") < wanted * _PART)
    pivots = stored(nodes.filter((F.col("nid") == F.col("least")) | picked).select("g", F.col("nid").alias("pivot"), F.col("vec").alias("centre"), "blocks"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame()
        right = right.sort_values("pivot")
        away = _distances(_stack(left["vec"]), _stack(right["centre"]))
        cell = away.argmin(axis=1)
        return left.assign(cell=right["pivot"].to_numpy()[cell], away=away[np.arange(len(left)), cell])[["g", "block", "nid", "weight", "vec", "cell", "away"]]

    schema = f"g {kind}, block int, nid long, weight long, vec array<double>, cell long, away double"
    placed = stored(_against(nodes.select("g", "block", "nid", "weight", "vec"), pivots, run, schema))
    parts = placed.groupBy("g", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    placed = placed.join(parts, ["g", "cell"]).withColumn("part", F.pmod(F.xxhash64("nid", F.lit(1)), F.col("parts")).cast("int"))
    return stored(placed), pivots


def _meet(visits: DataFrame, held: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(visitors, points)`` for every pair of a block of a cell's visitors and a part of its points."""
    visits = stored(visits)
    pairs = visits.select("g", "cell", "block").distinct()
    parts = held.select("g", "cell", "part").distinct()
    right = _fresh(held.join(pairs, ["g", "cell"]))
    left = visits.join(parts, ["g", "cell"])
    keys = ["g", "cell", "block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def _lists(placed: DataFrame, pivots: DataFrame, kind: str, size: int) -> DataFrame:
    """(g, nid, other, dist, other_weight): the ``size`` nearest other nodes of every node."""
    cells = placed.groupBy("g", F.col("cell").alias("pivot")).agg(F.count("*").alias("points"), F.min("away").alias("near"), F.max("away").alias("far")).join(pivots, ["g", "pivot"])
    shape = f"g {kind}, block int, nid long, vec array<double>, cell long"

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame()
        away = _distances(_stack(left["vec"]), _stack(right["centre"]))
        near, far, points = (right[c].to_numpy() for c in ("near", "far", "points"))
        upper = away + far
        order = np.argsort(upper, axis=1)
        covered = (np.cumsum(points[order], axis=1) < size + 1).sum(axis=1)
        limit = np.where(covered < len(points), np.take_along_axis(upper, np.take_along_axis(order, np.minimum(covered, len(points) - 1)[:, None], 1), 1)[:, 0], np.inf)
        row, cell = np.nonzero(np.maximum(away - far, near - away) <= limit[:, None] + _SLACK)
        return left.iloc[row].assign(cell=right["pivot"].to_numpy()[cell])[["g", "block", "nid", "vec", "cell"]]

    visits = _against(placed.select("g", "block", "nid", "vec"), cells, visit, shape)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame()
        right = right.sort_values("nid")
        a, b, names, others = _stack(left["vec"]), _stack(right["vec"]), left["nid"].to_numpy(), right["nid"].to_numpy()
        rough = _distances(a, b)
        rough[names[:, None] == others[None, :]] = np.inf
        if rough.shape[1] > size:
            limit = np.partition(rough, size - 1, axis=1)[:, size - 1, None]
            q, c = np.nonzero((rough <= limit + _SLACK) & np.isfinite(rough))
        else:
            q, c = np.nonzero(np.isfinite(rough))
        dist = np.sqrt(((a[q] - b[c]) ** 2).sum(axis=1))
        order = np.lexsort((others[c], dist, q))
        q, c, dist = q[order], c[order], dist[order]
        best = np.arange(len(q)) - np.searchsorted(q, np.arange(len(a)))[q] < size
        q, c, dist = q[best], c[best], dist[best]
        if not len(q):
            return pd.DataFrame()
        return pd.DataFrame({"g": left["g"].iloc[0], "nid": names[q], "other": others[c], "dist": dist, "other_weight": right["weight"].to_numpy()[c]})

    found = _meet(visits, placed.select("g", "nid", "weight", "vec", "cell", "part"), run, f"g {kind}, nid long, other long, dist double, other_weight long")
    order = Window.partitionBy("g", "nid").orderBy("dist", "other")
    return stored(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size))


def _cores(placed: DataFrame, lists: DataFrame, size: int, min_size: int) -> DataFrame:
    """(g, nid, core, floor): distance within which ``min_size`` points lie, and the least length of an edge no list holds."""
    upto = Window.partitionBy("g", "nid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = lists.withColumn("around", F.sum("other_weight").over(upto)).join(placed.select("g", "nid", "weight"), ["g", "nid"])
    enough = F.col("weight") + F.col("around") >= min_size
    own = summed.groupBy("g", "nid").agg(F.min(F.when(enough, F.col("dist"))).alias("core"), F.count("*").alias("held"), F.max("dist").alias("last"))
    core = F.when(F.col("weight") >= min_size, F.lit(0.0)).otherwise(F.coalesce("core", "last", F.lit(0.0)))
    last = F.when(F.col("held") >= size, F.col("last")).otherwise(F.lit(float("inf")))
    return placed.select("g", "nid", "weight").join(own, ["g", "nid"], "left").select("g", "nid", core.alias("core"), F.greatest(core, last).alias("floor"))


def _least(edges: DataFrame) -> DataFrame:
    """The least edge of every component, by length and then by nodes, so that choices never close a circle."""
    return edges.groupBy("g", "comp").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("g", "comp", "e.*")


def _foreign(open_points: DataFrame, placed: DataFrame, pivots: DataFrame, points: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """(g, comp, w, a, b, to): for open components, the least edge to a foreign point among those not longer than ``known(g, comp, w)``.

    First each point bounds its distance to a foreign point by the cells; the component's most
    promising point then measures one cell. With that bound, points visit the cells that may
    hold something nearer.
    """
    info = stored(placed.select("g", "block", "nid", "vec", "cell", "part", "away").join(points.select("g", "nid", "core", "comp"), ["g", "nid"]))
    cells = info.groupBy("g", F.col("cell").alias("pivot")).agg(
        F.min("away").alias("near"), F.max("away").alias("far"), F.min("core").alias("core_min"), F.max("core").alias("core_max"), F.min("comp").alias("one"), F.max("comp").alias("two")
    )
    cells = stored(cells.join(pivots, ["g", "pivot"]))
    asking = stored(open_points.select("g", "nid", "floor").join(info.select("g", "block", "nid", "vec", "core", "comp"), ["g", "nid"]))
    shape = f"g {kind}, block int, nid long, vec array<double>, core double, comp long, cell long, upto double"
    fields = ["g", "block", "nid", "vec", "core", "comp", "cell", "upto"]

    def reach(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible length of an edge from each row to a foreign point of each cell."""
        away = _distances(_stack(left["vec"]), _stack(right["centre"]))
        near, far, low, high, one, two = (right[c].to_numpy() for c in ("near", "far", "core_min", "core_max", "one", "two"))
        core, comp = left["core"].to_numpy()[:, None], left["comp"].to_numpy()[:, None]
        own = (one == comp) & (two == comp)
        least = np.maximum.reduce([np.broadcast_to(core, away.shape), np.broadcast_to(low, away.shape), away - far, near - away])
        most = np.maximum.reduce([np.broadcast_to(core, away.shape), np.broadcast_to(high, away.shape), away + far])
        return np.where(own, np.inf, least), np.where(own, np.inf, most)

    def promising(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame()
        most = reach(left, right)[1]
        cell = most.argmin(axis=1)
        found = left.assign(cell=right["pivot"].to_numpy()[cell], upto=most[np.arange(len(left)), cell])
        found = found.sort_values(["comp", "upto", "nid"]).drop_duplicates("comp")
        return found[fields]

    first = _against(asking, cells, promising, shape)
    first = first.groupBy("g", "comp").agg(F.min_by(F.struct("block", "nid", "vec", "core", "cell"), F.struct("upto", "nid")).alias("p"), F.min("upto").alias("upto"))
    first = stored(first.select("g", "comp", "p.*", "upto"))
    held = info.select("g", "nid", "vec", "core", "comp", "cell", "part")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame()
        right = right.sort_values("nid")
        a, b = _stack(left["vec"]), _stack(right["vec"])
        names, others = left["nid"].to_numpy(), right["nid"].to_numpy()
        core = np.maximum(left["core"].to_numpy()[:, None], right["core"].to_numpy()[None, :])
        rough = np.maximum(_distances(a, b), core)
        rough[left["comp"].to_numpy()[:, None] == right["comp"].to_numpy()[None, :]] = np.inf
        least = rough.min(axis=1, keepdims=True)
        q, c = np.nonzero((rough <= least + _SLACK) & np.isfinite(rough) & (rough <= left["upto"].to_numpy()[:, None] + _SLACK))
        if not len(q):
            return pd.DataFrame()
        w = np.maximum(np.sqrt(((a[q] - b[c]) ** 2).sum(axis=1)), core[q, c])
        low, high = np.minimum(names[q], others[c]), np.maximum(names[q], others[c])
        found = pd.DataFrame({"g": left["g"].iloc[0], "comp": left["comp"].to_numpy()[q], "w": w, "a": low, "b": high, "to": right["comp"].to_numpy()[c]})
        return found.sort_values(["comp", "w", "a", "b"]).drop_duplicates("comp")

    edge = f"g {kind}, comp long, w double, a long, b long, to long"
    tried = stored(_meet(first, held, run, edge))
    limit = known.select("g", "comp", "w").unionByName(first.select("g", "comp", F.col("upto").alias("w"))).unionByName(tried.select("g", "comp", "w"))
    limit = limit.groupBy("g", "comp").agg(F.min("w").alias("upto"))
    asked = asking.join(limit, ["g", "comp"]).filter(F.col("floor") <= F.col("upto") + _SLACK)

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame()
        row, cell = np.nonzero(reach(left, right)[0] <= left["upto"].to_numpy()[:, None] + _SLACK)
        if not len(row):
            return pd.DataFrame()
        return left.iloc[row].assign(cell=right["pivot"].to_numpy()[cell])[fields]

    return _meet(_against(asked, cells, visit, shape), held, run, edge)


def spanning_tree(placed: DataFrame, pivots: DataFrame, lists: DataFrame, cores: DataFrame, kind: str) -> DataFrame:
    """(g, a, b, w): the edges of each group's minimum spanning tree of mutual reachability distances."""
    points = stored(cores.withColumn("comp", F.col("nid")))
    core = lambda side: cores.select("g", F.col("nid").alias(side), F.col("core").alias(f"core_{side}"))
    edges = lists.select("g", F.col("nid").alias("a"), F.col("other").alias("b"), "dist").join(core("a"), ["g", "a"]).join(core("b"), ["g", "b"])
    w = F.greatest("dist", "core_a", "core_b")
    edges = edges.select("g", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), w.alias("w")).distinct()
    edges = stored(edges.select("g", F.col("x").alias("a"), F.col("y").alias("b"), "w", F.col("x").alias("ca"), F.col("y").alias("cb")))
    tree = None
    while True:
        ways = edges.select("g", F.col("ca").alias("comp"), "w", "a", "b", F.col("cb").alias("to")).unionByName(
            edges.select("g", F.col("cb").alias("comp"), "w", "a", "b", F.col("ca").alias("to"))
        )
        best = stored(_least(ways))
        parts = points.groupBy("g", "comp").agg(F.min("floor").alias("floor"))
        several = parts.groupBy("g").agg(F.count("*").alias("parts")).filter("parts > 1").select("g")
        # Nothing outside the lists is shorter than the floor; ties are searched as well, so that choices agree.
        unsure = parts.join(several, "g", "left_semi").join(best.select("g", "comp", F.col("w").alias("bound")), ["g", "comp"], "left")
        unsure = stored(unsure.withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).filter(F.col("floor") <= F.col("bound")).filter("floor < double('inf')").select("g", "comp", "bound"))
        if not unsure.isEmpty():
            open_points = points.join(unsure, ["g", "comp"]).filter(F.col("floor") <= F.col("bound"))
            more = _foreign(open_points, placed, pivots, points, best, kind)
            best = stored(_least(best.unionByName(more)))
        if best.isEmpty():
            return tree if tree is not None else best.select("g", "a", "b", "w")
        chosen = best.select("g", "a", "b", "w").distinct()
        tree = stored(chosen if tree is None else tree.unionByName(chosen))
        merged = connected_components(best.withColumnRenamed("to", "other"), "g", "comp", "other").withColumnRenamed("component", "new").withColumnRenamed("node", "comp")
        merged = stored(merged)
        points = stored(points.join(merged, ["g", "comp"], "left").withColumn("comp", F.coalesce("new", "comp")).drop("new"))
        for side in ("ca", "cb"):
            edges = edges.join(merged.withColumnRenamed("comp", side), ["g", side], "left").withColumn(side, F.coalesce("new", side)).drop("new")
        edges = stored(edges.filter("ca <> cb"))


def _merge(kind: str, min_size: int):
    """Merging of one component's parts by its edges of one range, in ascending order."""
    columns = ["g", "kind", "part", "into", "size", "mass", "below", "cluster", "loose", "chosen"]

    def run(parts: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if edges.empty:
            return pd.DataFrame()
        group, state, root, out = edges["g"].iloc[0], {}, {}, []
        for part, size, mass, below, cluster, loose in zip(*(parts[c] for c in ("part", "size", "mass", "below", "cluster", "loose"))):
            state[part] = [int(size), float(mass), float(below), None if pd.isna(cluster) else int(cluster), list(loose)]
            root[part] = part

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def fall(nodes, cluster):
            out.extend((group, "point", n, cluster, 0, 0.0, 0.0, None, [], False) for n in nodes)

        # What meets at one length meets at once, so that the order of equal edges has no say.
        ordered = edges.sort_values("w", kind="stable")
        for w, some in ordered.groupby("w", sort=False):
            density, joined, by = 1.0 / max(w, _SHORTEST), {}, {}
            for ca, cb, edge in zip(some["ca"], some["cb"], some["edge"]):
                x, y = find(ca), find(cb)
                if x != y:
                    joined[x] = joined.get(x, [x]) + joined.pop(y, [y])
                    by[x] = min(by.get(x, edge), by.pop(y, edge), edge)
                    root[y] = x
            for top, tops in sorted(joined.items()):
                new = 2 * int(by[top]) + 1
                old = [state.pop(t) for t in tops]
                big, small = [s for s in old if s[3] is not None], [s for s in old if s[3] is None]
                size, loose = sum(s[0] for s in old), [n for s in small for n in s[4]]
                if len(big) > 1:
                    # The clusters end here, and one begins that holds them and what is loose.
                    below = 0.0
                    for s in big:
                        excess = s[1] - s[0] * density
                        chosen = not s[2] > excess
                        below += excess if chosen else s[2]
                        out.append((group, "cluster", s[3], new, 0, 0.0, 0.0, None, [], chosen))
                    fall(loose, new)
                    state[top] = [size, size * density, below, new, []]
                elif big:
                    fall(loose, big[0][3])
                    state[top] = [size, big[0][1] + (size - big[0][0]) * density, big[0][2], big[0][3], []]
                elif size >= min_size:
                    fall(loose, new)
                    state[top] = [size, size * density, 0.0, new, []]
                else:
                    state[top] = [size, 0.0, 0.0, None, loose]
        least = {}
        for part in root:
            top = find(part)
            least[top] = min(part, least.get(top, part))
        out.extend((group, "moved", part, least[find(part)], 0, 0.0, 0.0, None, [], False) for part in root)
        out.extend((group, "part", least[top], None, *s[:4], s[4], False) for top, s in state.items())
        return pd.DataFrame(out, columns=columns).astype({"into": "Int64", "cluster": "Int64"})

    schema = f"g {kind}, kind string, part long, into long, size long, mass double, below double, cluster long, loose array<long>, chosen boolean"
    return run, schema


def _clusters(tree: DataFrame, nodes: DataFrame, kind: str, min_size: int, merge_edges: int) -> tuple[DataFrame, DataFrame]:
    """Clusters (g, cluster, into, chosen), ``into`` being the cluster around it, and (g, nid, cluster) of nodes that are in any."""
    ranged = with_ranges(tree, ["g"], "w", merge_edges).withColumn("edge", F.monotonically_increasing_id())
    ranged = stored(ranged)
    heavy = F.col("weight") >= min_size
    parts = nodes.select(
        "g", F.col("nid").alias("part"), F.col("weight").alias("size"), F.when(heavy, F.col("weight") / _SHORTEST).otherwise(0.0).alias("mass"), F.lit(0.0).alias("below"),
        F.when(heavy, 2 * F.col("nid")).alias("cluster"), F.when(heavy, F.array().cast("array<long>")).otherwise(F.array("nid")).alias("loose"),
    )
    parts = stored(parts)
    at = stored(nodes.select("g", "nid", F.col("nid").alias("part")))
    run, schema = _merge(kind, min_size)
    clusters = points = None
    steps = sorted(r[0] for r in ranged.select("_range").distinct().collect())  # one number a range
    for step in steps:
        edges = ranged.filter(F.col("_range") == step)
        for side in ("a", "b"):
            edges = edges.join(at.select("g", F.col("nid").alias(side), F.col("part").alias(f"c{side}")), ["g", side])
        edges = stored(edges)
        whole = connected_components(edges, "g", "ca", "cb").select("g", F.col("node").alias("part"), F.col("component").alias("_whole"))
        whole = stored(whole)
        meeting = parts.join(whole, ["g", "part"])
        grouped = edges.join(whole.withColumnRenamed("part", "ca"), ["g", "ca"])
        done = stored(meeting.groupBy("g", "_whole").cogroup(_fresh(grouped).groupBy("g", "_whole")).applyInPandas(run, schema))
        of = lambda k: done.filter(F.col("kind") == k)  # noqa: B023, E731
        closed, fallen = of("cluster").select("g", F.col("part").alias("cluster"), "into", "chosen"), of("point").select("g", F.col("part").alias("nid"), F.col("into").alias("cluster"))
        clusters, points = (closed, fallen) if clusters is None else (clusters.unionByName(closed), points.unionByName(fallen))
        moved = of("moved").select("g", "part", "into")
        if step != steps[-1]:
            parts = stored(parts.join(whole, ["g", "part"], "left_anti").unionByName(of("part").select(parts.columns)))
            at = stored(at.join(moved, ["g", "part"], "left").select("g", "nid", F.coalesce("into", "part").alias("part")))
    own = nodes.filter(heavy).select("g", "nid", (2 * F.col("nid")).alias("cluster"))
    if clusters is None:
        empty = nodes.limit(0)
        clusters = empty.select("g", F.col("nid").alias("cluster"), F.col("nid").alias("into"), F.lit(False).alias("chosen"))
        return clusters, own.limit(0)
    return clusters, points.unionByName(own)


def _topmost(clusters: DataFrame) -> DataFrame:
    """(g, cluster, top): the outermost chosen cluster around each, itself included, by doubled pointers."""
    current = stored(clusters.select("g", "cluster", F.col("into").alias("up"), F.when(F.col("chosen"), F.col("cluster")).alias("top")))
    while not current.join(current.select("g", F.col("cluster").alias("up")), ["g", "up"], "left_semi").isEmpty():
        above = current.select("g", F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.lit(True).alias("_there"))
        current = current.join(above, ["g", "up"], "left").select(
            "g", "cluster", F.when(F.col("_there"), F.col("_up")).otherwise(F.col("up")).alias("up"), F.coalesce("_top", "top").alias("top")
        )
        current = stored(current)
    return current.filter("top IS NOT NULL").select("g", "cluster", "top")


def density_clusters(
    df: DataFrame, group: str, name: str, vector: str = "embedding", min_size: int = 2, block_rows: int = BLOCK_ROWS, merge_edges: int = MERGE_EDGES
) -> DataFrame:
    """(group, name, cluster): the density cluster of each point, named by its smallest member; null for noise.

    ``min_size`` is the least size of a cluster and of a dense neighbourhood (the point included);
    distances are Euclidean. A whole group is never one cluster. Points whose vectors are null or
    empty are noise; groups that mix vector lengths are an error.
    """
    usable = F.size(vector) > 0
    points = df.filter(usable).select(F.col(group).alias("g"), F.col(name).alias("name"), F.col(vector).cast("array<double>").alias("vec")).distinct()
    kind = points.schema["g"].dataType.simpleString()
    size = max(LIST_SIZE, min_size)
    nodes, members = _weighted(points, block_rows)
    placed, pivots = _place(nodes, kind, block_rows)
    lists = _lists(placed, pivots, kind, size)
    cores = stored(_cores(placed, lists, size, min_size))
    tree = spanning_tree(placed, pivots, lists, cores, kind)
    clusters, within = _clusters(tree, placed.select("g", "nid", "weight"), kind, min_size, merge_edges)
    found = stored(members.join(within.join(_topmost(clusters), ["g", "cluster"]).select("g", "nid", "top"), ["g", "nid"]))
    first = found.groupBy("g", "top").agg(F.min("name").alias("cluster"))
    named = found.join(first, ["g", "top"]).select(F.col("g").alias(group), F.col("name").alias(name), "cluster")
    return df.select(group, name).distinct().join(named, [group, name], "left")
