"""Density clusters against a plain dense-matrix version."""

import numpy as np
import pytest

from recordloom.operators import density, label


def plain_clusters(names, table, min_size=2):
    """HDBSCAN from its definition: full matrix, single linkage, condensed tree, excess of mass."""
    n = len(names)
    if n == 0:
        return {}
    dist = np.sqrt(((table[:, None, :] - table[None, :, :]) ** 2).sum(-1))
    core = np.sort(dist, axis=1)[:, min_size - 1] if n >= min_size else np.full(n, np.inf)
    reach = np.maximum(np.maximum(core[:, None], core[None, :]), dist)
    # Prim
    inside, best, tree = np.zeros(n, bool), np.full(n, np.inf), []
    source, at = np.zeros(n, int), 0
    for _ in range(n - 1):
        inside[at] = True
        closer = (reach[at] < best) & ~inside
        best[closer], source[closer] = reach[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        tree.append((best[at], int(source[at]), at))
    # Dendrogram: what meets at one length is one node; nodes are (children, members, density).
    node = {i: ([], [i], None) for i in range(n)}
    owner, count = list(range(n)), n
    for w in sorted({t[0] for t in tree}):
        meets = {}
        for _, a, b in (t for t in tree if t[0] == w):
            x, y = ({owner[m]} | next((g for g in meets.values() if owner[m] in g), set()) for m in (a, b))
            for o in x | y:
                meets[o] = x | y
        for parts in {frozenset(g) for g in meets.values()}:
            members = [m for o in parts for m in node[o][1]]
            node[count] = (sorted(parts), members, 1 / max(w, 1e-9))
            for m in members:
                owner[m] = count
            count += 1
    mass, birth, kids, members = {}, {}, {}, {}

    def descend(root, cluster):
        """Condense below a dendrogram node that carries this cluster."""
        stack = [(root, cluster)]
        while stack:
            at, own = stack.pop()
            parts, _, rate = node[at]
            big = [x for x in parts if len(node[x][1]) >= min_size]
            for x in parts:
                if x not in big or len(big) > 1:
                    mass[own] += len(node[x][1]) * (rate - birth[own])
            if len(big) > 1:
                for x in big:
                    birth[x], mass[x], kids[x], members[x] = rate, 0.0, [], node[x][1]
                    kids[own].append(x)
                    stack.append((x, x))
            elif big:
                stack.append((big[0], own))

    root = count - 1
    birth[root], mass[root], kids[root], members[root] = 0.0, 0.0, [], node[root][1]
    descend(root, root)
    chosen, value = set(), {}
    for c in sorted(kids, key=lambda c: len(members[c])):
        below = sum(value[k] for k in kids[c])
        if kids[c] and below > mass[c]:
            value[c] = below
        else:
            value[c] = mass[c]
            chosen.add(c)
    out = {name: None for name in names}
    stack = list(kids[root])
    while stack:
        c = stack.pop()
        if c in chosen:
            first = min(names[i] for i in members[c])
            for i in members[c]:
                out[names[i]] = first
        else:
            stack.extend(kids[c])
    return out


def found(df, **options):
    rows = density.density_clusters(df, "g", "name", "vec", **options).collect()
    assert len(rows) == len({(r["g"], r["name"]) for r in rows})
    return {(r["g"], r["name"]): r["cluster"] for r in rows}


def wanted(rows, min_size=2):
    groups = {}
    for g, name, vec in rows:
        groups.setdefault(g, []).append((name, vec))
    out = {}
    for g, points in groups.items():
        points = sorted({n: v for n, v in points}.items())
        some = plain_clusters([n for n, _ in points], np.array([v for _, v in points], dtype=float), min_size)
        out.update({(g, n): c for n, c in some.items()})
    return out


SCHEMA = "g string, name string, vec array<double>"


def blobs(seed, sizes, spread, far, dims=4):
    rng = np.random.RandomState(seed)
    return np.concatenate([rng.randn(n, dims) * spread + rng.randn(dims) * far for n in sizes])


@pytest.mark.parametrize("min_size", [2, 4])
def test_density_equals_plain_version(spark, min_size):
    rows = []
    for g, table in {
        "blobs": blobs(1, [30, 25, 12, 1, 1, 40], 0.3, 5),
        "noise": np.random.RandomState(2).randn(80, 4),
        "chain": np.cumsum(np.random.RandomState(3).rand(60, 4) + 0.1, axis=0),
        "two": np.array([[0.0, 0, 0, 0], [1, 0, 0, 0]]),
        "one": np.zeros((1, 4)),
    }.items():
        rows += [(g, f"p{i:03}", v.tolist()) for i, v in enumerate(table)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = wanted(rows, min_size)
    # Small blocks and merge ranges take every step of large groups.
    assert found(df, min_size=min_size, block_rows=32, merge_edges=40) == want


def test_density_of_copies_and_odd_rows(spark):
    """Copies of one vector are a cluster of their own; rows without a vector are noise."""
    table = blobs(5, [30, 30], 0.2, 6)
    rows = [("g", f"a{i}", v.tolist()) for i, v in enumerate(table)] + [("g", f"copy{i}", [9.0, 9.0, 9.0, 9.0]) for i in range(150)]
    df = spark.createDataFrame(rows + [("g", "none", None), ("g", "empty", []), ("g", "a0", table[0].tolist())], SCHEMA)
    got = found(df, block_rows=32)
    assert {got["g", f"copy{i}"] for i in range(150)} == {"copy0"}
    assert got["g", "none"] is None and got["g", "empty"] is None
    assert {k: v for k, v in got.items() if k[1] not in ("none", "empty")} == wanted(rows)
    assert found(df.limit(0)) == {}


def test_density_of_all_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(str(r["label"]), f"v{r['vec_id']}", [float(x) for x in r["embedding"]]) for r in df.collect()]
    rows += [("all", n, v) for _, n, v in rows]
    assert found(spark.createDataFrame(rows, SCHEMA)) == wanted(rows)


def test_cluster_labels_keeps_noise_and_one_label_a_cluster(spark):
    table = blobs(7, [20, 20, 1], 0.1, 8)
    df = spark.createDataFrame([("k", f"l{i:02}", v.tolist()) for i, v in enumerate(table)], "key_name string, label string, embedding array<double>")
    clusters = wanted([("k", f"l{i:02}", v.tolist()) for i, v in enumerate(table)])
    want = {c or n for (_, n), c in clusters.items()}
    assert {r["label"] for r in label.cluster_labels(df).collect()} == want


def test_labels_and_their_vectors_are_made_once(spark):
    """The taxonomy reads its labels several times; the records they come from are read only once."""
    from checks.canonical import _own_labels

    for df in _own_labels(spark, "/root/testdata/sf0.001"):
        assert df.inputFiles() and not any("testdata" in f for f in df.inputFiles())
