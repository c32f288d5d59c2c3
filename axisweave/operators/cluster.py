"""Clustering of rows.

Components run distributed. Agglomerative trees, affinity propagation, spectral and co-clustering work on
a dense matrix whose merges depend on each other; they run in NumPy on the driver. What needs a figure of every two
rows at once (affinity propagation, spectral clusters, the order of a tree) refuses more rows than ``MAX_ROWS``; Ward
clusters, tail clusters and co-clusters need the dense matrix only, of ``MAX_CELLS`` cells at most. Of more rows
than ``MAX_ROWS`` Ward finds each row's nearest one distributed, in rounds that merge all mutual pairs.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.matrix import Matrix, axis_of, stored
from axisweave.operators.graph import components, strong_components
from axisweave.sources.export import to_dense

MAX_ROWS = 5_000
MAX_CELLS = 50_000_000


def one_hot(m: Matrix, labels: DataFrame, other: DataFrame | None = None) -> Matrix:
    """(label, cluster) as a matrix of ones, rows as in m."""
    cells = labels.select(F.col("label").alias("r"), F.col("cluster").alias("c"), F.lit(1.0).alias("v"))
    return Matrix(stored(cells), m.rows, axis_of(labels.select("cluster").distinct()) if other is None else other)


def connected_components(m: Matrix, connection: str = "weak") -> Matrix:
    """Rows of a square matrix by component of its graph; a component is named by its smallest label."""
    if connection not in ("weak", "strong"):
        raise ValueError("connection is 'weak' or 'strong'")
    if not m.is_square():
        raise ValueError("the matrix must be square")
    edges = m.cells.select(F.col("r").alias("a"), F.col("c").alias("b"))
    found = components(edges) if connection == "weak" else strong_components(edges)
    d = m.rows.select("label").join(found.withColumnRenamed("id", "label"), "label", "left")
    return one_hot(m, d.select("label", F.coalesce("component", "label").alias("cluster")))


def _dense(m: Matrix, limit: int | None = MAX_ROWS) -> tuple[list, np.ndarray]:
    """Row labels in order and the dense matrix; refuses more rows or columns than limit, or without one more cells than MAX_CELLS."""
    n, k = m.shape()
    if (n * k > MAX_CELLS) if limit is None else (n > limit or k > 4 * limit):
        raise ValueError(f"{n} x {k} is too large for an algorithm that works in one task (at most {f'{MAX_CELLS} cells' if limit is None else f'{limit} rows'})")
    rows = to_dense(m).join(m.rows.select(F.col("label").alias("r"), "pos"), "r").orderBy("pos").select("r", "val").toArrow()
    values = rows["val"].combine_chunks()
    return rows["r"].to_pylist(), values.flatten().to_numpy(zero_copy_only=False).reshape(n, k).copy()


def _labelled(m: Matrix, labels: list, cluster: list) -> Matrix:
    kind = dict(m.rows.dtypes)["label"]
    d = m.cells.sparkSession.createDataFrame(list(zip(labels, cluster)), f"label {kind}, cluster {kind}")
    return one_hot(m, d)


def _weights(m: Matrix, weight: DataFrame | Matrix | None, labels: list) -> np.ndarray:
    if weight is None:
        return np.ones(len(labels))
    d = weight.cells.groupBy(F.col("r").alias("label")).agg(F.sum("v").alias("v")) if isinstance(weight, Matrix) else weight
    table = {x["label"]: x["v"] for x in d.select("label", "v").collect()}
    return np.array([table.get(x, 0.0) for x in labels], float)


def ward_linkage(x: np.ndarray, weights: np.ndarray | None = None, n_clusters: int = 1) -> np.ndarray:
    """Merges (a, b, distance, size): always the two clusters of least weighted distance, down to n_clusters."""
    n = len(x)
    w = np.ones(n) if weights is None else np.asarray(weights, float).copy()
    gap = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2) if x.size * n < 30_000_000 else np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T)
    total = w[:, None] + w[None, :]
    d = 2 * gap * np.divide(w[:, None] * w[None, :], total, out=np.zeros_like(total), where=total > 0)
    np.fill_diagonal(d, np.inf)
    name, size = np.arange(n), np.ones(n)
    out = []
    for step in range(n - n_clusters):
        i, j = sorted(divmod(int(d.argmin()), n))
        low, high = sorted((name[i], name[j]))
        out.append((low, high, np.sqrt(d[i, j]), size[i] + size[j]))
        rest = np.isfinite(d[i]) & np.isfinite(d[j])
        t = w[i] + w[j] + w
        new = np.divide((w[i] + w) * d[i] + (w[j] + w) * d[j] - w * d[i, j], t, out=np.zeros(n), where=rest & (t > 0))
        d[i], d[:, i] = np.where(rest, new, np.inf), np.where(rest, new, np.inf)
        d[j], d[:, j] = np.inf, np.inf
        w[i], size[i], name[i] = w[i] + w[j], size[i] + size[j], n + step
    return np.array(out).reshape(-1, 4)


def cut_tree(linkage: np.ndarray, n: int) -> np.ndarray:
    """Cluster number of each of n leaves after the merges of linkage."""
    group = {k: [k] for k in range(n)}
    for step, (a, b, *_) in enumerate(linkage):
        group[n + step] = group.pop(int(a)) + group.pop(int(b))
    out = np.zeros(n, int)
    for k, leaves in enumerate(sorted(group.values(), key=min)):
        out[leaves] = k
    return out


def _nearest(x: np.ndarray, w: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows start to stop the other row of the least Ward distance, the first of equals, and that distance."""
    at, gap = np.zeros(stop - start, np.int64), np.full(stop - start, np.inf)
    for s in range(start, stop, 64):
        own = np.arange(s, min(s + 64, stop))
        for t in range(0, len(x), 4096):
            other = slice(t, t + 4096)
            v = np.zeros((len(own), len(x[other])))
            for a, b in zip(x[own].T, x[other].T):
                d = a[:, None] - b[None, :]
                v += np.multiply(d, d, out=d)
            total = w[own][:, None] + w[None, other]
            v *= 2 * np.divide(w[own][:, None] * w[None, other], total, out=np.zeros_like(total), where=total > 0)
            inside = (own >= t) & (own < t + v.shape[1])
            v[np.flatnonzero(inside), own[inside] - t] = np.inf
            k = v.argmin(1)
            low = v[np.arange(len(own)), k]
            less = low < gap[own - start]
            at[own[less] - start], gap[own[less] - start] = k[less] + t, low[less]
    return at, gap


def ward_groups(spark, x: np.ndarray, w: np.ndarray, n_clusters: int, enough: int = 2_000) -> np.ndarray:
    """Ward clusters as of ward_linkage, without its square matrix: equal rows first, then rounds that merge all rows nearest to each other.

    A merge never brings a cluster nearer to a third one than its parts were, so mutual pairs merge in any tree; the merges
    are then taken by rising distance. Nearest rows are found distributed, the last ``enough`` clusters by ward_linkage.
    """
    sc = spark.sparkContext
    whole = x, np.asarray(w, float)
    x, group = np.unique(x, axis=0, return_inverse=True)
    group = group.ravel()
    first = np.full(len(x), len(group))
    np.minimum.at(first, group, np.arange(len(group)))
    order = np.argsort(first)
    x, group = x[order], np.argsort(order)[group]
    if len(x) <= n_clusters:  # the least distances are all 0; which of equal rows stay apart is ward_linkage's choice
        first = np.sort(first)
        spare = np.setdiff1d(np.arange(len(group)), first)[::-1][: n_clusters - len(x)]
        group[spare] = len(x) + np.arange(len(spare))
        return group
    w = np.bincount(group, whole[1])
    name, high, merges = np.arange(len(x)), np.zeros(len(x)), []
    total = len(x)
    while len(x) > enough:
        n = len(x)
        held = sc.broadcast((x, w))
        step = max(64, -(-n // 128))
        found = sc.parallelize([(s, min(s + step, n)) for s in range(0, n, step)], -(-n // step)).map(lambda r: _nearest(*held.value, *r)).collect()
        held.destroy()
        at, gap = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        # of rows in a ring of equal distances the first pair is mutual: each points to its first nearest one
        i = np.flatnonzero((at[at] == np.arange(n)) & (np.arange(n) < at))
        j = at[i]
        for a, b, d in zip(i, j, np.maximum(gap[i], np.maximum(high[i], high[j]))):
            merges.append((d, name[a], name[b]))
            name[a], high[a] = total, d
            total += 1
        both = w[i] + w[j]
        x[i] = np.divide(w[i][:, None] * x[i] + w[j][:, None] * x[j], both[:, None], out=x[i], where=both[:, None] > 0)
        w[i] = both
        stay = np.ones(n, bool)
        stay[j] = False
        x, w, name, high = x[stay], w[stay], name[stay], high[stay]
    ids = dict(enumerate(name))
    floor = dict(enumerate(high))
    for k, (a, b, d, _) in enumerate(ward_linkage(x, w)):
        low = max(d * d, floor[int(a)], floor[int(b)])
        merges.append((low, ids[int(a)], ids[int(b)]))
        ids[len(x) + k], floor[len(x) + k] = total, low
        total += 1
    # every merge has a name, in the order of its making, so parts come before wholes of equal distance
    leaves = int(first.size)
    taken = np.argsort([d for d, *_ in merges], kind="stable")[: leaves - n_clusters]
    parent = np.arange(total)
    for k in taken:
        parent[[merges[k][1], merges[k][2]]] = leaves + k
    while (parent != parent[parent]).any():
        parent = parent[parent]
    return np.unique(parent[:leaves][group], return_inverse=True)[1].ravel()


def leaf_paths(linkage: np.ndarray, x: np.ndarray) -> dict[int, str]:
    """0/1 path of each leaf from the root of a full tree; of two children the one nearer to the uncle stands next to it."""
    n = len(linkage) + 1
    if n == 1:
        return {0: ""}
    leaves = {k: [k] for k in range(n)}
    for step, (a, b, *_) in enumerate(linkage):
        leaves[n + step] = leaves[int(a)] + leaves[int(b)]
    paths = {2 * n - 2: ""}
    centre = lambda k: x[leaves[k]].mean(0)
    for node in range(2 * n - 2, n - 1, -1):
        a, b = int(linkage[node - n][0]), int(linkage[node - n][1])
        p = paths.pop(node)
        if p:
            # the sibling of this node lies on the side that its own last bit does not name
            uncle = [k for k, q in paths.items() if q.startswith(p[:-1]) and q[: len(p)] != p]
            if uncle:
                u = np.concatenate([x[leaves[k]] for k in uncle]).mean(0)
                near_a = ((centre(a) - u) ** 2).sum() < ((centre(b) - u) ** 2).sum()
                if near_a == (p[-1] == "0"):
                    a, b = b, a
        paths[a], paths[b] = p + "0", p + "1"
    return paths


def _named(labels: list, group: np.ndarray, w: np.ndarray) -> list:
    """Each row's cluster, named by the label of its heaviest member (the first of equals)."""
    order = np.lexsort((np.arange(len(group)), -np.asarray(w, float), group))
    groups, first = np.unique(group[order], return_index=True)
    head = {g: labels[order[k]] for g, k in zip(groups, first)}
    return [head[g] for g in group]


def hierarchical_clustering(m: Matrix, weight=None, n_clusters: int = 2) -> Matrix:
    """Ward clusters of the rows, weighed by (label, v)."""
    labels, x = _dense(m, None)
    w = _weights(m, weight, labels)
    group = cut_tree(ward_linkage(x, w, n_clusters), len(labels)) if len(labels) <= MAX_ROWS else ward_groups(m.cells.sparkSession, x, w, n_clusters)
    return _labelled(m, labels, _named(labels, group, w))


def sort_by_clustering(m: Matrix) -> Matrix:
    """Rows (and columns if the matrix is square) in the order of the leaves of their Ward tree."""
    labels, x = _dense(m)
    paths = leaf_paths(ward_linkage(x), x)
    order = [labels[k] for k in sorted(paths, key=paths.get)]
    kind = dict(m.rows.dtypes)["label"]
    table = m.cells.sparkSession.createDataFrame(list(zip(order, range(len(order)))), f"label {kind}, place long")
    on = lambda axis: axis.join(table, "label").select("label", F.col("place").alias("pos"), "deco")
    return Matrix(m.cells, on(m.rows), on(m.cols) if m.is_square() else m.cols)


def tail_merges(x: np.ndarray, w: np.ndarray, k: int, nearest, gone: float) -> np.ndarray:
    """Merges the lightest row into the row that nearest picks until k are left (or it picks none); the row each ended in.

    nearest(columns, place) sees the columns of the rows that are left, and rows of ``gone`` that it must not pick.
    """
    columns, w, ids = np.ascontiguousarray(x.T), np.asarray(w, float).copy(), np.arange(len(x))
    place, parent, left = np.arange(len(x)), np.arange(len(x)), len(x)
    queue = list(zip(w.tolist(), range(len(x))))
    heapq.heapify(queue)
    stuck = np.zeros(len(x), bool)
    while left > k and queue:
        weight, i = heapq.heappop(queue)
        if parent[i] != i or stuck[i] or weight != w[i]:
            continue  # merged meanwhile, or an earlier weight
        at = nearest(columns, place[i])
        if at is None:
            stuck[i] = True
            continue
        j = ids[at]
        total = w[i] + w[j]
        if total > 0:
            columns[:, at] = (w[i] * columns[:, place[i]] + w[j] * columns[:, at]) / total
        columns[:, place[i]] = gone
        w[j], parent[i], left = total, j, left - 1
        heapq.heappush(queue, (float(total), int(j)))
        if left < 0.8 * len(ids):
            live = parent[ids] == ids
            ids, columns = ids[live], np.ascontiguousarray(columns[:, live])
            place[ids] = np.arange(len(ids))
    while (parent != parent[parent]).any():
        parent = parent[parent]
    return parent


def tail_clustering(m: Matrix, weight, n_clusters: int, min_density: float | None = None) -> Matrix:
    """Merges the lightest rows into their nearest ones; with min_density nearness is the overlap, and rows that overlap less stay."""
    labels, x = _dense(m, None)
    w = _weights(m, weight, labels)

    def summed(columns, f):
        # columns one by one hold no second matrix; from eight on NumPy sums a row in another order, which stays
        if len(columns) >= 8:
            return f(columns.T, None).sum(1)
        out = np.zeros(columns.shape[1])
        for k, column in enumerate(columns):
            out += f(column, k)
        return out

    def by_distance(columns, i):
        own = columns[:, i].copy()

        def square(c, k):
            gap = c - (own if k is None else own[k])
            return np.multiply(gap, gap, out=gap)

        d = summed(columns, square)
        d[i] = np.inf
        j = int(d.argmin())
        return j if np.isfinite(d[j]) else None

    def by_overlap(columns, i):
        own = columns[:, i].copy()
        s = summed(columns, lambda c, k: np.minimum(c, own if k is None else own[k]))
        s[i] = -np.inf
        return int(s.argmax()) if s.max() > 0 and s.max() >= min_density else None

    by, gone = (by_distance, np.inf) if min_density is None else (by_overlap, -np.inf)
    parent = tail_merges(x, w, n_clusters, by, gone)
    return _labelled(m, labels, [labels[p] for p in parent])


def affinity_propagation(s: np.ndarray, preference=None, max_iter: int = 200, damping: float = 0.5, seed: int = 0) -> np.ndarray:
    """Exemplar of each row of a similarity matrix, by damped messages."""
    s = np.array(s, float)
    n = len(s)
    off = s[~np.eye(n, dtype=bool)]
    if preference is not None:
        np.fill_diagonal(s, {"mean": np.mean, "median": np.median}[preference](off) if isinstance(preference, str) else preference)
    s += np.random.default_rng(seed).standard_normal(s.shape) * (np.abs(s).max() or 1) * 1e-12
    r, a = np.zeros((n, n)), np.zeros((n, n))
    at = np.arange(n)
    for _ in range(max_iter):
        both = a + s
        first = both.argmax(1)
        top = both[at, first]
        both[at, first] = -np.inf
        new = s - top[:, None]
        new[at, first] = s[at, first] - both.max(1)
        r = damping * r + (1 - damping) * new
        up = np.maximum(r, 0)
        up[at, at] = r[at, at]
        new = up.sum(0)[None, :] - up
        own = new[at, at].copy()
        new = np.minimum(new, 0)
        new[at, at] = own
        a = damping * a + (1 - damping) * new
    heads = np.flatnonzero((r + a)[at, at] > 0)
    if not len(heads):
        heads = np.array([(r + a)[at, at].argmax()])
    out = heads[s[:, heads].argmax(1)]
    out[heads] = heads
    return out


def affinity_clusters(m: Matrix, preference=None, max_iter: int = 200, seed: int = 0) -> Matrix:
    """Rows of a square similarity matrix by exemplar."""
    labels, s = _dense(m)
    return _labelled(m, labels, [labels[k] for k in affinity_propagation(s, preference, max_iter, seed=seed)])


def k_means(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50) -> np.ndarray:
    rng = np.random.default_rng(seed)
    best, cost = None, np.inf
    for _ in range(8):
        centres = [x[rng.integers(len(x))]]
        for _ in range(1, k):  # spread the first centres by distance
            d = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
            centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        c = np.array(centres)
        for _ in range(rounds):
            g = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[g == j].mean(0) if (g == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        total = ((x - c[g]) ** 2).sum()
        if total < cost:
            best, cost = g, total
    return best


def spectral_clusters(m: Matrix, n_clusters: int = 10, seed: int = 0) -> Matrix:
    """Rows of a square affinity matrix by k-means of the leading eigenvectors of its normalised form."""
    labels, s = _dense(m)
    s = (s + s.T) / 2
    root = 1 / np.sqrt(np.maximum(s.sum(1), 1e-12))
    k = min(n_clusters, len(labels))
    vectors = np.linalg.eigh(root[:, None] * s * root[None])[1][:, -k:] * root[:, None]
    g = k_means(vectors, k, seed)
    return _labelled(m, labels, _named(labels, g, np.ones(len(labels))))


def co_clustering(m: Matrix, ranks: tuple[int, int], max_iter: int = 120, preruns: int = 30, pre_iter: int = 4, seed: int = 0) -> tuple[Matrix, Matrix]:
    """Information-theoretic co-clusters of a non-negative matrix: one-hot rows and one-hot columns; several seeded starts."""
    labels, x = _dense(m, None)
    names = [c["label"] for c in m.cols.orderBy("pos").collect()]
    if (x < 0).any() or not x.sum(0).all() or not x.sum(1).all():
        raise ValueError("co-clustering needs non-negative values and no empty line")
    p = x / x.sum()
    rng = np.random.default_rng(seed)
    eps = 1e-12

    def half(p, g, h, k, j):
        """Best clusters g of the rows given clusters h of the columns."""
        joint = np.zeros((k, j))
        np.add.at(joint, (g[:, None], h[None, :]), p)
        share = joint / np.maximum(joint.sum(1, keepdims=True), eps)
        rows = np.zeros((len(p), j))
        np.add.at(rows.T, h, p.T)
        return (rows @ np.log(np.maximum(share, eps)).T).argmax(1)

    def loss(g, h):
        joint = np.zeros(ranks)
        np.add.at(joint, (g[:, None], h[None, :]), p)
        with np.errstate(divide="ignore", invalid="ignore"):
            return -np.nansum(joint * np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True))))

    def run(g, h, rounds):
        for _ in range(rounds):
            new = half(p, g, h, *ranks)
            new_h = half(p.T, h, new, ranks[1], ranks[0])
            if (new == g).all() and (new_h == h).all():
                break
            g, h = new, new_h
        return g, h

    starts = [run(rng.integers(ranks[0], size=len(x)), rng.integers(ranks[1], size=x.shape[1]), pre_iter) for _ in range(preruns)]
    g, h = run(*min(starts, key=lambda s: loss(*s)), max_iter)
    turned = Matrix(m.cells.select(F.col("c").alias("r"), F.col("r").alias("c"), "v"), m.cols, m.rows)
    return _labelled(m, labels, _named(labels, g, x.sum(1))), _labelled(turned, names, _named(names, h, x.sum(0)))
