"""Low-rank factorisations.

SVD: randomised range finding with distributed products; only rank x rank matrices reach the driver. NMF: rows
are independent given the right factor, so each pass updates them in place from a broadcast right factor
(rank x columns, whose size is checked) and adds up the pieces of its next value per partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axisweave.functions.checkpoints import cut
from axisweave.matrix import Matrix, axis_of, stored
from axisweave.operators.product import dot

EPS = 1e-10
#: Values of a right factor that may be broadcast (doubles).
MAX_FACTOR = 50_000_000


def _turned(m: Matrix) -> Matrix:
    return Matrix(m.cells.select(F.col("c").alias("r"), F.col("r").alias("c"), "v"), m.cols, m.rows)


def _ranks(spark, k: int) -> DataFrame:
    return axis_of(spark.range(k).select(F.col("id").alias("label")))


def _small(m: Matrix, n: int, k: int) -> np.ndarray:
    """A matrix of numbered axes, at most rank x rank, on the driver."""
    out = np.zeros((n, k))
    for x in m.cells.collect():
        out[x["r"], x["c"]] = x["v"]
    return out


def _times(m: Matrix, a: np.ndarray) -> Matrix:
    """m (any rows, numbered columns) times a small driver matrix."""
    spark = m.cells.sparkSession
    rows = [(int(i), int(j), float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j]]
    small = Matrix(spark.createDataFrame(rows, "r long, c long, v double"), _ranks(spark, a.shape[0]), _ranks(spark, a.shape[1]))
    return dot(m, small)


def _orthonormal(y: Matrix, k: int) -> Matrix:
    """Columns of y made orthonormal through their k x k Gram matrix; directions without weight become 0."""
    y = Matrix(cut(y.cells), y.rows, y.cols)
    values, vectors = np.linalg.eigh(_small(dot(_turned(y), y), k, k))
    keep = values > 1e-12 * max(values.max(), 1e-300)
    q = _times(y, vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0))
    return Matrix(cut(q.cells), q.rows, q.cols)


def randomized_svd(m: Matrix, rank: int, n_iter: int = 2, oversample: int = 10, seed: int = 0) -> tuple[Matrix, np.ndarray, Matrix]:
    """(U, s, V) with rank columns: m is about U diag(s) V'. Start vectors are a hash of label and seed, so reruns agree."""
    spark = m.cells.sparkSession
    n, c = m.shape()
    k = min(rank + oversample, n, c)
    salt = lambda j: F.pmod(F.xxhash64(F.lit(seed), F.lit(j), "r", "c"), F.lit(1 << 40)) / float(1 << 40)
    start = m.cols.select(F.col("label").alias("r")).join(spark.range(k).select(F.col("id").alias("c")), F.lit(True))
    start = start.withColumn("v", F.sqrt(-2 * F.log(salt(1) + 1e-15)) * F.cos(2 * np.pi * salt(2)))
    q = _orthonormal(dot(m, Matrix(start, m.cols, _ranks(spark, k))), k)
    mt = _turned(m)
    for _ in range(n_iter):
        q = _orthonormal(dot(m, _orthonormal(dot(mt, q), k)), k)
    b = dot(mt, q)  # columns x k, the transpose of Q' m
    b = Matrix(cut(b.cells), b.rows, b.cols)
    values, vectors = np.linalg.eigh(_small(dot(_turned(b), b), k, k))
    order = np.argsort(values)[::-1][:rank]
    s = np.sqrt(np.maximum(values[order], 0))
    u = _times(q, vectors[:, order])
    v = _times(b, vectors[:, order] * np.where(s > 0, 1 / np.where(s > 0, s, 1), 0))
    return u, s, v


def svd(m: Matrix, rank: int, seed: int = 0) -> tuple[Matrix, Matrix]:
    """U sqrt(S) and V sqrt(S)."""
    u, s, v = randomized_svd(m, rank, seed=seed)
    return _times(u, np.diag(np.sqrt(s))), _times(v, np.diag(np.sqrt(s)))


def _on_support(m: Matrix, left: Matrix, right: Matrix) -> Matrix:
    from axisweave.operators.product import mask_dot

    return mask_dot(left, _turned(right), m)


def _mean(ms: list[Matrix]) -> Matrix:
    from axisweave.operators.arith import map_cells, reduce_sum

    return map_cells(reduce_sum(ms), lambda v: v / len(ms))


def svd_approximation(m: Matrix, ranks: int | list[int], seed: int = 0) -> Matrix:
    """Low-rank values on the support of m, averaged over ranks."""
    ranks = [ranks] if isinstance(ranks, int) else ranks
    return _mean([_on_support(m, *svd(m, k, seed)) for k in ranks])


def rank_from_variance_ratio(m: Matrix, ratio: float, max_dim: int = 1000) -> int:
    """Number of components whose running share of variance is at most ratio, and one more."""
    n, c = m.shape()
    s = randomized_svd(m, min(max_dim, n, c))[1] ** 2
    total = m.cells.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 1.0
    return int((np.cumsum(s) / total <= ratio).sum()) + 1


# -- NMF ----------------------------------------------------------------------


def _row_form(m: Matrix) -> tuple[DataFrame, list]:
    """(r, idx, val): rows as places and values, and the column labels in order."""
    cols = [x["label"] for x in m.cols.orderBy("pos").select("label").collect()]
    places = m.cols.select(F.col("label").alias("c"), (F.row_number().over(W.orderBy("pos")) - 1).cast("int").alias("p"))
    rows = m.cells.join(places, "c").groupBy("r").agg(F.collect_list(F.struct("p", "v")).alias("x"))
    return rows.select("r", F.transform("x", lambda e: e["p"]).alias("idx"), F.transform("x", lambda e: e["v"]).alias("val")), cols


def _left_step(w: np.ndarray, h: np.ndarray, idx, val, loss: str) -> np.ndarray:
    """One multiplicative update of a row's factor w (rank) for the right factor h (rank x columns)."""
    part = h[:, idx]
    if loss == "kl":
        return np.maximum(w * (part @ (val / np.maximum(w @ part, EPS))) / np.maximum(h.sum(1), EPS), EPS)
    return np.maximum(w * (part @ val) / np.maximum(w @ (h @ h.T), EPS), EPS)


def nmf(m: Matrix, rank: int | list[int] | None, max_iter: int = 150, seed: int = 0, loss: str = "kl", smooth: float = 0.0, graph: Matrix | None = None) -> tuple[Matrix, Matrix]:
    """Non-negative factors (left: rows x rank, right: columns x rank) by multiplicative updates; right columns sum to 1.

    loss is 'kl' or 'euclid'. A list of ranks gives the factors of all side by side, None finds one. With graph (columns x columns
    weights) and smooth, right factors of linked columns are drawn together.
    """
    if loss not in ("kl", "euclid"):
        raise ValueError(f"unknown loss {loss!r}")
    if isinstance(rank, list):
        from axisweave.operators.labels import hstack

        parts = [nmf(m, k, max_iter, seed + j, loss, smooth, graph) for j, k in enumerate(rank)]
        return hstack([p[0] for p in parts]), hstack([p[1] for p in parts])
    if rank is None:
        rank = nmf_rank(m, seed=seed)
    spark = m.cells.sparkSession
    if not m.cells.filter("v < 0").isEmpty():
        raise ValueError("a value is negative")
    rows, cols = _row_form(m)
    if rank * len(cols) > MAX_FACTOR:
        raise ValueError(f"a right factor of {rank} x {len(cols)} is too large to broadcast")
    rng = np.random.default_rng(seed)
    total = m.cells.agg(F.sum("v")).first()[0] or 1.0
    n = m.rows.count()
    scale = np.sqrt(total / max(1, n * len(cols)) / rank)
    h = scale * (0.5 + rng.random((rank, len(cols))))
    links = None
    if graph is not None and smooth:
        at = {x: k for k, x in enumerate(cols)}
        links = [(at[x["r"]], at[x["c"]], x["v"]) for x in graph.cells.collect() if x["r"] in at and x["c"] in at and x["r"] != x["c"]]
    kind = dict(rows.dtypes)["r"]
    state = cut(rows.withColumn("w", F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda j: scale * (0.5 + F.pmod(F.xxhash64(F.lit(seed), "r", j), F.lit(1 << 20)) / float(1 << 20)))))

    def run(h):
        def passed(frames):
            for f in frames:
                up, gram, sums = np.zeros_like(h), np.zeros((rank, rank)), np.zeros(rank)
                new = []
                for idx, val, w in zip(f["idx"], f["val"], f["w"]):
                    idx, val = np.asarray(idx, int), np.asarray(val, float)
                    w = _left_step(np.asarray(w, float), h, idx, val, loss)
                    new.append(w)
                    sums += w
                    gram += np.outer(w, w)
                    up[:, idx] += np.outer(w, val / np.maximum(w @ h[:, idx], EPS) if loss == "kl" else val)
                yield pd.DataFrame({"r": f["r"], "idx": f["idx"], "val": f["val"], "w": new, "part": [None] * len(f)})
                yield pd.DataFrame({"r": [None], "idx": [None], "val": [None], "w": [None], "part": [np.concatenate((up.ravel(), gram.ravel(), sums))]})

        return passed

    for _ in range(max_iter):
        out = cut(state.mapInPandas(run(h), f"r {kind}, idx array<int>, val array<double>, w array<double>, part array<double>"))
        state = out.filter("part is null").drop("part")
        # partial sums are added up element by element before they reach the driver
        parts = out.filter("part is not null").select(F.posexplode("part").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(rank * len(cols) + rank * rank + rank)
        for p in parts:
            flat[p["k"]] = p["x"]
        up, gram, sums = flat[: h.size].reshape(h.shape), flat[h.size : h.size + rank * rank].reshape(rank, rank), flat[-rank:]
        below = np.broadcast_to(sums[:, None], h.shape).copy() if loss == "kl" else gram @ h
        top = h * up
        if links:
            pull, own = np.zeros_like(h), np.zeros(len(cols))
            for a, b, v in links:
                pull[:, a] += v * h[:, b]
                own[a] += v
            top = top + smooth * h * pull
            below = below + smooth * own[None, :] * h
        h = np.maximum(top / np.maximum(below, EPS), EPS)
    norm = h.sum(1)
    left = state.select("r", F.posexplode("w").alias("c", "x"))
    scale_by = F.element_at(F.array(*[F.lit(float(x)) for x in norm]), F.col("c") + 1)
    left = Matrix(stored(left.select("r", F.col("c").cast("long").alias("c"), (F.col("x") * scale_by).alias("v"))), m.rows, _ranks(spark, rank))
    h = h / norm[:, None]
    ckind = dict(m.cols.dtypes)["label"]
    right = spark.createDataFrame([(x, k, float(h[k, j])) for j, x in enumerate(cols) for k in range(rank)], f"r {ckind}, c long, v double")
    return left, Matrix(stored(right), m.cols, _ranks(spark, rank))


def nmf_fold(m: Matrix, right: Matrix, max_iter: int = 30) -> Matrix:
    """Left factor of m for a given right factor (columns x rank): rows are independent, one pass."""
    known = Matrix(m.cells.join(right.rows.select(F.col("label").alias("c")), "c", "left_semi").select("r", "c", "v"), m.rows, right.rows)
    rows, cols = _row_form(known)
    names = [x["label"] for x in right.cols.orderBy("pos").collect()]
    if len(cols) * len(names) > MAX_FACTOR:
        raise ValueError("the right factor is too large to broadcast")
    h = np.full((len(names), len(cols)), EPS)
    at, to = {x: k for k, x in enumerate(cols)}, {x: k for k, x in enumerate(names)}
    for x in right.cells.collect():
        h[to[x["c"]], at[x["r"]]] = x["v"]

    def run(frames):
        for f in frames:
            out = []
            for idx, val in zip(f["idx"], f["val"]):
                w = np.full(len(h), 1 / len(h))
                for _ in range(max_iter):
                    w = _left_step(w, h, np.asarray(idx, int), np.asarray(val, float), "kl")
                out.append(w)
            yield pd.DataFrame({"r": f["r"], "w": out})

    w = rows.mapInPandas(run, f"r {dict(rows.dtypes)['r']}, w array<double>").select("r", F.posexplode("w").alias("k", "v"))
    table = right.cols.select(F.col("label").alias("c"), (F.row_number().over(W.orderBy("pos")) - 1).alias("k"))
    return Matrix(stored(w.join(F.broadcast(table), "k").select("r", "c", "v")), m.rows, right.cols)


def nmf_approximation(m: Matrix, ranks: int | list[int], max_iter: int = 120, seed: int = 0) -> Matrix:
    """Values of the factors on the support of m, averaged over ranks."""
    ranks = [ranks] if isinstance(ranks, int) else ranks
    return _mean([_on_support(m, *nmf(m, k, max_iter, seed)) for k in ranks])


def nmf_rank(m: Matrix, max_model_rank: int = 60, max_iter: int = 60, seed: int = 0, share: float = 0.01) -> int:
    """Number of components of a generous model that carry more than a share of its weight."""
    n, c = m.shape()
    left, _ = nmf(m, min(max_model_rank, n, c), max_iter, seed)
    sums = [x["s"] for x in left.cells.groupBy("c").agg(F.sum("v").alias("s")).collect()]
    return max(1, sum(s > share * sum(sums) for s in sums))


def ntf(cells: DataFrame, rank: int, max_iter: int = 100, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Non-negative CP factors of cells (i, j, k, v): three relations (label, f, v), by KL updates with joins.

    A component's weight stays in the first factor. Each update is an aggregate over the stored cells.
    """
    cells = cut(cells.select("i", "j", "k", F.col("v").cast("double").alias("v")).filter("v > 0"))
    unit = lambda key, salt: F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda f: 0.5 + F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), key, f), F.lit(1 << 20)) / float(1 << 20))
    factors = {key: cut(cells.select(key).distinct().withColumn(f"f{key}", unit(key, s))) for s, key in enumerate("ijk")}
    for _ in range(max_iter):
        for key in "ijk":
            a, b = [x for x in "ijk" if x != key]
            d = cells
            for x in "ijk":
                d = d.join(factors[x], x)
            product = F.zip_with(f"f{a}", f"f{b}", lambda x, y: x * y)
            model = F.aggregate(F.zip_with(product, f"f{key}", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            d = d.select(key, (F.col("v") / F.greatest(model, F.lit(EPS))).alias("q"), F.posexplode(product).alias("f", "p"))
            up = d.groupBy(key, "f").agg(F.sum(F.col("q") * F.col("p")).alias("u")).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "u"))), lambda x: x["u"]).alias("u"))
            below = np.ones(rank)
            for x in (a, b):
                sums = factors[x].select(F.posexplode(f"f{x}").alias("f", "v")).groupBy("f").agg(F.sum("v").alias("s")).collect()
                below *= np.array([s["s"] for s in sorted(sums, key=lambda s: s["f"])])
            div = F.array(*[F.lit(float(x)) for x in np.maximum(below, EPS)])
            new = F.zip_with(F.zip_with(f"f{key}", "u", lambda x, y: x * y), div, lambda x, y: F.greatest(x / y, F.lit(EPS)))
            factors[key] = cut(factors[key].join(up, key).select(key, new.alias(f"f{key}")))
    return tuple(factors[x].select(F.col(x).alias("label"), F.posexplode(f"f{x}").alias("f", "v")) for x in "ijk")
