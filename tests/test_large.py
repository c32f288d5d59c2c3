"""What must not grow faster than its input: pairs in blocks, clusters of many rows, masked products, memory of sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisweave import api
from axisweave.functions import distance, pairs
from axisweave.matrix import Matrix
from axisweave.operators import cluster, similar
from tests.test_engine import dense, drawn, matrix


def plan(d) -> str:
    return d._jdf.queryExecution().executedPlan().toString()


def cells(d) -> dict:
    return {(r[0], r[1]): r[2] for r in d.collect()}


@pytest.mark.parametrize("name", ["euclidean", "cityblock", "chebychev", "scalar_product"])
def test_distances_meet_in_blocks(spark, name):
    x = np.random.default_rng(3).normal(size=(70, 4))
    rows = [(int(k) // 2 * 2, [float(v) for v in x[k]]) for k in range(70)]  # labels twice each: such pairs are none
    d = spark.createDataFrame(rows, "r long, val array<double>")
    got = distance.pairwise(d, name)
    assert "MapInArrow" in plan(got)
    f = {"euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()), "cityblock": lambda a, b: np.abs(a - b).sum(), "chebychev": lambda a, b: np.abs(a - b).max(), "scalar_product": lambda a, b: a @ b}[name]
    want = sorted((rows[i][0], rows[j][0], f(x[i], x[j])) for i in range(70) for j in range(70) if rows[i][0] < rows[j][0])
    got = sorted(map(tuple, got.collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    np.testing.assert_allclose([r[2] for r in got], [r[2] for r in want])
    assert distance.pairwise(d, name, flat=False).count() == 70 * 70


def test_vectors_of_several_lengths_still_pair(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [4.0, 6.0])], "r long, val array<double>")
    assert cells(distance.pairwise(d, "euclidean")) == {(1, 2): None, (1, 3): None, (1, 4): 5.0, (2, 3): None, (2, 4): None, (3, 4): None}


@pytest.mark.parametrize("room", [32 << 20, 0])
def test_best_pairs_meet_in_blocks(spark, monkeypatch, room):
    """Broadcast or not, the blocks give what the join of all pairs gave; negative values, ties and empty rows included."""
    monkeypatch.setattr(pairs, "BROADCAST", room)
    monkeypatch.setattr(pairs, "PARTS", 5)
    m = matrix(spark, drawn(11, (60, 4), -3, 6, 0.7).tolist())
    p = matrix(spark, drawn(12, (60, 4), 0, 4, 0.7).tolist())
    runs = {
        "dot": lambda: m.dot(m.transpose(), top=3),
        "min": lambda: m.pairwise_top(m.transpose(), "min", 4, -20),
        "max": lambda: m.pairwise_top(m.transpose(), "max", 4, 2),
        "many": lambda: p.pairwise_top(p.transpose(), "max", 20, 2),
        "similarity": lambda: p.normalize().similarity(nb_keep=5, top=None, cumtop=None, digits=6),
    }
    blocks = {k: f() for k, f in runs.items()}
    assert all("MapInArrow" in plan(b.cells) for b in blocks.values())
    monkeypatch.setattr(pairs, "NARROW", 0)
    for k, f in runs.items():
        assert cells(blocks[k].cells) == cells(f().cells), k


def test_all_pairs_meet_in_blocks(spark, monkeypatch):
    m = matrix(spark, [*drawn(13, (40, 5), -3, 6, 0.5).tolist(), [0] * 5])
    for f in (similar.jaccard, Matrix.pairwise_l2square):
        got = f(m)
        assert "MapInArrow" in plan(got.cells)
        with monkeypatch.context() as wide:
            wide.setattr(pairs, "NARROW", 0)
            want = cells(f(m).cells)
        assert cells(got.cells) == want


def test_rounding_is_as_sparks(spark):
    x = np.round(np.random.default_rng(2).random(2000), 7)
    x = np.concatenate([x, np.arange(200) / 128 / 100, -x[:50], [1e12 / 7, -1e-9, 123456789.1234565, 0.0]])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "v double").coalesce(1).select(F.round("v", 6)).collect()]
    assert list(map(repr, pairs.half_up(x[None], 6)[0].tolist())) == list(map(repr, want))


def users(spark, n: int, seed: int):
    """n users of five event types, with equal rows."""
    x = np.random.default_rng(seed).poisson([9, 9, 1, 2, 9], (n, 5)) + [1, 0, 0, 0, 0]
    rows = [(i, f"e{j}", float(x[i, j])) for i in range(n) for j in range(5) if x[i, j]]
    return x.astype(float), api.from_cells(spark.createDataFrame(rows, "r long, c string, v double"))


def test_clusters_of_more_rows_than_a_square_matrix_holds(spark):
    x, m = users(spark, 5_200, 1)
    for found, k in ((m.hierarchical_clustering(None, 4), 4), (m.tail_clustering(m.sum(), 5), 5), (m.co_clustering((3, 2), preruns=2)[0], 3)):
        of = cells(found.cells)
        assert len(of) == 5_200 and len({c for _, c in of}) <= k
        heads = {c for _, c in of}
        assert all((c, c) in of for c in heads)  # a cluster is named by one of its rows


def test_ward_in_rounds_is_ward(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(150, 3)) + 2, rng.normal(size=(20, 3)) * 4])
    x, w = np.concatenate([x, x[:60], x[:10]]), rng.random(390) + 0.5
    for weights in (np.ones(390), w):
        for k in (1, 2, 4, 25, 330):
            got, want = cluster.ward_groups(spark, x, weights, k, enough=20), cluster.cut_tree(cluster.ward_linkage(x, weights, k), 390)
            assert len(set(got)) == len(set(want)) == k
            if k < 300:
                assert len(set(zip(got.tolist(), want.tolist()))) == k


def test_tail_merges_as_before():
    x, w = drawn(5, (80, 4), 0, 9, 0.8).astype(float), drawn(7, (80,), 1, 6, 1.0).astype(float)

    def plain(x, w, k):
        x, w, live, parent = x.copy(), w.copy(), np.ones(len(x), bool), np.arange(len(x))
        while live.sum() > k:
            i = int(np.where(live, w, np.inf).argmin())
            d = np.where(live, ((x - x[i]) ** 2).sum(1), np.inf)
            d[i] = np.inf
            j = int(d.argmin())
            x[j], w[j], live[i], parent[i] = (w[i] * x[i] + w[j] * x[j]) / (w[i] + w[j]), w[i] + w[j], False, j
        for i in range(len(parent)):
            while parent[i] != parent[parent[i]]:
                parent[i] = parent[parent[i]]
        return parent

    def nearest(columns, i):
        d = ((columns.T - columns[:, i]) ** 2).sum(1)
        d[i] = np.inf
        return int(d.argmin())

    for k in (1, 5, 60):
        assert cluster.tail_merges(x, w, k, nearest, np.inf).tolist() == plain(x, w, k).tolist()


def test_group_truncation_reads_its_cells_once(spark):
    x = np.random.default_rng(8).permutation(48).reshape(6, 8) + 1.0
    m, g = matrix(spark, x), [0, 0, 0, 1, 1, -1, -1, None]
    groups = spark.createDataFrame([(f"c{j}", g[j]) for j in range(7)], "label string, g int")
    got = m.truncate_by_groups(groups, 1)
    want = x.copy()
    for group in ([0, 1, 2], [3, 4]):
        want[:, group] = np.where(x[:, group] == x[:, group].max(1, keepdims=True), x[:, group], 0)
    np.testing.assert_array_equal(dense(got), want)
    assert "Union" not in plan(got.cells)


def test_masked_product_meets_only_columns_of_the_right_factor(spark):
    """Cells of mask in columns that the right factor lacks must not be joined with their rows."""
    x, y = drawn(15, (6, 8), 0, 4, 0.6).astype(float), drawn(16, (8, 3), 0, 4, 0.6).astype(float)
    names = [f"c{j}" for j in range(8)]
    a, b = matrix(spark, x, None, names), matrix(spark, y, names, ["c1", "c4", "z"])
    want = np.zeros_like(x)
    want[:, 1], want[:, 4] = (x @ y)[:, 0], (x @ y)[:, 1]
    for mode, f in (("last", want), ("multiply", x * want), ("divide", np.divide(x, want, out=np.zeros_like(x), where=want != 0)), ("add", x + want)):
        got = a.mask_dot(b, a, mode)
        rows, cols, v = got.cells, None, np.zeros_like(x)
        for r in rows.collect():
            v[int(r["r"][1:]), int(r["c"][1:])] = r["v"]
        np.testing.assert_allclose(v, np.where(x != 0, f, 0), err_msg=mode)
        assert "LeftSemi" in plan(got.cells)


@pytest.mark.parametrize("name", ["euclidean", "sqeuclidean"])
def test_nearest_rows_are_exact(spark, name):
    """Far from 0 a product of matrices alone confuses near rows; equal distances go to the lesser label."""
    x = np.random.default_rng(9).integers(0, 3, (200, 12)) * 1e-3 + 1000.0
    x[150:] = x[:50]
    d = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(200)], "r long, val array<double>")
    f = lambda k, j: sum(((a - b) ** 2 for a, b in zip(x[k], x[j])), 0.0)
    want = {k: min((j for j in range(200) if j != k), key=lambda j: (np.sqrt(f(k, j)) if name == "euclidean" else f(k, j), j)) for k in range(200)}
    found = distance.nearest_row(d, name)
    assert {r["r"]: r["nearest"] for r in found.collect()} == want
    with pytest.raises(ValueError):
        distance.nearest_row(spark.createDataFrame([(1, [1.0]), (2, None)], "r long, val array<double>"), name)


def test_sums_of_pivots_are_made_once(spark):
    d = spark.createDataFrame([("a", "x", 1.0, 0), ("a", "x", 2.0, 1), ("b", "x", 5.0, 0), ("b", "x", -5.0, 1), ("b", "y", float("nan"), 1), ("c", "y", 3.0, 1)], "r string, c string, v double, k int")
    p, q = (api.from_cells(d.filter(f"k = {k}")) for k in (0, 1))
    for got, want in ((p + q, {("a", "x"): 3.0, ("c", "y"): 3.0}), (p - q, {("a", "x"): -1.0, ("b", "x"): 10.0, ("c", "y"): -3.0})):
        assert cells(got.cells) == want
        assert got.cells._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    assert cells((p.abs() + q).cells) == cells((p + q).cells)  # of other matrices, the cells
