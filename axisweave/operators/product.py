"""Products: a join on the inner label and an aggregate, with what can be pruned pruned before the join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axisweave.functions import pairs
from axisweave.matrix import Matrix, stored
from axisweave.operators.arith import reducer


def _terms(a: Matrix, b: Matrix, op=lambda x, y: x * y) -> DataFrame:
    """(r, c, t): one row for every pair of cells that meet in an inner label."""
    x = a.cells.select("r", F.col("c").alias("k"), F.col("v").alias("x"))
    y = b.cells.select(F.col("r").alias("k"), "c", F.col("v").alias("y"))
    return x.join(y, "k").select("r", "c", op(F.col("x"), F.col("y")).alias("t"))


def largest(cells: DataFrame, k: int) -> DataFrame:
    """The k largest cells of each row, ties by label; Catalyst limits the groups before the exchange."""
    return cells.withColumn("__k", F.row_number().over(W.partitionBy("r").orderBy(F.desc("v"), "c"))).filter(F.col("__k") <= k).drop("__k")


def best_of(x: DataFrame, y: DataFrame, name: str, k: int, cutoff: float | None = None, digits: int | None = None) -> DataFrame | None:
    """(r, c, v): the k largest figures of each row over (r, k, v) and (k, c, v), where the inner labels are few enough to hold rows dense; else None."""
    places = pairs.narrow(y.select("k"))
    if places is None:
        return None
    width = places.count()
    left, right = (pairs.packed(pairs.sparse(d, line, "k", places), width) for d, line in ((x, "r"), (y, "c")))
    found = pairs.best(left, right, name, width, k, ("r", "c"), digits)
    return largest(found if cutoff is None else found.filter(F.col("v") > cutoff), k)


def _sides(a: Matrix, b: Matrix) -> tuple[DataFrame, DataFrame]:
    return a.cells.select("r", F.col("c").alias("k"), "v"), b.cells.select(F.col("r").alias("k"), "c", "v")


def dot(a: Matrix, b: Matrix, top: int | None = None, mask: Matrix | None = None) -> Matrix:
    """Matrix product over the common inner labels; the top largest of each row, or only the cells of mask.

    With top and few inner labels rows meet in blocks, so the product is never made.
    """
    if top is not None and mask is not None:
        raise ValueError("top and mask exclude each other")
    if mask is not None:
        return mask_dot(a, b, mask)
    if top and (found := best_of(*_sides(a, b), "dot", top)) is not None:
        return Matrix(stored(found), a.rows, b.cols)
    cells = stored(_terms(a, b).groupBy("r", "c").agg(F.sum("t").alias("v")))
    return Matrix(cells if top is None else largest(cells, top), a.rows, b.cols)


def mask_dot(a: Matrix, b: Matrix, mask: Matrix, mode: str = "last") -> Matrix:
    """mode(mask value, product) on the cells of mask; the mask meets both factors before anything is multiplied."""
    m = mask.cells.select("r", "c", F.col("v").alias("m"))
    x = a.cells.select("r", F.col("c").alias("k"), F.col("v").alias("x"))
    y = b.cells.select(F.col("r").alias("k"), "c", F.col("v").alias("y"))
    # a cell of mask in a column that b lacks has no product, so it need not meet its row
    terms = m.join(b.cols.select(F.col("label").alias("c")), "c", "left_semi").join(x, "r").join(y, ["k", "c"])
    sums = terms.groupBy("r", "c").agg(F.sum(F.col("x") * F.col("y")).alias("d"), F.first("m").alias("m"))
    if mode not in ("last", "multiply", "divide"):  # these make 0 of cells without a product, which go
        sums = m.join(sums.drop("m"), ["r", "c"], "left")
    return Matrix(stored(sums.select("r", "c", reducer(mode)(F.col("m"), F.coalesce("d", F.lit(0.0))).alias("v"))), a.rows, b.cols)


def shadow(a: Matrix, b: Matrix) -> Matrix:
    """(max, x) product of non-negative matrices."""
    return Matrix(stored(_terms(a, b).groupBy("r", "c").agg(F.max("t").alias("v"))), a.rows, b.cols)


def pairwise_top(a: Matrix, b: Matrix, op: str, nb_keep: int, cutoff: float = 0.0) -> Matrix:
    """Sum of op ('min' or 'max') of the cells that meet; of each row the nb_keep largest above cutoff."""
    if op in ("min", "max") and nb_keep > 0 and (found := best_of(*_sides(a, b), op, nb_keep, cutoff)) is not None:
        return Matrix(stored(found), a.rows, b.cols)
    sums = _terms(a, b, reducer(op)).groupBy("r", "c").agg(F.sum("t").alias("v"))
    return Matrix(largest(stored(sums).filter(F.col("v") > cutoff), nb_keep), a.rows, b.cols)


def dot_vector(m: Matrix, vector: DataFrame, axis: str = "columns") -> DataFrame:
    """(label, v): matrix times (label, v) along its columns, or along its rows."""
    inner, outer = ("c", "r") if axis == "columns" else ("r", "c")
    w = vector.select(F.col("label").alias(inner), F.col("v").alias("w"))
    return m.cells.join(w, inner).groupBy(F.col(outer).alias("label")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def _then_vector(cells: DataFrame, vector: DataFrame, power: float) -> DataFrame:
    w = vector.select(F.col("label").alias("c"), F.col("v").alias("w"))
    return cells.join(w, "c").groupBy(F.col("r").alias("label")).agg(F.sum(F.pow("v", F.lit(float(power))) * F.col("w")).alias("v"))


def dot_vector_dot(a: Matrix, b: Matrix, vector: DataFrame, power: float = 1) -> DataFrame:
    """(a b)^power times a vector; with power 1 as a (b vector), which never makes the product."""
    if power == 1:
        return dot_vector(a, dot_vector(b, vector))
    return _then_vector(_terms(a, b).groupBy("r", "c").agg(F.sum("t").alias("v")), vector, power)


def shadow_vector_dot(a: Matrix, b: Matrix, vector: DataFrame, power: float = 1) -> DataFrame:
    return _then_vector(shadow(a, b).cells, vector, power)


def kron(a: Matrix, b: Matrix) -> Matrix:
    """Kronecker product; labels are structs of both labels. Its size is the product of the sizes by definition."""
    two = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    axes = [a.axis(k)[1].alias("x").join(b.axis(k)[1].alias("y"), F.lit(True)).select(two(F.col("x.label"), F.col("y.label")).alias("label"), two(F.col("x.pos"), F.col("y.pos")).alias("pos"), F.lit(None).cast("string").alias("deco")) for k in ("rows", "columns")]
    cells = a.cells.alias("x").join(b.cells.alias("y"), F.lit(True)).select(two(F.col("x.r"), F.col("y.r")).alias("r"), two(F.col("x.c"), F.col("y.c")).alias("c"), (F.col("x.v") * F.col("y.v")).alias("v"))
    return Matrix(stored(cells), *axes)


def _pairs(a: Matrix, b: Matrix) -> DataFrame:
    """(r, c1, c2, v): products of the cells of each common row."""
    x = a.cells.select("r", F.col("c").alias("c1"), F.col("v").alias("x"))
    y = b.cells.select("r", F.col("c").alias("c2"), F.col("v").alias("y"))
    return x.join(y, "r").select("r", "c1", "c2", (F.col("x") * F.col("y")).alias("v"))


def row_kron(a: Matrix, b: Matrix) -> Matrix:
    """Row-wise Kronecker product; a column label is the struct of both."""
    cells = _pairs(a, b).select("r", F.struct(F.col("c1").alias("a"), F.col("c2").alias("b")).alias("c"), "v")
    return Matrix(stored(cells), a.rows)


def row_kron_dot(a: Matrix, b: Matrix, factor: DataFrame, power: float = 1) -> DataFrame:
    """(label, v): per row the sum of (a b)^power times factor(c1, c2, v), without the product table.

    The factor meets a first, so only pairs that it weighs are made.
    """
    f = factor.select("c1", "c2", F.col("v").alias("f"))
    x = a.cells.select("r", F.col("c").alias("c1"), F.col("v").alias("x"))
    y = b.cells.select("r", F.col("c").alias("c2"), F.col("v").alias("y"))
    both = x.join(f, "c1").join(y, ["r", "c2"])
    return both.groupBy(F.col("r").alias("label")).agg(F.sum(F.pow(F.col("x") * F.col("y"), F.lit(float(power))) * F.col("f")).alias("v"))


def row_kron_dot_transpose(a: Matrix, b: Matrix, factor: DataFrame, power: float = 1) -> DataFrame:
    """(c1, c2, v): over the rows the sum of (a b)^power times factor(label, v)."""
    f = factor.select(F.col("label").alias("r"), F.col("v").alias("f"))
    return _pairs(a, b).join(f, "r").groupBy("c1", "c2").agg(F.sum(F.pow("v", F.lit(float(power))) * F.col("f")).alias("v"))


def second_moment(m: Matrix) -> Matrix:
    """Transpose times matrix; one triangle is computed, the other mirrored."""
    x, y = m.cells.select("r", F.col("c").alias("c1"), F.col("v").alias("x")), m.cells.select("r", F.col("c").alias("c2"), F.col("v").alias("y"))
    half = x.join(y, "r").filter("c1 <= c2").groupBy("c1", "c2").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    cells = half.select(F.col("c1").alias("r"), F.col("c2").alias("c"), "v").unionByName(half.filter("c1 < c2").select(F.col("c2").alias("r"), F.col("c1").alias("c"), "v"))
    return Matrix(stored(cells), m.cols, m.cols)


def row_kron_second_moment(a: Matrix, b: Matrix) -> Matrix:
    return second_moment(row_kron(a, b))


def pairwise_l2square(m: Matrix) -> Matrix:
    """Squared distances of all pairs of rows, |x|^2 + |y|^2 - 2 x y, on the whole grid of rows; of few columns in blocks."""
    if (places := pairs.narrow(m.cells.select("c"))) is not None:
        lines = pairs.sparse(m.cells, "r", "c", places)
        full = m.rows.select("label").join(lines, "label", "left")
        full = full.select("label", F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("val", F.array().cast("array<double>")).alias("val"))
        width = places.count()
        return Matrix(pairs.all_pairs(pairs.packed(full, width), None, "l2square", width, ("r", "c")), m.rows, m.rows)
    norm = m.cells.groupBy("r").agg(F.sum(F.col("v") * F.col("v")).alias("n"))
    line = m.rows.select(F.col("label").alias("r")).join(norm, "r", "left").select("r", F.coalesce("n", F.lit(0.0)).alias("n"))
    gram = _terms(m, Matrix(m.cells.select(F.col("c").alias("r"), F.col("r").alias("c"), "v"), m.cols, m.rows)).groupBy("r", "c").agg(F.sum("t").alias("g"))
    grid = line.join(line.select(F.col("r").alias("c"), F.col("n").alias("n2")), F.lit(True)).join(gram, ["r", "c"], "left")
    return Matrix(stored(grid.select("r", "c", F.greatest(F.lit(0.0), F.col("n") + F.col("n2") - 2 * F.coalesce("g", F.lit(0.0))).alias("v"))), m.rows, m.rows)


def linear_error(m: Matrix, regressor: Matrix, intercept: DataFrame, target: DataFrame) -> DataFrame:
    """(label, v) per column k of regressor: over the rows i the sum of ((m regressor)(i, k) + intercept(k) + target(k, or i))^2.

    intercept is (label, v) over the columns of regressor, target (label, v) over the same.
    """
    shift = regressor.cols.select(F.col("label").alias("c"))
    for name, d in (("p", intercept), ("q", target)):
        shift = shift.join(d.select(F.col("label").alias("c"), F.col("v").alias(name)), "c", "left")
    shift = shift.select("c", (F.coalesce("p", F.lit(0.0)) + F.coalesce("q", F.lit(0.0))).alias("s")).withColumn("n", m.rows.agg(F.count("*")).scalar())
    sums = dot(m, regressor).cells.groupBy("c").agg(F.sum("v").alias("a"), F.sum(F.col("v") * F.col("v")).alias("b"))
    both = shift.join(sums, "c", "left")
    # sum of (x + s)^2 = sum x^2 + 2 s sum x + n s^2; rows without a product count with x = 0
    v: Column = F.coalesce("b", F.lit(0.0)) + 2 * F.col("s") * F.coalesce("a", F.lit(0.0)) + F.col("n") * F.col("s") * F.col("s")
    return both.select(F.col("c").alias("label"), v.alias("v"))

