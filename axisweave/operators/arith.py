"""Cell-wise arithmetic of two matrices and functions of stored cells."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from axisweave.matrix import COLUMNS, ROWS, Matrix, stored
from axisweave.operators.labels import merge_axes

#: Binary operations by name; the right value of ``divide`` is never 0 where both cells are stored.
REDUCERS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.when(b == 0, 0.0).otherwise(F.try_divide(a, b)),
    "max": F.greatest,
    "min": F.least,
    "first": lambda a, b: a,
    "last": lambda a, b: b,
    "complement": lambda a, b: F.when(b == 0, a).otherwise(0.0),
}


def reducer(name: str) -> Callable[[Column, Column], Column]:
    if name not in REDUCERS:
        raise ValueError(f"unknown reducer {name!r}")
    return REDUCERS[name]


def combine(a: Matrix, b: Matrix, f: str | Callable[[Column, Column], Column], how: str = "outer") -> Matrix:
    """f(a, b) cell by cell; outer: on all labels, absent cells as 0; inner: on the common labels and cells."""
    f = reducer(f) if isinstance(f, str) else f
    both = a.cells.alias("a").join(b.cells.alias("b"), ["r", "c"], "full" if how == "outer" else "inner")
    v = f(F.coalesce("a.v", F.lit(0.0)), F.coalesce("b.v", F.lit(0.0)))
    return Matrix(stored(both.select("r", "c", v.alias("v"))), merge_axes(a.rows, b.rows, how), merge_axes(a.cols, b.cols, how))


def add(a: Matrix, b: Matrix) -> Matrix:
    return reduce_sum([a, b])


def subtract(a: Matrix, b: Matrix) -> Matrix:
    return reduce_sum([a, -b])


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return combine(a, b, "multiply", "inner")


def divide(a: Matrix, b: Matrix) -> Matrix:
    """Quotient on the common labels; x / 0 is 0."""
    return combine(a, b, "divide", "inner")


def maximum(a: Matrix, b: Matrix) -> Matrix:
    return combine(a, b, "max")


def minimum(a: Matrix, b: Matrix) -> Matrix:
    return combine(a, b, "min")


def reduce_sum(ms: list[Matrix]) -> Matrix:
    """Sum on all labels: one union and one aggregate, whose partial sums run before the exchange; of pivots their rows are summed, not their sums."""
    cells = fold(DataFrame.unionByName, [m.cells if m.terms is None else m.terms for m in ms]).groupBy("r", "c").agg(F.sum("v").alias("v"))
    axes = [fold(lambda x, y: merge_axes(x, y, "outer"), [m.axis(k)[1] for m in ms]) for k in (ROWS, COLUMNS)]
    return Matrix(stored(cells), *axes)


def reduce_product(ms: list[Matrix]) -> Matrix:
    """Product on the common labels: one union and one aggregate that keeps the cells all have."""
    n = len(ms)
    cells = fold(DataFrame.unionByName, [m.cells for m in ms]).groupBy("r", "c").agg(F.product("v").alias("v"), F.count("*").alias("n")).filter(F.col("n") == n)
    axes = [fold(lambda x, y: merge_axes(x, y, "inner"), [m.axis(k)[1] for m in ms]) for k in (ROWS, COLUMNS)]
    return Matrix(stored(cells), *axes)


def scale(m: Matrix, axis: str, factors: DataFrame) -> Matrix:
    """Multiplies each line of an axis by its factor of (label, v); lines without one become 0."""
    key, _ = m.axis(axis)
    f = factors.select(F.col("label").alias(key), F.col("v").alias("f"))
    return m.of(m.cells.join(f, key).select("r", "c", (F.col("v") * F.col("f")).alias("v")))


def add_vector(m: Matrix, axis: str, vector: DataFrame) -> Matrix:
    """Adds the value of (label, v) to every cell of its line, absent ones too: the result fills lines with a value."""
    key, _ = m.axis(axis)
    other = m.other(axis)[1].select(F.col("label").alias("c" if key == "r" else "r"))
    full = vector.filter("v <> 0").select(F.col("label").alias(key), "v").join(other, F.lit(True)).select("r", "c", "v")
    return m.of(m.cells.unionByName(full).groupBy("r", "c").agg(F.sum("v").alias("v")))


# -- functions of stored cells: absent cells stay 0, cells that become 0 go --


def map_cells(m: Matrix, f: Callable[[Column], Column]) -> Matrix:
    return m.of(m.cells.select("r", "c", f(F.col("v")).alias("v")))


def apply(m: Matrix, function: Callable, *args) -> Matrix:
    """A vectorised Python function of the stored values; Arrow batches, so prefer map_cells where a Column can say it."""

    @pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(function(v.to_numpy(), *args))

    return map_cells(m, run)


def absolute(m: Matrix) -> Matrix:
    return map_cells(m, F.abs)


def sign(m: Matrix) -> Matrix:
    return map_cells(m, F.signum)


def power(m: Matrix, p: float) -> Matrix:
    return map_cells(m, lambda v: F.pow(v, F.lit(float(p))))


def sqrt(m: Matrix) -> Matrix:
    return map_cells(m, F.sqrt)


def inverse(m: Matrix, scalar: float = 1.0) -> Matrix:
    return map_cells(m, lambda v: F.lit(scalar) / v)


def log(m: Matrix, base: float | None = None) -> Matrix:
    return map_cells(m, lambda v: F.log(v) if base is None else F.log(v) / F.log(F.lit(float(base))))


def log1p(m: Matrix) -> Matrix:
    return map_cells(m, F.log1p)


def exp(m: Matrix) -> Matrix:
    return map_cells(m, F.exp)


def rounded(m: Matrix) -> Matrix:
    """To the nearest integer, halves to even."""
    return map_cells(m, F.rint)


def trunc(m: Matrix) -> Matrix:
    return map_cells(m, lambda v: F.signum(v) * F.floor(F.abs(v)))


def clip(m: Matrix, lower: float | None = None, upper: float | None = None) -> Matrix:
    def run(v):
        v = v if upper is None else F.least(v, F.lit(float(upper)))
        return v if lower is None else F.greatest(v, F.lit(float(lower)))

    return map_cells(m, run)


def logistic(m: Matrix, shift: float = 0.0, width: float = 1.0) -> Matrix:
    return map_cells(m, lambda v: 1 / (1 + F.exp(-(v - shift) / width)))


def compatibility(m: Matrix, row_category: DataFrame, column_category: DataFrame, same: float, different: float) -> Matrix:
    """v * same where the categories of row and column agree, else v * different; categories are (label, g)."""
    d = m.cells.join(row_category.select(F.col("label").alias("r"), F.col("g").alias("gr")), "r", "left")
    d = d.join(column_category.select(F.col("label").alias("c"), F.col("g").alias("gc")), "c", "left")
    return m.of(d.select("r", "c", (F.col("v") * F.when(F.col("gr").eqNullSafe(F.col("gc")), same).otherwise(different)).alias("v")))
