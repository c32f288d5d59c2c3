"""Distances of array columns as expressions, and all pairs of rows in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisweave.functions import pairs


def _fold(x: Column, y: Column, f) -> Column:
    return F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda a, t: a + t)


#: Name to expression of two arrays of doubles.
METRICS = {
    "sqeuclidean": lambda x, y: _fold(x, y, lambda a, b: (a - b) * (a - b)),
    "euclidean": lambda x, y: F.sqrt(_fold(x, y, lambda a, b: (a - b) * (a - b))),
    "cityblock": lambda x, y: _fold(x, y, lambda a, b: F.abs(a - b)),
    "chebychev": lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, t: F.greatest(a, t)),
    "scalar_product": lambda x, y: _fold(x, y, lambda a, b: a * b),
    "idiv": lambda x, y: _fold(x, y, lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0) - a + b),
}


def metric(name: str):
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}")
    return METRICS[name]


def pairwise(rows: DataFrame, name: str = "euclidean", flat: bool = True, digits: int | None = None) -> DataFrame:
    """(a, b, v) for all pairs of rows (r, val): a < b (flat), or both orders and the diagonal; v rounded to digits.

    All pairs are the result here, so their number is the square of the rows; use nearest_row for more rows than that allows.
    Vectors of one length are taken in blocks (functions/pairs.py), any others through a join.
    """
    f = metric(name)
    d = rows.select("r", F.col("val").cast("array<double>").alias("val"))
    d = d.filter("r is not null") if flat else d
    vectors = d.withColumnRenamed("r", "label")
    # a logarithm or a quotient has other results for other than positive values, so these are left to the expression
    width = pairs.regular(vectors, F.lit(0.0) if name == "idiv" else None)
    if width is not None:
        return pairs.all_pairs(pairs.packed(vectors, width), None, name, width, ("a", "b"), once=flat, zeros=True, digits=digits)
    x, y = d.select(F.col("r").alias("a"), F.col("val").alias("x")), d.select(F.col("r").alias("b"), F.col("val").alias("y"))
    both = x.join(y, F.col("a") < F.col("b")) if flat else x.join(y, F.lit(True))
    v = f(F.col("x"), F.col("y"))
    return both.select("a", "b", (v if digits is None else F.round(v, digits)).alias("v"))


def vector_distance(rows: DataFrame, vector: list[float], name: str = "sqeuclidean") -> DataFrame:
    """(r, v): distance of every row (r, val) to one vector."""
    y = F.array(*[F.lit(float(v)) for v in vector])
    return rows.select("r", metric(name)(F.col("val").cast("array<double>"), y).alias("v"))


def nearest_row(rows: DataFrame, name: str = "sqeuclidean", block: int = pairs.BLOCK) -> DataFrame:
    """(r, nearest, v): the nearest other row of each row, ties by label.

    The rows meet in blocks of at most ``block`` (functions/pairs.py), and each keeps its best so far, so a task holds
    a batch of blocks however many rows there are, and no pair is shuffled.
    """
    metric(name)
    d = rows.select(F.col("r").alias("label"), F.col("val").cast("array<double>").alias("val"))
    width = pairs.regular(d)
    if width is None:
        if not d.isEmpty():
            raise ValueError("the rows need vectors of one length without nulls")
        return d.select(F.col("label").alias("r"), F.col("label").alias("nearest"), F.lit(0.0).alias("v"))
    held = pairs.packed(d, width, block)
    found = pairs.best(held, held, name, width, 1, ("r", "nearest"), others=True)
    return found.groupBy("r").agg(F.min_by(F.struct("nearest", "v"), F.struct("v", "nearest")).alias("x")).select("r", "x.nearest", "x.v")
