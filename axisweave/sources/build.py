"""Matrices from relations: pivots, occurrences, lists, dense rows, diagonals, random cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisweave.matrix import Matrix, axis_of, stored

#: Ways to join values of one cell; ``first`` and ``last`` need the column that orders them.
AGGREGATES: dict[str, Callable[[Column, Column | None], Column]] = {
    "sum": lambda v, o: F.sum(v),
    "add": lambda v, o: F.sum(v),
    "min": lambda v, o: F.min(v),
    "max": lambda v, o: F.max(v),
    "mean": lambda v, o: F.avg(v),
    "std": lambda v, o: F.stddev_pop(v),
    "multiply": lambda v, o: F.product(v),
    "first": lambda v, o: F.min_by(v, o),
    "!": lambda v, o: F.min_by(v, o),
    "last": lambda v, o: F.max_by(v, o),
}


def _key(columns: str | list[str]) -> Column:
    """One label column; several columns become one struct label."""
    names = [columns] if isinstance(columns, str) else list(columns)
    return F.col(names[0]) if len(names) == 1 else F.struct(*names)


def from_cells(df: DataFrame, r: str = "r", c: str = "c", v: str | None = "v", aggregate: str = "sum", order: str | None = None, rows: DataFrame | None = None, cols: DataFrame | None = None) -> Matrix:
    """A matrix of a relation of coordinates; cells given more than once are aggregated, null and NaN values skipped."""
    return from_pivot(df, r, c, v, aggregate, order, rows, cols)


def from_pivot(df: DataFrame, index, columns, values: str | None = None, aggregate: str | Callable[[Column], Column] = "sum", order: str | None = None, rows: DataFrame | None = None, cols: DataFrame | None = None) -> Matrix:
    """Pivot by one or more columns on each side; without values every row counts 1.

    Rows whose value is null or NaN still give their labels. ``aggregate`` is a name or a function of the value column.
    """
    unknown = {x for k in (index, columns, values, order) if k for x in ([k] if isinstance(k, str) else k)} - set(df.columns)
    if unknown:
        raise ValueError(f"no such column: {', '.join(sorted(unknown))}")
    if isinstance(aggregate, str) and aggregate not in AGGREGATES:
        raise ValueError(f"unknown aggregate {aggregate!r}")
    if aggregate in ("first", "!", "last") and not order:
        raise ValueError("first and last need the column that orders the rows")
    v = F.nanvl(F.col(values).cast("double"), F.lit(None).cast("double")) if values else F.lit(1.0)
    d = df.select(_key(index).alias("r"), _key(columns).alias("c"), v.alias("v"), *([F.col(order).alias("o")] if order else []))
    agg = aggregate(F.col("v")) if callable(aggregate) else AGGREGATES[aggregate](F.col("v"), F.col("o") if order else None)
    known = d.filter("v is not null")
    cells = known.groupBy("r", "c").agg(agg.alias("v"))
    axes = [axis_of(d.select(k).distinct()) if given is None else given for k, given in (("r", rows), ("c", cols))]
    out = Matrix(stored(cells), *axes)
    out.terms = known.select("r", "c", "v") if aggregate in ("sum", "add") else None
    return out


def from_occurrence(df: DataFrame, r: str, c: str) -> Matrix:
    """How often each pair of labels occurs together."""
    return from_pivot(df, r, c)


def from_dict(spark: SparkSession, pairs: dict) -> Matrix:
    """The items of a dict as pairs of row and column."""
    return from_occurrence(spark.createDataFrame(list(pairs.items()), ["r", "c"]), "r", "c")


def from_lists(df: DataFrame, r: str, columns: str, values: str | None = None) -> Matrix:
    """Rows with an array of column labels and maybe one of values; a label given twice in a row adds up."""
    pair = F.arrays_zip(F.col(columns).alias("c"), F.col(values).alias("v")) if values else F.transform(columns, lambda c: F.struct(c.alias("c"), F.lit(1.0).alias("v")))
    cells = df.select(F.col(r).alias("r"), F.explode(pair).alias("x")).select("r", "x.c", F.col("x.v").cast("double").alias("v"))
    return Matrix(stored(cells.groupBy("r", "c").agg(F.sum("v").alias("v"))), axis_of(df.select(r).distinct()), axis_of(cells.select("c").distinct()))


def from_dense(df: DataFrame, r: str, values: str, labels: list | None = None) -> Matrix:
    """Rows with an array of values; columns are numbered from 0 or named by labels."""
    d = df.select(F.col(r).alias("r"), F.posexplode(values).alias("c", "v"))
    if labels is not None:
        named = df.sparkSession.createDataFrame([(k, x) for k, x in enumerate(labels)], ["pos", "label"])
        cols = axis_of(named.select("label", "pos"), F.col("pos"))
        d = d.join(F.broadcast(named), F.col("c") == F.col("pos")).select("r", F.col("label").alias("c"), "v")
        return Matrix(stored(d), axis_of(df.select(r)), cols)
    return Matrix(stored(d), axis_of(df.select(r)), axis_of(d.select("c").distinct()))


def from_diagonal(values: DataFrame) -> Matrix:
    """(label, v) as a square matrix; labels with v = 0 stay on the axes."""
    axis = axis_of(values.select("label"))
    return Matrix(stored(values.select(F.col("label").alias("r"), F.col("label").alias("c"), "v")), axis, axis)


def from_random(spark: SparkSession, shape: tuple[int, int] = (4, 3), density: float = 0.5, seed: int = 0, square: bool = False) -> Matrix:
    """Random cells in (0, 1); labels are r0.. and c0.. (square: r0.. on both axes). Each cell is there with probability density."""
    n, m = shape if not square else (shape[0], shape[0])
    row, col = F.concat(F.lit("r"), F.floor(F.col("id") / m).cast("string")), F.concat(F.lit("r" if square else "c"), (F.col("id") % m).cast("string"))
    # a value depends on its cell alone, so the same seed gives the same matrix on any cluster
    unit = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(1 << 40)) / float(1 << 40)
    cells = spark.range(n * m).filter(unit(1) < density).select(row.alias("r"), col.alias("c"), unit(2).alias("v"))
    axis = lambda k, p: axis_of(spark.range(k).select(F.concat(F.lit(p), F.col("id").cast("string")).alias("label"), "id"), F.col("id"))
    return Matrix(stored(cells), axis(n, "r"), axis(m, "r" if square else "c"))


def zeros(rows: DataFrame, cols: DataFrame) -> Matrix:
    """No cells on the given axes."""
    cells = rows.select(F.col("label").alias("r")).limit(0).join(cols.select(F.col("label").alias("c")).limit(0), F.lit(False)).withColumn("v", F.lit(0.0))
    return Matrix(cells, rows, cols)
