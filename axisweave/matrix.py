"""The handle of a labelled matrix: three DataFrames, no computation of its own.

``cells(r, c, v)`` holds the non-zero values (v is never null, NaN or 0; (r, c) is unique), ``rows`` and
``cols`` hold ``(label, pos, deco)``. ``pos`` is any sortable key that gives the order of an axis; axes made
from cells are ordered by label, so their ``pos`` is the label itself and no numbering job runs. An absent
cell is 0. Nothing here counts or collects unless its name says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, COLUMNS = "rows", "columns"


def stored(cells: DataFrame) -> DataFrame:
    """Cells in canonical form: no null, NaN or zero value."""
    return cells.select("r", "c", F.col("v").cast("double").alias("v")).filter("v is not null and not isnan(v) and v <> 0")


def axis_of(labels: DataFrame, pos: Column | None = None, deco: Column | None = None) -> DataFrame:
    """An axis from a DataFrame whose first column is the label."""
    label = F.col(f"`{labels.columns[0]}`")
    key = label if pos is None else pos
    return labels.select(label.alias("label"), key.alias("pos"), (F.lit(None).cast("string") if deco is None else deco.cast("string")).alias("deco"))


class Matrix:
    """cells, rows, cols; rows and cols default to the labels of the cells."""

    def __init__(self, cells: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None, strict: bool = False):
        self.cells = cells
        #: Rows (r, c, v) whose sums the cells are, if they are such sums: a sum of matrices then needs no sums of sums.
        self.terms: DataFrame | None = None
        self.rows = axis_of(cells.select("r").distinct()) if rows is None else rows
        self.cols = axis_of(cells.select("c").distinct()) if cols is None else cols
        if strict:
            self.check()

    # -- the axes by name -------------------------------------------------
    def axis(self, which: str) -> tuple[str, DataFrame]:
        """The name of an axis in cells, and its labels."""
        if which not in (ROWS, COLUMNS):
            raise ValueError(f"axis is 'rows' or 'columns', not {which!r}")
        return ("r", self.rows) if which == ROWS else ("c", self.cols)

    def other(self, which: str) -> tuple[str, DataFrame]:
        return self.axis(COLUMNS if which == ROWS else ROWS)

    def width(self, which: str) -> Column:
        """Number of labels across a line of an axis, as a scalar subquery of the plan that uses it."""
        return self.other(which)[1].agg(F.count("*").alias("n")).scalar()

    def of(self, cells: DataFrame) -> Matrix:
        """The same axes with other cells; zeros that an operation made are dropped."""
        return Matrix(stored(cells), self.rows, self.cols)

    # -- eager checks and figures -----------------------------------------
    def check(self) -> Matrix:
        """Raises ValueError unless labels are unique and every cell lies on the axes once."""
        for which in (ROWS, COLUMNS):
            key, labels = self.axis(which)
            if not labels.groupBy("label").count().filter("count > 1").isEmpty():
                raise ValueError(f"labels of {which} are not unique")
            if not self.cells.join(labels, F.col(key) == F.col("label"), "left_anti").isEmpty():
                raise ValueError(f"cells outside the {which}")
        if not self.cells.groupBy("r", "c").count().filter("count > 1").isEmpty():
            raise ValueError("a cell is given twice")
        return self

    def non_empty(self) -> Matrix:
        """Raises ValueError if an axis has no label (lazy results can't know)."""
        if self.rows.isEmpty() or self.cols.isEmpty():
            raise ValueError("no label is left")
        return self

    def shape(self) -> tuple[int, int]:
        return self.rows.count(), self.cols.count()

    def nnz(self) -> int:
        return self.cells.count()

    def density(self) -> float:
        n, m = self.shape()
        return self.nnz() / (n * m) if n and m else 0.0

    def is_square(self) -> bool:
        """Same labels on both axes."""
        a, b = self.rows.select("label"), self.cols.select("label")
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def describe(self) -> DataFrame:
        """One row: rows, columns, nnz, density, min, max, sum (of all cells, absent ones as 0)."""
        stats = self.cells.agg(F.count("*").alias("nnz"), F.min("v").alias("low"), F.max("v").alias("high"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"))
        d = stats.withColumn("n_rows", self.rows.agg(F.count("*")).scalar()).withColumn("n_cols", self.cols.agg(F.count("*")).scalar())
        size = F.col("n_rows") * F.col("n_cols")
        low, high = (F.when(F.col("nnz") == size, F.col(k)).otherwise(f(F.coalesce(F.col(k), F.lit(0.0)), F.lit(0.0))) for k, f in (("low", F.least), ("high", F.greatest)))
        return d.select("n_rows", "n_cols", "nnz", F.when(size > 0, F.col("nnz") / size).otherwise(0.0).alias("density"), low.alias("min"), high.alias("max"), "sum")

    def equals(self, other: Matrix, rtol: float = 1e-7) -> bool:
        """Same labels and close values."""
        for which in (ROWS, COLUMNS):
            a, b = self.axis(which)[1].select("label"), other.axis(which)[1].select("label")
            if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
                return False
        both = self.cells.alias("a").join(other.cells.alias("b"), ["r", "c"], "full")
        x, y = F.coalesce("a.v", F.lit(0.0)), F.coalesce("b.v", F.lit(0.0))
        return both.filter(F.abs(x - y) > 1e-12 + rtol * F.abs(y)).isEmpty()

    def view(self, name: str) -> Matrix:
        """Names the cells and axes for spark.sql: name, name_rows, name_cols."""
        for suffix, df in (("", self.cells), ("_rows", self.rows), ("_cols", self.cols)):
            df.createOrReplaceTempView(name + suffix)
        return self

    def persist(self) -> Matrix:
        for df in (self.cells, self.rows, self.cols):
            df.persist()
        return self

    def __repr__(self) -> str:
        return f"Matrix({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in self.cells.schema)})"

    def __neg__(self):
        out = self.of(self.cells.withColumn("v", -F.col("v")))
        out.terms = None if self.terms is None else self.terms.withColumn("v", -F.col("v"))
        return out

    def __pos__(self):
        return self

    def __add__(self, other):
        return self.add(other) if isinstance(other, Matrix) else self.map_cells(lambda v: v + F.lit(float(other)))

    __radd__ = __add__

    def __sub__(self, other):
        return self + (-other)

    def __rsub__(self, other):
        return (-self) + other

    def __mul__(self, other):
        return self.multiply(other) if isinstance(other, Matrix) else self.map_cells(lambda v: v * F.lit(float(other)))

    __rmul__ = __mul__

    def __truediv__(self, other):
        if isinstance(other, Matrix):
            return self.divide(other)
        if not other:
            raise ZeroDivisionError("division of a matrix by 0")
        return self.map_cells(lambda v: v / F.lit(float(other)))

    def __pow__(self, power):
        return self.power(power)

    def __abs__(self):
        return self.abs()

    def __matmul__(self, other):
        return self.dot(other)
