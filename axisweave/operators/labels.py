"""Selecting, renaming, ordering and aligning labels."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axisweave.matrix import COLUMNS, ROWS, Matrix, axis_of

#: Axes up to this number of labels are numbered in one go; larger ones by range partitions.
NUMBER_AT_ONCE = 100_000


def _frame(m: Matrix, which: str, labels) -> DataFrame:
    """Labels as a one-column DataFrame: a list, an axis or any DataFrame whose first column they are."""
    kind = dict(m.axis(which)[1].dtypes)["label"]
    if isinstance(labels, DataFrame):
        return labels.select(F.col(f"`{labels.columns[0]}`").alias("label")).distinct()
    return m.cells.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(labels)], f"label {kind}")


def _filtered(m: Matrix, which: str, labels, how: str) -> Matrix:
    key, axis = m.axis(which)
    want = _frame(m, which, labels)
    cells = m.cells.join(want.withColumnRenamed("label", key), key, how)
    axis = axis.join(want, "label", how).select("label", "pos", "deco")
    return Matrix(cells, axis, m.cols) if which == ROWS else Matrix(cells, m.rows, axis)


def restrict(m: Matrix, rows=None, columns=None) -> Matrix:
    """Keeps the listed labels that exist."""
    m = m if rows is None else _filtered(m, ROWS, rows, "left_semi")
    return m if columns is None else _filtered(m, COLUMNS, columns, "left_semi")


def exclude(m: Matrix, rows=None, columns=None) -> Matrix:
    """Drops the listed labels."""
    m = m if rows is None else _filtered(m, ROWS, rows, "left_anti")
    return m if columns is None else _filtered(m, COLUMNS, columns, "left_anti")


def get(m: Matrix, row, column) -> float:
    """One value by its labels; 0 where no cell is."""
    found = m.cells.filter((F.col("r") == F.lit(row)) & (F.col("c") == F.lit(column))).select("v").first()
    return found["v"] if found else 0.0


def sample_values(m: Matrix, points: DataFrame) -> DataFrame:
    """points(r, c) with their values."""
    return points.select("r", "c").join(m.cells, ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def without_zeros(m: Matrix, axis: str | None = None, min_nonzero: int = 1) -> Matrix:
    """Drops the lines of an axis that have fewer cells than min_nonzero; None: rows, then columns of what is left."""
    if axis is None:
        return without_zeros(without_zeros(m, ROWS, min_nonzero), COLUMNS, min_nonzero)
    key, _ = m.axis(axis)
    full = m.cells.groupBy(F.col(key).alias("label")).count().filter(F.col("count") >= min_nonzero)
    return _filtered(m, axis, full, "left_semi")


def diagonal(m: Matrix) -> Matrix:
    return m.of(m.cells.filter("r = c"))


def without_diagonal(m: Matrix) -> Matrix:
    return m.of(m.cells.filter("r <> c"))


def without_mask(m: Matrix, mask: Matrix) -> Matrix:
    """Drops the cells where mask has one."""
    return m.of(m.cells.join(mask.cells.select("r", "c"), ["r", "c"], "left_anti"))


def nonzero_mask(m: Matrix) -> Matrix:
    return m.of(m.cells.withColumn("v", F.lit(1.0)))


def zeros(m: Matrix) -> Matrix:
    return Matrix(m.cells.filter("false"), m.rows, m.cols)


def truncate_with_cutoff(m: Matrix, cutoff: float) -> Matrix:
    """Drops cells below cutoff."""
    return m.of(m.cells.filter(F.col("v") >= cutoff))


def transpose(m: Matrix) -> Matrix:
    return Matrix(m.cells.select(F.col("c").alias("r"), F.col("r").alias("c"), "v"), m.cols, m.rows)


def numbered(axis: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """The axis with pos numbered from 0 without gaps. Large axes are numbered by range partitions, not in one task."""
    by = by or [F.col("pos")]
    n = axis.count()
    if n <= NUMBER_AT_ONCE:
        return axis.withColumn("pos", (F.row_number().over(W.orderBy(*by)) - 1).cast("long"))
    parts = axis.repartitionByRange(math.ceil(n / NUMBER_AT_ONCE), *by).withColumn("__part", F.spark_partition_id()).persist()
    before = parts.groupBy("__part").count().withColumn("__before", F.sum("count").over(W.orderBy("__part")) - F.col("count"))
    d = parts.withColumn("__n", F.row_number().over(W.partitionBy("__part").orderBy(*by)) - 1).join(F.broadcast(before), "__part")
    return d.withColumn("pos", (F.col("__n") + F.col("__before")).cast("long")).drop("__part", "__n", "__before", "count")


def renumber(m: Matrix) -> Matrix:
    return Matrix(m.cells, numbered(m.rows), numbered(m.cols))


def sort(m: Matrix, axis: str | None = None, by: str = "label") -> Matrix:
    """Orders an axis (None: both) by label, or by deco with the label where there is none."""
    key = [F.col("label")] if by == "label" else [F.coalesce("deco", F.col("label").cast("string")), F.col("label")]
    rows = numbered(m.rows, key) if axis in (None, ROWS) else m.rows
    cols = numbered(m.cols, key) if axis in (None, COLUMNS) else m.cols
    return Matrix(m.cells, rows, cols)


def _positions(m: Matrix) -> DataFrame:
    n = renumber(m)
    d = m.cells.join(n.rows.select(F.col("label").alias("r"), F.col("pos").alias("rp")), "r")
    return d.join(n.cols.select(F.col("label").alias("c"), F.col("pos").alias("cp")), "c")


def tril(m: Matrix, k: int = 0) -> Matrix:
    """Cells on or below the k-th diagonal by position."""
    return m.of(_positions(m).filter(F.col("cp") <= F.col("rp") + k))


def triu(m: Matrix, k: int = 0) -> Matrix:
    """Cells on or above the k-th diagonal by position."""
    return m.of(_positions(m).filter(F.col("cp") >= F.col("rp") + k))


def take(m: Matrix, axis: str, positions: list[int]) -> Matrix:
    """Lines by position, in the given order and as often as given; the new labels are the places in the list."""
    key, labels = m.axis(axis)
    n = labels.count()
    if any(not -n <= p < n for p in positions):
        raise IndexError(f"position beyond {n} labels")
    want = m.cells.sparkSession.createDataFrame([(k, p % n) for k, p in enumerate(positions)], "new long, pos long")
    chosen = numbered(labels).join(F.broadcast(want), "pos").select("label", "new", "deco")
    cells = m.cells.join(chosen.select(F.col("label").alias(key), "new"), key).withColumn(key, F.col("new")).select("r", "c", "v")
    line = chosen.select(F.col("new").alias("label"), F.col("new").alias("pos"), "deco")
    return Matrix(cells, line, m.cols) if axis == ROWS else Matrix(cells, m.rows, line)


def slice_positions(m: Matrix, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None) -> Matrix:
    """The labels at positions [low, high) of each axis."""
    for which, span in ((ROWS, rows), (COLUMNS, columns)):
        if span is not None:
            m = _filtered(m, which, numbered(m.axis(which)[1]).filter(F.col("pos").between(span[0], span[1] - 1)), "left_semi")
    return m


def rename(m: Matrix, axis: str, prefix: str = "", suffix: str = "", mapping: dict | None = None) -> Matrix:
    """prefix + mapping.get(label, label) + suffix on an axis; new labels are strings and must stay unique."""
    new = F.col("label").cast("string")
    key, labels = m.axis(axis)
    if mapping:
        named = m.cells.sparkSession.createDataFrame([(k, str(x)) for k, x in mapping.items()], f"label {dict(labels.dtypes)['label']}, new string")
        table = labels.join(F.broadcast(named) if len(mapping) <= 100_000 else named, "label", "left")
        new = F.coalesce("new", new)
    else:
        table = labels
    table = table.withColumn("name", F.concat(F.lit(prefix), new, F.lit(suffix)))
    cells = m.cells.join(table.select(F.col("label").alias(key), "name"), key).withColumn(key, F.col("name")).select("r", "c", "v")
    line = table.select(F.col("name").alias("label"), "pos", "deco")
    return Matrix(cells, line, m.cols) if axis == ROWS else Matrix(cells, m.rows, line)


def set_deco(m: Matrix, rows: DataFrame | None = None, columns: DataFrame | None = None) -> Matrix:
    """Replaces decorations by those of (label, deco) tables."""
    dressed = lambda axis, d: axis if d is None else axis.drop("deco").join(d.select("label", F.col("deco").cast("string").alias("deco")), "label", "left")
    return Matrix(m.cells, dressed(m.rows, rows).select("label", "pos", "deco"), dressed(m.cols, columns).select("label", "pos", "deco"))


def merge_axes(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Labels of both (inner), of either (outer), of the right (right) or left one; the right decoration wins.

    Where the order keys have different types the labels are ordered by themselves.
    """
    if a is b or how == "left":
        return a
    x, y = a.select("label", F.col("pos").alias("p1"), F.col("deco").alias("d1")), b.select("label", F.col("pos").alias("p2"), F.col("deco").alias("d2"))
    both = x.join(y, "label", {"inner": "inner", "outer": "full", "right": "right"}[how])
    same = dict(a.dtypes)["pos"] == dict(b.dtypes)["pos"]
    pos = F.coalesce("p2", "p1") if how == "right" else F.coalesce("p1", "p2") if same else F.col("label")
    return both.select("label", pos.alias("pos"), F.coalesce("d2", "d1").alias("deco"))


def align(a: Matrix, b: Matrix, rows: str | None = "inner", columns: str | None = "inner") -> tuple[Matrix, Matrix]:
    """Both matrices on common axes: each axis 'inner', 'outer', 'right' (a takes b's labels) or None (as it is)."""
    out = []
    for which, how in ((ROWS, rows), (COLUMNS, columns)):
        x, y = a.axis(which)[1], b.axis(which)[1]
        axis = None if how is None else merge_axes(x, y, how)
        out.append((axis, x is y or how in (None, "outer")))

    def on(m: Matrix) -> Matrix:
        cells = m.cells
        for key, (axis, whole) in zip("rc", out):
            if not whole:
                cells = cells.join(axis.select(F.col("label").alias(key)), key, "left_semi")
        return Matrix(cells, m.rows if out[0][0] is None else out[0][0], m.cols if out[1][0] is None else out[1][0])

    return on(a), on(b)


def extend(m: Matrix, rows: DataFrame | list | None = None, columns: DataFrame | list | None = None) -> Matrix:
    """Adds labels without cells; given axes bring their decorations along."""
    def more(which, labels):
        axis = m.axis(which)[1]
        if labels is None:
            return axis
        if not (isinstance(labels, DataFrame) and set(labels.columns) >= {"label", "pos", "deco"}):
            labels = axis_of(_frame(m, which, labels))
        return merge_axes(axis, labels, "outer")

    return Matrix(m.cells, more(ROWS, rows), more(COLUMNS, columns))


def symmetrize(m: Matrix, restrict_to_common: bool = False) -> Matrix:
    """The same labels on both axes: all of them, or the common ones."""
    axis = merge_axes(m.rows, m.cols, "inner" if restrict_to_common else "outer")
    if not restrict_to_common:
        return Matrix(m.cells, axis, axis)
    keep = lambda d, key: d.join(axis.select(F.col("label").alias(key)), key, "left_semi")
    return Matrix(keep(keep(m.cells, "r"), "c"), axis, axis)


def _stack(ms: list[Matrix], axis: str) -> Matrix:
    """Concatenates lines: the stacked axis gets labels (number of the matrix, label); the other one is the union."""
    parts, lines = [], []
    for k, m in enumerate(ms):
        key, labels = m.axis(axis)
        tag = lambda c: F.struct(F.lit(k).alias("part"), c.alias("label"))  # noqa: B023, E731
        parts.append(m.cells.withColumn(key, tag(F.col(key))))
        lines.append(labels.select(tag(F.col("label")).alias("label"), tag(F.col("pos")).alias("pos"), "deco"))
    cells, line = (reduce(DataFrame.unionByName, x) for x in (parts, lines))
    rest = reduce(lambda a, b: merge_axes(a, b, "outer"), [m.other(axis)[1] for m in ms])
    return Matrix(cells, line, rest) if axis == ROWS else Matrix(cells, rest, line)


def hstack(ms: list[Matrix]) -> Matrix:
    return _stack(ms, COLUMNS)


def vstack(ms: list[Matrix]) -> Matrix:
    return _stack(ms, ROWS)


def sample_labels(m: Matrix, axis: str, p: int | float, seed: int = 0) -> Matrix:
    """Exactly p labels, or the share p of them, without replacement; the same seed gives the same labels."""
    labels = m.axis(axis)[1]
    n = labels.count()
    if isinstance(p, bool) or not (isinstance(p, int) and 0 < p <= n or isinstance(p, float) and 0 < p < 1):
        raise ValueError("a number of labels or a share between 0 and 1")
    chosen = labels.orderBy(F.xxhash64(F.lit(seed), F.col("label")), "label").limit(p if isinstance(p, int) else int(p * n))
    return _filtered(m, axis, chosen, "left_semi")


def element_sample(m: Matrix, p: float, seed: int = 0) -> Matrix:
    """Each cell with probability p, by a hash of its labels."""
    return m.of(m.cells.filter(F.pmod(F.xxhash64(F.lit(seed), "r", "c"), F.lit(1 << 40)) < p * (1 << 40)))


def random_label(m: Matrix, axis: str, seed: int = 0):
    return m.axis(axis)[1].orderBy(F.xxhash64(F.lit(seed), F.col("label"))).first()["label"]


def is_one_hot(m: Matrix, axis: str = ROWS) -> bool:
    """Every line of the axis has one cell, of value 1."""
    key, labels = m.axis(axis)
    per = m.cells.groupBy(F.col(key).alias("label")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    return labels.join(per, "label", "left").filter("coalesce(n, 0) <> 1 or low <> 1 or high <> 1").isEmpty()


def check_positive(m: Matrix) -> Matrix:
    if not m.cells.filter("v < 0").isEmpty():
        raise ValueError("a value is negative")
    return m
