"""Ranks, truncations and quantiles of lines: windows over stored cells, or over the whole grid where asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axisweave.matrix import COLUMNS, ROWS, Matrix

#: Slack of running sums of doubles.
EPS = 1e-9


def grid(m: Matrix) -> DataFrame:
    """All cells, absent ones as 0: as large as the product of the axes."""
    full = m.rows.select(F.col("label").alias("r")).join(m.cols.select(F.col("label").alias("c")), F.lit(True))
    return full.join(m.cells, ["r", "c"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def _line(axis: str | None):
    """Window of a line and the label that breaks ties in it."""
    if axis is None:
        return W.partitionBy(), ["r", "c"]
    return (W.partitionBy("r"), ["c"]) if axis == ROWS else (W.partitionBy("c"), ["r"])


def rank(m: Matrix, axis: str | None = ROWS, reverse: bool = False, whole_grid: bool = False) -> DataFrame:
    """(r, c, v): rank of each stored cell in its line from 1; whole_grid ranks absent cells too, from 0. Ties by label."""
    line, tie = _line(axis)
    d = grid(m) if whole_grid else m.cells
    k = F.row_number().over(line.orderBy(F.desc("v") if reverse else F.asc("v"), *tie))
    return d.select("r", "c", (k - 1 if whole_grid else k).alias("v"))


def truncate_by_count(m: Matrix, nb: int | dict | DataFrame, axis: str | None = ROWS, whole_grid: bool = False) -> Matrix:
    """The nb largest cells of each line (or of all); nb may differ by label: a dict or (label, nb), 0 for the others.

    With whole_grid absent cells take places, so no negative value beats them.
    """
    line, tie = _line(axis)
    cells = m.cells
    if whole_grid:
        # the stored positive cells come first anyway; negative ones have the places that absent cells leave
        n = m.width(axis) if axis else m.rows.agg(F.count("*")).scalar() * m.cols.agg(F.count("*")).scalar()
        d = cells.withColumn("k", F.row_number().over(line.orderBy(F.desc("v"), *tie)) + F.when(F.col("v") < 0, n - F.count("*").over(line)).otherwise(0))
    elif axis is None and isinstance(nb, int):
        return m.of(cells.orderBy(F.desc("v"), *tie).limit(nb))
    else:
        d = cells.withColumn("k", F.row_number().over(line.orderBy(F.desc("v"), *tie)))
    if isinstance(nb, int):
        return m.of(d.filter(F.col("k") <= nb))
    key, labels = m.axis(axis)
    limits = nb if isinstance(nb, DataFrame) else cells.sparkSession.createDataFrame(list(nb.items()), f"label {dict(labels.dtypes)['label']}, nb long")
    return m.of(d.join(limits.select(F.col("label").alias(key), "nb"), key).filter(F.col("k") <= F.col("nb")))


def truncate_by_cumulative(m: Matrix, share: float, axis: str | None = ROWS) -> Matrix:
    """Per line (or of all) the fewest largest cells whose sum is at least (1 - share) of the line's."""
    if not 0 < share < 1:
        raise ValueError("share must be between 0 and 1")
    line, tie = _line(axis)
    order = line.orderBy(F.desc("v"), *tie)
    before = F.coalesce(F.sum("v").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    d = m.cells.withColumns({"k": F.row_number().over(order), "before": before, "all": F.sum("v").over(line)})
    return m.of(d.filter((F.col("k") == 1) | (F.col("before") < (1 - share) * F.col("all") - EPS)))


def truncate_by_budget(m: Matrix, density: DataFrame, volume: float, axis: str = ROWS) -> Matrix:
    """Per line the fewest largest cells whose summed density (label, v) reaches volume."""
    line, tie = _line(axis)
    other = "c" if axis == ROWS else "r"
    d = m.cells.join(density.select(F.col("label").alias(other), F.col("v").alias("w")), other, "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    order = line.orderBy(F.desc("v"), *tie)
    d = d.withColumns({"k": F.row_number().over(order), "run": F.sum("w").over(order.rowsBetween(W.unboundedPreceding, 0))})
    reached = F.max("run").over(order.rowsBetween(W.unboundedPreceding, -1))
    return m.of(d.withColumn("reached", reached).filter((F.col("k") == 1) | (F.col("reached") < volume)))


def truncate_by_groups(m: Matrix, groups: DataFrame, nb: int, axis: str = ROWS) -> Matrix:
    """Per line the nb largest cells of each group (label, g) of the other axis; group -1 and labels without one are left alone."""
    key, other = ("r", "c") if axis == ROWS else ("c", "r")
    d = m.cells.join(groups.select(F.col("label").alias(other), "g"), other, "left")
    # one pass: free cells of a line are a group of their own, whose ranks count for nothing
    free = F.col("g").isNull() | (F.col("g") == -1)
    k = F.row_number().over(W.partitionBy(key, "g").orderBy(F.desc("v"), other))
    return m.of(d.withColumn("k", k).filter(free | (F.col("k") <= nb)))


def truncate(m: Matrix, cutoff: float | None = None, nb: int | None = None, cum_h: float | None = None, cum_v: float | None = None, nb_h=None, nb_v=None) -> Matrix:
    """In this order: cum_h (rows), cum_v (columns), cutoff, nb (all), nb_h (rows), nb_v (columns)."""
    if any(x == 0 for x in (nb, nb_h, nb_v) if isinstance(x, int)):
        return Matrix(m.cells.filter("false"), m.rows, m.cols)
    m = truncate_by_cumulative(m, cum_h, ROWS) if cum_h is not None else m
    m = truncate_by_cumulative(m, cum_v, COLUMNS) if cum_v is not None else m
    m = m.of(m.cells.filter(F.col("v") >= cutoff)) if cutoff else m
    m = truncate_by_count(m, nb, None) if nb is not None else m
    m = truncate_by_count(m, nb_h, ROWS) if nb_h is not None else m
    return truncate_by_count(m, nb_v, COLUMNS) if nb_v is not None else m


def quantile(m: Matrix, q: float, axis: str | None = ROWS, only_nonzero: bool = False) -> DataFrame:
    """(label, v): the value at int(n q) of each sorted line, averaged with the one before where n is even.

    Absent cells count as 0 unless only_nonzero. At the ends the place is kept inside the line; a line
    of no values gives null.
    """
    from axisweave.operators.stats import per_line

    values = F.sort_array(F.collect_list("v"))
    d = m.cells.agg(values.alias("x")).withColumn("width", m.rows.agg(F.count("*")).scalar() * m.cols.agg(F.count("*")).scalar()) if axis is None else per_line(m, axis, x=values)
    d = d.withColumn("x", F.coalesce("x", F.array().cast("array<double>")))
    n = F.size("x") if only_nonzero else F.col("width")
    gap = F.lit(0) if only_nonzero else F.col("width") - F.size("x")
    d = d.withColumns({"n": n.cast("int"), "gap": gap.cast("int"), "neg": F.size(F.filter("x", lambda v: v < 0))})
    at = F.least(F.greatest(F.floor(F.col("n") * q), F.lit(0)), F.col("n") - 1).cast("int")

    def value(k: Column) -> Column:
        # negative values, then the absent zeros, then the positive ones
        return F.when(k < F.col("neg"), F.get("x", k)).when(k < F.col("neg") + F.col("gap"), 0.0).otherwise(F.get("x", k - F.col("gap")))

    even = (F.col("n") % 2 == 0) & (at > 0)
    v = F.when(F.col("n") <= 0, F.lit(None)).when(even, (value(at) + value(at - 1)) / 2).otherwise(value(at))
    return d.select(*(["label"] if axis else []), v.alias("v"))


def median(m: Matrix, axis: str | None = ROWS, only_nonzero: bool = False) -> DataFrame:
    return quantile(m, 0.5, axis, only_nonzero)


def quantile_boundaries(m: Matrix, nb: int, axis: str = ROWS) -> DataFrame:
    """(label, v array): nb - 1 boundaries of the stored values of each line, the value at int(j n / nb + 0.5) - 1 of each."""
    key, _ = m.axis(axis)
    d = m.cells.groupBy(F.col(key).alias("label")).agg(F.sort_array(F.collect_list("v")).alias("x"))
    at = lambda j: F.least(F.greatest(F.floor(j * F.size("x") / nb + 0.5), F.lit(1)), F.size("x")).cast("int")
    return d.select("label", F.transform(F.sequence(F.lit(1), F.lit(nb - 1)), lambda j: F.element_at("x", at(j))).alias("v"))


def quantile_bins(m: Matrix, nb: int, axis: str = ROWS) -> Matrix:
    """Replaces each stored cell by the number of its quantile bin in its line, from 1."""
    key, _ = m.axis(axis)
    bounds = quantile_boundaries(m, nb, axis).select(F.col("label").alias(key), F.col("v").alias("bounds"))
    d = m.cells.join(bounds, key)
    return m.of(d.select("r", "c", (F.size(F.filter("bounds", lambda b: b < F.col("v"))) + 1).cast("double").alias("v")))


def reco(m: Matrix, row, nb: int = 20) -> DataFrame:
    """The nb best columns of one row: column, value, decoration."""
    best = m.cells.filter(F.col("r") == F.lit(row)).orderBy(F.desc("v"), "c").limit(nb)
    return best.join(m.cols.select(F.col("label").alias("c"), "deco"), "c", "left").select(F.col("c").alias("label"), "v", "deco").orderBy(F.desc("v"), "label")


def reco_summary(m: Matrix, row) -> DataFrame:
    """One row: number of cells, sum and least value of a row."""
    return m.cells.filter(F.col("r") == F.lit(row)).agg(F.count("*").alias("nb_nonzero"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"), F.min("v").alias("min"))

