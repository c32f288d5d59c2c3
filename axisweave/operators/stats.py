"""Figures of lines and of whole matrices; absent cells count as 0 wherever a figure is over all cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axisweave.matrix import COLUMNS, ROWS, Matrix, stored
from axisweave.sources.build import from_diagonal


def _zero() -> Column:
    return F.lit(0.0)


def per_line(m: Matrix, axis: str, **aggs: Column) -> DataFrame:
    """(label, aggregates of stored cells, width): every label of the axis, null aggregates where it has no cell."""
    key, labels = m.axis(axis)
    stats = m.cells.groupBy(F.col(key).alias("label")).agg(*[a.alias(k) for k, a in aggs.items()])
    return labels.select("label").join(stats, "label", "left").withColumn("width", m.width(axis))


def _over_all(m: Matrix, **aggs: Column) -> DataFrame:
    n, k = (a.agg(F.count("*")).scalar() for a in (m.rows, m.cols))
    return m.cells.agg(*[a.alias(name) for name, a in aggs.items()]).withColumn("width", n * k)


def _figure(m: Matrix, axis: str | None, value: Column, **aggs: Column) -> DataFrame:
    """(label, v) of an axis, or one row (v) of all cells."""
    if axis is None:
        return _over_all(m, **aggs).select(value.alias("v"))
    return per_line(m, axis, **aggs).select("label", value.alias("v"))


def to_diagonal(figures: DataFrame) -> Matrix:
    """A figure of every line as a square matrix, so that it chains with products."""
    return from_diagonal(figures)


def total(m: Matrix, axis: str | None = ROWS) -> DataFrame:
    return _figure(m, axis, F.coalesce("s", _zero()), s=F.sum("v"))


def mean(m: Matrix, axis: str | None = ROWS) -> DataFrame:
    return _figure(m, axis, F.coalesce("s", _zero()) / F.col("width"), s=F.sum("v"))


def _extreme(m: Matrix, axis, agg, pick) -> DataFrame:
    stored_only = F.col("n") == F.col("width")
    return _figure(m, axis, F.when(stored_only, F.col("x")).otherwise(pick(F.coalesce("x", _zero()), _zero())), x=agg("v"), n=F.count("*"))


def maximum_of(m: Matrix, axis: str | None = ROWS) -> DataFrame:
    return _extreme(m, axis, F.max, F.greatest)


def minimum_of(m: Matrix, axis: str | None = ROWS) -> DataFrame:
    return _extreme(m, axis, F.min, F.least)


def variance(m: Matrix, axis: str | None = ROWS) -> DataFrame:
    """Population variance over all cells."""
    mu = F.coalesce("s", _zero()) / F.col("width")
    return _figure(m, axis, F.greatest(_zero(), F.coalesce("q", _zero()) / F.col("width") - mu * mu), s=F.sum("v"), q=F.sum(F.col("v") * F.col("v")))


def deviation(m: Matrix, axis: str | None = ROWS) -> DataFrame:
    d = variance(m, axis)
    return d.withColumn("v", F.sqrt("v"))


def sum_power(m: Matrix, power: float, axis: str | None = ROWS) -> DataFrame:
    return _figure(m, axis, F.coalesce("s", _zero()), s=F.sum(F.pow("v", F.lit(float(power)))))


def count_nonzero(m: Matrix, axis: str | None = ROWS) -> DataFrame:
    return _figure(m, axis, F.coalesce("n", F.lit(0)), n=F.count("*"))


NORMS = {"l1": lambda v: F.sum(F.abs(v)), "l2": lambda v: F.sqrt(F.sum(v * v)), "linf": lambda v: F.max(F.abs(v))}


def norm(m: Matrix, axis: str | None = ROWS, kind: str = "l2") -> DataFrame:
    if kind not in NORMS:
        raise ValueError(f"unknown norm {kind!r}")
    return _figure(m, axis, F.coalesce("x", _zero()), x=NORMS[kind](F.col("v")))


def normalize(m: Matrix, axis: str | None = ROWS, kind: str = "l1", invpow: float = 1.0, invlog: float = 0.0, threshold: float | None = None, width: float = 1.0) -> Matrix:
    """Divides each line by its norm^invpow * log1p(norm)^invlog, damped by a logistic of the norm where a threshold is given.

    Lines without cells stay empty; None takes the norm of the whole matrix.
    """
    if kind not in NORMS:
        raise ValueError(f"unknown norm {kind!r}")
    if axis is None:
        d = m.cells.withColumn("n", m.cells.agg(NORMS[kind](F.col("v"))).scalar())
    else:
        key, _ = m.axis(axis)
        # aggregate, then join: a hot line is summed before the exchange and split by AQE in the join
        d = m.cells.join(m.cells.groupBy(key).agg(NORMS[kind](F.col("v")).alias("n")), key)
    factor = F.pow("n", F.lit(float(invpow)))
    if invlog:
        factor = factor * F.pow(F.log1p("n"), F.lit(float(invlog)))
    if threshold is not None:
        factor = factor * (1 + F.exp(-(F.col("n") - threshold) / width))
    return m.of(d.select("r", "c", (F.col("v") / factor).alias("v")))


def arg_extreme(m: Matrix, axis: str = ROWS, largest: bool = True, only_nonzero: bool = False) -> DataFrame:
    """(label, arg): where the extreme of each line is, the first by position among ties; absent cells compete as 0.

    With only_nonzero absent cells do not compete and lines without cells give null.
    """
    key, _ = m.axis(axis)
    out, others = m.other(axis)
    here = "c" if out == "c" else "r"
    place = others.select(F.col("label").alias(here), F.col("pos").alias("p"))
    sign = 1 if largest else -1
    cells = m.cells.join(place, here)
    rank = W.partitionBy(key).orderBy((F.col("v") * -sign), "p")
    top = cells.withColumn("k", F.row_number().over(rank)).filter("k = 1").select(F.col(key).alias("label"), F.col(here).alias("arg"), "v", "p")
    lines = m.axis(axis)[1].select("label").join(top, "label", "left")
    if only_nonzero:
        return lines.select("label", "arg")
    # the first absent place matters only for lines whose best stored value is not on the right side of 0
    open_ = lines.filter(F.col("v").isNull() | (F.col("v") * sign <= 0)).select("label")
    gaps = open_.join(others.select(F.col("label").alias("o"), F.col("pos").alias("op")), F.lit(True)).join(m.cells.select(F.col(key).alias("label"), F.col(here).alias("o")), ["label", "o"], "left_anti")
    first = gaps.groupBy("label").agg(F.min_by("o", "op").alias("gap"))
    d = lines.join(first, "label", "left")
    return d.select("label", F.when(F.col("gap").isNotNull() & (F.col("v").isNull() | (F.col("v") * sign <= 0)), F.col("gap")).otherwise(F.col("arg")).alias("arg"))


def dict_max(m: Matrix, axis: str = ROWS) -> dict:
    """{label: max} of the lines that have cells, on the driver; absent cells compete as 0 among non-empty columns."""
    from axisweave.operators.labels import without_zeros

    return {r["label"]: r["v"] for r in maximum_of(without_zeros(m), axis).collect()}


def dict_argmax(m: Matrix) -> dict:
    from axisweave.operators.labels import without_zeros

    return {r["label"]: r["arg"] for r in arg_extreme(without_zeros(m)).collect()}


def group_rows(m: Matrix, groups: DataFrame, aggregate: str = "mean") -> Matrix:
    """Rows joined by groups(label, g): sum, mean (absent cells as 0), max (at least 0 unless all rows have the cell) or first by position."""
    g = groups.select(F.col("label").alias("r"), "g")
    d = m.cells.join(g, "r")
    sizes = g.groupBy("g").agg(F.count("*").alias("size"))
    if aggregate == "first":
        firsts = g.join(m.rows.select(F.col("label").alias("r"), "pos"), "r").groupBy("g").agg(F.min_by("r", "pos").alias("r"))
        cells = m.cells.join(firsts, "r").select(F.col("g").alias("r"), "c", "v")
    elif aggregate in ("sum", "mean", "max"):
        agg = d.groupBy("g", "c").agg(F.sum("v").alias("s"), F.max("v").alias("x"), F.count("*").alias("n")).join(sizes, "g")
        top = F.when(F.col("n") == F.col("size"), F.col("x")).otherwise(F.greatest("x", _zero()))
        cells = agg.select(F.col("g").alias("r"), "c", {"sum": F.col("s"), "mean": F.col("s") / F.col("size"), "max": top}[aggregate].alias("v"))
    else:
        raise ValueError(f"unknown aggregate {aggregate!r}")
    rows = sizes.select(F.col("g").alias("label"), F.col("g").alias("pos"), F.lit(None).cast("string").alias("deco"))
    return Matrix(stored(cells), rows, m.cols)


def divergence(a: Matrix, b: Matrix, kl: bool = True, eps: float = 1e-11) -> DataFrame:
    """One row (v): sum of a log(a / b), values clipped at eps; kl adds the sum of b minus that of a."""
    both = a.cells.alias("a").join(b.cells.alias("b"), ["r", "c"], "full")
    x, y = F.coalesce("a.v", _zero()), F.coalesce("b.v", _zero())
    term = F.when(x > 0, x * F.log(F.greatest(x, F.lit(eps)) / F.greatest(y, F.lit(eps)))).otherwise(0.0)
    return both.agg(F.coalesce(F.sum(term - x + y if kl else term), _zero()).alias("v"))


def cosine_gram(m: Matrix, axis: str = COLUMNS) -> DataFrame:
    """(a, b, v) with a < b: cosines of the lines of an axis that share a cell."""
    key, other = ("c", "r") if axis == COLUMNS else ("r", "c")
    unit = normalize(m, axis, "l2").cells
    x, y = unit.select(other, F.col(key).alias("a"), F.col("v").alias("x")), unit.select(other, F.col(key).alias("b"), F.col("v").alias("y"))
    return x.join(y, other).filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def coherence(m: Matrix) -> DataFrame:
    """One row (v): the largest absolute cosine of two columns."""
    return cosine_gram(m).agg(F.coalesce(F.max(F.abs("v")), _zero()).alias("v"))


def gram_quantiles(m: Matrix, q: float = 0.1) -> DataFrame:
    """One row (v): a quantile of the absolute cosines of all pairs of columns (plotting position 0.4 at both ends)."""
    pairs = cosine_gram(m).select(F.abs("v").alias("x"))
    n = m.cols.agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("n")).scalar()
    ranked = pairs.withColumn("n", n).withColumn("k", F.col("n") - F.count("*").over(W.partitionBy()) + F.row_number().over(W.orderBy("x")))
    at = 0.4 + q * (F.col("n") + 1 - 0.4 - 0.4)
    low = F.least(F.greatest(F.floor(at), F.lit(1)), F.col("n") - 1)
    part = F.least(F.greatest(at - low, _zero()), F.lit(1.0))
    weight = F.when(F.col("k") == low, 1 - part).when(F.col("k") == low + 1, part).otherwise(0.0)
    return ranked.agg(F.coalesce(F.sum(F.col("x") * weight), _zero()).alias("v"))


def row_mean_gini(m: Matrix) -> DataFrame:
    """One row (v): the mean over the rows of the Gini index of their absolute values, absent cells included.

    The stored values of a row hold the last ranks, so absent cells need no rows of their own.
    """
    d = m.cells.withColumn("a", F.abs("v")).withColumn("width", m.width(ROWS))
    line = W.partitionBy("r")
    rank = F.col("width") - F.count("*").over(line) + F.row_number().over(line.orderBy("a", "c"))
    g = d.withColumn("k", rank).groupBy("r").agg((F.sum((2 * F.col("k") - F.col("width") - 1) * F.col("a")) / (F.sum("a") * F.first("width"))).alias("g"))
    n = m.rows.agg(F.count("*")).scalar()
    return g.agg(F.coalesce(F.sum("g"), _zero()).alias("s")).select((F.col("s") / n).alias("v"))


def volume_at_cutoff(m: Matrix, cutoff: float) -> DataFrame:
    """(label, v): per column the share of all rows whose running share of the column's sum, largest first, is below cutoff."""
    line = W.partitionBy("c")
    run = F.sum("v").over(line.orderBy(F.desc("v"), "r").rowsBetween(W.unboundedPreceding, 0)) / F.sum("v").over(line)
    low = m.cells.withColumn("s", run).groupBy(F.col("c").alias("label")).agg(F.count(F.when(F.col("s") < cutoff, 1)).alias("n"))
    n = m.rows.agg(F.count("*")).scalar()
    return m.cols.select("label").join(low, "label", "left").select("label", (F.coalesce("n", F.lit(0)) / n).alias("v"))


def anomaly(m: Matrix, skepticism: float = 1.0) -> Matrix:
    """Log-odds of a cell's corrected frequency in its row against the frequency of its column, on the whole grid.

    The expectation of a cell is its row's sum times its column's share; the deviation counts only as far as
    skepticism times its standard error. A single column gives 0.
    """
    total_ = m.cells.agg(F.sum("v")).scalar()
    row = per_line(m, ROWS, s=F.sum("v")).select(F.col("label").alias("r"), F.coalesce("s", _zero()).alias("rs"))
    col = per_line(m, COLUMNS, s=F.sum("v")).select(F.col("label").alias("c"), F.greatest(F.coalesce("s", _zero()) / total_, F.lit(1e-10)).alias("f"), m.width(ROWS).alias("k"))
    grid = row.join(col, F.lit(True)).join(m.cells, ["r", "c"], "left").withColumn("v", F.coalesce("v", _zero()))
    expected = F.col("rs") * F.col("f")
    diff = expected - F.col("v")
    err = F.least(skepticism * F.sqrt(F.greatest(expected, F.col("v"))), F.abs(diff)) * F.signum(diff)
    d = grid.withColumn("fixed", F.col("v") + err).withColumn("e", expected)
    per_row = d.groupBy("r").agg(F.sum("e").alias("es"))
    d = d.join(per_row, "r").withColumn("g", F.col("fixed") / F.col("es"))
    odds = F.log(F.col("g") * (1 - F.col("f")) / F.col("f") / (1 - F.col("g")))
    return m.of(d.select("r", "c", F.when((F.col("k") <= 1) | (F.col("es") <= 0), 0.0).otherwise(odds).alias("v")))


def default_row(m: Matrix, default: str = "mean") -> DataFrame:
    """(label, v) per column for rows that are not there: 'mean' of the columns, 'uniform' (one share each) or 'zero'."""
    if default == "mean":
        return mean(m, COLUMNS)
    if default not in ("uniform", "zero"):
        raise ValueError(f"unknown default {default!r}")
    n = m.cols.agg(F.count("*")).scalar()
    return m.cols.select("label", (1 / n if default == "uniform" else F.lit(0.0)).alias("v"))


def inverse_diagonal(matrix):
    """Diagonal of the inverse of a small symmetric positive matrix (NumPy, on the driver)."""
    import numpy as np

    root = np.linalg.inv(np.linalg.cholesky(np.asarray(matrix, float)))
    return (root * root).sum(0)
