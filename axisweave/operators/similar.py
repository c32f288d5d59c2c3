"""Similarity of lines and allocation of rows to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axisweave.functions import pairs
from axisweave.functions.checkpoints import cut
from axisweave.matrix import COLUMNS, ROWS, Matrix, stored
from axisweave.operators.product import best_of, largest
from axisweave.operators.topk import truncate_by_count, truncate_by_cumulative


def similarity(m: Matrix, other: Matrix | None = None, cutoff: float = 0.005, nb_keep: int = 200, top: int | None = 1000, cumtop: float | None = 0.02, digits: int | None = None) -> Matrix:
    """Overlap of rows, the sum of the smaller values over common columns; per row the nb_keep best above cutoff.

    With itself the rows are truncated first (cumtop, then top a column), which bounds what a popular column costs; without
    that, rows of few columns meet in blocks. digits rounds before the cutoff and the ranks, so equal overlaps tie whatever the order of sums.
    """
    if other is None:
        # the least values of a row go, and a column keeps its top rows
        m2 = truncate_by_cumulative(m, cumtop, ROWS) if cumtop else m
        m2 = truncate_by_count(m2, top, COLUMNS) if top else m2
        a = b = m2.cells
        rows, cols = m.rows, m.rows
    else:
        a, b, rows, cols = m.cells, other.cells, m.rows, other.rows
    if not top and nb_keep > 0 and cutoff >= 0:
        x, y = a.select("r", F.col("c").alias("k"), "v"), b.select(F.col("r").alias("c"), F.col("c").alias("k"), "v")
        if (found := best_of(x, y, "min", nb_keep, cutoff, digits)) is not None:
            return Matrix(stored(found), rows, cols)
    x, y = a.select("r", F.col("c").alias("k"), F.col("v").alias("x")), b.select(F.col("r").alias("c"), F.col("c").alias("k"), F.col("v").alias("y"))
    sums = x.join(y, "k").groupBy("r", "c").agg(F.sum(F.least("x", "y")).alias("v"))
    sums = (sums if digits is None else sums.withColumn("v", F.round("v", digits))).filter(F.col("v") > cutoff)
    return Matrix(stored(largest(sums, nb_keep)), rows, cols)


def jaccard(m: Matrix, digits: int | None = None) -> Matrix:
    """Common over all columns of two rows, rounded to digits; pairs without a common one are absent. Rows of few columns meet in blocks."""
    if (places := pairs.narrow(m.cells.select("c"))) is not None:
        width = places.count()
        return Matrix(pairs.all_pairs(pairs.packed(pairs.sparse(m.cells, "r", "c", places), width), None, "jaccard", width, ("r", "c"), digits=digits), m.rows, m.rows)
    sizes = m.cells.groupBy("r").agg(F.count("*").alias("n"))
    x = m.cells.select("r", "c")
    both = x.withColumnRenamed("r", "a").join(x.withColumnRenamed("r", "b"), "c").filter("a <= b").groupBy("a", "b").agg(F.count("*").alias("k"))
    d = both.join(sizes.select(F.col("r").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("r").alias("b"), F.col("n").alias("nb")), "b")
    v = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    half = d.select("a", "b", (v if digits is None else F.round(v, digits)).alias("v"))
    cells = half.select(F.col("a").alias("r"), F.col("b").alias("c"), "v").unionByName(half.filter("a < b").select(F.col("b").alias("r"), F.col("a").alias("c"), "v"))
    return Matrix(stored(cells), m.rows, m.rows)


def top_values_similarity(m: Matrix, other: Matrix | None = None, top: float | int = 0.1, axis: str = COLUMNS, renorm: bool = True, potential: bool = False) -> Matrix:
    """Overlap of the top values of each line of an axis: their number (potential: the left values) in common, over top if renorm.

    A share of top is taken of the length of a line, rounded down.
    """
    key, inner = ("c", "r") if axis == COLUMNS else ("r", "c")
    k = top if isinstance(top, int) else F.floor(m.width(axis) * top)
    order = W.partitionBy(key).orderBy(F.desc("v"), inner)

    def best(x: Matrix) -> DataFrame:
        return x.cells.withColumns({"n": F.row_number().over(order), "top": F.lit(k) if isinstance(k, int) else k}).filter("n <= top")

    a, b = best(m), best(other or m)
    x, y = a.select(F.col(key).alias("a"), inner, "v", "top"), b.select(F.col(key).alias("b"), inner)
    d = x.join(y, inner).groupBy(F.col("a").alias("r"), F.col("b").alias("c")).agg((F.sum("v") if potential else F.count("*").cast("double")).alias("s"), F.first("top").alias("top"))
    return Matrix(stored(d.select("r", "c", (F.col("s") / F.col("top") if renorm else F.col("s")).alias("v"))), m.axis(axis)[1], (other or m).axis(axis)[1])


# -- allocation ---------------------------------------------------------------


def _bound(name: str, x) -> None:
    if x is None:
        return
    if isinstance(x, bool) or not isinstance(x, (int, dict)):
        raise ValueError(f"expected an int or a dict of ints as {name}, not {type(x).__name__}")
    if any(v < 0 for v in (x.values() if isinstance(x, dict) else [x])):
        raise ValueError(f"{name} may not go below 0")


def _limit(m: Matrix, d: DataFrame, x, name: str) -> DataFrame:
    """Adds a column's bound: an int for all, a dict by label (0 for labels it lacks), null for none."""
    if not isinstance(x, dict):
        return d.withColumn(name, F.lit(x).cast("long"))
    table = d.sparkSession.createDataFrame(list(x.items()), f"c {dict(m.cols.dtypes)['label']}, {name} long")
    return d.join(table, "c", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def _greedy(m: Matrix, d: DataFrame, order: list[Column], pressure: int) -> Matrix:
    """Takes pairs in a total order while row and column have room, as one greedy pass would.

    Without volumes a window says which pairs a row takes. With them, all pairs that are within the room of
    both their row and their column among what is left are taken at once - no earlier pair can displace
    them - and rooms shrink until no pair is left.
    """
    free = d.filter("volume is null")
    if free.isEmpty() or not d.filter("volume is not null").isEmpty():
        taken, left = None, cut(d.withColumn("room", F.lit(pressure).cast("long")))
        while not left.isEmpty():
            at = left.withColumns({"kr": F.row_number().over(W.partitionBy("r").orderBy(*order)), "kc": F.row_number().over(W.partitionBy("c").orderBy(*order))})
            at = cut(at.withColumn("ok", (F.col("kr") <= F.col("room")) & (F.coalesce("volume", F.col("kc")) >= F.col("kc"))))
            now = at.filter("ok").select("r", "c", "v")
            taken = now if taken is None else taken.unionByName(now)
            used_r, used_c = (at.filter("ok").groupBy(k).agg(F.count("*").alias(f"used_{k}")) for k in "rc")
            left = at.filter("not ok").drop("kr", "kc", "ok").join(used_r, "r", "left").join(used_c, "c", "left")
            left = left.withColumns({"room": F.col("room") - F.coalesce("used_r", F.lit(0)), "volume": F.col("volume") - F.coalesce("used_c", F.lit(0))})
            left = cut(left.filter("room > 0 and (volume is null or volume > 0)").drop("used_r", "used_c"))
        return m.of(taken if taken is not None else d.select("r", "c", "v"))
    k = F.row_number().over(W.partitionBy("r").orderBy(*order))
    return m.of(d.withColumn("k2", k).filter(F.col("k2") <= pressure))


def _candidates(m: Matrix, max_ranks, max_volumes) -> DataFrame:
    """Cells with their rank in the column, within its rank bound; columns of volume 0 take none."""
    _bound("max_ranks", max_ranks)
    _bound("max_volumes", max_volumes)
    d = m.cells.withColumn("k", F.row_number().over(W.partitionBy("c").orderBy(F.desc("v"), "r")))
    d = _limit(m, _limit(m, d, max_ranks, "ranks"), max_volumes, "volume")
    d = d.filter("(ranks is null or k <= ranks) and (volume is null or volume > 0)")
    return d.join(m.cols.select(F.col("label").alias("c"), F.col("pos").alias("cp")), "c")


def round_robin_allocation(m: Matrix, maximum_pressure: int = 1, max_ranks: int | dict | None = None, max_volumes: int | dict | None = None) -> Matrix:
    """Columns take turns, rank by rank, each taking its best row that still has room; a bound of 0 takes none."""
    return _greedy(m, _candidates(m, max_ranks, max_volumes), [F.col("k"), F.col("cp")], maximum_pressure)


def argmax_allocation(m: Matrix, maximum_pressure: int = 1, max_ranks: int | dict | None = None, max_volumes: int | dict | None = None) -> Matrix:
    """Pairs by falling value, each taken if its row and column still have room; ties by labels."""
    return _greedy(m, _candidates(m, max_ranks, max_volumes), [F.desc("v"), F.col("cp"), F.col("r")], maximum_pressure)
