"""Matrices as DataFrames, and reading and writing them as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axisweave.matrix import Matrix

#: A wide table has at most this many columns.
MAX_COLUMNS = 10_000


def to_flat(m: Matrix, row: str = "col0", col: str = "col1", value: str = "similarity", deco_row: str | None = None, deco_col: str | None = None) -> DataFrame:
    """Long table of the non-zero cells, with decorations where they are named (missing: '')."""
    d = m.cells
    for name, axis, key in ((deco_row, m.rows, "r"), (deco_col, m.cols, "c")):
        if name:
            d = d.join(axis.select(F.col("label").alias(key), F.coalesce("deco", F.lit("")).alias(name)), key, "left")
    return d.select(F.col("r").alias(row), F.col("c").alias(col), F.col("v").alias(value), *[x for x in (deco_row, deco_col) if x])


def to_wide(m: Matrix, deco: bool = False, limit: int = MAX_COLUMNS) -> DataFrame:
    """One row a row label and one column a column label, 0 where no cell is; the column labels are collected (limit at most)."""
    named = F.coalesce("deco", F.col("label").cast("string")) if deco else F.col("label").cast("string")
    cols = m.cols.orderBy("pos").select("label", named.alias("name")).limit(limit + 1).collect()
    if len(cols) > limit:
        raise ValueError(f"more than {limit} columns")
    wide = m.cells.groupBy("r").pivot("c", [x["label"] for x in cols]).agg(F.first("v")) if cols else m.cells.select("r").distinct()
    row = F.coalesce("deco", F.col("label").cast("string")) if deco else F.col("label")
    d = m.rows.join(wide, F.col("label") == F.col("r"), "left")
    return d.select(row.alias("row"), *[F.coalesce(F.col(f"`{x['label']}`"), F.lit(0.0)).alias(x["name"]) for x in cols])


def to_lists(m: Matrix, col: str = "col", prefix: str = "list_of_", exclude: bool = False) -> DataFrame:
    """Per row the column labels of its cells by falling value (ties by label); exclude drops the row's own label."""
    d = m.cells.filter("r <> c") if exclude else m.cells
    listed = F.sort_array(F.collect_list(F.struct((-F.col("v")).alias("v"), "c")))
    return d.groupBy(F.col("r").alias(col)).agg(F.transform(listed, lambda x: x["c"]).alias(f"{prefix}{col}"))


def to_rows(m: Matrix) -> DataFrame:
    """(r, idx, val): each row as its column labels and values in label order; rows without cells have empty arrays."""
    lists = m.cells.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("x"))
    kind = dict(m.cells.dtypes)["c"]
    d = m.rows.join(lists, F.col("label") == F.col("r"), "left")
    empty = lambda k: F.array().cast(f"array<{k}>")
    return d.select(F.col("label").alias("r"), F.coalesce(F.transform("x", lambda e: e["c"]), empty(kind)).alias("idx"), F.coalesce(F.transform("x", lambda e: e["v"]), empty("double")).alias("val"))


def to_dense(m: Matrix) -> DataFrame:
    """(r, val): each row as one array over all columns in their order."""
    places = m.cols.select(F.col("label").alias("c"), (F.row_number().over(W.orderBy("pos")) - 1).alias("p"))
    pairs = m.cells.join(places, "c").groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("x"))
    d = m.rows.join(pairs, F.col("label") == F.col("r"), "left").withColumn("n", m.width("rows"))
    value = lambda k: F.coalesce(F.try_element_at("x", k.cast("int")), F.lit(0.0))
    return d.select(F.col("label").alias("r"), F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), value)).otherwise(F.array().cast("array<double>")).alias("val"))


def to_arrow(m: Matrix):
    """to_rows as a PyArrow table on the driver."""
    return to_rows(m).toArrow()


def to_numpy(m: Matrix):
    """(row labels, column labels, dense array) on the driver, for results known to be small."""
    import numpy as np

    rows, cols = ([x["label"] for x in a.orderBy("pos").collect()] for a in (m.rows, m.cols))
    at_r, at_c = ({x: k for k, x in enumerate(a)} for a in (rows, cols))
    out = np.zeros((len(rows), len(cols)))
    for x in m.cells.collect():
        out[at_r[x["r"]], at_c[x["c"]]] = x["v"]
    return rows, cols, out


def write(m: Matrix, path: str, mode: str = "error", partitions: int | None = None) -> None:
    """Writes cells and axes as Parquet below path; cells are clustered by row."""
    cells = m.cells if partitions is None else m.cells.repartition(partitions, "r")
    for name, df in (("cells", cells), ("rows", m.rows), ("cols", m.cols)):
        df.write.mode(mode).parquet(f"{path}/{name}")


def write_bucketed(m: Matrix, table: str, buckets: int, by: str = "r") -> None:
    """Saves the cells as a table bucketed by an axis, so that later joins on it need no exchange."""
    m.cells.write.bucketBy(buckets, by).sortBy(by).saveAsTable(table)


def read(spark: SparkSession, path: str) -> Matrix:
    return Matrix(*(spark.read.parquet(f"{path}/{name}") for name in ("cells", "rows", "cols")))
