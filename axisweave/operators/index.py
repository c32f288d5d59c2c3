"""Lookups, grouping, ordering and de-duplication by the values of a column.

A table has an ordinal column (``ord``) where the order of rows matters; Spark rows have none by themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _columns(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def factorize(df: DataFrame, key: str | list[str], order: str = "ord") -> DataFrame:
    """Adds ``code``: values are numbered from 0 by first appearance. The distinct values are numbered, not the rows."""
    first = df.groupBy(*_columns(key)).agg(F.min(order).alias("__first"))
    codes = first.withColumn("code", F.row_number().over(W.orderBy("__first")) - 1).drop("__first")
    return df.join(codes, _columns(key))


def reversed_index(df: DataFrame, key: str | list[str], order: str = "ord") -> DataFrame:
    """Inverted index: each value with the ordinals of its rows."""
    return df.groupBy(*_columns(key)).agg(F.sort_array(F.collect_list(order)).alias("indices"))


def counts(df: DataFrame, key: str | list[str]) -> DataFrame:
    return df.groupBy(*_columns(key)).count()


def sizes_of(df: DataFrame, key: str | list[str], wanted: DataFrame) -> DataFrame:
    """wanted (the key columns) with the number of rows of each value, 0 where there is none."""
    k = _columns(key)
    return wanted.join(counts(df, key), k, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def lookup(df: DataFrame, key: str | list[str], wanted: DataFrame, order: str = "ord") -> DataFrame:
    """wanted with the ordinals of the matching rows (an empty array where there is none)."""
    k = _columns(key)
    kind = dict(df.dtypes)[order]
    return wanted.join(reversed_index(df, key, order), k, "left").withColumn("indices", F.coalesce("indices", F.array().cast(f"array<{kind}>")))


def matching(df: DataFrame, key: str | list[str], wanted: DataFrame) -> DataFrame:
    """The rows whose value is wanted, each once."""
    return df.join(wanted, _columns(key), "left_semi")


def first_of(df: DataFrame, key: str | list[str], wanted: DataFrame, order: str = "ord") -> DataFrame:
    """wanted with the first ordinal of each value, -1 where there is none."""
    k = _columns(key)
    return wanted.join(df.groupBy(*k).agg(F.min(order).alias("first")), k, "left").withColumn("first", F.coalesce("first", F.lit(-1)))


def deduplicate(df: DataFrame, key: str | list[str], take: str = "first", order: str = "ord") -> DataFrame:
    """One whole row a value, the first or the last; aggregated before the exchange."""
    if take not in ("first", "last"):
        raise ValueError("take is 'first' or 'last'")
    pick = F.min_by if take == "first" else F.max_by
    return df.groupBy(*_columns(key)).agg(pick(F.struct(*df.columns), F.col(order)).alias("__row")).select("__row.*")


def unique_positions(df: DataFrame, key: str | list[str], last: bool = True, order: str = "ord") -> DataFrame:
    return df.groupBy(*_columns(key)).agg((F.max if last else F.min)(order).alias(order))


def argsort(df: DataFrame, key: str, nb: int | None = None, reverse: bool = False, order: str = "ord") -> DataFrame:
    """Rows in a stable order of a column, NaN and null last in both directions; the nb first of them."""
    nan = F.isnull(key) | F.isnan(key) if dict(df.dtypes)[key] in ("double", "float") else F.isnull(key)
    out = df.orderBy(nan, F.desc(key) if reverse else F.asc(key), order)
    return out if nb is None else out.limit(nb)


def sort_unique(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().orderBy(key)


def union_sorted(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct().orderBy(a.columns[0])


def bisect_left(values: DataFrame, points: DataFrame, value: str = "v", point: str = "x") -> DataFrame:
    """points with ``at``: how many values are below each. One sorted pass over both, no join of ranges."""
    both = values.select(F.col(value).alias("k"), F.lit(1).alias("side")).unionByName(points.distinct().select(F.col(point).alias("k"), F.lit(0).alias("side")))
    n = math.ceil(max(1, values.count()) / 1_000_000)
    parts = both.repartitionByRange(n, "k", "side").withColumn("part", F.spark_partition_id()).persist()
    before = parts.groupBy("part").agg(F.sum("side").alias("s")).withColumn("before", F.sum("s").over(W.orderBy("part")) - F.col("s")).select("part", "before")
    run = F.sum("side").over(W.partitionBy("part").orderBy("k", "side").rowsBetween(W.unboundedPreceding, 0))
    at = parts.withColumn("run", run).join(F.broadcast(before), "part").filter("side = 0").select(F.col("k").alias(point), (F.col("run") + F.col("before")).cast("long").alias("at"))
    return points.join(at, point)


def column_quantiles(df: DataFrame, key: str, nb: int, label: str | None = None) -> DataFrame:
    """(bin, value): the column's sorted values cut into nb bins of about equal numbers of rows.

    value is the greatest of a bin, or with label 'first' its first, with 'most_common' its most frequent value.
    Works on the distinct values with their counts.
    """
    d = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))
    run = F.sum("n").over(W.orderBy("value"))
    total = d.agg(F.sum("n")).scalar()
    d = d.withColumn("run", run).withColumn("bin", F.least(F.floor((F.col("run") - 1) * nb / total), F.lit(nb - 1)).cast("int"))
    pick = {None: F.max("value"), "first": F.min("value"), "most_common": F.max_by("value", F.struct("n", "value"))}
    if label not in pick:
        raise ValueError(f"unknown label {label!r}")
    return d.groupBy("bin").agg(pick[label].alias("value"))


def compression_rate(df: DataFrame, key: str | list[str]) -> float:
    """Distinct values per row."""
    n = df.count()
    return df.select(*_columns(key)).distinct().count() / n if n else 0.0


def apply_mapping(df: DataFrame, key: str, mapping: dict, default=None, keep_same: bool = False) -> DataFrame:
    """Adds ``mapped``: the mapping's value, else the value itself (keep_same) or default."""
    table = df.sparkSession.createDataFrame([(k, v) for k, v in mapping.items()], [key, "__to"])
    fallback = F.col(key) if keep_same else F.lit(default)
    small = len(mapping) <= 100_000
    return df.join(F.broadcast(table) if small else table, key, "left").withColumn("mapped", F.coalesce("__to", fallback)).drop("__to")


def is_increasing(df: DataFrame, key: str, strictly: bool = False, order: str = "ord") -> bool:
    """Whether the column never falls (strictly: always rises) in the order of the rows."""
    return df.select(F.col(key).alias("v"), F.lag(key).over(W.orderBy(order)).alias("p")).filter("p >= v" if strictly else "p > v").isEmpty()
