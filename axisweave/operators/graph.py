"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.functions.checkpoints import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of edges (a, b): component is the smallest id reachable; ids without an edge are absent.

    Each round every node links its larger neighbours, then its smaller ones, to the smallest it
    knows, which halves long chains; it ends when a round changes nothing. The minimum of a node is
    aggregated before the join, and the join's hot nodes are split by adaptive execution.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut(small)
        now = tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of directed edges (a, b): ids that reach each other share the smallest of their ids.

    Colouring: the smallest id that reaches a node colours it, and the nodes that reach back to their colour
    within it are one component; they leave and the rest goes on.
    """
    e = cut(edges.filter("a <> b").select("a", "b").distinct())
    left = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct())
    done = None
    while not left.isEmpty():
        colour = _spread(left.select("id", F.col("id").alias("k")), e)
        pairs = cut(e.join(colour.withColumnRenamed("id", "a").withColumnRenamed("k", "ka"), "a").join(colour.withColumnRenamed("id", "b").withColumnRenamed("k", "kb"), "b").filter("ka = kb").select(F.col("b").alias("a"), F.col("a").alias("b")))
        reached = cut(colour.filter("id = k"))
        while True:
            more = cut(reached.join(pairs.withColumnRenamed("a", "id"), "id").select(F.col("b").alias("id"), "k").distinct().join(reached.select("id"), "id", "left_anti"))
            if more.isEmpty():
                break
            reached = cut(reached.unionByName(more))
        done = reached if done is None else done.unionByName(reached)
        left = cut(left.join(reached.select("id"), "id", "left_anti"))
        e = cut(e.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi"))
    return (left.withColumn("k", F.col("id")) if done is None else done).select("id", F.col("k").alias("component"))


def _spread(colour: DataFrame, e: DataFrame) -> DataFrame:
    """Carries the smallest k along edges a -> b until nothing changes."""
    colour = cut(colour)
    while True:
        come = colour.withColumnRenamed("id", "a").join(e, "a").groupBy(F.col("b").alias("id")).agg(F.min("k").alias("new"))
        both = cut(colour.join(come, "id", "left").withColumn("least", F.least("k", "new")))
        if both.filter("least < k").isEmpty():
            return both.select("id", "k")
        colour = both.select("id", F.col("least").alias("k"))
