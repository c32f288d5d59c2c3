"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows lie in partitions. How many rows each partition sends to each shard is
drawn from the multivariate hypergeometric law, so the counts are those of a uniform
permutation and the shards' sizes are exact. Every partition permutes its rows
and deals them by its row of the matrix; every shard permutes what it got.

A partition here is a block of rows by hash, not a Spark task, so a lost executor
or another split of the input changes nothing. Equal rows are numbered first and the number is hashed with
them, so repetitions are dealt like any other rows. Law: ``rows`` (shards' counts differ by
one at most), so ``grown_shard`` is null.

Edge cases. A null text has size 1 and the checksum of the empty text; a null doc_id is
hashed as such; doc_id may be of any type that can be hashed. Rows are told apart by all their columns in ``shard`` (maps by their JSON) and by doc_id and text in ``assign``; equal rows tie, and either may come first,
which gives the same rows whatever the partitioning. Empty input gives no rows. Other columns, whatever their names, are ignored by ``assign`` and kept in ``row`` by ``shard``. A text of any length is one row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axisweave.llm.common import signature, written

SHARDS, SEED = 16, 20_250
#: Rows of a partition, and the most partitions: they bound the matrix on the driver (16 counts each).
PART_ROWS, PARTS = 20_000, 65_536


def _drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric number. NumPy's own up to 10**9, beyond it by inversion outwards from the mode."""
    if not n or not good:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    choose = lambda a, b: lg(a + 1) - lg(b + 1) - lg(a - b + 1)
    up = down = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    left, a, b, u = up, mode, mode, rng.random()
    while u > left and (a > low or b < high):
        if b < high:
            up *= (good - b) / (b + 1) * (n - b) / (bad - n + b + 1)
            b += 1
            left += up
            if u <= left:
                return b
        if a > low:
            down *= a / (good - a + 1) * (bad - n + a) / (n - a + 1)
            a -= 1
            left += down
            if u <= left:
                return a
    return mode


def matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows from each partition to each shard: row sums are counts, column sums differ by one at most."""
    total, rng = sum(counts), np.random.default_rng(seed)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        open_ = sum(room)
        for s in range(shards):
            open_ -= room[s]
            out[p, s] = k = _drawn(rng, room[s], open_, n) if s < shards - 1 else n
            n -= k
            room[s] -= k
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """h becomes the hash of h and the row's number among those of equal h.

    rid (written, by monotonically_increasing_id) has the input task in its upper bits. Rows are numbered within a task and behind
    those of the tasks before, so a hot h is no group of its own; whatever the split, k equal rows have the numbers below k.
    """
    rows = rows.withColumn("task", F.shiftright("rid", 33))
    held = rows.groupBy("h", "task").count()
    before = held.select("h", "task", (F.sum("count").over(W.partitionBy("h").orderBy("task")) - F.col("count")).alias("before")).filter("before > 0")
    number = F.row_number().over(W.partitionBy("h", "task").orderBy("rid")) - 1 + F.coalesce("before", F.lit(0))
    return rows.join(before, ["h", "task"], "left").withColumn("h", F.xxhash64("h", number.cast("long"))).drop("task", "before")


def _dealt(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """Adds shard and slot to written rows that have long columns rid and h, their number and hash."""
    rows = written(_numbered(rows), "numbered")
    n = rows.count()
    parts = min(PARTS, max(1, math.ceil(n / PART_ROWS)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(parts)).cast("int"))
    counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # PARTS rows at most
    held = sorted(counts)
    ends = np.cumsum(matrix([counts[p] for p in held], shards, seed), axis=1)
    deal = rows.sparkSession.createDataFrame([(p, [int(x) for x in e]) for p, e in zip(held, ends)], "part int, ends array<long>")
    place = F.row_number().over(W.partitionBy("part").orderBy(F.xxhash64("h", F.lit(2)), "h")) - 1
    rows = rows.withColumn("place", place).join(F.broadcast(deal), "part")  # PARTS rows at most
    rows = rows.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))).cast("int")).drop("ends", "place", "part")
    # second permutation: bins of a shard by a new hash, each bin ordered by itself behind those before it
    bins = max(1, math.ceil(n / shards / PART_ROWS))
    rows = rows.withColumn("g", F.xxhash64("h", F.lit(3))).withColumn("bin", F.pmod("g", F.lit(bins)).cast("int"))
    within = W.partitionBy("shard", "bin")
    rows = rows.withColumn("slot", F.row_number().over(within.orderBy(F.xxhash64("g", F.lit(4)), "h")) - 1)
    sizes = rows.groupBy("shard", "bin").count()
    sizes = sizes.select("shard", "bin", (F.sum("count").over(W.partitionBy("shard").orderBy("bin")) - F.col("count")).alias("before"))
    return rows.join(sizes, ["shard", "bin"]).withColumn("slot", (F.col("slot") + F.col("before")).cast("long")).drop("bin", "g", "before")


def _rid():
    return F.monotonically_increasing_id().alias("rid")


def _hash(seed: int):
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard. The texts are not moved."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(_rid(), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), _hash(seed).alias("h"))
    out = _dealt(written(slim, "slim"), shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The documents themselves, all columns in ``row``, with shard and slot; the texts are written and cross the network once."""
    rows = written(docs.select(_rid(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), signature(docs, F.lit(seed)).alias("h")), "rows")
    dealt = _dealt(rows.select("rid", "h"), shards, seed).select("rid", "shard", "slot")
    return rows.select("rid", "row").join(dealt, "rid").drop("rid")


query = assign
