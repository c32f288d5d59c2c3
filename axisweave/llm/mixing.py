"""Mixing sources to target weights by capped water-filling.

Sources above their largest number of epochs are clamped, their excess goes to
the others by weight until no source is above; then every source repeats all its
documents a whole number of times and a seeded random share of them once more.

Edge cases. A null text has size 0; a null source is one source, last in order;
a source without words gets target 0. Documents are ordered by a digest of seed,
doc_id and text, and ``mix`` orders those of one digest by a hash of all columns (maps by their JSON); equal rows tie and either may come first, which gives the same
rows whatever the partitioning. A null doc_id counts as an empty string there. Empty input gives no rows. Other columns of the input, whatever their names, are ignored by ``plan`` and kept by ``mix``. A text of any
length is one document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axisweave.llm.common import WORD, cut, n_words, signature

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
#: Hex digits of the digest that name a bucket: 4096 buckets a source.
DIGITS = 3
#: Sources up to this number are broadcast (under 100 bytes each); more are joined by a shuffle.
FEW = 100_000


def _digest(seed: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))


def _ranked(sources: DataFrame, n: int) -> DataFrame:
    """Numbers the sources from 0 by code point, null last, over range partitions of bounded size."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = cut(sources.repartitionByRange(max(1, math.ceil(n / FEW)), *order).withColumn("part", F.spark_partition_id()))
    before = parts.groupBy("part").count().withColumn("before", F.sum("count").over(W.orderBy("part")) - F.col("count"))
    rank = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("rank", rank).join(F.broadcast(before), "part").withColumn("rank", F.col("rank") + F.col("before")).drop("part", "count", "before")


def fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Adds target to (source, source_size, weight): water-filling with one small aggregate a round."""
    size, weight = F.col("source_size"), F.col("weight")
    total = sources.agg(F.sum(size)).first()[0] or 0
    level, clamped = None, -1
    while True:
        full = F.lit(False) if level is None else size * epochs < weight * level
        held, n_held, free = sources.agg(F.coalesce(F.sum(F.when(full, size)), F.lit(0)), F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(~full, weight)), F.lit(0))).first()
        if n_held == clamped or not free:
            break
        clamped, level = n_held, (share * total - epochs * held) / free
    target = size * epochs if level is None else F.least(size * epochs, weight * level)
    return sources.withColumn("target", target.cast("double"))


def _edges(base: DataFrame, weights, share: float, epochs: float) -> DataFrame:
    """Per source (of): source_size, target, whole repetitions, and the bucket (edge) of base in which the seeded order takes the last words (left_over)."""
    sizes = cut(base.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sources = sizes.groupBy("source").agg(F.sum("words").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    targets = fill(cut(_ranked(sources, sources.count()).withColumn("weight", weight)), share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    # the bucket in which the seeded order reaches the rest, from the buckets' sums alone
    up_to = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
    t, s = targets.alias("t"), sizes.withColumn("up_to", up_to).alias("s")
    edge = t.join(s, F.col("t.source").eqNullSafe(F.col("s.source")) & (F.col("t.rest") > F.col("s.up_to") - F.col("s.words")) & (F.col("t.rest") <= F.col("s.up_to")), "left")
    return cut(edge.select("t.*", F.coalesce("s.bucket", F.lit("")).alias("edge"), (F.col("t.rest") - F.coalesce(F.col("s.up_to") - F.col("s.words"), F.lit(0))).alias("left_over")).withColumnRenamed("source", "of"))


def _small(edges: DataFrame) -> DataFrame:
    """With the hint to broadcast where the sources are few and their names short; else Catalyst chooses."""
    n, size = edges.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("of")), F.lit(0))).first()
    return F.broadcast(edges) if n <= FEW and size <= 64 * FEW else edges


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target of its source, and the words taken of it.

    taken is the whole repetitions times size, plus size for the documents that come
    first in the seeded order of their source, plus a part of the one at which the
    target is reached (its leading words).
    """
    base = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _digest(seed).alias("digest")))
    base = base.withColumn("bucket", F.substring("digest", 1, DIGITS))
    joined = base.join(_small(_edges(base, weights, share, epochs)), F.col("source").eqNullSafe(F.col("of")))
    clear = joined.filter(F.col("bucket") != F.col("edge")).withColumn("extra", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0))
    before = F.sum("size").over(W.partitionBy("source").orderBy("digest", "doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    split = joined.filter(F.col("bucket") == F.col("edge")).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left_over") - before)))
    both = clear.unionByName(split)
    return both.select("doc_id", "source", "digest", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed corpus itself: each document as many times as the plan takes it, all its columns kept.

    The one document a source at which its target is reached comes whole if at least half of it is
    taken, else not once more. Documents without words stay once. Texts stay where they are, but for those of one bucket a source.
    """
    slim = cut(docs.select("source", n_words(F.col("text")).alias("size"), _digest(seed).alias("digest")))
    edges = _small(_edges(slim.withColumn("bucket", F.substring("digest", 1, DIGITS)), weights, share, epochs))
    has = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", _digest(seed).alias("digest"), signature(docs).alias("sig"), has.alias("has"))
    own = own.withColumn("bucket", F.substring("digest", 1, DIGITS)).join(edges, F.col("source").eqNullSafe(F.col("of")))
    clear = own.filter(F.col("bucket") != F.col("edge")).withColumn("times", F.col("whole") + (F.col("bucket") < F.col("edge")).cast("long"))
    # in the bucket of the edge the order is by digest, then by a hash of all columns
    split = own.filter(F.col("bucket") == F.col("edge")).withColumn("size", n_words(F.col("row.text")))
    before = F.sum("size").over(W.partitionBy("source").orderBy("digest", "sig").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    split = split.withColumn("times", F.col("whole") + (2 * (F.col("left_over") - before) >= F.col("size")).cast("long"))
    both = clear.select("row", "has", "times").unionByName(split.select("row", "has", "times"))
    copies = both.withColumn("times", F.when(F.col("has"), F.col("times")).otherwise(1)).filter("times > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
with base as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as digest
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, ([5, 2, 1])[(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight
  from base group by source),
ordered as (
  select *, coalesce(sum(source_size) over before, 0) as held, sum(weight) over rest as free, {SHARE} * sum(source_size) over () as budget
  from sources
  window before as (order by source_size / weight, source is null, source rows between unbounded preceding and 1 preceding),
         rest as (order by source_size / weight, source is null, source rows between current row and unbounded following)),
level as (
  select (budget - {EPOCHS} * held) / free as level from ordered
  where {EPOCHS} * source_size >= weight * ((budget - {EPOCHS} * held) / free) order by source_size / weight, source is null, source limit 1),
targets as (
  select source, source_size, least(source_size * {EPOCHS}, coalesce(weight * (select level from level), source_size * {EPOCHS}))::double as target from sources),
whole as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from targets),
taken as (
  select b.doc_id, b.size, w.source_size, w.target, w.whole, round(w.target - w.whole * w.source_size)::bigint as rest,
         sum(b.size) over (partition by b.source order by b.digest, b.doc_id rows between unbounded preceding and current row)::bigint - b.size as before
  from base b join whole w on b.source is not distinct from w.source)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::bigint as taken from taken
"""
