"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Every stage works on all that its predecessor kept and returns the columns of documents; the last adds shard and slot.

Edge cases. Columns of documents may be null, repeated rows are rows, ties go by doc_id and then by a hash of all columns, texts of any length
are whole, and no documents give no rows, as the operators' docstrings say of each stage. Further columns are carried along, whatever their names; if documents has a
column shard or slot, it stays and the new one is named shard_1 or slot_1 (the first free number).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisweave.functions.checkpoints import place
from axisweave.llm import decontaminate, mixing, ngram_join, quality, sharding
from axisweave.llm.common import table

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return ngram_join.deduplicate(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark window hits."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights."""
    return mixing.mix(docs)


def _free(name: str, taken: list[str]) -> str:
    """name, or name_1, name_2 and so on, whichever is the first that no column has (names differ by more than case)."""
    held = {c.lower() for c in taken}
    return next(x for x in (name, *(f"{name}_{k}" for k in range(1, len(held) + 2))) if x not in held)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return sharding.shard(docs).select(*own, *[F.col(c).alias(_free(c, docs.columns)) for c in ("shard", "slot")])


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", remove_leaks),
    ("mixing sources", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder (``checkpoints.sweep`` deletes it) and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = place(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
