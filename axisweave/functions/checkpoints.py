"""Cutting lineage in the folder that the cluster shares.

``cut`` checkpoints a frame, ``written`` writes it as a compressed table and reads it again. Both run at once,
so what they return does not depend on how often, where or when it is read. ``sweep`` deletes the tables that
``written`` made; results that still read them must have been used by then.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master without one gets a temporary folder; a cluster must name a shared one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="axisweave-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints df in the folder of spark.checkpoint.dir."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which sweep deletes."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Deletes the tables of this application."""
    sc = spark.sparkContext
    for path in _made.pop(sc.applicationId, []):
        there = sc._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(sc._jsc.hadoopConfiguration()).delete(there, True)
