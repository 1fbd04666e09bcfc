"""Shared scratch space: tables that cut lineage and survive the loss of an executor."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "file:///tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is set only where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(LOCAL_FALLBACK)
    return LOCAL_FALLBACK


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that none of those taken has, whatever its case."""
    low = {x.lower() for x in taken}
    out = []
    for x in wanted:
        name = f"__{x}"
        while name.lower() in low:
            name = f"_{name}"
        out.append(name)
    return out


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


class Scratch:
    """Tables written below one folder of the shared space; drop() removes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        workers_find_package(spark)
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """df, computed once and read back from Parquet."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_kept_at", None)
        if path is not None:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
