"""Folders that batches of a stream wrote, and folding them into one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def whole(spark: SparkSession, at: str) -> list[str]:
    """Folders right below a place that were written to the end, in order of their names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(f"{at}/{s.getPath().getName()}" for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def fold(spark: SparkSession, root: str, standing: Callable[[], DataFrame], least: int = 2) -> None:
    """Where at least so many batches lie under root/batches, what stands of them and of the last fold becomes the new fold.

    Batches and older folds go once it is whole. A run that breaks off leaves a fold that is not whole, which
    the next one writes over, or folders that the fold holds already, which change nothing of what stands.
    """
    batches, old = whole(spark, f"{root}/batches"), whole(spark, f"{root}/folded")
    if len(batches) < least:
        return
    number = int(old[-1].rsplit("/", 1)[1]) + 1 if old else 0
    standing().write.mode("overwrite").parquet(f"{root}/folded/{number:09d}")
    _remove(spark, [*batches, *old])


def _remove(spark: SparkSession, folders: Sequence[str]) -> None:
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, root: str) -> DataFrame | None:
    """Rows of the last fold and of all batches after it; None where nothing was written."""
    folders = [*whole(spark, f"{root}/folded")[-1:], *whole(spark, f"{root}/batches")]
    return spark.read.parquet(*folders) if folders else None
