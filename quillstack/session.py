"""Sessions with the settings that the queries are written for."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def session(name: str = "quillstack", **settings: str) -> SparkSession:
    """A session in UTC with adaptive plans; on a cluster its own settings stand."""
    builder = SparkSession.builder.appName(name)
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | settings
    for key, value in own.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is set only where none is named, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    own = sc._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or "file:///tmp/checkpoints")
        own = sc._jsc.sc().getCheckpointDir()
    return (named or own.get()).rstrip("/")


def shipped(spark: SparkSession) -> SparkSession:
    """spark, whose workers can import this package: it goes to them as a zip file, once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "quillstack_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join(os.path.basename(top), os.path.relpath(full, top)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return spark
