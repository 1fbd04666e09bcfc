"""Tables in the shared folder that are replaced as a whole or by key, with a mark of what they hold."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder


class VersionedTable:
    """A table whose every write is a new folder; the newest commit mark names the folder that stands.

    A commit is the rename of one small file, so that readers see the old table or the new one. Old
    folders stay until `sweep`, for readers that are still at them.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/table-{name}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self) -> list[int]:
        at = self._path(f"{self.root}/commits")
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(at) if x.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def state(self) -> dict:
        """Version, folder and watermark of what stands; version 0 before the first commit."""
        marks = self._marks()
        if not marks:
            return {"version": 0, "folder": None, "watermark": None}
        line = self.spark.read.text(f"{self.root}/commits/{marks[-1]}").first()[0]
        return json.loads(line)

    def read(self) -> DataFrame:
        folder = self.state()["folder"]
        if folder is None:
            raise ValueError(f"{self.root} has no commit yet")
        return self.spark.read.parquet(folder)

    def rebuild(self, rows: DataFrame, watermark: str | None = None) -> int:
        """rows become the whole table. Of two writers of one version the later fails and may try again."""
        version, folder = self.state()["version"] + 1, f"{self.root}/rows-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        new = self._path(f"{self.root}/pending-{uuid.uuid4().hex}")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps({"version": version, "folder": folder, "watermark": watermark}).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        if self._fs.exists(self._path(f"{self.root}/commits/{version}")) or not self._fs.rename(new, self._path(f"{self.root}/commits/{version}")):
            raise RuntimeError(f"version {version} was written by another")
        return version

    def replace(self, rows: DataFrame, key: Sequence[str], watermark: str | None = None) -> int:
        """Rows of the keys given are replaced by those given, the others stay."""
        return self.rebuild(self.read().join(rows.select(*key).distinct(), list(key), "left_anti").unionByName(rows), watermark)

    def set_values(self, changes: DataFrame, key: Sequence[str], column: str) -> int:
        """One column takes new values where they are given, all else stays."""
        new = changes.select(*key, F.col(column).alias("__new"), F.lit(True).alias("__given"))
        own = self.read()
        out = own.join(new, list(key), "left").withColumn(column, F.when(F.col("__given"), F.col("__new")).otherwise(F.col(column)))
        return self.rebuild(out.select(*own.columns), self.state()["watermark"])

    def keep_only(self, present: DataFrame, key: Sequence[str]) -> int:
        return self.rebuild(self.read().join(present.select(*key), list(key), "left_semi"), self.state()["watermark"])

    def sweep(self) -> int:
        """Delete folders and marks of all but the version that stands; gives how many folders went."""
        stands, gone = self.state(), 0
        for x in self._fs.listStatus(self._path(self.root)):
            name = x.getPath().getName()
            if name.startswith(("rows-", "pending-")) and not (stands["folder"] or "").endswith(name):
                self._fs.delete(x.getPath(), True)
                gone += name.startswith("rows-")
        for version in self._marks()[:-1]:
            self._fs.delete(self._path(f"{self.root}/commits/{version}"), False)
        return gone
