"""Index writing after a quiet period: changes of a scope are gathered until it is still, then written at once.

The stream's state is one open session a scope, when it began and when it would end; a session whose end
the watermark has passed is told once and dropped from the state. What changed is not held in the stream: it
is read of the log by the session's dates, so that a stop loses nothing and a repeated batch writes the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder
from . import folds
from .changes import change_log


def quiet_scopes(events: DataFrame, scope: str, quiet: str, late: str = "0 seconds") -> DataFrame:
    """(scope, began, ended, n): runs of a scope's changes that a quiet period has ended, each told once."""
    own = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return own.groupBy(scope, F.session_window("at", quiet).alias("w")).agg(F.count("*").alias("n")).select(scope, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def documents_anew(log: DataFrame, told: DataFrame, scope: str, item: str) -> DataFrame:
    """Documents of the items that changed in the told sessions: changes so far and the newest value, as of the session's end."""
    own = log.withColumn("at", F.col("ts").cast("timestamp"))
    during = own.join(told.select(scope, "began", "ended"), scope).where((F.col("at") >= F.col("began")) & (F.col("at") < F.col("ended")))
    changed = during.groupBy(scope, item).agg(F.max("ended").alias("written"))
    upto = own.join(changed, [scope, item]).where(F.col("at") < F.col("written"))
    return upto.groupBy(scope, item, "written").agg(F.count("*").alias("changes"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


class QuietIndex:
    """An index below one folder of the shared space, kept in step with a log under a name.

    Each batch writes a folder of its own, again if it is run again; the document of the latest writing stands.
    A run folds the folders of earlier runs into one before it goes on, so that reads stay short.
    """

    def __init__(self, spark: SparkSession, name: str, scope: str = "user_id", item: str = "event_type", quiet: str = "1 second") -> None:
        self.spark, self.scope, self.item, self.quiet = spark, scope, item, quiet
        self.root = f"{shared_folder(spark)}/quiet-{name}"

    def _newest(self, rows: DataFrame) -> DataFrame:
        keys: Sequence[str] = [self.scope, self.item]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct("changes", "value", "written"), "written").alias("d"))
        return best.select(*keys, "d.changes", "d.value", "d.written")

    def documents(self) -> DataFrame:
        """The index as it stands: scope, item, changes, value, written."""
        rows = folds.read(self.spark, self.root)
        if rows is None:
            return self.spark.createDataFrame([], f"{self.scope} string, {self.item} string, changes long, value double, written timestamp")
        return self._newest(rows)

    def fold(self) -> None:
        """All batches and the fold before them as one; the older ones go once it is whole."""
        folds.fold(self.spark, self.root, self.documents)

    def catch_up(self, path: str) -> int:
        """Reads what is new in the log at path, writes what has become quiet, and returns how many sessions that were."""
        self.fold()
        told_now = []

        def write(told: DataFrame, batch: int) -> None:
            told = told.select("*").persist()
            n = told.count()
            if n:
                documents_anew(self.spark.read.parquet(f"{path}/events.parquet*"), told, self.scope, self.item).write.mode("overwrite").parquet(f"{self.root}/batches/{batch:09d}")
                told_now.append(n)
            told.unpersist()

        plan = quiet_scopes(change_log(self.spark, path), self.scope, self.quiet)
        stream = plan.writeStream.outputMode("append").option("checkpointLocation", f"{self.root}/log").foreachBatch(write).trigger(availableNow=True).start()
        try:
            stream.awaitTermination()
            if stream.exception() is not None:
                raise stream.exception()
        finally:
            stream.stop()
        return sum(told_now)

