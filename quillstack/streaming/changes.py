"""The change log as a stream: debounce, latest state, and changes told once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder
from . import folds


def change_log(spark: SparkSession, path: str) -> DataFrame:
    """Events as a file stream; the schema is that of the files there, read once from a footer."""
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{path}/events.parquet*")


def sessions(events: DataFrame, quiet: str) -> DataFrame:
    """Runs of a user's changes without a quiet period, batch or stream."""
    own = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        own = own.withWatermark("at", quiet)
    return own.groupBy("user_id", F.session_window("at", quiet).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("began"), "n")


def latest_state(events: DataFrame) -> DataFrame:
    """The newest change of each user, kept in the state store as partial maxima."""
    newest = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("s")
    return events.groupBy("user_id").agg(newest).select("user_id", F.col("s.event_type").alias("kind"), F.col("s.value").alias("value"))


def distinct_changes(events: DataFrame, late: str | None = None) -> DataFrame:
    """Changes of one kind, user and hour, told once: one row each, a key of the state and no set inside it.

    late: how far behind the newest change one may come; the state of older hours goes, and changes
    of them no longer count. Without it every hour is held for ever.
    """
    own = events.withColumn("at", F.col("ts").cast("timestamp"))
    if late is None:
        return own.groupBy("user_id", F.col("event_type").alias("kind"), F.date_trunc("hour", "at").alias("hour")).agg(F.count("*").alias("told"))
    hours = own.withWatermark("at", late).groupBy("user_id", F.col("event_type").alias("kind"), F.window("at", "1 hour").alias("w"))
    return hours.agg(F.count("*").alias("told")).select("user_id", "kind", F.col("w.start").alias("hour"), "told")


def run_on(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame], name: str, key: Sequence[str]) -> DataFrame:
    """What a streaming plan holds by key after all that is there now, as a table in the shared folder.

    Offsets, state and table lie under `name`, so that a later run of that name reads only what is
    new and goes on from where this one ended. Each batch's changed keys are appended with their
    batch's number, and the newest row of a key stands; a batch that is run again after a failure
    writes its own folder again. A run first folds the batches of those before it, so that what is
    read stays as large as the keys; a result is to be read before the next run of its name.
    """
    root = f"{shared_folder(spark)}/changes-{name}"

    def newest() -> DataFrame:
        rows = folds.read(spark, root)
        rest = [c for c in rows.columns if c not in key]
        best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
        return best.select(*key, *(F.col(f"row.{c}").alias(c) for c in rest))

    def kept(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{root}/batches/{batch:09d}")

    folds.fold(spark, root, newest)

    stream = plan(change_log(spark, path)).writeStream.outputMode("update").option("checkpointLocation", f"{root}/log").foreachBatch(kept).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
        if stream.exception() is not None:
            raise stream.exception()
    finally:
        stream.stop()
    return newest().drop("batch")


def run_once(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame], key: Sequence[str]) -> DataFrame:
    """run_on under a name of its own: everything that is there, read once."""
    return run_on(spark, path, plan, uuid.uuid4().hex, key)
