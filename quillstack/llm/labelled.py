"""Bounded samples of labelled documents for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SAMPLE_DOCS = 12_000


def remainder(column: str, by: int) -> F.Column:
    """crc32 of the id as text, modulo `by`; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % by


def labelled_ids(labels: DataFrame, label: str, by: int, held_out: int, most: int = SAMPLE_DOCS) -> DataFrame:
    """(id, y) of at most `most` labelled rows outside the held-out remainder, chosen by hash of the id."""
    fine = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", by) != held_out))
    return fine.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y")).orderBy(F.md5(F.col("id").cast("string")), "id").limit(most)


def labelled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, y, text) of the sample. ids is bounded, and so is broadcast."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids), "id").select("id", "y", "text")
