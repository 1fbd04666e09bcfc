"""From raw documents to packed training sequences, in five stages.

Each stage reads what the one before it kept and returns the columns of documents; the last returns
pieces of packed sequences. run() writes every stage's result to the shared folder and reads it back,
so that a lost executor costs the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstack.llm import lines, minhash, packing, suffix, toxicity
from quillstack.llm.store import Scratch

#: Columns of documents that stages read or rewrite.
OWN = ("doc_id", "text", "n_chars")


def beside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage over doc_id, text and n_chars; other columns, whatever their names, come through as they were."""
    own = [c for c in docs.columns if c.lower() in OWN]
    others = [c for c in docs.columns if c.lower() not in OWN]
    packed = docs.select(*own, F.struct(F.lit(0).alias("beside"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others))).alias("other_columns"))
    out = stage(packed)
    return out.select(*(F.col(c) if c in own else F.col(f"other_columns.c{others.index(c)}").alias(c) for c in docs.columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field does not reject, fitted on labels outside the held-out third.

    Null or empty text: kept. Rows of equal or null doc_id: judged each on its own. No labels: all are
    kept. Empty table: no rows. Other columns, also those named like a score, come through.
    """
    field = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return beside(docs, lambda own: toxicity.score(own, field).where("predicted = 0"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share, but for the last that holds each.

    Null text comes back empty. Rows of equal doc_id are one document, null ids one below all others.
    Empty table: no rows. n_chars is counted anew, other columns come through.
    """
    return beside(docs, lines.drop_repeated_lines)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of smallest doc_id.

    Null texts and null ids stay; texts without words are copies of equal texts only. Of rows of equal
    doc_id one stays (see keep_one). Empty table: no rows. Other columns come through.
    """
    return beside(docs, minhash.keep_one)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeated passages cover.

    Null text comes back empty; each row is a text of its own, whatever its doc_id. Empty table: no
    rows. n_chars is counted anew, other columns come through.
    """
    return beside(docs, suffix.drop_repeated_passages)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens.

    Null or empty text: its closing id alone. Rows of equal or null doc_id: packed each on its own.
    Empty table: no rows. Other columns are not read.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_shared_lines),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: The field's marginals, signatures and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
