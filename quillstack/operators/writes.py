"""Keyed writes as new versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """Of each key the row of latest `at`; rows of the new table win ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in key]
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, "__new")).alias("__row"))
    return best.select(*key, *(F.col(f"__row.{c}").alias(c) for c in rest))


def insert_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of old, and of new those whose key old has not."""
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti"))


def merge_into(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Matched keys take the new values where they are given, the others of both sides stay."""
    rest = [c for c in old.columns if c not in key]
    right = new.select(*key, *(F.col(c).alias(f"__{c}") for c in rest))
    return old.join(right, list(key), "full_outer").select(*key, *(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in rest))


def replace_values(old: DataFrame, new: DataFrame, owner: Sequence[str]) -> DataFrame:
    """All values of an owner that the new table has are replaced by its values there."""
    return old.join(new.select(*owner).distinct(), list(owner), "left_anti").unionByName(new)


def set_or_delete(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """New values replace old ones; a null value deletes."""
    return replace_values(old, new, key).where(F.col(value).isNotNull())


def save_parts(old: DataFrame, new: DataFrame, key: Sequence[str], now: Column, whole: bool) -> DataFrame:
    """Parts upserted; if the new list is whole, parts that it lacks are marked as taken off."""
    rest = [c for c in new.columns if c not in key]
    right = new.select(*key, *(F.col(c).alias(f"__{c}") for c in rest), F.lit(1).alias("__has"))
    joined = old.join(right, list(key), "full_outer")
    gone = F.when(F.col("__has").isNull() & F.lit(whole), F.coalesce(F.col("taken_off_at"), now)).when(F.col("__has").isNull(), F.col("taken_off_at"))
    return joined.select(*key, *(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in rest), gone.alias("taken_off_at"))


def keep_only(table: DataFrame, present: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.join(present.select(*key), list(key), "left_semi")


def last_of_each(table: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The last n rows of each group."""
    return table.withColumn("__k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__k") <= n).drop("__k")


def changed_rows(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of new whose fingerprint differs from that of old, or whose key old has not."""
    rest = [c for c in new.columns if c not in key]
    prints = old.select(*key, F.xxhash64(*rest).alias("__print"))
    return new.join(prints, list(key), "left").where(~F.xxhash64(*rest).eqNullSafe(F.col("__print"))).drop("__print")
