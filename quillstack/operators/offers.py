"""Offers on a hierarchy of tags from a catalogue of entries that tags are bound to, at any depth.

links (child, parent) of the catalogue and of the tags are taken through their closures, so that an offer says over
how many levels it holds. Of offers that want the same tag the nearest is kept, in rounds: an offer stands that
no tag of its has a better one for, what shares a tag with it goes, until nothing is left to say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import shared_folder
from .graph import closure


def entries_above(catalogue: DataFrame) -> DataFrame:
    """(entry, above, levels): every entry that is above another, over the least number of levels."""
    return closure(catalogue).select(F.col("node").alias("entry"), F.col("ancestor").alias("above"), F.col("depth").alias("levels"))


def links_offered(bound: DataFrame, above: DataFrame, tags_above: DataFrame) -> DataFrame:
    """(child, parent, levels): a tag under the nearest tags above it by their entries, unless it is under them already.

    bound (tag, entry): several tags may be bound to one entry; tags_above (node, ancestor). A tag bound to the same
    entry is no parent. Of entries above, only those of the fewest levels that have a tag are offered.
    """
    child = bound.select(F.col("tag").alias("child"), "entry").join(above, "entry")
    both = child.join(bound.select(F.col("tag").alias("parent"), F.col("entry").alias("above")), "above").where("child <> parent")
    both = both.groupBy("child", "parent").agg(F.min("levels").alias("levels"))
    nearest = both.groupBy("child").agg(F.min("levels").alias("levels"))
    known = tags_above.select(F.col("node").alias("child"), F.col("ancestor").alias("parent"))
    return both.join(nearest, ["child", "levels"]).join(known, ["child", "parent"], "left_anti").select("child", "parent", "levels")


def works_changed(offers: DataFrame, works: DataFrame) -> DataFrame:
    """offers (child, parent, ...) with changed: works of the child that do not have the parent. works (tag, work), distinct."""
    own = offers.select("child", "parent").join(works.withColumnRenamed("tag", "child"), "child")
    lacking = own.join(works.withColumnRenamed("tag", "parent"), ["parent", "work"], "left_anti")
    n = lacking.groupBy("child", "parent").agg(F.count("*").alias("changed"))
    return offers.join(n, ["child", "parent"], "left").withColumn("changed", F.coalesce("changed", F.lit(0)))


def new_parents(bound: DataFrame, above: DataFrame, refused: DataFrame) -> DataFrame:
    """(entry, tag, levels, tags): entries without a tag that stand above several tags, as new tags over them, nearest first.

    refused (entry): said to be too general; neither they nor what is above them are offered. An entry's levels are
    those of its furthest tag; a tag is in the offer of one entry only: of fewest levels, then of most tags,
    then of smallest name. Tags that an offer of theirs loses to another's tag stay free for a further one.
    """
    spark = bound.sparkSession
    root = f"{shared_folder(spark)}/offers-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    general = refused.select("entry").unionByName(above.join(refused, "entry").select(F.col("above").alias("entry"))).distinct()
    over = bound.join(above, "entry").select("tag", F.col("above").alias("entry"), "levels").groupBy("entry", "tag").agg(F.min("levels").alias("levels"))
    over = over.join(bound.select("entry").distinct(), "entry", "left_anti").join(general, "entry", "left_anti")
    left = written(over, "left-0")
    said: DataFrame | None = None
    turn = 0
    while True:
        turn += 1
        each = left.groupBy("entry").agg(F.max("levels").alias("levels"), F.count("*").alias("tags")).where("tags > 1")
        rank = F.struct("levels", (-F.col("tags")).alias("fewer"), "entry")
        asked = left.select("entry", "tag").join(each, "entry").withColumn("rank", rank)
        best = asked.groupBy("tag").agg(F.min("rank").alias("best"))
        wins = asked.join(best, "tag").groupBy("entry").agg(F.min((F.col("rank") == F.col("best")).cast("int")).alias("wins")).where("wins = 1").select("entry")
        now = written(asked.join(wins, "entry").select("entry", "tag", "levels", "tags"), f"said-{turn}")
        if now.isEmpty():
            return now if said is None else said
        said = now if said is None else said.unionByName(now)
        gone = left.join(now.select("tag").distinct(), "tag", "left_semi").select("entry").distinct()
        left = written(left.join(gone, "entry", "left_anti"), f"left-{turn}")
