"""What a user said, laid over what sites gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def facet_overlay(site: Column, added: Column, removed: Column, single: bool = False) -> Column:
    """Site values and additions without removals; an addition replaces the value of a single-valued facet."""
    empty = F.array().cast("array<string>")
    site, added, removed = (F.coalesce(x, empty) for x in (site, added, removed))
    whole = F.array_except(F.array_distinct(F.concat(site, added)), removed)
    return F.when(F.size(added) > 0, added).otherwise(F.array_except(site, removed)) if single else whole


def number_override(site: Column, said: Column) -> Column:
    """A number said by the user, with a comma or a point, stands above the site's."""
    return F.coalesce(F.regexp_replace(said, ",", ".").try_cast("double"), site)


def text_override(site: Column, said: Column) -> Column:
    """A text said by the user stands; a blank one removes the site's."""
    return F.when(said.isNull(), site).when(F.trim(said) == "", None).otherwise(said)


def answers(corrections: DataFrame, key: str, value: str) -> DataFrame:
    """Added and removed values of each key, the newest word of each value standing."""
    newest = corrections.groupBy(key, value).agg(F.max_by("added", "said_at").alias("added"))
    return newest.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("added"), F.col(value)))).alias("added"), F.sort_array(F.collect_list(F.when(~F.col("added"), F.col(value)))).alias("removed"))


def drafts(site: DataFrame, bindings: DataFrame) -> DataFrame:
    """Values of items in a shared dictionary: site values through their bindings, only where one value is bound."""
    clear = bindings.groupBy("source", "value").agg(F.min("tag").alias("tag"), F.count_distinct("tag").alias("n")).where("n = 1").drop("n")
    return site.join(clear, ["source", "value"])
