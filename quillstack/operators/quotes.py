"""Quotes around names: the paragraphs of texts that name something, cut around names that stand near one another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed value: characters quoted on each side of names in a long paragraph
AROUND = 160
WHOLE, APART = 3 * AROUND, 2 * AROUND


def named_paragraphs(texts: DataFrame, key: str, text: str, names: Sequence[str]) -> DataFrame:
    """(key, paragraph, body, name, first, last): every place of a name, in whatever case, by places of its paragraph from 0.

    A paragraph is a line, counted from 1; names are taken as they are, without word edges. Places come from
    what stands between a name's occurrences, so that a paragraph is read once a name.
    """
    line = texts.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n")).alias("at", "body")).where("body <> ''")
    line = line.select("key", (F.col("at") + 1).cast("long").alias("paragraph"), "body")
    upto = Window.partitionBy("key", "paragraph", "name").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    out = None
    for name in names:
        pieces = line.withColumn("pieces", F.split("body", f"(?i)\\Q{name}\\E", -1)).where(F.size("pieces") > 1)
        each = pieces.select("key", "paragraph", "body", F.lit(name).alias("name"), F.posexplode(F.slice("pieces", F.lit(1), F.size("pieces") - 1)).alias("k", "piece"))
        first = (F.sum(F.length("piece")).over(upto) + F.col("k") * len(name)).cast("int")
        own = each.select("key", "paragraph", "body", "name", first.alias("first"), (first + len(name) - 1).alias("last"))
        out = own if out is None else out.unionByName(own)
    return out


def _cut(body: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """Where an excerpt around first..last begins and ends: at spaces, if there are any before the names are reached."""
    start = F.greatest(first - AROUND, F.lit(0))
    space = F.locate(" ", F.substr(body, start + 1)) + start - 1
    start = F.when((start > 0) & (space >= start) & (space < first), space + 1).otherwise(start)
    end = F.least(last + 1 + AROUND, F.length(body))
    back = end - F.locate(" ", F.reverse(F.substr(body, F.lit(1), end + 1))) + 1
    end = F.when((end < F.length(body)) & (back <= end) & (back > last), back).otherwise(end)
    return start, end


def quotes(places: DataFrame) -> DataFrame:
    """(key, paragraph, quote, highlights): passages that hold names, each name as its first and last place in the quote.

    A short paragraph is quoted whole. In a long one a name within APART of the one before is of its group,
    and each group has a passage, marked where it is cut.
    """
    w = Window.partitionBy("key", "paragraph").orderBy("first", "last", "name")
    long_ = F.length("body") > WHOLE
    gap = F.coalesce((F.col("first") - F.lag("last").over(w) > APART) & long_, F.lit(False))
    islands = places.withColumn("opens", gap.cast("int")).withColumn("island", F.sum("opens").over(w))
    group = islands.groupBy("key", "paragraph", "island").agg(F.first("body").alias("body"), F.min("first").alias("a"), F.max_by("last", F.struct("first", "last", "name")).alias("b"), F.sort_array(F.collect_list(F.struct("first", "last", "name"))).alias("names"))
    start, end = _cut(F.col("body"), F.col("a"), F.col("b"))
    group = group.withColumn("start", F.when(long_, start).otherwise(0)).withColumn("end", F.when(long_, end).otherwise(F.length("body")))
    before, after = F.when(F.col("start") > 0, "… ").otherwise(""), F.when(F.col("end") < F.length("body"), " …").otherwise("")
    quote = F.concat(before, F.substr("body", F.col("start") + 1, F.col("end") - F.col("start")), after)
    shift = F.length(before) - F.col("start")
    marks = F.transform("names", lambda n: F.concat_ws("-", (n["first"] + shift).cast("string"), (n["last"] + shift).cast("string")))
    return group.select("key", "paragraph", quote.alias("quote"), F.array_join(marks, " ").alias("highlights"))
