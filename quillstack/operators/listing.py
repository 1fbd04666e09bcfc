"""Filtered, ordered, collapsed and paged lists of items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def facet_passes(values: Column, shown: Sequence[str] = (), hidden: Sequence[str] = (), within: Sequence[str] | None = None, without_hidden: bool = False) -> Column:
    """Whether an item of these values passes a choice.

    Without values it passes unless those without are hidden; in a range if one value is in it; among
    shown values if one is shown; else if one is not hidden.
    """
    some = lambda xs: F.arrays_overlap(values, F.array(*map(F.lit, xs))) if xs else F.lit(False)
    left = F.size(F.array_except(values, F.array(*map(F.lit, hidden)))) > 0 if hidden else F.lit(True)
    rule = some(within) if within is not None else some(shown) if shown else left
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.lit(not without_hidden)).otherwise(rule)


def only_of(having: Sequence[str], passes: Column, source: str = "source") -> Column:
    """A filter on a field that some sources lack lets their rows pass."""
    return passes | ~F.col(source).isin(*having)


def three_state(has: Column, choice: str) -> Column:
    """`only`: rows that have it, `without`: rows that have it not, anything else: all."""
    return has if choice == "only" else ~has if choice == "without" else F.lit(True)


def between(scale: Sequence[str], low: str | None, high: str | None) -> list[str]:
    """Steps of an ordered scale from low to high; an inverted range is empty."""
    a = scale.index(low) if low in scale else 0
    b = scale.index(high) if high in scale else len(scale) - 1
    return list(scale[a : b + 1])


def parse_range(text: str) -> tuple[str, float | None, float | None] | None:
    """`id=from..to`; a blank end is open, what isn't a number makes no range."""
    name, eq, rest = text.partition("=")
    low, dots, high = rest.partition("..")
    try:
        ends = [float(x.replace(",", ".")) if x.strip() else None for x in (low, high)]
    except ValueError:
        return None
    return (name.strip(), ends[0], ends[1]) if eq and dots else None


def number_within(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """A closed range, either end of which may be open; a missing value is outside."""
    return value.isNotNull() & (value >= low if low is not None else F.lit(True)) & (value <= high if high is not None else F.lit(True))


def selection(values: Column, groups: Sequence[Sequence[str]]) -> Column:
    """One value of each group, at least."""
    out = F.lit(True)
    for g in groups:
        out = out & F.arrays_overlap(values, F.array(*map(F.lit, g)))
    return out


def kept_digits(x: Column, digits: int = 3) -> Column:
    """x at so many significant digits."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * power) / power)


def expected(score: Column, chance: Column) -> Column:
    """Score that counts only as far as the item is of interest."""
    return F.when(chance.isNull(), score).otherwise(F.greatest(score, F.lit(0.0)) * chance)


def interest(mark: Column, chance: Column) -> Column:
    """A mark of the user stands above the model's chance."""
    return F.coalesce(mark.cast("double"), chance)


def surprise(grade: Column, place: Column, score: Column, lowest: int = 1, highest: int = 5) -> Column:
    """How far a score lies from the place of the item's grade; one-sided at the outermost grades."""
    return F.when(grade.isNull(), None).when(grade == lowest, F.greatest(score - place, F.lit(0.0))).when(grade == highest, F.greatest(place - score, F.lit(0.0))).otherwise(F.abs(score - place))


def collapse(df: DataFrame, work: str, *rank: Column) -> DataFrame:
    """The item of least rank stands for its work."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(work).orderBy(*rank))).where("__place = 1").drop("__place")


ORDERS = {
    "score": lambda: [F.desc_nulls_last("expected")],
    "interest": lambda: [F.desc_nulls_last("chance")],
    "grade": lambda: [F.desc_nulls_last("grade")],
    "updated": lambda: [F.desc_nulls_last("rated_at")],
    "number": lambda: [F.desc_nulls_last("size")],
    "surprise": lambda: [F.desc_nulls_last("surprise")],
}


def ordered(kind: str, key: str = "item_id") -> list[Column]:
    """Missing values come last, the newest first among equals, then the key."""
    return [*ORDERS[kind](), F.desc_nulls_last("rated_at"), F.asc(key)]


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset..offset+limit in order, each with the total before paging.

    The total is a separate aggregate, so that the page itself stays a bounded top-n of each task.
    """
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def after_cursor(df: DataFrame, value: str, key: str, at: tuple[float, int], limit: int) -> DataFrame:
    """Rows strictly behind a cursor in (value descending, key ascending)."""
    v, k = at
    return df.where((F.col(value) < v) | ((F.col(value) == v) & (F.col(key) > k))).orderBy(F.desc(value), F.asc(key)).limit(limit)


def facet_counts(df: DataFrame, values: str) -> DataFrame:
    """Items of each value, of none (value null) and in all (value '*')."""
    flat = df.select(F.explode_outer(F.array_distinct(values)).alias("value"))
    return flat.groupBy("value").agg(F.count("*").alias("n")).unionByName(df.agg(F.lit("*").alias("value"), F.count("*").alias("n")))
