"""Scalar, vector and statistic expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_folder


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def weighed(vector: str, weights: Sequence[float]) -> Column:
    """Sum of a vector's components by these weights."""
    return dot(F.col(vector), F.array(*(F.lit(float(w)) for w in weights)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    # the norm as an element, so that it is worked out once and not for each component
    scaled = lambda n: F.transform(a, lambda x: F.when(n <= 1e-9, x.cast("double")).otherwise(x.cast("double") / n))
    return F.element_at(F.transform(F.array(norm(a)), scaled), 1)


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def centred(a: Column, centre: Column, spread: Column) -> Column:
    """(v - centre)·√dim / spread."""
    return F.zip_with(a, centre, lambda x, c: (x - c) * F.sqrt(F.size(a).cast("double")) / spread)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logit(p: Column, least: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return F.ln(q / (1 - q))


def log_scale(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def strength(share_below: Column, n: Column, cap: float = 20.0) -> Column:
    """-ln(1 - F^n): how surprising the best of n is."""
    return F.least(F.when(share_below >= 1, F.lit(cap)).when(share_below <= 0, F.lit(0.0)).otherwise(-F.ln(-F.expm1(n * F.ln(share_below)))), F.lit(cap))


def doubt(p: Column, boundary: Column) -> Column:
    return F.lit(1.0) / (1 + F.abs(logit(p) - boundary))


def size_ratio(a: Column, b: Column) -> Column:
    """Smaller over larger; null where either is unknown."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b))


def mean_of_known(*xs: Column) -> Column:
    return F.aggregate(F.filter(F.array(*xs), lambda x: x.isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))


def dealt_by_range(df: DataFrame, *order: Column) -> DataFrame:
    """df with __part, which rises with the order: rows of one part are near in it, equal ones in one part.

    Written once, as the bounds of the ranges come from a sample.
    """
    shared_folder(df.sparkSession)
    return df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint()


def running(df: DataFrame, by: Sequence[str], order: Column, value: Column, before: str) -> DataFrame:
    """df with `before`: the sum of value over rows of lower order among those of equal `by`.

    No window holds more than one part of the range: sums of whole parts before come from one row a part.
    """
    own = dealt_by_range(df.withColumn("__value", value), order)
    parts = own.groupBy(*by, "__part").agg(F.sum("__value").alias("__all"))
    lower = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "__part", F.coalesce(F.sum("__all").over(lower), F.lit(0)).alias("__lower"))
    upto = Window.partitionBy(*by, "__part").orderBy(order)
    inside = own.withColumn("__upto", F.sum("__value").over(upto.rangeBetween(Window.unboundedPreceding, 0)) - F.sum("__value").over(Window.partitionBy(*by, "__part", order)))
    return inside.join(parts, [*by, "__part"]).withColumn(before, F.col("__lower") + F.col("__upto")).drop("__part", "__value", "__upto", "__lower")


def numbered(df: DataFrame, *order: Column, out: str = "place") -> DataFrame:
    """df with each row's place in the order, from 1, without a window over all rows."""
    own = dealt_by_range(df, *order)
    parts = own.groupBy("__part").agg(F.count("*").alias("__n"))
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = own.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return placed.join(parts, "__part").withColumn(out, F.col("__k") + F.col("__before")).drop("__part", "__k", "__before")


def quantiles(df: DataFrame, by: Sequence[str], value: Column, shares: Sequence[float], bins_a_unit: int = 1000) -> DataFrame:
    """by, and q0, q1, ...: exact quantiles by linear interpolation at share * (n - 1).

    Values are counted by bin first; only bins that hold a wanted place are looked into, so that no
    task holds a group's values.
    """
    own = df.select(*by, value.cast("double").alias("__x")).where("__x is not null").withColumn("__bin", F.floor(F.col("__x") * bins_a_unit))
    bins = own.groupBy(*by, "__bin").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    bins = bins.withColumns({"__all": F.sum("__n").over(w), "__before": F.sum("__n").over(w.orderBy("__bin")) - F.col("__n")})
    places = F.array(*(F.struct(F.lit(k).alias("k"), (F.floor(F.lit(q) * (F.col("__all") - 1)) + side).alias("at"), (F.lit(q) * (F.col("__all") - 1) - F.floor(F.lit(q) * (F.col("__all") - 1))).alias("rest"), F.lit(side).alias("side")) for k, q in enumerate(shares) for side in (0, 1)))
    asked = bins.withColumn("__p", F.explode(places)).where((F.col("__p.at") >= F.col("__before")) & (F.col("__p.at") < F.col("__before") + F.col("__n")))
    held = own.join(asked.select(*by, "__bin", "__before").distinct(), [*by, "__bin"])
    ranked = held.withColumn("__at", F.row_number().over(Window.partitionBy(*by, "__bin").orderBy("__x")) - 1 + F.col("__before"))
    found = ranked.join(asked.select(*by, "__bin", F.col("__p.k").alias("__k"), F.col("__p.at").alias("__at"), F.col("__p.rest").alias("__rest"), F.col("__p.side").alias("__side")), [*by, "__bin", "__at"])
    # the upper place lacks where the lower one is the last
    low, high = F.max(F.when(F.col("__side") == 0, F.col("__x"))), F.max(F.when(F.col("__side") == 1, F.col("__x")))
    each = found.groupBy(*by, "__k").agg((low + F.max("__rest") * (F.coalesce(high, low) - low)).alias("__q"))
    return each.groupBy(*by).agg(*(F.max(F.when(F.col("__k") == k, F.col("__q"))).alias(f"q{k}") for k in range(len(shares))))


def average_ranks(df: DataFrame, column: str, out: str, *by: str) -> DataFrame:
    """Mean rank of ties, from counts of equal values."""
    n = df.groupBy(*by, column).agg(F.count("*").alias("__n"))
    ranked = running(n, list(by), F.col(column), F.col("__n"), "__b").withColumn(out, F.col("__b") + (F.col("__n") + 1) / 2).drop("__n", "__b")
    return df.join(ranked, [*by, column])


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    own = average_ranks(average_ranks(df.select(a, b), a, "__ra"), b, "__rb")
    return own.agg(F.corr("__ra", "__rb").alias("spearman"))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the curve by the sum of ranks of the positive."""
    own = average_ranks(df.select(score, positive), score, "__r")
    n1, n0 = F.count_if(F.col(positive)), F.count_if(~F.col(positive))
    return own.agg(((F.sum(F.when(F.col(positive), F.col("__r"))) - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def _ordered_pairs(df: DataFrame, by: Sequence[str], highest: int) -> DataFrame:
    """by, right, pairs: pairs of rows of different grades, and how many stand in the order of the grades; ties count half.

    For each grade h the scores of rows of higher grade are counted against those of grade h that lie
    below, by running sums over distinct scores: no pair is made. A grade outside 1 to highest is an error.
    """
    wrong = F.raise_error(F.concat(F.lit(f"grades are 1 to {highest}, not "), F.col("grade").cast("string")))
    df = df.withColumn("grade", F.when(F.col("grade").isNull() | F.col("grade").between(1, highest), F.col("grade")).otherwise(wrong.cast("int")))
    levels = F.explode(F.sequence(F.lit(1), F.least(F.col("grade"), F.lit(highest - 1)))).alias("level")
    rows = df.groupBy(*by, "grade", "score").agg(F.count("*").alias("n")).select(*by, "grade", "score", "n", levels)
    above = F.sum(F.when(F.col("grade") > F.col("level"), F.col("n")).otherwise(0))
    here = F.sum(F.when(F.col("grade") == F.col("level"), F.col("n")).otherwise(0))
    own = running(rows.groupBy(*by, "level", "score").agg(above.alias("above"), here.alias("here")), [*by, "level"], F.col("score"), F.col("here"), "below")
    each = own.groupBy(*by, "level").agg(F.sum(F.col("above") * (F.col("below") + F.col("here") / 2)).alias("right"), (F.sum("above") * F.sum("here")).alias("pairs"))
    return each.groupBy(*by).agg(F.sum("right").alias("right"), F.sum("pairs").alias("pairs"))


def concordance(df: DataFrame, *by: str, highest: int = 5) -> DataFrame:
    """Share of pairs of different works and grades whose scores stand in the order of the grades; ties count half.

    df: work, grade (1 to highest), score. Pairs of all rows, less those inside a work.
    """
    own = df.where("grade is not null and score is not null")
    if not by:
        own, by = own.withColumn("__everything", F.lit(1)), ("__everything",)
    every = _ordered_pairs(own, by, highest)
    inside = _ordered_pairs(own, [*by, "work"], highest).groupBy(*by).agg(F.sum("right").alias("r"), F.sum("pairs").alias("p"))
    both = every.join(inside, list(by), "left").na.fill({"r": 0.0, "p": 0})
    return both.select(*by, ((F.col("right") - F.col("r")) / (F.col("pairs") - F.col("p"))).alias("concordance")).where("concordance is not null").drop("__everything")


def balanced_cutoff(df: DataFrame, p: str, bins: int = 10_000) -> DataFrame:
    """The highest chance at which what is wrongly shown outweighs what is wrongly hidden, over bins."""
    own = df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.min(p).alias("least"))
    down = Window.orderBy(F.desc("bin"))
    total = own.agg(F.sum("s").alias("all"))
    run = own.withColumns({"shown": F.sum(F.col("n") - F.col("s")).over(down), "had": F.sum("s").over(down)}).crossJoin(F.broadcast(total))
    return run.where(F.col("shown") >= F.col("all") - F.col("had")).agg(F.max("least").alias("cutoff"))


def between_variance(df: DataFrame, estimate: str, variance: str) -> DataFrame:
    """DerSimonian and Laird's variance between estimates."""
    w = 1 / F.col(variance)
    s = df.agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * F.col(estimate)).alias("we"), F.sum(w * F.col(estimate) * F.col(estimate)).alias("we2"), F.count("*").alias("n"))
    q = F.col("we2") - F.col("we") * F.col("we") / F.col("w")
    return s.select(F.greatest((q - (F.col("n") - 1)) / (F.col("w") - F.col("w2") / F.col("w")), F.lit(0.0)).alias("tau2"))
