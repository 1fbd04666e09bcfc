"""A logistic model with common weights and one bias a tag, by Newton steps on sums of each tag."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import shared_folder


@dataclass
class Mixed:
    """weights of the features; biases (tag, bias), a table; a tag without rows has bias 0."""

    weights: np.ndarray
    biases: DataFrame

    def chance(self, rows: DataFrame, features: list[str], out: str = "chance") -> DataFrame:
        """rows (tag and features) with the chance that the tag is theirs."""
        z = F.coalesce("bias", F.lit(0.0))
        for c, w in zip(features, self.weights, strict=True):
            z = z + F.col(c) * float(w)
        return rows.join(self.biases, "tag", "left").withColumn(out, 1 / (1 + F.exp(-z))).drop("bias")


def fit(rows: DataFrame, features: list[str], y: str, spread: float = 2.0, penalty: float = 1e-3, steps: int = 25, close: float = 1e-7) -> Mixed:
    """rows: tag, features, y (0 or 1). Biases are drawn to 0 as by a normal of this spread, weights by the penalty.

    A step adds up slopes and curvatures a tag, in partial sums, so that a tag of most rows is as cheap as
    another. The biases are taken out of the step for the weights by what each tag's sums say, which are added up
    in turn: the driver solves for the weights only, and the biases stay in a table. Rows with a null are left out.
    """
    spark = rows.sparkSession
    root = f"{shared_folder(spark)}/mixed-{uuid.uuid4().hex}"
    n = len(features)
    fine = rows.select("tag", *(F.col(c).cast("double").alias(c) for c in features), F.col(y).cast("double").alias("__y")).dropna()

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    fine = written(fine, "rows")
    biases = written(fine.groupBy("tag").agg(F.lit(0.0).alias("bias")), "biases-0")
    weights = np.zeros(n)
    for turn in range(1, steps + 1):
        z = F.col("bias")
        for c, w in zip(features, weights, strict=True):
            z = z + F.col(c) * float(w)
        p = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))))
        own = fine.join(biases, "tag").withColumn("__p", p).withColumn("__v", F.col("__p") * (1 - F.col("__p"))).withColumn("__d", F.col("__p") - F.col("__y"))
        each: list[Column] = [(F.sum("__d") + F.first("bias") / spread**2).alias("g"), (F.sum("__v") + 1 / spread**2).alias("h"), F.first("bias").alias("bias")]
        each += [F.sum(F.col("__v") * F.col(c)).alias(f"c{k}") for k, c in enumerate(features)] + [F.sum(F.col("__d") * F.col(c)).alias(f"d{k}") for k, c in enumerate(features)]
        each += [F.sum(F.col("__v") * F.col(a) * F.col(b)).alias(f"m{j}_{k}") for j, a in enumerate(features) for k, b in enumerate(features) if j <= k]
        sums = written(own.groupBy("tag").agg(*each), f"sums-{turn}")
        slope = [F.sum(F.col(f"d{k}") - F.col(f"c{k}") * F.col("g") / F.col("h")) for k in range(n)]
        curve = [F.sum(F.col(f"m{j}_{k}") - F.col(f"c{j}") * F.col(f"c{k}") / F.col("h")) for j in range(n) for k in range(j, n)]
        got = np.array([x or 0.0 for x in sums.agg(*slope, *curve).first()], float)
        s = np.zeros((n, n))
        s[np.triu_indices(n)] = got[n:]
        s = s + np.triu(s, 1).T + penalty * np.eye(n)
        step = np.linalg.solve(s, got[:n] + penalty * weights)
        weights = weights - step
        move = F.col("g")
        for k in range(n):
            move = move - F.col(f"c{k}") * float(step[k])
        biases = sums.select("tag", (F.col("bias") - move / F.col("h")).alias("bias"))
        if np.abs(step).max() < close:
            break
    return Mixed(weights, biases)
