"""Isotonic fits by pooling adjacent violators, in ranges that meet until none is left."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import shared_folder, shipped

#: Blocks that a task pools at once.
BLOCKS_A_TASK = 50_000
_BLOCKS = "task long, place long, lo double, hi double, s double, w double"


def pool(lo: np.ndarray, hi: np.ndarray, s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks in order, each from lo to hi with its sum and weight, joined until their means rise."""
    out: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), s.tolist(), w.tolist(), strict=True):
        now = list(block)
        while out and out[-1][2] * now[3] >= now[2] * out[-1][3]:
            last = out.pop()
            now = [last[0], now[1], last[2] + now[2], last[3] + now[3]]
        out.append(now)
    return tuple(np.array(out, float).reshape(-1, 4).T)


def isotonic_blocks(df: DataFrame, x: str, y: str, weight: str, blocks_a_task: int = BLOCKS_A_TASK) -> DataFrame:
    """(lo, hi, fitted): the steps of the increasing function of x nearest to y by weighed squares.

    Rows of equal x are one point. Points are dealt into ranges of at most blocks_a_task, each pools its own,
    and what is left is dealt anew with the cuts moved by half a range, until no two neighbours violate the
    order; pooling gives the same steps in whatever order violators meet. Null x or y, and weights of 0: left out.
    """
    spark = shipped(df.sparkSession)
    root = f"{shared_folder(spark)}/pooled-{uuid.uuid4().hex}"
    fine = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(weight) > 0))
    points = fine.groupBy(F.col(x).cast("double").alias("lo")).agg(F.sum(F.col(y) * F.col(weight)).cast("double").alias("s"), F.sum(F.col(weight)).cast("double").alias("w"))

    def pooled(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("lo")
        lo, hi, s, w = pool(*(g[c].to_numpy() for c in ("lo", "hi", "s", "w")))
        return pd.DataFrame({"task": g.task.iloc[0] if len(g) else 0, "place": np.arange(len(lo)), "lo": lo, "hi": hi, "s": s, "w": w})

    def written(own: DataFrame, name: str) -> DataFrame:
        own.write.parquet(f"{root}/{name}")
        return spark.read.schema(own.schema).parquet(f"{root}/{name}")

    # ranges of the first round: places by counts of ranges that the engine cuts
    points = written(points, "points")
    n = points.count()
    ranges = points.repartitionByRange(max(1, -(-n // blocks_a_task)), "lo").withColumn("task", F.spark_partition_id().cast("long")).withColumn("hi", F.col("lo"))
    blocks = written(ranges.groupBy("task").applyInPandas(pooled, _BLOCKS), "round-0")
    turn = 0
    while True:
        # of each range its first and last step and how many it has
        ends = blocks.groupBy("task").agg(F.count("*").alias("n"), F.min_by(F.struct("s", "w"), "lo").alias("first"), F.max_by(F.struct("s", "w"), "lo").alias("last")).collect()
        ends.sort(key=lambda r: r.task)
        if all(a["last"].s * b["first"].w < b["first"].s * a["last"].w for a, b in zip(ends, ends[1:], strict=False)):
            return blocks.select("lo", "hi", (F.col("s") / F.col("w")).alias("fitted"))
        turn += 1
        starts, at = [], 0
        for r in ends:
            starts.append((r.task, at))
            at += r.n
        # one row a range, a fraction 1 / blocks_a_task of the points
        dealt = blocks.join(F.broadcast(spark.createDataFrame(starts, "task long, start long")), "task")
        moved = F.expr(f"(start + place + {(blocks_a_task // 2) * (turn % 2)}) div {blocks_a_task}")
        blocks = written(dealt.withColumn("task", moved).select("task", "lo", "hi", "s", "w").groupBy("task").applyInPandas(pooled, _BLOCKS), f"round-{turn}")


def isotonic(df: DataFrame, x: str, y: str, weight: str, blocks_a_task: int = BLOCKS_A_TASK) -> DataFrame:
    """(x, fitted) of every distinct x."""
    steps = isotonic_blocks(df, x, y, weight, blocks_a_task)
    told = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(weight) > 0)).select(F.col(x), F.lit(None).cast("double").alias("fitted"), F.col(x).cast("double").alias("k")).distinct()
    edges = steps.select(F.lit(None).cast(dict(df.dtypes)[x]).alias(x), "fitted", F.col("lo").alias("k"))
    return _filled(told.unionByName(edges), x)


def _filled(both: DataFrame, x: str) -> DataFrame:
    """Each x with the step that starts at or before it: in ranges, with the last step of each range handed on."""
    spark = both.sparkSession

    def fill(batches):  # noqa: ANN001, ANN202
        last = np.nan
        for b in batches:
            if len(b):
                b["fitted"] = b.fitted.astype(float).ffill().fillna(last)
                last = b.fitted.iloc[-1]
                yield b

    dealt = both.repartitionByRange("k").sortWithinPartitions("k", F.col("fitted").asc_nulls_last()).withColumn("task", F.spark_partition_id())
    root = f"{shared_folder(spark)}/filled-{uuid.uuid4().hex}"
    dealt.mapInPandas(fill, dealt.schema).write.parquet(root)
    own = spark.read.parquet(root)
    # a range may begin within a step that began before it, and hold no step's start at all
    known = F.when(~F.isnan("fitted"), F.col("fitted"))
    rows, last = [], None
    for task, fitted in sorted(((r.task, r.fitted) for r in own.groupBy("task").agg(F.max_by(known, "k").alias("fitted")).collect()), key=lambda r: r[0]):
        rows.append((task, last))
        last = last if fitted is None else fitted
    carried = spark.createDataFrame(rows, "task int, carried double")
    out = own.where(F.col(x).isNotNull()).join(F.broadcast(carried), "task", "left")
    return out.select(x, F.when(F.col("fitted").isNull() | F.isnan("fitted"), F.col("carried")).otherwise(F.col("fitted")).alias("fitted"))
