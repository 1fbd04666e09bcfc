"""Connected components of a link table, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Scratch


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) with the same components as the links (u, v)."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new[a] == new[b]).all() and (new[new] == new).all():
            label = new[label]
            break
        label = new[label]
    for _ in range(64):
        if (label[label] == label).all():
            break
        label = label[label]
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            u, v = forest(np.asarray(batch.column(0)), np.asarray(batch.column(1)))
            yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node in links(u, v), component being its smallest node.

    Each round costs two shuffles of the links; the number of rounds grows with the logarithm of
    the longest chain. A hub's links meet only in partial minima and in joins that can be split.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    edges = scratch.keep(links.mapInArrow(_local, "u long, v long").distinct(), "edges")

    def step(e: DataFrame, both: bool) -> DataFrame:
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        if both:
            out = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = near.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    while True:
        # stars already: every node hangs on one root, and no root hangs on another
        state = edges.groupBy("u").agg(F.count("*").alias("n"), F.lit(0).alias("r")).unionByName(edges.select(F.col("v").alias("u")).distinct().select("u", F.lit(0).cast("long").alias("n"), F.lit(1).alias("r")))
        bad = state.groupBy("u").agg(F.max("n").alias("n"), F.max("r").alias("r")).where("n > 1 or (n > 0 and r > 0)").limit(1).count()
        if not bad:
            break
        after = scratch.keep(step(step(edges, True), False), "edges")
        scratch.drop(edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
