"""A graph of nearest neighbours by descent: neighbours of neighbours are likely neighbours.

Each round looks at every node's newest and older neighbours, and at the nodes it is a neighbour of, in
samples of a fixed size, scores those that met there for the first time, and keeps the best of each
node. Rows of the graph lie in the shared folder between rounds; a node that many others are near
takes part with a sample of them, so that no node's list grows with the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shared_folder

#: Neighbours a node keeps, new and old ones of each direction that a round looks at, and rows that one window of seeds may hold.
KEPT, SAMPLED, BLOCK_ROWS = 16, 8, 4096


@dataclass
class Graph:
    """edges (key, other, score), and of each round the share of edges that it changed."""

    edges: DataFrame
    changed: list[float] = field(default_factory=list)


def _written(df: DataFrame, root: str, name: str) -> DataFrame:
    path = f"{root}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near_in_order(rows: DataFrame, key: str, block: Column, order: Sequence[Column], reach: int = 4, most: int = BLOCK_ROWS) -> DataFrame:
    """(key, other): each row and the `reach` after it in an order within its block.

    A block of more than `most` rows is dealt into parts by hash of the key, each in the same order, so
    that its rows have neighbours that are near without a window over all of them; it is dealt twice, by two
    hashes, as nothing would lead from one part to another. Rows of a null block are left out.
    """
    own = rows.select(F.col(key).alias("key"), block.alias("block"), *(o.alias(f"o{k}") for k, o in enumerate(order))).where("block is not null")
    parts = own.groupBy("block").agg(F.ceil(F.count("*") / most).alias("parts"))
    turns = F.when(F.col("parts") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = own.join(parts, "block").withColumn("turn", F.explode(turns)).withColumn("part", F.pmod(F.xxhash64("key", "turn"), "parts"))
    w = Window.partitionBy("block", "turn", "part").orderBy(*(f"o{k}" for k in range(len(order))), "key")
    others = F.array(*(F.lead("key", k).over(w) for k in range(1, reach + 1)))
    return dealt.select("key", others.alias("others")).select("key", F.explode(F.filter("others", lambda x: x.isNotNull())).alias("other"))


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges of each key; of equal scores the smaller other."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "other"))
    return edges.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _with_turns(edges: DataFrame, sampled: int, turn: int) -> DataFrame:
    """edges, each marked as taken in the next round if it is one of `sampled` new or old ones of its key, by hash."""
    w = Window.partitionBy("key", "fresh").orderBy(F.xxhash64("key", "other", F.lit(turn)), "other")
    return edges.withColumn("taken", F.row_number().over(w) <= sampled)


def descend(rows: DataFrame, key: str, score: Callable[[Column, Column], Column], seeds: DataFrame, k: int = KEPT, sampled: int = SAMPLED, rounds: int = 20, least_changed: float = 0.001) -> Graph:
    """The graph that `score` leads to from the seeds.

    rows: the key, distinct and not null, and what score reads of two rows (structs of the other
    columns); a null score says that the two may not be neighbours. seeds (key, other): pairs to start
    from, in any order. Stops once a round changes a smaller share of all edges than least_changed.
    Rows without a seed stay without neighbours; an empty table has no edges.
    """
    spark = rows.sparkSession
    root = f"{shared_folder(spark)}/neighbours-{uuid.uuid4().hex}"
    nodes = _written(rows.select(F.col(key).alias("key"), F.struct(*(c for c in rows.columns if c != key)).alias("f")), root, "nodes")
    side = nodes.select(F.col("key").alias("other"), F.col("f").alias("g"))
    pairs = seeds.select("key", "other").where("key <> other")
    pairs = pairs.unionByName(pairs.select(F.col("other").alias("key"), F.col("key").alias("other"))).distinct()
    first = pairs.join(nodes, "key").join(side, "other").select("key", "other", score(F.col("f"), F.col("g")).alias("score")).where("score is not null")
    graph = _written(_with_turns(_best(first, k).withColumn("fresh", F.lit(True)), sampled, 0), root, "round-0")
    out = Graph(graph)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for turn in range(1, rounds + 1):
        worst = graph.groupBy("key").agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
        known = nodes.join(worst, "key", "left").select("key", "f", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
        onward = graph.where("taken").select(F.col("key").alias("node"), "other", "fresh")
        back = graph.select(F.col("other").alias("node"), F.col("key").alias("other"), "fresh")
        back = back.withColumn("n", F.row_number().over(Window.partitionBy("node", "fresh").orderBy(F.xxhash64("node", "other", F.lit(turn)), "other"))).where(F.col("n") <= sampled).drop("n")
        # an edge known from both ends is new while one of them has not been looked at
        met = onward.unionByName(back).groupBy("node", "other").agg(F.max("fresh").alias("fresh"))
        met = met.join(known.withColumnRenamed("key", "other"), "other").select("node", "fresh", F.struct(F.col("other").alias("key"), "f", "worst").alias("x"))
        lists = met.groupBy("node").agg(F.collect_list(F.when(F.col("fresh"), F.col("x"))).alias("new"), F.collect_list(F.when(~F.col("fresh"), F.col("x"))).alias("old"))
        both = lists.select(F.explode("new").alias("a"), "new", "old").select("a", F.explode(F.concat(F.filter("new", lambda y: y["key"] > F.col("a.key")), F.filter("old", lambda y: y["key"] != F.col("a.key")))).alias("b"))
        tried = both.select("a", "b", score(F.col("a.f"), F.col("b.f")).alias("score")).where("score > least(a.worst, b.worst)")
        better = lambda a, b: tried.where(F.col("score") > F.col(f"{a}.worst")).select(F.col(f"{a}.key").alias("key"), F.col(f"{b}.key").alias("other"), "score", F.lit(True).alias("fresh"), F.lit(True).alias("now"))
        old = graph.select("key", "other", "score", (F.col("fresh") & ~F.col("taken")).alias("fresh"), F.lit(False).alias("now"))
        merged = old.unionByName(better("a", "b")).unionByName(better("b", "a")).groupBy("key", "other").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"), F.min("now").alias("now"))
        new = _written(_with_turns(_best(merged, k), sampled, turn), root, f"round-{turn}")
        changed, total = new.agg(F.count_if("now"), F.count("*")).first()
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/round-{turn - 1}")
        path.getFileSystem(conf).delete(path, True)
        graph, out = new, Graph(new, [*out.changed, changed / max(1, total)])
        if changed <= least_changed * total:
            break
    return Graph(graph.select("key", "other", "score"), out.changed)
