"""Exact top-k search by inner product, in the three phases of the uniform threshold.

The components of all vectors are split between nodes. A node is a set of rows (uid, share) of its
own, and knows only its share of a score. First every node gathers the lists of its k best partial
scores; the vectors in them are looked up at the other nodes, and the k-th best sum gives a safe
cutoff. A vector that can reach it has, at one node at least, the cutoff divided by the number of
nodes; second, nodes send every entry from there on. Third, of vectors whose upper bound still
reaches the k-th best sum the nodes that have not sent theirs are asked. Partial scores are taken
above the node's least, so that what is unknown is never negative.

Queries lie in blocks in the shared folder; tasks read one after another, so that a phase is one job
and a task holds one block of queries against one block of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet as pq
from pyspark.sql import DataFrame, Window, functions as F

from .store import Scratch

NODES, QUERY_BLOCK = 2, 2048
#: Partial scores (rows times queries) that a task holds at once.
CELLS = 1 << 21


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of equal width, shorter ones filled with zeros."""
    n = len(column)
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    if n and (size == width).all():
        return flat[off[0] : off[-1]].reshape(n, width)
    out = np.zeros((n, width), np.int64)
    for k in range(n):
        out[k, : min(width, size[k])] = flat[off[k] : off[k] + min(width, size[k])]
    return out


def product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where that is exact."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if bound < 2**53:
        return np.rint(x.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    return x @ q.T


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """uid, vec_id, v: floor(scale * component) of the vectors that take part; uid is one a row."""
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(ok).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


@lru_cache(maxsize=4)
def _block(path: str, folder: str) -> pa.Table:
    store, _ = fs.FileSystem.from_uri(path)
    files = [x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.base_name.endswith(".parquet")]
    return pa.concat_tables([pq.read_table(store.open_input_file(x)) for x in files])


def _blocks_of(path: str) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Query numbers and rows of each block of a table in the shared folder."""
    store, base = fs.FileSystem.from_uri(path)
    for folder in sorted(x.path for x in store.get_file_info(fs.FileSelector(base)) if x.base_name.startswith("block=")):
        table = _block(path, folder)
        yield table.column("query").to_numpy(), table


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, nodes: int = NODES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose vec_id is divisible by `every`.

    Ties go to the smaller vec_id. Null vectors, and those with null or non-finite components, take
    no part, nor do rows without vec_id. Vectors of unequal length: shorter ones count as filled with
    zeros. Rows of equal vec_id: all are candidates except for queries of that vec_id; as queries
    they are one, the first row. Fewer rows than k: all. Empty table: no rows. Other columns are not
    read. Components beyond 64 bits after scaling, and products beyond them, wrap.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.keep(quantised(vectors), "rows")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by("v", "uid").alias("v"))
    count, width = rows.where(F.col("vec_id") % every == 0).agg(F.count_distinct("vec_id")).first()[0], int(rows.agg(F.max(F.size("v"))).first()[0] or 0)
    nodes, width = max(1, min(nodes, width)), max(1, width)
    edges = [width * n // nodes for n in range(nodes + 1)]
    # a block is a folder that tasks read whole
    blocks = max(1, -(-count // QUERY_BLOCK))
    asked = scratch.path("queries")
    named = queries.withColumn("query", F.xxhash64("vec_id"))
    named.withColumn("block", F.pmod("query", F.lit(blocks))).write.partitionBy("block").parquet(asked)
    numbers = scratch.keep(named.select("query", F.col("vec_id").alias("query_id")), "numbers")
    share = F.explode(F.array(*(F.struct(F.lit(n).alias("node"), F.slice("v", edges[n] + 1, edges[n + 1] - edges[n]).alias("part")) for n in range(nodes)))).alias("s")
    held = scratch.keep(rows.select("uid", "vec_id", share).select("s.node", "uid", "vec_id", "s.part").sortWithinPartitions("node"), "shares")

    def scores(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
        """(node, uids, queries, partial scores of the node, pairs of a query and its own row, the query block)."""
        for batch in batches:
            node = batch.column(0).to_numpy()
            for n in np.unique(node):
                own = batch.filter(pa.array(node == n))
                lo, hi = edges[n], edges[n + 1]
                x, uid, name = _matrix(own.column(3), hi - lo), own.column(1).to_numpy(), own.column(2).to_numpy()
                for query, table in _blocks_of(path):
                    q = _matrix(table.column("v").combine_chunks(), width)[:, lo:hi]
                    same = table.column("vec_id").to_numpy()
                    step = max(1, CELLS // len(query))
                    for at in range(0, len(x), step):
                        part = slice(at, at + step)
                        yield int(n), uid[part], query, product(x[part], q), name[part, None] == same[None, :], table

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, uid, query, s, same, _ in scores(batches, asked):
            low, s = s.min(0), np.where(same, np.iinfo(np.int64).min, s)
            at = np.argpartition(-s, min(k, len(s)) - 1, 0)[:k]
            score = np.take_along_axis(s, at, 0)
            ok = score > np.iinfo(np.int64).min
            column = np.broadcast_to(np.arange(len(query)), at.shape)
            # a query without other rows here still tells the node's least
            yield pa.record_batch([pa.array(np.full(ok.sum(), n, np.int32)), pa.array(query[column[ok]]), pa.array(uid[at[ok]]), pa.array(score[ok]), pa.array(low[column[ok]])], names=["node", "query", "uid", "part", "low"])

    first = scratch.keep(held.mapInArrow(lists, "node int, query long, uid long, part long, low long"), "lists")
    # a node's least is that of the rows that are not the query's own: no other ever counts
    floors = scratch.keep(first.groupBy("node", "query").agg(F.min("low").alias("floor")), "floors")
    best = Window.partitionBy("node", "query").orderBy(F.desc("part"), "uid")
    listed = scratch.keep(first.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).select("query", "uid").distinct(), "listed")

    def looked_up(pairs: DataFrame) -> DataFrame:
        """(query, uid, node, part) of pairs(query, uid, node): each node computes its own."""
        texts = named.select("query", F.col("v").alias("q"))
        both = pairs.join(held.drop("vec_id"), ["node", "uid"]).join(texts, "query").select("node", "query", "uid", "part", "q")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                node, out = batch.column(0).to_numpy(), np.zeros(batch.num_rows, np.int64)
                q = _matrix(batch.column(4), width)
                for n in np.unique(node):
                    at = np.flatnonzero(node == n)
                    out[at] = np.einsum("ij,ij->i", _matrix(batch.column(3).take(pa.array(at)), edges[n + 1] - edges[n]), q[at, edges[n] : edges[n + 1]])
                yield pa.record_batch([batch.column(1), batch.column(2), batch.column(0), pa.array(out)], names=["query", "uid", "node", "part"])

        return both.mapInArrow(task, "query long, uid long, node int, part long")

    every_node = F.explode(F.array(*map(F.lit, range(nodes)))).alias("node")
    sums = looked_up(listed.select("query", "uid", every_node)).join(floors, ["node", "query"]).groupBy("query", "uid").agg(F.sum(F.col("part") - F.col("floor")).alias("s"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s")))
    kth = sums.withColumn("k", place).where(F.col("k") == k).select("query", "s")
    floor = floors.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("node", "floor"))).alias("f"))
    limits = scratch.keep(floor.join(kth, "query", "left").select("query", F.coalesce("s", F.lit(0)).alias("cutoff"), F.transform(F.sequence(F.lit(0), F.lit(nodes - 1)), lambda n: F.coalesce(F.try_element_at("f", n), F.lit(0))).alias("floors")), "limits")
    told = scratch.path("told")
    named.join(limits, "query").withColumn("block", F.pmod("query", F.lit(blocks))).write.partitionBy("block").parquet(told)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, uid, query, s, same, table in scores(batches, told):
            low = _matrix(table.column("floors").combine_chunks(), nodes)[:, n]
            above = s - low
            i, j = np.nonzero((above * nodes >= table.column("cutoff").to_numpy()) & ~same)
            if len(i):
                yield pa.record_batch([pa.array(np.full(len(i), n, np.int32)), pa.array(query[j]), pa.array(uid[i]), pa.array(above[i, j])], names=["node", "query", "uid", "part"])

    second = scratch.keep(held.mapInArrow(entries, "node int, query long, uid long, part long"), "entries")
    known = second.groupBy("query", "uid").agg(F.sum("part").alias("s"), F.count("*").alias("n"), F.collect_list("node").alias("sent"))
    # below the threshold a part is under cutoff / nodes, so that is what an unknown one can add
    better = known.withColumn("k", place).where(F.col("k") == k).select("query", F.col("s").alias("least"))
    bound = limits.select("query", "cutoff").join(better, "query", "left").select("query", "cutoff", F.greatest("cutoff", F.coalesce("least", F.lit(0))).alias("least"))
    reach = F.col("s") * nodes + (F.lit(nodes) - F.col("n")) * F.col("cutoff")
    candidates = scratch.keep(known.join(bound, "query").where(reach >= F.col("least") * nodes).select("query", "uid", "s", "sent"), "candidates")
    unsent = candidates.select("query", "uid", F.explode(F.array_except(F.array(*map(F.lit, range(nodes))), "sent")).alias("node"))
    rest = looked_up(unsent).join(floors, ["node", "query"]).groupBy("query", "uid").agg(F.sum(F.col("part") - F.col("floor")).alias("more"))
    base = limits.select("query", F.aggregate("floors", F.lit(0).cast("long"), lambda a, x: a + x).alias("base"))
    whole = candidates.join(rest, ["query", "uid"], "left").join(base, "query").select("query", "uid", (F.col("s") + F.coalesce("more", F.lit(0)) + F.col("base")).alias("score"))
    scored = whole.join(rows.select("uid", "vec_id"), "uid").join(numbers, "query").select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
