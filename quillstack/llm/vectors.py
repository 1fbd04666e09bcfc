"""Near-duplicate vectors by navigable small-world graphs, one hierarchy a shard.

Exact copies collapse first. The classes are dealt to shards by hash; each shard gets a graph, and
blocks of all classes query every shard. A beam that ends among links is widened, and a sample of
each block's queries is audited against the whole shard: beams widen until the audit passes. Queries
whose links outgrow the widest beam are answered from the whole shard. Links are verified in double
precision; a task sends a spanning forest of its links, and components are joined over all shards.
A link is looked for from both of its ends. Rows whose links were not all found from both are told by
sums of names and asked again of whole shards, so that a count errs only by links that both ends missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet as pq
from pyspark.sql import DataFrame, functions as F

from .components import components, forest
from .store import Scratch

SIMILAR = 0.9
SHARD_ROWS, LEAST_SHARDS, BLOCK_ROWS, MOST_TASKS = 50_000, 6, 8192, 100_000
NEIGHBOURS, BUILD_BEAM, BEAM, WIDEST = 8, 32, 48, 384
RECALL, AUDITED = 0.999, 64
LEVEL_SHARE = 16
BATCH = 256


class Layer:
    """A graph over some rows of the shard's vectors; ids in it are the shard's."""

    def __init__(self, vectors: np.ndarray, degree: int) -> None:
        self.vectors, self.degree = vectors, degree
        self.near = np.full((len(vectors), degree), -1, np.int32)

    def search(self, queries: np.ndarray, entry: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of up to `width` rows near each query, best first, all queries in step."""
        n = len(queries)
        seen = np.zeros((n, len(self.vectors)), bool)
        line = np.arange(n)
        ids = np.full((n, width), -1, np.int32)
        score = np.full((n, width), -np.inf, np.float32)
        done = np.zeros((n, width), bool)
        start = entry[:, :width]
        ids[:, : start.shape[1]] = start
        got = np.einsum("ad,amd->am", queries, self.vectors[start])
        score[:, : start.shape[1]] = np.where(start >= 0, got, -np.inf)
        for k in range(start.shape[1]):
            ok = start[:, k] >= 0
            twice = seen[line[ok], start[ok, k]]
            seen[line[ok], start[ok, k]] = True
            score[line[ok][twice], k], ids[line[ok][twice], k] = -np.inf, -1
        while True:
            open_score = np.where(done | (ids < 0), -np.inf, score)
            take = np.argpartition(-open_score, min(expand, width) - 1, 1)[:, :expand]
            value = np.take_along_axis(open_score, take, 1)
            act = np.flatnonzero((value > -np.inf).any(1))
            if not len(act):
                break
            take, value = take[act], value[act]
            ok = value > -np.inf
            row = np.repeat(act, ok.sum(1))
            done[row, take[ok]] = True
            near = np.where(ok[:, :, None], self.near[np.where(ok, ids[act[:, None], take], 0)], -1).reshape(len(act), -1)
            fresh = (near >= 0) & ~seen[act[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            # the same row through two neighbours counts once
            code = r.astype(np.int64) * len(self.vectors) + near[r, c]
            _, first = np.unique(code, return_index=True)
            fresh[:] = False
            fresh[r[first], c[first]] = True
            near = np.where(fresh, near, -1)
            seen[act[r[first]], near[r[first], c[first]]] = True
            got = np.full(near.shape, -np.inf, np.float32)
            got[r[first], c[first]] = np.einsum("ad,ad->a", queries[act[r[first]]], self.vectors[near[r[first], c[first]]])
            all_score = np.concatenate((score[act], got), 1)
            all_ids = np.concatenate((ids[act], near), 1)
            all_done = np.concatenate((done[act], np.zeros(near.shape, bool)), 1)
            keep = np.argpartition(-all_score, width - 1, 1)[:, :width]
            score[act], ids[act], done[act] = (np.take_along_axis(x, keep, 1) for x in (all_score, all_ids, all_done))
            ids[act] = np.where(score[act] > -np.inf, ids[act], -1)
        order = np.argsort(-score, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)

    def choose(self, found: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Neighbours of each row among those found: near ones in different directions, then the nearest left."""
        n, m = found.shape
        kept = np.full((n, self.degree), -1, np.int32)
        count = np.zeros(n, np.int64)
        taken = np.zeros((n, m), bool)
        for strict in (True, False):
            for k in range(m):
                ok = (found[:, k] >= 0) & (count < self.degree) & ~taken[:, k]
                if strict and k:
                    own = self.vectors[np.maximum(found[:, k], 0)]
                    close = np.einsum("ad,amd->am", own, self.vectors[np.maximum(kept, 0)])
                    ok &= ~((close > score[:, k, None]) & (kept >= 0)).any(1)
                r = np.flatnonzero(ok)
                kept[r, count[r]] = found[r, k]
                taken[r, k] = True
                count[r] += 1
        return kept

    def link_back(self, new: np.ndarray) -> None:
        """Rows that the new ones point at point back, with the best of old and new where there are too many."""
        u = np.repeat(new, self.degree)
        v = self.near[new].reshape(-1)
        u, v = u[v >= 0], v[v >= 0]
        order = np.argsort(v, kind="stable")
        u, v = u[order], v[order]
        who, first, n = np.unique(v, return_index=True, return_counts=True)
        place = np.arange(len(v)) - np.repeat(first, n)
        for lo in range(0, len(who), 512):
            part = slice(lo, lo + 512)
            width = int(n[part].max())
            extra = np.full((len(who[part]), width), -1, np.int32)
            inside = (np.repeat(np.arange(len(who)), n) >= lo) & (np.repeat(np.arange(len(who)), n) < lo + 512)
            extra[np.repeat(np.arange(len(who)), n)[inside] - lo, place[inside]] = u[inside]
            every = np.concatenate((self.near[who[part]], extra), 1)
            # a row that is there already isn't added again
            again = (extra[:, :, None] == self.near[who[part]][:, None, :]).any(2)
            every[:, self.degree :][again] = -1
            score = np.where(every >= 0, np.einsum("ad,amd->am", self.vectors[who[part]], self.vectors[np.maximum(every, 0)]), -np.inf)
            by = np.argsort(-score, 1, kind="stable")
            self.near[who[part]] = self.choose(np.take_along_axis(every, by, 1), np.take_along_axis(score, by, 1))


class Graph:
    """Layers from the coarsest to the one of all rows."""

    def __init__(self, vectors: np.ndarray, layers: list[Layer], top: np.ndarray) -> None:
        self.vectors, self.layers, self.top = vectors, layers, top

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        n = len(vectors)
        draw = np.random.default_rng(n).permutation(n)
        sizes = [n]
        while sizes[-1] > 4 * LEVEL_SHARE:
            sizes.append(sizes[-1] // LEVEL_SHARE)
        # members of a layer are a prefix of the drawn order, so that coarser layers lie inside finer ones
        top = draw[: sizes[-1]].astype(np.int32)
        graph = cls(vectors, [], top)
        for size in reversed(sizes):
            layer = Layer(vectors, NEIGHBOURS * (2 if size == n else 1))
            members = draw[:size]
            lo, step = 0, 32
            while lo < size:
                new = members[lo : lo + step]
                known = members[: lo + len(new)]
                if lo == 0 or len(known) <= 4 * LEVEL_SHARE:
                    s = vectors[new] @ vectors[known].T
                    s[known[None, :] == new[:, None]] = -np.inf
                    by = np.argsort(-s, 1, kind="stable")[:, :BUILD_BEAM]
                    ids, score = known[by].astype(np.int32), np.take_along_axis(s, by, 1)
                    ids[score == -np.inf] = -1
                else:
                    entry = graph.descend(vectors[new], 2)
                    entry = np.concatenate((entry, np.broadcast_to(members[:4].astype(np.int32), (len(new), 4))), 1)
                    ids, score = layer.search(vectors[new], entry, BUILD_BEAM)
                    # those that come together may be each other's nearest
                    own = vectors[new] @ vectors[new].T
                    np.fill_diagonal(own, -np.inf)
                    by = np.argpartition(-own, min(8, len(new) - 1), 1)[:, :8] if len(new) > 1 else np.zeros((1, 0), int)
                    ids = np.concatenate((ids, new[by].astype(np.int32)), 1)
                    score = np.concatenate((score, np.take_along_axis(own, by, 1)), 1)
                    # a coarser layer's entry may be the row itself
                    score[ids == new[:, None]] = -np.inf
                    ids[score == -np.inf] = -1
                    order = np.argsort(-score, 1, kind="stable")
                    ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
                layer.near[new] = layer.choose(ids, score)
                layer.link_back(new)
                lo += len(new)
                step = min(BATCH, max(32, lo // 4))
            graph.layers.append(layer)
        return graph

    def descend(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Where to enter the layer below those that are there."""
        best = np.argsort(-(queries @ self.vectors[self.top].T), 1)[:, :width]
        entry = self.top[best]
        for layer in self.layers[1:]:
            entry = layer.search(queries, entry, max(width, 4), 2)[0][:, :width]
            entry = np.where(entry >= 0, entry, self.top[0])
        return entry

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        layers, self.layers = self.layers, self.layers[:-1]
        try:
            entry = self.descend(queries, 4)
        finally:
            self.layers = layers
        return layers[-1].search(queries, entry, width)


def spread_over(rows: np.ndarray, most: int) -> np.ndarray:
    """Up to so many of the rows, at even distances."""
    return rows[np.linspace(0, len(rows) - 1, min(most, len(rows))).astype(int)]


def links_in(graph: Graph, exact: np.ndarray, queries: np.ndarray, similar: float, beam: int = BEAM, own_row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(query, row) of every pair found with cosine >= similar in double precision, links in the last audit and those it missed. exact: the shard's unit vectors as doubles.

    The audit takes queries evenly and, so that it has links to look for, as many of those that found some.
    A beam of WIDEST reads the whole shard. own_row: the shard's row of each query, -1 where it has none; audits leave it out.
    """
    units = queries.astype(np.float32)
    slack = np.float32(similar - 1e-4)
    audit = truth = None
    width = min(beam, len(exact))
    open_rows = np.arange(len(queries))
    found: dict[int, np.ndarray] = {}
    while len(open_rows):
        if width >= min(WIDEST, len(exact)):
            # more links than the widest beam holds: the whole shard, in blocks
            for lo in range(0, len(open_rows), BATCH):
                own = open_rows[lo : lo + BATCH]
                hit = units[own] @ graph.vectors.T >= slack
                found.update((int(q), np.flatnonzero(h)) for q, h in zip(own, hit, strict=True))
            break
        for lo in range(0, len(open_rows), BATCH):
            own = open_rows[lo : lo + BATCH]
            ids, score = graph.search(units[own], width)
            hit = (score >= slack) & (ids >= 0)
            found.update((int(q), i[h]) for q, i, h in zip(own, ids, hit, strict=True))
        if audit is None:
            linked = np.array([q for q in range(len(queries)) if len(found[q])], int)
            audit = np.union1d(spread_over(np.arange(len(queries)), AUDITED), spread_over(linked, AUDITED))
            truth = np.concatenate([queries[audit[lo : lo + 32]] @ exact.T >= similar for lo in range(0, len(audit), 32)])
            if own_row is not None:
                at = np.flatnonzero(own_row[audit] >= 0)
                truth[at, own_row[audit[at]]] = False
        # those whose beam ends among links go on anyway; the audit is of all others
        ended = [(np.flatnonzero(t), found[int(q)]) for q, t in zip(audit, truth, strict=True) if len(found[int(q)]) < width]
        if sum(np.isin(t, f).sum() for t, f in ended) < RECALL * sum(len(t) for t, _ in ended):
            open_rows = np.arange(len(queries))
        else:
            # a beam that ends among links may hide more of them
            open_rows = np.array([q for q in open_rows if len(found[int(q)]) >= width], int)
        width = min(2 * width, len(exact))
    q = np.repeat(np.arange(len(queries)), [len(found[k]) for k in range(len(queries))])
    r = np.concatenate([found[k] for k in range(len(queries))]) if len(queries) else np.zeros(0, int)
    keep = np.zeros(len(q), bool)
    for lo in range(0, len(q), 100_000):
        part = slice(lo, lo + 100_000)
        keep[part] = np.einsum("ad,ad->a", queries[q[part]], exact[r[part]]) >= similar
    sought = [(np.flatnonzero(t), found[int(k)]) for k, t in zip(audit, truth, strict=True)] if audit is not None else []
    total = sum(len(t) for t, _ in sought)
    return q[keep], r[keep], total, total - int(sum(np.isin(t, f).sum() for t, f in sought))


@dataclass(frozen=True)
class Audit:
    """Links that audits of single searches looked for, over all blocks and shards, and those that were not found.

    Of a link both ends are asked, so the share of links lost is below the share missed here.
    """

    links: int
    missed: int
    #: whether all rows were asked again of whole shards, after which nothing is missed
    repeated: bool = False

    @property
    def recall(self) -> float:
        return 1.0 if not self.links else 1 - self.missed / self.links


def named(ids: np.ndarray) -> np.ndarray:
    """Ids as mixed numbers of 28 bits, whose sums tell sets apart and fit 64 bits for 2^35 of them."""
    x = ids.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) & np.uint64((1 << 28) - 1)).astype(np.int64)


def both_sides(rep: np.ndarray, other: np.ndarray, copies: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, vectors linked, balance) of the links (q, r) that one side found.

    The balance is the sum of the names that a row found, less the sum of the names that found it. Over all
    blocks and shards it is 0 exactly where every link of the row was found from both of its ends.
    """
    n = np.bincount(q, copies[r], len(rep)).astype(np.int64)
    gave, took = np.zeros(len(rep), np.int64), np.zeros(len(other), np.int64)
    np.add.at(gave, q, named(other[r]))
    np.add.at(took, r, named(rep[q]))
    a, b = np.unique(q), np.unique(r)
    return np.concatenate((rep[a], other[b])), np.concatenate((n[a], np.zeros(len(b), np.int64))), np.concatenate((gave[a], -took[b]))


def folder(path: str, size: int, name: str, number: int) -> pa.Table:
    """Rows of one folder of a table that was written by size and name."""
    store, base = fs.FileSystem.from_uri(f"{path}/size={size}/{name}={number}")
    files = [x.path for x in store.get_file_info(fs.FileSelector(base)) if x.base_name.endswith(".parquet")]
    return pa.concat_tables([pq.read_table(store.open_input_file(x)) for x in files])


def _table(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Representatives, copies and vectors of a group of classes."""
    column = group.column("embedding").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return group.column("rep").to_numpy(), group.column("copies").to_numpy(), vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def near_vectors(vectors: DataFrame, similar: float = SIMILAR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; see `audited`."""
    return audited(vectors, similar, shard_rows)[0]


def audited(vectors: DataFrame, similar: float = SIMILAR, shard_rows: int = SHARD_ROWS, beam: int = BEAM, recall: float = RECALL) -> tuple[DataFrame, Audit]:
    """vec_id, n_links, component_id, kept of every vector, and what the pooled audits found.

    n_links counts the other vectors linked directly (cosine >= similar), copies included;
    component_id is the smallest vec_id reachable by links, kept marks vec_id = component_id.

    Null or zero vectors and those with null or non-finite components link with nothing. Vectors of
    different lengths never link. Null vec_id: left alone, its component is null and kept is null.
    Rows of equal vec_id: vectors each on its own that share a name, so that their links add up in
    one component. Empty table: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            off, flat = column.offsets.to_numpy(), column.values
            raw, hole = flat.to_numpy(zero_copy_only=False), np.asarray(flat.is_null())
            ok = np.asarray(column.is_valid())
            out = []
            for k in range(len(column)):
                own = raw[off[k] : off[k + 1]]
                fine = ok[k] and len(own) and not hole[off[k] : off[k + 1]].any() and np.isfinite(own).all() and own.any()
                out.append(hashlib.md5((own + own.dtype.type(0)).tobytes()).digest() if fine else None)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary()), pa.array([None if x is None else int(off[k + 1] - off[k]) for k, x in enumerate(out)], pa.int32()), column], names=["vec_id", "digest", "size", "embedding"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    signed = scratch.keep(base.where("vec_id is not null").mapInArrow(sign, f"vec_id long, digest binary, size int, embedding {kind}"), "signed")
    classes = scratch.keep(signed.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("embedding").alias("embedding")), "classes")
    total = classes.count()
    shards, blocks = max(LEAST_SHARDS, -(-total // shard_rows)), max(1, -(-total // BLOCK_ROWS))
    dealt = classes.select("rep", "copies", "size", "embedding", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))

    def build(group: pa.Table) -> pa.Table:
        rep, copies, exact = _table(group)
        graph = Graph.build(exact.astype(np.float32))
        near = [x.near.tobytes() for x in graph.layers]
        return pa.table({"shard": group.column("shard")[:1], "size": group.column("size")[:1], "rep": [rep.astype(np.int64).tobytes()], "copies": [copies.astype(np.int64).tobytes()], "exact": [exact.tobytes()], "top": [graph.top.tobytes()], "near": pa.array([near], pa.list_(pa.binary()))})

    graphs, asked = scratch.path("graphs"), scratch.path("blocks")
    dealt.groupBy("shard", "size").applyInArrow(build, "shard int, size int, rep binary, copies binary, exact binary, top binary, near array<binary>").write.partitionBy("size", "shard").parquet(graphs)
    dealt.select("rep", "copies", "embedding", "size", "block").repartition("size", "block").write.partitionBy("size", "block").parquet(asked)

    def ask(asked: str, beam: int) -> DataFrame:
        """(u, v, n, balance): links of every block to every shard; both are read from the shared folder by their names. Without u: an audit's links and misses."""

        def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, shard, block in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    own = folder(graphs, size, "shard", shard).to_pylist()[0]
                    rep, _, queries = _table(folder(asked, size, "block", block))
                    shard_rep, copies = np.frombuffer(own["rep"], np.int64), np.frombuffer(own["copies"], np.int64)
                    exact = np.frombuffer(own["exact"]).reshape(len(shard_rep), -1)
                    units = exact.astype(np.float32)
                    layers = []
                    for data in own["near"]:
                        layer = Layer(units, 0)
                        layer.near = np.frombuffer(data, np.int32).reshape(len(units), -1)
                        layers.append(layer)
                    by = np.argsort(shard_rep)
                    at = by[np.minimum(np.searchsorted(shard_rep, rep, sorter=by), len(by) - 1)]
                    own_row = np.where(shard_rep[at] == rep, at, -1)
                    q, r, sought, missed = links_in(Graph(units, layers, np.frombuffer(own["top"], np.int32)), exact, queries, similar, beam, own_row)
                    other = rep[q] != shard_rep[r]
                    q, r = q[other], r[other]
                    row, n, balance = both_sides(rep, shard_rep, copies, q, r)
                    u, v = forest(rep[q], shard_rep[r])
                    none = np.zeros(len(u), np.int64)
                    end = pa.array(np.concatenate((np.zeros(len(row), np.int64), v)), mask=np.arange(len(row) + len(v)) < len(row))
                    yield pa.record_batch([pa.array(np.concatenate((row, u))), end, pa.array(np.concatenate((n, none))), pa.array(np.concatenate((balance, none)))], names=["u", "v", "n", "balance"])
                    # the audit has no row
                    yield pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([sought]), pa.array([missed])], names=["u", "v", "n", "balance"])

        blocks_asked = spark.read.parquet(asked).select(F.col("size").cast("int").alias("size"), F.col("block").cast("int").alias("block")).distinct()
        pairs = scratch.keep(dealt.select("size", "shard").distinct().join(blocks_asked, "size"), "pairs")
        # a pair is a task's work, so they are dealt by number and not by their few bytes
        tasks = min(max(1, pairs.count()), MOST_TASKS)
        return scratch.keep(pairs.select("size", "shard", "block").repartition(tasks).mapInArrow(query, "u long, v long, n long, balance long"), "links")

    got = ask(asked, beam) if total else spark.createDataFrame([], "u long, v long, n long, balance long")
    pooled = got.where("u is null").agg(F.sum("n").alias("n"), F.sum("balance").alias("missed")).first()
    audit = Audit(pooled["n"] or 0, pooled["missed"] or 0)
    if audit.recall < recall:
        # each block's audit is small; together they tell what no block's own could
        audit = Audit(audit.links, audit.missed, True)
        got = ask(asked, WIDEST)
    sums = scratch.keep(got.where("u is not null and v is null").groupBy("u").agg(F.sum("n").alias("n"), F.sum("balance").alias("balance")).withColumnRenamed("u", "rep"), "counts")
    counts = sums.where("balance = 0").select("rep", "n")
    doubted = sums.where("balance <> 0")
    n_doubted = doubted.count()
    if n_doubted:
        # one end of a link missed it: these rows are asked again, of whole shards
        again, parts = scratch.path("again"), -(-n_doubted // BLOCK_ROWS)
        block = F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int").alias("block")
        classes.join(doubted.select("rep"), "rep").select("rep", "copies", "embedding", "size", block).repartition("size", "block").write.partitionBy("size", "block").parquet(again)
        more = ask(again, WIDEST)
        exact_counts = more.where("u is not null and v is null").groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "rep")
        counts = counts.unionByName(doubted.select("rep").join(exact_counts, "rep"))
        got = got.unionByName(more)
    links = got.where("v is not null").select("u", "v")
    member = signed.select("vec_id", "digest").join(classes.select("digest", "rep", "copies"), "digest", "left")
    # rows of one vec_id with several vectors tie their classes together
    several = signed.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    tied = member.join(several, "vec_id").where("rep <> vec_id").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    labels = components(links.unionByName(tied), scratch).withColumnRenamed("node", "rep")
    told = scratch.keep(classes.select("rep", "copies").join(counts, "rep", "left").join(labels, "rep", "left").select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "told")
    out = member.drop("copies").join(told, "rep", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(base.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("boolean").alias("kept")))
    return out, audit
