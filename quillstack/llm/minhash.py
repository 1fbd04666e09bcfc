"""Near-duplicate documents by weighted MinHash.

Texts become sets of five-word shingles weighted by TF-IDF. Improved consistent weighted sampling
draws signatures, bands of them give candidate buckets, each bucket is linked through pivots, and a
link stands only if the weighted Jaccard similarity of the two whole texts is at least 0.8.

Document frequencies are counted over all documents in a sketch of two rows of counters. What other
shingles add to a counter is known on average and taken off, and the lesser of both rows stands: a
shingle's share of the documents is resolved down to about COUNTERS⁻¹ times the shingles of a
document (0.03 % at 300), whatever the size of the corpus; rarer ones all weigh as rare.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import components, forest
from .rolling import Chunk, chunks, mix, slices, words_of
from .sketches import SCHEMA, add_up, emit, gather
from .store import Scratch, free_names

U = np.uint64
SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 12, 4
COUNTERS = 1 << 20
#: Weight of a shingle in no other document over that of one in all of them is 1 + DAMPING * ln(documents) / SCALE.
DAMPING, SCALE = 0.25, np.log(1 << 16)
#: Buckets of up to SMALL members are compared pair by pair; in larger ones PIVOTS members meet all that are still apart.
SMALL = PIVOTS = 8
LEFT_ROWS, RIGHT_ROWS = 256, 512
NO_ID = -(2**63)
DOC_BITS = U(52)
LOW = U((1 << 52) - 1)
_rng = np.random.default_rng(777)
_SPREAD = (_rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) << U(1)) | U(1)


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 and rate 1 at the middles of n equal parts."""
    p = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = 1 - np.exp(-mid) * (1 + mid) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


_R = _gamma_quantiles(1 << 12).astype(np.float32)
_LOG_C = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)
_MUL = _rng.integers(0, 2**32, (BANDS * ROWS, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingles(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (text << 52 | shingle), count of each, and words of each text.

    A text of one to four words has one shingle of them all; one without words has none.
    """
    w = words_of(chunk)
    n = np.bincount(w.doc, minlength=len(chunk))
    close = np.cumsum(n)
    keys = []
    if len(w.hash) >= SHINGLE:
        span = len(w.hash) - SHINGLE + 1
        h = np.zeros(span, np.uint64)
        for k in range(SHINGLE):
            h += w.hash[k : k + span] * _SPREAD[k]
        ok = w.doc[:span] == w.doc[SHINGLE - 1 :]
        keys.append((w.doc[:span][ok].astype(np.uint64) << DOC_BITS) | (mix(h[ok]) & LOW))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            ok = n[short] > k
            h[ok] += w.hash[(close[short] - n[short])[ok] + k] * _SPREAD[k]
        keys.append((short.astype(np.uint64) << DOC_BITS) | (mix(h + U(1)) & LOW))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.diff(np.append(first, len(key))), n


def counters_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counter of each shingle in both rows of the sketch."""
    return (key & U(COUNTERS - 1)).astype(np.int64), (key >> U(26) & U(COUNTERS - 1)).astype(np.int64)


@dataclass
class Weights:
    """Inverse document frequency by counter, a row of counters each; the greater of both stands."""

    one: np.ndarray
    two: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, documents: int) -> Weights:
        """1 + DAMPING * ln((1 + N) / (1 + df)) / SCALE of each counter, what others add on average taken off first."""
        rows = []
        for own in counts.astype(float):
            noise = (own.sum() - own) / (COUNTERS - 1)
            rows.append(np.maximum(1.0, 1 + DAMPING * np.log((1 + documents) / (1 + np.maximum(own - noise, 1.0))) / SCALE).astype(np.float32))
        return cls(*rows)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        a, b = counters_of(key)
        return np.maximum(self.one[a], self.two[b]).astype(float)


def inverse_frequencies(texts: DataFrame) -> Weights:
    """Weights of shingles by the number of documents that hold them, counted over all documents.

    Damped, so that what a large group of near copies shares isn't outweighed by what each has alone.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((2, COUNTERS), np.int64), np.zeros(1, np.int64)
        for batch in batches:
            n += batch.num_rows
            for c in chunks(batch.column(1)):
                for own, at in zip(df, counters_of(shingles(c)[0]), strict=True):
                    np.add.at(own, at, 1)
        yield from emit({"df": df, "n": n})

    got = gather(texts.mapInArrow(task, SCHEMA), texts.rdd.getNumPartitions(), {"df": (np.dtype(np.int64), (2, COUNTERS)), "n": (np.dtype(np.int64), (1,))}, add_up("int64"))
    return Weights.of(got["df"], int(got["n"][0]))


def signatures(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and for each the keys of its bands.

    For each of the samples, shingle k of weight S draws r, c from gamma(2, 1) and b from [0, 1) by
    its hash; t = floor(ln S / r + b), and the shingle of least c / exp(r (t - b + 1)) is taken with
    its t. Two texts take the same with the probability of their weighted Jaccard similarity.
    """
    doc = (key >> DOC_BITS).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    out = np.empty((len(first), BANDS * ROWS), np.uint64)
    edge = np.append(first, len(doc))
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + 40_000, "right")) - 1)
        a, b = edge[lo], edge[hi]
        at, sizes = first[lo:hi] - a, np.diff(edge[lo : hi + 1])
        own = key[a:b] & LOW
        x, y = (own & U(0xFFFFFFFF)).astype(np.uint32), (own >> U(20)).astype(np.uint32)
        log_s = np.log(weight[a:b]).astype(np.float32)
        for i in range(BANDS * ROWS):
            h = x * _MUL[i, 0] + y * _MUL[i, 1] + _ADD[i]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            g = h * np.uint32(0x297A2D39)
            r = _R[g >> np.uint32(20)]
            beta = (h & np.uint32(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(log_s / r + beta)
            a_log = _LOG_C[h >> np.uint32(16)] - r * (t - beta + np.float32(1))
            low = np.minimum.reduceat(a_log, at)
            hit = np.flatnonzero(a_log == np.repeat(low, sizes))
            pick = hit[np.searchsorted(hit, at)]
            out[lo:hi, i] = mix(own[pick] + t[pick].astype(np.int64).view(np.uint64) * U(0x9E3779B97F4A7C15))
        lo = hi
    bands = np.empty((len(first), BANDS), np.uint64)
    for k in range(BANDS):
        h = np.full(len(first), k + 1, np.uint64)
        for i in range(k * ROWS, (k + 1) * ROWS):
            h = mix(h + out[:, i])
        bands[:, k] = h
    return doc[first] if len(doc) else first, bands


def similarity(left: pa.Array, right: pa.Array, idf: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of the whole texts of each row; 0 where a text has no words."""
    out = np.zeros(len(left))

    def parts(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        key, tf, _ = shingles(c)
        return key, tf * idf(key)

    lo = 0
    for c in chunks(left, rows=500):
        lo, n = c.lo, len(c)
        ka, wa = parts(c)
        kb, wb = [], []
        for d in chunks(right.slice(lo, n), rows=500):
            k, w = parts(d)
            kb.append(k + (U(d.lo) << DOC_BITS))
            wb.append(w)
        kb, wb = np.concatenate(kb), np.concatenate(wb)
        both, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        sum_of = lambda k, w: np.bincount((k >> DOC_BITS).astype(np.int64), w, n)
        low = sum_of(both, np.minimum(wa[i], wb[j]))
        top = sum_of(ka, wa) + sum_of(kb, wb) - low
        out[lo : lo + n] = np.divide(low, top, out=np.zeros(n), where=top > 0)
    return out


def block_links(left: pa.Array, right: pa.Array, idf: Weights, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of every pair of a left and a right text whose similarity is at least `similar`.

    A shingle that occurs k times is k elements, so that the shared weight is a matrix product.
    """

    def elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, name, weight = [], [], []
        for c in chunks(column):
            key, tf, _ = shingles(c)
            step = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
            row.append(np.repeat((key >> DOC_BITS).astype(np.int64) + c.lo, tf))
            own = np.repeat(key & LOW, tf)
            name.append(mix(own + step.astype(np.uint64) * U(0xD6E8FEB86659FD93)))
            weight.append(idf(own))
        return np.concatenate(row), np.concatenate(name), np.concatenate(weight)

    (i, a, wa), (j, b, wb) = elements(left), elements(right)
    n, m = len(left), len(right)
    top = np.bincount(i, wa, n)[:, None] + np.bincount(j, wb, m)[None, :]
    shared = np.intersect1d(a, b)
    low = np.zeros((n, m))
    at, bt = np.searchsorted(shared, a), np.searchsorted(shared, b)
    ok_a = shared[np.minimum(at, len(shared) - 1)] == a if len(shared) else np.zeros(len(a), bool)
    ok_b = shared[np.minimum(bt, len(shared) - 1)] == b if len(shared) else np.zeros(len(b), bool)
    i, at, wa, j, bt = i[ok_a], at[ok_a], wa[ok_a], j[ok_b], bt[ok_b]
    by_a, by_b = np.argsort(at, kind="stable"), np.argsort(bt, kind="stable")
    i, at, wa, j, bt = i[by_a], at[by_a], wa[by_a], j[by_b], bt[by_b]
    for k in range(0, len(shared), 4096):
        p, q = slice(*np.searchsorted(at, (k, k + 4096))), slice(*np.searchsorted(bt, (k, k + 4096)))
        x, y = np.zeros((n, 4096)), np.zeros((m, 4096))
        x[i[p], at[p] - k], y[j[q], bt[q] - k] = wa[p], 1
        low += x @ y.T
    return np.nonzero((low >= similar * (top - low) - 1e-12) & (low > 0))


BROADCAST_IDS = 1_000_000


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id, n_copies) a document: the smallest doc_id of its class, and rows of its exact text.

    Copies of one text are one class member; texts link if their weighted Jaccard similarity is at
    least `similar`, and classes are the components of links. Buckets are resolved through pivots:
    every member is compared with the bucket's most central one, and where members stay in different
    components, with a few more. Small buckets are then done; in larger ones each member outside the
    largest component is compared with all others, in blocks that pass on a forest of their links.

    Null text: a class of its own. Empty text or text without words: links with exact copies only.
    Null doc_id: stays alone under a null class. Rows of equal doc_id: one document, one row.
    Empty table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    known = texts.where("id is not null")
    weights = spark.sparkContext.broadcast(inverse_frequencies(texts))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = weights.value
        for batch in batches:
            ids, column = np.asarray(batch.column(0)), batch.column(1)
            for c in chunks(column):
                key, tf, _ = shingles(c)
                at, bands = signatures(key, tf * idf(key))
                lists = [None] * len(c)
                for k, row in zip(at.tolist(), bands.view(np.int64), strict=True):
                    lists[k] = row
                raw = c.data.tobytes()
                digest = [None if c.null[k] else hashlib.md5(raw[c.start[k] : c.end[k]]).digest() for k in range(len(c))]
                yield pa.record_batch([pa.array(ids[c.lo : c.hi]), pa.array(digest, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["id", "digest", "bands"])

    signed = scratch.keep(known.mapInArrow(sign, "id long, digest binary, bands array<long>"), "signed")
    exact = scratch.keep(signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min_by("bands", "id").alias("bands")), "exact")
    band = scratch.keep(exact.select("rep", F.explode("bands").alias("key")), "band")
    sizes = scratch.keep(band.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    # a member that shares more, with more others, is the likelier centre of a group
    weight = scratch.keep(band.join(sizes, "key").groupBy("rep").agg(F.sum("n").alias("w")), "weight")
    buckets = scratch.keep(band.join(sizes, "key").join(weight, "rep"), "buckets")
    pivot = scratch.keep(buckets.groupBy("key").agg(F.min(F.struct(-F.col("w"), F.col("rep"))).alias("p")).select("key", F.col("p.rep").alias("pivot")), "pivot")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs(u, v)."""
        need = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
        if pairs_count(pairs) <= BROADCAST_IDS // 2:
            need = F.broadcast(need)
        own = scratch.keep(known.join(need, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "texts")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                s = similarity(batch.column(2), batch.column(3), weights.value)
                keep = np.flatnonzero(s >= similar)
                yield pa.record_batch([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(s[keep])], names=["u", "v", "s"])

        both = pairs.join(own.select(F.col("id").alias("u"), F.col("text").alias("a")), "u").join(own.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")
        links = scratch.keep(both.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long, s double").select("u", "v"), "links")
        scratch.drop(own)
        return links

    counted: dict[int, int] = {}

    def pairs_count(pairs: DataFrame) -> int:
        return counted.setdefault(id(pairs), pairs.count())

    tried = scratch.keep(buckets.join(pivot, "key").where("rep <> pivot").select(F.greatest("rep", "pivot").alias("u"), F.least("rep", "pivot").alias("v")).distinct(), "pairs")
    links = verified(tried)

    def apart(labels: DataFrame) -> DataFrame:
        """Members of buckets of several components: key, rep, n, w, c, and whether c is not the bucket's largest."""
        named = scratch.keep(buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", "w", F.coalesce("component", "rep").alias("c")), "named")
        parts = named.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("k", "c")).alias("m")).where("parts > 1")
        main = scratch.keep(parts.select("key", F.col("m.c").alias("main")), "main")
        return named.join(main, "key").withColumn("stray", F.col("c") != F.col("main")).drop("main")

    labels = scratch.keep(components(links, scratch), "labels")
    left = scratch.keep(apart(labels), "open")
    order = Window.partitionBy("key").orderBy(F.desc("w"), "rep")
    ranked = left.withColumn("k", F.row_number().over(order)).where(f"k <= {PIVOTS}").where("k > 1").select("key", F.col("rep").alias("p"), F.col("c").alias("pc"))
    pairs = scratch.keep(left.join(ranked, "key").where(f"c <> pc and (stray or n <= {SMALL})").select(F.greatest("rep", "p").alias("u"), F.least("rep", "p").alias("v")).distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
    if pairs_count(pairs):
        links = links.unionByName(verified(pairs))
        labels = scratch.keep(components(links, scratch), "labels")
    # what is still apart in larger buckets meets every member, in blocks that send a forest of their links
    left = scratch.keep(apart(labels).where(f"n > {SMALL}"), "open")
    if left.limit(1).count():
        need = left.select("rep").distinct()
        own = known.join(F.broadcast(need) if need.count() <= BROADCAST_IDS else need, F.col("id") == F.col("rep"), "left_semi").groupBy("id").agg(F.min("text").alias("text"))
        with_text = left.join(own.withColumnRenamed("id", "rep"), "rep").select("key", "rep", "c", "text", "stray")
        shape = scratch.keep(left.groupBy("key").agg(F.ceil(F.sum(F.col("stray").cast("int")) / LEFT_ROWS).cast("int").alias("i"), F.ceil(F.count("*") / RIGHT_ROWS).cast("int").alias("j")), "shape")
        dealt = scratch.keep(with_text.join(shape, "key"), "dealt")
        strays = dealt.where("stray").withColumn("a", F.pmod(F.xxhash64("rep"), F.col("i"))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("j").cast("long") - 1)))
        others = dealt.withColumn("b", F.pmod(F.xxhash64("rep"), F.col("j"))).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("i").cast("long") - 1)))

        def block(x: pa.Table, y: pa.Table) -> pa.Table:
            schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
            if not x.num_rows or not y.num_rows:
                return schema.empty_table()
            u, v = block_links(x.column("text").combine_chunks(), y.column("text").combine_chunks(), weights.value, similar)
            u, v = x.column("rep").to_numpy()[u], y.column("rep").to_numpy()[v]
            u, v = forest(u, v)
            return pa.table([pa.array(u), pa.array(v)], schema=schema)

        columns = ["key", "a", "b", "rep", "text"]
        more = strays.select(*columns).groupBy("key", "a", "b").cogroup(others.select(*columns).groupBy("key", "a", "b")).applyInArrow(block, "u long, v long")
        links = links.unionByName(scratch.keep(more.distinct(), "links"))
        labels = scratch.keep(components(links, scratch), "labels")
    member = signed.join(exact.select("digest", "rep", "copies"), "digest", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    # rows of one doc_id with several texts are one document
    own = member.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"), F.max("copies").alias("n_copies"))
    odd = scratch.keep(own.where("rep <> other"), "odd")
    if odd.limit(1).count():
        joined = member.select(F.col("id").alias("u"), F.col("rep").alias("v")).where("u <> v")
        labels = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(joined), scratch)
    out = own.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("id").alias("doc_id"), F.coalesce("component", "rep").alias("class_id"), F.col("n_copies").cast("long").alias("n_copies"))
    # a class is named by its smallest member
    return out.unionByName(texts.where("id is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_copies")))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs without the near copies: of each class the row of smallest doc_id stays; null ids stay.

    Columns are those of docs, whatever their names. Of rows with equal doc_id that of least text
    stays (null: empty), and of those with equal text that of least hash, so that it is the same each time.
    """
    one, row = free_names(docs.columns, "id", "row")
    kept = near_duplicates(docs, similar).where("doc_id = class_id").select(F.col("doc_id").alias(one))
    own = docs.where("doc_id is not null").withColumn(one, F.col("doc_id").cast("long")).join(kept, one)
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rest = own.groupBy(one).agg(F.min_by(every, F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))).alias(row)).select(*(F.col(f"{row}.`{c}`") for c in docs.columns))
    return rest.unionByName(docs.where("doc_id is null"))
