"""Removal of lines that many documents share.

Two Bloom filters mark keys seen once and seen twice; only lines whose key the second one holds are
shuffled, as 16-byte digests, for exact counting and for the choice of the document that keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .rolling import LOWER, Chunk, Prefix, chunks, slices
from .sketches import SeenTwice, filter_bits_for, seen_twice
from .store import Scratch, free_names

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
NO_ID = -(2**63)


@dataclass
class Lines:
    """Lines of a chunk: text that holds each, its bytes, its key's bytes, hash and code points."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key_start: np.ndarray
    key_end: np.ndarray
    points: np.ndarray
    hash: np.ndarray
    lower: np.ndarray

    def digest(self, i: int) -> bytes:
        return hashlib.blake2b(self.lower[self.key_start[i] : self.key_end[i]].tobytes(), digest_size=16).digest()


def lines_of(chunk: Chunk) -> Lines:
    data = chunk.data
    breaks = np.flatnonzero(data == 10)
    at = np.concatenate((2 * chunk.end, 2 * breaks + 1))
    order = np.argsort(at, kind="stable")
    closes = order < len(chunk.end)
    end = at[order] >> 1
    doc = np.cumsum(closes) - closes
    start = np.concatenate(([0], (end + ~closes)[:-1])) if len(end) else end
    body = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(body, start), np.searchsorted(body, end)
    some = b > a
    key_start, key_end = start.copy(), start.copy()
    key_start[some], key_end[some] = body[a[some]], body[b[some] - 1] + 1
    lower = LOWER[data]
    count = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return Lines(doc, start, end, key_start, key_end, count[key_end] - count[key_start], Prefix(lower).of(key_start, key_end), lower)


def repeated_keys(docs: DataFrame, least_docs: int, least_points: int, filter_bits: int | None = None) -> DataFrame:
    """(id, hash, key, keeper) of each key and each document that holds it but isn't the one to keep it."""

    def hashes(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        for c in chunks(batch.column(1)):
            x = lines_of(c)
            ok = x.points >= least_points
            # a key twice in one document is no repeat: each document adds it once
            order = np.lexsort((x.hash[ok], x.doc[ok]))
            h, d = x.hash[ok][order], x.doc[ok][order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            yield {"line": h[new]}

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    found = seen_twice(texts, hashes, {"line": filter_bits or filter_bits_for(docs, 40)})["line"]
    held = texts.sparkSession.sparkContext.broadcast(found.twice)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = SeenTwice.reader(held.value)
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for c in chunks(batch.column(1)):
                x = lines_of(c)
                at = np.flatnonzero(x.points >= least_points)
                at = at[seen.suspected(x.hash[at])]
                if len(at):
                    out = {(int(x.doc[i]), x.digest(i)): int(i) for i in at}
                    rows = np.fromiter(out.values(), np.int64, len(out))
                    yield pa.record_batch([pa.array(ids[c.lo + x.doc[rows]]), pa.array(x.hash[rows].view(np.int64)), pa.array([k for _, k in out], pa.binary())], names=["id", "hash", "key"])

    lines = texts.mapInArrow(suspects, "id long, hash long, key binary").groupBy("key", "id").agg(F.first("hash").alias("hash"))
    return lines


def drop_repeated_lines(docs: DataFrame, least_docs: int = 3, least_points: int = 20, filter_bits: int | None = None) -> DataFrame:
    """docs with shared lines removed from text; adds n_lines (before) and n_dropped.

    A key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Keys of at least
    least_points code points in at least least_docs documents stay only in the largest doc_id that
    holds them, there as often as they occur.

    Null or empty text: one empty line, the text comes back empty. Null doc_id: one document below
    all others. Rows of equal doc_id: one document. Empty table: no rows. Other columns pass through;
    of those named n_lines or n_dropped the new ones win; n_chars, if there, is counted anew. A very
    long text is one row. filter_bits: of each Bloom filter, by default by the size of docs.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    suspects = scratch.keep(repeated_keys(docs, least_docs, least_points, filter_bits), "suspects")
    keepers = scratch.keep(suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= least_docs).select("key", "keeper"), "keepers")
    base = docs.drop("n_lines", "n_dropped")
    one, hashes_, keys_ = free_names(base.columns, "id", "hash", "key")
    drops = suspects.join(keepers, "key").where("id <> keeper").groupBy(F.col("id").alias(one)).agg(F.collect_list("hash").alias(hashes_), F.collect_list("key").alias(keys_))
    joined = base.withColumn(one, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).join(drops, one, "left").drop(one)
    names = base.columns
    place = [n.lower() for n in names].index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", n_lines long, n_dropped long"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = batch.num_rows
            hashes, keys = batch.column(len(names)), batch.column(len(names) + 1)
            has = np.asarray(hashes.is_valid())
            texts, n_lines, n_dropped = np.empty(n, object), np.ones(n, np.int64), np.zeros(n, np.int64)
            for c in chunks(batch.column(place)):
                x = lines_of(c)
                n_lines[c.lo : c.hi] = np.bincount(x.doc, minlength=len(c))
                raw = c.data.tobytes()
                edge = np.searchsorted(x.doc, np.arange(len(c) + 1))
                for j in range(len(c)):
                    i = c.lo + j
                    s, e = c.start[j], c.end[j]
                    if has[i]:
                        a, b = edge[j], edge[j + 1]
                        gone, wanted = np.zeros(b - a, bool), set(keys[i].as_py())
                        for k in np.flatnonzero(np.isin(x.hash[a:b].view(np.int64), np.asarray(hashes[i].values)) & (x.points[a:b] >= least_points)):
                            gone[k] = x.digest(a + k) in wanted
                        n_dropped[i] = gone.sum()
                        if n_dropped[i]:
                            texts[i] = b"\n".join(raw[x.start[k] : x.end[k]] for k in np.flatnonzero(~gone) + a)
                            continue
                    texts[i] = raw[s:e]
            out = [batch.column(k) for k in range(len(names))]
            out[place] = pa.array(list(texts), pa.binary()).cast(pa.string())
            yield pa.record_batch([*out, pa.array(n_lines), pa.array(n_dropped)], names=[*names, "n_lines", "n_dropped"])

    out = joined.mapInArrow(rewrite, fields)
    if "n_chars" in [n.lower() for n in names]:
        out = out.withColumn("n_chars", F.length("text").cast(base.schema[[n.lower() for n in names].index("n_chars")].dataType))
    return out
