"""Vectors as codes: a codebook a part, fitted by Lloyd's rounds that scan only what their bounds leave open.

Entries of a codebook are dealt into groups. Every part of every vector keeps one lower bound a group:
no entry of the group but its own is nearer than that. After the entries have moved, a bound falls by
the furthest move in its group; a group whose bound still lies above the distance to the part's own
entry is not looked at. Distances that are looked at, and with them ties, are whole numbers. Vectors,
codes and bounds go from round to round in tables of the shared folder; what reaches the driver is a
count and a sum an entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .store import Scratch, workers_find_package

PARTS, ENTRIES, SCALE, ROUNDS = 16, 64, 256, 2
GROUPS = 8
#: Bounds are kept in half precision, rounded down; what is further away counts as this far.
FURTHEST = 65504.0


@dataclass
class Books:
    """entries[part, entry, position], the group of each entry, and how far each has moved, at most."""

    entries: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def grouped(entries: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """A group of near entries for each entry of each part; any dealing is right, a close one saves scans."""
    out = np.zeros(entries.shape[:2], np.int64)
    for p, own in enumerate(entries.astype(float)):
        centres = own[np.linspace(0, len(own) - 1, min(groups, len(own))).astype(int)]
        for _ in range(rounds):
            out[p] = ((own[:, None] - centres) ** 2).sum(2).argmin(1)
            centres = np.array([own[out[p] == g].mean(0) if (out[p] == g).any() else c for g, c in enumerate(centres)])
    return out


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries; through a float product where all of it stays below 2**53."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def half_down(x: np.ndarray) -> np.ndarray:
    """Half-precision numbers none of which is above x."""
    out = np.minimum(x, FURTHEST).astype(np.float16)
    over = out.astype(float) > x
    out[over] = np.nextafter(out[over], np.float16(-np.inf))
    return out


def _two_least(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the least of each row, the least, and the next."""
    at = d.argmin(1)
    rows = np.arange(len(d))
    least = d[rows, at]
    if d.shape[1] == 1:
        return at, least, np.full(len(d), np.iinfo(np.int64).max)
    rest = d.copy()
    rest[rows, at] = np.iinfo(np.int64).max
    return at, least, rest.min(1)


def assign(x: np.ndarray, entries: np.ndarray, group: np.ndarray, moved: np.ndarray | None = None, code: np.ndarray | None = None, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row (ties to the lower one), its squared distance, bounds a group, and groups scanned.

    code and lower: what an earlier round found before the entries moved; without them all is scanned.
    """
    n, rows = len(x), np.arange(len(x))
    first = code is None
    if first:
        old, best = np.full(n, len(entries)), np.full(n, np.iinfo(np.int64).max)
        bound = np.full((n, GROUPS), -1.0)
    else:
        old, best = code.astype(np.int64), ((x - entries[code]) ** 2).sum(1)
        fall = np.array([moved[group == g].max(initial=0.0) for g in range(GROUPS)])
        bound = lower.astype(float) - fall
    own, reach = best.copy(), np.sqrt(best.astype(float)) * (1 + 1e-9) + 1e-9
    new, scanned = old.copy(), np.zeros(n, np.int32)
    seen = []
    for g in range(GROUPS):
        members = np.flatnonzero(group == g)
        at = np.flatnonzero(bound[:, g] <= reach) if not first else rows
        if not len(members) or not len(at):
            continue
        place, least, following = _two_least(distances(x[at], entries[members]))
        place = members[place]
        better = (least < best[at]) | ((least == best[at]) & (place < new[at]))
        best[at[better]], new[at[better]] = least[better], place[better]
        scanned[at] += 1
        seen.append((g, at, place, least, following))
    for g, at, place, least, following in seen:
        bound[at, g] = np.sqrt(np.where(place == new[at], following, least).astype(float)) * (1 - 1e-12)
    if not first:  # an entry that was left is one of the others of its group now
        left = np.flatnonzero(new != old)
        g = group[old[left]]
        bound[left, g] = np.minimum(bound[left, g], np.sqrt(own[left].astype(float)) * (1 - 1e-12))
    bound[:, [g for g in range(GROUPS) if not (group == g).any()]] = FURTHEST
    return new, best, half_down(bound), scanned


def whole_vectors(rows: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of rows whose vector can be coded, v in whole numbers, and the vectors' length."""
    x = F.col("embedding").cast("array<double>")
    fine = rows.select("vec_id", "label", x.alias("x")).where(F.expr("x is not null and size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"))
    first = fine.where(F.size("x") % PARTS == 0).orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x")).limit(1).collect()
    width = first[0][0] if first else PARTS
    most = int((2**61 / width) ** 0.5)  # so that the error of a row is a long
    floors = F.transform("x", lambda c: F.floor(c * SCALE))
    coded = fine.where((F.size("x") == width) & F.forall("x", lambda c: F.abs(c * SCALE) < most))
    return coded.select("vec_id", "label", floors.cast("array<int>").alias("v")), width


_STATE = "vec_id long, label string, v array<int>, code binary, lower binary, error long, groups_scanned int"


def _round(table: DataFrame, books: Books, first: bool) -> DataFrame:
    width = books.entries.shape[2]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, PARTS, width)
            code, lower = np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS, GROUPS), np.float16)
            if not first:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, PARTS).copy()
                lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), np.float16).reshape(n, PARTS, GROUPS).copy()
            error, scanned = np.zeros(n, np.int64), np.zeros(n, np.int32)
            for p in range(PARTS):
                state = () if first else (books.moved[p], code[:, p], lower[:, p])
                code[:, p], d, lower[:, p], s = assign(v[:, p], books.entries[p], books.group[p], *state)
                error += d
                scanned += s
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), batch.column("v"), pa.array([r.tobytes() for r in code], pa.binary()), pa.array([r.tobytes() for r in lower], pa.binary()), pa.array(error), pa.array(scanned)], names=["vec_id", "label", "v", "code", "lower", "error", "groups_scanned"])

    return table.mapInArrow(task, _STATE)


def _moved(table: DataFrame, books: Books) -> Books:
    """Entries at the floor of the mean of their parts; those without any stay."""
    parts, entries, width = books.entries.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            n = batch.num_rows
            if n:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n * parts, width)
                slot = (np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts) + np.arange(parts) * entries).ravel()
                order = np.argsort(slot, kind="stable")
                own, at = np.unique(slot[order], return_index=True)
                sums[own] += np.add.reduceat(v[order], at, 0)
                count += np.bincount(slot, minlength=parts * entries)
        used = np.flatnonzero(count)
        yield pa.record_batch([pa.array(used), pa.array(count[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["slot", "n", "sums"])

    wide = lambda k: F.sum(F.col("sums")[k].cast("decimal(20,0)")).cast("string")
    rows = table.select("v", "code").mapInArrow(task, "slot long, n long, sums array<long>").groupBy("slot").agg(F.sum("n").alias("n"), F.array(*(wide(k) for k in range(width))).alias("sums")).collect()
    out = books.entries.copy()
    for row in rows:
        out[row.slot // entries, row.slot % entries] = [int(s) // row.n for s in row.sums]
    return Books(out, books.group, np.sqrt(((out - books.entries).astype(float) ** 2).sum(2)) * (1 + 1e-9))


def fit(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """Codes of all vectors, and the codebooks.

    rows: vec_id, label, embedding. Codes: vec_id, label, v (whole numbers), code (a byte a part), error and groups_scanned (of
    PARTS * GROUPS, in the last assignment). Rows whose vector is null, empty, holds null or non-finite
    components, has another length than the vector of the smallest vec_id that PARTS divides, or is so
    large that its error is no long, are left out. Null vec_ids come after all others; of rows of equal
    vec_id each is a row of its own, in order of vectors. With fewer rows than ENTRIES codebooks are as
    short. Empty table: no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "codes")
    vectors, width = whole_vectors(rows)
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    entries = np.array([r.v for r in seeds], np.int64).reshape(len(seeds), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    books = Books(entries, grouped(entries) if seeds else np.zeros((PARTS, 0), np.int64), np.zeros(entries.shape[:2]))
    if not seeds:
        return spark.createDataFrame([], _STATE).drop("lower"), books
    state = vectors.withColumn("label", F.col("label").cast("string"))
    for k in range(rounds):
        now = scratch.keep(_round(state, books, first=k == 0), "round")
        if k:
            scratch.drop(state)
        state, books = now, _moved(now, books)
    return scratch.keep(_round(state, books, first=rounds == 0).drop("lower"), "codes"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the error of all rows of equal label, nulls together."""
    by = codes.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return codes.join(by, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def code_text(column: str = "code") -> F.Column:
    """Two hex digits a part."""
    return F.lower(F.hex(column))


def decoded(codes: DataFrame, books: Books) -> DataFrame:
    """codes with embedding: the entries that a code names, scaled back."""
    workers_find_package(codes.sparkSession)
    entries = books.entries
    told = codes.toDF(*(f"c{k}" for k in range(len(codes.columns))))  # names may hold dots and backticks
    schema = StructType([*told.schema.fields, StructField("embedding", ArrayType(DoubleType()))])
    place = codes.columns.index("code")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(place).to_pylist()), np.uint8).reshape(batch.num_rows, PARTS)
            v = entries[np.arange(PARTS), code].reshape(batch.num_rows, -1) / SCALE
            yield pa.record_batch([*batch.columns, pa.array(v.tolist(), pa.list_(pa.float64()))], names=schema.names)

    return told.mapInArrow(task, schema).toDF(*codes.columns, "embedding")
