"""Vectors against a stated set of others, block by block, where a figure of each pair is folded at once; means of vectors named by keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks

#: Rows of a task that are held at once, marks of a block, and cosines that are held at once.
SHARD_ROWS, MARK_ROWS, CELLS = 20_000, 1024, 1 << 22
#: Below every cosine: of pairs with a vector that has none, and of a vector and itself.
UNKNOWN, ITSELF = -2.0, -3.0


def width_of(df: DataFrame, vector: str) -> int:
    """The length that most vectors have that are not null and hold no nulls; of equals the smaller."""
    fine = df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    size = fine.groupBy(F.size(vector).alias("__n")).count().orderBy(F.desc("count"), "__n").select("__n").first()
    return size[0] if size else 0


def fitting(vector: str, width: int) -> Column:
    """The vector if it has this width and no nulls, else null."""
    return F.when((F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull()), F.transform(vector, lambda x: x.cast("double")))


def _unit(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows to length one, without numbers where there is no vector."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    known = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.full((len(column), width), np.nan)
    if known.any():
        out[known] = blocks.unit_rows(blocks.matrix(column.drop_null()))
    return out


def _laid(df: DataFrame, width: int) -> DataFrame:
    return df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), "label", fitting("v", width).alias("v"))


def best_by_label(own: DataFrame, marks: DataFrame) -> DataFrame:
    """(label, likeness): the best cosine of each label's vectors to a mark other than themselves.

    own, marks: vec_id, label, v. A vector of length nought has the cosine 0. A label none of whose pairs
    has a cosine is told with null.
    """
    width = width_of(own, "v")
    every = blocks.stored(_laid(marks, width), "marks", MARK_ROWS)

    def task(batches):  # noqa: ANN001, ANN202
        for t in blocks.shards(batches, SHARD_ROWS):
            code, names = pd.factorize(t.column("label").to_pandas(), use_na_sentinel=False)
            order = np.argsort(code, kind="stable")
            ids, x = t.column("id").to_numpy()[order], _unit(t.column("v"), width)[order]
            starts = np.searchsorted(code[order], np.arange(len(names)))
            best = np.full(len(names), ITSELF)
            for b in every:
                m, mark = _unit(b.column(2), width), b.column(0).to_numpy()
                step = max(1, CELLS // max(1, len(mark)))
                top = np.full(len(ids), ITSELF)
                for k in range(0, len(ids), step):
                    c = np.nan_to_num(x[k : k + step] @ m.T, nan=UNKNOWN)
                    c[ids[k : k + step, None] == mark[None, :]] = ITSELF
                    top[k : k + step] = c.max(1)
                best = np.maximum(best, np.maximum.reduceat(top, starts))
            yield pa.record_batch([pa.array(pd.Series(names), from_pandas=True).cast(t.schema.field("label").type), pa.array(best)], names=["label", "best"])

    kind = own.schema["label"].dataType.simpleString()
    best = _laid(own, width).mapInArrow(task, f"label {kind}, best double").groupBy("label").agg(F.max("best").alias("best")).where(F.col("best") > ITSELF)
    return best.select("label", F.when(F.col("best") > UNKNOWN, F.least("best", F.lit(1.0))).alias("likeness"))


def kin_places(own: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, place): of each asked vector that has a kin the place of the nearest one of its label among all others, equal at nine digits.

    own, asked: vec_id, label, v. Two passes keep one row a query and shard: the best kin, and how many are nearer.
    """
    width = width_of(own, "v")
    laid = _laid(own, width).where("v is not null")

    def passed(queries: DataFrame, name: str, fold, out: str) -> DataFrame:  # noqa: ANN001
        every = blocks.stored(queries, name, MARK_ROWS)

        def task(batches):  # noqa: ANN001, ANN202
            for t in blocks.shards(batches, SHARD_ROWS):
                label = t.column("label").to_pandas()
                ids, x = t.column("id").to_numpy(), _unit(t.column("v"), width)
                for b in every:
                    codes = pd.factorize(pd.concat((label, b.column(1).to_pandas())))[0]
                    got = fold(ids, x, codes[: len(ids)], b, codes[len(ids) :])
                    yield pa.record_batch([b.column(0), pa.array(got)], names=["q", out])

        return laid.mapInArrow(task, f"q long, {out} {'double' if out == 'best' else 'long'}")

    def best_kin(ids, x, theirs, b, mine):  # noqa: ANN001, ANN202
        q, m, best = b.column(0).to_numpy(), _unit(b.column(2), width), np.full(b.num_rows, UNKNOWN)
        for c in np.unique(mine[mine >= 0]):
            at, rows = np.flatnonzero(mine == c), np.flatnonzero(theirs == c)
            for k in range(0, len(rows), step := max(1, CELLS // len(at))):
                s = np.round(m[at] @ x[rows[k : k + step]].T, 9)
                s[q[at][:, None] == ids[rows[k : k + step]][None, :]] = UNKNOWN
                best[at] = np.maximum(best[at], s.max(1))
        return best

    def nearer(ids, x, theirs, b, mine):  # noqa: ANN001, ANN202
        m, best, n = _unit(b.column(2), width), b.column(3).to_numpy()[:, None], np.zeros(b.num_rows, np.int64)
        known = np.flatnonzero(theirs >= 0)
        for k in range(0, len(known), step := max(1, CELLS // b.num_rows)):
            rows = known[k : k + step]
            s = m @ x[rows].T
            # the few that rounding decides are rounded
            near = s > best + 4e-10
            i, j = np.nonzero(near)
            over = (np.round(s[i, j], 9) > best[i, 0]) & (theirs[rows[j]] != mine[i])
            n += np.bincount(i[over], minlength=len(n))
        return n

    queries = _laid(asked, width).where("v is not null and label is not null")
    best = passed(queries, "asked", best_kin, "best").groupBy("q").agg(F.max("best").alias("best")).where(F.col("best") > UNKNOWN)
    told = queries.join(best.withColumnRenamed("q", "id"), "id").select("id", "label", "v", "best")
    return passed(told, "asked-again", nearer, "nearer").groupBy("q").agg((1 + F.sum("nearer")).alias("place"))


# --- means ---

#: Pairs that are held at once, and vectors of a block.
PAIR_ROWS, VECTOR_ROWS = 200_000, 20_000


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of any length as rows with noughts after their ends, and which places they have."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    at = np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    x, has = np.zeros((len(column), width)), np.zeros((len(column), width))
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    x[at] = np.where(known, flat.to_numpy(zero_copy_only=False).astype(float), 0.0)
    has[at] = known
    return x, has


def means(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(item_id, length, first) of the mean of the vectors that each item names: its length and first component.

    pairs (item_id, vec_id), each once; vectors (vec_id, v). Only keys are shuffled; a task has the pairs of
    its items in order and adds up vectors as it reads them in blocks. A component is averaged over the
    vectors that have it. Items that name no vector have no row.
    """
    known = vectors.where("vec_id is not null and v is not null")
    width = known.agg(F.max(F.size("v"))).first()[0] or 0
    every = blocks.stored(known.select(F.col("vec_id").cast("long").alias("id"), "v"), "vectors", VECTOR_ROWS)

    def told(items: np.ndarray, x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        some = (n > 0).any(1)
        m = x[some] / np.maximum(n[some], 1)
        first = np.where(n[some][:, 0] > 0, m[:, 0], np.nan)
        return pa.record_batch([pa.array(items[some]), pa.array(np.sqrt((m * m).sum(1))), pa.array(first, from_pandas=True)], names=["item_id", "length", "first"])

    def task(batches):  # noqa: ANN001, ANN202
        rest = None
        for t in blocks.shards(batches, PAIR_ROWS):
            item, vec = t.column("item_id").to_numpy(), t.column("vec_id").to_numpy()
            items, at = np.unique(item, return_inverse=True)
            x, n = np.zeros((len(items), width)), np.zeros((len(items), width))
            order = np.argsort(vec, kind="stable")
            ordered = vec[order]
            for b in every:
                ids, own = np.unique(b.column(0).to_numpy(), return_inverse=True)
                v, has = _padded(b.column(1), width)
                if len(ids) < len(own):
                    sums = np.zeros((2, len(ids), width))
                    np.add.at(sums[0], own, v)
                    np.add.at(sums[1], own, has)
                    v, has = sums
                else:
                    v, has = v[np.argsort(own)], has[np.argsort(own)]
                a, z = np.searchsorted(ordered, ids[0]), np.searchsorted(ordered, ids[-1], "right")
                place = np.minimum(np.searchsorted(ids, ordered[a:z]), len(ids) - 1)
                met = np.flatnonzero(ids[place] == ordered[a:z])
                if len(met):
                    to, place = at[order[a:z][met]], place[met]
                    by = np.argsort(to, kind="stable")
                    to, place = to[by], place[by]
                    starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                    x[to[starts]] += np.add.reduceat(v[place], starts, axis=0)
                    n[to[starts]] += np.add.reduceat(has[place], starts, axis=0)
            if rest is not None:
                if rest[0][0] == items[0]:
                    x[0], n[0] = x[0] + rest[1][0], n[0] + rest[2][0]
                else:
                    yield told(*rest)
            # the last item may go on in the next shard
            yield told(items[:-1], x[:-1], n[:-1])
            rest = items[-1:], x[-1:], n[-1:]
        if rest is not None:
            yield told(*rest)

    laid = pairs.where("item_id is not null and vec_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("vec_id").cast("long").alias("vec_id"))
    return laid.repartition("item_id").sortWithinPartitions("item_id").mapInArrow(task, "item_id long, length double, first double")
