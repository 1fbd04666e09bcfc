"""Asked works against all works of other sources: the mean of shared words, sizes and prices.

Works of equal words and size are a group. The words and sizes of two groups bound how like their works
can be, so that a group is looked into only while it can hold what is sought; in those that can, every
price is compared. Asked works lie in the shared folder in blocks, and a task goes over its own works in
shards, so that neither side need fit into one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blocks

#: Works of a shard, asked works of a block, and pairs whose likeness is held at once.
SHARD_ROWS, ASKED_ROWS, CELLS = 100_000, 50_000, 1 << 20
#: Scores below every likeness: of pairs whose likeness is unknown, and of pairs of one source.
UNKNOWN, FORBIDDEN = -1.0, -2.0


def _ratio(a: np.ndarray | float, b: np.ndarray) -> np.ndarray:
    """Smaller over larger; no number where either is unknown."""
    with np.errstate(all="ignore"):
        return np.where((a > 0) & (b > 0), np.minimum(a, b) / np.maximum(a, b), np.nan)


def rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e9 + 0.5) / 1e9


def _laid(items: DataFrame) -> DataFrame:
    words = F.to_json(F.array_sort(F.array_distinct("words")))
    return items.where("item_id is not null and source is not null").select("item_id", "source", "title", "type", words.alias("words"), F.col("size").cast("double").alias("size"), F.col("price").cast("double").alias("price"))


class _Grouped:
    """Works in order of their groups; starts are the groups' beginnings, words and sizes theirs."""

    def __init__(self, table: pa.Table | pa.RecordBatch) -> None:
        f = table.to_pandas()
        code, sets = pd.factorize(f.words)
        f = f.assign(code=code).sort_values(["code", "size"], kind="stable", ignore_index=True)
        new = (f.code.diff() != 0) | ~((f["size"] == f["size"].shift()) | (f["size"].isna() & f["size"].shift().isna()))
        self.starts = np.append(np.flatnonzero(new.to_numpy()), len(f))
        self.ids, self.price, self.frame = f.item_id.to_numpy(), f.price.to_numpy(float), f
        self.code, self.size = f.code.to_numpy()[self.starts[:-1]], f["size"].to_numpy(float)[self.starts[:-1]]
        self.sets = [None if s is None else set(json.loads(s)) for s in sets]

    def like(self, at: np.ndarray, whole: np.ndarray, price: np.ndarray) -> np.ndarray:
        """Likeness of rows at these places, whose groups' words and sizes add up to `whole`, to asked prices (rows of the result)."""
        return (whole[None, :] + _ratio(price[:, None], self.price[at][None, :])) / 3


def _met(shard: _Grouped, asked: _Grouped) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, whole) of each group of asked works: the sum of words and sizes that each group of the shard has with it."""
    sizes = np.array([0 if s is None else len(s) for s in shard.sets], float)
    known = np.array([s is not None for s in shard.sets], bool)
    lists: dict[str, list[int]] = {}
    for k, s in enumerate(shard.sets):
        for w in s or ():
            lists.setdefault(w, []).append(k)
    lists = {w: np.array(x) for w, x in lists.items()}
    code, words = None, None
    for g in range(len(asked.code)):
        if asked.code[g] != code:
            code, own = asked.code[g], asked.sets[asked.code[g]] if asked.code[g] >= 0 else None
            if own is None:
                share = np.full(len(shard.sets), np.nan)
            else:
                both = np.zeros(len(shard.sets))
                for w in own:
                    if w in lists:
                        both[lists[w]] += 1
                with np.errstate(all="ignore"):
                    share = np.where(known, both / (sizes + len(own) - both), np.nan)
            words = np.append(share, np.nan)[shard.code]  # works without words have the code -1
        yield asked.starts[g], asked.starts[g + 1], words + np.nan_to_num(_ratio(asked.size[g], shard.size), nan=0.0)


def _pieces(shard: _Grouped, groups: np.ndarray, whole: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, whole) of the rows of these groups, at most so many at once."""
    n = shard.starts[groups + 1] - shard.starts[groups]
    at = np.repeat(shard.starts[groups] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    sums = np.repeat(whole[groups], n)
    for k in range(0, len(at), most):
        yield at[k : k + most], sums[k : k + most]


def likest(items: DataFrame, asked: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """(asked, other, likeness): the likest work of another source of each asked one; equal at nine digits: the smaller key.

    items, asked: item_id (distinct), source, title, type, words, size, price. Of works all of whose likenesses are
    unknown the likeness is null. An asked work without works of other sources has no row.
    """
    every = blocks.stored(_laid(asked), "asked", ASKED_ROWS)

    def task(batches):  # noqa: ANN001, ANN202
        for table in blocks.shards(batches, rows):
            shard = _Grouped(table)
            for block in every:
                own = _Grouped(block)
                codes = pd.factorize(pd.concat((shard.frame.source, own.frame.source)))[0]
                theirs, mine = codes[: len(shard.ids)], codes[len(shard.ids) :]
                best, other, told = np.full(len(own.ids), FORBIDDEN), np.full(len(own.ids), np.iinfo(np.int64).max), np.full(len(own.ids), np.nan)
                for a, b, whole in _met(shard, own):
                    most = rounded((whole + 1) / 3)
                    most = np.where(np.isnan(most), UNKNOWN, most)
                    order, k, step = np.argsort(-most, kind="stable"), 0, 1
                    while k < len(order) and most[order[k]] >= best[a:b].min():
                        for at, sums in _pieces(shard, order[k : k + step], whole, max(1, CELLS // (b - a))):
                            x = shard.like(at, sums, own.price[a:b])
                            score = np.where(np.isnan(x), UNKNOWN, rounded(x))
                            score[theirs[at][None, :] == mine[a:b, None]] = FORBIDDEN
                            top = score.max(1)
                            ids = np.where(score == top[:, None], shard.ids[at][None, :], np.iinfo(np.int64).max)
                            place = ids.argmin(1)
                            first = ids[np.arange(b - a), place]
                            better = (top > best[a:b]) | ((top == best[a:b]) & (first < other[a:b]) & (top > FORBIDDEN))
                            to = a + np.flatnonzero(better)
                            best[to], other[to], told[to] = top[better], first[better], x[np.flatnonzero(better), place[better]]
                        k, step = k + step, min(2 * step, 256)
                out = best > FORBIDDEN
                yield pa.record_batch([pa.array(own.ids[out]), pa.array(best[out]), pa.array(other[out]), pa.array(told[out])], names=["asked", "score", "other", "likeness"])

    found = _laid(items).repartition("item_id").mapInArrow(task, "asked long, score double, other long, likeness double")
    best = found.groupBy("asked").agg(F.min(F.struct((-F.col("score")).alias("s"), "other", "likeness")).alias("b"))
    return best.select("asked", "b.other", F.when(-F.col("b.s") > UNKNOWN, F.col("b.likeness")).alias("likeness"))


def counted(items: DataFrame, asked: DataFrame, least: float, rows: int = SHARD_ROWS) -> DataFrame:
    """(kept, found): pairs of an asked work and one of another source at least so like, and those of them that share a block.

    A block is one title, or one type and size.
    """
    every = blocks.stored(_laid(asked), "asked", ASKED_ROWS)

    def task(batches):  # noqa: ANN001, ANN202
        kept = found = 0
        for table in blocks.shards(batches, rows):
            shard = _Grouped(table)
            for block in every:
                own = _Grouped(block)
                n = len(shard.ids)
                source, title, kind = (pd.factorize(pd.concat((shard.frame[c], own.frame[c])))[0] for c in ("source", "title", "type"))
                size = shard.frame["size"].to_numpy(float)
                for a, b, whole in _met(shard, own):
                    with np.errstate(invalid="ignore"):
                        groups = np.flatnonzero((whole + 1) / 3 >= least)
                    q = np.arange(n + a, n + b)[:, None]
                    for at, sums in _pieces(shard, groups, whole, max(1, CELLS // (b - a))):
                        with np.errstate(invalid="ignore"):
                            good = (shard.like(at, sums, own.price[a:b]) >= least) & (source[at][None, :] != source[q])
                        same = (title[at][None, :] == title[q]) & (title[q] >= 0) | (kind[at][None, :] == kind[q]) & (kind[q] >= 0) & (size[at][None, :] == own.frame["size"].iloc[a])
                        kept, found = kept + int(good.sum()), found + int((good & same).sum())
        yield pa.record_batch([pa.array([kept]), pa.array([found])], names=["kept", "found"])

    sums = _laid(items).repartition("item_id").mapInArrow(task, "kept long, found long")
    return sums.agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))
