"""A search service over a stored index and stored vectors: lines in, ordered documents out; what it orders by is learnt.

A line's candidates are the documents nearest to its vector and those that hold most of the weight of its
words. Two parts, closeness and words, are put together by weights. Learning goes in turns: a shift of the
lines' vectors that brings them nearer to what was found right, the search again, weights that order what
it found. Lines to learn from are bounded; all documents are searched in each turn.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import blocks, learnt, models, search
from .stored import StoredIndex

PARTS = ("close", "words")
#: Candidates of each part, lines that are learnt from, and steps and rate of the fits.
CANDIDATES, LINES, STEPS, RATE, SCALE = 30, 300, 300, 0.5, 0.05
#: Documents of a shard, and lines of a block.
SHARD_ROWS, LINE_ROWS = 50_000, 5_000


@dataclass(frozen=True)
class Service:
    """index: postings; vectors: (key, v) of length one, a stored table; field: the field that lines are looked for in."""

    index: StoredIndex
    vectors: DataFrame
    field: str
    shift: tuple[float, ...] = ()
    weights: tuple[float, ...] = (1.0, 0.0)
    rarity: DataFrame | None = field(default=None, compare=False)
    held: DataFrame | None = field(default=None, compare=False)

    def opened(self) -> Service:
        """The service with the rarity of each token, counted once, and each document's tokens in one row."""
        every = self.vectors.count()
        postings = self.index.postings(fields=[self.field]).where("key is not null")
        n = postings.groupBy("token").agg(F.count("*").alias("n"))
        held = postings.groupBy("key").agg(F.collect_list("token").alias("tokens"))
        return replace(self, rarity=learnt.kept(n.select("token", F.ln(1 + F.lit(float(every)) / F.col("n")).alias("x")), "rarity"), held=learnt.kept(held, "held-tokens"))

    def moved(self, v: Column) -> Column:
        return F.zip_with(v, F.array(*map(F.lit, self.shift)), lambda a, b: a + b) if self.shift else v

    def by_words(self, lines: DataFrame) -> DataFrame:
        """(asked, key, words): the share of a line's weight that a document's words have, for the best CANDIDATES of each line.

        lines (asked, line). A task adds up a line's weights over the lists of its own documents and passes on the best, so that
        no row is made of a line and a document that share a word.
        """
        own = lines.select("asked", F.explode(F.array_distinct(search.tokens(F.col("line")))).alias("token")).join(self.rarity, "token")
        own = own.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("token", "x"))).alias("w")).select(F.col("asked").cast("long").alias("asked"), F.col("w.token").alias("token"), F.col("w.x").alias("x"))
        every = blocks.stored(own, "lines", LINE_ROWS)

        def task(batches):  # noqa: ANN001, ANN202
            for t in blocks.shards(batches, SHARD_ROWS):
                t = t.sort_by("key")
                keys, lists = t.column("key").to_numpy(), t.column("tokens").combine_chunks()
                at = np.repeat(np.arange(len(keys)), np.diff(lists.offsets.to_numpy()))
                code, tokens = pd.factorize(lists.flatten().to_pandas())
                at, starts = at[np.argsort(code, kind="stable")], np.append(0, np.cumsum(np.bincount(code, minlength=len(tokens))))
                known = {w: k for k, w in enumerate(tokens)}
                for b in every:
                    out = []
                    for asked, words, xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                        met = [(at[starts[known[w]] : starts[known[w] + 1]], x) for w, x in zip(words, xs, strict=True) if w in known]
                        if met:
                            out.append((asked, *_best_of(np.concatenate([a for a, _ in met]), np.repeat([x for _, x in met], [len(a) for a, _ in met]), len(keys), sum(xs))))
                    if out:
                        n = [len(rows) for _, rows, _ in out]
                        yield pa.record_batch([pa.array(np.repeat([a for a, _, _ in out], n)), pa.array(keys[np.concatenate([r for _, r, _ in out])]), pa.array(np.concatenate([w for _, _, w in out]))], names=["asked", "key", "words"])

        found = self.held.select(F.col("key").cast("long").alias("key"), "tokens").mapInArrow(task, "asked long, key long, words double")
        place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("words"), "key"))
        return found.withColumn("place", place).where(F.col("place") <= CANDIDATES).drop("place")

    def candidates(self, lines: DataFrame) -> DataFrame:
        """(asked, key, close, words) of what either part finds; lines (asked, line, v)."""
        shifted = lines.select(F.col("asked").alias("key"), self.moved(F.col("v")).alias("v"))
        near = models.nearest(self.vectors, "key", "v", shifted, CANDIDATES, digits=12, itself=True).select("asked", F.col("near").alias("key"))
        both = near.join(self.by_words(lines), ["asked", "key"], "full_outer")
        doc = self.vectors.select("key", F.col("v").alias("d"))
        line = shifted.select(F.col("key").alias("asked"), F.col("v").alias("q"))
        close = F.aggregate(F.zip_with("q", "d", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))
        told = both.join(doc, "key").join(line, "asked")
        return told.select("asked", "key", F.when(length > 0, close / length).otherwise(0.0).alias("close"), F.coalesce("words", F.lit(0.0)).alias("words"))

    def ordered(self, found: DataFrame) -> DataFrame:
        """found with score and place: the best first, of equals the smaller key."""
        score = sum((F.col(p) * w for p, w in zip(PARTS[1:], self.weights[1:], strict=True)), F.col(PARTS[0]) * self.weights[0])
        place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc(F.round("score", 9)), "key"))
        return found.withColumn("score", score).withColumn("place", place)

    def search(self, lines: DataFrame) -> DataFrame:
        """(asked, key, close, words, score, place) of every line."""
        return self.ordered(self.candidates(lines))


def _best_of(rows: np.ndarray, weights: np.ndarray, n: int, whole: float) -> tuple[np.ndarray, np.ndarray]:
    """The CANDIDATES rows of n with the largest sums of weights, and the sums as shares; of equal ones the first rows."""
    if len(rows) < n // 8:
        rows, to = np.unique(rows, return_inverse=True)
        sums = np.bincount(to, weights, len(rows)) / whole
    else:
        sums = np.bincount(rows, weights, n) / whole
        rows = np.arange(n)
    least = np.partition(sums, len(sums) - CANDIDATES)[len(sums) - CANDIDATES] if len(sums) > CANDIDATES else 0.0
    some = np.flatnonzero((sums >= least) & (sums > 0))
    some = some[np.lexsort((rows[some], -sums[some]))][:CANDIDATES]
    return rows[some], sums[some]


def same_class(lines: DataFrame, documents: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What tells of found rows (asked, key) whether they are right: those of one class, of lines (asked, class) and documents (key, class).

    Lines and documents of a class are never paired off, as those of a common one are many.
    """

    def right(found: DataFrame) -> DataFrame:
        told = found.join(documents.select("key", F.col("class").alias("__own")), "key", "left").join(lines.select("asked", F.col("class").alias("__asked")), "asked", "left")
        return told.withColumn("good", F.coalesce(F.col("__own") == F.col("__asked"), F.lit(False))).drop("__own", "__asked")

    return right


def mean_reciprocal(ordered: DataFrame, right: Callable[[DataFrame], DataFrame], asked: DataFrame) -> float:
    """Of the asked lines the mean of 1 / place of the first right document, 0 where none was found."""
    first = right(ordered).where("good").groupBy("asked").agg(F.min("place").alias("place"))
    got = asked.select("asked").join(first, "asked", "left").agg(F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0)))).first()[0]
    return float(got or 0.0)


def learn(service: Service, lines: DataFrame, right: Callable[[DataFrame], DataFrame], turns: int = 2) -> list[Service]:
    """The service as it was, and after each turn.

    lines (asked, line, v) to learn from, and right, which marks found rows as good; of more than LINES lines those of the
    smallest hashes are taken. A line that has no right document among its candidates teaches nothing in that turn.
    """
    some = learnt.kept(lines.orderBy(F.md5(F.col("asked").cast("string")), "asked").limit(LINES), "learnt-lines")
    out = [service]
    for _ in range(turns):
        own = out[-1]
        found = right(own.candidates(some)).join(own.vectors.select("key", F.col("v").alias("d")), "key").join(some.select("asked", "v"), "asked")
        rows = found.select("asked", "v", "d", "good").toPandas().sort_values("asked")
        if rows.good.any():
            q, d, good, line = np.stack(rows.v.to_numpy()), np.stack(rows.d.to_numpy()), rows.good.to_numpy(), rows.asked.to_numpy()
            b, o = _pairs(good, line)
            s = np.array(own.shift or np.zeros(q.shape[1]))
            for _ in range(STEPS):
                # a pair's slope goes to its two rows, so that no vector is made of a pair
                r = ((q + s) * d).sum(1)
                g = models.sigmoid((r[o] - r[b]) / SCALE)
                s = s + 0.02 * (d.T @ (np.bincount(b, g, len(d)) - np.bincount(o, g, len(d))) / max(1, len(b)) - 0.01 * s)
            own = replace(own, shift=tuple(map(float, s)))
        found = right(own.candidates(some)).select("asked", *PARTS, "good")
        rows = found.toPandas().sort_values("asked")
        if rows.good.any() and not rows.good.all():
            x, (b, o) = rows[list(PARTS)].to_numpy(float), _pairs(rows.good.to_numpy(), rows.asked.to_numpy())
            w = np.array(own.weights)
            for t in range(STEPS):
                away = (x[b] - x[o]) / SCALE
                w = models.on_simplex(w + RATE / np.sqrt(t + 1) * (away * models.sigmoid(-away @ w)[:, None]).mean(0) * SCALE)
            own = replace(own, weights=tuple(map(float, w)))
        out.append(own)
    return out


def _pairs(good: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a right and a wrong document of the same line."""
    b, o = [], []
    for k in np.unique(line):
        own = np.flatnonzero(line == k)
        yes, no = own[good[own]], own[~good[own]]
        b.append(np.repeat(yes, len(no)))
        o.append(np.tile(no, len(yes)))
    return np.concatenate(b), np.concatenate(o)
