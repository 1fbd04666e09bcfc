"""Fitted models: ranking, suggestions, pairs. Fits run on bounded samples on the driver, scores everywhere."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import blocks

#: Rows that a fit on the driver reads at most; chosen by hash of the key.
SAMPLE = 20_000
#: Labelled rows that ranking models, curves of one or two weights, and models of values are fitted on, at most.
RANKED_ROWS, CURVE_ROWS, VALUE_ROWS = 400, 2000, 1000


def bounded(df: DataFrame, key: str, most: int = SAMPLE) -> pd.DataFrame:
    """At most `most` rows, the same ones each time, in order of the key."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(most).toPandas().sort_values(key).reset_index(drop=True)


def lbfgs(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 300, tol: float = 1e-4, memory: int = 10) -> np.ndarray:
    """Minimum of a smooth function by limited-memory quasi-Newton steps that are halved until they help."""
    x, s, y = start.astype(float).copy(), [], []
    value, grad = loss(x)
    for _ in range(steps):
        if np.abs(grad).max() < tol:
            break
        q, alphas = grad.copy(), []
        for a, b in zip(reversed(s), reversed(y), strict=True):
            alphas.append(a @ q / (a @ b))
            q -= alphas[-1] * b
        if s:
            q *= s[-1] @ y[-1] / (y[-1] @ y[-1])
        for (a, b), alpha in zip(zip(s, y, strict=True), reversed(alphas), strict=True):
            q += a * (alpha - b @ q / (a @ b))
        step, slope = 1.0, grad @ q
        while step > 1e-10:
            new, new_grad = loss(x - step * q)
            if new <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        dx, dg = -step * q, new_grad - grad
        if dx @ dg > 1e-12:
            s, y = [*s, dx][-memory:], [*y, dg][-memory:]
        x, value, grad = x + dx, new, new_grad
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def ranking_pairs(grades: np.ndarray, works: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Better and worse rows of pairs of different works, and rows of equal pairs within a work."""
    better, worse = np.nonzero((grades[:, None] > grades[None, :]) & (works[:, None] != works[None, :]))
    one, other = np.nonzero(np.triu(works[:, None] == works[None, :], 1))
    return better, worse, one, other


def pairwise_loss(z: np.ndarray, pairs: tuple[np.ndarray, ...]) -> tuple[float, np.ndarray]:
    """Logistic loss of ordered pairs, with equal pairs pulled together; and its gradient by row."""
    b, w, i, j = pairs
    weight = 2 * len(b) / max(1, len(z)) if len(i) else 0.0
    d, e = z[b] - z[w], z[i] - z[j]
    loss = np.logaddexp(0, -d).sum() + 0.5 * weight * (np.logaddexp(0, -e) + np.logaddexp(0, e)).sum()
    gd, ge = -sigmoid(-d), 0.5 * weight * (sigmoid(e) - sigmoid(-e))
    n = len(z)
    return loss, np.bincount(b, gd, n) - np.bincount(w, gd, n) + np.bincount(i, ge, n) - np.bincount(j, ge, n)


def fit_pairwise(x: np.ndarray, grades: np.ndarray, works: np.ndarray, c: float = 0.1) -> np.ndarray:
    pairs = ranking_pairs(grades, works)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, dz = pairwise_loss(x @ w, pairs)
        return value + w @ w / (2 * c), x.T @ dz + w / c

    return lbfgs(loss, np.zeros(x.shape[1]))


def arc_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|x||y|(sin t + (π - t) cos t) / π."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    cos = np.clip(a @ b.T / np.maximum(np.outer(na, nb), 1e-12), -1, 1)
    t = np.arccos(cos)
    return np.outer(na, nb) * (np.sin(t) + (np.pi - t) * cos) / np.pi


def fit_kernel(x: np.ndarray, grades: np.ndarray, works: np.ndarray, c: float = 0.1) -> np.ndarray:
    k, pairs = arc_cosine(x, x), ranking_pairs(grades, works)

    def loss(a: np.ndarray) -> tuple[float, np.ndarray]:
        z = k @ a
        value, dz = pairwise_loss(z, pairs)
        return value + a @ z / (2 * c), k @ (dz + a / c)

    return lbfgs(loss, np.zeros(len(x)))


def fit_factorization(x: np.ndarray, grades: np.ndarray, works: np.ndarray, rank: int = 8, c: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Linear weights and factors of a machine of this rank."""
    d, pairs = x.shape[1], ranking_pairs(grades, works)
    start = np.concatenate((np.zeros(d), 0.01 * np.random.default_rng(1).normal(size=d * rank)))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, v = p[:d], p[d:].reshape(d, rank)
        xv, x2 = x @ v, x * x
        value, dz = pairwise_loss(x @ w + 0.5 * ((xv**2).sum(1) - x2 @ (v**2).sum(1)), pairs)
        dv = x.T @ (dz[:, None] * xv) - (x2.T @ dz)[:, None] * v
        return value + p @ p / (2 * c), np.concatenate((x.T @ dz, dv.ravel())) + p / c

    p = lbfgs(loss, start, 150)
    return p[:d], p[d:].reshape(d, rank)


def factorization_scores(x: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return x @ w + 0.5 * (((x @ v) ** 2).sum(1) - (x * x) @ (v**2).sum(1))


def fit_boosting(x: np.ndarray, grades: np.ndarray, works: np.ndarray, trees: int = 25, depth: int = 3, rate: float = 0.1, share: float = 0.3, least: int = 3) -> list[dict]:
    """Trees with Newton leaves on the pairwise loss; each tree reads a share of the features."""
    pairs, rng, z, out = ranking_pairs(grades, works), np.random.default_rng(1), np.zeros(len(x)), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int, columns: np.ndarray) -> dict:
        leaf = {"value": -rate * g[rows].sum() / (h[rows].sum() + 1)}
        if not left or len(rows) < 2 * least:
            return leaf
        best, base = (1e-9, None, None), g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in columns:
            order = rows[np.argsort(x[rows, f], kind="stable")]
            gs, hs = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
            gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - base
            gain[: least - 1] = gain[len(gain) - least + 1 :] = -1
            gain[x[order[1:], f] == x[order[:-1], f]] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = gain[k], f, (x[order[k], f] + x[order[k + 1], f]) / 2
        if best[1] is None:
            return leaf
        low = x[rows, best[1]] <= best[2]
        return {"feature": int(best[1]), "at": float(best[2]), "low": grow(rows[low], g, h, left - 1, columns), "high": grow(rows[~low], g, h, left - 1, columns)}

    for _ in range(trees):
        _, g = pairwise_loss(z, pairs)
        b, w = pairs[0], pairs[1]
        p = sigmoid(z[b] - z[w])
        h = np.bincount(b, p * (1 - p), len(x)) + np.bincount(w, p * (1 - p), len(x))
        tree = grow(np.arange(len(x)), g, h, depth, rng.choice(x.shape[1], max(1, round(share * x.shape[1])), replace=False))
        out.append(tree)
        z += tree_scores(x, [tree])
    return out


def tree_scores(x: np.ndarray, trees: list[dict]) -> np.ndarray:
    def walk(node: dict, rows: np.ndarray, out: np.ndarray) -> None:
        if "value" in node:
            out[rows] += node["value"]
            return
        low = x[rows, node["feature"]] <= node["at"]
        walk(node["low"], rows[low], out)
        walk(node["high"], rows[~low], out)

    out = np.zeros(len(x))
    for tree in trees:
        walk(tree, np.arange(len(x)), out)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, firth: bool = False, count: np.ndarray | None = None) -> np.ndarray:
    """Newton steps on a logistic loss; the first column is a constant without penalty. firth: bias-reduced. count: how often each row stands."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 0
    n = np.ones(len(x)) if count is None else count.astype(float)
    for _ in range(50):
        p = sigmoid(x @ w)
        v = p * (1 - p)
        h = (x * (n * v)[:, None]).T @ x + np.diag(penalty + 1e-9)
        target = y - p
        if firth:
            target = target + np.einsum("ij,jk,ik->i", x, np.linalg.inv(h), x) * v * (0.5 - p)
        step = np.linalg.solve(h, x.T @ (n * target) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def platt(z: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Shift and slope of sigmoid(shift + slope·z) with Platt's targets; None with one class."""
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return None
    return fit_logistic(np.stack((np.ones(len(z)), z), 1), np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), ridge=1e-6)


def on_simplex(y: np.ndarray, total: float = 1.0) -> np.ndarray:
    """Nearest point of non-negative parts that sum to total."""
    u = np.sort(y)[::-1]
    over = (np.cumsum(u) - total) / np.arange(1, len(y) + 1)
    k = np.flatnonzero(u > over)[-1]
    return np.maximum(y - over[k], 0)


def same_length(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, holds no nulls, and has the length that most have (of equals the smaller)."""
    fine = df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    size = fine.groupBy(F.size(vector).alias("__n")).count().orderBy(F.desc("count"), "__n").select("__n").first()
    return fine.where(F.size(vector) == (size[0] if size else 0))


def moments(df: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the vectors of all rows that same_length keeps; a task sums its own, the sums are added by place."""
    df = same_length(df, column)
    mean = df.select(F.posexplode(column).alias("k", "x")).groupBy("k").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("k").toPandas().x.to_numpy()
    d = len(mean)

    def task(batches):  # noqa: ANN001, ANN202
        cov, n = np.zeros((d, d)), 0
        for b in batches:
            if len(b):
                x = np.stack(b[column].to_numpy()).astype(float) - mean
                cov += x.T @ x
                n += len(b)
        if n:
            yield pd.DataFrame({"k": range(d * d + 1), "x": [*cov.ravel(), n]})

    sums = df.select(column).mapInPandas(task, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").toPandas().x.to_numpy()
    return mean, (sums[:-1] / sums[-1]).reshape(d, d) if len(sums) else np.zeros((d, d))


def principal(cov: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions of most variance, each with its greatest part positive, and the spread along each."""
    value, q = np.linalg.eigh(cov)
    value, q = value[::-1][:count], q[:, ::-1][:, :count]
    q = q * np.sign(q[np.abs(q).argmax(0), np.arange(q.shape[1])])
    return q, np.sqrt(np.maximum(value, 0))


def ridge_solve(a: np.ndarray, b: np.ndarray, penalty: float, steps: int = 200) -> np.ndarray:
    """(AᵀA + penalty)x = Aᵀb by conjugate gradients with a diagonal preconditioner."""
    m = 1 / ((a * a).sum(0) + penalty)
    x = np.zeros(a.shape[1])
    r = a.T @ b
    z = m * r
    p = z.copy()
    for _ in range(steps):
        q = a.T @ (a @ p) + penalty * p
        if r @ z < 1e-18:
            break
        step = r @ z / (p @ q)
        x, new = x + step * p, r - step * q
        z_new = m * new
        p = z_new + (new @ z_new) / (r @ z) * p
        r, z = new, z_new
    return x


def least_absolute(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Non-negative weights of least absolute error, by reweighted squares and coordinate steps."""
    w = np.full(x.shape[1], max(1e-6, y.sum() / max(1e-9, x.sum())))
    for _ in range(rounds):
        v = 1 / np.maximum(np.abs(y - x @ w), 1e-6)
        for j in range(len(w)):
            r = y - x @ w + x[:, j] * w[j]
            w[j] = max(0.0, (v * x[:, j]) @ r / max(1e-12, (v * x[:, j]) @ x[:, j]))
    return w


def least_absolute_of_all(df: DataFrame, features: str, size: int, y: str, rounds: int = 50) -> np.ndarray:
    """least_absolute() over all rows: each round reads only sums of weighted products. df should be kept."""
    x = [F.col(features)[k] for k in range(size)]
    total = df.agg(F.sum(y), F.sum(sum(x[1:], x[0]))).first()
    w = np.full(size, max(1e-6, float(total[0] or 0) / max(1e-9, float(total[1] or 0))))
    for _ in range(rounds):
        rest = F.col(y)
        for k in range(size):
            rest = rest - x[k] * float(w[k])
        v = 1 / F.greatest(F.abs(rest), F.lit(1e-6))
        sums = df.withColumn("__v", v).agg(*(F.sum(F.col("__v") * a * b) for a in x for b in [*x, F.col(y)])).first()
        g = np.array([t or 0.0 for t in sums], float).reshape(size, size + 1)
        for j in range(size):
            w[j] = max(0.0, (g[j, -1] - g[j, :-1] @ w + g[j, j] * w[j]) / max(1e-12, g[j, j]))
    return w


def scored(df: DataFrame, key: str, features: str, score: Callable[[np.ndarray], np.ndarray], out: str = "score") -> DataFrame:
    """key and score of every row that same_length keeps; the model travels in the closure, rows in Arrow batches."""

    def task(batches):  # noqa: ANN001, ANN202
        for b in batches:
            x = np.stack(b[features].to_numpy()) if len(b) else np.zeros((0, 1))
            yield pd.DataFrame({key: b[key], out: score(x.astype(float)) if len(b) else np.zeros(0)})

    return same_length(df.select(key, features), features).mapInPandas(task, f"{key} long, {out} double")


#: Asked rows that a task holds against its own at once, rows of a shard, and how many of them are met at once.
ASKED_BLOCK, SHARD_ROWS, TILE = 1024, 40_000, 4096


class Best:
    """The k best of each row so far, by score, of equal scores the smaller key. Scores below what is kept are passed over."""

    def __init__(self, rows: int, k: int) -> None:
        self.k, self.least = k, np.full(rows, -np.inf)
        self.row, self.key, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, row: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        row, key, score = np.append(self.row, row), np.append(self.key, key), np.append(self.score, score)
        by = np.lexsort((key, -score, row))
        row, key, score = row[by], key[by], score[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.least[row[last]] = score[last]
        own = place < self.k
        self.row, self.key, self.score = row[own], key[own], score[own]


def nearest(df: DataFrame, key: str, vector: str, asked: DataFrame, k: int, digits: int = 15, itself: bool = False) -> DataFrame:
    """(asked, near, cosine, place): the k nearest others of each asked row; equal at so many digits: the smaller key.

    itself: whether a row of the asked key may be near, as where keys of lines and of rows mean different things.

    asked is a stated set of queries. It is written to the shared folder, and every task reads it in
    blocks; a task keeps k a query and shard, so that what is ranked in the end is k a query and shard.
    Rows whose vector is null, holds nulls or has another length than most take no part.
    """
    df = same_length(df.where(F.col(key).isNotNull()), vector)
    size = df.select(F.size(vector)).first()
    size = size[0] if size else 0
    asked = asked.where(F.col(key).isNotNull() & ~F.exists(vector, lambda x: x.isNull()) & (F.size(vector) == size))
    every = blocks.stored(asked.select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("v is not null"), "asked", ASKED_BLOCK)
    slack = 10.0**-digits

    def unit(column):  # noqa: ANN001, ANN202
        x = blocks.matrix(column)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def task(batches):  # noqa: ANN001, ANN202
        for t in blocks.shards(batches, SHARD_ROWS):
            x, near = unit(t.column(1)), t.column(0).to_numpy()
            for b in every:
                ids, q = b.column(0).to_numpy(), unit(b.column(1))
                best = Best(len(ids), k)
                for at in range(0, len(near), TILE):
                    s, own = q @ x[at : at + TILE].T, near[at : at + TILE]
                    least = best.least
                    if at == 0 and len(own) > k + 1:
                        # one more than k, as a row may meet itself
                        least = np.partition(s, len(own) - k - 1, axis=1)[:, len(own) - k - 1] - slack
                    i, j = np.nonzero(s >= (least - slack)[:, None])
                    score, others = np.round(s[i, j], digits), own[j]
                    if not itself:
                        other = others != ids[i]
                        i, others, score = i[other], others[other], score[other]
                    best.add(i, others, score)
                yield pa.record_batch([pa.array(ids[best.row]), pa.array(best.key), pa.array(best.score)], names=["asked", "near", "cosine"])

    found = df.select(F.col(key).cast("long").alias("key"), vector).mapInArrow(task, "asked long, near long, cosine double")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("cosine"), "near"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def commonest_of_others(df: DataFrame, context: Sequence[str], facet: str, out: str, told: Sequence[str] | None = None) -> DataFrame:
    """df with `out`: the commonest value of a facet among other rows of the same context, null where there are none.

    Rows are counted under the columns `told` (`context` if not given), which name what a row has, while `context` may hold
    what was predicted of it. Ties go to the larger value; null facets count for nothing. Counts are joined as one row a
    context, as wide as the facet has values; a row's own value is taken off by expression.
    """
    told = list(told or context)
    counts = df.where(F.col(facet).isNotNull()).groupBy(*told, facet).agg(F.count("*").alias("__n"))
    lists = counts.groupBy(*(F.col(t).alias(c) for t, c in zip(told, context, strict=True))).agg(F.collect_list(F.struct(F.col("__n").alias("n"), F.col(facet).alias("v"))).alias("__counts"))
    same = reduce(lambda a, b: a & b, (F.col(t).eqNullSafe(F.col(c)) for t, c in zip(told, context, strict=True)))
    best = F.array_max(F.transform("__counts", lambda x: F.struct((x["n"] - (same & x["v"].eqNullSafe(F.col(facet))).cast("long")).alias("n"), x["v"].alias("v"))))
    return df.join(lists, list(context), "left").withColumn("__best", best).withColumn(out, F.when(F.col("__best.n") > 0, F.col("__best.v"))).drop("__counts", "__best")
