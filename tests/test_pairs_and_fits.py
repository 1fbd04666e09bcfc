"""Searches of pairs against all pairs, the stored index against its documents, fits against dense or sequential ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quillstack.operators import learnt, models, neighbours, pooling, pruned, stored
from quillstack.plans import pairs, search

# --- graph of neighbours ---


def test_descent_finds_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(0, 12, 500)] + 0.4 * rng.normal(size=(500, 6))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    near = lambda a, b: -F.aggregate(F.zip_with(a["v"], b["v"], lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, z: s + z)
    seeds = neighbours.near_in_order(rows, "id", F.lit(0), [F.col("v")[0]], most=100)
    graph = neighbours.descend(rows, "id", near, seeds, k=8, sampled=6)
    got = graph.edges.toPandas()
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    exact = {(i, j) for i in range(500) for j in d[i].argsort()[:8]}
    found = set(zip(got.key, got.other, strict=True))
    assert (recall := len(found & exact) / len(exact)) >= 0.9, recall
    assert len(got) == len(found) == 500 * 8 and (got.key != got.other).all()
    assert np.allclose(-got.score, d[got.key, got.other]) and graph.changed[-1] <= 0.001


def test_descent_keeps_to_what_may_be_neighbours(spark):
    """A third of the rows are alike, some have no seed, a null score forbids a pair; and no rows at all."""
    rows = spark.range(300).select("id", F.when(F.col("id") < 100, 5.0).otherwise(F.rand(1) * 10).alias("x"), (F.col("id") % 3).alias("site"))
    score = lambda a, b: F.when(a["site"] != b["site"], -F.abs(a["x"] - b["x"]))
    seeds = neighbours.near_in_order(rows, "id", F.when(F.col("id") < 290, 0), [F.col("x")], most=50)
    edges = neighbours.descend(rows, "id", score, seeds, k=5, sampled=4).edges.toPandas()
    assert (edges.key % 3 != edges.other % 3).all() and edges.groupby("key").size().max() <= 5
    assert set(edges.key) == set(range(290)) and set(edges.other) <= set(range(290))
    assert neighbours.descend(rows.limit(0), "id", score, seeds.limit(0)).edges.count() == 0


def test_vectors_of_many_directions_have_all_their_nearest(spark, tmp_path):
    """Vectors without any order among them: a descent finds some of the nearest only. Among them copies, and vectors that take no part."""
    x = np.random.default_rng(4).normal(size=(3000, 64)).astype(np.float32)
    x[5] = x[6] = x[7]
    odd = [None, [0.0] * 64, [1.0, 2.0]]
    pd.DataFrame({"vec_id": range(3003), "embedding": [*(v.tolist() for v in x), *odd], "label": 0}).to_parquet(tmp_path / "embeddings.parquet")
    got = pairs.vector_graph(spark, str(tmp_path)).toPandas().sort_values(["vec_id", "place"])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    c = np.round(u @ u.T, 9)
    np.fill_diagonal(c, -2)
    want = np.argsort(-c, 1, kind="stable")[:, :10]
    assert got.vec_id.tolist() == np.repeat(range(3000), 10).tolist() and (got.near.to_numpy().reshape(-1, 10) == want).all()


def test_seeds_of_a_hot_block(spark):
    rows = spark.range(1000).select("id", F.lit("hot").alias("b"))
    got = neighbours.near_in_order(rows, "id", F.col("b"), [F.col("id")], reach=2, most=100).toPandas()
    assert 3800 < len(got) < 4000 and got.groupby("key").size().max() == 4


# --- pairs through bounded postings ---


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
def test_pruned_pairs_are_all_pairs(spark, least):
    rng = np.random.default_rng(int(least * 10))
    sets = [sorted({f"t{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 12)) if x < 400}) for _ in range(250)] + [[], None, ["t1"], ["only", "me"]]
    rows = spark.createDataFrame([(k, s, float(1 + k % 5)) for k, s in enumerate(sets)], "key long, terms array<string>, size double")
    weights = pruned.weighed_by_rarity(rows, "key", "terms")
    needed = lambda a, b: F.lit(least) + 0.1 * (1 - F.least(a["size"] / b["size"], b["size"] / a["size"]))
    found = pruned.near_pairs(weights, rows.select("key", "size"), needed, least)
    w = weights.toPandas().pivot(index="key", columns="term", values="w").fillna(0)
    c, keys = w.to_numpy() @ w.to_numpy().T, w.index.to_numpy()
    want = {(a, b) for i, a in enumerate(keys) for j, b in enumerate(keys) if a < b and c[i, j] >= least + 0.1 * (1 - min((1 + a % 5) / (1 + b % 5), (1 + b % 5) / (1 + a % 5))) - 1e-9}
    got = found.pairs.toPandas()
    assert set(zip(got.a, got.b, strict=True)) == want and len(got) == len(want)
    told = found.shares().first()
    assert told.kept == len(want) <= told.touched < told.pairs
    assert all(abs(c[np.flatnonzero(keys == a)[0], np.flatnonzero(keys == b)[0]] - x) < 1e-9 for a, b, x in zip(got.a, got.b, got.cosine, strict=True))


def test_most_pairs_of_titles_are_never_touched(spark):
    told = pairs.title_pairs(spark, DATA).shares().first()
    assert told.touched * 10 < told.pairs and told.kept <= told.touched


# --- the stored index ---


def test_searches_read_folders_of_their_tokens_only(spark):
    index = search.stored_index(spark, DATA)
    plan = index.postings(["the", "that"], ["title"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "PushedFilters: [In(token" in plan
    assert search.stored_index(spark, DATA) is index
    found = index.search(search.LINE, search.WEIGHTS, search.NAMING, search.CHOSEN)
    assert found.count() and not [f for f in found.inputFiles() if "documents.parquet" in f]
    buckets = {stored.bucket_of(t) for t in search.LINE}
    read = {f.split("bucket=")[1].split("/")[0] for f in index.postings(search.LINE).inputFiles() if "bucket=" in f}
    assert {str(b) for b in buckets} <= read


def test_index_of_odd_documents(spark):
    rows = [(1, "Red red fox", ["a", "b"], "s1"), (2, None, [], "s1"), (3, "", None, "s2"), (4, "fox", [None], None), (5, "word " * 5000, ["b"], "s2"), (6, "red fox", ["c"], "s1")]
    docs = spark.createDataFrame(rows, "key long, title string, tags array<string>, source string")
    index = stored.StoredIndex.build(docs, "key", ["title"], {"tags": F.col("tags"), "source": F.col("source")})
    keys = lambda **c: sorted(r.key for r in index.chosen(stored.Choice("tags", **c)).collect())
    assert keys(shown=["a"]) == [1, 2, 3, 4] and keys(shown=["a"], without_hidden=True) == [1]
    assert keys(hidden=["b"]) == [1, 2, 3, 4, 6] and keys(hidden=["b", "c"], without_hidden=True) == [1]
    assert keys(within=[], without_hidden=True) == [] and keys(shown=["c"], sources=["s1"]) == [2, 3, 4, 5, 6]
    assert [(r.key, r.n, list(r.places)) for r in index.postings(["red"]).orderBy("key").collect()] == [(1, 2, [0, 1]), (6, 1, [0])]
    assert {r.key for r in index.search(["red", "fox"], {"title": 1.0}, ["title"], [stored.Choice("tags", shown=["a"], without_hidden=True)]).collect()} == {1}


# --- fits by sums ---


def sequential(y, w):
    out = []
    for s, n in zip((y * w).tolist(), w.tolist(), strict=True):
        out.append([s, n, 1])
        while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
            s, n, k = out.pop()
            out[-1] = [out[-1][0] + s, out[-1][1] + n, out[-1][2] + k]
    return np.concatenate([np.full(k, s / n) for s, n, k in out])


@pytest.mark.parametrize("shape,n,a_task", [("noisy", 100_000, 9000), ("falling", 5000, 300), ("rising", 5000, 300), ("flat", 3000, 300), ("late dip", 5000, 300), ("one", 1, 10)])
def test_pooling_in_ranges_is_pooling_in_order(spark, shape, n, a_task):
    rng, x = np.random.default_rng(n), np.arange(n)
    y = {"noisy": np.sqrt(x) + rng.normal(0, 30, n), "falling": -x, "rising": x, "flat": x * 0 + 3, "late dip": np.where(x == n - 1, -(10**6), x), "one": x}[shape].astype(float)
    w = rng.integers(1, 4, n).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "w": w})).orderBy(F.xxhash64("x"))
    got = pooling.isotonic(df, "x", "y", "w", a_task).toPandas().sort_values("x")
    assert (got.x == x).all() and np.allclose(got.fitted, sequential(y, w))


def test_pooling_of_odd_rows(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (1.0, None, 1.0), (2.0, 5.0, 0.0), (1.0, 2.0, 1.0), (1.0, 4.0, 1.0), (3.0, 1.0, 1.0)], "x double, y double, w double")
    assert np.allclose(sorted(map(tuple, pooling.isotonic(df, "x", "y", "w").collect())), [(1.0, 7 / 3), (3.0, 7 / 3)])
    assert pooling.isotonic(df.limit(0), "x", "y", "w").count() == 0


def test_ridge_is_the_dense_solution(spark):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(400, 12)) * np.logspace(0, 2, 12), rng.uniform(0.1, 2, 400)
    y = x @ rng.normal(size=12) + rng.normal(size=400)
    rows = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)] + [(None, 1.0, 1.0), ([1.0], 1.0, 1.0), ([None] * 12, 1.0, 1.0), (x[0].tolist(), None, 1.0)], "x array<double>, y double, w double")
    want = np.linalg.solve((x.T * w) @ x + 3 * np.eye(12), (x.T * w) @ y)
    assert np.allclose(learnt.ridge(rows, 3.0), want, rtol=1e-6, atol=1e-8)
    assert len(learnt.ridge(rows.where("y > 1e9"), 1.0)) in (0, 12)


def test_learnt_likeness_beats_the_plain_one_on_held_out_triplets(spark):
    """Two of eight directions tell universes apart, the others are louder noise."""
    rng = np.random.default_rng(6)
    kind = rng.integers(0, 4, 240)
    v = np.concatenate((np.eye(4)[kind][:, :2] * 2 - 1 + 0.2 * rng.normal(size=(240, 2)), 1.5 * rng.normal(size=(240, 6))), 1)
    rows = []
    for a in range(240):
        y, z = rng.choice(np.flatnonzero((kind == kind[a]) & (np.arange(240) != a))), rng.choice(np.flatnonzero(kind != kind[a]))
        rows.append((v[a].tolist(), v[y].tolist(), v[z].tolist(), 1.0, a % 4 == 0))
    df = learnt.kept(spark.createDataFrame(rows, "a array<double>, near array<double>, far array<double>, weight double, held boolean").coalesce(2), "triplets")
    w = learnt.likeness_weights(df.where("not held"), 8, steps=30, rate=0.06)
    plain, own = (learnt.triplet_loss(df.where("held"), x) for x in (np.ones(8), w))
    assert own[0] < plain[0] and own[1] > plain[1] and (w >= 0).all() and w[:2].min() > w[2:].max()
    assert (learnt.likeness_weights(df.limit(0), 8, steps=2) == 1).all()


def test_walk_comes_near_the_whole_search(spark):
    """Loss of a model walked over portions beside that of quasi-Newton steps on all rows at once; each row is judged by models that never stepped on it."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 10))
    has = 1 / (1 + np.exp(-2 * x @ rng.normal(size=(10, 4)))) > rng.random((600, 4))
    rows = [(k, v.tolist(), [int(i) for i in np.flatnonzero(h)], k % 2) for k, (v, h) in enumerate(zip(x, has, strict=True))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<int>, fold int").coalesce(1)
    shape = learnt.Bilinear(10, 4, 3)
    portions, count = learnt.portions_of(df, "id", 200, 2)
    assert count == 3
    out = learnt.walk(portions, count, shape, [1e-3], 2, walks=8, steps=3, rate=0.15)
    own, y = (np.arange(600) % 2 != 0), has.astype(float)

    def loss(p, rows):
        z = shape.logits(p, x[rows])
        return (np.logaddexp(0, z) - y[rows] * z).sum() / rows.sum() + 1e-3 * p @ p

    def both(p):
        z = shape.logits(p, x[own])
        return loss(p, own), shape.slope(p, x[own], 1 / (1 + np.exp(-z)) - y[own]) / own.sum() + 2e-3 * p

    whole = models.lbfgs(both, shape.start(), 200)
    assert out.models == [(1e-3, 0), (1e-3, 1)] and loss(out.points[0], own) <= 1.05 * loss(whole, own)
    assert 0.9 < out.held[1e-3] / ((loss(out.points[0], ~own) + loss(out.points[1], own)) / 2 - 1e-3 * (out.points**2).sum(1).mean()) < 1.3


def test_trigrams_of_long_and_short_texts(spark):
    from quillstack.functions import text as tx

    df = spark.createDataFrame([("",), ("a",), ("Ab  c",), ("日本語é",), (None,), ("x" * 50_000,)], "t string")
    got = [r[0] for r in df.select(tx.trigrams(F.col("t"))).collect()]
    assert got[1:4] == [[" a "], [" ab", "ab ", "b c", " c "], [" 日本", "日本語", "本語é", "語é "]] and not got[0] and len(got[5]) == 50_000


def test_nearest_of_null_and_ragged_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.9, 0.1]), (4, [1.0]), (5, [None, 1.0]), (6, [0.0, 1.0])], "id long, v array<double>")
    got = models.nearest(df, "id", "v", df, 2).toPandas()
    assert set(got.asked) == {1, 3, 6} == set(got.near)


def test_moments_and_scores_of_null_and_ragged_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [3.0, 2.0]), (4, [1.0]), (5, [None, 1.0])], "id long, v array<double>")
    mean, cov = models.moments(df, "v")
    assert np.allclose(mean, [2, 1]) and np.allclose(cov, [[1, 1], [1, 1]])
    assert sorted(map(tuple, models.scored(df, "id", "v", lambda x: x.sum(1)).collect())) == [(1, 1.0), (3, 5.0)]


def test_ways_up_end_in_circles(spark):
    from quillstack.operators import graph

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("a", "a"), (None, "x")], "child string, parent string")
    got = sorted("".join(r.way) for r in graph.ways_up(edges, spark.createDataFrame([("a",), ("c",)], "node string")).collect())
    assert got == sorted(["ab", "abc", "ad", "adc", "ca", "cab", "cad"])
