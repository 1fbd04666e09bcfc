"""Vectors against marks, means of named vectors, and answers that many items share, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from quillstack.operators import graph, marks


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(k % 4), rng.normal(size=6).round(1).tolist()) for k in range(300)]
    rows += [(300, 9, None), (301, 9, [1.0, 2.0]), (302, 8, [0.0] * 6), (303, None, [1.0] * 6), (304, 7, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, 6, [1.0] * 6)]
    return rows, spark.createDataFrame(rows, "vec_id long, label int, v array<float>")


def test_best_by_label(vectors):
    rows, df = vectors
    fine = {k: np.float32(v).astype(float) for k, _, v in rows if k is not None and v and len(v) == 6 and None not in v}
    got = {r.label: r.likeness for r in marks.best_by_label(df, df.where("vec_id % 50 = 0")).collect()}
    labels = {k: c for k, c, _ in rows}
    for c in (0, 1, 2, 3, 8, None):
        want = max(cosine(x, fine[m]) for k, x in fine.items() if labels[k] == c for m in range(0, 300, 50) if m != k)
        assert abs(got.pop(c) - want) < 1e-12
    # labels without a fitting vector: there are pairs, none has a cosine
    assert got == {9: None, 7: None}


def test_kin_places(vectors):
    rows, df = vectors
    fine = {k: np.float32(v).astype(float) for k, _, v in rows if k is not None and v and len(v) == 6 and None not in v}
    labels = {k: c for k, c, _ in rows}
    got = {r.q: r.place for r in marks.kin_places(df, df.where("vec_id % 50 = 0 or vec_id > 299")).collect()}
    want = {}
    for q in [*range(0, 300, 50)]:
        c = {k: round(cosine(fine[q], x), 9) for k, x in fine.items() if k != q}
        best = max(s for k, s in c.items() if labels[k] == labels[q])
        want[q] = 1 + sum(s > best for k, s in c.items() if labels[k] is not None and labels[k] != labels[q])
    assert got == want


def test_means_of_named_vectors(spark, vectors):
    rows, df = vectors
    rng = np.random.default_rng(6)
    pairs = sorted({(int(i), int(v)) for i, v in zip(rng.integers(0, 40, 900), rng.integers(0, 330, 900), strict=True)} | {(99, 320), (98, 301), (97, 304)})
    got = {r.item_id: (r.length, r.first) for r in marks.means(spark.createDataFrame(pairs, "item_id long, vec_id long"), df).collect()}
    by = {k: v for k, _, v in rows if k is not None}
    for i in {i for i, _ in pairs}:
        own = [by[v] for k, v in pairs if k == i and by.get(v)]
        if not own:
            assert i not in got
            continue
        m = [np.mean(np.float32(x).astype(float)) for k in range(6) if len(x := [v[k] for v in own if len(v) > k and v[k] is not None])]
        assert abs(got[i][0] - np.linalg.norm(m)) < 1e-9 and abs(got[i][1] - m[0]) < 1e-9


def test_answers_are_not_shuffled_row_by_row(spark):
    """Items that said the same share what follows; one item said something of its own, one nothing that the hierarchy knows."""
    edges = spark.range(1, 400).selectExpr("concat('n', id) as child", "concat('n', id div 3) as parent")
    ancestors = graph.closure(edges)
    said = [(k, "n7", True) for k in range(5000)] + [(k, "n2", False) for k in range(0, 5000, 2)] + [(5001, "n0", False), (5001, "n5", True), (5002, "x", True), (5002, "x", False), (5003, "x", None)]
    out = graph.expand_answers(spark.createDataFrame(said, "item long, value string, added boolean"), ancestors)
    up = lambda n: [n // 3**k for k in range(1, 8) if n // 3 ** (k - 1) > 0]
    under = lambda n: {k for k in range(1, 400) if n in up(k)}
    want = {f"n{k}": True for k in [7, *up(7)]}
    got = out.where("item = 1").toPandas()
    assert dict(zip(got.value, got.added, strict=True)) == want
    got = out.where("item = 2").toPandas()
    assert dict(zip(got.value, got.added, strict=True)) == want | {f"n{k}": False for k in [2, *under(2)]} and len(got) == len(set(got.value))
    assert {(r.value, r.added) for r in out.where("item = 5001").collect()} == {(f"n{k}", False) for k in [0, *under(0)]}
    assert [tuple(r) for r in out.where("item >= 5002").collect()] == [(5002, "x", False)]
    # before, all rows of the result went through the last shuffle
    n = out.count()
    assert n == 2500 * len(want) + 2500 * len(want.keys() | {f"n{k}" for k in [2, *under(2)]}) + 400 + 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Exchange")
