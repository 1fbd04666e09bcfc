"""Rules of operators on small hand-made tables."""

from __future__ import annotations

from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillstack.functions import numbers, text as tx
from quillstack.operators import graph, listing, models, overlay, writes
from quillstack.sources import contracts


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_no_takes_a_subtree_against_a_yes(spark):
    edges = spark.createDataFrame([("child", "middle"), ("middle", "top"), ("other", "middle")], "child string, parent string")
    said = spark.createDataFrame([(1, "child", True), (1, "middle", False), (2, "child", True)], "item int, value string, added boolean")
    got = {(r.item, r.value): r.added for r in graph.expand_answers(said, graph.closure(edges)).collect()}
    assert got == {(1, "child"): False, (1, "middle"): False, (1, "other"): False, (1, "top"): True, (2, "child"): True, (2, "middle"): True, (2, "top"): True}


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=30))
def test_order_keeps_pairs_that_close_no_circle(pairs):
    order = graph.topological(range(10), pairs)
    assert sorted(order) == list(range(10))
    if pairs and pairs[0][0] != pairs[0][1]:
        assert order.index(pairs[0][0]) < order.index(pairs[0][1])


def test_range_text():
    assert listing.parse_range("size=1..2,5") == ("size", 1.0, 2.5)
    assert listing.parse_range("size=..7") == ("size", None, 7.0)
    assert listing.parse_range("size=a..7") is None
    assert listing.between(["a", "b", "c"], "c", "a") == []


def test_single_facet_is_replaced(spark):
    got = one(spark, overlay.facet_overlay(F.col("a"), F.col("b"), F.col("c"), single=True), a=["x"], b=["y"], c=["z"])
    assert got == ["y"]


def test_null_deletes_and_whole_lists_take_parts_off(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, writes.set_or_delete(old, new, ["k"], "v").collect())) == [(2, "b"), (3, "c")]


def test_russian_dates(spark):
    got = one(spark, F.unix_timestamp(tx.russian_date(F.col("t"))), t="5 марта 2021, 14:07")
    assert got == 1614942420
    assert one(spark, tx.russian_date(F.col("t")), t="вчера") is None


def test_paragraphs_join_short_rest(spark):
    got = one(spark, tx.paragraphs(F.col("t"), 10), t="aaaa\nbbbbbb\n12\ncc")
    assert got == ["aaaa\nbbbbbb\ncc"]


@settings(deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=8))
def test_simplex(y):
    x = models.on_simplex(np.array(y))
    assert abs(x.sum() - 1) < 1e-9 and (x >= 0).all()


def task(n=60, d=5):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, d))
    z = x @ np.arange(1, d + 1)
    return x, np.digitize(z, np.quantile(z, [0.2, 0.4, 0.6, 0.8])) + 1, np.arange(n) // 2


@pytest.mark.parametrize("fit", ["pairwise", "kernel", "factorization", "boosting"])
def test_scorers_order_their_own_rows(fit):
    x, g, w = task()
    if fit == "pairwise":
        z = x @ models.fit_pairwise(x, g, w)
    elif fit == "kernel":
        z = models.arc_cosine(x, x) @ models.fit_kernel(x, g, w)
    elif fit == "factorization":
        z = models.factorization_scores(x, *models.fit_factorization(x, g, w))
    else:
        z = models.tree_scores(x, models.fit_boosting(x, g, w, trees=60))
    b, o, _, _ = models.ranking_pairs(g, w)
    assert (z[b] > z[o]).mean() > 0.8


def test_firth_stays_finite_on_separable_rows():
    x = np.stack((np.ones(6), np.array([-3, -2, -1, 1, 2, 3.0])), 1)
    w = models.fit_logistic(x, np.array([0, 0, 0, 1, 1, 1.0]), ridge=0, firth=True)
    assert np.isfinite(w).all() and w[1] > 0


def test_ridge_and_least_absolute():
    rng = np.random.default_rng(0)
    a, truth = rng.normal(size=(50, 3)), np.array([1.0, 2, 3])
    assert np.allclose(models.ridge_solve(a, a @ truth, 1e-9), truth, atol=1e-5)
    assert np.allclose(models.least_absolute(np.abs(a), np.abs(a) @ truth), truth, atol=1e-2)


def test_commonest_of_others(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "xyz"[int(a)], None if b == 4 else "pqrs"[int(b)], "uvw"[int(c)]) for i, (a, b, c) in enumerate(rng.integers(0, (3, 5, 3), (40, 3)))] + [(99, "alone", "p", "u"), (98, None, "p", "u"), (97, None, "q", "w")]
    df = spark.createDataFrame(rows, "id long, site string, kind string, girth string")

    def others(own, key, facet, wanted):
        seen = Counter(facet(r) for r in rows if r[0] != own[0] and key(r) == wanted and None not in wanted and facet(r) is not None)
        return max(seen, key=lambda v: (seen[v], v)) if seen else None

    got = models.commonest_of_others(models.commonest_of_others(df, ["site"], "kind", "first"), ["site", "first"], "girth", "second", ["site", "kind"])
    for r in got.collect():
        own = (r.id, r.site, r.kind, r.girth)
        assert r.first == others(own, lambda x: (x[1],), lambda x: x[2], (r.site,))
        assert r.second == others(own, lambda x: (x[1], x[2]), lambda x: x[3], (r.site, r.first))
    assert got.count() == len(rows)


def test_grades_outside_the_scale_are_an_error(spark):
    rows = spark.createDataFrame([(1, 1, 2, 0.5), (2, 2, 7, 0.9)], "item_id long, work long, grade int, score double")
    with pytest.raises(Exception, match="grades are 1 to 5, not 7"):
        numbers.concordance(rows).collect()
    assert numbers.concordance(rows, highest=7).first().concordance == 1.0


def test_registry_of_sources(spark):
    one = contracts.memory_source("one", [(1, "a", datetime(2020, 1, 1)), (2, None, None)])
    known = contracts.Registry()
    known.add("source", "one", one)
    known.add("source", "none", contracts.memory_source("none", []))
    assert known.active("source") is one and [s.name for s in known.of("source")] == ["none", "one"]
    known.use("source", "none")
    assert known.active("source").name == "none"
    assert sorted(r.item_id for r in known.items(spark, "").collect()) == [1, 2]
    for wrong in (lambda: known.use("source", "two"), lambda: known.add("source", "one", one)):
        with pytest.raises(ValueError):
            wrong()
