"""Hierarchies, components, streams that go on, text rules, running sums, and plans without one-task steps."""

from __future__ import annotations

import shutil
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillstack import plans
from quillstack.functions import numbers as nm, text as tx
from quillstack.operators import graph
from quillstack.session import shared_folder
from quillstack.streaming import changes, folds


def closed(spark, edges):
    return {(r.node, r.ancestor): r.depth for r in graph.closure(spark.createDataFrame(edges, "child string, parent string")).collect()}


def test_closure_of_a_long_chain(spark):
    got = closed(spark, [(str(k), str(k + 1)) for k in range(40)])
    assert got == {(str(a), str(b)): b - a for a in range(41) for b in range(a + 1, 41)}


def test_closure_of_diamonds_and_a_circle(spark):
    """2 ** 18 ways up through 18 diamonds; and a circle, whose nodes are their own ancestors."""
    edges = [e for k in range(18) for e in ((f"{k}", f"{k}l"), (f"{k}", f"{k}r"), (f"{k}l", f"{k + 1}"), (f"{k}r", f"{k + 1}"))]
    got = closed(spark, edges)
    assert got[("0", "18")] == 36 and len([1 for a, _ in got if a == "0"]) == 3 * 18
    assert closed(spark, [("a", "b"), ("b", "c"), ("c", "a")]) == {(x, y): (ord(y) - ord(x) - 1) % 3 + 1 for x in "abc" for y in "abc"}


@settings(deadline=None, max_examples=5)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components_against_brute_force(spark, pairs):
    label = {x: x for p in pairs for x in p}
    for _ in range(40):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == label and len(got) == len(label)


def test_a_chain_is_one_component(spark):
    order = np.random.default_rng(0).permutation(300).tolist()
    got = graph.components(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")).collect()
    assert {r.component for r in got} == {0} and len(got) == 300


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    """Between two runs of one name new rows come; the second reads those alone, and both add up."""
    rows = pd.read_parquet(f"{DATA}/events.parquet")
    whole = tmp_path / "events.parquet"
    whole.mkdir()
    rows[:300].to_parquet(whole / "a.parquet", coerce_timestamps="us")
    name = f"test-{tmp_path.name}"
    first = changes.run_on(spark, str(tmp_path), changes.latest_state, name, ["user_id"]).toPandas()
    rows[300:].to_parquet(whole / "b.parquet", coerce_timestamps="us")
    # what the first run read is gone: a run that began anew would lose it
    shutil.move(whole / "a.parquet", tmp_path / "a.parquet")
    second = changes.run_on(spark, str(tmp_path), changes.latest_state, name, ["user_id"]).toPandas().set_index("user_id")
    newest = rows.sort_values(["ts", "event_id"]).groupby("user_id").last()
    assert len(first) == rows[:300].user_id.nunique()
    assert second.value.to_dict() == newest.value.to_dict() and second.kind.to_dict() == newest.event_type.to_dict()


def test_batches_are_folded(spark, tmp_path):
    """Many runs leave one fold and one batch; a fold that broke off is written over."""
    rows = pd.read_parquet(f"{DATA}/events.parquet")
    whole = tmp_path / "events.parquet"
    whole.mkdir()
    name = f"folds-{tmp_path.name}"
    root = f"{shared_folder(spark)}/changes-{name}"
    for k in range(4):
        rows[k * 100 : (k + 1) * 100].to_parquet(whole / f"{k}.parquet", coerce_timestamps="us")
        if k == 2:
            spark.range(3).write.parquet(f"{root}/folded/000000000")
            broken = Path(root.removeprefix("file:")) / "folded/000000000/_SUCCESS"
            broken.unlink()
        got = changes.run_on(spark, str(tmp_path), changes.latest_state, name, ["user_id"]).toPandas()
        newest = rows[: (k + 1) * 100].sort_values(["ts", "event_id"]).groupby("user_id").last()
        assert got.set_index("user_id").value.to_dict() == newest.value.to_dict()
    assert len(folds.whole(spark, f"{root}/folded")) == 1 and len(folds.whole(spark, f"{root}/batches")) <= 2


def test_late_changes_no_longer_count(spark, tmp_path):
    """With a bound on lateness an hour's state goes; without one a late change still counts."""
    day = pd.Timestamp("2020-01-01")
    whole = tmp_path / "events.parquet"
    whole.mkdir()
    parts = [[(1, 0), (1, 30), (1, 60 * 48)], [(1, 60 * 49)], [(1, 5), (1, 60 * 48 + 5)]]
    told = {}
    for late in (None, "2 hours"):
        for k, part in enumerate(parts):
            pd.DataFrame([(u, "x", day + pd.Timedelta(minutes=m), 0.0, m) for u, m in part], columns=["user_id", "event_type", "ts", "value", "event_id"]).to_parquet(whole / f"{k}.parquet", coerce_timestamps="us")
            got = changes.run_on(spark, str(tmp_path), lambda e, late=late: changes.distinct_changes(e, late), f"late-{late}-{tmp_path.name}".replace(" ", ""), ["user_id", "kind", "hour"]).toPandas()
        told[late] = sorted(got.told)
        for k in range(len(parts)):
            (whole / f"{k}.parquet").unlink()
    assert told == {None: [1, 2, 3], "2 hours": [1, 2, 2]}


@pytest.mark.parametrize(("text", "want"), [("1994 was the year of the long winter", ["1994 was the year of the long winter"]), ("- 3.5 million people came", ["3.5 million people came"]), ("* • > (so it was) indeed here", ["(so it was) indeed here"])])
def test_phrases_keep_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.phrases(F.col("t"))).first()[0] == want


def test_classes_are_disjoint_and_whole(spark):
    text = "ab é漢𐐀 1\n\t!😀"
    got = spark.createDataFrame([(text,)], "t string").select(*(c.alias(k) for k, c in tx.class_counts(F.col("t")).items())).first().asDict()
    assert got == {"breaks": 1, "spaces": 3, "digits": 1, "letters1": 2, "letters2": 1, "letters3": 1, "letters4": 1, "rest": 2}


@settings(deadline=None, max_examples=5)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-5, 5)), min_size=1, max_size=40))
def test_running_sums_places_and_quantiles(spark, rows):
    df = spark.createDataFrame(rows, "k long, x long")
    got = nm.running(df, ["k"], F.col("x"), F.lit(1), "before").collect()
    assert sorted((r.k, r.x, r.before) for r in got) == sorted((k, x, sum(a == k and b < x for a, b in rows)) for k, x in rows)
    placed = nm.numbered(df, F.desc("x"), F.asc("k")).collect()
    assert [(r.k, r.x) for r in sorted(placed, key=lambda r: r.place)] == sorted(rows, key=lambda r: (-r[1], r[0]))
    q = {r.k: r.q0 for r in nm.quantiles(df, ["k"], F.col("x"), (0.3,)).collect()}
    assert all(np.isclose(q[k], np.quantile([x for a, x in rows if a == k], 0.3)) for k, _ in rows)


@pytest.mark.parametrize("name", ["knn_scorer", "concordance_by_fold", "auc_rank_sum", "ranks_spearman", "previous_grade_as_of", "blocking_same_author_title", "best_partner_per_item", "pairs_theta_by_grade", "set_quantile_embedding", "trigram_cosine"])
def test_plans_have_no_nested_loops(spark, name):
    """No pairs by nested loops, and no rows gathered in one partition but those of totals."""
    plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name != "pairs_theta_by_grade":
        assert "BroadcastNestedLoopJoin" not in plan
