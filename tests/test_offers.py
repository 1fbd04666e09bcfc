"""Offers of a hierarchy against one decision after another."""

from __future__ import annotations

import numpy as np
import pytest

from quillstack.operators import offers


def greedy(bound, links, refused):
    """Entries over tags, nearest first, each tag in one."""
    parents = {}
    for c, p in links:
        parents.setdefault(c, set()).add(p)

    def above(entry):
        seen, now, depth = {}, {entry}, 0
        while now:
            depth += 1
            now = {p for e in now for p in parents.get(e, ())} - set(seen) - {entry}
            seen |= {p: depth for p in now}
        return seen

    general = set(refused).union(*(above(e) for e in refused))
    over = {}
    for tag, entry in bound:
        for e, levels in above(entry).items():
            if e not in general and e not in {x for _, x in bound}:
                over.setdefault(e, {})[tag] = min(levels, over.get(e, {}).get(tag, 99))
    out, placed = [], set()
    for e, tags in sorted(((e, t) for e, t in over.items() if len(t) > 1), key=lambda x: (max(x[1].values()), -len(x[1]), x[0])):
        if not placed & set(tags):
            placed |= set(tags)
            out += [(e, t, max(tags.values()), len(tags)) for t in tags]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_new_parents_are_those_of_one_decision_after_another(spark, seed):
    rng = np.random.default_rng(seed)
    links = sorted({(f"e{k}", f"e{int(p)}") for k in range(1, 60) for p in rng.integers(0, k, 1 + (k % 4 == 0))})
    bound = [(f"t{k}", f"e{k}") for k in range(60) if rng.random() < 0.6] + [("twin", "e59")]
    refused = ["e1"]
    got = offers.new_parents(
        spark.createDataFrame(bound, "tag string, entry string"), offers.entries_above(spark.createDataFrame(links, "child string, parent string")), spark.createDataFrame([(r,) for r in refused], "entry string")
    )
    assert sorted((r.entry, r.tag, r.levels, r.tags) for r in got.collect()) == greedy(bound, links, refused)


def test_links_leave_out_what_holds_already(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "d")], "child string, parent string")
    bound = spark.createDataFrame([("A", "a"), ("A2", "a"), ("C", "c"), ("D", "d"), ("X", "x")], "tag string, entry string")
    known = spark.createDataFrame([("A2", "C")], "node string, ancestor string")
    got = offers.links_offered(bound, offers.entries_above(links), known)
    assert sorted(map(tuple, got.collect())) == [("A", "C", 2), ("C", "D", 1), ("X", "D", 1)]
    works = spark.createDataFrame([("A", 1), ("A", 2), ("C", 2), ("X", 5)], "tag string, work long")
    assert {(r.child, r.changed) for r in offers.works_changed(got, works).collect()} == {("A", 1), ("C", 1), ("X", 1)}
    assert offers.new_parents(bound.limit(0), offers.entries_above(links), spark.createDataFrame([], "entry string")).count() == 0
