"""The likest works by groups against every pair, with unknown values, ties and shards smaller than a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quillstack import plans
from quillstack.operators import likest

COLUMNS = ["item_id", "source", "title", "type", "words", "size", "price"]


def works(n):
    rng = np.random.default_rng(n)
    out = []
    for k in range(n):
        words = [None if rng.random() < 0.03 else [f"w{x}" for x in rng.integers(0, 6, rng.integers(1, 4))]][0]
        out.append((k, None if rng.random() < 0.03 else f"s{rng.integers(0, 4)}", None if words is None else " ".join(words), f"t{rng.integers(0, 3)}", words, None if rng.random() < 0.05 else float(rng.integers(0, 6)), None if rng.random() < 0.05 else float(rng.integers(0, 40)) / 4))
    return out


def likeness(q, i):
    if q[4] is None or i[4] is None or not (q[6] and i[6]):
        return None
    a, b = set(q[4]), set(i[4])
    size = min(q[5], i[5]) / max(q[5], i[5]) if q[5] and i[5] else 0.0
    return (len(a & b) / len(a | b) + size + min(q[6], i[6]) / max(q[6], i[6])) / 3


@pytest.mark.parametrize("rows", [50, 100_000])
def test_likest_of_every_pair(spark, rows):
    own = works(600)
    items = spark.createDataFrame(own, "item_id long, source string, title string, type string, words array<string>, size double, price double")
    got = {r.asked: (r.other, r.likeness) for r in likest.likest(items, items.where("item_id % 5 = 0"), rows).collect()}
    kept = found = 0
    for q in own[::5]:
        all_ = [(i, likeness(q, i)) for i in own if q[1] is not None and i[1] is not None and i[1] != q[1]]
        if not all_:
            assert q[0] not in got
            continue
        best = min(((-1 if x is None else -round(x, 9)), i[0]) if x is not None else (1, i[0]) for i, x in all_)
        assert got[q[0]][0] == best[1] and (got[q[0]][1] is None if best[0] == 1 else abs(got[q[0]][1] + best[0]) < 1e-8)
        near = [i for i, x in all_ if x is not None and x >= 0.9]
        kept, found = kept + len(near), found + sum(i[2] == q[2] or (i[3] == q[3] and i[5] is not None and i[5] == q[5]) for i in near)
    told = likest.counted(items, items.where("item_id % 5 = 0"), 0.9, rows).first()
    assert (told.kept, told.found) == (kept, found) and kept > 0


def test_unknown_likeness_is_not_the_likest(spark, tmp_path):
    """A work without a price came first, as what is unknown sorted below every score."""
    parts = [(0, "red ring", "Brand#1", "SMALL", 10, 100.0), (1, "red ring", "Brand#2", "SMALL", 10, None), (2, "red ring", "Brand#2", "SMALL", 10, 90.0), (3, "red ring", "Brand#2", "SMALL", 10, 90.0)]
    pd.DataFrame(parts, columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]).to_parquet(tmp_path / "part.parquet")
    assert [tuple(r) for r in plans.QUERIES["exhaustive_search"](spark, str(tmp_path)).collect()] == [(0, 2, 0.966667)]
    assert [tuple(r) for r in plans.QUERIES["search_recall"](spark, str(tmp_path)).collect()] == [(2, 2, 1.0)]
