"""Queries read whole tables: small tables on which a cut of the input shows."""

from __future__ import annotations

import numpy as np
import pandas as pd

from quillstack import plans
from quillstack.operators import models
from quillstack.plans import learning


def test_series_of_all_keys_are_ordered(spark, tmp_path):
    lines = pd.DataFrame([(k, w, 3 * w + 1, n) for k in (1, 1999, 2000, 70_000) for n, w in enumerate((9, 4, 7), 1)], columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    lines.to_parquet(tmp_path / "lineitem.parquet")
    got = plans.QUERIES["series_topological"](spark, str(tmp_path)).toPandas().sort_values(["series", "place"])
    assert {s: g.work.tolist() for s, g in got.groupby("series")} == dict.fromkeys((1, 1999, 2000, 70_000), [9, 4, 7])


def test_shifts_count_every_row_of_a_bin(spark, tmp_path):
    """Two bins, at chances of 1/2 and 2/3, with more rows than 200 of one answer."""
    bins = [(2, 0, 500), (2, 1, 50), (3, 0, 300), (3, 1, 250)]
    parts, lines = [], []
    for size, yes, n in bins:
        for _ in range(n):
            key = 3 * (len(parts) + 1)
            parts.append((key, "red ring", "Brand#1", "SMALL", 10, 100.0))
            lines += [(key, key, k, float(4 if yes else 0), pd.Timestamp("2000-01-01"), 1000.0, "R" if k == 1 else "N") for k in range(1, size + 1)]
    pd.DataFrame(parts, columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]).to_parquet(tmp_path / "part.parquet")
    pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate", "l_extendedprice", "l_returnflag"]).astype({"l_linenumber": "int32"}).to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    got = plans.QUERIES["value_shifts"](spark, str(tmp_path)).toPandas()
    z = np.repeat([0.0 if size == 2 else 0.7 for size, _, _ in bins], [n for _, _, n in bins])
    y = np.repeat([float(yes) for _, yes, _ in bins], [n for _, _, n in bins])
    want = models.fit_logistic(np.stack((np.ones(len(z)), z), 1), y, ridge=1e-3, firth=True)
    assert np.allclose(got[["shift", "slope"]].to_numpy(), [want], atol=1e-8)


def test_directions_are_those_of_all_vectors(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(3000, 40)) * np.arange(40, 0, -1)
    pd.DataFrame({"vec_id": range(3000), "embedding": list(x), "label": 0}).to_parquet(tmp_path / "embeddings.parquet")
    got = plans.QUERIES["principal_directions"](spark, str(tmp_path)).toPandas().sort_values("vec_id")
    along = np.stack(got.along.to_numpy())
    assert along.shape == (3000, 32) and np.allclose(along[:, 0], got["first"])
    # places along the directions of all rows have mean 0, spread 1 and no correlation
    assert np.allclose(along.mean(0), 0, atol=1e-9) and np.allclose(along.T @ along / 3000, np.eye(32), atol=1e-8)


def test_words_are_fitted_on_all_documents(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = [" ".join("ab1"[k % 3] * n for k, n in enumerate(rng.integers(1, 9, rng.integers(1, 30)))) for _ in range(1500)]
    pd.DataFrame({"doc_id": range(1500), "text": texts, "lang": "en", "source": "s", "n_chars": [len(t) for t in texts]}).to_parquet(tmp_path / "documents.parquet")
    got = plans.QUERIES["words_per_character"](spark, str(tmp_path)).toPandas().sort_values("doc_id").words.to_numpy()
    letters, digits, spaces = (np.array([float(sum(c in own for c in t)) for t in texts]) for own in ("ab", "1", " "))
    # the eight classes in their order: breaks, spaces, digits, letters of one to four bytes, the rest
    none = np.zeros(1500)
    x = np.stack((none, spaces, digits, letters, none, none, none, none), 1)
    want = x @ models.least_absolute(x, np.array([float(len(t.split())) for t in texts]), 20)
    assert np.allclose(got, want, atol=1e-6)


def test_page_is_ordered_by_the_digits_it_shows(spark, tmp_path):
    """All works show 2.0; what lies beyond the three digits rises with the key, and so does the date of the grade, by turns."""
    n, day = 60, pd.Timestamp("2000-01-01")
    parts = [(k, "red ring", "Brand#1", "SMALL", 10, 1000.0) for k in range(n)]
    lines = [(k, k, 7, 10.0, day + pd.Timedelta(days=k % 4), 2_000_000.0 + 10 * k, "N") for k in range(n)]
    pd.DataFrame(parts, columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]).to_parquet(tmp_path / "part.parquet")
    pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate", "l_extendedprice", "l_returnflag"]).astype({"l_linenumber": "int32"}).to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    got = plans.QUERIES["list_page_score"](spark, str(tmp_path)).toPandas()
    assert got.item_id.tolist() == sorted(range(n), key=lambda k: (-(k % 4), k))[20:40] and set(got.total) == {n}


def test_surveyed_steps():
    assert (learning.SHIFT_STEPS, learning.WEIGHT_STEPS) == (300, 2000)
