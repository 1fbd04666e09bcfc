"""Codes of vectors against whole scans in whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from conftest import DATA, plain

from quillstack.llm import codes, queries

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, rounds=2, parts=16, most=64):
    """rows: (vec_id, vector, label), all of them fine; the digest and (vec_id, code, error, label_error)."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    v = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in order]
    w = len(v[0]) // parts
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for x in v]
    books = [[list(cut[k][p]) for k in range(min(most, len(v)))] for p in range(parts)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for x in cut]

    for _ in range(rounds):
        near = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut[i][p] for i in range(len(v)) if near[i][p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    near, by = assigned(), {}
    errors = [sum(d for d, _ in n) for n in near]
    for r, e in zip(order, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return digest, sorted(((r[0], "".join(f"{k:02x}" for _, k in n), e, by[r[2]]) for r, n, e in zip(order, near, errors, strict=True)), key=str)


def found(df):
    coded, books = codes.fit(df.select("vec_id", "embedding", "label"))
    out = codes.with_label_errors(coded).select("vec_id", codes.code_text().alias("code"), "error", "label_error")
    return books.digest(), sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("spread,entries,wide", [(40, 64, 4), (3, 64, 4), (40, 3, 4), (5, 1, 4), (2**26, 64, 4), (30, 64, 2), (0, 64, 1)])
def test_bounds_lose_no_entry(spread, entries, wide):
    """Rounds with bounds give what whole scans give, ties too."""
    x = np.random.default_rng(spread).integers(-spread, spread + 1, (3000, wide))
    e = x[:entries].copy()
    group, state = codes.grouped(e[None])[0], ()
    for _ in range(4):
        code, best, lower, scanned = codes.assign(x, e, group, *state)
        d = ((x[:, None] - e) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
        d[np.arange(len(x)), code] = 2**62
        least = np.stack([d[:, group == g].min(1, initial=2**62) for g in range(codes.GROUPS)], 1)
        assert (lower.astype(float) <= np.sqrt(least)).all()
        new = np.array([x[code == k].sum(0) // max(1, (code == k).sum()) if (code == k).any() else e[k] for k in range(len(e))])
        state, e = (np.sqrt(((new - e).astype(float) ** 2).sum(1)) * (1 + 1e-9), code, lower), new
    assert spread > 40 or entries < 64 or scanned.mean() < codes.GROUPS


def test_rows_of_the_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").limit(150)
    assert found(df) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    fine = [(k, rng.normal(0, 0.2, 32).astype(np.float32).tolist(), k % 3 or None) for k in range(5, 120)]
    fine += [(None, fine[3][1], 7), (11, fine[0][1], None), (11, fine[0][1], None)] + [(500 + k, fine[9][1], 1) for k in range(40)]
    bad = [(0, None, 1), (1, [], 1), (2, [None] * 32, 1), (3, [float("nan")] * 32, 1), (4, [float("inf")] * 32, 1), (200, [0.5] * 48, 1), (201, [0.5] * 31, 1), (202, [3e38] * 32, 1)]
    df = spark.createDataFrame([(i, v, y, "x") for i, v, y in fine + bad], SCHEMA)
    assert found(df) == brute(fine)
    few = spark.createDataFrame([(i, v, y, "x") for i, v, y in fine[:3] + bad[:5]], SCHEMA)
    assert found(few) == brute(fine[:3])
    assert found(spark.createDataFrame([], SCHEMA))[1] == []
    assert found(spark.createDataFrame([(i, v, y, "x") for i, v, y in bad[:5]], SCHEMA))[1] == []


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    coded, books = codes.fit(spark.read.parquet(f"{DATA}/embeddings.parquet"))
    out = codes.decoded(coded, books).toPandas()
    v, back = np.stack(out.v.to_numpy()), np.stack(out.embedding.to_numpy())
    assert (((v - back * codes.SCALE) ** 2).sum(1) == out.error).all()
    assert out.groups_scanned.mean() < codes.PARTS * codes.GROUPS


def test_query_against_sql(spark, duck):
    got = queries.op11_vector_codes(spark, DATA).toPandas()
    assert plain(got) == plain(duck.sql(queries.SQL["op11_vector_codes"]).df())
