"""The Merkle manifest against trees built row by row."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quillstack.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, path string, G string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(hashes, fanout):
    paths, own = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, path in enumerate(paths):
            run = own[i] // fanout * fanout
            path.append(("".join(hashes[run : own[i]]), "".join(hashes[own[i] + 1 : run + fanout])))
            own[i] //= fanout
        hashes = [H("".join(hashes[k : k + fanout])) for k in range(0, len(hashes), fanout)]
    return hashes[0], paths


def brute(rows, fanout):
    def leaf(r, text):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    by = {}
    for r in rows:
        even = zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 2 == 0
        turned = r["text"].replace("\n", "") if r["text"] and even else r["text"]
        by.setdefault(r["source"], []).append((r["doc_id"], leaf(r, r["text"]), leaf(r, turned)))
    for own in by.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[1] for x in by[s]], fanout) for s in sources]
    root, above = tree([t[0] for t in trees], fanout)
    out = []
    for s, (subroot, paths), up in zip(sources, trees, above, strict=True):
        for (doc, own, h), path in zip(by[s], paths, strict=True):
            for before, after in path + up:
                h = H(before + h + after)
            out.append((doc, own, subroot, root, H("".join(a + b for a, b in path + up)), h, h == root))
    return sorted(out, key=str)


def found(docs, fanout):
    m = merkle.manifest(docs, merkle.without_line_ends(), fanout)
    out = m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("path").alias("proof"), merkle.fold(F.col("turned"), "path").alias("folded"))
    return sorted((tuple(r) for r in out.withColumn("same", F.col("folded") == F.col("root")).collect()), key=str)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_of_documents(spark, fanout):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert found(docs, fanout) == brute([r.asDict() for r in docs.collect()], fanout)


def test_odd_rows(spark):
    """Nulls, many rows of one id, copies over several blocks, ids of every size, many sources, other columns."""
    rows = [(None, None, None, None, None)] * 400
    rows += [(5, "a", None, 1, "x\ny")] * 3
    rows += [(None, "a", "e", k % 3, f"t\n{k % 700}") for k in range(1500)]
    rows += [(-k, "", "f", 2, "") for k in range(30)]
    rows += [(2**63 - 1, "b", None, None, "q"), (-(2**63), "b", None, None, "q\n")]
    rows += [(k * 2**40 - 2**60, "ünï", None, None, "z\n" * (1 + 3000 * (k == 7))) for k in range(900)]
    rows += [(k, f"s{k}", None, None, "z\n") for k in range(600)]
    docs = spark.createDataFrame([(*r, "p", "g") for r in rows], SCHEMA)
    assert found(docs, 3) == brute([r.asDict() for r in docs.collect()], 3)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([(k, "s", "en", 3, "a\nb", None, None) for k in range(n)], SCHEMA)
    assert found(docs, 3) == (brute([r.asDict() for r in docs.collect()], 3) if n else [])


def test_tampering_is_seen_and_only_that(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    m = merkle.manifest(docs, F.col("text"))
    assert m.where(merkle.fold(F.col("turned"), "path") != F.col("root")).count() == 0
    m = merkle.manifest(docs, F.concat("text", F.lit(" ")))
    assert m.where(merkle.fold(F.col("turned"), "path") == F.col("root")).count() == 0


def test_positions_are_exact_ranks(spark):
    docs = spark.range(5000).select((F.col("id") * 7919 % 100003).alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    got = merkle.manifest(docs).select("source", "doc_id", "position").toPandas()
    assert (got.groupby("source").doc_id.rank().astype(int) - 1 == got.position).all()
