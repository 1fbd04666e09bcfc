"""Languages of texts: vectors against triples taken one by one, held-out accuracy, odd texts."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from conftest import DATA

from quillstack.llm import languages, queries

SCHEMA = "doc_id long, text string, lang string, score string, `a``b` int"


def brute(text):
    """The vector of a text, triple by triple."""
    out, symbols = np.zeros(languages.WIDTH, int), [0]
    for c in text + " ":
        s = (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 0
        if s or symbols[-1]:
            symbols.append(s)
    vector = lambda s: languages.letter_vector(s).astype(int)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        if b:
            out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


def summed(texts):
    out = np.zeros((len(texts), languages.WIDTH))
    for rows, triples, count in languages.counted(texts):
        out[rows] += count @ languages.triple_vectors(triples)
    return out


TEXTS = ["", None, "a", "Ab c", " x  yz\n\n", "12 34 !", "Straße İstanbul ÀÉ", "日本語のテキスト", "́é", "a\x00b", "word " * 50, "!a", "a!", "ab\n\nab"]


def test_vectors_of_texts():
    assert (summed(TEXTS) == [brute(t or "") for t in TEXTS]).all()


@pytest.mark.parametrize("part", [5, 16, 37])
def test_long_texts_in_parts(monkeypatch, part):
    """Cuts inside words, at edges and in texts without any edge change nothing; nor do small tables."""
    rng = np.random.default_rng(part)
    texts = ["".join(rng.choice(list("abcdé 日.\n"), n)) for n in (1, 4, 5, 6, 40, 200)] + ["abcdefgh" * 20, " " * 90, "a" + " " * 50 + "b", *TEXTS]
    want = [brute(t or "") for t in texts]
    monkeypatch.setattr(languages, "PART_CHARS", part)
    monkeypatch.setattr(languages, "CHUNK_CHARS", 11)
    monkeypatch.setattr(languages, "CHUNK_TRIPLES", 3)
    assert (summed(texts) == want).all()


def test_held_out_accuracy(spark):
    got = queries.op12_language_profiles(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = docs.merge(got, on="doc_id")
    held = both[both.held_out & both.lang.notna()]
    assert len(both) == len(docs) and (held.lang == held.lang_pred).mean() > 0.98
    assert both.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(both.doc_id, both.held_out, strict=True))


def test_prototypes_are_sums_of_texts_outside_the_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = languages.fit(docs)
    rows = [r for r in docs.collect() if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    assert got.names == sorted({r.lang for r in rows})
    for name, own in zip(got.names, got.sums, strict=True):
        assert (own == summed([r.text for r in rows if r.lang == name]).sum(0)).all()


def test_odd_rows(spark):
    rows = [(k, t, ["x", "y"][k % 2], "s", k) for k, t in enumerate(["the cat and the dog", "el gato y el perro"] * 20)]
    rows += [(None, None, "x", "s", 1), (None, "", None, None, None), (7, "123 !?", "y", "s", 2), (7, "the cat", None, "s", 2), (7, "the cat", None, "s", 2), (90, "word " * 300_000, "x", "s", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = languages.tag(docs, languages.fit(docs)).toPandas()
    assert len(got) == len(rows) and list(got.columns) == ["doc_id", "text", "lang", "a`b", "lang_pred", "score"]
    plain = got.text.fillna("").str.contains("[a-z]")
    assert (got[~plain].lang_pred == "und").all() and (got[~plain].score == 0).all()
    assert (got[got.text == "the cat"].lang_pred == "x").all() and got[plain].lang_pred.isin(["x", "y"]).all()
    none = languages.tag(docs, languages.fit(docs.where("lang is null")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert languages.tagged(docs.limit(0)).count() == 0


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(languages, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(k, "abc", f"l{k}", "s", 1) for k in range(20)], SCHEMA)
    with pytest.raises(ValueError):
        languages.fit(docs)
