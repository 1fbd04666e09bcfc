"""Line, passage and near-copy removal against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import DATA, plain
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillstack.llm import lines, minhash, queries, suffix
from quillstack.llm.components import forest
from quillstack.llm.rolling import Prefix, chunks, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, n_lines string, u int"
LONG = "A line that is long enough to count"


def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and extra columns with clashing names."""
    rows = [
        (1, f"{LONG}\nown one", "en", "a", 1, "h", "x", 1),
        (2, f"  {LONG.upper()}\t\nown two\n", None, None, None, None, None, None),
        (3, LONG, "en", "a", 1, "h", "x", 1),
        (3, LONG, "en", "a", 1, "h", "x", 1),
        (None, LONG, "en", "a", 1, "h", "x", 1),
        (4, None, "en", "a", 1, "h", "x", 1),
        (5, "", "en", "a", 1, "h", "x", 1),
        (6, "é" * 30_000, "en", "a", 1, "h", "x", 1),
        (7, "\n" * 500, "en", "a", 1, "h", "x", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return odd(spark).where("false")


def test_lines_of_odd_rows(spark):
    got = lines.drop_repeated_lines(odd(spark)).toPandas()
    by = got.groupby("doc_id", dropna=False)
    assert len(got) == 9 and set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", "hash", "u", "n_lines", "n_dropped"}
    assert by.get_group(1).text.tolist() == ["own one"]
    assert by.get_group(2).text.tolist() == ["own two\n"]
    assert by.get_group(3).text.tolist() == [LONG, LONG]
    assert by.get_group(4).text.tolist() == [""] and by.get_group(4).n_lines.tolist() == [1]
    assert by.get_group(7).n_lines.tolist() == [501]
    assert lines.drop_repeated_lines(empty(spark)).count() == 0


def test_line_query_is_what_sql_says(spark, duck):
    assert plain(queries.op3_line_dedup(spark, DATA).toPandas()) == plain(duck.sql(queries.SQL["op3_line_dedup"]).df())


def brute_passages(texts, width=200):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append((int(gone.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_passage_query_against_brute_force(spark):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").toPandas()
    want = brute_passages([t.encode() for t in texts.text])
    got = queries.op4_suffix_dedup(spark, DATA).toPandas().sort_values("doc_id")
    assert list(zip(got.n_removed, got.kept_sha256, strict=True)) == want
    assert want != [(0, h) for _, h in want]


def test_passages_of_odd_rows(spark):
    got = suffix.drop_repeated_passages(odd(spark), width=20, gram=8).toPandas()
    assert len(got) == 9
    by = got.groupby("doc_id", dropna=False)
    assert (by.get_group(3).n_removed == len(LONG)).all()
    assert by.get_group(6).n_removed.tolist() == [60_000]
    assert by.get_group(4).n_bytes.tolist() == [0]
    assert suffix.drop_repeated_passages(empty(spark)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abé", max_size=120), min_size=1, max_size=5), st.sampled_from([1, 100]))
def test_passages_at_random(spark, texts, group):
    """Also with every group too large for one task."""
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    got = suffix.drop_repeated_passages(docs, width=20, gram=8, filter_bits=1 << 16, group=group).orderBy("doc_id").select("n_removed", F.sha2("kept", 256).alias("h")).collect()
    assert [(r.n_removed, r.h) for r in got] == brute_passages([t.encode() for t in texts], 20)


@given(st.lists(st.tuples(st.integers(0, 2), st.binary(max_size=6), st.binary(min_size=12, max_size=16)), max_size=12))
def test_dictionary_order_is_that_of_plain_suffixes(rows):
    """Suffixes of a group at its trigger, sorted: as Python sorts them, with their common prefixes."""
    rows = sorted(rows, key=lambda r: r[0])
    texts = [left + right for _, left, right in rows]
    end = np.cumsum([0] + [len(t) for t in texts])
    trigger = end[:-1] + np.array([len(r[1]) for r in rows], int)
    data, part = np.frombuffer(b"".join(texts), np.uint8), np.array([r[0] for r in rows], int)
    if not rows:
        return
    order, common = suffix.suffix_order(data, part, trigger, end[1:], 12)
    suffixes = [r[2][:12] for r in rows]
    assert [(part[k], suffixes[k]) for k in order] == sorted((r[0], r[2][:12]) for r in rows)
    for a, b, n in zip(order, order[1:], common[1:], strict=False):
        x, y = suffixes[a], suffixes[b]
        want = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert n == (want if part[a] == part[b] else -1)
    # every window that two rows of a group share, wherever it begins
    held = Counter((g, len(left) - s, (left + right)[s : s + 12]) for g, left, right in rows for s in range(len(left) + len(right) - 11))
    want = sorted((k, s) for k, (g, left, right) in enumerate(rows) for s in range(len(left) + 1) if len(left) + len(right) - s >= 12 and held[(g, len(left) - s, (left + right)[s : s + 12])] > 1)
    got = suffix.repeated_in_dictionary(data, part, end[:-1], trigger, end[1:], 12)
    assert sorted(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want


def test_extra_columns_of_any_name_pass_through(spark):
    """Names that operators use inside, and names of their results, as columns of the input."""
    docs = odd(spark).withColumns({"__id": F.lit(1), "__hash": F.lit("x"), "__twin": F.lit(2), "_id": F.lit(3), "id": F.lit(4), "key": F.lit(5)})
    for own in (lines.drop_repeated_lines(docs), suffix.drop_repeated_passages(docs, width=20, gram=8), minhash.keep_one(docs)):
        row = own.where("doc_id = 1").first()
        assert (row["__id"], row["__hash"], row["__twin"], row["_id"], row["id"], row["key"]) == (1, "x", 2, 3, 4, 5)


def word_sets(texts):
    out = []
    for t in texts:
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        out.append(Counter(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else Counter([tuple(w)]))
    return out


def test_near_copies_are_found_and_others_left_alone(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(4000)])
    base = [rng.choice(words, 200) for _ in range(30)]
    rows, truth = [], []
    for k, b in enumerate(base):
        for copy in range(1 + k % 4):
            own = b.copy()
            if copy:
                own[rng.integers(0, 200, 2)] = "changed"
            rows.append((len(rows), " ".join(own)))
            truth.append(k)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").toPandas()
    first = {}
    for i, k in enumerate(truth):
        first.setdefault(k, i)
    assert got.class_id.tolist() == [first[k] for k in truth]


def test_similarity_is_weighted_jaccard():
    a, b = ["one two three four five six", "x", None, "same same same same same same"], ["one two three four five seven", "x", "y", "same same same same same"]
    idf = minhash.Weights(*np.ones((2, minhash.COUNTERS)))
    got = minhash.similarity(pa.array(a), pa.array(b), idf)
    want = []
    for x, y in zip(word_sets(a), word_sets(b), strict=True):
        want.append(sum((x & y).values()) / sum((x | y).values()))
    want[2] = 0
    assert np.allclose(got, want)
    u, v = minhash.block_links(pa.array(a), pa.array(b), idf, 0.5)
    assert (1, 1) in set(zip(u.tolist(), v.tolist(), strict=True)) and (3, 3) in set(zip(u.tolist(), v.tolist(), strict=True))


def test_weights_are_inverse_document_frequencies(spark):
    """Of a shingle in every document, in half of them, and in one."""
    texts = spark.createDataFrame([(k, f"a b c d e {'f g h i j' if k % 2 else ''} {k}x {k}y {k}z {k}v {k}w") for k in range(400)], "id long, text string")
    weigh = minhash.inverse_frequencies(texts)
    key = lambda text: minhash.shingles(next(chunks(pa.array([text]))))[0]
    want = lambda df: 1 + minhash.DAMPING * np.log(401 / (1 + df)) / minhash.SCALE
    got = [float(weigh(key(t))[0]) for t in ("a b c d e", "f g h i j", "7x 7y 7z 7v 7w")]
    assert np.allclose(got, [want(400), want(200), want(1)], atol=2e-3) and got[0] < got[1] < got[2]


def test_near_copy_query_against_all_pairs(spark):
    """The query's classes are those of all pairs of whole texts at 0.8 of weighted Jaccard similarity."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").toPandas()
    weigh = minhash.inverse_frequencies(spark.createDataFrame(docs[["doc_id", "text"]].rename(columns={"doc_id": "id"})))
    texts = pa.array(docs.text)
    u, v = minhash.block_links(texts, texts, weigh, minhash.SIMILAR)
    label = {k: k for k in range(len(docs))}
    same = [(k, docs.text[:k][docs.text[:k] == t].index[0]) for k, t in enumerate(docs.text) if (docs.text[:k] == t).any()]
    for _ in range(len(docs)):
        before = dict(label)
        for a, b in [*zip(u.tolist(), v.tolist(), strict=True), *same]:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    got = queries.op1_minhash_near_dedup(spark, DATA).toPandas().sort_values("doc_id").class_id.tolist()
    want = [int(docs.doc_id[label[k]]) for k in range(len(docs))]
    assert got == want and len(set(want)) < len(want)


def test_large_groups_meet_in_blocks(spark):
    """A chain of texts, each near the next only, shares buckets with all of its group."""
    rng = np.random.default_rng(1)
    own = [f"t{k}" for k in rng.permutation(150)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(own)))
        own[k * 3] = f"new{k}"
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (got.class_id == 0).all()


def test_near_copies_of_odd_rows(spark):
    got = minhash.near_duplicates(odd(spark)).toPandas()
    classes = {None if pd.isna(d) else int(d): c for d, c in zip(got.doc_id, got.class_id, strict=True)}
    assert len(got) == 8 and classes[1] == 1 and classes[4] == 4 and pd.isna(classes[None])
    kept = minhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 8
    assert minhash.near_duplicates(empty(spark)).count() == 0


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=30))
def test_forest_keeps_components(pairs):
    def groups(links):
        label = {x: x for p in pairs for x in p}
        for _ in range(40):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    u, v = forest(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert groups(pairs) == groups(list(zip(u.tolist(), v.tolist(), strict=True)))


@given(st.lists(st.text(max_size=30), max_size=8))
def test_words_and_hashes(texts):
    for c in chunks(pa.array(texts, pa.string()), most=16):
        raw = c.data.tobytes()
        w = words_of(c)
        found = defaultdict(list)
        for s, e, d, h in zip(w.start, w.end, w.doc, w.hash, strict=True):
            assert c.start[d] <= s < e <= c.end[d]
            found[raw[s:e].lower() if raw[s:e].isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in raw[s:e])].append(h)
        assert all(len(set(hs)) == 1 for hs in found.values())
        if len(c.data) > 3:
            p = Prefix(c.data)
            assert (p.windows(3) == p.of(np.arange(len(c.data) - 2), np.arange(3, len(c.data) + 1))).all()


@pytest.mark.parametrize("name", ["op7_exact_topk", "op9_warc", "op10_vector_near_dedup"])
def test_queries_with_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, DATA).toPandas()) == plain(duck.sql(queries.SQL[name]).df())
