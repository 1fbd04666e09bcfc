"""Search, vectors, archives, models and the pipeline."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import DATA
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillstack.llm import quality, sketches, topk, toxicity, vectors, warc
from quillstack.llm.store import Scratch

ODD = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.99, 0.05]), (100, [0.0, 1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (8, []), (9, [1.0])]


def odd(spark):
    return spark.createDataFrame([(i, v, i) for i, v in ODD], "vec_id long, embedding array<float>, score long")


def test_topk_of_odd_rows(spark):
    got = topk.top_k(odd(spark), k=3).toPandas()
    assert (got.query_id == 100).all() and len(got) == 3
    assert got.sort_values("rank").vec_id.tolist() == [7, 1, 1]
    assert topk.top_k(odd(spark).where("false")).count() == 0


@settings(deadline=None, max_examples=3)
@given(st.integers(0, 10**6), st.integers(1, 5), st.integers(1, 4))
def test_topk_against_brute_force(spark, seed, nodes, k):
    """Few values, so that scores tie at the k-th place; several blocks of queries; a column named like a result."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-2, 3, (60, 5)) / 1024
    frame = pd.DataFrame({"vec_id": rng.permutation(60), "embedding": [r.tolist() for r in x], "rank": "x", "node": 1})
    before, topk.QUERY_BLOCK = topk.QUERY_BLOCK, 4
    try:
        got = topk.top_k(spark.createDataFrame(frame), k, every=5, nodes=nodes).toPandas()
    finally:
        topk.QUERY_BLOCK = before
    v = {i: np.floor(1024 * r).astype(int) for i, r in zip(frame.vec_id, x, strict=True)}
    want = []
    for q in sorted(i for i in v if i % 5 == 0):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:k]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    assert sorted(got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == sorted(want)


@settings(deadline=None, max_examples=20)
@given(st.integers(0, 10**6))
def test_product_is_exact(seed):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-(2**40), 2**40, (3, 4)), rng.integers(-(2**20), 2**20, (2, 4))
    want = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in q] for r in x]
    assert topk.product(x, q).tolist() == want


def test_vectors_of_odd_rows(spark):
    got = vectors.near_vectors(odd(spark)).toPandas()
    by = got.groupby("vec_id", dropna=False)
    assert len(got) == len(ODD)
    assert (by.get_group(1).n_links == 3).all() and by.get_group(2).component_id.tolist() == [1]
    assert by.get_group(7).n_links.tolist() == [3] and by.get_group(3).n_links.tolist() == [0]
    assert by.get_group(9).component_id.tolist() == [9]
    assert vectors.near_vectors(odd(spark).where("false")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 16))
    x = np.repeat(centres, 40, 0) + 0.2 * rng.normal(size=(2400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vectors.Graph.build(x.astype(np.float32))
    q, r, sought, missed = vectors.links_in(graph, x, x[::5], 0.9, own_row=np.arange(0, 2400, 5))
    assert sought > 0 and missed <= 0.01 * sought
    truth = (x[::5] @ x.T >= 0.9).sum()
    assert len(q) >= 0.99 * truth and (np.einsum("ij,ij->i", x[::5][q], x[r]) >= 0.9).all()


def test_recall_of_a_whole_shard():
    """Groups of near vectors among unrelated ones, in a shard of SHARD_ROWS."""
    rng = np.random.default_rng(1)
    n = vectors.SHARD_ROWS
    x = np.concatenate((np.repeat(rng.normal(size=(500, 64)), 20, 0) + 0.25 * rng.normal(size=(10_000, 64)), rng.normal(size=(n - 10_000, 64))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = np.concatenate((np.arange(0, 10_000, 20), np.arange(10_000, n, 80)))
    q, _, sought, missed = vectors.links_in(vectors.Graph.build(x.astype(np.float32)), x, x[own], 0.9, own_row=own)
    assert len(q) >= 0.998 * (x[own] @ x.T >= 0.9).sum() and sought > 1000 and missed <= 0.001 * sought


def test_links_missed_from_one_end_are_told():
    """Balances of all blocks and shards are 0 but at both ends of a link that one end missed."""
    rep, copies = np.arange(100, 140), np.full(40, 2)
    hit = np.random.default_rng(3).random((40, 40)) < 0.3
    hit = (hit | hit.T) & ~np.eye(40, dtype=bool)
    hit[:, :2] = hit[:2] = False
    found = hit.copy()
    a, b = np.argwhere(hit)[0]
    found[a, b] = False

    def balance(found):
        total, linked = dict.fromkeys(rep.tolist(), 0), dict.fromkeys(rep.tolist(), 0)
        for block in (rep[:25], rep[25:]):
            for shard in (rep[:10], rep[10:]):
                q, r = np.nonzero(found[np.ix_(block - 100, shard - 100)])
                for u, n, s in zip(*vectors.both_sides(block, shard, copies[: len(shard)], q, r), strict=True):
                    total[int(u)] += int(s)
                    linked[int(u)] += int(n)
        return {u for u, s in total.items() if s}, linked

    assert balance(hit) == (set(), {int(u): int(n) * 2 for u, n in zip(rep, hit.sum(1), strict=True)})
    assert balance(found)[0] == {100 + int(a), 100 + int(b)}


def test_whole_shards_when_the_beam_is_widest():
    x = np.random.default_rng(8).normal(size=(900, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vectors.Graph.build(x.astype(np.float32))
    q, r, _, missed = vectors.links_in(graph, x, x[:50], 0.9, vectors.WIDEST)
    assert missed == 0
    assert set(zip(q.tolist(), r.tolist())) == set(zip(*(z.tolist() for z in np.nonzero(x[:50] @ x.T >= 0.9))))


def test_links_at_the_threshold(spark):
    """A cosine of exactly 0.9 links, one just below does not; several shards and blocks, every link counted from both ends."""
    rows = [(0, [1.0, 0.0, 0.0]), (1, [9.0, np.sqrt(19.0), 0.0]), (2, [0.8999999, 0.0, np.sqrt(1 - 0.8999999**2)])]
    got = vectors.near_vectors(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")
    unit = [np.array(v) / np.sqrt(np.dot(v, v)) for _, v in rows]
    assert got.n_links.to_dict() == {i: sum(unit[i] @ unit[j] >= 0.9 for j in range(3) if j != i) for i in range(3)}
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 8)), 5, 0) + 0.15 * rng.normal(size=(200, 8))
    before, vectors.BLOCK_ROWS = vectors.BLOCK_ROWS, 64
    try:
        got = vectors.near_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), shard_rows=30).toPandas().set_index("vec_id")
    finally:
        vectors.BLOCK_ROWS = before
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got.n_links.sort_index().tolist() == ((u @ u.T >= 0.9).sum(1) - 1).tolist()


def test_pooled_audits(spark):
    """Audits of all blocks and shards add up; under the target all rows are asked again, and then nothing is missed."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(12, 8)), 25, 0) + 0.2 * rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = ((u @ u.T >= 0.9).sum(1) - 1).tolist()
    got, audit = vectors.audited(rows)
    assert 0 < audit.links <= sum(truth) and audit.recall >= vectors.RECALL and not audit.repeated
    assert got.toPandas().set_index("vec_id").n_links.sort_index().tolist() == truth
    got, audit = vectors.audited(rows, recall=1.01)
    assert audit.repeated and got.toPandas().set_index("vec_id").n_links.sort_index().tolist() == truth
    assert vectors.audited(rows.where("false"))[1] == vectors.Audit(0, 0)


def test_archives_read_back_by_index(spark):
    rows = [(1, "http://a", "<p>" + "x" * 200), (2, "http://b", "<p>" + "x" * 200), (3, None, None), (4, "http://c\r\nX: y", "short"), (5, "u", "short"), (None, "n", "<p>" + "x" * 200), (1, "http://a", "<p>" + "x" * 200)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    scratch = Scratch(spark, "warc-test")
    index = warc.write_archives(pages, scratch.path("bundles"), scratch)
    for r in index.collect():
        reader = warc.BundleReader(r.bundle)
        fields, block = reader.record(r.frame, r.offset)
        assert fields["warc-record-id"] == r.record_id and b"Content-Length" in block
        reader.close()
    got = warc.read_archives(index).toPandas()
    kinds = {(None if pd.isna(p) else int(p)): k for p, k in zip(got.page_id, got.record_type, strict=True)}
    assert kinds == {1: "response", 2: "revisit", 3: "response", 4: "response", 5: "response", None: "revisit"} and len(got) == 7
    assert got[got.page_id == 2].refers_to.tolist() == [1] and got[got.page_id == 2].payload_bytes.tolist() == [203]
    assert warc.archive_and_read(pages.where("false")).count() == 0


def test_frames_stand_alone(tmp_path):
    bundle = warc.Bundle(f"file://{tmp_path}")
    payloads = [bytes([65 + k % 26]) * 400_000 for k in range(9)]
    places = [bundle.add(warc.record(k, "u", p, "d", len(p), None, False)) for k, p in enumerate(payloads)]
    bundle.close()
    reader = warc.BundleReader(bundle.path)
    assert len(reader.sizes) > 2
    for k in (8, 0, 5):
        fields, block = reader.record(*places[k])
        assert block.endswith(payloads[k]) and fields["warc-record-id"] == f"<urn:page:{k}>"
    reader.close()


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=20), min_size=1, max_size=4))
def test_repeats_are_always_suspected(parts):
    filters = []
    for p in parts:
        f = sketches.SeenTwice(8192)
        f.add(np.array(p, np.uint64))
        filters.append(f.arrays("x")["x"].tobytes())
    out = sketches.SeenTwice(8192)
    out.twice = np.ascontiguousarray(np.frombuffer(sketches.SeenTwice.join(filters, "x"), np.uint8).reshape(-1, 2, 1024)[:, 1]).reshape(-1)
    every = np.array([x for p in parts for x in p], np.uint64)
    own, n = np.unique(every, return_counts=True)
    assert out.suspected(own[n > 1]).all()


def toxic_corpus(spark, n=600):
    rng = np.random.default_rng(7)
    words = np.array([f"plain{k}" for k in range(3000)])
    rows, labels = [], []
    for k in range(n):
        own, bad = rng.choice(words, 40).tolist(), k % 5 == 0
        if bad:
            for at in rng.integers(0, 40, 3):
                own[at] = rng.choice(["vile", "nasty", "rotten"])
        rows.append((k, " ".join(own) + "."))
        labels.append((k, int(bad), int(k % 2)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxic_documents_and_spans(spark):
    docs, labels = toxic_corpus(spark)
    field = toxicity.fit(docs, labels)
    got = toxicity.score(docs, field).join(labels, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.98
    for r in got[got.toxic == 1].head(20).itertuples():
        assert {w for s in r.spans for w in r.text[s.start : s.end].split()} & {"vile", "nasty", "rotten"}


def test_toxic_sample_does_not_follow_the_table(spark):
    """A document over the bound leads the table, and toxic ones stand at its end."""
    docs, labels = toxic_corpus(spark)
    longest = spark.createDataFrame([(k, "plain1 " * 20_000) for k in (1000, 1001, 1002)], "doc_id long, text string")
    clean = spark.createDataFrame([(k, 0, 0) for k in (1000, 1001, 1002)], "doc_id long, toxic int, quality int")
    table = longest.coalesce(1).unionByName(docs.join(labels, "doc_id").orderBy("toxic", "doc_id").select("doc_id", "text").coalesce(1))
    field = toxicity.fit(table, labels.unionByName(clean), tokens=12_000)
    got = toxicity.score(docs, field).join(labels, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.98


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(toxicity.BUCKETS, np.float32), -0.3, rng.normal(size=(2, 2)), np.zeros(3))
    word = rng.integers(0, 50, (7, toxicity.TRAITS))
    field.weight[:50] = rng.normal(size=50)
    ends = np.array([0, 4, 7])
    want, moves = np.zeros(7), np.zeros((2, 2))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        total, own, pair = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for path in np.ndindex(*(2,) * (b - a)):
            s = sum(y * (field.weight[word[a + t]].sum() + field.bias) for t, y in enumerate(path)) + sum(field.transition[x, y] for x, y in zip(path, path[1:], strict=False))
            total += np.exp(s)
            own += np.exp(s) * np.array(path)
            for x, y in zip(path, path[1:], strict=False):
                pair[x, y] += np.exp(s)
        want[a:b] = own / total
        moves += pair / total
    got, expected = field.expectations(word, ends, np.ones(len(ends) - 1))
    assert np.allclose(got, want, atol=1e-5) and np.allclose(expected, moves, atol=1e-5)


def test_thinned_sentences_keep_their_weight():
    """A field fitted on a tenth of the plain sentences expects about as many toxic tokens as one fitted on all.

    Words that no drawn sentence holds have no weight, which leaves about a tenth; without weights it is a quarter and more.
    """
    rng = np.random.default_rng(2)

    def document(toxic):
        w = np.repeat(rng.integers(100, 2000, (240, 1)), toxicity.TRAITS, 1)
        at = rng.choice(240, 24, replace=False)
        w[at] = rng.integers(1, 9, (24, 1)) if toxic else w[at]
        # a toxic word's neighbour that other documents have too
        w[::7] = 50
        return w.astype(np.int32)

    y = np.arange(60) % 3 == 0
    sample = toxicity.Sample([document(t) for t in y], [np.arange(0, 240, 8, dtype=np.int32) for _ in y], y.astype(int))
    whole, thin = (toxicity.train(sample, plain=n) for n in (10**9, 180))

    def toxic_mass(field):
        return sum(field.marginals(w, np.append(h, len(w))).sum() for w, h in zip(sample.words, sample.heads, strict=True))

    assert abs(toxic_mass(thin) / toxic_mass(whole) - 1) < 0.15


def test_models_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "vile words here", None), (3, "a " * 50_000, 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for module in (toxicity, quality):
        got = module.scored(docs, labels).toPandas()
        assert len(got) == 4 and got.score.between(0, 1).all()
        assert module.scored(docs.where("false"), labels).count() == 0


def test_quality_is_learnt(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.scored(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.8


def test_pooling_is_a_mean():
    from quillstack.llm.rolling import chunks

    rng = np.random.default_rng(0)
    w, s = rng.normal(size=(quality.WORDS, quality.WIDTH)), rng.normal(size=(quality.SHAPES, quality.WIDTH))
    for c in chunks(pa.array(["Some words, SOME words!!", "", "one"])):
        word, shape, doc = quality.stream(c)
        x = quality.pooled(c, w, s)
        assert np.allclose(x[0, : quality.WIDTH], w[word[doc == 0]].mean(0)) and (x[1] == 0).all()
        assert np.allclose(x[2, quality.WIDTH : -1], s[shape[doc == 2]].mean(0))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "suffix_dedup", "packing"]
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0 < docs.count() <= n
        n = docs.count()
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, DATA).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("text", ["", None])
def test_stages_take_empty_tables(spark, text):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_stages_leave_other_columns_alone(spark):
    """Columns with the names of what stages add, and of what they use inside, come through each stage as they were."""
    import corpus_pipeline

    names = ["score", "n_lines", "kept", "__id", "class_id", "spans", "other_columns", "N_Removed"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k} "), "doc_id"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[name] == f"{k} {r.doc_id}" for r in rows for k, name in enumerate(names))
