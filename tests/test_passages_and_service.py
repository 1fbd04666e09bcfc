"""Quotes against a plain walk, the model of tags against a dense one, writing after quiet, and the search service."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.operators import mixed, quotes, service, stored
from quillstack.plans import passages
from quillstack.streaming import folds, quiet


def plain_quotes(body, names):
    """Passages of one paragraph, name by name."""
    at = sorted((m.start(), m.end() - 1) for n in names for m in re.finditer(re.escape(n), body, re.I | re.A))
    if len(body) <= 480:
        return [(body, at)] if at else []
    groups = []
    for r in at:
        if groups and r[0] - groups[-1][-1][1] <= 320:
            groups[-1].append(r)
        else:
            groups.append([r])
    out = []
    for g in groups:
        a, b = max(g[0][0] - 160, 0), min(g[-1][1] + 161, len(body))
        if a > 0 and a <= (s := body.find(" ", a)) < g[0][0]:
            a = s + 1
        if b < len(body) and (s := body.rfind(" ", 0, b + 1)) > g[-1][1]:
            b = s
        before = "… " if a else ""
        out.append((before + body[a:b] + (" …" if b < len(body) else ""), [(x - a + len(before), y - a + len(before)) for x, y in g]))
    return out


def test_quotes_are_those_of_a_plain_walk(spark):
    rng = np.random.default_rng(4)
    words = ["name", "Word", "é", "日本", "x" * 30, "long", "naMEs"]
    texts = ["\n".join(" ".join(rng.choice(words, p=[0.02, 0.3, 0.1, 0.1, 0.08, 0.39, 0.01], size=rng.integers(0, 400))) for _ in range(4)) for _ in range(40)]
    texts += [None, "", "name", "a.b name" + "y" * 900 + "name", "a.b", "axb", "NAME\n\nname"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = quotes.quotes(quotes.named_paragraphs(docs, "id", "text", ["name", "a.b"])).collect()
    want = [(k, p, q, " ".join(f"{a}-{b}" for a, b in marks)) for k, t in enumerate(texts) for p, body in enumerate((t or "").split("\n"), 1) for q, marks in plain_quotes(body, ["name", "a.b"])]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 60


def test_mixed_model_is_the_dense_one(spark):
    rng = np.random.default_rng(8)
    n, tags = 900, np.minimum(rng.geometric(0.4, 900), 12)
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [1.5, -1.0] + np.sin(tags))))).astype(int)
    rows = [(f"t{t}", float(a), float(b), int(c)) for t, (a, b), c in zip(tags, x, y, strict=True)] + [("none", None, 1.0, 1), ("t1", 1.0, 1.0, None)]
    model = mixed.fit(spark.createDataFrame(rows, "tag string, a double, b double, y int"), ["a", "b"], "y", spread=1.5, penalty=0.1)
    names, at = np.unique(tags, return_inverse=True)
    full = np.concatenate((x, np.eye(len(names))[at]), 1)
    penalty, w = np.array([0.1, 0.1, *[1 / 1.5**2] * len(names)]), np.zeros(2 + len(names))
    for _ in range(60):
        p = 1 / (1 + np.exp(-full @ w))
        w = w - np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty), full.T @ (p - y) + penalty * w)
    biases = {r.tag: r.bias for r in model.biases.collect()}
    assert np.allclose(model.weights, w[:2], atol=1e-6)
    assert np.allclose([biases[f"t{t}"] for t in names], w[2:], atol=1e-6)
    told = model.chance(spark.createDataFrame([("new", 0.0, 0.0)], "tag string, a double, b double"), ["a", "b"]).first()
    assert told.chance == 0.5


def test_tags_of_held_out_documents(spark):
    d = "/root/testdata/sf0.001"
    got = passages.tags_by_text(spark, d).toPandas()
    docs = spark.read.parquet(f"{d}/documents.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").select("doc_id", "lang", "text").toPandas()
    best = got.loc[got.groupby("key").chance.idxmax()].merge(docs, left_on="key", right_on="doc_id")
    assert len(best) > 20 and (best.tag == best.lang).mean() > 0.9
    assert all(r.text.split("\n")[r.paragraph - 1][:160] == r.quote for r in best.itertuples())


def test_writing_after_quiet_with_two_bursts_and_a_restart(spark, tmp_path):
    """A burst is written once it is over, one that goes on waits, and a new object of the same name goes on where the last ended."""
    kinds = "event_id long, user_id long, event_type string, value double, ts timestamp"

    def log(part, rows):
        out = [(i, u, k, float(v), f"2024-01-01 00:{m:02d}:{s:02d}") for i, (u, k, v, m, s) in enumerate(rows, 100 * part)]
        spark.createDataFrame(out, kinds.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        next((tmp_path / f"p{part}").glob("*.parquet")).rename(tmp_path / "events.parquet" / f"part-{part}.parquet")

    name = uuid.uuid4().hex
    told = lambda index: sorted((r.user_id, r.event_type, r.changes, r.value) for r in index.documents().collect())
    log(1, [(1, "a", 1, 0, 0), (1, "b", 2, 0, 20), (1, "a", 3, 0, 40), (2, "a", 9, 5, 0)])
    index = quiet.QuietIndex(spark, name, quiet="1 minute")
    assert index.catch_up(str(tmp_path)) == 1 and told(index) == [(1, "a", 2, 3.0), (1, "b", 1, 2.0)]
    assert index.catch_up(str(tmp_path)) == 0
    log(2, [(2, "a", 8, 5, 30), (1, "a", 4, 10, 0), (3, "c", 7, 20, 0)])
    index = quiet.QuietIndex(spark, name, quiet="1 minute")
    assert index.catch_up(str(tmp_path)) == 2 and told(index) == [(1, "a", 3, 4.0), (1, "b", 1, 2.0), (2, "a", 2, 8.0)]
    log(3, [(4, "c", 7, 40, 0)])
    assert quiet.QuietIndex(spark, name, quiet="1 minute").catch_up(str(tmp_path)) == 1
    assert len(folds.whole(spark, f"{index.root}/batches")) == len(folds.whole(spark, f"{index.root}/folded")) == 1 and told(index) == [(1, "a", 3, 4.0), (1, "b", 1, 2.0), (2, "a", 2, 8.0), (3, "c", 1, 7.0)]


def test_no_scope_is_quiet_yet(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a", 1.0, "2024-01-01 00:00:00")], "event_id long, user_id long, event_type string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    index = quiet.QuietIndex(spark, uuid.uuid4().hex)
    assert index.catch_up(str(tmp_path)) == 0 and index.documents().count() == 0


def test_search_gets_better_on_lines_that_were_not_learnt_from(spark):
    from quillstack.plans import search

    told = search.search_learnt(spark, "/root/testdata/sf0.01").toPandas().sort_values("turn")
    assert told.reciprocal.iloc[-1] > told.reciprocal.iloc[0] + 0.02 and np.allclose(told.close + told.words, 1)


@pytest.mark.parametrize("weights", [(1.0, 0.0), (0.3, 0.7)])
def test_service_orders_candidates_of_both_parts(spark, weights):
    from quillstack.operators import service
    from quillstack.plans import search

    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["red fox runs", "red fox", "blue bird sings", "the quick fox", "bird", None, ""] * 3)], "key long, title string")
    index = search.stored.StoredIndex.build(docs, "key", ["title"], {"one": F.lit("x")})
    own = service.Service(index, search.hashed(docs, "key", "title"), "title", weights=weights).opened()
    lines = spark.createDataFrame([(900, "red fox"), (901, "bird"), (902, "nothing here zzz")], "asked long, line string")
    got = own.search(lines.join(search.hashed(lines, "asked", "line"), "asked")).toPandas().sort_values(["asked", "place"])
    assert got[got.asked == 900].key.head(3).tolist() == [1, 8, 15] and got[got.asked == 901].key.head(3).tolist() == [4, 11, 18]
    assert (got.groupby("asked").score.diff().fillna(0) <= 1e-8).all() and not got.duplicated(["asked", "key"]).any()


def test_words_of_lines_without_a_row_a_pair(spark):
    """The best documents by words against every pair; equal ones by key."""
    rng = np.random.default_rng(8)
    docs = [(k, " ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(1, 8)) if x < 60)) for k in range(900)] + [(900, None), (901, "alone")]
    index = stored.StoredIndex.build(spark.createDataFrame(docs, "key long, title string"), "key", ["title"], {"all": F.lit("x")})
    vectors = spark.createDataFrame([(k, [1.0]) for k, _ in docs], "key long, v array<double>")
    lines = [(5000 + k, docs[7 * k][1]) for k in range(100)] + [(6000, "nothing here"), (6001, "alone W1 w1")]
    opened = service.Service(index, vectors, "title").opened()
    got = opened.by_words(spark.createDataFrame(lines, "asked long, line string")).toPandas().sort_values(["asked", "words", "key"], ascending=[True, False, True])
    sets = {k: set(t.split()) for k, t in docs if t}
    x = {w: np.log1p(len(docs) / sum(w in s for s in sets.values())) for s in sets.values() for w in s}
    for asked, line in lines:
        own = sorted({w for w in line.lower().split() if w in x})
        all_ = sum(x[w] for w in own)
        want = sorted(((-sum(x[w] for w in own if w in s) / all_, k) for k, s in sets.items() if s & set(own)))[:30] if own else []
        mine = got[got.asked == asked]
        assert mine.key.tolist() == [k for _, k in want] and np.allclose(mine.words, [-s for s, _ in want])
    # before, lines and documents met in a join by word
    plan = opened.by_words(spark.createDataFrame(lines, "asked long, line string"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
