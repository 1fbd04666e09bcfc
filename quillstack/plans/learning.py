"""Queries around fitted models: validation, calibration, learnt orders, suggestions, names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import numbers as nm, text as tx
from ..operators import models
from ..sources.catalogue import Catalogue
from .lists import ITEMS, ROWS, THREE, rows

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Judged rows, and steps, of the fit of a list's weights; vectors, triples drawn from them, and steps, of the fit of the query shift.
WEIGHT_ROWS, WEIGHT_STEPS = 300, 2000
SHIFT_ROWS, SHIFT_TRIPLES, SHIFT_STEPS = 300, 600, 300
NAMES = ["red widget", "small ring", "ring", "blue"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _features(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).where("score is not null").select("item_id", "work", "grade", F.array(F.lit(1.0), F.col("size") / 50, F.col("price") / 1000, "score", "chance").alias("x"))


@query()
def cross_validation(spark: SparkSession, d: str) -> DataFrame:
    """Concordance of each penalty in five folds by work; folds and penalties are fitted in parallel on the bounded sample."""
    sample = models.bounded(_features(spark, d).where("grade is not null"), "item_id", models.RANKED_ROWS)
    task = spark.createDataFrame(sample.assign(fold=sample.work % 5))
    grid = task.crossJoin(spark.createDataFrame([(k, c) for k in range(5) for c in (0.01, 0.1, 1.0)], "held int, c double"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        held, c = int(group.held.iloc[0]), float(group.c.iloc[0])
        x, g, w, inside = np.stack(group.x.to_numpy()).astype(float), group.grade.to_numpy(), group.work.to_numpy(), (group.fold != held).to_numpy()
        z = x @ models.fit_pairwise(x[inside], g[inside], w[inside], c)
        b, o, _, _ = models.ranking_pairs(g[~inside], w[~inside])
        own = z[~inside]
        share = float(np.mean(np.where(own[b] > own[o], 1.0, np.where(own[b] == own[o], 0.5, 0.0)))) if len(b) else None
        return pd.DataFrame({"held": [held], "c": [c], "concordance": [share]})

    return grid.groupBy("held", "c").applyInPandas(fit, "held int, c double, concordance double")


@query()
def scorer_choice(spark: SparkSession, d: str) -> DataFrame:
    """The most cautious penalty within a standard error of the best."""
    by = cross_validation(spark, d).groupBy("c").agg(F.avg("concordance").alias("m"), (F.stddev_samp("concordance") / F.sqrt(F.count("*"))).alias("se"))
    best = by.orderBy(F.desc("m"), "c").limit(1).select((F.col("m") - F.col("se")).alias("least"))
    return by.crossJoin(F.broadcast(best)).where("m >= least").agg(F.min("c").alias("c"))


@query(f"""with {ROWS}, g as (select item_id, grade, size / 50 as a, price / 1000 as b from rows_ where grade is not null), q as (select item_id, size / 50 as a, price / 1000 as b from rows_ where item_id % 50 = 0),
n as (select q.item_id, g.grade, greatest((q.a * g.a + q.b * g.b) / (sqrt(q.a * q.a + q.b * q.b) * sqrt(g.a * g.a + g.b * g.b)), 0) + 1e-6 as w, row_number() over (partition by q.item_id order by round((q.a * g.a + q.b * g.b) / (sqrt(q.a * q.a + q.b * q.b) * sqrt(g.a * g.a + g.b * g.b)), 9) desc, g.item_id) as k from q join g on q.item_id <> g.item_id)
select item_id, round(sum(w * grade) / sum(w), 4) as score from n where k <= 20 group by 1""")
def knn_scorer(spark: SparkSession, d: str) -> DataFrame:
    """The mean grade of the twenty nearest graded items, by closeness, for the items asked about; in blocks of those."""
    own = rows(spark, d).select("item_id", "grade", F.array(F.col("size") / 50, F.col("price") / 1000).alias("v"))
    graded = own.where("grade is not null")
    near = models.nearest(graded, "item_id", "v", own.where("item_id % 50 = 0"), 20, digits=9)
    w = F.greatest("cosine", F.lit(0.0)) + 1e-6
    both = near.join(graded.select(F.col("item_id").alias("near"), "grade"), "near")
    return both.groupBy(F.col("asked").alias("item_id")).agg(F.round(F.sum(w * F.col("grade")) / F.sum(w), 4).alias("score"))


@query(f"""with {ROWS}, knot as (select floor(chance * 5) / 5 as x, avg((coalesce(grade, 0) >= 4)::int) as y from rows_ where chance is not null group by 1),
span as (select x as x0, y as y0, lead(x) over (order by x) as x1, lead(y) over (order by x) as y1 from knot)
select item_id, round(case when x1 is null then y0 else y0 + (y1 - y0) * (chance - x0) / (x1 - x0) end, 6) as fitted from rows_ join span on chance >= x0 and (x1 is null or chance < x1) where chance is not null""")
def piecewise_linear(spark: SparkSession, d: str) -> DataFrame:
    """Chances read off a curve between knots; the few knots go to every row as one array."""
    own = rows(spark, d).where("chance is not null")
    knots = own.groupBy((F.floor(F.col("chance") * 5) / 5).alias("x")).agg(F.avg((F.coalesce("grade", F.lit(0)) >= 4).cast("int")).alias("y")).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("k"))
    at = F.size(F.filter("k", lambda v: v["x"] <= F.col("chance")))
    a, b = F.element_at("k", at), F.try_element_at("k", at + 1)
    fitted = F.when(b.isNull(), a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (F.col("chance") - a["x"]) / (b["x"] - a["x"]))
    return own.crossJoin(F.broadcast(knots)).select("item_id", F.round(fitted, 6).alias("fitted"))


@query()
def value_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Slope and shift on the logit of each value's chances, bias-reduced; one small group a value."""
    own = rows(spark, d).where("grade is not null and chance is not null").select("source", nm.logit(F.least(F.greatest("chance", F.lit(0.01)), F.lit(0.99))).alias("z"), (F.col("grade") >= 4).cast("double").alias("y"))
    # sums by rounded logit keep a hot value's group as small as any other
    binned = own.groupBy("source", F.round("z", 1).alias("z"), "y").agg(F.count("*").alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        w = models.fit_logistic(np.stack((np.ones(len(group)), group.z.to_numpy()), 1), group.y.to_numpy(), ridge=1e-3, firth=True, count=group.n.to_numpy())
        return pd.DataFrame({"source": [group.source.iloc[0]], "shift": [w[0]], "slope": [w[1]]})

    return binned.groupBy("source").applyInPandas(fit, "source string, shift double, slope double")


@query()
def search_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of a list's features that order judged rows best, on the simplex."""
    sample = models.bounded(_features(spark, d).where("grade is not null"), "item_id", WEIGHT_ROWS)
    x, g, line = np.stack(sample.x.to_numpy()).astype(float)[:, 1:], sample.grade.to_numpy(), (sample.work % 10).to_numpy()
    b, o = np.nonzero((g[:, None] > g[None, :]) & (line[:, None] == line[None, :]))
    w = np.full(x.shape[1], 1 / x.shape[1])
    for t in range(WEIGHT_STEPS):
        z = (x[b] - x[o]) @ w
        w = models.on_simplex(w + 0.5 / np.sqrt(t + 1) * ((x[b] - x[o]) * models.sigmoid(-z)[:, None]).mean(0)) if len(b) else w
    return spark.createDataFrame([(n, float(v)) for n, v in zip(("size", "price", "score", "chance"), w, strict=True)], "feature string, weight double")


@query()
def query_shift(spark: SparkSession, d: str) -> DataFrame:
    """A shift of query vectors that brings them nearer to what fits than to what doesn't."""
    own = Catalogue(spark, d).vectors()
    sample = models.bounded(own, "vec_id", SHIFT_ROWS)
    v = np.stack(sample.embedding.to_numpy()).astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    y = sample.label.to_numpy()
    rng = np.random.default_rng(1)
    a, p, n = (rng.integers(0, len(v), SHIFT_TRIPLES) for _ in range(3))
    ok = (y[a] == y[p]) & (y[a] != y[n])
    a, p, n = a[ok], p[ok], n[ok]
    shift = np.zeros(v.shape[1])
    for _ in range(SHIFT_STEPS):
        z = ((v[a] + shift) * (v[p] - v[n])).sum(1) / 0.05 if len(a) else np.zeros(0)
        shift += 0.02 * (((v[p] - v[n]) * models.sigmoid(-z)[:, None]).mean(0) - 0.01 * shift) if len(a) else 0
    return own.select("vec_id", (nm.weighed("embedding", v[0]) + float(shift @ v[0])).alias("closeness"))


@query(f"with {ITEMS}, n(name) as (values ('red widget'), ('small ring'), ('ring'), ('blue')), f as (select item_id, name, row_number() over (partition by item_id order by length(name) desc) as k from items join n on contains(' ' || title || ' ', ' ' || name || ' ')) select item_id, name from f where k = 1")
def name_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The longest name of a dictionary that stands in a title, word by word."""
    found = F.filter(F.array(*map(F.lit, sorted(NAMES, key=len, reverse=True))), lambda n: F.contains(F.concat(F.lit(" "), F.col("title"), F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" "))))
    return Catalogue(spark, d).items().select("item_id", F.try_element_at(found, F.lit(1)).alias("name")).where("name is not null")


@query(f"with {ITEMS} select item_id, item_id % 2 = 0 as answered from items order by (item_id % 2 = 0) desc, md5(item_id::varchar), item_id limit 200")
def reference_set(spark: SparkSession, d: str) -> DataFrame:
    """The items kept to compare with: answered first, then by hash, as many as there is room for."""
    own = Catalogue(spark, d).items().select("item_id", (F.col("item_id") % 2 == 0).alias("answered"))
    return own.orderBy(F.desc("answered"), F.md5(F.col("item_id").cast("string")), "item_id").limit(200)


@query(f"with {ITEMS}, v as (select distinct unnest(words) as value from items), l as (select item_id, value, list_contains(words, value) as has from items cross join v) select value, sum(case when has then 1 when item_id % 5 = 0 then 1 else 0.25 end) as weight, sum(has::int)::bigint as label from l group by 1")
def labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Weight and label of every (item, value): had, rejected, or merely lacked; from counts, without listing the pairs."""
    own = Catalogue(spark, d).items().select("item_id", F.array_distinct("words").alias("words"))
    totals = own.agg(F.count("*").alias("n"), F.count_if(F.col("item_id") % 5 == 0).alias("r"))
    had = own.select(F.explode("words").alias("value"), (F.col("item_id") % 5 == 0).alias("said")).groupBy("value").agg(F.count("*").alias("label"), F.count_if("said").alias("hr"))
    weight = F.col("label") + (F.col("r") - F.col("hr")) + 0.25 * (F.col("n") - F.col("r") - F.col("label") + F.col("hr"))
    return had.crossJoin(F.broadcast(totals)).select("value", weight.alias("weight"), "label")


ASKED = ["the", "that", "with", "and", "der", "und"]


@query(f"""with t as (select doc_id, sha1(text) as print, list_distinct(regexp_extract_all(lower(text), '\\p{{L}}+')) as w from documents), s as (select doc_id, print, len(list_filter(w, lambda x: x in ({", ".join(repr(x) for x in ASKED)}))) / {len(ASKED)}.0 as score from t),
k as (select print, round(any_value(score), 2) as kept from s where doc_id % 3 = 0 group by 1) select doc_id, round(coalesce(kept, score), 6) as score, kept is not null as cached from s left join k using (print)""".replace("\\\\", "\\"))
def rerank_cached(spark: SparkSession, d: str) -> DataFrame:
    """The share of a line's words that a text has. Scores are kept, at two digits, by the print of the text, and only texts without one are scored."""
    own = Catalogue(spark, d).documents().select("doc_id", F.sha1("text").alias("print"), "text")
    score = F.size(F.array_intersect(F.array_distinct(tx.letter_words(F.lower("text"))), F.array(*map(F.lit, ASKED)))) / F.lit(float(len(ASKED)))
    kept = own.where("doc_id % 3 = 0").dropDuplicates(["print"]).select("print", F.round(score, 2).alias("kept"))
    new = own.join(kept, "print", "left_anti").select("doc_id", F.round(score, 6).alias("score"), F.lit(False).alias("cached"))
    return own.join(kept, "print").select("doc_id", F.round("kept", 6).alias("score"), F.lit(True).alias("cached")).unionByName(new)


@query(f"""with {ROWS}, k as (select item_id, score, score * case when item_id % 4 = 0 then 1.01 else 1.0 end as new_ from rows_ where score is not null) select item_id, {THREE('new_')} as score from k where {THREE('score')} <> {THREE('new_')}""")
def sweep_changes(spark: SparkSession, d: str) -> DataFrame:
    """Predictions that differ from those kept at three digits, and so are written."""
    own = rows(spark, d).where("score is not null").select("item_id", "score", (F.col("score") * F.when(F.col("item_id") % 4 == 0, 1.01).otherwise(1.0)).alias("new"))
    from ..operators.listing import kept_digits

    return own.where(kept_digits(F.col("score")) != kept_digits(F.col("new"))).select("item_id", kept_digits(F.col("new")).alias("score"))
