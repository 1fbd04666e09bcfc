"""Statistics, vectors, ranking, suggestions, duplicates, search and change queries."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import numbers as nm, text as tx
from ..operators import listing, models, pooling
from ..sources.catalogue import Catalogue
from ..streaming import changes, quiet
from .lists import ITEMS, RATINGS, ROWS, rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- statistics ---


@query(f"with {ITEMS}, v as (select item_id, unnest(words) as value from items), n as (select count(distinct item_id) as n from items) select value, round(ln(any_value(n.n)::double / count(distinct item_id)), 6) as idf from v, n group by value")
def idf_values(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).items().select("item_id", F.array_distinct("words").alias("words"))
    total = own.agg(F.count("*").alias("total"))
    return own.select(F.explode("words").alias("value")).groupBy("value").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("value", F.round(F.ln(F.col("total") / F.col("n")), 6).alias("idf"))


@query("select p_brand as source, round(avg(p_retailprice), 4) as mean, round(greatest(stddev_pop(p_retailprice), 1e-6), 4) as spread, count(*) as n from part group by 1 having count(*) >= 2")
def number_spreads(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).items().groupBy("source").agg(F.round(F.avg("price"), 4).alias("mean"), F.round(F.greatest(F.stddev_pop("price"), F.lit(1e-6)), 4).alias("spread"), F.count("*").alias("n"))
    return own.where("n >= 2")


@query(f"with {ROWS} select tag, count(*) as n from (select unnest(words) as tag from rows_ where grade is not null) group by tag having count(*) >= 2")
def feature_support(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).where("grade is not null").select(F.explode("words").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).where("n >= 2")


@query("with v as (select vec_id, generate_subscripts(embedding, 1) as k, unnest(embedding)::double as x from embeddings) select k - 1 as place, round(avg(x), 5) as centre, round(stddev_pop(x), 5) as spread from v group by k")
def spread_of_vectors(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).vectors().select(F.posexplode("embedding").alias("place", "x"))
    return own.groupBy("place").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("centre"), F.round(F.stddev_pop(F.col("x").cast("double")), 5).alias("spread"))


@query("with v as (select label, generate_subscripts(embedding, 1) as k, unnest(embedding)::double as x from embeddings) select label, k - 1 as place, round(avg(x), 5) as mean from v group by 1, 2")
def group_mean_vector(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).vectors().select("label", F.posexplode("embedding").alias("place", "x"))
    return own.groupBy("label", "place").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("with v as (select label, generate_subscripts(embedding, 1) as k, unnest(embedding)::double as x from embeddings) select label, k - 1 as place, round(quantile_cont(x, 0.05), 5) as q05, round(quantile_cont(x, 0.5), 5) as q50, round(quantile_cont(x, 0.95), 5) as q95 from v group by 1, 2")
def set_quantile_embedding(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).vectors().select("label", F.posexplode("embedding").alias("place", "x"))
    q = nm.quantiles(own, ["label", "place"], F.col("x"), (0.05, 0.5, 0.95))
    return q.select("label", "place", *(F.round(F.col(f"q{i}"), 5).alias(n) for i, n in enumerate(("q05", "q50", "q95"))))


@query(f"with {ITEMS} select work, round(avg(price), 4) as mean_price, max(size) as top_size, round((min(size) + max(size)) / 2, 4) as agreed_size from items group by work")
def work_joined_numbers(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).items().groupBy("work").agg(F.round(F.avg("price"), 4).alias("mean_price"), F.max("size").alias("top_size"), F.round((F.min("size") + F.max("size")) / 2, 4).alias("agreed_size"))


@query("select o_custkey as who, min(substr(o_orderpriority, 1, 1))::int as first_step from orders group by 1")
def first_listed_status(spark: SparkSession, d: str) -> DataFrame:
    scale = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))
    place = F.array_position(scale, F.col("o_orderpriority")).cast("int")
    return Catalogue(spark, d).table("orders").groupBy(F.col("o_custkey").alias("who")).agg(F.min(place).alias("first_step"))


@query(f"""with {ROWS}, b as (select least(floor(chance * 10000), 9999)::bigint as bin, count(*) as n, sum(chance) as s, min(chance) as least_ from rows_ where chance is not null group by 1),
r as (select *, sum(n - s) over (order by bin desc) as shown, sum(s) over () - sum(s) over (order by bin desc) as hidden from b) select round(max(least_), 6) as cutoff from r where shown >= hidden""")
def histogram_cutoff_balanced(spark: SparkSession, d: str) -> DataFrame:
    return nm.balanced_cutoff(rows(spark, d).where("chance is not null"), "chance").select(F.round("cutoff", 6).alias("cutoff"))


RANKED = f"with {ROWS}, g as (select grade::double as a, score as b from rows_ where grade is not null and score is not null), r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb, a >= 4 as good from g)"


@query(f"{RANKED} select round(corr(ra, rb), 6) as spearman from r")
def ranks_spearman(spark: SparkSession, d: str) -> DataFrame:
    return nm.spearman(rows(spark, d).where("grade is not null and score is not null"), "grade", "score").select(F.round("spearman", 6).alias("spearman"))


@query(f"{RANKED} select round((sum(rb) filter (where good) - count(*) filter (where good) * (count(*) filter (where good) + 1) / 2.0) / (count(*) filter (where good) * count(*) filter (where not good)), 6) as auc from r")
def auc_rank_sum(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d).where("grade is not null and score is not null").withColumn("good", F.col("grade") >= 4)
    return nm.auc(own, "score", "good").select(F.round("auc", 6).alias("auc"))


@query(f"""with {ROWS}, g as (select work % 5 as fold, work, grade, score from rows_ where grade is not null and score is not null)
select a.fold, round(avg(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end), 6) as concordance from g a join g b on a.fold = b.fold and a.grade > b.grade and a.work <> b.work group by 1""")
def concordance_by_fold(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d).where("grade is not null and score is not null").select((F.col("work") % 5).alias("fold"), "work", "grade", "score")
    return nm.concordance(own, "fold").select("fold", F.round("concordance", 6).alias("concordance"))


@query(f"""with {ROWS}, g as (select grade, quantile_cont(score, 0.5) as m, count(*)::double as n from rows_ where grade is not null and score is not null group by 1),
w as (select a.grade as lo, b.grade as hi, sum(x.m * x.n) / sum(x.n) as avg_ from g a, g b, g x where a.grade <= x.grade and x.grade <= b.grade group by 1, 2)
select g.grade, round(max(low), 6) as place from g, (select g.grade as at_, w.lo, min(w.avg_) as low from g join w on w.lo <= g.grade and w.hi >= g.grade group by 1, 2) where at_ = g.grade group by g.grade""")
def ladder_pava(spark: SparkSession, d: str) -> DataFrame:
    """Medians of scores a grade, made increasing."""
    medians = rows(spark, d).where("grade is not null and score is not null")
    n = medians.groupBy("grade").agg(F.count("*").cast("double").alias("n"))
    medians = nm.quantiles(medians, ["grade"], F.col("score"), [0.5]).select("grade", F.col("q0").alias("m")).join(n, "grade")
    return pooling.isotonic(medians, "grade", "m", "n").select("grade", F.round("fitted", 6).alias("place"))


@query(f"""with {ROWS}, g as (select floor(chance * 10)::int as bin, (count(*) filter (where grade >= 4) + 0.5) / (count(*) + 1.0) as m, count(*)::double as n from rows_ where grade is not null group by 1),
w as (select a.bin as lo, b.bin as hi, sum(x.m * x.n) / sum(x.n) as avg_ from g a, g b, g x where a.bin <= x.bin and x.bin <= b.bin group by 1, 2)
select g.bin, round(max(low), 6) as chance from g, (select g.bin as at_, w.lo, min(w.avg_) as low from g join w on w.lo <= g.bin and w.hi >= g.bin group by 1, 2) where at_ = g.bin group by g.bin""")
def isotonic_curve(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d).where("grade is not null").groupBy(F.floor(F.col("chance") * 10).cast("int").alias("bin")).agg(((F.count_if(F.col("grade") >= 4) + 0.5) / (F.count("*") + 1.0)).alias("m"), F.count("*").cast("double").alias("n"))
    return pooling.isotonic(own, "bin", "m", "n").select("bin", F.round("fitted", 6).alias("chance"))


@query(f"""with {ITEMS}, s as (select type, avg(price) as m, stddev_samp(price) / sqrt(count(*)) as se from items group by 1), best as (select m, se from s order by m desc, type limit 1)
select min(type) as chosen from s, best where s.m >= best.m - best.se""")
def one_se_choice(spark: SparkSession, d: str) -> DataFrame:
    """The first candidate within a standard error of the best."""
    own = Catalogue(spark, d).items().groupBy("type").agg(F.avg("price").alias("m"), (F.stddev_samp("price") / F.sqrt(F.count("*"))).alias("se"))
    best = own.orderBy(F.desc("m"), "type").limit(1).select((F.col("m") - F.col("se")).alias("least"))
    return own.crossJoin(F.broadcast(best)).where("m >= least").agg(F.min("type").alias("chosen"))


@query("with k as (select l_returnflag as f, avg(l_quantity) as e, var_pop(l_quantity) / count(*) as v from lineitem group by 1), s as (select sum(1/v) as w, sum(1/v/v) as w2, sum(e/v) as we, sum(e*e/v) as we2, count(*) as n from k) select round(greatest((we2 - we*we/w - (n-1)) / (w - w2/w), 0), 6) as tau2 from s")
def dersimonian_laird(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("e"), (F.var_pop("l_quantity") / F.count("*")).alias("v"))
    return nm.between_variance(own, "e", "v").select(F.round("tau2", 6).alias("tau2"))


@query(f"with {RATINGS}, f as (select item_id, row_number() over (order by md5(item_id::varchar), item_id) as k from (select distinct item_id from ratings)) select item_id, ((k - 1) % 5)::int as fold from f")
def folds_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Rows dealt round in order of a hash, from counts of partitions instead of one global window."""
    own = Catalogue(spark, d).ratings().select("item_id").distinct().withColumn("h", F.md5(F.col("item_id").cast("string")))
    own = own.withColumn("b", F.substring("h", 1, 2))
    before = own.groupBy("b").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "before")
    placed = own.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("h", "item_id"))).join(F.broadcast(before), "b")
    return placed.select("item_id", ((F.col("k") - 1 + F.col("before")) % 5).cast("int").alias("fold"))


@query(f"with {RATINGS} select a.grade as better, b.grade as worse, count(*) as pairs from (select distinct work, grade from ratings) a join (select distinct work, grade from ratings) b on a.grade > b.grade and a.work <> b.work group by 1, 2")
def pairs_theta_by_grade(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of works by their two grades: products of counts, less the pairs inside a work, so that none is made."""
    own = Catalogue(spark, d).ratings().select("work", "grade").distinct()
    n = own.groupBy("grade").agg(F.count("*").alias("n"))
    inside = own.groupBy("work").agg(F.array_sort(F.collect_set("grade")).alias("g"))
    both = F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: y < x), lambda y: F.struct(x.alias("better"), y.alias("worse")))))
    same = inside.select(F.explode(both).alias("p")).groupBy("p.better", "p.worse").agg(F.count("*").alias("same"))
    steps = n.select(F.col("grade").alias("better"), F.col("n").alias("a")).join(n.select(F.col("grade").alias("worse"), F.col("n").alias("b")), F.col("better") > F.col("worse"))
    pairs = F.col("a") * F.col("b") - F.coalesce("same", F.lit(0))
    return steps.join(same, ["better", "worse"], "left").select("better", "worse", pairs.alias("pairs")).where("pairs > 0")


# --- vectors ---

UNITS = "u as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), c as (select a.vec_id as asked, b.vec_id as near, b.label, list_cosine_similarity(a.v, b.v) as s from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)"


@query(f"with {UNITS} select asked, near, round(s, 5) as cosine, k::int as place from (select *, row_number() over (partition by asked order by s desc, near) as k from c) where k <= 5")
def knn_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).vectors()
    out = models.nearest(own, "vec_id", "embedding", own.where("vec_id % 50 = 0"), 5)
    return out.select("asked", "near", F.round("cosine", 5).alias("cosine"), "place")


@query(f"with {UNITS}, k as (select *, row_number() over (partition by asked order by s desc, near) as k from c) select asked, round((sum(greatest(s, 0) * (label % 2)) + 0.5) / (sum(greatest(s, 0)) + 1), 5) as chance from k where k <= 10 group by asked")
def knn_vote(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).vectors()
    near = models.nearest(own, "vec_id", "embedding", own.where("vec_id % 50 = 0"), 10).join(own.select(F.col("vec_id").alias("near"), "label"), "near")
    s = F.greatest("cosine", F.lit(0.0))
    return near.groupBy("asked").agg(F.round((F.sum(s * (F.col("label") % 2)) + 0.5) / (F.sum(s) + 1), 5).alias("chance"))


@query("with m as (select list_transform(embedding, lambda x: x::double) as q from embeddings where vec_id = 0), b as (select floor((list_cosine_similarity(list_transform(embedding, lambda x: x::double), q) + 1) * 20)::int as bin from embeddings, m where vec_id <> 0) select bin, count(*) as n, sum(count(*)) over (order by bin)::bigint as upto from b group by bin")
def cosine_histogram_cdf(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).vectors()
    mark = own.where("vec_id = 0").select(F.col("embedding").alias("q"))
    bins = own.where("vec_id <> 0").crossJoin(F.broadcast(mark)).groupBy(F.floor((nm.cosine(F.col("embedding"), F.col("q")) + 1) * 20).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return bins.select("bin", "n", F.sum("n").over(Window.orderBy("bin")).alias("upto"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as first from embeddings")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).vectors().select("vec_id", F.round(nm.norm(F.col("embedding")), 5).alias("norm"), F.round(nm.unit(F.col("embedding"))[0], 5).alias("first"))


@query(f"""with {ROWS}, b as (select item_id, greatest(least(chance, 1 - 1e-12), 1e-12) as p from rows_ where chance is not null) select item_id, round(1 / (1 + abs(ln(p / (1 - p)) - 0.5)), 5) as doubt,
round(least(case when p >= 1 - 1e-12 then 20.0 else -ln(1 - pow(p, 8)) end, 20), 4) as strength from b""")
def doubt_order(spark: SparkSession, d: str) -> DataFrame:
    p = F.greatest(F.least(F.col("chance"), F.lit(1 - 1e-12)), F.lit(1e-12))
    s = F.when(p >= 1 - 1e-12, F.lit(20.0)).otherwise(nm.strength(p, F.lit(8)))
    return rows(spark, d).where("chance is not null").select("item_id", F.round(nm.doubt(p, F.lit(0.5)), 5).alias("doubt"), F.round(s, 4).alias("strength"))


@query(f"""with {ROWS}, k as (select item_id, score, row_number() over (order by score desc, item_id) as k, count(*) over () as n from rows_ where score is not null),
e as (select max(score) filter (where k = least(2000, n // 2)) as lo, max(score) filter (where k = greatest(1, n // 100)) as hi from k) select item_id, round(least(greatest((score - lo) / (hi - lo), 0), 1.5), 5) as closeness from k, e where k <= 60""")
def closeness_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Scores between that of the n/2-th and the n/100-th, at places that are counted by ranges."""
    own = rows(spark, d).where("score is not null").select("item_id", "score")
    n = own.count()
    placed = nm.numbered(own, F.desc("score"), F.asc("item_id"))
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("score")))
    ends = placed.agg(at(min(2000, n // 2)).alias("lo"), at(max(1, n // 100)).alias("hi"))
    share = (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return placed.where("place <= 60").crossJoin(F.broadcast(ends)).select("item_id", F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.5)), 5).alias("closeness"))


# --- suggestions ---


@query(f"with {ITEMS}, v as (select item_id, type, unnest(words) as w from items) select type, w as value, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by type), 6) as share from v group by 1, 2")
def bayes_counts(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).items().select("type", F.explode("words").alias("value")).groupBy("type", "value").agg(F.count("*").alias("n"))
    total = own.groupBy("type").agg(F.sum("n").alias("t"))
    return own.join(total, "type").select("type", "value", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query(f"""with {ITEMS}, v as (select item_id, type, unnest(words) as w from items), n1 as (select type, count(*)::double as n from items group by 1), nt as (select count(*)::double as n from items),
c as (select w, type, count(*)::double as n from v group by 1, 2), q as (select w, count(*)::double as n from v group by 1),
s as (select i.item_id, t.type as value, n1.n as own, ln(n1.n / (nt.n - n1.n)) + sum(ln((coalesce(c.n, 0) - (i.type = t.type)::int + q.n / nt.n) / (n1.n - (i.type = t.type)::int + 1)) - ln((q.n - coalesce(c.n, 0) - (i.type <> t.type)::int + q.n / nt.n) / (nt.n - n1.n - (i.type <> t.type)::int + 1))) as z
from v i cross join (select distinct type from items) t join n1 on n1.type = t.type cross join nt join q on q.w = i.w left join c on c.w = i.w and c.type = t.type group by i.item_id, t.type, n1.n, nt.n)
select item_id, value, round(1 / (1 + exp(-z)), 5) as chance from s""")
def bayes_chance(spark: SparkSession, d: str) -> DataFrame:
    """Chance of each value by the item's other facet, with the item's own witness taken out of the counts."""
    items = Catalogue(spark, d).items()
    v = items.select("item_id", "type", F.explode("words").alias("w"))
    n1 = items.groupBy(F.col("type").alias("value")).agg(F.count("*").cast("double").alias("n1"))
    nt = items.agg(F.count("*").cast("double").alias("nt"))
    c = v.groupBy("w", F.col("type").alias("value")).agg(F.count("*").cast("double").alias("c"))
    q = v.groupBy("w").agg(F.count("*").cast("double").alias("q"))
    # one row a value and word: the counts of values hang on the word's, the total is one row
    grid = q.join(n1, F.lit(True)).crossJoin(F.broadcast(nt)).join(c, ["w", "value"], "left").na.fill({"c": 0.0})
    own = (F.col("type") == F.col("value")).cast("int")
    mass = F.col("q") / F.col("nt")
    yes = (F.col("c") - own + mass) / (F.col("n1") - own + 1)
    no = (F.col("q") - F.col("c") - (1 - own) + mass) / (F.col("nt") - F.col("n1") - (1 - own) + 1)
    z = v.join(grid, "w").groupBy("item_id", "value", "n1", "nt").agg((F.ln(F.col("n1") / (F.col("nt") - F.col("n1"))) + F.sum(F.ln(yes) - F.ln(no))).alias("z"))
    return z.select("item_id", "value", F.round(nm.sigmoid(F.col("z")), 5).alias("chance"))


# --- duplicates ---

BLOCK = f"""with {ITEMS}, p as (select item_id as b, min(item_id) over w as a, count(*) over w as n, source, title, size, price, first_value(size) over o as a_size, first_value(price) over o as a_price
from items window w as (partition by source, title), o as (partition by source, title order by item_id)), r as (select a, b, n, source, title, case when size > 0 and a_size > 0 then least(size, a_size) / greatest(size, a_size) end as size_ratio, least(price, a_price) / greatest(price, a_price) as price_ratio from p)"""


def _blocked(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the first of its block (same source and title), by which the block's pairs are told, and the block's size."""
    own = Catalogue(spark, d).items().select("item_id", "source", "title", "size", "price")
    first = own.groupBy("source", "title").agg(F.min("item_id").alias("a"), F.count("*").alias("n"), F.min_by("size", "item_id").alias("a_size"), F.min_by("price", "item_id").alias("a_price"))
    both = own.join(first, ["source", "title"])
    return both.select("a", F.col("item_id").alias("b"), "n", "source", "title", nm.size_ratio(F.col("size"), F.col("a_size")).alias("size_ratio"), nm.size_ratio(F.col("price"), F.col("a_price")).alias("price_ratio"))


@query(f"{BLOCK} select b as item_id, a as class_id, n - 1 as links from r")
def blocking_same_author_title(spark: SparkSession, d: str) -> DataFrame:
    """One row an item: the block it lies in, and the others there; pairs are not made."""
    return _blocked(spark, d).select(F.col("b").alias("item_id"), F.col("a").alias("class_id"), (F.col("n") - 1).alias("links"))


@query(f"{BLOCK} select a, b, round(size_ratio, 6) as size_ratio, round(price_ratio, 6) as price_ratio, round((size_ratio + price_ratio) / 2, 6) as prior from r where a < b")
def layers_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _blocked(spark, d).where("a < b").select("a", "b", F.round("size_ratio", 6).alias("size_ratio"), F.round("price_ratio", 6).alias("price_ratio"), F.round(nm.mean_of_known(F.col("size_ratio"), F.col("price_ratio")), 6).alias("prior"))


@query(f"with {ITEMS}, e as (select a.item_id as item_id, b.item_id as partner, least(a.price, b.price) / greatest(a.price, b.price) as r from items a join items b on a.source = b.source and a.title = b.title and a.item_id <> b.item_id) select item_id, partner from (select *, row_number() over (partition by item_id order by r desc, partner) as k from e) where k = 1")
def best_partner_per_item(spark: SparkSession, d: str) -> DataFrame:
    """The partner of nearest price in the block. In order of price it is the next lower or the next higher of another price, or one of equal price."""
    own = Catalogue(spark, d).items().select("item_id", "source", "title", "price")
    level = own.groupBy("source", "title", "price").agg(F.min("item_id").alias("first"), F.min_by(F.lit(1), "item_id").alias("one"), F.count("*").alias("n"))
    w = Window.partitionBy("source", "title").orderBy("price")
    near = level.withColumns({"lower": F.lag(F.struct("price", "first")).over(w), "higher": F.lead(F.struct("price", "first")).over(w)}).drop("one")
    second = own.join(near.where("n > 1").select("source", "title", "price", "first"), ["source", "title", "price"]).where("item_id <> first").groupBy("source", "title", "price").agg(F.min("item_id").alias("second"))
    both = own.join(near, ["source", "title", "price"]).join(second, ["source", "title", "price"], "left")
    mine = F.when(F.col("item_id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    equal = F.when(mine.isNotNull(), F.struct(F.lit(-1.0).alias("r"), mine.alias("partner")))
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct((-F.least(F.col("price"), F.col(f"{c}.price")) / F.greatest(F.col("price"), F.col(f"{c}.price"))).alias("r"), F.col(f"{c}.first").alias("partner")))
    return both.select("item_id", F.array_min(F.filter(F.array(equal, side("lower"), side("higher")), lambda x: x.isNotNull()))["partner"].alias("partner")).where("partner is not null")


@query(f"{BLOCK} select band, count(*) as n from (select case when price_ratio < 0.9 then 0 when price_ratio < 0.99 then 1 else 2 end as band from r where a < b) group by 1")
def chance_spread_bands(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("price_ratio")
    return _blocked(spark, d).where("a < b").groupBy(F.when(r < 0.9, 0).when(r < 0.99, 1).otherwise(2).alias("band")).agg(F.count("*").alias("n"))


#: Sort keys of the page of pairs; the pair itself breaks ties.
PAIR_SORTS = {
    "likeness": "price_ratio desc",
    "unlikeness": "price_ratio",
    "sizes": "size_ratio desc nulls last",
    "unlike_sizes": "size_ratio nulls last",
    "prior": "(size_ratio + price_ratio) / 2 desc",
    "title": "title, price_ratio desc",
    "source": "source, price_ratio desc",
    "crowded": "n desc, price_ratio desc",
    "newest": "b desc",
}


def _order(line: str) -> list[F.Column]:
    out = []
    for term in line.split(", "):
        down, last = " desc" in term, "nulls last" in term
        c = F.expr(term.replace(" nulls last", "").replace(" desc", ""))
        out.append((c.desc_nulls_last() if last else c.desc()) if down else c.asc_nulls_last() if last else c.asc())
    return out


@query(BLOCK + " " + " union all ".join(f"(select '{k}' as sort, a, b, place from (select a, b, row_number() over (order by {o}, a, b) as place from r where a < b) where place <= 20)" for k, o in PAIR_SORTS.items()))
def duplicate_page_sorts(spark: SparkSession, d: str) -> DataFrame:
    """The first page of pairs in each of the nine orders."""
    own = _blocked(spark, d).where("a < b")
    out = None
    for name, order in PAIR_SORTS.items():
        order = _order(order)
        page = own.orderBy(*order, "a", "b").limit(20).withColumn("place", F.row_number().over(Window.orderBy(*order, "a", "b"))).select(F.lit(name).alias("sort"), "a", "b", "place")
        out = page if out is None else out.unionByName(page)
    return out


# --- search ---

SEARCH = r"""hit as (select doc_id, w, count(*)::double as n from (select doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) as w from documents) where w in ('the', 'and', 'with', 'trash') group by 1, 2),
word as (select doc_id, sum(n / (n + 1.2)) / 4 as score, count(*) as found from hit group by 1 having count(*) >= 3)"""


def _words(spark: SparkSession, d: str, line: list[str]) -> DataFrame:
    """(doc_id, score, found): documents with enough of the terms; a term counts n / (n + 1.2)."""
    own = Catalogue(spark, d).documents().select("doc_id", F.explode(tx.letter_words(F.lower("text"))).alias("w")).where(F.col("w").isin(*line)).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    need = len(line) if len(line) <= 2 else len(line) - len(line) // 3
    return own.groupBy("doc_id").agg((F.sum(F.col("n") / (F.col("n") + 1.2)) / len(line)).alias("score"), F.count("*").alias("found")).where(F.col("found") >= need)


@query(f"with {SEARCH} select doc_id, round(score, 6) as score, found from word order by score desc, doc_id limit 50")
def word_score(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d, ["the", "and", "with", "trash"]).select("doc_id", F.round("score", 6).alias("score"), "found").orderBy(F.desc("score"), "doc_id").limit(50)


@query(f"""with {SEARCH}, near as (select e.vec_id as doc_id, list_cosine_similarity(list_transform(e.embedding, lambda x: x::double), list_transform(q.embedding, lambda x: x::double)) as c from embeddings e, embeddings q where q.vec_id = 3)
select doc_id, round(coalesce(case when c >= 0.1 then c end, 0) + 0.6 * coalesce(score, 0), 5) as score from word full join near using (doc_id) where coalesce(case when c >= 0.1 then c end, 0) + 0.6 * coalesce(score, 0) > 0""")
def fusion_score(spark: SparkSession, d: str) -> DataFrame:
    """Closeness by meaning, where it is enough, and words, fused."""
    own = Catalogue(spark, d).vectors()
    q = own.where("vec_id = 3").select(F.col("embedding").alias("q"))
    near = own.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("doc_id"), nm.cosine(F.col("embedding"), F.col("q")).alias("c"))
    both = _words(spark, d, ["the", "and", "with", "trash"]).select("doc_id", "score").join(near, "doc_id", "full_outer")
    total = F.coalesce(F.when(F.col("c") >= 0.1, F.col("c")), F.lit(0.0)) + 0.6 * F.coalesce("score", F.lit(0.0))
    return both.select("doc_id", F.round(total, 5).alias("score")).where(total > 0)


@query(f"""with {ROWS}, j as (select work % 20 as line, grade - 1 as level, row_number() over (partition by work % 20 order by score desc, item_id) as place from rows_ where grade is not null and score is not null),
i as (select line, level, row_number() over (partition by line order by level desc) as place from j), g as (select line, sum((pow(2, level) - 1) / log2(place + 1)) as dcg, 1.0 / min(place) filter (where level >= 3) as rr from j where place <= 10 group by 1),
b as (select line, sum((pow(2, level) - 1) / log2(place + 1)) as best from i where place <= 10 group by 1) select line, round(case when best > 0 then dcg / best end, 6) as ndcg, round(rr, 6) as reciprocal from g join b using (line)""")
def search_quality(spark: SparkSession, d: str) -> DataFrame:
    """Discounted gain of the first ten of each line against the best order, and the reciprocal place of the first fitting."""
    own = rows(spark, d).where("grade is not null and score is not null").select((F.col("work") % 20).alias("line"), (F.col("grade") - 1).alias("level"), "score", "item_id")
    gain = lambda p: F.sum((F.pow(F.lit(2.0), "level") - 1) / F.log2(F.col(p) + 1))
    a = own.withColumn("p", F.row_number().over(Window.partitionBy("line").orderBy(F.desc("score"), "item_id"))).where("p <= 10").groupBy("line").agg(gain("p").alias("dcg"), (1 / F.min(F.when(F.col("level") >= 3, F.col("p")))).alias("rr"))
    b = own.withColumn("p", F.row_number().over(Window.partitionBy("line").orderBy(F.desc("level")))).where("p <= 10").groupBy("line").agg(gain("p").alias("best"))
    return a.join(b, "line").select("line", F.round(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")), 6).alias("ndcg"), F.round("rr", 6).alias("reciprocal"))


# --- fitted models: rows only; invariants are tested ---


def _ranked_rows(spark: SparkSession, d: str) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    own = rows(spark, d).where("score is not null").select("item_id", "work", "grade", F.array(F.lit(1.0), F.col("size") / 50, F.col("price") / 1000, "score", "chance").alias("x"))
    sample = models.bounded(own.where("grade is not null"), "item_id", models.RANKED_ROWS)
    x = np.stack(sample.x.to_numpy()).astype(float)
    return own, x, sample.grade.to_numpy(), sample.work.to_numpy()


@query()
def pairwise_linear(spark: SparkSession, d: str) -> DataFrame:
    own, x, g, w = _ranked_rows(spark, d)
    return own.select("item_id", nm.weighed("x", models.fit_pairwise(x, g, w)).alias("score"))


@query()
def kernel_ranking(spark: SparkSession, d: str) -> DataFrame:
    own, x, g, w = _ranked_rows(spark, d)
    alpha = models.fit_kernel(x, g, w)
    return models.scored(own, "item_id", "x", lambda a: models.arc_cosine(a, x) @ alpha)


@query()
def factorization_ranking(spark: SparkSession, d: str) -> DataFrame:
    own, x, g, w = _ranked_rows(spark, d)
    weight, factors = models.fit_factorization(x, g, w)
    return models.scored(own, "item_id", "x", lambda a: models.factorization_scores(a, weight, factors))


@query()
def boosted_ranking(spark: SparkSession, d: str) -> DataFrame:
    own, x, g, w = _ranked_rows(spark, d)
    trees = models.fit_boosting(x, g, w)
    return models.scored(own, "item_id", "x", lambda a: models.tree_scores(a, trees))


@query()
def explanations(spark: SparkSession, d: str) -> DataFrame:
    """Score minus the score with one feature at its average, for each feature."""
    own, x, g, w = _ranked_rows(spark, d)
    weight, mean = models.fit_pairwise(x, g, w), x.mean(0)
    names = F.array(*map(F.lit, ["constant", "size", "price", "score", "chance"]))
    parts = F.zip_with("x", F.array(*[F.struct(F.lit(float(a)).alias("w"), F.lit(float(m)).alias("m")) for a, m in zip(weight, mean, strict=True)]), lambda v, c: (v - c["m"]) * c["w"])
    return own.select("item_id", F.explode(F.arrays_zip(names.alias("name"), parts.alias("part"))).alias("e")).select("item_id", F.col("e.name").alias("feature"), F.round("e.part", 6).alias("part"))


@query()
def platt_calibration(spark: SparkSession, d: str) -> DataFrame:
    sample = models.bounded(rows(spark, d).where("grade is not null and score is not null").select("item_id", "score", "grade"), "item_id", models.CURVE_ROWS)
    fit = models.platt(sample.score.to_numpy(), (sample.grade >= 4).to_numpy().astype(float))
    shift, slope = (0.0, 0.0) if fit is None else fit
    return rows(spark, d).where("score is not null").select("item_id", nm.sigmoid(F.col("score") * float(slope) + float(shift)).alias("chance"))


@query()
def logistic_pair(spark: SparkSession, d: str) -> DataFrame:
    own = _blocked(spark, d).where("a < b").withColumn("id", F.xxhash64("a", "b")).withColumn("x", F.array(F.lit(1.0), F.coalesce("size_ratio", F.lit(0.0)), "price_ratio"))
    sample = models.bounded(own.select("id", "x", "price_ratio"), "id", models.CURVE_ROWS)
    if not len(sample):
        return own.select("id", F.lit(0.0).alias("score"))
    weight = models.fit_logistic(np.stack(sample.x.to_numpy()).astype(float), (sample.price_ratio > 0.99).to_numpy().astype(float))
    return own.select("id", nm.sigmoid(nm.weighed("x", weight)).alias("score"))


#: Directions that principal_directions finds.
DIRECTIONS = 32


@query()
def principal_directions(spark: SparkSession, d: str) -> DataFrame:
    """Place of every vector along the directions of most variance of all vectors, and along the first."""
    own = Catalogue(spark, d).vectors()
    centre, cov = models.moments(own, "embedding")
    q, scale = models.principal(cov, DIRECTIONS)

    def task(batches):  # noqa: ANN001, ANN202
        for b in batches:
            if len(b):
                z = (np.stack(b.embedding.to_numpy()).astype(float) - centre) @ q / np.maximum(scale, 1e-9)
                yield pd.DataFrame({"vec_id": b.vec_id, "first": z[:, 0], "along": list(z)})

    return own.select("vec_id", "embedding").mapInPandas(task, "vec_id long, first double, along array<double>")


# --- changes ---


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 10 minutes then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as s from e) select user_id, min(ts) as began, count(*) as n from s group by user_id, s""")
def event_debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a user run together until ten minutes of quiet."""
    return changes.sessions(Catalogue(spark, d).table("events"), "10 minutes").select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), "n")


@query("select user_id, event_type as kind, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def stream_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return changes.run_once(spark, d, changes.latest_state, ["user_id"]).select("user_id", "kind", "value")


@query("select user_id, event_type as kind, count(*) as n from (select distinct user_id, event_type, date_trunc('hour', ts) as h from events) group by 1, 2")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return changes.run_once(spark, d, changes.distinct_changes, ["user_id", "kind", "hour"]).groupBy("user_id", "kind").agg(F.count("*").alias("n"))


@query("""with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 10 minutes then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts) as s from e), w as (select user_id, s, max(ts) + interval 10 minutes as ended from s group by 1, 2),
d as (select s.* from s join w using (user_id, s) where ended <= (select max(ts) from events))
select user_id, event_type as kind, count(*) as changes, arg_max(value, epoch_us(ts)::hugeint * 10000000 + event_id) as value from d group by 1, 2""")
def index_after_quiet(spark: SparkSession, d: str) -> DataFrame:
    """Documents of what changed, written once each user had been still for ten minutes; who is not yet still waits."""
    index = quiet.QuietIndex(spark, uuid.uuid4().hex, quiet="10 minutes")
    index.catch_up(d)
    return index.documents().select("user_id", F.col("event_type").alias("kind"), "changes", "value")


@query("select user_id as task, sum(n)::bigint as changes, string_agg(event_type || '=' || n, ' ' order by event_type) as reasons from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1")
def stream_task_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """One task a key, the reasons that asked for it counted together."""
    own = Catalogue(spark, d).table("events").groupBy(F.col("user_id").alias("task"), "event_type").agg(F.count("*").alias("n"))
    return own.groupBy("task").agg(F.sum("n").alias("changes"), F.array_join(F.sort_array(F.collect_list(F.concat("event_type", F.lit("="), F.col("n").cast("string")))), " ").alias("reasons"))


@query("select count(*) as n, bool_or(false) as truncated from (select 1 from nation limit 1000)")
def sql_passthrough(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.passthrough import read_only

    for t in ("nation", "region"):
        Catalogue(spark, d).table(t).createOrReplaceTempView(t)
    out, truncated = read_only(spark, "select n.n_name, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey", 1000)
    return out.agg(F.count("*").alias("n")).withColumn("truncated", F.lit(truncated))
