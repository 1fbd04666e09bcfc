"""Curation and view queries: series, authors, tags, names, tasks, and further suggestions and scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import numbers as nm, text as tx
from ..operators import graph, listing, marks, models
from ..session import shared_folder
from ..sources.catalogue import Catalogue
from .lists import EDGES, ITEMS, RATINGS, ROWS, rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with recursive {EDGES}, walk(node, at_, path) as (select child, parent, child || '>' || parent from edge where child = 'S0' union all select walk.node, e.parent, walk.path || '>' || e.parent from walk join edge e on walk.at_ = e.child) select path from walk")
def upward_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every way up from one value, with the values on it."""
    ways = graph.ways_up(Catalogue(spark, d).words_edges(), spark.createDataFrame([("S0",)], "node string"))
    return ways.select(F.array_join("way", ">").alias("path"))


@query(f"with recursive {EDGES} select sum(('0x' || left(md5(node || '<' || ancestor), 8))::bigint)::bigint as signature, count(*) as pairs from closed")
def closure_signature(spark: SparkSession, d: str) -> DataFrame:
    """A print of a hierarchy's closure that doesn't depend on its order, so that it sums up before any shuffle."""
    closed = graph.closure(Catalogue(spark, d).words_edges())
    part = F.conv(F.substring(F.md5(F.concat("node", F.lit("<"), "ancestor")), 1, 8), 16, 10).cast("long")
    return closed.agg(F.sum(part).alias("signature"), F.count("*").alias("pairs"))


@query(f"with recursive {EDGES}, n as (select distinct node as n from closed union select distinct ancestor from closed) select n as node, coalesce(max(depth), 0)::int as level from n left join closed on n = node group by n")
def parents_first(spark: SparkSession, d: str) -> DataFrame:
    """The level of each value: ancestors come before descendants in its order."""
    closed = graph.closure(Catalogue(spark, d).words_edges())
    every = closed.select("node").union(closed.select("ancestor")).distinct()
    return every.join(closed, "node", "left").groupBy("node").agg(F.coalesce(F.max("depth"), F.lit(0)).cast("int").alias("level"))


@query("select c_custkey as item_id from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 2)")
def kept_out_works(spark: SparkSession, d: str) -> DataFrame:
    """Items none of whose values lies at or below a value that keeps them out."""
    c = Catalogue(spark, d)
    below = c.table("nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return c.table("customer").join(F.broadcast(below), "c_nationkey", "left_anti").select(F.col("c_custkey").alias("item_id"))


@query(f"with {ITEMS}, {RATINGS} select i.source, count(*) as stale from items i left join (select item_id, max(rated_at) as last_ from ratings group by 1) r using (item_id) where r.last_ is null or r.last_ < case when i.source < 'Brand#2' then timestamp '2001-01-01' else timestamp '2000-01-01' end group by 1")
def staleness_per_source(spark: SparkSession, d: str) -> DataFrame:
    c = Catalogue(spark, d)
    last = c.ratings().groupBy("item_id").agg(F.max("rated_at").alias("last"))
    since = F.when(F.col("source") < "Brand#2", F.lit("2001-01-01")).otherwise(F.lit("2000-01-01")).cast("timestamp_ntz")
    return c.items().join(last, "item_id", "left").where(F.col("last").isNull() | (F.col("last") < since)).groupBy("source").agg(F.count("*").alias("stale"))


@query(f"with {ROWS} select item_id from rows_ where grade is not null and source = 'Brand#4' union all select item_id from rows_ where grade is null and source = 'Brand#5'")
def union_of_sources(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d)
    return own.where("grade is not null and source = 'Brand#4'").select("item_id").unionByName(own.where("grade is null and source = 'Brand#5'").select("item_id"))


@query(f"with {RATINGS} select distinct item_id from ratings where grade = 5 except select distinct item_id from ratings where grade = 1 except select item_id from ratings where version = 7")
def graded_difference(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).ratings()
    bad = own.where("grade = 1 or version = 7").select("item_id")
    return own.where("grade = 5").select("item_id").distinct().join(bad, "item_id", "left_anti")


@query(f"with {RATINGS} select a.item_id as a, b.item_id as b, count(*) as shared from (select distinct item_id, rating_id from ratings) a join (select distinct item_id, rating_id from ratings) b on a.rating_id = b.rating_id and a.item_id < b.item_id group by 1, 2 having count(*) > 1")
def duplicate_entry_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share more than one catalogue entry, from the sorted set of each entry."""
    sets = Catalogue(spark, d).ratings().groupBy("rating_id").agg(F.array_sort(F.collect_set("item_id")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared")).where("shared > 1")


@query(f"with {ITEMS} select source, count(distinct type) as kinds, max(n) as most, arg_max(type, (n, type)) as shown from (select source, type, count(*) as n from items group by 1, 2) group by source".replace("arg_max(type, (n, type))", "arg_max(type, n * 1000 + ascii(type) * 10 + length(type))"))
def display_name_choice(spark: SparkSession, d: str) -> DataFrame:
    """The name used most for each key; the later one in the alphabet's first letter among equals."""
    own = Catalogue(spark, d).items().groupBy("source", "type").agg(F.count("*").alias("n"))
    rank = F.col("n") * 1000 + F.ascii("type") * 10 + F.length("type")
    return own.groupBy("source").agg(F.count("*").alias("kinds"), F.max("n").alias("most"), F.max_by("type", rank).alias("shown"))


@query("select o_custkey as who, count(*) filter (where o_orderstatus = 'F') as told, round(sum(case when o_orderstatus <> 'F' then o_totalprice / 1000000 else 0 end), 4) as expected from orders group by 1")
def author_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Answered pairs counted, and the chances of those not answered summed."""
    own = Catalogue(spark, d).table("orders").groupBy(F.col("o_custkey").alias("who"))
    return own.agg(F.count_if(F.col("o_orderstatus") == "F").alias("told"), F.round(F.sum(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") / 1_000_000).otherwise(0.0)), 4).alias("expected"))


@query("select event_id, user_id, event_type as kind from events order by case event_type when 'purchase' then 0 when 'signup' then 1 else 2 end, ts, event_id limit 40")
def priority_turns(spark: SparkSession, d: str) -> DataFrame:
    """What waits, by priority and then by how long."""
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return Catalogue(spark, d).table("events").orderBy(rank, "ts", "event_id").limit(40).select("event_id", "user_id", F.col("event_type").alias("kind"))


@query("select n, least(60 * pow(2, n - 1), 86400)::bigint as seconds from (select distinct l_linenumber * 2 as n from lineitem)")
def backoff_delays(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("lineitem").select((F.col("l_linenumber") * 2).alias("n")).distinct()
    return own.select("n", F.least(F.lit(60) * F.pow(F.lit(2), F.col("n") - 1), F.lit(86_400)).cast("long").alias("seconds"))


@query("select doc_id, case when n_chars % 3 = 0 then (n_chars / 6.0)::bigint else n_chars end as size from documents".replace("(n_chars / 6.0)::bigint", "round(n_chars / 6.0)::bigint"))
def stated_or_derived_size(spark: SparkSession, d: str) -> DataFrame:
    """Stated words, else characters by the ratio."""
    stated = F.when(F.col("n_chars") % 3 != 0, F.col("n_chars"))
    return Catalogue(spark, d).documents().select("doc_id", F.coalesce(stated, F.round(F.col("n_chars") / 6.0).cast("long")).alias("size"))


@query(f"with {ROWS}, t as (select type, score, row_number() over (partition by type order by score desc, item_id) as k, item_id from rows_ where score is not null) select item_id, type, k::int as k from t where k <= 3")
def leaders_first(spark: SparkSession, d: str) -> DataFrame:
    """The best items of each feature."""
    own = rows(spark, d).where("score is not null")
    k = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("score"), "item_id"))
    return own.select("item_id", "type", k.alias("k")).where("k <= 3")


@query("with f as (select label % 5 as fold, label % 3 as value, count(*)::double as w, sum((vec_id % 2)::double) as y from embeddings group by 1, 2) select fold, value, w, y, round((y + 0.5) / (w + 1), 6) as chance from f")
def fold_sums(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).vectors().groupBy((F.col("label") % 5).alias("fold"), (F.col("label") % 3).alias("value")).agg(F.count("*").cast("double").alias("w"), F.sum((F.col("vec_id") % 2).cast("double")).alias("y"))
    return own.withColumn("chance", F.round((F.col("y") + 0.5) / (F.col("w") + 1), 6))


@query(f"with {ROWS}, p as (select item_id, chance as p, (coalesce(grade, 0) >= 4)::int as y from rows_ where chance is not null), q as (select -(y * ln(greatest(p, 1e-6)) + (1 - y) * ln(greatest(1 - p, 1e-6))) as l from p) select round(avg(l), 5) as loss, round(stddev_samp(l) / sqrt(count(*)), 6) as se from q")
def held_out_loss(spark: SparkSession, d: str) -> DataFrame:
    p, y = F.col("chance"), F.coalesce((F.col("grade") >= 4).cast("int"), F.lit(0))
    loss = -(y * F.ln(F.greatest(p, F.lit(1e-6))) + (1 - y) * F.ln(F.greatest(1 - p, F.lit(1e-6))))
    return rows(spark, d).where("chance is not null").select(loss.alias("l")).agg(F.round(F.avg("l"), 5).alias("loss"), F.round(F.stddev_samp("l") / F.sqrt(F.count("*")), 6).alias("se"))


@query(f"with {ROWS}, c as (select type, source, count(*) as n, row_number() over (partition by type order by count(*) desc, source) as k from rows_ group by 1, 2) select type, source, n from c where k <= 4")
def capped_values(spark: SparkSession, d: str) -> DataFrame:
    """At most so many values of each, the likeliest."""
    own = Catalogue(spark, d).items().groupBy("type", "source").agg(F.count("*").alias("n"))
    return own.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "source"))).where("k <= 4").drop("k")


@query(f"with {ITEMS} select a.type as type, a.w as a, b.w as b, count(*) as n from (select item_id, type, unnest(words) as w from items) a join (select item_id, unnest(words) as w from items) b on a.item_id = b.item_id and a.w < b.w group by 1, 2, 3")
def pairing_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of an item's values, from the item's own set."""
    own = Catalogue(spark, d).items().select("type", F.array_sort(F.array_distinct("words")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return own.select("type", F.explode(pairs).alias("p")).groupBy("type", "p.a", "p.b").agg(F.count("*").alias("n"))


@query("with l as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings where vec_id in (1, 2, 3)), k as (select generate_subscripts(v, 1) as k, unnest(v) as x, vec_id from l) select k - 1 as place, round(sum(case vec_id when 1 then x when 2 then 0.5 * x else -0.5 * x end), 5) as x from k group by k")
def rocchio_shift(spark: SparkSession, d: str) -> DataFrame:
    """A mark moved towards what was told to fit and away from what was told not to."""
    own = Catalogue(spark, d).vectors().where("vec_id in (1, 2, 3)").select("vec_id", F.posexplode("embedding").alias("place", "x"))
    weight = F.when(F.col("vec_id") == 1, 1.0).when(F.col("vec_id") == 2, 0.5).otherwise(-0.5)
    return own.groupBy("place").agg(F.round(F.sum(weight * F.col("x").cast("double")), 5).alias("x"))


@query("with p as (select a.label as label, max(list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double))) as likeness from embeddings a, embeddings b where b.vec_id % 50 = 0 and a.vec_id <> b.vec_id group by 1) select label, round(likeness, 5) as likeness from p")
def similar_tags(spark: SparkSession, d: str) -> DataFrame:
    """The best cosine of each group to a few marks."""
    own = Catalogue(spark, d).vectors().withColumnRenamed("embedding", "v")
    return marks.best_by_label(own, own.where("vec_id % 50 = 0")).select("label", F.round("likeness", 5).alias("likeness"))


@query("with m as (select distinct l_suppkey as a, l_partkey as b from lineitem) select a as author, count(*) as works, min(b) as first from m group by 1 having count(*) >= 2")
def named_authors(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("lineitem").select(F.col("l_suppkey").alias("author"), F.col("l_partkey").alias("b")).distinct()
    return own.groupBy("author").agg(F.count("*").alias("works"), F.min("b").alias("first")).where("works >= 2")


@query("select l_orderkey as series, count(distinct l_partkey) as works, count(distinct l_suppkey % 3) as sites from lineitem group by 1 having count(distinct l_suppkey % 3) >= 3 order by works desc, series limit 30")
def series_views(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("lineitem").groupBy(F.col("l_orderkey").alias("series"))
    return own.agg(F.count_distinct("l_partkey").alias("works"), F.count_distinct(F.col("l_suppkey") % 3).alias("sites")).where("sites >= 3").orderBy(F.desc("works"), "series").limit(30)


@query("select conv_id, sum(length(text))::bigint as chars, count(*) as parts, sha256(string_agg(turn || ':' || sha256(text), chr(10) order by turn)) as hash from conversations group by 1")
def part_totals(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("conversations")
    marks = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.sha2("text", 256).alias("h")))), lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["h"]))
    return own.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("parts"), F.sha2(F.array_join(marks, "\n"), 256).alias("hash"))


@query("select p_partkey as item_id, p_type as type from part order by md5(p_partkey::varchar), p_partkey limit 60")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample that is the same each time, by hash of the key."""
    return Catalogue(spark, d).items().orderBy(F.md5(F.col("item_id").cast("string")), "item_id").limit(60).select("item_id", "type")


@query()
def bilinear_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Chance of each type by vectors of items: a model of low rank, fitted by quasi-Newton steps on a bounded sample."""
    own = Catalogue(spark, d).vectors().select("vec_id", "embedding", "label")
    sample = models.bounded(own, "vec_id", models.VALUE_ROWS)
    x = np.stack(sample.embedding.to_numpy()).astype(float)
    values = np.unique(sample.label)
    y = (sample.label.to_numpy()[:, None] == values[None, :]).astype(float)
    d_in, k, rank = x.shape[1], len(values), 8
    start = 0.1 * np.random.default_rng(1).normal(size=d_in * rank + rank * k + k)

    def parts(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return p[: d_in * rank].reshape(d_in, rank), p[d_in * rank : -k].reshape(rank, k), p[-k:]

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        a, b, c = parts(p)
        h = x @ a
        z = h @ b + c
        g = (models.sigmoid(z) - y) / len(x)
        return float((np.logaddexp(0, z) - y * z).sum() / len(x) + 1e-3 * p @ p), np.concatenate(((x.T @ (g @ b.T)).ravel(), (h.T @ g).ravel(), g.sum(0))) + 2e-3 * p

    a, b, c = parts(models.lbfgs(loss, start, 100))
    return models.scored(own, "vec_id", "embedding", lambda v: models.sigmoid(v @ a @ b + c).max(1), "chance")


@query()
def words_per_character(spark: SparkSession, d: str) -> DataFrame:
    """Words by classes of characters: non-negative weights of least absolute error, then applied to all."""
    classes = tx.class_counts(F.col("text"))
    own = Catalogue(spark, d).documents().select("doc_id", tx.word_count(F.col("text")).alias("n"), F.array(*(c.cast("double") for c in classes.values())).alias("x"))
    shared_folder(spark)
    own = own.checkpoint()
    weight = models.least_absolute_of_all(own, "x", len(classes), "n", 20)
    return own.select("doc_id", nm.weighed("x", weight).alias("words"))
