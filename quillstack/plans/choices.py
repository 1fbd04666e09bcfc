"""What models are chosen by, what suggestions and searches of pairs start from, and what hierarchies offer, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import numbers as nm
from ..operators import marks
from ..sources.catalogue import TYPES, Catalogue
from .features import CHANCES, chances
from .lists import ITEMS, ROWS, rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


COMPONENTS = "v as (select vec_id, label, generate_subscripts(embedding, 1) as k, unnest(embedding)::double as x from embeddings)"


def _doubles(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).vectors().select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _sums(vectors: DataFrame, *by: str | Column) -> DataFrame:
    """by, n, total: the sum of vectors, by partial sums of components."""
    names = [x if isinstance(x, str) else f"b{k}" for k, x in enumerate(by)]
    cells = vectors.select(*(x if isinstance(x, str) else x.alias(n) for x, n in zip(by, names, strict=True)), F.posexplode("v").alias("k", "x"))
    sums = cells.groupBy(*names, "k").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return sums.groupBy(*names).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]).alias("total"))


# --- what models are chosen by ---

GRID = [0.0, 0.25, 0.5, 1.0, 2.0]
# squared error of a grade told by two groups of inputs under each pair of weights, by fold, from the fold's moments
ERRORS = f"""{ROWS}, x as (select work % 5 as fold, grade - 3.0::double as y, price / 1000 - 1 as a, size / 50 - 0.5 as b from rows_ where grade is not null),
m as (select fold, count(*) as n, sum(y*y) as yy, sum(a*y) as ay, sum(b*y) as by_, sum(a*a) as aa, sum(a*b) as ab, sum(b*b) as bb from x group by 1),
g as (select unnest({GRID}::double[]) as w), e as (select fold, p.w as w1, q.w as w2, (yy - 2*p.w*ay - 2*q.w*by_ + p.w*p.w*aa + 2*p.w*q.w*ab + q.w*q.w*bb) / n as error from m, g p, g q)"""


def weight_errors(spark: SparkSession, d: str) -> DataFrame:
    """fold, w1, w2, error: the rows are read once, the grid meets five rows of moments."""
    own = rows(spark, d).where("grade is not null").select((F.col("work") % 5).alias("fold"), (F.col("grade") - 3.0).alias("y"), (F.col("price") / 1000 - 1).alias("a"), (F.col("size") / 50 - 0.5).alias("b"))
    m = own.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in ("yy", "ay", "by", "aa", "ab", "bb")))
    pairs = F.array(*(F.struct(F.lit(p).alias("w1"), F.lit(q).alias("w2")) for p in GRID for q in GRID))
    error = (F.col("yy") - 2 * F.col("w1") * F.col("ay") - 2 * F.col("w2") * F.col("by") + F.col("w1") ** 2 * F.col("aa") + 2 * F.col("w1") * F.col("w2") * F.col("ab") + F.col("w2") ** 2 * F.col("bb")) / F.col("n")
    return m.withColumn("g", F.explode(pairs)).select("*", "g.*").select("fold", "w1", "w2", error.alias("error"))


def _step(own: str, other: str, at: str, name: str) -> str:
    """One step of the walk in SQL: of the weights within a standard error of the best, the one nearest to 1."""
    return f"{name} as (select {own} as w from s, (select m + se as high from s where {other} = {at} order by m, {own} limit 1) where {other} = {at} and m <= high order by abs({own} - 1), {own} limit 1)"


@query(f"with {ERRORS}, s as (select w1, w2, avg(error) as m, stddev_samp(error) / sqrt(count(*)) as se from e group by 1, 2), {_step('w1', 'w2', '1', 's1')}, {_step('w2', 'w1', '(select w from s1)', 's2')}, {_step('w1', 'w2', '(select w from s2)', 's3')}, {_step('w2', 'w1', '(select w from s3)', 's4')} select s3.w as w1, s4.w as w2, round((select m from s where w1 = s3.w and w2 = s4.w), 6) as error from s3, s4")
def group_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of two groups of inputs, one after another in two passes; the walk is over the 25 rows of the grid."""
    table = weight_errors(spark, d).groupBy("w1", "w2").agg(F.avg("error").alias("m"), (F.stddev_samp("error") / F.sqrt(F.count("*"))).alias("se"))
    told = {(x.w1, x.w2): (x.m, x.se) for x in table.collect()}
    if not told:
        return spark.createDataFrame([], "w1 double, w2 double, error double")
    at = [1.0, 1.0]
    for k in (0, 1, 0, 1):
        line = {w: told[(w, at[1]) if k == 0 else (at[0], w)] for w in GRID}
        best = min(GRID, key=lambda w: (line[w][0], w))
        at[k] = min((w for w in GRID if line[w][0] <= sum(x or 0.0 for x in line[best])), key=lambda w: (abs(w - 1), w))
    return spark.createDataFrame([(*at, told[tuple(at)][0])], "w1 double, w2 double, error double").withColumn("error", F.round("error", 6))


@query(f"with {ERRORS}, t as (select o.fold, e.w1, e.w2, avg(e.error) as m from (select distinct fold from m) o join e on e.fold <> o.fold group by 1, 2, 3), c as (select * from (select *, row_number() over (partition by fold order by round(m, 9), w1, w2) as k from t) where k = 1) select c.fold, c.w1, c.w2, round(b.error, 6) as baseline, round(w.error, 6) as weighed from c join e b on b.fold = c.fold and b.w1 = 1 and b.w2 = 1 join e w on w.fold = c.fold and w.w1 = c.w1 and w.w2 = c.w2")
def weights_nested(spark: SparkSession, d: str) -> DataFrame:
    """What weights chosen on the other folds are worth on each: an honest estimate of the choice."""
    e = weight_errors(spark, d)
    total = e.groupBy("w1", "w2").agg(F.sum("error").alias("s"), F.count("*").alias("n")).where("n > 1")
    rest = e.join(F.broadcast(total), ["w1", "w2"]).withColumn("m", F.round((F.col("s") - F.col("error")) / (F.col("n") - 1), 9))
    base = F.max(F.when((F.col("w1") == 1) & (F.col("w2") == 1), F.col("error")))
    own = rest.groupBy("fold").agg(F.min(F.struct("m", "w1", "w2", "error")).alias("c"), base.alias("b"))
    return own.select("fold", "c.w1", "c.w2", F.round("b", 6).alias("baseline"), F.round("c.error", 6).alias("weighed"))


@query(f"with {ITEMS}, n as (select source, type, count(*) filter (where item_id % 5 <> 0) as n, count(*) filter (where item_id % 5 = 0) as h from items group by 1, 2), t as (select source, sum(n) as t from n group by 1), g as (select unnest([0.5, 1, 2, 4]::double[]) as smoothing) select smoothing, round(sum(-h * ln((n.n + smoothing) / (t.t + smoothing * (select count(distinct type) from items)))) / sum(h), 6) as loss from n join t using (source), g group by 1")
def trial_grid(spark: SparkSession, d: str) -> DataFrame:
    """Several settings in one walk: counts are taken once, and each setting is tried on them."""
    n = Catalogue(spark, d).items().groupBy("source", "type").agg(F.count_if(F.col("item_id") % 5 != 0).alias("n"), F.count_if(F.col("item_id") % 5 == 0).alias("h"))
    kinds = n.agg(F.count_distinct("type").alias("kinds"))
    own = n.join(n.groupBy("source").agg(F.sum("n").alias("t")), "source").crossJoin(F.broadcast(kinds)).withColumn("smoothing", F.explode(F.array(*map(F.lit, [0.5, 1.0, 2.0, 4.0]))))
    loss = -F.col("h") * F.ln((F.col("n") + F.col("smoothing")) / (F.col("t") + F.col("smoothing") * F.col("kinds")))
    return own.groupBy("smoothing").agg(F.round(F.sum(loss) / F.sum("h"), 6).alias("loss"))


@query(f"with {ITEMS}, i as (select 'source' as kind, source as value, item_id % 10 = 0 as held, price as y from items union all select 'type', type, item_id % 10 = 0, price from items), mu as (select avg(price) as mu from items where item_id % 10 <> 0), s as (select kind, value, count(*) filter (where not held) as n, coalesce(sum(y - mu) filter (where not held), 0) as t, count(*) filter (where held) as hn, coalesce(sum(y - mu) filter (where held), 0) as ht, coalesce(sum((y - mu) * (y - mu)) filter (where held), 0) as hh from i, mu group by 1, 2), e as (select kind, penalty, sum(hh - 2 * ht * t / (n + penalty) + hn * pow(t / (n + penalty), 2)) / sum(hn) as error from s, (select pow(2.0, r) as penalty from range(-2, 9) r(r)) group by 1, 2) select kind, penalty, round(error, 4) as error from (select *, row_number() over (partition by kind order by round(error, 6), penalty) as k from e) where k = 1")
def penalties_chosen(spark: SparkSession, d: str) -> DataFrame:
    """The penalty of each kind of value under which means drawn to the middle tell a held-out tenth best, from sums by value."""
    own = Catalogue(spark, d).items().select("source", "type", (F.col("item_id") % 10 == 0).alias("held"), "price")
    mu = own.where("not held").agg(F.avg("price").alias("mu"))
    y = own.crossJoin(F.broadcast(mu)).withColumn("y", F.col("price") - F.col("mu"))
    kinds = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("source", "type")))
    told = lambda held, x: F.coalesce(F.sum(F.when(F.col("held") == held, x)), F.lit(0.0))
    s = y.withColumn("i", F.explode(kinds)).groupBy("i.kind", "i.value").agg(F.count_if(~F.col("held")).alias("n"), told(False, F.col("y")).alias("t"), F.count_if("held").alias("hn"), told(True, F.col("y")).alias("ht"), told(True, F.col("y") * F.col("y")).alias("hh"))
    drawn = F.col("t") / (F.col("n") + F.col("penalty"))
    e = s.withColumn("penalty", F.explode(F.array(*(F.lit(2.0**k) for k in range(-2, 9))))).groupBy("kind", "penalty").agg((F.sum(F.col("hh") - 2 * F.col("ht") * drawn + F.col("hn") * drawn * drawn) / F.sum("hn")).alias("error"))
    return e.groupBy("kind").agg(F.min(F.struct(F.round("error", 6).alias("r"), "penalty", "error")).alias("b")).select("kind", "b.penalty", F.round("b.error", 4).alias("error"))


@query(f"with {ITEMS}, g as (select source, count(*)::double as n, avg(size) as m, var_pop(size) * count(*) as ss from items group by 1), t as (select sum(n) as n, count(*) as k, sum(n * m) / sum(n) as mean, sum(n * n) as nn, sum(ss) as ss from g), b as (select sum(g.n * pow(g.m - t.mean, 2)) as sb from g, t) select round(ss / (n - k), 4) as own, round(greatest((sb / (k - 1) - ss / (n - k)) / ((n - nn / n) / (k - 1)), 0), 4) as shared from t, b")
def variance_components(spark: SparkSession, d: str) -> DataFrame:
    """Variance of sizes inside a source and between sources, by the method of moments."""
    g = Catalogue(spark, d).items().groupBy("source").agg(F.count("size").cast("double").alias("n"), F.avg("size").alias("m"), (F.var_pop("size") * F.count("size")).alias("ss"))
    s = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") ** 2).alias("nmm"), F.sum(F.col("n") ** 2).alias("nn"), F.sum("ss").alias("ss"))
    own = F.col("ss") / (F.col("n") - F.col("k"))
    between = (F.col("nmm") - F.col("nm") ** 2 / F.col("n")) / (F.col("k") - 1)
    return s.select(F.round(own, 4).alias("own"), F.round(F.greatest((between - own) / ((F.col("n") - F.col("nn") / F.col("n")) / (F.col("k") - 1)), F.lit(0.0)), 4).alias("shared"))


@query(f"with {COMPONENTS} select ((k - 1) // 16)::int as block, count(distinct k) as dim, round(1 / sqrt(avg(x * x)), 5) as scale from v group by 1")
def block_scales(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of inputs, and what brings the mean square of each to one."""
    own = Catalogue(spark, d).vectors().select(F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    cells = own.groupBy("k").agg(F.sum(F.col("x") * F.col("x")).alias("s"), F.count("x").alias("n"))
    return cells.groupBy(F.floor(F.col("k") / 16).cast("int").alias("block")).agg(F.count("*").alias("dim"), F.round(1 / F.sqrt(F.sum("s") / F.sum("n")), 5).alias("scale"))


@query(f"with {COMPONENTS}, s as (select label, k, sum(x) as s, count(*) as n from v group by 1, 2), m as (select k, x as m from v where vec_id = 0) select vec_id, round((sum(s * m) / sqrt(sum(s * s)) - sum((s - x) * m) / sqrt(sum((s - x) * (s - x)))) / sqrt(sum(m * m)), 5) as influence from v join s using (label, k) join m using (k) where n > 1 group by 1")
def part_influence(spark: SparkSession, d: str) -> DataFrame:
    """What a part adds to the likeness of its whole to a mark: with all parts, less without it; from the sum of parts."""
    own = _doubles(spark, d)
    mark = own.where("vec_id = 0").select(F.col("v").alias("m"))
    both = own.join(_sums(own, "label").where("n > 1"), "label").crossJoin(F.broadcast(mark))
    rest = F.zip_with("total", "v", lambda s, x: s - x)
    return both.select("vec_id", F.round(nm.cosine(F.col("total"), F.col("m")) - nm.cosine(rest, F.col("m")), 5).alias("influence"))


# --- vocabularies and casts ---


@query(f"with {ITEMS}, v as (select item_id, source, work, unnest(list_distinct(words)) as value from items), works as (select source, count(*) as t from items group by 1), n as (select source, value, count(*) as n from v group by 1, 2), m as (select work, value, count(*) as mentions from v group by 1, 2), c as (select item_id, n.value from items join n using (source) join works using (source) where n.n * 16 >= t union select item_id, m.value from items join m using (work)) select c.item_id, c.value, round(coalesce(n.n, 0) / works.t::double, 6) as chance, coalesce(mentions, 0) as mentions from c join items i using (item_id) join works on works.source = i.source left join n on n.source = i.source and n.value = c.value left join m on m.work = i.work and m.value = c.value")
def work_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Values that a sixteenth of a source's works have or that the work's items name, with chance and mentions.

    A source gives each item a bounded number of values, so that rows grow with items.
    """
    own = Catalogue(spark, d).items().select("item_id", "source", "work", F.array_distinct("words").alias("words"))
    v = own.select("source", "work", F.explode("words").alias("value"))
    works = own.groupBy("source").agg(F.count("*").alias("t"))
    n = v.groupBy("source", "value").agg(F.count("*").alias("n")).join(works, "source").withColumn("chance", F.col("n") / F.col("t"))
    m = v.groupBy("work", "value").agg(F.count("*").alias("mentions"))
    keys = own.select("item_id", "source", "work")
    c = keys.join(n.where("n * 16 >= t").select("source", "value"), "source").select("item_id", "source", "work", "value")
    c = c.union(keys.join(m.select("work", "value"), "work").select("item_id", "source", "work", "value")).distinct()
    out = c.join(n.select("source", "value", "chance"), ["source", "value"], "left").join(m, ["work", "value"], "left")
    return out.select("item_id", "value", F.round(F.coalesce("chance", F.lit(0.0)), 6).alias("chance"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query(f"with {ITEMS}, v as (select *, unnest(list_distinct(words)) as value from items) select value, left(value, 1) as group_name, count(*) as works, count(distinct source) as sources, round(avg(ln(1 + price)), 5) as price, round(avg(size), 5) as size from v group by 1, 2")
def value_side(spark: SparkSession, d: str) -> DataFrame:
    """Values that can be suggested, with their group and what the works that have them are like."""
    v = Catalogue(spark, d).items().select("source", "price", "size", F.explode(F.array_distinct("words")).alias("value"))
    by = v.groupBy("value", "source").agg(F.count("*").alias("n"), F.sum(nm.log_scale(F.col("price"))).alias("p"), F.sum("size").alias("s"))
    return by.groupBy("value").agg(F.sum("n").alias("works"), F.count("*").alias("sources"), F.round(F.sum("p") / F.sum("n"), 5).alias("price"), F.round(F.sum("s") / F.sum("n"), 5).alias("size")).withColumn("group_name", F.substring("value", 1, 1))


@query(f"with {CHANCES}, a as (select *, list_slice({TYPES}, substr(source, 7)::int % 3 + 1, substr(source, 7)::int % 3 + 3) as allowed from ch join items using (item_id)) select item_id, arg_max(value, round(chance, 9) * 100 - list_position({TYPES}, value)::double / 1e9) as value, count(*) as offered from a where list_contains(allowed, value) group by 1".replace("join items using (item_id))", "join (select item_id, source from items) using (item_id))"))
def steps_allowed(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest of the steps of a scale that the item's site allows; at equal chances the lower step."""
    scale = F.array(*map(F.lit, TYPES))
    own = chances(spark, d).withColumn("low", F.substring_index("source", "#", -1).cast("int") % 3 + 1)
    place = F.array_position(scale, F.col("value"))
    return own.where(place.between(F.col("low"), F.col("low") + 2)).groupBy("item_id").agg(F.max_by("value", F.struct(F.round("chance", 9), -place)).alias("value"), F.count("*").alias("offered"))


@query("with c as (select l_partkey as item_id, s_nationkey as nation, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2) select item_id, n_name as universe, n, round(n / sum(n) over (partition by item_id)::double, 6) as share from c join nation on n_nationkey = nation")
def candidate_universes(spark: SparkSession, d: str) -> DataFrame:
    """Universes of a work's authors, with how many of its lines speak for each."""
    c = Catalogue(spark, d)
    lines = c.table("lineitem").groupBy(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    by = lines.join(c.table("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").groupBy("item_id", "s_nationkey").agg(F.sum("n").alias("n"))
    whole = by.groupBy("item_id").agg(F.sum("n").alias("t"))
    named = by.join(whole, "item_id").join(c.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("universe")), "s_nationkey")
    return named.select("item_id", "universe", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query(f"with {COMPONENTS}, n as (select count(*) as n from embeddings), c as (select distinct l_partkey as item_id, l_suppkey % n as vec_id from lineitem, n), m as (select item_id, k, avg(x) as x from c join v using (vec_id) group by 1, 2) select item_id, round(sqrt(sum(x * x)), 5) as length, round(max(case when k = 1 then x end), 5) as first from m group by 1")
def name_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of a work's cast, each name once."""
    c = Catalogue(spark, d)
    own = c.vectors().select("vec_id", F.col("embedding").alias("v"))
    cast = c.table("lineitem").crossJoin(F.broadcast(own.agg(F.count("*").alias("n")))).select(F.col("l_partkey").alias("item_id"), (F.col("l_suppkey") % F.col("n")).alias("vec_id")).distinct()
    return marks.means(cast, own).select("item_id", F.round("length", 5).alias("length"), F.round("first", 5).alias("first"))


@query(f"with {ITEMS}, w as (select item_id, unnest(list_distinct(words)) as w from items), f as (select item_id, w as feature from w union all select a.item_id, a.w || ' + ' || b.w from w a join w b on a.item_id = b.item_id and a.w < b.w) select feature, count(*) as works, min(item_id) as first from f group by 1")
def name_features(spark: SparkSession, d: str) -> DataFrame:
    """Each name and each pairing of a cast as a feature, with the works that have it."""
    names = F.sort_array(F.array_distinct("words"))
    pairs = F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: b > a), lambda b: F.concat(a, F.lit(" + "), b))))
    own = Catalogue(spark, d).items().select("item_id", names.alias("w")).select("item_id", F.explode(F.concat("w", pairs)).alias("feature"))
    return own.groupBy("feature").agg(F.count("*").alias("works"), F.min("item_id").alias("first"))


# --- pairs ---

FIRSTS = f"{ITEMS}, f as (select arg_min(item_id, item_id) as first_id, work from items group by 2), p as (select i.*, f.first_id, o.words as owords, o.size as osize, o.price as oprice, o.source as osource from items i join f using (work) join items o on o.item_id = f.first_id where i.item_id <> f.first_id)"


def first_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each item beside the first of its work, whose columns begin with o; one row a work is on the other side."""
    own = Catalogue(spark, d).items().select("item_id", "work", "source", "words", "size", "price")
    first = own.groupBy("work").agg(F.min_by(F.struct("item_id", "source", "words", "size", "price"), "item_id").alias("o"))
    return own.join(first, "work").where("item_id <> o.item_id").select("*", F.col("o.item_id").alias("first_id"), *(F.col(f"o.{c}").alias(f"o{c}") for c in ("source", "words", "size", "price")))


@query(f"with {FIRSTS} select item_id, first_id, len(list_intersect(words, owords)) as shared, len(list_distinct(list_concat(words, owords))) as either from p")
def compared_values(spark: SparkSession, d: str) -> DataFrame:
    """Values that the two works of a pair share, and that either has."""
    return first_pairs(spark, d).select("item_id", "first_id", F.size(F.array_intersect("words", "owords")).alias("shared"), F.size(F.array_union("words", "owords")).alias("either"))


@query(f"with {FIRSTS}, c as (select item_id, first_id, item_id % 13 = 0 as answered, case when source <> 'Brand#1' and size > 0 and osize > 0 then 1 / (1 + exp(10 - 12 * least(size, osize) / greatest(size, osize))) end as chance from p) select item_id, first_id, answered, round(chance, 6) as chance from c where answered or chance is null or chance >= 0.01")
def least_chance_kept(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that were answered, or that a learnt model gives a hundredth at least; where none is learnt, all."""
    chance = F.when(F.col("source") != "Brand#1", nm.sigmoid(12 * nm.size_ratio(F.col("size"), F.col("osize")) - 10))
    own = first_pairs(spark, d).select("item_id", "first_id", (F.col("item_id") % 13 == 0).alias("answered"), chance.alias("chance"))
    return own.where("answered or chance is null or chance >= 0.01").withColumn("chance", F.round("chance", 6))


@query(f"with {ITEMS}, r as (select source, min(size) filter (where size > 0) as ls, max(size) filter (where size > 0) as hs, min(price) as lp, max(price) as hp from items group by 1), t as (select min(ls) as als, max(hs) as ahs, min(lp) as alp, max(hp) as ahp from r) select source, round((ln(0.01 / 0.99) + 8 - 2 * coalesce(least(1, hs / als, ahs / ls), 0) - 1.5 * least(1, hp / alp, ahp / lp)) / 6, 6) as least_cosine from r, t")
def pruning_plan(spark: SparkSession, d: str) -> DataFrame:
    """The least likeness of titles at which a pair of a source's work can still have a hundredth, from what other layers can add at most.

    Bounds come from the ranges of sizes and prices, so that no pair that would be kept is passed over.
    """
    known = F.when(F.col("size") > 0, F.col("size"))
    r = Catalogue(spark, d).items().groupBy("source").agg(F.min(known).alias("ls"), F.max(known).alias("hs"), F.min("price").alias("lp"), F.max("price").alias("hp"))
    t = r.agg(F.min("ls").alias("als"), F.max("hs").alias("ahs"), F.min("lp").alias("alp"), F.max("hp").alias("ahp"))
    most = lambda c: F.least(F.lit(1.0), F.col(f"h{c}") / F.col(f"al{c}"), F.col(f"ah{c}") / F.col(f"l{c}"))
    least = (nm.logit(F.lit(0.01)) + 8 - 2 * F.coalesce(most("s"), F.lit(0.0)) - 1.5 * most("p")) / 6
    return r.crossJoin(F.broadcast(t)).select("source", F.round(least, 6).alias("least_cosine"))


@query(f"with {ITEMS} select a.item_id, b.item_id as other, a.source = b.source as same_source, round(len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words)))::double, 6) as words, round(case when a.size > 0 and b.size > 0 then least(a.size, b.size) / greatest(a.size, b.size) end, 6) as size, round(least(a.price, b.price) / greatest(a.price, b.price), 6) as price from items a, items b where a.item_id = 7 and b.item_id = 107")
def loose_pair(spark: SparkSession, d: str) -> DataFrame:
    """The layers of one pair, worked out on demand; both sides are read by key."""
    own = Catalogue(spark, d).items().select("item_id", "source", "words", "size", "price")
    other = own.where("item_id = 107").select(*(F.col(c).alias(f"o{c}") for c in own.columns))
    words = F.size(F.array_intersect("words", "owords")) / F.size(F.array_union("words", "owords"))
    return own.where("item_id = 7").crossJoin(F.broadcast(other)).select("item_id", F.col("oitem_id").alias("other"), (F.col("source") == F.col("osource")).alias("same_source"), F.round(words, 6).alias("words"), F.round(nm.size_ratio(F.col("size"), F.col("osize")), 6).alias("size"), F.round(nm.size_ratio(F.col("price"), F.col("oprice")), 6).alias("price"))


@query(f"with {ITEMS}, a as (select l_partkey as item_id, list(distinct l_linenumber order by l_linenumber) as authors from lineitem group by 1), c as (select min(item_id) as class_id, count(*) as n, lower(trim(title)) as t, authors from items join a using (item_id) group by 3, 4) select item_id, class_id, n from items join a using (item_id) join c on c.t = lower(trim(title)) and c.authors = a.authors where n > 1")
def whole_matches(spark: SparkSession, d: str) -> DataFrame:
    """Works of equal titles, but for case and ends, and equal sets of authors: the class each is in, not its pairs.

    Sets are told by size, ends and a sum of digests, so that no set is gathered.
    """
    c = Catalogue(spark, d)
    digest = F.conv(F.substring(F.md5(F.col("l_linenumber").cast("string")), 1, 10), 16, 10).cast("long")
    a = c.table("lineitem").select(F.col("l_partkey").alias("item_id"), "l_linenumber").distinct().groupBy("item_id").agg(F.struct(F.count("*"), F.min("l_linenumber"), F.max("l_linenumber"), F.sum(digest)).alias("authors"))
    own = c.items().select("item_id", F.lower(F.trim("title")).alias("t")).join(a, "item_id")
    classes = own.groupBy("t", "authors").agg(F.min("item_id").alias("class_id"), F.count("*").alias("n")).where("n > 1")
    return own.join(classes, ["t", "authors"]).select("item_id", "class_id", "n")


@query(rf"with {ITEMS}, g as (select item_id, ' ' || trim(regexp_replace(lower(title), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')) || ' ' as f from items), a as (select l_partkey as item_id, count(distinct l_suppkey) as authors from lineitem group by 1) select i.item_id, len(list_distinct(list_transform(range(1, length(f) - 1), lambda k: f[k:k+2]))) as trigrams, len(list_distinct(words)) as values_, size > 0 as sized, coalesce(authors, 0) as authors from items i join g using (item_id) left join a using (item_id)")
def search_sides(spark: SparkSession, d: str) -> DataFrame:
    """What a search of pairs lays out for each work: trigrams of its title, values, whether its size is known, authors."""
    c = Catalogue(spark, d)
    form = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{Nd}]+", " ")), F.lit(" "))
    own = c.items().withColumn("f", form)
    trigrams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("f") - 2, F.lit(1))), lambda k: F.substring("f", k, F.lit(3))))
    a = c.table("lineitem").select(F.col("l_partkey").alias("item_id"), "l_suppkey").distinct().groupBy("item_id").agg(F.count("*").alias("authors"))
    sides = own.select("item_id", F.size(trigrams).alias("trigrams"), F.size(F.array_distinct("words")).alias("values_"), (F.col("size") > 0).alias("sized"))
    return sides.join(a, "item_id", "left").withColumn("authors", F.coalesce("authors", F.lit(0)))


@query(f"with {COMPONENTS}, q as (select vec_id, label, k, least(greatest(round(x * 127)::int, -127), 127) as q from v), f as (select label, min(vec_id) as first_id from embeddings group by 1) select a.vec_id, first_id, sum(a.q * b.q)::bigint as product, round(sum(a.q * b.q) / sqrt(sum(a.q * a.q)) / sqrt(sum(b.q * b.q)), 5) as cosine from q a join f using (label) join q b on b.vec_id = first_id and b.k = a.k where a.vec_id <> first_id group by 1, 2")
def texts_compared(spark: SparkSession, d: str) -> DataFrame:
    """Texts beside the first of their kind by vectors in steps of 1/127."""
    step = lambda x: F.least(F.greatest(F.round(x * 127), F.lit(-127.0)), F.lit(127.0))
    own = _doubles(spark, d).select("vec_id", "label", F.transform("v", step).alias("q"))
    first = own.groupBy("label").agg(F.min_by(F.struct("vec_id", "q"), "vec_id").alias("o"))
    both = own.join(first, "label").where("vec_id <> o.vec_id")
    return both.select("vec_id", F.col("o.vec_id").alias("first_id"), nm.dot(F.col("q"), F.col("o.q")).cast("long").alias("product"), F.round(nm.cosine(F.col("q"), F.col("o.q")), 5).alias("cosine"))


@query("with l as (select s_suppkey as author, s_suppkey % 40 as place, s_suppkey % 10 = 3 as told_apart from supplier), r as (select l.*, c_name as name from l join customer on c_custkey = place), m as (select place, min(author) as merged from r where not told_apart group by 1) select author, name, case when told_apart then author else merged end as merged from r left join m using (place)")
def author_places(spark: SparkSession, d: str) -> DataFrame:
    """Authors whose links lead to one profile of another site are one, unless they were told apart."""
    c = Catalogue(spark, d)
    link = c.table("supplier").select(F.col("s_suppkey").alias("author"), (F.col("s_suppkey") % 40).alias("place"), (F.col("s_suppkey") % 10 == 3).alias("told_apart"))
    r = link.join(c.table("customer").select(F.col("c_custkey").alias("place"), F.col("c_name").alias("name")), "place")
    m = r.where("not told_apart").groupBy("place").agg(F.min("author").alias("first"))
    return r.join(m, "place", "left").select("author", "name", F.when(F.col("told_apart"), F.col("author")).otherwise(F.col("first")).alias("merged"))


# --- likeness of universes and tags ---


@query("with n as (select count(*) as n from embeddings), l as (select label, count(*) as n from embeddings group by 1), r as (select vec_id, label, row_number() over (partition by label order by vec_id) as k from embeddings), a as (select e.vec_id, e.label, r.vec_id as near from embeddings e join r on r.label = e.label and r.k <= 3 and r.vec_id <> e.vec_id), f as (select vec_id, label, ('0x' || left(md5(vec_id || ':' || r), 7))::bigint % n as far from embeddings, n, range(4) r(r)) select a.vec_id, a.near, f.far, round(1 / l.n::double, 6) as weight from a join f on f.vec_id = a.vec_id join embeddings o on o.vec_id = f.far and o.label <> a.label join l on l.label = a.label")
def triplets(spark: SparkSession, d: str) -> DataFrame:
    """What lies near a name and what lies far: three names of its universe, and draws by hash from all others; a universe weighs one."""
    return drawn_triplets(Catalogue(spark, d).vectors().select("vec_id", "label"))


def drawn_triplets(own: DataFrame) -> DataFrame:
    """(vec_id, near, far, weight) of rows (vec_id, label), whose ids are 0 to their number."""
    kin = own.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("a"))
    # the first three by three rounds of the least, which are combined before they move
    for name, before in (("b", "a"), ("c", "b")):
        more = own.join(kin.select("label", before), "label").where(F.col("vec_id") > F.col(before)).groupBy("label").agg(F.min("vec_id").alias(name))
        kin = kin.join(more, "label", "left")
    draw = lambda r: F.conv(F.substring(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit(f":{r}"))), 1, 7), 16, 10).cast("long") % F.col("total")
    asked = own.crossJoin(F.broadcast(own.agg(F.count("*").alias("total")))).select("vec_id", "label", F.explode(F.array(*(draw(r) for r in range(4)))).alias("far"))
    far = asked.join(own.select(F.col("vec_id").alias("far"), F.col("label").alias("other")), "far").where("other <> label")
    near = far.join(kin, "label").select("vec_id", "far", "n", F.explode(F.array("a", "b", "c")).alias("near")).where("near <> vec_id")
    return near.select("vec_id", "near", "far", F.round(1 / F.col("n"), 6).alias("weight"))


@query("with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), c as (select q.vec_id, q.label = o.label as same, round(list_cosine_similarity(q.v, o.v), 9) as c from v q join v o on q.vec_id % 50 = 0 and o.vec_id <> q.vec_id), b as (select vec_id, max(c) as best from c where same group by 1), p as (select vec_id, 1 + count(*) filter (where not same and c > best) as place from c join b using (vec_id) group by 1) select count(*) as asked, round(avg((place = 1)::int), 6) as first_hits, round(avg(1.0::double / place), 6) as reciprocal from p")
def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    """How often the nearest of a stated set of queries is of its universe, and the mean reciprocal place of the first that is.

    Queries go to every task in blocks; two passes keep one row a query: its best kin, and how many are nearer.
    """
    own = Catalogue(spark, d).vectors().withColumnRenamed("embedding", "v")
    place = marks.kin_places(own, own.where("vec_id % 50 = 0"))
    return place.agg(F.count("*").alias("asked"), F.round(F.avg((F.col("place") == 1).cast("int")), 6).alias("first_hits"), F.round(F.avg(1 / F.col("place")), 6).alias("reciprocal"))


@query(f"with {COMPONENTS}, m as (select label, vec_id % 3 as way, k, avg(x) as x from v group by 1, 2, 3), c as (select o.label, o.way, a.way as way0, sum(a.x * o.x) / sqrt(sum(a.x * a.x)) / sqrt(sum(o.x * o.x)) as c from m a join m o on o.k = a.k and o.label <> 0 where a.label = 0 group by 1, 2, 3) select label, round(max(c), 5) as likeness from c group by 1")
def tag_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of tags to one tag: the best over the directions in which either is used."""
    m = _sums(_doubles(spark, d), "label", F.col("vec_id") % 3)
    mark = m.where("label = 0").select(F.col("total").alias("mark"))
    return m.where("label <> 0").crossJoin(F.broadcast(mark)).groupBy("label").agg(F.round(F.max(nm.cosine(F.col("total"), F.col("mark"))), 5).alias("likeness"))


# --- hierarchies ---


@query("with i as (select l_suppkey as s, count(*) as impact from lineitem group by 1), e as (select s_suppkey as s, s_nationkey as n, n_regionkey as r, s_suppkey % 5 as own from supplier join nation on n_nationkey = s_nationkey) select case when own = r then 'UNLINK' else 'LINK' end as kind, case when own = r then 'S' || s else 'N' || n end as child, 'R' || own as parent, sum(coalesce(impact, 0))::bigint as impact from e left join i using (s) group by 1, 2, 3")
def hierarchy_offers(spark: SparkSession, d: str) -> DataFrame:
    """Links that follow from others are offered to be taken off, parents of children that a parent lacks to be linked; with the works concerned."""
    c = Catalogue(spark, d)
    impact = c.table("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("impact"))
    own = (F.col("s_suppkey") % 5).alias("own")
    e = c.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"), own).join(c.table("nation").select("n_nationkey", "n_regionkey"), "n_nationkey").join(impact, "s_suppkey", "left")
    follows = F.col("own") == F.col("n_regionkey")
    child = F.when(follows, F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")))
    return e.groupBy(F.when(follows, "UNLINK").otherwise("LINK").alias("kind"), child.alias("child"), F.concat(F.lit("R"), F.col("own").cast("string")).alias("parent")).agg(F.sum(F.coalesce("impact", F.lit(0))).alias("impact"))


@query("with p as (select distinct l_orderkey as k, s_nationkey as a from lineitem join supplier on s_suppkey = l_suppkey), c as (select o_orderkey as k, c_nationkey as b from orders join customer on c_custkey = o_custkey), n as (select least(a, b) as a, greatest(a, b) as b, count(*) as works from p join c using (k) where a <> b group by 1, 2) select x.n_name as a, y.n_name as b, case when x.n_regionkey = y.n_regionkey then 'R' || x.n_regionkey else 'W' end as parent, works from n join nation x on x.n_nationkey = a join nation y on y.n_nationkey = b")
def new_parents(spark: SparkSession, d: str) -> DataFrame:
    """The lowest common ancestor of tags that stand together, with the works in which they do."""
    c = Catalogue(spark, d)
    lines = c.table("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s_suppkey")).join(c.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("a")), "s_suppkey").select("k", "a").distinct()
    orders = c.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c_custkey")).join(c.table("customer").select("c_custkey", F.col("c_nationkey").alias("b")), "c_custkey").select("k", "b")
    n = lines.join(orders, "k").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("works"))
    side = lambda x: c.table("nation").select(F.col("n_nationkey").alias(x), F.col("n_name").alias(f"{x}name"), F.col("n_regionkey").alias(f"{x}region"))
    parent = F.when(F.col("aregion") == F.col("bregion"), F.concat(F.lit("R"), F.col("aregion").cast("string"))).otherwise("W")
    return n.join(side("a"), "a").join(side("b"), "b").select(F.col("aname").alias("a"), F.col("bname").alias("b"), parent.alias("parent"), "works")


# --- judgments ---


@query("select source, count(*) as judged, count(*) filter (where md5(text) = md5(case when doc_id % 7 = 0 then text || '.' else text end)) as stand from documents group by 1")
def judged_as_shown(spark: SparkSession, d: str) -> DataFrame:
    """Judgments that stand: those of a text that is still what was judged, told by its digest."""
    own = Catalogue(spark, d).documents().select("source", F.md5("text").alias("now"), F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("judged"))
    return own.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("now") == F.col("judged")).alias("stand")).withColumnRenamed("n", "judged")
