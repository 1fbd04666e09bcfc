"""Scalar and vector features, validation figures, suggestions and pairs of works, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import numbers as nm, text as tx
from ..operators import likest, listing, models
from ..sources.catalogue import Catalogue
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


# --- numbers and vectors ---


@query(f"with {ITEMS} select item_id, round(ln(1 + greatest(price, 0)), 6) as logged, round(greatest(size - 20, 0) + ln(1 + exp(-abs(size - 20))), 6) as soft from items")
def scales(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).items().select("item_id", F.round(nm.log_scale(F.col("price")), 6).alias("logged"), F.round(nm.softplus(F.col("size") - 20), 6).alias("soft"))


CENTRED = "v as (select vec_id, generate_subscripts(embedding, 1) as k, unnest(embedding)::double as x from embeddings), c as (select k, avg(x) as c, greatest(stddev_pop(x), 1e-6) as s from v group by 1)"


def _centred(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, v, centre and spread: mean and spread of each component, in one row that goes to every task."""
    own = Catalogue(spark, d).vectors().select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    stat = own.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("c"), F.greatest(F.stddev_pop("x"), F.lit(1e-6)).alias("s"))
    line = stat.agg(F.sort_array(F.collect_list(F.struct("k", "c", "s"))).alias("z")).select(F.col("z.c").alias("centre"), F.col("z.s").alias("spread"))
    return own.crossJoin(F.broadcast(line))


@query(f"with {CENTRED}, z as (select vec_id, v.k, (x - c) / s as z from v join c using (k)) select vec_id, round(max(case when k = 1 then z end) * sqrt(max(k)), 5) as first, round(sqrt(sum(z * z)), 5) as length from z group by 1")
def stretched_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors centred, and stretched by the spread of each component."""
    z = F.transform(F.arrays_zip("v", "centre", "spread"), lambda x: (x["v"] - x["centre"]) / x["spread"])
    return _centred(spark, d).withColumn("z", z).select("vec_id", F.round(F.col("z")[0] * F.sqrt(F.size("z").cast("double")), 5).alias("first"), F.round(nm.norm(F.col("z")), 5).alias("length"))


@query(f"with {CENTRED}, u as (select vec_id, v.k, x - c as z from v join c using (k)), l as (select vec_id, sqrt(sum(z * z)) as l from u group by 1), m as (select k, z from u where vec_id = 0) select u.vec_id, round(sum(u.z * m.z) / any_value(l.l) / (select l from l where vec_id = 0), 5) as cosine from u join m using (k) join l on l.vec_id = u.vec_id where u.vec_id <> 0 group by 1")
def centred_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine to a mark after the mean of all vectors is taken off both."""
    own = _centred(spark, d).select("vec_id", F.zip_with("v", "centre", lambda x, c: x - c).alias("z"))
    mark = own.where("vec_id = 0").select(F.col("z").alias("m"))
    return own.where("vec_id <> 0").crossJoin(F.broadcast(mark)).select("vec_id", F.round(nm.cosine(F.col("z"), F.col("m")), 5).alias("cosine"))


@query("with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), s as (select v.vec_id, m.vec_id % 2 = 0 as plus, list_cosine_similarity(v.v, m.v) as s, row_number() over (partition by v.vec_id, m.vec_id % 2 order by list_cosine_similarity(v.v, m.v) desc) as k from v join v m on m.vec_id < 12 and m.vec_id <> v.vec_id) select vec_id, round(greatest(max(s) filter (where plus and k = 1), 0), 5) as plus1, round(greatest(max(s) filter (where plus and k = 2), 0), 5) as plus2, round(greatest(max(s) filter (where not plus and k = 1), 0), 5) as minus1, round(greatest(max(s) filter (where not plus and k = 2), 0), 5) as minus2 from s group by 1")
def four_axes(spark: SparkSession, d: str) -> DataFrame:
    """The two strongest likenesses to marks of either sign, a work's own mark left out; marks are a few rows."""
    own = Catalogue(spark, d).vectors()
    marks = own.where("vec_id < 12").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("m"))
    best = lambda odd: F.sort_array(F.transform(F.filter("m", lambda x: (x["vec_id"] % 2 == odd) & (x["vec_id"] != F.col("vec_id"))), lambda x: F.greatest(nm.cosine(F.col("embedding"), x["embedding"]), F.lit(0.0))), False)
    both = own.crossJoin(F.broadcast(marks)).select("vec_id", best(0).alias("p"), best(1).alias("n"))
    return both.select("vec_id", *(F.round(F.col(c)[k], 5).alias(f"{name}{k + 1}") for c, name in (("p", "plus"), ("n", "minus")) for k in (0, 1)))


@query("with v as (select vec_id, generate_subscripts(embedding, 1) as k, unnest(embedding)::double as x from embeddings) select vec_id, list(least(greatest(round(x * 127)::int, -127), 127) order by k)::varchar as bytes, round(sqrt(sum(pow(x - least(greatest(round(x * 127), -127), 127) / 127, 2))), 6) as loss from v group by 1")
def byte_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in steps of 1/127, and what that loses."""
    step = lambda x: F.least(F.greatest(F.round(x.cast("double") * 127), F.lit(-127.0)), F.lit(127.0))
    own = Catalogue(spark, d).vectors()
    shown = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: step(x).cast("int").cast("string")), ", "), F.lit("]"))
    off = F.aggregate(F.transform("embedding", lambda x: x.cast("double") - step(x) / 127), F.lit(0.0), lambda s, x: s + x * x)
    return own.select("vec_id", shown.alias("bytes"), F.round(F.sqrt(off), 6).alias("loss"))


@query("with p as (select vec_id, k, sum(x * case when ('0x' || left(md5(k || ':' || r.r), 2))::int % 2 = 0 then 1 else -1 end) as y, r.r as r from (select vec_id, generate_subscripts(embedding, 1) - 1 as k, unnest(embedding)::double as x from embeddings) v, range(8) r(r) group by 1, 2, 4), q as (select vec_id, r, sum(y) / sqrt(8.0) as y from p group by 1, 2) select vec_id, r as axis, round(y, 5) as place from q".replace("select vec_id, k, sum(x", "select vec_id, sum(x").replace("group by 1, 2, 4)", "group by 1, 3)"))
def random_projection(spark: SparkSession, d: str) -> DataFrame:
    """Places of vectors along eight axes of random signs, drawn by hash, so that they are the same everywhere."""
    own = Catalogue(spark, d).vectors().select("vec_id", F.posexplode("embedding").alias("k", "x"))
    sign = lambda r: F.when(F.conv(F.substring(F.md5(F.concat(F.col("k").cast("string"), F.lit(f":{r}"))), 1, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = own.groupBy("vec_id").agg(*(F.sum(F.col("x").cast("double") * sign(r)).alias(f"a{r}") for r in range(8)))
    axes = F.array(*(F.struct(F.lit(r).cast("long").alias("axis"), F.round(F.col(f"a{r}") / F.sqrt(F.lit(8.0)), 5).alias("place")) for r in range(8)))
    return sums.select("vec_id", F.explode(axes).alias("a")).select("vec_id", "a.*")


@query(f"with {ITEMS}, w as (select distinct unnest(words) as value from items), o as (select value, row_number() over (order by value) - 1 as at_ from w) select item_id, string_agg(at_::varchar, ',' order by at_) as places from (select item_id, unnest(words) as value from items) join o using (value) group by 1")
def one_hot_layout(spark: SparkSession, d: str) -> DataFrame:
    """The columns that an item's values set, values in the order of their names; the layout is one small row."""
    own = Catalogue(spark, d).items().select("item_id", F.array_distinct("words").alias("words"))
    layout = own.select(F.explode("words").alias("value")).distinct().agg(F.sort_array(F.collect_list("value")).alias("layout"))
    at = F.sort_array(F.transform("words", lambda x: F.array_position("layout", x) - 1))
    return own.crossJoin(F.broadcast(layout)).select("item_id", F.array_join(F.transform(at, lambda x: x.cast("string")), ",").alias("places"))


@query(rf"with g as (select p_partkey as id, ' ' || trim(regexp_replace(lower(p_name), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')) || ' ' as f from part), c as (select id, substr(f, i, 3) as t from g, range(1, 80) r(i) where i <= length(f) - 2), b as (select id, (((ascii(t[1]) * 961 + ascii(t[2]) * 31 + ascii(t[3]))::bigint * 2654435769) % 4294967296) // 8388608 as bucket, count(*) as n from c group by 1, 2) select id as item_id, count(*) as buckets, round(sqrt(sum(n * n)), 6) as length, min(bucket)::int as first from b group by 1")
def hashed_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles as counts of hashed trigrams: buckets set, length, and the first bucket."""
    own = Catalogue(spark, d).items().select("item_id", F.explode(tx.hashed_trigrams(F.col("title"))).alias("bucket")).groupBy("item_id", "bucket").agg(F.count("*").alias("n"))
    return own.groupBy("item_id").agg(F.count("*").alias("buckets"), F.round(F.sqrt(F.sum(F.col("n") * F.col("n"))), 6).alias("length"), F.min("bucket").alias("first"))


@query("select o_orderkey as k, epoch_ms(o_orderdate + to_hours((o_orderkey % 24)::int) + to_minutes((o_orderkey % 60)::int)) as ms from orders")
def comment_times(spark: SparkSession, d: str) -> DataFrame:
    """Times of comments as people read them (d MMM yyyy h:mma) back as instants."""
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 24 * 3600 + F.col("o_orderkey") % 60 * 60)
    told = Catalogue(spark, d).table("orders").select("o_orderkey", F.date_format(at, "d MMM yyyy h:mma").alias("t"))
    return told.select(F.col("o_orderkey").alias("k"), F.unix_millis(tx.comment_time(F.col("t"))).alias("ms"))


@query("with l(tag, code) as (values ('en-GB', 'en'), ('English', 'en'), ('de', 'de'), ('Deutsch', 'de'), ('FR_fr', 'fr'), ('Spanish', 'es'), ('xx-yy', null), ('', null)) select doc_id, coalesce(l.code, 'none') as code from documents join l on l.tag = ['en-GB', 'English', 'de', 'Deutsch', 'FR_fr', 'Spanish', 'xx-yy', ''][1 + doc_id % 8]")
def language_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of languages told by tags, by their names in English or in themselves."""
    said = F.element_at(F.array(*map(F.lit, ["en-GB", "English", "de", "Deutsch", "FR_fr", "Spanish", "xx-yy", ""])), (F.col("doc_id") % 8 + 1).cast("int"))
    return Catalogue(spark, d).documents().select("doc_id", F.coalesce(tx.language_code(said), F.lit("none")).alias("code"))


COMMON = {"en": ["the", "and", "of", "that"], "de": ["der", "die", "und", "das"], "fr": ["le", "la", "et", "les"], "es": ["el", "que", "los", "una"]}


@query(r"with w as (select doc_id, lang, regexp_extract_all(lower(text), '\p{L}+') as w from documents), n as (select doc_id, lang, len(w) as n, " + ", ".join(f"len(list_filter(w, lambda x: x in ({', '.join(repr(x) for x in v)}))) as {k}" for k, v in COMMON.items()) + " from w) select doc_id, case when n < 50 or greatest(en, de, fr, es) = 0 then lang when en = greatest(en, de, fr, es) then 'en' when de = greatest(en, de, fr, es) then 'de' when fr = greatest(en, de, fr, es) then 'fr' else 'es' end as detected from n")
def text_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language of a text by its common words; a text of fewer than fifty words keeps its work's."""
    w = tx.letter_words(F.lower("text"))
    return Catalogue(spark, d).documents().withColumn("w", w).select("doc_id", tx.common_language(F.col("w"), COMMON, F.col("lang")).alias("detected"))


# --- validation ---


@query(f"with {ROWS}, s as (select min(score) as low, max(score) as high from rows_ where score is not null) select item_id, round(10 * (score - low) / (high - low), 5) as scaled from rows_, s where score is not null")
def scaled_scores(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d).where("score is not null").select("item_id", "score")
    ends = own.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    return own.crossJoin(F.broadcast(ends)).select("item_id", F.round(10 * (F.col("score") - F.col("low")) / (F.col("high") - F.col("low")), 5).alias("scaled"))


@query(f"with {ROWS}, f as (select type, work % 5 as fold, avg(score) as m from rows_ where score is not null group by 1, 2) select type, round(sqrt(sum(pow(m - a, 2)) / (any_value(n) - 1) / any_value(n)), 8) as se from (select *, avg(m) over (partition by type) as a, count(*) over (partition by type) as n from f) group by 1")
def fold_errors(spark: SparkSession, d: str) -> DataFrame:
    """Standard error of each parameter's mean over folds."""
    f = rows(spark, d).where("score is not null").groupBy("type", (F.col("work") % 5).alias("fold")).agg(F.avg("score").alias("m"))
    return f.groupBy("type").agg(F.round(F.stddev_samp("m") / F.sqrt(F.count("*")), 8).alias("se"))


@query(f"with {ROWS}, g as (select source, work % 5 as fold, count(*) as n, sum(grade)::double as s from rows_ where grade is not null group by 1, 2), t as (select source, sum(n) as n, sum(s) as s from g group by 1) select r.item_id, round((t.s - g.s + 3) / (t.n - g.n + 1), 6) as held_out from rows_ r join g on g.source = r.source and g.fold = r.work % 5 join t on t.source = r.source where r.grade is not null")
def held_out_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score of each graded item from the grades of its source in the other folds, by sums less the fold's own."""
    own = rows(spark, d).where("grade is not null").select("item_id", "source", "grade", (F.col("work") % 5).alias("fold"))
    g = own.groupBy("source", "fold").agg(F.count("*").alias("n"), F.sum("grade").cast("double").alias("s"))
    t = g.groupBy("source").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    return own.join(g, ["source", "fold"]).join(t, "source").select("item_id", F.round((F.col("ts") - F.col("s") + 3) / (F.col("tn") - F.col("n") + 1), 6).alias("held_out"))


@query(f"with {ROWS}, a as (select avg(score) as score, avg(chance) as chance from rows_ where score is not null) select r.item_id, round(r.score * r.chance - a.score * r.chance, 6) as by_score, round(r.score * r.chance - r.score * a.chance, 6) as by_chance from rows_ r, a where r.score is not null")
def part_worths(spark: SparkSession, d: str) -> DataFrame:
    """What each part of a prediction is worth: the prediction less that with the part at its average."""
    own = rows(spark, d).where("score is not null").select("item_id", "score", "chance")
    a = own.agg(F.avg("score").alias("ms"), F.avg("chance").alias("mc"))
    s, c = F.col("score"), F.col("chance")
    return own.crossJoin(F.broadcast(a)).select("item_id", F.round(s * c - F.col("ms") * c, 6).alias("by_score"), F.round(s * c - s * F.col("mc"), 6).alias("by_chance"))


@query(f"with {ROWS} select item_id, case when item_id % 17 = 0 then 2 when item_id % 19 = 0 then 1 end as mark, round(coalesce(case when item_id % 17 = 0 then 1.0 when item_id % 19 = 0 then 0.0 end, chance), 6) as interest from rows_ where chance is not null")
def interest_rows(spark: SparkSession, d: str) -> DataFrame:
    """Marks of interest as grades of two classes; a mark stands above the model's chance."""
    said = F.when(F.col("item_id") % 17 == 0, F.lit(True)).when(F.col("item_id") % 19 == 0, F.lit(False))
    own = rows(spark, d).where("chance is not null")
    return own.select("item_id", F.when(said, 2).when(~said, 1).alias("mark"), F.round(listing.interest(said.cast("int"), F.col("chance")), 6).alias("interest"))


# --- suggestions ---

CHANCES = f"{ITEMS}, n as (select source, type, count(*) as n from items group by 1, 2), t as (select source, sum(n) as t from n group by 1), ch as (select i.item_id, n.type as value, n.n / t.t::double as chance, i.type as has from items i join n on n.source = i.source join t on t.source = i.source)"


def chances(spark: SparkSession, d: str) -> DataFrame:
    """item_id, value, chance, has: the chance of each type by the item's source, and the type it has."""
    own = Catalogue(spark, d).items().select("item_id", "source", F.col("type").alias("has"))
    n = own.groupBy("source", F.col("has").alias("value")).agg(F.count("*").alias("n"))
    t = n.groupBy("source").agg(F.sum("n").alias("t"))
    return own.join(n.join(t, "source").select("source", "value", (F.col("n") / F.col("t")).alias("chance")), "source")


@query(f"with {CHANCES}, r as (select *, row_number() over (partition by item_id order by chance desc, value) as k from ch) select item_id, value, round(chance, 6) as chance, case when value = has then 'has' when item_id % 10 = 0 then 'rejected' when chance >= 0.2 then 'likely' else 'other' end as state from r where value = has or item_id % 10 = 0 or chance >= 0.2 or k <= 2")
def shown_chances(spark: SparkSession, d: str) -> DataFrame:
    """Of each item the values that it has, that were rejected, that are likely, and the best few others."""
    k = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("chance"), "value"))
    own = chances(spark, d).withColumn("k", k).where("value = has or item_id % 10 = 0 or chance >= 0.2 or k <= 2")
    state = F.when(F.col("value") == F.col("has"), "has").when(F.col("item_id") % 10 == 0, "rejected").when(F.col("chance") >= 0.2, "likely").otherwise("other")
    return own.select("item_id", "value", F.round("chance", 6).alias("chance"), state.alias("state"))


@query(f"with {CHANCES}, r as (select *, row_number() over (partition by item_id order by chance desc, value) as k from ch where not (item_id % 10 = 0 and value = has)) select item_id, value from r where k = 1")
def values_given(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest value of a single facet that must have one, rejected ones left out."""
    own = chances(spark, d).where("not (item_id % 10 = 0 and value = has)")
    return own.groupBy("item_id").agg(F.min_by("value", F.struct(-F.col("chance"), F.col("value"))).alias("value"))


@query(f"with {CHANCES}, f as (select value, avg(-ln(greatest(case when value = has then chance else 1 - chance end, 1e-6))) as by_source from ch group by 1), b as (select type, count(*) / (select count(*) from items)::double as p from items group by 1), g as (select b.type as value, avg(-ln(greatest(case when i.type = b.type then p else 1 - p end, 1e-6))) as by_all from items i, b group by 1) select value, round(by_source, 6) as by_source, round(by_all, 6) as by_all, case when by_source <= by_all then 'source' else 'all' end as chosen from f join g using (value)")
def methods_compared(spark: SparkSession, d: str) -> DataFrame:
    """Loss of two ways to suggest each value, and the better one."""
    loss = lambda hit, p: -F.ln(F.greatest(F.when(hit, p).otherwise(1 - p), F.lit(1e-6)))
    # values that no item of a source has weigh in by neither way
    a = chances(spark, d).groupBy("value").agg(F.avg(loss(F.col("value") == F.col("has"), F.col("chance"))).alias("a"))
    n = Catalogue(spark, d).items().groupBy(F.col("type").alias("value")).agg(F.count("*").alias("n"))
    p = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).withColumn("p", F.col("n") / F.col("t"))
    b = p.select("value", (F.col("p") * loss(F.lit(True), F.col("p")) + (1 - F.col("p")) * loss(F.lit(False), F.col("p"))).alias("b"))
    return a.join(b, "value").select("value", F.round("a", 6).alias("by_source"), F.round("b", 6).alias("by_all"), F.when(F.col("a") <= F.col("b"), "source").otherwise("all").alias("chosen"))


@query(f"""with {ITEMS}, i as (select item_id, source, type, case when size >= 40 then 'LARGE' when size >= 20 then 'MEDIUM' else 'SMALL' end as girth from items),
n1 as (select source, type as v, count(*) as n from i group by 1, 2),
g1 as (select item_id, v, n - (v = type)::int as n, row_number() over (partition by item_id order by n - (v = type)::int desc, v desc) as k from i join n1 using (source)),
f as (select i.*, case when g1.n > 0 then v end as first from i join g1 using (item_id) where k = 1),
n2 as (select source, type as first, girth as v, count(*) as n from i group by 1, 2, 3),
g2 as (select item_id, v, n - (v = girth and f.first = type)::int as n, row_number() over (partition by item_id order by n - (v = girth and f.first = type)::int desc, v desc) as k from f join n2 using (source, first))
select item_id, f.first, case when g2.n > 0 then v end as second from f left join (select * from g2 where k = 1) g2 using (item_id)""")
def facet_chain(spark: SparkSession, d: str) -> DataFrame:
    """Facets one after another, each the commonest among the site's other items: what the first gives is context of the second.

    An item is left out of its own counts. Those of a context are one row of the facet's values.
    """
    girth = F.when(F.col("size") >= 40, "LARGE").when(F.col("size") >= 20, "MEDIUM").otherwise("SMALL")
    own = Catalogue(spark, d).items().select("item_id", "source", "type", girth.alias("girth"))
    first = models.commonest_of_others(own, ["source"], "type", "first")
    return models.commonest_of_others(first, ["source", "first"], "girth", "second", ["source", "type"]).select("item_id", "first", "second")


# --- pairs of works ---


@query(f"with {ITEMS}, v as (select item_id, unnest(words) as w from items), n as (select w, count(distinct item_id) as n from v group by 1), t as (select count(*)::double as t from items), x as (select item_id, w, ln(t / n) as x from (select distinct item_id, w from v) join n using (w), t) select item_id, w as value, round(x / sqrt(sum(x * x) over (partition by item_id)), 6) as weight from x")
def unit_weights(spark: SparkSession, d: str) -> DataFrame:
    """Values of items weighed by rarity, each item's to length one."""
    own = Catalogue(spark, d).items().select("item_id", F.array_distinct("words").alias("words"))
    n = own.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).crossJoin(F.broadcast(own.agg(F.count("*").alias("t"))))
    x = own.select("item_id", F.explode("words").alias("w")).join(n, "w").withColumn("x", F.ln(F.col("t") / F.col("n")))
    return x.select("item_id", F.col("w").alias("value"), F.round(F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("item_id"))), 6).alias("weight"))


ASKED = f"""{ITEMS}, q as (select * from items where item_id % 50 = 0), c as (select q.item_id as asked, i.item_id as other, q.title = i.title or (q.type = i.type and q.size = i.size) as blocked,
(len(list_intersect(q.words, i.words)) / len(list_distinct(list_concat(q.words, i.words)))::double + case when q.size > 0 and i.size > 0 then least(q.size, i.size) / greatest(q.size, i.size) else 0 end + least(q.price, i.price) / greatest(q.price, i.price)) / 3 as likeness
from q join items i on q.source <> i.source), best as (select *, row_number() over (partition by asked order by round(likeness, 9) desc, other) as k from c)"""


def asked_and_all(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All items, and those asked about, whose id 50 divides."""
    own = Catalogue(spark, d).items().select("item_id", "source", "title", "type", "words", "size", "price")
    return own, own.where("item_id % 50 = 0")


@query(f"with {ASKED} select asked, other, round(likeness, 6) as likeness from best where k = 1")
def exhaustive_search(spark: SparkSession, d: str) -> DataFrame:
    """The likest work of another source for each asked item; only groups that cannot hold it are not compared."""
    return likest.likest(*asked_and_all(spark, d)).select("asked", "other", F.round("likeness", 6).alias("likeness"))


@query(f"with {ASKED} select count(*) as kept, count(*) filter (where blocked) as found, round(count(*) filter (where blocked) / count(*)::double, 6) as recall from c where likeness >= 0.9")
def search_recall(spark: SparkSession, d: str) -> DataFrame:
    """The share of an exhaustive search's kept pairs that share a block, which is what a search through blocks finds."""
    own = likest.counted(*asked_and_all(spark, d), 0.9)
    return own.withColumn("recall", F.when(F.col("kept") > 0, F.round(F.col("found") / F.col("kept"), 6)))


@query(f"with {ITEMS}, n as (select source, count(*) as works from items group by 1), v as (select source, w as value, count(*) as n from (select item_id, source, unnest(words) as w from items) group by 1, 2) select source, value, v.n from v join n using (source) where v.n * 16 >= works")
def frequent_values(spark: SparkSession, d: str) -> DataFrame:
    """Values that a sixteenth of a source's works have at least."""
    own = Catalogue(spark, d).items()
    works = own.groupBy("source").agg(F.count("*").alias("works"))
    n = own.select("source", F.explode("words").alias("value")).groupBy("source", "value").agg(F.count("*").alias("n"))
    return n.join(works, "source").where("n * 16 >= works").select("source", "value", "n")


@query("with e as (select user_id, event_id, event_type, ts, lead(event_type) over (partition by user_id order by ts, event_id) as next from events), s as (select * from e where event_type <> 'error' and coalesce(next, '') <> 'error') select user_id, arg_max(event_type, epoch_us(ts)::hugeint * 10000000 + event_id) as said, count(*) as standing from s group by 1")
def journal_with_undo(spark: SparkSession, d: str) -> DataFrame:
    """An append-only journal in which an undo takes back the entry before it: what stands of each key, and the last word."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    own = Catalogue(spark, d).table("events").withColumn("after", after).where((F.col("event_type") != "error") & (F.coalesce("after", F.lit("")) != "error"))
    return own.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("said"), F.count("*").alias("standing"))


@query("with a as (select l_orderkey as k, l_returnflag as said, l_quantity as q from lineitem) select case said when 'A' then 'SAME' when 'N' then 'DIFFERENT' else 'TRANSLATION' end as answer, case said when 'A' then 1 when 'N' then 0 end as label, count(*) as n from a group by 1, 2")
def pair_labels(spark: SparkSession, d: str) -> DataFrame:
    """Answers on pairs as labels of a model: the same is yes, different no, translations are left out."""
    said = F.when(F.col("l_returnflag") == "A", "SAME").when(F.col("l_returnflag") == "N", "DIFFERENT").otherwise("TRANSLATION")
    return Catalogue(spark, d).table("lineitem").select(said.alias("answer")).withColumn("label", F.when(F.col("answer") == "SAME", 1).when(F.col("answer") == "DIFFERENT", 0)).groupBy("answer", "label").agg(F.count("*").alias("n"))
