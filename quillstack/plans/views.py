"""Composed reads: marking, history, what sites say, dictionaries, series, authors, offers, tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import graph, listing
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


@query(f"""with {ROWS}, m as (select item_id, chance, case when item_id % 5 = 0 then list_contains(words, 'red') end as said from rows_ where chance is not null),
s as (select *, row_number() over (order by said is not null, abs(chance - 0.5), item_id) as place, count(*) over () as total from m) select item_id, round(chance, 6) as chance, said, total from s where place <= 500""")
def marking_table(spark: SparkSession, d: str) -> DataFrame:
    """Items open to one value, the most doubtful first, then those answered; a page of 500 and the total."""
    own = rows(spark, d).where("chance is not null").select("item_id", "chance", F.when(F.col("item_id") % 5 == 0, F.array_contains("words", "red")).alias("said"))
    page = listing.page(own, [F.col("said").isNotNull().asc(), F.abs(F.col("chance") - 0.5).asc(), F.asc("item_id")], 0, 500)
    return page.select("item_id", F.round("chance", 6).alias("chance"), "said", "total")


@query(f"""with {RATINGS}, g as (select work, max(rated_at) as at_, arg_max(grade, epoch_us(rated_at)::hugeint * 100000000000 + rating_id * 10 + version) as grade from ratings group by 1),
i as (select l_partkey % 700 as work, max(l_shipdate) as at_, bool_or(l_returnflag = 'N') as wanted from lineitem where l_linestatus = 'O' group by 1), r as (select work, min(item_id) as item_id from items group by 1), {ITEMS}
select item_id, work, grade, wanted, greatest(coalesce(g.at_, i.at_), coalesce(i.at_, g.at_)) as "at" from r join (g full join i using (work)) using (work) order by "at" desc, work limit 100""".replace("r as (select work, min(item_id) as item_id from items group by 1), " + ITEMS, ITEMS + ", r as (select work, min(item_id) as item_id from items group by 1)"))
def history(spark: SparkSession, d: str) -> DataFrame:
    """Grades and marks of interest, once a work by its first item, the newest first."""
    c = Catalogue(spark, d)
    g = c.ratings().groupBy("work").agg(F.max("rated_at").alias("g_at"), F.max_by("grade", F.struct("rated_at", "rating_id", "version")).alias("grade"))
    i = c.table("lineitem").where("l_linestatus = 'O'").groupBy((F.col("l_partkey") % 700).alias("work")).agg(F.max("l_shipdate").alias("i_at"), F.bool_or(F.col("l_returnflag") == "N").alias("wanted"))
    first = c.items().groupBy("work").agg(F.min("item_id").alias("item_id"))
    both = g.join(i, "work", "full_outer").join(first, "work")
    return both.select("item_id", "work", "grade", "wanted", F.greatest("g_at", "i_at").alias("at")).orderBy(F.desc("at"), "work").limit(100)


@query(f"with {ITEMS} select work, 'size' as field, source, size::bigint::varchar as value from items union all select work, 'title', source, title from items union all select work, 'type', source, type from items".replace("select work,", "select distinct work,"))
def sites_say(spark: SparkSession, d: str) -> DataFrame:
    """For each field of a work the values that its member items' sites give."""
    own = Catalogue(spark, d).items()
    said = F.explode(F.create_map(F.lit("size"), F.col("size").cast("long").cast("string"), F.lit("title"), F.col("title"), F.lit("type"), F.col("type"))).alias("field", "value")
    return own.select("work", "source", said).select("work", "field", "source", "value").distinct()


@query("with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), c as (select m.vec_id as mark, v.vec_id as paragraph, list_cosine_similarity(m.v, v.v) as c from v, v m where m.vec_id % 50 = 0 and v.vec_id % 50 <> 0) select mark, paragraph, round(c, 6) as closeness from (select *, row_number() over (partition by mark order by c desc, paragraph) as k from c) where k <= 3")
def closest_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest paragraphs of each mark (every fiftieth), marks left out."""
    from ..operators import models

    own = Catalogue(spark, d).vectors()
    near = models.nearest(own.where("vec_id % 50 <> 0"), "vec_id", "embedding", own.where("vec_id % 50 = 0"), 3)
    return near.select(F.col("asked").alias("mark"), F.col("near").alias("paragraph"), F.round("cosine", 6).alias("closeness"))


@query("select p_name as name, count(*) as keys, min(p_partkey) as first, max(p_partkey) as last from part group by 1 having count(*) > 1")
def keys_by_names(spark: SparkSession, d: str) -> DataFrame:
    """Reverse look-up in a dictionary: names that stand for several keys."""
    return Catalogue(spark, d).items().groupBy(F.col("title").alias("name")).agg(F.count("*").alias("keys"), F.min("item_id").alias("first"), F.max("item_id").alias("last")).where("keys > 1")


@query("with s as (select lower(n_name) as synonym, n_name as value from nation union select left(n_name, 3), n_name from nation), clear as (select synonym, min(value) as value from s group by 1 having count(distinct value) = 1) select c_custkey as item_id, value from customer join nation on c_nationkey = n_nationkey join clear on synonym = case when c_custkey % 2 = 0 then lower(n_name) else left(n_name, 3) end")
def synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Site names resolved through synonyms, where a synonym stands for one value only."""
    c = Catalogue(spark, d)
    n = c.table("nation")
    s = n.select(F.lower("n_name").alias("synonym"), F.col("n_name").alias("value")).unionByName(n.select(F.substring("n_name", 1, 3).alias("synonym"), F.col("n_name").alias("value")))
    clear = s.groupBy("synonym").agg(F.min("value").alias("value"), F.count_distinct("value").alias("k")).where("k = 1").drop("k")
    said = c.table("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("item_id"), F.when(F.col("c_custkey") % 2 == 0, F.lower("n_name")).otherwise(F.substring("n_name", 1, 3)).alias("synonym"))
    return said.join(clear, "synonym").select("item_id", "value")


@query("select r_regionkey as universe, r_name as name, count(distinct n_nationkey) as entries, count(distinct c_custkey) as works, count(distinct c_mktsegment) as sites from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2")
def universes_list(spark: SparkSession, d: str) -> DataFrame:
    """Every universe with its entries, works and sites; counted by entry first, so that a large universe meets in a few rows."""
    c = Catalogue(spark, d)
    works = c.table("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("w"), F.collect_set("c_mktsegment").alias("s"))
    own = c.table("region").join(c.table("nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(works, "n_nationkey", "left")
    by = own.groupBy(F.col("r_regionkey").alias("universe"), F.col("r_name").alias("name")).agg(F.count("n_nationkey").alias("entries"), F.coalesce(F.sum("w"), F.lit(0)).alias("works"), F.flatten(F.collect_list("s")).alias("s"))
    return by.select("universe", "name", "entries", "works", F.size(F.array_distinct("s")).cast("long").alias("sites"))


@query("with v as (select label, generate_subscripts(embedding, 1) as k, unnest(embedding)::double as x from embeddings), m as (select label, k, avg(x) as x from v group by 1, 2), l as (select label, sqrt(sum(x * x)) as l from m group by 1), c as (select a.label as a, b.label as b, sum(a.x * b.x) as d from m a join m b on a.k = b.k and a.label <> b.label group by 1, 2) select a as universe, b as other, round(d / x.l / y.l, 5) as likeness from (select c.*, row_number() over (partition by a order by round(d / x.l / y.l, 9) desc, b) as p, x.l as xl from c join l x on x.label = a join l y on y.label = b) c join l x on x.label = a join l y on y.label = b where p <= 3")
def similar_universes(spark: SparkSession, d: str) -> DataFrame:
    """The three universes most like each, by the cosine of their mean vectors."""
    v = Catalogue(spark, d).vectors().select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    length = v.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    u = v.join(length, "label").select("label", "k", (F.col("x") / F.col("l")).alias("x"))
    other = u.select(F.col("label").alias("other"), "k", F.col("x").alias("y"))
    c = u.join(other, "k").where("label <> other").groupBy(F.col("label").alias("universe"), "other").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    place = F.row_number().over(Window.partitionBy("universe").orderBy(F.desc(F.round("c", 9)), "other"))
    return c.withColumn("p", place).where("p <= 3").select("universe", "other", F.round("c", 5).alias("likeness"))


@query("select s_suppkey as k, coalesce(case when s_suppkey % 7 = 0 then 'Renamed ' || s_suppkey end, case when s_suppkey % 2 = 0 then upper(s_name) end, s_name) as name from supplier")
def entry_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in the user's languages, the user's own name on top."""
    k = F.col("s_suppkey")
    return Catalogue(spark, d).table("supplier").select(k.alias("k"), F.coalesce(F.when(k % 7 == 0, F.concat(F.lit("Renamed "), k.cast("string"))), F.when(k % 2 == 0, F.upper("s_name")), F.col("s_name")).alias("name"))


@query(f"with {ITEMS}, t as (select w as tag, count(distinct item_id) as items, count(distinct source) as sites from (select item_id, source, unnest(words) as w from items) group by 1) select tag, items, sites, count(*) over () as total from t where contains(tag, 'e') and tag not in ('red') order by items desc, tag limit 5")
def tags_list(spark: SparkSession, d: str) -> DataFrame:
    """A page of tags whose name holds a text and that are not ignored, the most used first, with the total."""
    own = Catalogue(spark, d).items().select("item_id", "source", F.explode(F.array_distinct("words")).alias("tag")).where(F.col("tag").contains("e") & ~F.col("tag").isin("red"))
    by = own.groupBy("tag", "source").agg(F.count("*").alias("n")).groupBy("tag").agg(F.sum("n").alias("items"), F.count("*").alias("sites"))
    return listing.page(by, [F.desc("items"), F.asc("tag")], 0, 5)


@query(f"with {ITEMS} select item_id from items where list_has_any(words, ['red', 'bolt']) and item_id % 9 <> 0 union select item_id from items where item_id % 11 = 0")
def items_of_tags(spark: SparkSession, d: str) -> DataFrame:
    """Items that have a tag of a set: from their sites unless the user took it off, or by the user's word."""
    own = Catalogue(spark, d).items()
    return own.where((F.arrays_overlap("words", F.array(F.lit("red"), F.lit("bolt"))) & (F.col("item_id") % 9 != 0)) | (F.col("item_id") % 11 == 0)).select("item_id")


@query("""with k as (select page_id, regexp_extract(url, '/(\\d+)', 1) as n from pages), p as (select l_partkey as item_id, sum(round(l_extendedprice * 100)::bigint)::double / count(*) / 1000000 as score from lineitem group by 1)
select page_id, p_partkey as item_id, p_name as title, round(score, 6) as score from k join part on p_partkey = n::bigint left join p on p.item_id = p_partkey where n <> ''""")
def page_cards(spark: SparkSession, d: str) -> DataFrame:
    """Items that pages point at by the number in their URL, with predictions."""
    c = Catalogue(spark, d)
    keys = c.table("pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).try_cast("long").alias("item_id")).where("item_id is not null")
    return keys.join(c.items(), "item_id").join(c.predictions(), "item_id", "left").select("page_id", "item_id", "title", F.round("score", 6).alias("score"))


@query(f"with {ITEMS} select work, array_to_string(list_sort(list(item_id)), ',') as items, array_to_string(list_sort(list_distinct(flatten(list(words)))), ',') as words, max(size) as size from items where work > 100 and work <= 300 group by 1")
def works_read(spark: SparkSession, d: str) -> DataFrame:
    """All that is read of a portion of works, in one pass."""
    own = Catalogue(spark, d).items().where("work > 100 and work <= 300").groupBy("work")
    ids = F.transform(F.sort_array(F.collect_list("item_id")), lambda x: x.cast("string"))
    return own.agg(F.array_join(ids, ",").alias("items"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("words")))), ",").alias("words"), F.max("size").alias("size"))


@query("select l_suppkey as source, count(*) as changes, max(l_shipdate) as due from lineitem where l_shipdate > timestamp '2001-06-01' group by 1 having count(*) >= 3")
def facet_refits(spark: SparkSession, d: str) -> DataFrame:
    """Sources changed since their fit, planned once each at their newest change."""
    own = Catalogue(spark, d).table("lineitem").where(F.col("l_shipdate") > F.lit("2001-06-01").cast("timestamp_ntz"))
    return own.groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").alias("changes"), F.max("l_shipdate").alias("due")).where("changes >= 3")


@query(f"with {ITEMS}, w as (select work, max(size) as size, round(avg(price), 2) as price from items group by 1), k as (select work, max(size) as size, round(avg(case when item_id % 8 = 0 then price + 1 else price end), 2) as price from items group by 1) select w.work, w.price from w join k using (work) where w.price <> k.price")
def fields_of_works(spark: SparkSession, d: str) -> DataFrame:
    """Fields of works worked out anew; those that differ from what is kept are written."""
    own = Catalogue(spark, d).items()
    new = own.groupBy("work").agg(F.round(F.avg("price"), 2).alias("price"))
    kept = own.groupBy("work").agg(F.round(F.avg(F.when(F.col("item_id") % 8 == 0, F.col("price") + 1).otherwise(F.col("price"))), 2).alias("was"))
    return new.join(kept, "work").where("price <> was").select("work", "price")


@query(f"with {ITEMS}, o as (select p_partkey % 700 as work, case when p_partkey % 13 = 0 then p_partkey % 700 + 1000 else p_partkey % 700 end as moved, p_partkey as item_id from part), m as (select moved as work, item_id from o) select work, count(*) as items, min(item_id) as stands from m group by 1")
def taken_out(spark: SparkSession, d: str) -> DataFrame:
    """Items taken out of their works into works of their own; what stands for each work after."""
    own = Catalogue(spark, d).items().select("item_id", F.when(F.col("item_id") % 13 == 0, F.col("work") + 1000).otherwise(F.col("work")).alias("work"))
    return own.groupBy("work").agg(F.count("*").alias("items"), F.min("item_id").alias("stands"))


@query(f"with recursive {EDGES}, gone as (select 'S' || s_suppkey as node, 'S' || (s_suppkey - s_suppkey % 2) as into_ from supplier where s_suppkey % 2 = 1), e as (select coalesce(g.into_, child) as child, coalesce(h.into_, parent) as parent from edge left join gone g on g.node = child left join gone h on h.node = parent) select distinct child, parent from e where child <> parent")
def tags_merged(spark: SparkSession, d: str) -> DataFrame:
    """Links of a hierarchy after values were merged: rebound, once each, none to itself."""
    c = Catalogue(spark, d)
    key = F.col("s_suppkey")
    gone = c.table("supplier").where(key % 2 == 1).select(F.concat(F.lit("S"), key.cast("string")).alias("node"), F.concat(F.lit("S"), (key - key % 2).cast("string")).alias("into"))
    return graph.rebound(c.words_edges(), gone)


@query("select count(*) as edges, sum((p.s % 5 = n_regionkey)::int)::bigint as circles from (select s_suppkey as s, s_nationkey as n from supplier) p join nation on n_nationkey = p.n")
def links_refused(spark: SparkSession, d: str) -> DataFrame:
    """Links asked for from regions down to suppliers: those that would close a circle are counted and left out."""
    c = Catalogue(spark, d)
    closed = graph.closure(c.words_edges())
    asked = c.table("supplier").join(c.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("child"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("parent"), (F.col("s_suppkey") % 5 == F.col("n_regionkey")).alias("own"))
    bad = graph.closing_circles(asked, closed)
    return asked.agg(F.count("*").alias("edges")).crossJoin(F.broadcast(bad.where("own").agg(F.count("*").alias("circles"))))


@query(f"with recursive {EDGES}, near(node, step) as (select 'S3', 0 union select case when e.child = near.node then e.parent else e.child end, step + 1 from near join edge e on e.child = near.node or e.parent = near.node where step < 2) select node, min(step) as step from near group by 1")
def around_a_seed(spark: SparkSession, d: str) -> DataFrame:
    """What lies within two links of a value, in either direction, by its distance."""
    return graph.around(Catalogue(spark, d).words_edges(), ["S3"], 2)


@query("with w as (select l_orderkey as series, count(distinct l_partkey) as works, count(distinct l_suppkey % 3) as sites, bool_or(l_returnflag = 'R') as said from lineitem group by 1) select series, works from w where sites >= 2 and said and works >= 4")
def series_filter(spark: SparkSession, d: str) -> DataFrame:
    """Series of enough works and sites that the user said something about."""
    own = Catalogue(spark, d).table("lineitem").groupBy(F.col("l_orderkey").alias("series"))
    every = own.agg(F.count_distinct("l_partkey").alias("works"), F.count_distinct(F.col("l_suppkey") % 3).alias("sites"), F.bool_or(F.col("l_returnflag") == "R").alias("said"))
    return every.where("sites >= 2 and said and works >= 4").select("series", "works")


@query("with s as (select s_suppkey as a, s_nationkey as n, s_acctbal as v from supplier) select count(*) filter (where a % 5 = n % 5) as only_, count(*) filter (where a % 5 <> n % 5) as without_, count(*) as every_ from s")
def three_state_filter(spark: SparkSession, d: str) -> DataFrame:
    """A filter that shows only what has a relation, only what has it not, or both."""
    own = Catalogue(spark, d).table("supplier").withColumn("has", F.col("s_suppkey") % 5 == F.col("s_nationkey") % 5)
    n = lambda choice: F.count_if(listing.three_state(F.col("has"), choice))
    return own.agg(n("only").alias("only_"), n("without").alias("without_"), n("any").alias("every_"))


@query("select l_suppkey as author, count(distinct l_partkey) as works from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey = 3) or l_suppkey % 10 = 1 group by 1")
def author_offers(spark: SparkSession, d: str) -> DataFrame:
    """Offers of authors with an account on a site, or of a given few."""
    c = Catalogue(spark, d)
    here = c.table("supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("here"))
    own = c.table("lineitem").select("l_suppkey", "l_partkey").distinct().join(here, "l_suppkey", "left").where(F.col("here") | (F.col("l_suppkey") % 10 == 1))
    return own.groupBy(F.col("l_suppkey").alias("author")).agg(F.count("*").alias("works"))


@query("with w as (select distinct l_orderkey as work, l_suppkey as author from lineitem), n as (select work, work + 1 as other from (select distinct work from w)), p as (select a.author as a, b.author as b from n join w a on a.work = n.work join w b on b.work = n.other where a.author not in (select author from w x where x.work = n.other) and b.author not in (select author from w x where x.work = n.work)) select least(a, b) as a, greatest(a, b) as b, count(*) as pairs from p where a <> b group by 1, 2".replace("where a.author not in (select author from w x where x.work = n.other) and b.author not in (select author from w x where x.work = n.work)", "where not exists (select 1 from w x where x.work = n.other and x.author = a.author) and not exists (select 1 from w x where x.work = n.work and x.author = b.author)"))
def authors_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Authors of the two works of each pair, without those that both works share, counted together."""
    works = Catalogue(spark, d).table("lineitem").groupBy(F.col("l_orderkey").alias("work")).agg(F.collect_set("l_suppkey").alias("a"))
    both = works.join(works.select((F.col("work") - 1).alias("work"), F.col("a").alias("b")), "work")
    own = both.select(F.explode(F.array_except("a", "b")).alias("x"), F.array_except("b", "a").alias("b")).select("x", F.explode("b").alias("y"))
    return own.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("pairs"))


@query("with same as (select s_suppkey as a, s_suppkey + 10 as b from supplier where s_suppkey % 3 = 0 and s_suppkey + 10 in (select s_suppkey from supplier)), k as (select a, b from same union select b, a from same) select s_suppkey as author, coalesce(string_agg(b::varchar, ',' order by b), '') as kin from supplier left join k on a = s_suppkey group by 1")
def author_kin(spark: SparkSession, d: str) -> DataFrame:
    """Each author with those that are partly the same."""
    own = Catalogue(spark, d).table("supplier").select(F.col("s_suppkey").alias("a"))
    same = own.where("a % 3 = 0").select("a", (F.col("a") + 10).alias("b")).join(own.select(F.col("a").alias("b")), "b", "left_semi")
    both = same.unionByName(same.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("k"))
    return own.join(both, "a", "left").select(F.col("a").alias("author"), F.coalesce(F.array_join(F.transform("k", lambda x: x.cast("string")), ","), F.lit("")).alias("kin"))


@query(f"""with {ITEMS}, {RATINGS}, g as (select item_id, count(*) as times, max(grade) as best from ratings group by 1) select item_id, title, array_to_string(list_sort(words), '|') as facets, 'size=' || size::bigint || ' price=' || round(price * 100)::bigint as numbers, coalesce(times, 0) as times, best from items left join g using (item_id)""")
def item_details(spark: SparkSession, d: str) -> DataFrame:
    """Everything of each item in one row."""
    c = Catalogue(spark, d)
    g = c.ratings().groupBy("item_id").agg(F.count("*").alias("times"), F.max("grade").alias("best"))
    numbers = F.concat(F.lit("size="), F.col("size").cast("long").cast("string"), F.lit(" price="), F.round(F.col("price") * 100).cast("long").cast("string"))
    return c.items().join(g, "item_id", "left").select("item_id", "title", F.array_join(F.sort_array("words"), "|").alias("facets"), numbers.alias("numbers"), F.coalesce("times", F.lit(0)).alias("times"), "best")


@query(f"with {ITEMS} select item_id, case when item_id % 4 = 0 then 'ADDED extra' when item_id % 6 = 0 then 'REMOVED ' || type when item_id % 5 = 0 then 'CONFIRMED ' || type else 'SITE ' || type end as shown from items")
def shown_facets(spark: SparkSession, d: str) -> DataFrame:
    """The state of a value: added, taken off or confirmed by the user, or as the site gives it."""
    k = F.col("item_id")
    state = F.when(k % 4 == 0, F.lit("ADDED extra")).when(k % 6 == 0, F.concat(F.lit("REMOVED "), "type")).when(k % 5 == 0, F.concat(F.lit("CONFIRMED "), "type")).otherwise(F.concat(F.lit("SITE "), "type"))
    return Catalogue(spark, d).items().select("item_id", state.alias("shown"))


@query(f"with {ITEMS} select item_id, '{{\"size\":[' || size::bigint || '],\"source\":[\"' || source || '\"],\"words\":[' || array_to_string(list_transform(list_sort(list_distinct(words)), lambda x: '\"' || x || '\"'), ',') || ']}}' as facets from items")
def work_facets(spark: SparkSession, d: str) -> DataFrame:
    """An item's facets as one compact map."""
    own = Catalogue(spark, d).items()
    return own.select("item_id", F.to_json(F.struct(F.array(F.col("size").cast("long")).alias("size"), F.array("source").alias("source"), F.sort_array(F.array_distinct("words")).alias("words"))).alias("facets"))


@query(f"with {ITEMS} select 'type' as filter, count(distinct type)::double as low, count(*)::double as high from items union all select 'size', min(size), max(size) from items union all select 'price', min(price), max(price) from items")
def filters_of_a_type(spark: SparkSession, d: str) -> DataFrame:
    """Filters there are: of a facet its values and items, of a number its range; one pass."""
    own = Catalogue(spark, d).items().agg(F.count_distinct("type").cast("double").alias("t"), F.count("*").cast("double").alias("n"), *(f(c).alias(f"{c}{k}") for c in ("size", "price") for k, f in enumerate((F.min, F.max))))
    lines = F.array(*(F.struct(F.lit(n).alias("filter"), F.col(a).alias("low"), F.col(b).alias("high")) for n, a, b in (("type", "t", "n"), ("size", "size0", "size1"), ("price", "price0", "price1"))))
    return own.select(F.explode(lines).alias("f")).select("f.*")


@query("with e as (select *, row_number() over (partition by user_id order by ts, event_id) as k from events), last_ as (select user_id, max(case when event_type = 'purchase' then ts end) as vectors, max(case when event_type = 'signup' then ts end) as fields, max(case when event_type = 'click' then ts end) as predicted from e group by 1) select user_id, vectors, fields, predicted, coalesce(predicted < fields, true) as stale from last_")
def stage_times(spark: SparkSession, d: str) -> DataFrame:
    """When each stage was last done for a key, and whether a later one is behind an earlier."""
    own = Catalogue(spark, d).table("events").groupBy("user_id").agg(*(F.max(F.when(F.col("event_type") == t, F.col("ts"))).alias(n) for n, t in (("vectors", "purchase"), ("fields", "signup"), ("predicted", "click"))))
    return own.withColumn("stale", F.coalesce(F.col("predicted") < F.col("fields"), F.lit(True)))


@query("with e as (select event_id, user_id, ts, count(*) filter (where event_type = 'error') over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as fails, event_type from events), l as (select user_id, arg_max(event_type, epoch_us(ts)::hugeint * 10000000 + event_id) as last_, max(ts) as at_, max(fails) as fails from e group by 1) select user_id, fails, at_ + to_seconds(least(60 * pow(2, fails - 1), 86400)::bigint) as retry_at from l where last_ = 'error' order by retry_at, user_id limit 20")
def due_retries(spark: SparkSession, d: str) -> DataFrame:
    """What failed last and when it is tried again, twice as late each time, the earliest due first."""
    own = Catalogue(spark, d).table("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.max("ts").alias("at"), F.count_if(F.col("event_type") == "error").alias("fails"))
    wait = F.least(F.lit(60) * F.pow(F.lit(2.0), F.col("fails") - 1), F.lit(86_400.0)).cast("long")
    due = F.timestamp_micros(F.unix_micros(F.col("at").cast("timestamp")) + wait * 1_000_000).cast("timestamp_ntz")
    return own.where("last = 'error'").select("user_id", "fails", due.alias("retry_at")).orderBy("retry_at", "user_id").limit(20)


@query("select user_id, event_type as kind, min(ts) as since, count(*) as callers, min(event_id) as first from events group by 1, 2 having count(*) > 1")
def joined_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Callers that ask for a task that waits already share its one run."""
    own = Catalogue(spark, d).table("events").groupBy("user_id", F.col("event_type").alias("kind"))
    return own.agg(F.min("ts").alias("since"), F.count("*").alias("callers"), F.min("event_id").alias("first")).where("callers > 1")


@query("with c as (select user_id, min(event_id) as a, max(event_id) as b from events group by 1) select user_id, case when a % 3 = 0 then null when b % 2 = 0 then least(a, b - a) else a end as cursor from c")
def cursors_merged(spark: SparkSession, d: str) -> DataFrame:
    """Of two cursors of a task the earlier; a task that begins anew has none."""
    own = Catalogue(spark, d).table("events").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    second = F.when(F.col("b") % 2 == 0, F.col("b") - F.col("a")).otherwise(F.col("a"))
    first = F.when(F.col("a") % 3 != 0, F.col("a"))
    return own.select("user_id", F.when(first.isNotNull() & second.isNotNull(), F.least(first, second)).alias("cursor"))


@query("select event_type as job, count(*) as total, count(*) filter (where event_id % 3 <> 0) as done, round(count(*) filter (where event_id % 3 <> 0) / count(*)::double, 4) as share, max(event_id) filter (where event_id % 3 <> 0) as cursor from events group by 1")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far each crawl is: done of all, and the cursor from which it goes on."""
    done = F.col("event_id") % 3 != 0
    own = Catalogue(spark, d).table("events").groupBy(F.col("event_type").alias("job")).agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.max(F.when(done, F.col("event_id"))).alias("cursor"))
    return own.withColumn("share", F.round(F.col("done") / F.col("total"), 4))


@query("with m as (select s_suppkey as gone, s_suppkey - s_suppkey % 4 as into_ from supplier), p as (select l_suppkey as a, l_partkey % 100 as b, l_returnflag as said, l_shipdate as at_, l_orderkey * 10 + l_linenumber as id from lineitem), r as (select least(x.into_, y.into_) as a, greatest(x.into_, y.into_) as b, said, at_, id from p join m x on x.gone = a join m y on y.gone = b) select a, b, arg_max(said, epoch_us(at_)::hugeint * 10000000000 + id) as said from r where a <> b group by 1, 2")
def pair_words_moved(spark: SparkSession, d: str) -> DataFrame:
    """The user's words on pairs after merges: moved to what stands, the newest word of each pair kept, none on a pair of one."""
    c = Catalogue(spark, d)
    m = c.table("supplier").select(F.col("s_suppkey").alias("gone"), (F.col("s_suppkey") - F.col("s_suppkey") % 4).alias("into"))
    p = c.table("lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"), F.col("l_returnflag").alias("said"), F.struct(F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).alias("at"))
    moved = p.join(m.select(F.col("gone").alias("a"), F.col("into").alias("x")), "a").join(m.select(F.col("gone").alias("b"), F.col("into").alias("y")), "b").where("x <> y")
    return moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max_by("said", "at").alias("said"))


@query("select l_partkey as item_id, l_suppkey as value from lineitem group by 1, 2 having count(*) filter (where l_returnflag <> 'R') = 0")
def unused_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of works that no source gives any more: every line that gave one was taken back."""
    own = Catalogue(spark, d).table("lineitem").groupBy(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("value"))
    return own.agg(F.count_if(F.col("l_returnflag") != "R").alias("n")).where("n = 0").drop("n")


@query("with f as (select c_custkey as item_id, c_mktsegment || case when c_custkey % 2 = 1 then '' else ' ' || c_nationkey end as name from customer), b2 as (select c_mktsegment || ' ' || c_nationkey as name, min(c_nationkey % 5) as universe from customer group by 1 having count(distinct c_nationkey % 5) = 1) select item_id, f.name, universe, universe is null as created from f left join b2 using (name)")
def fandoms_bound(spark: SparkSession, d: str) -> DataFrame:
    """Site names bound to the one universe that names like them are bound to on any site; others are made anew."""
    own = Catalogue(spark, d).table("customer")
    named = F.concat("c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string"))
    bound = own.groupBy(named.alias("name")).agg(F.min(F.col("c_nationkey") % 5).alias("universe"), F.count_distinct(F.col("c_nationkey") % 5).alias("k")).where("k = 1").drop("k")
    said = own.select(F.col("c_custkey").alias("item_id"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment")).otherwise(named).alias("name"))
    return said.join(bound, "name", "left").select("item_id", "name", "universe", F.col("universe").isNull().alias("created"))


@query("with s as (select distinct l_orderkey as series, l_partkey as work from lineitem), d as (select p_partkey as a, p_partkey + 1 as b from part where p_partkey % 3 = 0) select distinct a, b from d join s x on x.work = a join s y on y.work = b and y.series = x.series")
def series_differences(spark: SparkSession, d: str) -> DataFrame:
    """Pairs told to differ that lie in one series, where the word goes without saying and is taken back."""
    c = Catalogue(spark, d)
    s = c.table("lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_partkey").alias("work")).distinct()
    told = c.items().where("item_id % 3 = 0").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    both = told.join(s.withColumnRenamed("work", "a"), "a").join(s.withColumnRenamed("work", "b"), ["b", "series"])
    return both.select("a", "b").distinct()
