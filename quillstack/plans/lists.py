"""List, overlay, write and graph queries over the star schema, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import graph, listing, overlay, writes
from ..sources.catalogue import TYPES, Catalogue

QUERIES: dict = {}
SQL: dict[str, str] = {}

ITEMS = """items as (
    select p_partkey as item_id, p_name as title, p_brand as source, string_split(p_name, ' ') as words, p_type as type,
           p_size::double as size, p_retailprice as price, p_partkey % 700 as work from part)"""
RATINGS = """ratings as (
    select l_partkey as item_id, l_partkey % 700 as work, l_linenumber as version, (l_quantity::bigint % 5 + 1)::int as grade,
           l_shipdate as rated_at, l_orderkey as rating_id from lineitem)"""
PREDICTIONS = """predictions as (
    select l_partkey as item_id, sum(round(l_extendedprice * 100)::bigint)::double / count(*) / 1000000 as score,
           sum((l_returnflag <> 'R')::int)::double / count(*) as chance from lineitem group by 1)"""
ROWS = f"""{ITEMS}, {RATINGS}, {PREDICTIONS}, latest as (
    select item_id, grade, rated_at from (select *, row_number() over (partition by item_id order by rated_at desc, rating_id desc, version desc) as k
    from ratings where version = 7) where k = 1), rows_ as (
    select i.*, p.score, p.chance, g.grade, g.rated_at,
           case when p.chance is null then p.score else greatest(p.score, 0) * p.chance end as expected
    from items i left join predictions p using (item_id) left join latest g using (item_id))"""


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).rows().withColumn("expected", listing.expected(F.col("score"), F.col("chance")))


THREE = lambda x: f"case when {x} = 0 then 0.0 else round({x} * pow(10.0, 2 - floor(log10(abs({x}))))) / pow(10.0, 2 - floor(log10(abs({x})))) end"


@query(f"""with {ROWS}, passing as (
    select * from rows_ where list_has_any(words, ['small', 'red', 'blue']) and source not in ('Brand#3', 'Brand#7') and price between 900 and 1500
), stands as (select * from (select *, row_number() over (partition by work order by size desc, item_id) as k from passing) where k = 1),
total as (select count(*) as total from stands)
select item_id, work, title, source, {THREE('expected')} as expected, total from stands, total
order by expected desc nulls last, rated_at desc nulls last, item_id limit 20 offset 20""")
def list_page_score(spark: SparkSession, d: str) -> DataFrame:
    """The second page of works that have a word, not of hidden sources, in a price range, best first by the digits that are kept."""
    own = rows(spark, d).where(listing.facet_passes(F.col("words"), shown=["small", "red", "blue"]) & ~F.col("source").isin("Brand#3", "Brand#7") & listing.number_within(F.col("price"), 900, 1500))
    stands = listing.collapse(own, "work", F.desc("size"), F.asc("item_id"))
    kept = stands.select("item_id", "work", "title", "source", listing.kept_digits(F.col("expected")).alias("expected"), "rated_at")
    return listing.page(kept, listing.ordered("score"), 20, 20).drop("rated_at")


@query(f"with {ROWS} select source, count(*) as n, count(*) filter (where grade >= 4) as liked from rows_ where grade is not null group by source")
def list_view_rated(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).where("grade is not null").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("grade") >= 4).alias("liked"))


@query(f"with {ROWS} select item_id, title, source from rows_ where grade is null and source in ('Brand#1', 'Brand#2')")
def list_view_unrated(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).where(F.col("grade").isNull() & F.col("source").isin("Brand#1", "Brand#2")).select("item_id", "title", "source")


def _facet(name: str, sql: str, **choice) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        own = Catalogue(spark, d).items()
        # every seventh item has no words, so that the choice's rule for those shows
        values = F.when(F.col("item_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("words"))
        return own.withColumn("values", values).where(listing.facet_passes(F.col("values"), **choice)).select("item_id", "source", F.array_join("values", " ").alias("joined"))

    f.__name__ = name
    QUERIES[name] = f
    SQL[name] = f"with {ITEMS}, v as (select item_id, source, case when item_id % 7 = 0 then []::varchar[] else words end as vals from items) select item_id, source, array_to_string(vals, ' ') as joined from v where {sql}"


_facet("list_facet_shown", "len(vals) = 0 or list_has_any(vals, ['small', 'ring'])", shown=["small", "ring"])
_facet("list_facet_hidden", "len(vals) = 0 or len(list_filter(vals, lambda x: x not in ('small', 'ring'))) > 0", hidden=["small", "ring"])
_facet("list_facet_range", "len(vals) = 0 or list_has_any(vals, ['red', 'blue'])", within=["red", "blue"])
_facet("list_without_hidden", "len(vals) > 0 and list_has_any(vals, ['small', 'ring'])", shown=["small", "ring"], without_hidden=True)


@query(f"with {ITEMS} select item_id, source, type from items where type in ('SMALL', 'MEDIUM', 'STANDARD') or source not in ('Brand#1', 'Brand#2', 'Brand#3')")
def list_filter_missing_source_passes(spark: SparkSession, d: str) -> DataFrame:
    steps = listing.between(TYPES, "SMALL", "STANDARD")
    return Catalogue(spark, d).items().where(listing.only_of(["Brand#1", "Brand#2", "Brand#3"], F.col("type").isin(*steps))).select("item_id", "source", "type")


@query(f"with {ITEMS} select item_id, size, price from items where size >= 40 and price <= 1800")
def list_number_range_open(spark: SparkSession, d: str) -> DataFrame:
    name, low, high = listing.parse_range("size=40..")
    return Catalogue(spark, d).items().where(listing.number_within(F.col(name), low, high) & listing.number_within(F.col("price"), None, 1800)).select("item_id", "size", "price")


@query(f"with {ROWS} select item_id, grade, size from (select *, case when item_id % 5 = 0 then null else size end as s from rows_) order by s desc nulls last, rated_at desc nulls last, item_id limit 50 offset 1500")
def list_order_number_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d).withColumns({"whole": F.col("size"), "size": F.when(F.col("item_id") % 5 == 0, None).otherwise(F.col("size"))})
    return own.orderBy(*listing.ordered("number")).offset(1500).limit(50).select("item_id", "grade", F.col("whole").alias("size"))


@query(f"""with {ROWS}, placed as (select *, case when grade is null then null when grade = 1 then greatest(score - grade * 2.0, 0) when grade = 5 then greatest(grade * 2.0 - score, 0) else abs(score - grade * 2.0) end as surprise from rows_)
select item_id, grade, round(surprise, 6) as surprise from placed order by placed.surprise desc nulls last, rated_at desc nulls last, item_id limit 40""")
def list_order_surprise(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d).withColumn("surprise", listing.surprise(F.col("grade"), F.col("grade") * 2.0, F.col("score")))
    return own.orderBy(*listing.ordered("surprise")).limit(40).select("item_id", "grade", F.round("surprise", 6).alias("surprise"))


@query(f"with {ROWS} select item_id, price from rows_ where price < 1200.5 or (price = 1200.5 and item_id > 300) order by price desc, item_id limit 25")
def list_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return listing.after_cursor(Catalogue(spark, d).items(), "price", "item_id", (1200.5, 300), 25).select("item_id", "price")


@query(f"with {ITEMS}, v as (select item_id, unnest(words) as value from items) select value, count(distinct item_id) as n from v group by value union all select '*', count(*) from items")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return listing.facet_counts(Catalogue(spark, d).items(), "words")


@query(f"with {ITEMS} select item_id, title from items where list_has_any(words, ['small', 'large', 'red']) and list_has_any(words, ['ring', 'widget'])")
def selection_and_of_or(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).items().where(listing.selection(F.col("words"), [["small", "large", "red"], ["ring", "widget"]])).select("item_id", "title")


@query("select distinct l_partkey as item_id from lineitem where l_shipdate > timestamp '2000-06-01'")
def items_of_changed_since(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).ratings().where(F.col("rated_at") > F.lit("2000-06-01").cast("timestamp_ntz")).select("item_id").distinct()


@query(f"with {ITEMS}, {RATINGS} select r.item_id, r.version, max(r.grade) as grade, count(*) as n from ratings r join items i on r.item_id = i.item_id and r.version = 1 + i.size::bigint % 7 group by 1, 2")
def join_current_version_rating(spark: SparkSession, d: str) -> DataFrame:
    c = Catalogue(spark, d)
    current = c.items().select("item_id", (F.col("size").cast("long") % 7 + 1).cast("int").alias("version"))
    return c.ratings().join(current, ["item_id", "version"]).groupBy("item_id", "version").agg(F.max("grade").alias("grade"), F.count("*").alias("n"))


@query(f"""with {RATINGS} select a.item_id, a.rating_id, a.version, arg_max(b.grade, (epoch_us(b.rated_at)::hugeint * 1000000000 + b.rating_id) * 10 + b.version)::int as previous
from ratings a join ratings b on a.item_id = b.item_id and b.version <> a.version and b.rated_at < a.rated_at group by 1, 2, 3""")
def previous_grade_as_of(spark: SparkSession, d: str) -> DataFrame:
    """For each rating the latest earlier one of another version of the item, in one pass over each item's ratings."""
    own = Catalogue(spark, d).ratings().withColumn("at", F.unix_micros(F.col("rated_at").cast("timestamp")))
    line = Window.partitionBy("item_id").orderBy("at", "rating_id", "version")
    # of each row the last before its run of equal versions: what stands for it if the newest earlier row has the asked version
    whole = F.struct("at", "rating_id", "version", "grade")
    own = own.withColumn("was", F.lag(whole).over(line)).withColumn("other", F.when(F.col("was.version") != F.col("version"), F.col("was")))
    own = own.withColumn("other", F.last("other", True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy("item_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("e", F.max(F.struct(whole.alias("row"), "other")).over(earlier))
    previous = F.when(F.col("e.row.version") != F.col("version"), F.col("e.row")).otherwise(F.col("e.other"))
    return own.select("item_id", "rating_id", "version", previous.alias("p")).where("p is not null").groupBy("item_id", "rating_id", "version").agg(F.max("p").alias("p")).select("item_id", "rating_id", "version", F.col("p.grade").alias("previous"))


@query(f"""with {RATINGS}, k as (select *, row_number() over (partition by item_id order by rated_at desc, rating_id desc, version desc) as k from ratings where version <> 1 + item_id % 7)
select item_id, grade as previous from k where k = 1""")
def previous_grade_current_version(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).ratings().where(F.col("version") != F.col("item_id") % 7 + 1)
    return own.groupBy("item_id").agg(F.max_by("grade", F.struct("rated_at", "rating_id", "version")).alias("previous"))


@query("select p_partkey as item_id, p_brand as source from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R')")
def anti_unbound(spark: SparkSession, d: str) -> DataFrame:
    c = Catalogue(spark, d)
    return c.table("part").join(c.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("source"))


@query("select o_orderkey as order_id, o_custkey as who from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY' and c_acctbal > 5000)")
def semi_in_set(spark: SparkSession, d: str) -> DataFrame:
    c = Catalogue(spark, d)
    chosen = c.table("customer").where("c_mktsegment = 'MACHINERY' and c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return c.table("orders").join(chosen, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("who"))


@query("select n_nationkey as nation, count(s_suppkey) as members from nation left join supplier on s_nationkey = n_nationkey group by 1 having count(s_suppkey) < 4")
def left_small_groups(spark: SparkSession, d: str) -> DataFrame:
    c = Catalogue(spark, d)
    return c.table("nation").join(c.table("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("nation")).agg(F.count("s_suppkey").alias("members")).where("members < 4")


@query(f"with {RATINGS} select work, count(distinct item_id) as items from ratings group by work having count(distinct item_id) > 1")
def works_of_several_items(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).ratings().groupBy("work").agg(F.count_distinct("item_id").alias("items")).where("items > 1")


@query(f"""with {ROWS}, v as (select work, unnest(words) as tag, grade from rows_)
select tag, count(distinct work) as works, count(distinct case when grade is not null then work end) as graded,
       count(distinct case when grade > 3 then work end) as liked, count(distinct case when grade < 2 then work end) as rejected from v group by tag""")
def tag_statistics(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d).select("work", "grade", F.explode("words").alias("tag"))
    # one row a tag and work first, so that no distinct aggregate holds a hot tag's works in one state
    by_work = own.groupBy("tag", "work").agg(F.max("grade").alias("best"), F.min("grade").alias("worst"))
    return by_work.groupBy("tag").agg(F.count("*").alias("works"), F.count("best").alias("graded"), F.count_if(F.col("best") > 3).alias("liked"), F.count_if(F.col("worst") < 2).alias("rejected"))


@query(f"with {ROWS} select item_id, grade from rows_ where grade is not null")
def latest_grade_per_item(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).latest_grades().select("item_id", "grade")


@query(f"with {ROWS} select grade, count(*) as n from (select work, max(grade) as grade from rows_ where grade is not null group by work) group by grade")
def grade_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).where("grade is not null").groupBy("work").agg(F.max("grade").alias("grade")).groupBy("grade").agg(F.count("*").alias("n"))


@query(f"""with {ITEMS}, said as (select item_id, case when item_id % 4 = 0 then ['extra'] else [] end as added, case when item_id % 6 = 0 then [words[1]] else [] end as removed from items)
select item_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(i.words, s.added)), lambda x: not list_contains(s.removed, x))), ',') as vals from items i join said s using (item_id)""")
def overlay_corrections(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).items()
    none = F.array().cast("array<string>")
    added = F.when(F.col("item_id") % 4 == 0, F.array(F.lit("extra"))).otherwise(none)
    removed = F.when(F.col("item_id") % 6 == 0, F.slice("words", 1, 1)).otherwise(none)
    return own.select("item_id", F.array_join(F.sort_array(overlay.facet_overlay(F.col("words"), added, removed)), ",").alias("vals"))


@query("select p_partkey as item_id, case when p_partkey % 4 = 0 then 'SAID' when p_partkey % 6 = 0 then '' else p_type end as vals from part")
def overlay_single(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    added = F.when(F.col("item_id") % 4 == 0, F.array(F.lit("SAID"))).otherwise(none)
    removed = F.when(F.col("item_id") % 6 == 0, F.array("type")).otherwise(none)
    return Catalogue(spark, d).items().select("item_id", F.array_join(overlay.facet_overlay(F.array("type"), added, removed, single=True), ",").alias("vals"))


@query("select p_partkey as item_id, case when p_partkey % 3 = 0 then 12.5 else p_size::double end as size, case when p_partkey % 5 = 0 then null when p_partkey % 7 = 0 then 'own title' else p_name end as title from part")
def number_override(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("item_id") % 3 == 0, "12,5").when(F.col("item_id") % 3 == 1, "not a number")
    title = F.when(F.col("item_id") % 5 == 0, "  ").when(F.col("item_id") % 7 == 0, "own title")
    return Catalogue(spark, d).items().select("item_id", overlay.number_override(F.col("size"), said).alias("size"), overlay.text_override(F.col("title"), title).alias("title"))


@query(f"""with {ITEMS}, bind as (select source, value, min(tag) as tag from (select distinct 'Brand#' || (s.n % 25 + 1) as source, w.value, upper(left(w.value, 1)) || (s.n % 25 + 1) % 3 as tag
from range(25) s(n), (select distinct unnest(words) as value from items) w) group by 1, 2 having count(distinct tag) = 1)
select i.item_id, b.tag from (select item_id, source, unnest(words) as value from items) i join bind b using (source, value)""")
def draft_values(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).items().select("item_id", "source", F.explode("words").alias("value"))
    number = F.regexp_extract("source", r"\d+", 0).cast("int")
    bindings = own.select("source", "value").distinct().select("source", "value", F.concat(F.upper(F.substring("value", 1, 1)), (number % 3).cast("string")).alias("tag"))
    return overlay.drafts(own, bindings).select("item_id", "tag")


# --- writes ---


@query("""with o as (select o_custkey as who, o_orderstatus as state, o_totalprice as paid, o_orderdate as seen, o_orderkey as id from orders),
k as (select *, row_number() over (partition by who order by seen desc, id desc) as k from o) select who, state, paid from k where k = 1""")
def dedupe_upsert(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("orders").select(F.col("o_custkey").alias("who"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("paid"), F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id")).alias("at"))
    return writes.upsert(own.where("at.id % 2 = 0"), own.where("at.id % 2 = 1"), ["who"], "at").drop("at")


@query("select s_suppkey as k, s_name as name, s_acctbal as v from supplier where s_suppkey % 2 = 0 union all select s_suppkey, 'new', 0.0 from supplier where s_suppkey % 2 = 1 and s_suppkey % 3 = 0")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("v"))
    new = own.where("k % 3 = 0").select("k", F.lit("new").alias("name"), F.lit(0.0).alias("v"))
    return writes.insert_ignore(own.where("k % 2 = 0"), new, ["k"])


@query("select s_suppkey as k, case when s_suppkey % 3 = 0 then -1.0 else s_acctbal end as v from supplier where s_suppkey % 2 = 0 or s_suppkey % 3 = 0")
def merge_not_matched(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return writes.merge_into(own.where("k % 2 = 0"), own.where("k % 3 = 0").select("k", F.lit(-1.0).alias("v")), ["k"])


@query(f"with {ITEMS} select item_id, case when item_id % 4 = 0 then 'only' else v end as value from (select item_id, unnest(case when item_id % 4 = 0 then ['x'] else words end) as v from items)")
def replace_facet_values(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).items().select("item_id", F.explode("words").alias("value"))
    new = own.where("item_id % 4 = 0").select("item_id").distinct().withColumn("value", F.lit("only"))
    return writes.replace_values(own, new, ["item_id"])


@query("select p_partkey as item_id, case when p_partkey % 3 = 0 then 1.0 else p_retailprice end as v from part where p_partkey % 5 <> 0")
def number_set_null_deletes(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).items().select("item_id", F.col("price").alias("v"))
    new = own.where("item_id % 5 = 0 or item_id % 3 = 0").select("item_id", F.when(F.col("item_id") % 5 == 0, None).otherwise(F.lit(1.0)).alias("v"))
    return writes.set_or_delete(own, new, ["item_id"], "v")


@query("select conv_id, turn, role, turn % 3 = 2 as gone from conversations")
def parts_taken_off(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("conversations").select("conv_id", "turn", "role", F.lit(None).cast("timestamp_ntz").alias("taken_off_at"))
    out = writes.save_parts(own, own.where("turn % 3 <> 2").drop("taken_off_at"), ["conv_id", "turn"], F.lit("2024-02-01").cast("timestamp_ntz"), whole=True)
    return out.select("conv_id", "turn", "role", F.col("taken_off_at").isNotNull().alias("gone"))


@query("select event_type as kind, event_id, ts from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as k from events) where k <= 5")
def retention_last_n(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("events").select(F.col("event_type").alias("kind"), "event_id", "ts")
    return writes.last_of_each(own, ["kind"], [F.desc("ts"), F.desc("event_id")], 5)


@query("select s_suppkey as k, s_acctbal + case when s_suppkey % 10 = 0 then 1 else 0 end as v from supplier where s_suppkey % 10 = 0 or s_suppkey >= 90")
def fingerprint_changed(spark: SparkSession, d: str) -> DataFrame:
    new = Catalogue(spark, d).table("supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") + F.when(F.col("s_suppkey") % 10 == 0, 1).otherwise(0)).alias("v"))
    old = Catalogue(spark, d).table("supplier").where("s_suppkey < 90").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return writes.changed_rows(old, new, ["k"])


@query("select event_type as kind, round(avg(value), 6) as mean from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as k from events) where k <= 3 group by 1")
def mean_of_last_three(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("events")
    return writes.last_of_each(own, ["event_type"], [F.desc("ts"), F.desc("event_id")], 3).groupBy(F.col("event_type").alias("kind")).agg(F.round(F.avg("value"), 6).alias("mean"))


# --- graphs ---

EDGES = """edge(child, parent) as (select 'S' || s_suppkey, 'N' || s_nationkey from supplier union select 'S' || s_suppkey, 'R' || s_suppkey % 5 from supplier
    union select 'N' || n_nationkey, 'R' || n_regionkey from nation union select 'R' || r_regionkey, 'W' from region),
up(node, ancestor, depth) as (select child, parent, 1 from edge union select up.node, e.parent, up.depth + 1 from up join edge e on up.ancestor = e.child),
closed as (select node, ancestor, min(depth) as depth from up group by 1, 2)"""


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the tag of their nation."""
    return Catalogue(spark, d).table("customer").select(F.col("c_custkey").alias("item"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("value"))


@query(f"with recursive {EDGES} select node, ancestor, depth from closed")
def hierarchy_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(Catalogue(spark, d).words_edges())


@query(f"""with recursive {EDGES}, tagged as (select c_custkey as item, 'N' || c_nationkey as value from customer),
every as (select item, value from tagged union select item, ancestor from tagged join closed on value = node)
select item, value from every where not (item % 2 = 0 and value = 'R1')""")
def close_tags(spark: SparkSession, d: str) -> DataFrame:
    own = _tagged(spark, d)
    rejected = own.where("item % 2 = 0").select("item", F.lit("R1").alias("value"))
    return graph.close_values(own, graph.closure(Catalogue(spark, d).words_edges()), rejected)


@query(f"""with recursive {EDGES}, tagged as (select c_custkey as item, 'N' || c_nationkey as value from customer),
no as (select distinct item, 'R1' as value from tagged where item % 3 = 0),
every as (select item, value, 2 as r, true as added from tagged union all select item, ancestor, 1, true from tagged join closed on value = node
union all select item, value, 4, false from no union all select item, node, 3, false from no join closed on value = ancestor)
select item, value, arg_max(added, r) as added from every group by item, value""")
def expand_answers(spark: SparkSession, d: str) -> DataFrame:
    own = _tagged(spark, d)
    said = own.withColumn("added", F.lit(True)).unionByName(own.where("item % 3 = 0").select("item", F.lit("R1").alias("value"), F.lit(False).alias("added")).distinct())
    return graph.expand_answers(said, graph.closure(Catalogue(spark, d).words_edges()))


@query(f"with recursive {EDGES} select distinct e.child, e.parent from edge e join edge o on o.child = e.child and o.parent <> e.parent join closed c on c.node = o.parent and c.ancestor = e.parent")
def redundant_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = Catalogue(spark, d).words_edges()
    return graph.redundant_edges(edges, graph.closure(edges))


@query(f"""with recursive {EDGES}, par as (select child, parent, count(*) over (partition by child) as n from edge), own as (select child as node, parent as via, parent as m, 0 as depth from par where n > 1 union all select child, parent, c.ancestor, c.depth from par join closed c on c.node = par.parent where n > 1),
both_ as (select x.node, x.via as a, y.via as b, x.m, greatest(x.depth, y.depth) as reach, x.depth + y.depth as s from own x join own y on x.node = y.node and x.m = y.m and x.via < y.via)
select node, a, b, m as meeting, reach from (select *, row_number() over (partition by node, a, b order by reach, s, m) as k from both_) where k = 1""")
def meeting_point(spark: SparkSession, d: str) -> DataFrame:
    edges = Catalogue(spark, d).words_edges()
    return graph.meeting_points(edges, graph.closure(edges))


@query()
def components_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Orders and parts that lines tie together, all of them; recursive SQL would list every pair of a component."""
    own = Catalogue(spark, d).table("lineitem")
    return graph.components(own.select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")))


@query()
def series_components(spark: SparkSession, d: str) -> DataFrame:
    return components_of_pairs(spark, d).groupBy("component").agg(F.count("*").alias("members"))


@query("""with recursive m(gone, into_) as (select p_partkey, p_partkey - 1 - p_partkey % 3 from part where p_partkey % 50 <> 0 and p_partkey - 1 - p_partkey % 3 >= p_partkey // 50 * 50),
up(node, anc, depth) as (select gone, into_, 1 from m union all select up.node, m.into_, depth + 1 from up join m on up.anc = m.gone)
select node as gone, arg_max(anc, depth) as "into" from up group by node""")
def merge_chains(spark: SparkSession, d: str) -> DataFrame:
    """Parts merged into earlier ones of their fifty, step by step: where each chain ends."""
    into = F.col("p_partkey") - 1 - F.col("p_partkey") % 3
    merges = Catalogue(spark, d).table("part").select(F.col("p_partkey").alias("gone"), into.alias("into")).where("gone % 50 <> 0 and into >= floor(gone / 50) * 50")
    return graph.merged_into(merges)


@query()
def series_topological(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("lineitem")
    return graph.series_order(own.groupBy(F.col("l_orderkey").alias("series"), F.col("l_partkey").alias("work")).agg(F.min(F.col("l_suppkey") % 3).alias("site"), F.min("l_linenumber").alias("number")))
