"""Sources by contract, captured pages, keyed lookups, and tables that are rebuilt, replaced and marked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.tables import VersionedTable
from ..session import shared_folder
from ..sources import pages as html
from ..sources.catalogue import Catalogue
from ..sources.contracts import Registry, Source
from .lists import ITEMS, RATINGS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def registry() -> Registry:
    """The sources of the star schema: parts, orders and documents."""
    out = Registry()
    never = F.lit(None).cast("timestamp_ntz")
    out.add("source", "parts", Source("parts", "goods", lambda s, d: Catalogue(s, d).table("part").select(F.lit("parts").alias("source"), F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), never.alias("updated_at"))))
    out.add("source", "orders", Source("orders", "goods", lambda s, d: Catalogue(s, d).table("orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("updated_at")), modes=("all", "updates")))
    out.add("source", "documents", Source("documents", "texts", lambda s, d: Catalogue(s, d).table("documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("item_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), never.alias("updated_at")), pages=(r"^https?://[^/]+/(en|de)/", r"^https://m\.")))
    return out


EVERY = "every_ as (select 'parts' as source, p_partkey as item_id, p_name as title, null::timestamp as updated_at from part union all select 'orders', o_orderkey, o_orderpriority, o_orderdate from orders union all select 'documents', doc_id, split_part(text, chr(10), 1), null from documents)"


@query(f"with {EVERY} select source, count(*) as items, count(distinct title) as titles, count(updated_at) as dated from every_ group by 1")
def items_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """Items of every registered source through one contract."""
    return registry().items(spark, d).groupBy("source").agg(F.count("*").alias("items"), F.count_distinct("title").alias("titles"), F.count("updated_at").alias("dated"))


@query(f"with {EVERY} select source, count(*) as n, max(updated_at) as newest, sum(('0x' || left(md5(source || '/' || item_id || '/' || title), 8))::bigint)::bigint as print from every_ group by 1")
def source_markers(spark: SparkSession, d: str) -> DataFrame:
    """A mark of each source's whole content: if it is as it was, nothing has to be read again."""
    part = F.conv(F.substring(F.md5(F.concat_ws("/", "source", F.col("item_id").cast("string"), "title")), 1, 8), 16, 10).cast("long")
    return registry().items(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.max("updated_at").alias("newest"), F.sum(part).alias("print"))


@query(f"with {EVERY}, asked(source, item_id) as (select 'parts', p_partkey from part where p_size = 7 union all select 'orders', o_orderkey from orders where o_orderstatus = 'P') select e.source, e.item_id, e.title from every_ e join asked using (source, item_id)")
def items_by_tuple(spark: SparkSession, d: str) -> DataFrame:
    """Items of a list of (source, id) keys of several sources."""
    c = Catalogue(spark, d)
    asked = c.table("part").where("p_size = 7").select(F.lit("parts").alias("source"), F.col("p_partkey").alias("item_id")).unionByName(c.table("orders").where("o_orderstatus = 'P'").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("item_id")))
    return registry().items(spark, d).join(asked, ["source", "item_id"], "left_semi").select("source", "item_id", "title")


@query(f"with {ITEMS} select item_id, source, title from items where item_id in (3, 17, 42, 199)")
def items_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Point lookups by key; the keys reach the scan."""
    return Catalogue(spark, d).items().where(F.col("item_id").isin(3, 17, 42, 199)).select("item_id", "source", "title")


@query(f"with {ITEMS} select item_id, (dense_rank() over (order by source) - 1)::int as ordinal, price from items")
def doc_values(spark: SparkSession, d: str) -> DataFrame:
    """Columns of every item with its source as an ordinal in the order of names; sources are a dimension."""
    own = Catalogue(spark, d).items()
    names = own.select("source").distinct().withColumn("ordinal", (F.row_number().over(Window.orderBy("source")) - 1).cast("int"))
    return own.join(names, "source").select("item_id", "ordinal", "price")


@query("select conv_id, turn, sha1(text) as print from conversations")
def texts_in_key_order(spark: SparkSession, d: str) -> DataFrame:
    """Every text in order of its key: by ranges, sorted inside them."""
    own = Catalogue(spark, d).table("conversations").repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    return own.select("conv_id", "turn", F.sha1("text").alias("print"))


@query(r"""select 'documents' as source, page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages where regexp_matches(url, '^https?://[^/]+/(en|de)/') or regexp_matches(url, '^https://m\.')""")
def captured_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages pushed to a landing folder, read as a stream: those that a source's pattern fits are kept and parsed, once each."""
    schema = spark.read.parquet(f"{d}/pages.parquet").schema
    root = f"{shared_folder(spark)}/captured-{uuid.uuid4().hex}"
    landing = spark.readStream.schema(schema).parquet(f"{d}/pages.parquet*")
    kept = registry().captured(landing)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/pages/batch={number}")

    stream = kept.writeStream.option("checkpointLocation", f"{root}/log").foreachBatch(store).trigger(availableNow=True).start()
    stream.awaitTermination()
    pages = spark.read.parquet(f"{root}/pages").dropDuplicates(["page_id"])
    return html.parsed(pages).join(pages.select("page_id", "source"), "page_id").select("source", "page_id", "title")


@query(r"""with b as (select page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<!--.*?-->', '', 'g') as h from pages),
t as (select page_id, regexp_replace(regexp_replace(regexp_replace(h, '\s+', ' ', 'g'), '(?i)</?(p|div|br|li|ul|h1|h2|h3|article|nav|section|tr|table|footer|header)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') as x from b)
select page_id, sha1(trim(regexp_replace(regexp_replace(x, ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) as print from t""")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text of every page: block tags break lines, scripts and styles go, spaces are evened, one blank line at most."""
    return Catalogue(spark, d).table("pages").select("page_id", F.sha1(html.text_of(F.col("html"))).alias("print"))


# --- tables ---


def _table(spark: SparkSession, d: str, name: str) -> VersionedTable:
    """Suppliers with their balances, as a table of its own for each query."""
    out = VersionedTable(spark, f"{name}-{uuid.uuid4().hex}")
    out.rebuild(Catalogue(spark, d).table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("v")), "start")
    return out


@query("select s_suppkey as k, case when s_suppkey % 3 = 0 then 'new' else s_name end as name, case when s_suppkey % 3 = 0 then 0.0 else s_acctbal end as v from supplier where s_suppkey % 3 <> 0 or s_suppkey % 2 = 0")
def documents_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Rows replaced by key, then rows whose key is no longer there taken out, a version each."""
    table = _table(spark, d, "replace")
    own = table.read()
    table.replace(own.where("k % 3 = 0").select("k", F.lit("new").alias("name"), F.lit(0.0).alias("v")), ["k"])
    table.keep_only(own.where("k % 3 <> 0 or k % 2 = 0"), ["k"])
    table.sweep()
    return table.read()


@query("select s_suppkey as k, s_name as name, case when s_suppkey % 4 = 0 then null when s_suppkey % 4 = 1 then s_acctbal + 1 else s_acctbal end as v from supplier")
def values_set_in_place(spark: SparkSession, d: str) -> DataFrame:
    """One column of some rows takes new values, null among them; the rest of the table stays."""
    table = _table(spark, d, "set")
    table.set_values(table.read().where("k % 4 < 2").select("k", F.when(F.col("k") % 4 == 1, F.col("v") + 1).alias("v")), ["k"], "v")
    return table.read()


@query("select 3::bigint as version, '2024-03' as watermark, count(*) as n from supplier where s_suppkey % 2 = 1")
def commits_with_watermark(spark: SparkSession, d: str) -> DataFrame:
    """What stands after three commits: the version, the mark up to which it has read, and its rows."""
    table = _table(spark, d, "commit")
    table.rebuild(table.read().where("k % 2 = 0"), "2024-02")
    table.rebuild(_table(spark, d, "other").read().where("k % 2 = 1"), "2024-03")
    state = table.state()
    return table.read().agg(F.count("*").alias("n")).select(F.lit(state["version"]).cast("long").alias("version"), F.lit(state["watermark"]).alias("watermark"), "n")


@query(f"with {ITEMS} select value, round(ln((select count(*) from items)::double / n), 6) as rarity from (select unnest(words) as value, count(*) as n from items group by 1)")
def rarities_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The rarity of each value, worked out anew and put in place of the table that stood."""
    table = VersionedTable(spark, f"rarities-{uuid.uuid4().hex}")
    items = Catalogue(spark, d).items()
    n = items.groupBy().agg(F.count("*").alias("total"))
    seen = items.select(F.explode("words").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    table.rebuild(seen.select("value", F.lit(0.0).alias("rarity")))
    table.rebuild(seen.crossJoin(F.broadcast(n)).select("value", F.round(F.ln(F.col("total") / F.col("n")), 6).alias("rarity")))
    return table.read()


@query("select 'part' as name, count(*) as n from part union all select 'orders', count(*) from orders union all select 'lineitem', count(*) from lineitem union all select 'documents', count(*) from documents")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tables; counts come from the files' footers."""
    c, out = Catalogue(spark, d), None
    for name in ("part", "orders", "lineitem", "documents"):
        own = c.table(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"with {RATINGS}, portion as (select item_id, rating_id % 4 as turn, sum(grade)::bigint as s, sum(grade * grade)::bigint as q, count(*) as n from ratings group by 1, 2) select item_id, round(sum(s)::double / sum(n), 6) as mean, round(sqrt(greatest(sum(q)::double / sum(n) - pow(sum(s)::double / sum(n), 2), 0)), 6) as spread, sum(n)::bigint as n from portion group by 1")
def averages_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Means and spreads from sums that are kept after each portion and gone on with: a stopped walk costs one portion."""
    own = Catalogue(spark, d).ratings().select("item_id", "grade", (F.col("rating_id") % 4).alias("turn"))
    table = VersionedTable(spark, f"averages-{uuid.uuid4().hex}")
    for turn in range(4):
        part = own.where(F.col("turn") == turn).groupBy("item_id").agg(F.sum("grade").alias("s"), F.sum(F.col("grade") * F.col("grade")).alias("q"), F.count("*").alias("n"))
        kept = part if turn == 0 else table.read().unionByName(part).groupBy("item_id").agg(*(F.sum(c).alias(c) for c in "sqn"))
        table.rebuild(kept, str(turn))
    mean = F.col("s") / F.col("n")
    return table.read().select("item_id", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), 6).alias("spread"), "n")


@query(f"with {ITEMS} select item_id, 'item=' || item_id || ' title=' || title || ' words=[' || array_to_string(words, ', ') || '] size=' || size::bigint || ' raw=<' || strlen(title) || ' bytes>' as shown from items")
def value_cells(spark: SparkSession, d: str) -> DataFrame:
    """Values as a table shows them: arrays joined, bytes by their number."""
    return Catalogue(spark, d).items().select("item_id", F.concat(F.lit("item="), F.col("item_id").cast("string"), F.lit(" title="), "title", F.lit(" words=["), F.array_join("words", ", "), F.lit("] size="), F.col("size").cast("long").cast("string"), F.lit(" raw=<"), F.octet_length(F.encode("title", "UTF-8")).cast("string"), F.lit(" bytes>")).alias("shown"))
