"""Offers on the hierarchy of tags by a catalogue of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graph, learnt, offers
from ..sources.catalogue import Catalogue

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Entries stand in a tree of this fan-out by their numbers; every entry but those whose number this divides has a tag.
FAN_OUT, UNBOUND = 3, 4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def entries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(child, parent) of entries, one a supplier, and the tags (tag, entry) that are bound to them."""
    k = Catalogue(spark, d).table("supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    links = k.where(f"k >= {FAN_OUT}").select(F.concat(F.lit("E"), F.col("k").cast("string")).alias("child"), F.concat(F.lit("E"), F.expr(f"k div {FAN_OUT}").cast("string")).alias("parent"))
    bound = k.where(f"k % {UNBOUND} <> 0").select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("tag"), F.concat(F.lit("E"), F.col("k").cast("string")).alias("entry"))
    return links, bound


@query(f"""with recursive up as (select s_suppkey as k, s_suppkey // {FAN_OUT} as above, 1 as levels from supplier where s_suppkey >= {FAN_OUT} union all select k, above // {FAN_OUT}, levels + 1 from up where above >= {FAN_OUT}),
n as (select k, min_by(above, levels) as above, min(levels) as levels from up where k % {UNBOUND} <> 0 and above % {UNBOUND} <> 0 group by 1), w as (select distinct l_suppkey as k, l_orderkey as o from lineitem)
select 'S' || n.k as child, 'S' || n.above as parent, levels::bigint as levels, (select count(*) from w where w.k = n.k and not exists (select 1 from w x where x.k = n.above and x.o = w.o)) as changed from n""")
def link_offers(spark: SparkSession, d: str) -> DataFrame:
    """A tag under the nearest tag above it by their entries, over how many levels, and how many works that would change."""
    c = Catalogue(spark, d)
    links, bound = entries(spark, d)
    works = c.table("lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("tag"), F.col("l_orderkey").alias("work")).distinct()
    own = offers.links_offered(bound, offers.entries_above(links), graph.closure(c.words_edges()))
    return offers.works_changed(learnt.kept(own, "links"), works).select("child", "parent", F.col("levels").cast("long").alias("levels"), "changed")


@query()
def new_parent_offers(spark: SparkSession, d: str) -> DataFrame:
    """Entries without a tag over several tags, as new tags, the nearest first; the third entry was said to be too general."""
    links, bound = entries(spark, d)
    refused = spark.createDataFrame([("E3",)], "entry string")
    return offers.new_parents(bound, offers.entries_above(links), refused)
