"""Passages of texts: quotes around names, and tags by what paragraphs are like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numbers as nm, text as tx
from ..operators import learnt, mixed, quotes
from ..sources.catalogue import Catalogue

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NAMES = ["license", "with", "und"]
PLACES = " union all ".join(
    f"select key, paragraph, body, '{n}' as name, (sum(length(piece)) over (partition by key, paragraph order by k) + (k - 1) * {len(n)})::int as first, k, len(pieces) as n_pieces from (select *, unnest(pieces) as piece, generate_subscripts(pieces, 1) as k from (select *, string_split_regex(body, '(?i){n}') as pieces from line))"
    for n in NAMES
)


@query(f"""with l as (select doc_id as key, string_split(text, chr(10)) as t from documents), line as (select * from (select key, generate_subscripts(t, 1) as paragraph, unnest(t) as body from l) where body <> ''),
raw as ({PLACES}), places as (select key, paragraph, body, name, first, first + length(name) - 1 as last from raw where k < n_pieces),
m as (select *, coalesce((first - lag(last) over (partition by key, paragraph order by first, last, name) > 320 and length(body) > 480)::int, 0) as opens from places),
i as (select *, sum(opens) over (partition by key, paragraph order by first, last, name) as island from m),
g as (select key, paragraph, island, any_value(body) as body, min(first) as a, last(last order by first, last, name) as b, list({{'f': first, 'l': last}} order by first, last, name) as names from i group by 1, 2, 3),
s as (select *, greatest(a - 160, 0) as s0, least(b + 161, length(body)) as e0 from g),
t as (select *, strpos(substr(body, s0 + 1), ' ') + s0 - 1 as sp, e0 - strpos(reverse(substr(body, 1, e0 + 1)), ' ') + 1 as bk from s),
c as (select *, case when length(body) <= 480 then 0 when s0 > 0 and sp >= s0 and sp < a then sp + 1 else s0 end as st, case when length(body) <= 480 then length(body) when e0 < length(body) and bk <= e0 and bk > b then bk else e0 end as en from t)
select key, paragraph, case when st > 0 then '… ' else '' end || substr(body, st + 1, en - st) || case when en < length(body) then ' …' else '' end as quote,
array_to_string(list_transform(names, lambda x: (x.f + (case when st > 0 then 2 else 0 end) - st)::varchar || '-' || (x.l + (case when st > 0 then 2 else 0 end) - st)::varchar), ' ') as highlights from c""")
def quotes_of_names(spark: SparkSession, d: str) -> DataFrame:
    """Where documents name something: paragraphs that hold the names, long ones cut around names near one another."""
    return quotes.quotes(quotes.named_paragraphs(Catalogue(spark, d).documents(), "doc_id", "text", NAMES))


# --- tags ---

#: Places of a paragraph's hashed trigrams, paragraphs shorter than which say nothing, and what is quoted of the likeliest.
PLACES_OF_TRIGRAMS, LEAST_LETTERS, QUOTED = 128, 40, 160


def paragraph_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(key, paragraph, body, v) of paragraphs of some length: hashed trigrams to length one."""
    docs = Catalogue(spark, d).documents().where("doc_id is not null")
    line = docs.select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", "\n")).alias("at", "body")).where(F.length("body") >= LEAST_LETTERS)
    line = line.select("key", (F.col("at") + 1).alias("paragraph"), "body", F.col("body").alias("letters"))
    both = learnt.kept(tx.trigram_counts(line, "letters", PLACES_OF_TRIGRAMS), "paragraph-counts")
    return both.withColumn("v", nm.unit(F.col("v")))


def tag_vectors(paragraphs: DataFrame, tagged: DataFrame) -> DataFrame:
    """(tag, t): mean vector of the paragraphs of documents that have the tag, to length one."""
    own = paragraphs.join(tagged, "key").select("tag", F.posexplode("v").alias("k", "x")).groupBy("tag", "k").agg(F.avg("x").alias("x"))
    return own.groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("s")).select("tag", nm.unit(F.col("s.x")).alias("t"))


@query()
def tags_by_text(spark: SparkSession, d: str) -> DataFrame:
    """Of every document and tag (its language) the chance by the closeness of its paragraphs, and the likeliest paragraph as quote and address.

    One model of closeness with one bias a tag; documents whose hash is held out are not learnt from, neither
    by the model nor by the tags' vectors.
    """
    docs = Catalogue(spark, d).documents().where("doc_id is not null").select(F.col("doc_id").alias("key"), F.col("lang").alias("tag"))
    held = F.crc32(F.col("key").cast("string").cast("binary")) % 5 == 0
    paragraphs = paragraph_vectors(spark, d)
    tags = learnt.kept(tag_vectors(paragraphs.where(~held), docs.where(~held & F.col("tag").isNotNull())), "tags")
    # a tag's vector is small and each is a value of one facet; every paragraph meets every tag, as in a product of matrices
    near = paragraphs.crossJoin(tags).select("key", "tag", "paragraph", "body", nm.dot(F.col("v"), F.col("t")).alias("c"))
    best = near.groupBy("key", "tag").agg(F.max_by(F.struct("paragraph", "body"), F.struct("c", -F.col("paragraph"))).alias("b"), F.max("c").alias("best"), F.avg("c").alias("mean"))
    best = learnt.kept(best.select("key", "tag", F.col("b.paragraph").alias("paragraph"), F.substring("b.body", 1, QUOTED).alias("quote"), "best", "mean"), "closeness")
    known = best.join(docs.where("tag is not null").withColumn("has", F.lit(1)), ["key", "tag"], "left").withColumn("has", F.coalesce("has", F.lit(0)))
    model = mixed.fit(known.where(~held), ["best", "mean"], "has")
    return model.chance(best, ["best", "mean"]).select("key", "tag", F.round("chance", 6).alias("chance"), "paragraph", "quote")
