"""Text, date and map queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import numbers, stems as st, text as tx
from ..sources import pages as html
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


FORM = r"trim(regexp_replace(lower(t), '[^\p{L}\p{Nd}]+', ' ', 'g'))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).documents()


@query(f"select doc_id, {FORM.replace('lower(t)', 'lower(text)')} as form from documents")
def title_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.title_form(F.col("text")).alias("form"))


@query(r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{Nd}]+(?:[-''’‐‑][\p{L}\p{Nd}]+)*'))::bigint as n from documents")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.word_count(F.col("text")).cast("long").alias("n"))


@query(r"""with t as (select doc_id, text, length(text) as n, regexp_replace(text, '[^\n\r]', '', 'g') as br, regexp_replace(text, '[^\p{L}]', '', 'g') as l from documents),
c as (select doc_id, n, length(br) as breaks, n - length(regexp_replace(text, '[ \t\f\x0B]', '', 'g')) as spaces, length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) as digits,
length(regexp_replace(l, '[^\x{0}-\x{7F}]', '', 'g')) as letters1, length(regexp_replace(l, '[^\x{80}-\x{7FF}]', '', 'g')) as letters2, length(regexp_replace(l, '[^\x{800}-\x{FFFF}]', '', 'g')) as letters3, length(regexp_replace(l, '[^\x{10000}-\x{10FFFF}]', '', 'g')) as letters4 from t)
select doc_id, breaks, spaces, digits, letters1, letters2, letters3, letters4, n - breaks - spaces - digits - letters1 - letters2 - letters3 - letters4 as rest from c""")
def char_classes(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", *(c.cast("long").alias(k) for k, c in tx.class_counts(F.col("text")).items()))


@query(r"""with s as (select doc_id, unnest(string_split(regexp_replace(replace(text, chr(10), chr(1)), '([.!?…])[ \t\f\r\x0B]+', '\1' || chr(1), 'g'), chr(1))) as x, generate_subscripts(string_split(regexp_replace(replace(text, chr(10), chr(1)), '([.!?…])[ \t\f\r\x0B]+', '\1' || chr(1), 'g'), chr(1)), 1) as i from documents),
w as (select doc_id, i, list_filter(string_split_regex(regexp_replace(x, '^[\s\-*•·+>]+', ''), '\s+'), lambda z: z <> '') as t from s),
p as (select doc_id, i, j, array_to_string(t[j * 40 + 1 : j * 40 + 40], ' ') as phrase from w, range(0, 2000) r(j) where j <= greatest((len(t) - 1) // 40, 0)),
k as (select * from p where length(regexp_replace(phrase, '[^\p{L}]', '', 'g')) >= 12 and len(string_split(phrase, ' ')) >= 3)
select doc_id, (row_number() over (partition by doc_id order by i, j) - 1)::int as place, phrase from k""")
def phrases(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(tx.phrases(F.col("text"))).alias("place", "phrase"))


@query(r"""with recursive l as (select doc_id, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as line, row_number() over (partition by doc_id order by i) as k from
(select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where regexp_matches(x, '\p{L}')),
walk(doc_id, k, done, rest) as (select distinct doc_id, 0::bigint, []::varchar[], '' from l
union all select w.doc_id, l.k, case when length(case when rest = '' then line else rest || chr(10) || line end) >= 200 then list_append(done, case when rest = '' then line else rest || chr(10) || line end) else done end,
case when length(case when rest = '' then line else rest || chr(10) || line end) >= 200 then '' else case when rest = '' then line else rest || chr(10) || line end end
from walk w join l on l.doc_id = w.doc_id and l.k = w.k + 1),
last_ as (select doc_id, case when rest = '' then done when len(done) = 0 then [rest] else list_append(done[1 : len(done) - 1], done[len(done)] || chr(10) || rest) end as p from (select *, row_number() over (partition by doc_id order by k desc) as r from walk) where r = 1)
select doc_id, (generate_subscripts(p, 1) - 1)::int as place, unnest(p) as paragraph from last_""")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(tx.paragraphs(F.col("text"))).alias("place", "paragraph"))


@query(r"select s_suppkey as k, regexp_replace(replace(lower(trim('  ' || s_name || '  Ёж')), 'ё', 'е'), '\s+', ' ', 'g') as form from supplier")
def name_form(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).table("supplier").select(F.col("s_suppkey").alias("k"), tx.name_form(F.concat(F.lit("  "), "s_name", F.lit("  Ёж"))).alias("form"))


@query("select p_partkey as item_id, array_to_string(list_sort(list_transform(string_split(p_name, ' '), lambda x: lower(trim(x)))), '|') as form from part")
def pairing_form(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).items().select("item_id", tx.pairing_form(F.col("words")).alias("form"))


@query("select doc_id, case when u >= 9223372036854775808 then (u - 18446744073709551616)::bigint else u::bigint end as key from (select doc_id, ('0x' || left(sha1(text), 16))::ubigint::hugeint as u from documents)")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.text_key(F.col("text")).alias("key"))


@query("select doc_id, sha256(lang || chr(10) || source || chr(10) || text) as hash from documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2(F.concat_ws("\n", "lang", "source", "text"), 256).alias("hash"))


@query("select o_orderkey as k, o_orderkey as n, o_custkey as b from orders")
def numbers_in_text(spark: SparkSession, d: str) -> DataFrame:
    said = Catalogue(spark, d).table("orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("about "), F.regexp_replace(F.format_number("o_orderkey", 0), ",", " "), F.lit(" words")).alias("t"), F.concat(F.lit("x "), F.col("o_custkey").cast("string"), F.lit(" likes, 3 more")).alias("u"))
    return said.select("k", tx.number_in(F.col("t")).alias("n"), tx.number_before(F.col("u"), "likes").alias("b"))


@query("select o_orderkey as k, epoch_ms(o_orderdate)::bigint // 1000 - 3 * 3600 as moscow from orders where o_orderdate >= timestamp '1992-01-01' and month(o_orderdate) = 1 and year(o_orderdate) > 1995 and year(o_orderdate) < 2010")
def russian_dates(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("orders").where("month(o_orderdate) = 1 and year(o_orderdate) > 1995 and year(o_orderdate) < 2010")
    plain = F.date_format("o_orderdate", "dd.MM.yyyy")
    told = F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit(" января "), F.year("o_orderdate").cast("string"))
    text = F.when(F.col("o_orderkey") % 2 == 0, plain).otherwise(told)
    return own.select(F.col("o_orderkey").alias("k"), F.unix_timestamp(tx.russian_date(text)).alias("moscow"))


@query("select o_orderkey as k, epoch_ms(date_trunc('day', o_orderdate))::bigint as ms from orders where o_orderkey % 4 <> 3")
def card_dates(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("orders")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "d MMM yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "MMM d, yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("yesterday"))
    return own.select(F.col("o_orderkey").alias("k"), F.unix_millis(tx.card_date(text)).alias("ms")).where("ms is not null")


@query(r"select doc_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}'']+'), lambda w: length(w) >= 2 and w not in ('the', 'and', 'of'))))::bigint as n from documents")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(tx.terms(F.col("text"), ["the", "and", "of"])).cast("long").alias("n"))


@query("select n, case when n <= 2 then n else n - n // 3 end as needed from (select distinct l_linenumber as n from lineitem)")
def minimum_should_match(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).table("lineitem").select(F.col("l_linenumber").alias("n")).distinct().select("n", tx.required(F.col("n")).alias("needed"))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as x from documents), n as (select doc_id, length(regexp_replace(x, '[^\p{Latin}]', '', 'g')) as la, [length(regexp_replace(x, '[^\p{Cyrillic}]', '', 'g')), length(regexp_replace(x, '[^\p{Greek}]', '', 'g')), length(regexp_replace(x, '[^\p{Hebrew}]', '', 'g')), length(regexp_replace(x, '[^\p{Arabic}]', '', 'g')), length(regexp_replace(x, '[^\p{Han}]', '', 'g')), length(regexp_replace(x, '[^\p{Hiragana}\p{Katakana}]', '', 'g'))] as o from l),
b as (select doc_id, case when greatest(la, list_max(o)) = 0 then 'la' else list_max([{'n': la, 'l': 'la'}, {'n': o[1], 'l': 'ru'}, {'n': o[2], 'l': 'el'}, {'n': o[3], 'l': 'he'}, {'n': o[4], 'l': 'ar'}, {'n': o[5], 'l': 'zh'}, {'n': o[6], 'l': 'ja'}]).l end as l from n) select doc_id, l, count(*) as n from b group by 1, 2""")
def line_language(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"), "lang").select("doc_id", tx.script_language(F.col("line"), "la").alias("l")).groupBy("doc_id", "l").agg(F.count("*").alias("n"))


@query(rf"""with w as (select lang, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) as word from documents), d as (select lang, word, count(*) as n from w group by 1, 2), s as (select lang, word, n, {st.stems_sql(st.PLAIN, 'word', 'lang')} as stem from d)
select lang, stem, sum(n)::bigint as n, count(*) as forms from s group by 1, 2""")
def stems(spark: SparkSession, d: str) -> DataFrame:
    """Stems of all words by the language of their document: how often they stand, and in how many forms. Each form is stemmed once."""
    words = _docs(spark, d).select("lang", F.explode(tx.letter_words(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return words.groupBy("lang", st.stem("word", "lang").alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


@query("select n_nationkey as k, case when n_nationkey % 2 = 0 then 'dt ' || n_name else n_name end as shown from nation")
def labels_by_language(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("nation")
    lines = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("en\t"), "n_name", F.lit("\nde\tdt "), "n_name", F.lit("\nde\tother"))).otherwise(F.concat(F.lit("en\t"), "n_name"))
    return own.select(F.col("n_nationkey").alias("k"), tx.shown_text(tx.texts_by_language(lines), ["de", "en"]).alias("shown"))


@query("select s_suppkey as k, s_nationkey::double as a, s_acctbal as b from supplier")
def key_numbers(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("supplier")
    m = tx.numbers_of(F.concat(F.lit("a="), F.col("s_nationkey").cast("string"), F.lit(" b="), F.col("s_acctbal").cast("string")))
    return own.select(F.col("s_suppkey").alias("k"), m["a"].alias("a"), m["b"].alias("b"))


@query("select event_type as kind, sum((props->>'$.k')::bigint)::bigint as total, count(*) as n from events group by 1")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).table("events").groupBy(F.col("event_type").alias("kind")).agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count("*").alias("n"))


@query(r"""with d as (select doc_id, text, greatest(instr(lower(text), 'the') - 73, 1) as at_ from documents where contains(lower(text), 'the')), r as (select doc_id, text, at_, substr(text, at_, 220) as raw from d),
h as (select *, case when at_ > 1 then '…' || regexp_replace(raw, '^[^\s]*\s+', '') else raw end as head from r) select doc_id, case when length(text) >= at_ + 220 then regexp_replace(head, '\s+[^\s]*$', '') || '…' else head end as shown from h""")
def snippet_window(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(F.lower("text").contains("the")).select("doc_id", tx.snippet(F.col("text"), "the").alias("shown"))


@query(r"""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<html lang="([^"]*)"', 1) as lang,
len(regexp_extract_all(html, '<a href="[^"]*"'))::bigint as links, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages""")
def page_parse(spark: SparkSession, d: str) -> DataFrame:
    return html.parsed(Catalogue(spark, d).table("pages")).select("page_id", "title", "lang", "links", "host")


@query("select count(*) as n, count(distinct url) as urls from pages where page_id % 3 <> 0")
def misread_pages(spark: SparkSession, d: str) -> DataFrame:
    """Captured pages that an older parser read, read again."""
    own = Catalogue(spark, d).table("pages").withColumn("parser_version", F.when(F.col("page_id") % 3 == 0, 2).otherwise(1))
    return html.parsed(html.misread(own, 2)).agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query("select url, min(page_id) as page_id from pages group by url order by min(page_id) limit 30")
def wanted_pages(spark: SparkSession, d: str) -> DataFrame:
    return Catalogue(spark, d).table("pages").groupBy("url").agg(F.min("page_id").alias("page_id")).orderBy("page_id").limit(30)


WORDS = r"word as (select doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) as w from documents where lang = 'en')"


@query(f"""with {WORDS}, share as (select doc_id, w, count(*)::double / sum(count(*)) over (partition by doc_id) as s, count(*) as n from word group by doc_id, w)
select w as word, round(sum(s), 6) as share, sum(n)::bigint as seen from share group by w order by sum(n) desc, w limit 100""")
def word_tally_top(spark: SparkSession, d: str) -> DataFrame:
    own = _docs(spark, d).where("lang = 'en'").select(tx.letter_words(F.lower("text")).alias("ws"))
    # every occurrence brings its document's 1 / total, so that one shuffle on the word, summed before it, is all
    return own.select(F.explode("ws").alias("word"), (1 / F.size("ws")).alias("share")).groupBy("word").agg(F.round(F.sum("share"), 6).alias("share"), F.count("*").alias("seen")).orderBy(F.desc("seen"), "word").limit(100)


@query(f"""with {WORDS}, total as (select doc_id, count(*) as t from word group by doc_id), share as (select doc_id, w, count(*)::double / any_value(t) as s from word join total using (doc_id) where w in ('the', 'of', 'and', 'is', 'to') group by doc_id, w),
stat as (select w, avg(s) as m, greatest(stddev_pop(s), 1e-6) as sd from share group by w)
select doc_id, share.w as word, round((s - m) / sd, 5) as z from share join stat using (w)""")
def manner_standardised(spark: SparkSession, d: str) -> DataFrame:
    own = _docs(spark, d).where("lang = 'en'").select("doc_id", tx.letter_words(F.lower("text")).alias("ws"))
    share = own.select("doc_id", F.size("ws").alias("t"), F.explode("ws").alias("word")).where(F.col("word").isin("the", "of", "and", "is", "to")).groupBy("doc_id", "t", "word").agg((F.count("*") / F.col("t")).alias("s"))
    stat = share.groupBy("word").agg(F.avg("s").alias("m"), F.greatest(F.stddev_pop("s"), F.lit(1e-6)).alias("sd"))
    return share.join(stat, "word").select("doc_id", "word", F.round((F.col("s") - F.col("m")) / F.col("sd"), 5).alias("z"))


@query(r"""with p as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as k, unnest(string_split(text, chr(10))) as line from documents),
m as (select distinct doc_id, k, n.w from p, (values ('the'), ('and'), ('that'), ('with')) n(w) where list_contains(regexp_extract_all(lower(line), '\p{L}+'), n.w))
select a.w as a, b.w as b, count(*) as n from m a join m b on a.doc_id = b.doc_id and a.k = b.k and a.w < b.w group by 1, 2""")
def cooccurrence_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of names that stand in one paragraph, from the set of names of each paragraph."""
    names = F.array(*map(F.lit, ["the", "and", "that", "with"]))
    own = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    found = own.select(F.array_sort(F.array_intersect(names, tx.letter_words(F.lower("line")))).alias("f")).where(F.size("f") > 1)
    pairs = found.select(F.explode(F.flatten(F.transform("f", lambda a: F.transform(F.filter("f", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


@query(r"select doc_id, w as name, len(list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda x: x = n.w))::bigint as n from documents, (values ('the'), ('that')) n(w) where list_contains(regexp_extract_all(lower(text), '\p{L}+'), n.w)")
def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    own = _docs(spark, d).select("doc_id", F.explode(tx.letter_words(F.lower("text"))).alias("name"))
    return own.where(F.col("name").isin("the", "that")).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query("select conv_id, count(*) as parts, string_agg(text, chr(10) order by turn) as whole from conversations group by conv_id")
def texts_grouped(spark: SparkSession, d: str) -> DataFrame:
    own = Catalogue(spark, d).table("conversations")
    return own.groupBy("conv_id").agg(F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t")).select("conv_id", "parts", F.array_join(F.col("t.text"), "\n").alias("whole"))


@query("select p_partkey as item_id, case when lower(p_name) = 'red' then 0 when starts_with(lower(p_name), 'red') then 1 else 2 end as rank, p_name as name from part where contains(lower(p_name), 'red') order by 2, 1 limit 30")
def value_name_search(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower("title")
    rank = F.when(name == "red", 0).when(name.startswith("red"), 1).otherwise(2)
    return Catalogue(spark, d).items().where(name.contains("red")).select("item_id", rank.alias("rank"), F.col("title").alias("name")).orderBy("rank", "item_id").limit(30)


GRAMS = rf"""f as (select {FORM.replace('lower(t)', 'lower(p_name)')} as f, min(p_partkey) as id, count(*) as items from part group by 1),
g as (select id, substr(' ' || f || ' ', i, 3) as g, count(*)::double as n from f, range(1, 100) r(i) where i <= length(f) group by 1, 2),
len as (select id, sqrt(sum(n * n)) as l from g group by id)"""


@query(f"""with {GRAMS}, c as (select a.id as a, b.id as b, sum(a.n * b.n) / any_value(x.l) / any_value(y.l) as c, any_value(x.l) as al, any_value(y.l) as bl
from g a join g b on a.g = b.g and a.id < b.id join len x on x.id = a.id join len y on y.id = b.id group by 1, 2)
select a, b, round(c, 6) as cosine, round(least(c * bl / al, 1), 6) as share, x.items as a_items, y.items as b_items from c join f x on x.id = a join f y on y.id = b where c >= 0.6""")
def trigram_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of titles by cosine of their trigrams, each title by its first item and with its number of items.

    Equal titles are one. Only titles that share a gram of their prefix are compared: the rarest
    grams, down to where what is left could no longer make a cosine of 0.6.
    """
    least = 0.6
    titles = Catalogue(spark, d).items().groupBy(tx.title_form(F.col("title")).alias("f")).agg(F.min("item_id").alias("id"), F.count("*").alias("items"))
    grams = titles.select("id", F.explode(tx.trigrams(F.col("f"))).alias("g")).groupBy("id", "g").agg(F.count("*").cast("double").alias("n"))
    seen = grams.groupBy("g").agg(F.count("*").alias("df"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("df", "g", "n"))), lambda x: F.struct(x["g"].alias("g"), x["n"].alias("n")))
    vectors = grams.join(seen, "g").groupBy("id").agg(line.alias("v")).withColumn("l", nm_norm("v"))
    # a vector whose grams from the k-th on weigh less than `least` of it cannot reach it without one before
    tail = lambda k: F.aggregate(F.slice("v", k, F.size("v")), F.lit(0.0), lambda s, x: s + x["n"] * x["n"])
    prefix = F.filter(F.sequence(F.lit(1), F.size("v")), lambda k: F.sqrt(tail(k)) >= least * F.col("l") - 1e-9)
    keys = vectors.select("id", F.explode(F.transform(prefix, lambda k: F.element_at("v", k)["g"])).alias("g"))
    pairs = keys.join(keys.select("g", F.col("id").alias("other")), "g").where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    side = lambda s: titles.join(vectors, "id").select(F.col("id").alias(s), F.col("v").alias(f"{s}v"), F.col("l").alias(f"{s}l"), F.col("items").alias(f"{s}_items"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("bm", F.map_from_entries("bv"))
    c = F.aggregate("av", F.lit(0.0), lambda s, x: s + x["n"] * F.coalesce(F.try_element_at("bm", x["g"]), F.lit(0.0))) / F.col("al") / F.col("bl")
    return both.withColumn("c", c).where(f"c >= {least}").select("a", "b", F.round("c", 6).alias("cosine"), F.round(tx.lexical_share(F.col("c"), F.col("al"), F.col("bl")), 6).alias("share"), "a_items", "b_items")


def nm_norm(v: str) -> F.Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x["n"] * x["n"]))
