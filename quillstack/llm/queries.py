"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import codes, languages, lines, merkle, minhash, packing, pieces, quality, suffix, topk, toxicity, vectors, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.scored(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op5_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.drop_repeated_passages(_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))



def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op10_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.fit(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    out = codes.with_label_errors(coded)
    return out.select("vec_id", codes.code_text().alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.tagged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), merkle.without_line_ends())
    return out.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest("path").alias("proof_sha256"), merkle.fold(F.col("turned"), "path").alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_toxicity_crf, op3_line_dedup, op4_suffix_dedup, op5_quality_network, op6_harmonic_packing, op7_exact_topk, op8_sentencepiece, op9_warc, op10_vector_near_dedup, op11_vector_codes, op12_language_profiles, op13_merkle_manifest)}

SQL = {
    "op3_line_dedup": """
with line as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as body,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
    from documents
), keyed as (
    select *, translate(trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from line
), shared as (
    select k, max(doc_id) as keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3
), marked as (
    select keyed.*, shared.k is not null and keyed.doc_id <> shared.keeper as gone from keyed left join shared on keyed.k = shared.k
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(body, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""",
    "op7_exact_topk": """
with vectors as (
    select row_number() over () as uid, vec_id, list_transform(embedding, lambda x: floor(1024.0 * x::double)::bigint) as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, c.uid,
           list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
    from vectors q join vectors c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored
)
select query_id, r::int as rank, vec_id, score from ranked where r <= 10
""",
    "op9_warc": """
with full_pages as (
    select page_id, coalesce(html, '') as body from pages
), digested as (
    select page_id, strlen(body)::bigint as payload_bytes, sha256(body) as payload_digest from full_pages
), firsts as (
    select payload_digest, min(page_id) as first_id from digested where payload_bytes >= 100 group by payload_digest
)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when f.first_id <> d.page_id then 'revisit' else 'response' end as record_type,
       case when f.first_id <> d.page_id then f.first_id end as refers_to
from digested d left join firsts f on d.payload_digest = f.payload_digest
""",
    "op10_vector_near_dedup": """
with recursive fine as (
    select vec_id, embedding::double[] as v from embeddings
    where embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), link as materialized (
    select a.vec_id as u, b.vec_id as v from fine a join fine b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where list_cosine_similarity(a.v, b.v) >= 0.9
), reach(u, v) as (
    select vec_id, vec_id from embeddings union select reach.u, link.v from reach join link on reach.v = link.u
), component as (
    select u, min(v) as component_id from reach group by u
), degree as (
    select u, count(*) as n from link group by u
)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join component c on c.u = e.vec_id left join degree d on d.u = e.vec_id
""",
    "op11_vector_codes": """
with fine as (
    select row_number() over (order by vec_id, embedding) - 1 as rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), part as materialized (
    select rid, p.part, v[4 * p.part + 1 : 4 * p.part + 4] as v from fine, range(16) p(part)
), book0 as materialized (
    select part, rid as entry, v from part where rid < 64
), near0 as materialized (
    select rid, part, any_value(v) as v, arg_min(entry, d * 64 + entry) as entry, min(d) as d
    from (select p.rid, p.part, p.v, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
          from part p join book0 b on b.part = p.part)
    group by rid, part
), book1 as materialized (
    select b.part, b.entry, coalesce(m.v, b.v) as v from book0 b left join (
        select part, entry, list(c order by k) as v from (
            select part, entry, k, floor(sum(v[k])::double / count(*))::bigint as c from near0, range(1, 5) r(k) group by part, entry, k
        ) group by part, entry
    ) m on m.part = b.part and m.entry = b.entry
), near1 as materialized (
    select rid, part, any_value(v) as v, arg_min(entry, d * 64 + entry) as entry, min(d) as d
    from (select p.rid, p.part, p.v, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
          from part p join book1 b on b.part = p.part)
    group by rid, part
), book2 as materialized (
    select b.part, b.entry, coalesce(m.v, b.v) as v from book1 b left join (
        select part, entry, list(c order by k) as v from (
            select part, entry, k, floor(sum(v[k])::double / count(*))::bigint as c from near1, range(1, 5) r(k) group by part, entry, k
        ) group by part, entry
    ) m on m.part = b.part and m.entry = b.entry
), near2 as materialized (
    select rid, part, any_value(v) as v, arg_min(entry, d * 64 + entry) as entry, min(d) as d
    from (select p.rid, p.part, p.v, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
          from part p join book2 b on b.part = p.part)
    group by rid, part
), told as (
    select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from book2
), coded as (
    select f.vec_id, f.label, string_agg(printf('%02x', n.entry), '' order by n.part) as code, sum(n.d)::bigint as error
    from near2 n join fine f on f.rid = n.rid group by f.rid, f.vec_id, f.label
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, told
""",
    "op13_merkle_manifest": """
with recursive told as (
    select doc_id, source, case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id::varchar end || case when source is null then '-' else strlen(source::varchar) || ':' || source::varchar end || case when lang is null then '-' else strlen(lang::varchar) || ':' || lang::varchar end || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars::varchar end as head, text,
           xor(list_reduce([4294967295::bigint] || list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda c: ascii(c)::bigint),
               lambda acc, b: list_reduce([xor(acc, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295) as crc
    from documents
), hashed as (
    select doc_id, source, sha256(head || case when text is null then '-' else strlen(text::varchar) || ':' || text::varchar end) as leaf,
           sha256(head || case when text is null then '-' when crc % 2 = 0 then strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') else strlen(text) || ':' || text end) as turned
    from told
), placed as (
    select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as seq, count(*) over (partition by source) as n from hashed
), node(source, lvl, seq, h, n) as (
    select source, 0, seq, leaf, n from placed
    union all
    select source, lvl + 1, seq // 3, sha256(string_agg(h, '' order by seq)), (min(n) + 2) // 3 from node where n > 1 group by source, lvl, seq // 3
), crown(lvl, seq, h, n) as (
    select 0, row_number() over (order by source is not null, encode(source)) - 1, h, count(*) over () from node where n = 1
    union all
    select lvl + 1, seq // 3, sha256(string_agg(h, '' order by seq)), (min(n) + 2) // 3 from crown where n > 1 group by lvl, seq // 3
), seat as (
    select source, h as subroot, row_number() over (order by source is not null, encode(source)) - 1 as seq from node where n = 1
), side as (
    select s.source, c.lvl, coalesce(string_agg(c.h, '' order by c.seq) filter (where c.seq < s.seq // pow(3, c.lvl)::bigint), '') as b,
           coalesce(string_agg(c.h, '' order by c.seq) filter (where c.seq > s.seq // pow(3, c.lvl)::bigint), '') as a
    from seat s join crown c on c.n > 1 and c.seq // 3 = s.seq // pow(3, c.lvl + 1)::bigint group by s.source, c.lvl
), upper_path as (
    select source, list({'b': b, 'a': a} order by lvl) as path from side group by source
), own_side as (
    select p.source, p.seq, c.lvl, coalesce(string_agg(c.h, '' order by c.seq) filter (where c.seq < p.seq // pow(3, c.lvl)::bigint), '') as b,
           coalesce(string_agg(c.h, '' order by c.seq) filter (where c.seq > p.seq // pow(3, c.lvl)::bigint), '') as a
    from placed p join node c on c.source is not distinct from p.source and c.n > 1 and c.seq // 3 = p.seq // pow(3, c.lvl + 1)::bigint
    group by p.source, p.seq, c.lvl
), own_path as (
    select source, seq, list({'b': b, 'a': a} order by lvl) as path from own_side group by source, seq
), whole as (
    select p.*, s.subroot, (select h from crown where n = 1) as root, coalesce(o.path, []) || coalesce(u.path, []) as path
    from placed p join seat s on s.source is not distinct from p.source
    left join own_path o on o.source is not distinct from p.source and o.seq = p.seq
    left join upper_path u on u.source is not distinct from p.source
), folded as (
    select *, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.b || x.a), ''), '')) as proof_sha256,
           list_reduce([{'b': turned, 'a': ''}] || path, lambda acc, x: {'b': sha256(x.b || acc.b || x.a), 'a': ''}).b as folded_root
    from whole
)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded
""",
}
