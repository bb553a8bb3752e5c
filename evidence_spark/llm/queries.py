"""The registered queries of this folder and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_spark.llm import exact_dedup, filter_audit, language, lines, manifest, mixing, packing, passages, personal_data, repeats, sharding, simhash, vectors
from evidence_spark.llm.common import documents

#: The tokenizer file, the same vocabulary as ranks, and the pattern that splits texts into words.
VOCABULARY = (
    public_tokenizers.path("byte_bpe_50k.json"),
    public_tokenizers.path("byte_bpe_50k.tiktoken"),
    public_tokenizers.PATTERN,
)


def op1_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, folder)).drop("kept")


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.digest(personal_data.find(documents(spark, folder)))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = language.train(docs.where(~language.is_held_out()))
    keep = [F.col("doc_id").cast("long").alias("doc_id"), language.is_held_out().alias("held_out")]
    return language.label(docs, model, keep=keep)


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.group_copies(documents(spark, folder))


def op5_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), VOCABULARY)


def op7_hilbert_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(documents(spark, folder))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.remove_similar_lines(documents(spark, folder)).drop("kept")


def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(mixing.mix(documents(spark, folder)))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest(documents(spark, folder))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op13_phrase_automata(spark: SparkSession, folder: str) -> DataFrame:
    return passages.remove_passages(documents(spark, folder)).drop("kept")


QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_personal_data": op2_personal_data,
    "op3_language": op3_language,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_multi_index": op5_multi_index,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_hilbert_sharding": op7_hilbert_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_simhash": op10_simhash,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_filter_audit": op12_filter_audit,
    "op13_phrase_automata": op13_phrase_automata,
}

ORACLES = {
    "op4_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') as t from documents)
        select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from d
    """,
    "op11_merkle_manifest": """
        with recursive d as (
            select doc_id, lang,
                   list_reduce(list_prepend(4294967295::ubigint, [ascii(c)::ubigint for c in string_split(doc_id::varchar, '')]),
                       lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::ubigint for i in range(8)]),
                           lambda x, i: case when x & 1::ubigint = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)) as crc,
                   concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                          coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) as head,
                   coalesce(strlen(text) || ':' || text, '-') as body,
                   coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') as other
            from documents
        ), leaves as (
            select doc_id, lang, sha256(head || body) as leaf,
                   sha256(head || case when xor(crc, 4294967295::ubigint) % 3 = 0 then other else body end) as shown,
                   row_number() over (partition by lang order by doc_id nulls last, sha256(head || body)) - 1 as pos, count(*) over (partition by lang) as n
            from d
        ), nodes as (
            select lang, 0 as level, pos, n, leaf as hash from leaves
            union all
            select lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(hash, '' order by pos))
            from nodes where n > 1 group by lang, level, pos // 8, n
        ), tops as (
            select lang, hash, level, row_number() over (order by lang is not null, encode(lang)) - 1 as pos, count(*) over () as n
            from nodes where n = 1
        ), roots as (
            select 0 as level, pos, n, hash from tops
            union all
            select level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(hash, '' order by pos)) from roots where n > 1 group by level, pos // 8, n
        ), steps as (
            select a.lang, a.level, a.pos, coalesce(string_agg(b.hash, '' order by b.pos) filter (b.pos < a.pos), '') as l,
                   coalesce(string_agg(b.hash, '' order by b.pos) filter (b.pos > a.pos), '') as r
            from nodes a join nodes b on a.lang is not distinct from b.lang and a.level = b.level and a.pos // 8 = b.pos // 8
            where a.n > 1 group by a.lang, a.level, a.pos
        ), rises as (
            select a.level, a.pos, coalesce(string_agg(b.hash, '' order by b.pos) filter (b.pos < a.pos), '') as l,
                   coalesce(string_agg(b.hash, '' order by b.pos) filter (b.pos > a.pos), '') as r
            from roots a join roots b on a.level = b.level and a.pos // 8 = b.pos // 8 where a.n > 1 group by a.level, a.pos
        ), folds as (
            select row_number() over () as nr, doc_id, leaf, t.hash as subroot, l.lang, l.pos, t.pos as top_pos, t.level as height, 0 as level,
                   shown as held, '' as proof
            from leaves l join tops t on l.lang is not distinct from t.lang
            union all
            select nr, doc_id, leaf, subroot, f.lang, f.pos, top_pos, height, f.level + 1,
                   sha256(coalesce(s.l, u.l) || held || coalesce(s.r, u.r)), proof || coalesce(s.l || s.r, u.l || u.r)
            from folds f
            left join steps s on f.level < height and s.lang is not distinct from f.lang and s.level = f.level and s.pos = f.pos >> (3 * f.level)
            left join rises u on f.level >= height and u.level = f.level - height and u.pos = top_pos >> (3 * greatest(f.level - height, 0))
            where s.level is not null or u.level is not null
        )
        select doc_id, leaf, subroot, (select hash from roots where n = 1) as root, sha256(proof) as proof_sha256, held as folded_root,
               held = (select hash from roots where n = 1) as verified
        from folds qualify level = max(level) over (partition by nr)
    """,
    "op12_filter_audit": """
        with d as (
            select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents
        ), w as (
            select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as words, min(doc_id) over (partition by t) as first_id from d
        ), known as (
            select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id
        ), f as (
            select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
                   (case when len(words) < 200 then 16 else 0 end)
                   + (case when 100 * len(list_distinct(words)) < 50 * len(words) then 8 else 0 end)
                   + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 4 else 0 end)
                   + (case when regexp_matches(t, '[#$%&*|]') then 2 else 0 end)
                   + (case when doc_id > first_id then 1 else 0 end) as code
            from w left join known using (doc_id)
        ), c as (
            select part, code, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by part, code
        ), x as (
            select unnest([16, 8, 4, 2, 1]) as bit, unnest(['A', 'B', 'C', 'D', 'E']) as name
        ), orders as (
            select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
            from x a, x b, x c, x d, x e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31
        ), s as (
            select filter_order, step, bits[step] as now, coalesce(list_sum(bits[:step - 1]), 0)::integer as before
            from orders, (select unnest(range(1, 6))::integer as step)
        ), r as (
            select part, filter_order, step, now,
                   coalesce(sum(n) filter (code & (before | now) = 0), 0)::bigint as kept,
                   coalesce(sum(n) filter (code & now > 0 and code & before = 0), 0)::bigint as removed,
                   coalesce(sum(n) filter (code & now > 0 and code & before > 0), 0)::bigint as redundant,
                   coalesce(sum(n) filter (code = now), 0)::bigint as unique_fails,
                   coalesce(sum(good) filter (code & now > 0 and code & before = 0), 0)::bigint as good_lost,
                   coalesce(sum(toxic) filter (code & now > 0 and code & before = 0), 0)::bigint as toxic_lost
            from c, s group by part, filter_order, step, now
        )
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) over (partition by part, now)::bigint as shapley
        from r
    """,
    "op13_phrase_automata": """
        with d as (
            select row_number() over () as nr, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
        ), w as (
            select nr, pos, array_to_string(words[pos:pos + 34], ' ') as phrase
            from (select nr, words, unnest(range(1, len(words) - 33)) as pos from d where len(words) >= 35)
        ), r as (
            select nr, pos from (select nr, pos, count(*) over (partition by phrase) as n from w) where n > 1
        ), g as (
            select nr, pos, lead(pos) over (partition by nr order by pos) as next from r
        ), gone as (
            select distinct nr, unnest(range(pos, least(pos + 35, coalesce(next, pos + 35)))) as pos from g
        ), kept as (
            select nr, array_to_string(list(word order by pos), ' ') as kept, count(*) as n
            from (select nr, unnest(words) as word, unnest(range(1, len(words) + 1)) as pos from d) anti join gone using (nr, pos)
            group by nr
        )
        select doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from d left join kept using (nr)
    """,
}
