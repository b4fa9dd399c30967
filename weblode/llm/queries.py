"""The registered query of each operator, and the DuckDB twin where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cross_entropy, exact_dedup, hard_negatives, kn_quality, mixing, ngram_join, packing, prefix_trie, ring_sharding, suffix_dedup, syncmers, toxicity
from .common import documents, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_documents(documents(spark, sf_dir))


def op2_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_stateful_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet").select(
        F.col("row_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), 200)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(documents(spark, sf_dir), width=4, percent=85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_sharding.shard_documents(documents(spark, sf_dir), 40)


def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy.score(documents(spark, sf_dir), table(spark, sf_dir, "labels").filter("quality = 1"))


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.vectors(table(spark, sf_dir, "embeddings").withColumn("label", hard_negatives.shifted()))
    return hard_negatives.mine(rows, rows.filter("vec_id % 50 = 0"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), rebuild=True)


def op13_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), packing.tokenizer_encoder(WORD_BPE, 1))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_closed_syncmers": op1_closed_syncmers,
    "op2_budget_mix": op2_budget_mix,
    "op3_stateful_stream_dedup": op3_stateful_stream_dedup,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_bounded_ring": op9_bounded_ring,
    "op10_cross_entropy": op10_cross_entropy,
    "op11_cover_tree": op11_cover_tree,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_online_packing": op13_online_packing,
}

ORACLES = {
    "op3_stateful_stream_dedup": """
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
               doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window g as (partition by coalesce(text, ''))
    """,
    "op11_cover_tree": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: floor(256 * x::double)) as e
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select a.vec_id as anchor_id, b.vec_id as row_id, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score
            from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
        ), p as (
            select * from s where same qualify row_number() over (partition by anchor_id order by score desc, row_id) <= 5
        ), n as (
            select p.anchor_id, p.row_id as positive_id, s.row_id as negative_id, p.score as positive_score, s.score as negative_score,
                   row_number() over (partition by p.anchor_id, p.row_id order by s.score desc, s.row_id)::int as rank
            from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
        )
        select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
    """,
    "op12_prefix_trie": """
        with t as (
            select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                   row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as p
            from conversations where conv_id is not null
        ), b as (
            select list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) order by i) as tab from range(256) r(i)
        ), c as (
            select conv_id, count(*) as own, conv_id - conv_id % 5 as base,
                   xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
                       lambda c, x: xor(c >> 8, b.tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 9 as h
            from t, b group by conv_id, b.tab
        ), m as (
            select c.conv_id, c.base, c.h, least(c.h, coalesce(d.own, 0)) as taken, least(c.h, coalesce(d.own, 0)) + greatest(0, c.own - c.h) as n
            from c left join c d on d.conv_id = c.base
        ), r as (
            select m.conv_id, t.p as depth, t.role, t.text from m join t on t.conv_id = m.base and t.p <= m.taken
            union all
            select m.conv_id, m.taken + t.p - m.h, t.role, t.text from m join t on t.conv_id = m.conv_id and t.p > m.h
        ), k as (
            select conv_id, depth, strlen(text) as bytes,
                   sha256(string_agg(sha256(strlen(role)::varchar || ':' || role || text), ',' order by depth) over g) as key
            from r window g as (partition by conv_id order by depth)
            union all select conv_id, 0, 0, '' from m
        ), n as (
            select key, depth, min(conv_id) as conv_id, count(*) as n_convs, min(bytes) as bytes from k group by key, depth
        ), f as (
            select n.*, p.conv_id as parent_conv_id, coalesce(p.key || '/' || p.depth, '-') as parent
            from n left join k on k.conv_id = n.conv_id and k.depth = n.depth - 1 left join n p on p.key = k.key and p.depth = k.depth
        ), g as (
            select f.*, (select count(*) from f x where x.parent = f.key || '/' || f.depth) as n_children from f
        ), s as (
            select k.key, k.depth, sum(case when g.n_children = 0 then 1 else 0 end)::bigint as n_leaves, sum((g.n_convs - 1) * g.bytes)::bigint as saved_tokens
            from g join k on k.conv_id = g.conv_id and k.depth <= g.depth group by k.key, k.depth
        ), e as (
            select k.key, k.depth, string_agg(k.conv_id::varchar, ',' order by k.conv_id) as ids
            from k join m on m.conv_id = k.conv_id and m.n = k.depth group by k.key, k.depth
        )
        select g.conv_id, g.depth::bigint as depth, g.parent_conv_id, g.n_convs, g.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
        from g join s on s.key = g.key and s.depth = g.depth left join e on e.key = g.key and e.depth = g.depth
    """,
}
