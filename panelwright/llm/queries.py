"""The registered queries of this subpackage, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cotrain, exact, mixing, near, pii, repetition, sharding, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_radix_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.radix_groups(_table(spark, sf_dir, "documents"))


def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), sharding.tree(8), sharding.tree(9))


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_pairs(chat.swapped_replies(_table(spark, sf_dir, "conversations")))


#: All sources of the corpus at equal shares; sources that turn up later share one more.
MIXTURE = {f"src{k}": 1.0 for k in range(20)}


def op4_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(_table(spark, sf_dir, "documents"), MIXTURE, seed=7)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(_table(spark, sf_dir, "documents"))


def op6_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = cotrain.with_scores(docs, cotrain.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))


def op7_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    archive = warc.write_archive(pages)
    return warc.read_records(archive, warc.look_up(archive, pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.private_spans(_table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_radix_exact_dedup": op1_radix_exact_dedup,
    "op2_hash_tree_shards": op2_hash_tree_shards,
    "op3_preference_pairs": op3_preference_pairs,
    "op4_poisson_mixture": op4_poisson_mixture,
    "op5_order_minhash": op5_order_minhash,
    "op6_cotrained_quality": op6_cotrained_quality,
    "op7_speculative_bpe": op7_speculative_bpe,
    "op8_warc_index": op8_warc_index,
    "op9_weak_pii": op9_weak_pii,
    "op10_repetition_rules": op10_repetition_rules,
}

ORACLES: dict[str, str] = {
    "op1_radix_exact_dedup": """
        select doc_id, max(doc_id) over (partition by k) as keep_id, count(*) over (partition by k) as group_size,
               doc_id = max(doc_id) over (partition by k) as kept, sha256(k) as text_sha256
        from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from documents)
    """,
    "op3_preference_pairs": """
        with said as (select conv_id, turn, coalesce(text, '') as text from conversations where role = 'assistant' and conv_id is not null and turn is not null),
        tops as (select conv_id, max(turn) as top from said group by conv_id),
        replies as (select s.conv_id, t.top, min(s.text) as reply from said s join tops t on s.conv_id = t.conv_id and s.turn = t.top group by all),
        ends as (select r.conv_id, r.top, r.reply, o.reply as other from replies r left join replies o on xor(r.conv_id, 1) = o.conv_id),
        told as (
            select c.conv_id as pair_id, c.turn, coalesce(c.role, 'unknown') as role, coalesce(c.text, '') as text from conversations c join ends e on c.conv_id = e.conv_id and c.turn < e.top),
        sides as (
            select pair_id, 'chosen' as side, turn, role, text from told union all select pair_id, 'rejected', turn, role, text from told
            union all select conv_id, 'chosen', top, 'assistant', reply from ends
            union all select conv_id, 'rejected', top, 'assistant', other from ends where other is not null),
        placed as (select *, row_number() over (partition by pair_id, side order by turn, role, text) as k from sides),
        matched as (select c.pair_id, c.k, c.role = r.role and c.text = r.text as same from placed c join placed r on c.pair_id = r.pair_id and c.k = r.k where c.side = 'chosen' and r.side = 'rejected'),
        cut as (select e.conv_id as pair_id, coalesce(min(k) filter (not same) - 1, max(k), 0) as n_common from ends e left join matched m on e.conv_id = m.pair_id group by e.conv_id),
        escaped as (select * replace (replace(role, '<|im_', '<| im_') as role, replace(text, '<|im_', '<| im_') as text) from placed),
        drawn as (
            select p.*, c.n_common, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as shown, length(role) as role_size, length(text) as text_size
            from escaped p join cut c on p.pair_id = c.pair_id),
        spots as (
            select *, coalesce(sum(length(shown)) over (partition by pair_id, side order by k rows between unbounded preceding and 1 preceding), 0) as spot from drawn where k > n_common),
        spans as (
            select pair_id, side, string_agg((spot + 13 + role_size)::bigint || ':' || (spot + 23 + role_size + text_size)::bigint, ',' order by k) as spans from spots where role = 'assistant' group by all)
        select c.pair_id, c.n_common,
               coalesce((select string_agg(shown, '' order by k) from drawn d where d.pair_id = c.pair_id and d.side = 'chosen' and d.k <= d.n_common), '') as prompt,
               coalesce((select string_agg(shown, '' order by k) from drawn d where d.pair_id = c.pair_id and d.side = 'chosen' and d.k > d.n_common), '') as chosen,
               coalesce((select string_agg(shown, '' order by k) from drawn d where d.pair_id = c.pair_id and d.side = 'rejected' and d.k > d.n_common), '') as rejected,
               coalesce((select spans from spans s where s.pair_id = c.pair_id and s.side = 'chosen'), '') as chosen_spans,
               coalesce((select spans from spans s where s.pair_id = c.pair_id and s.side = 'rejected'), '') as rejected_spans
        from cut c
    """,
    "op4_poisson_mixture": """
        with d as (select *, case when source in (select 'src' || i from range(20) t(i)) then source else 'rest' end as bucket from documents),
        sizes as (select bucket, sum(strlen(coalesce(text, '')))::double as size from d group by bucket having size > 0),
        rates as (select bucket, 1.0::double / (select count(*)::double from sizes) * (select sum(size) from sizes) / size as rate from sizes),
        parts as (select bucket, ceil(rate / 32)::int as pieces, rate / ceil(rate / 32) as mean from rates),
        terms as (
            with recursive t(bucket, k, p, c, mean) as (
                select bucket, 0, exp(-mean), exp(-mean), mean from parts
                union all select bucket, k + 1, p * mean / (k + 1), c + p * mean / (k + 1), mean from t where k < 140)
            select bucket, list(c order by k) as cdf from t group by bucket),
        drawn as (
            select d.*, p.pieces, t.cdf, [('0x' || substr(md5('7|count|' || coalesce(doc_id::varchar, 'null') || '|' || j), 1, 13))::bigint::double / 4503599627370496.0::double for j in range(1, p.pieces + 1)] as us
            from d join parts p on d.bucket = p.bucket join terms t on d.bucket = t.bucket),
        counted as (select doc_id, text, lang, source, n_chars, list_sum([len([c for c in cdf if c <= u]) for u in us])::int as n_copies from drawn)
        select doc_id, text, lang, source, n_chars, unnest(range(1, n_copies + 1))::int as copy, n_copies from counted where n_copies > 0
    """,
}
