"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    chat,
    decontamination,
    extraction,
    hard_negatives,
    line_quality,
    near_dedup,
    ngram_join,
    packing,
    personal_data,
    secrets,
    substring_dedup,
    token_counts,
)
from .text import read_table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), word_bpe(), capacity=2048, end_id=0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (read_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontamination.contaminated(docs, benchmark)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), words=5, similar=0.8)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    talks = talks.unionAll(spark.createDataFrame(fixed, talks.schema))
    return chat.digests(chat.format_chat(chat.events_of(talks)))


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read_table(spark, sf_dir, "pages"))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return line_quality.judge(docs, labels)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_windows(read_table(spark, sf_dir, "documents"), size=35)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(read_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), piece_bpe())


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(read_table(spark, sf_dir, "documents"), byte_bpe(), piece_bpe())


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(read_table(spark, sf_dir, "documents"), words=5, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_decontamination,
        op3_near_dedup,
        op4_chat,
        op5_extraction,
        op6_line_quality,
        op7_substring_dedup,
        op8_personal_data,
        op9_secrets,
        op10_token_counts,
        op11_alignment,
        op12_hard_negatives,
        op13_ngram_join,
    )
}

#: Tokenising, tiling, sampling, fitted models and wrappers are beyond SQL; tests compare them with brute-force versions.
ORACLES: dict[str, str] = {
    "op4_chat": r"""
        with turns as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
          union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
               cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), ''))
                 as loss_sha256,
               cast(sum(10 + length(role) + length(regexp_replace(role, '[^<\[|\\]', '', 'g'))
                        + length(text) + length(regexp_replace(text, '[^<\[|\\]', '', 'g'))) as bigint) as formatted_chars
        from turns group by conv_id""",
    "op7_substring_dedup": r"""
        with docs as (
          select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
        windows as (
          select doc_id, start, array_to_string(words[start : start + 34], ' ') as w
          from (select doc_id, words, unnest(range(1, len(words) - 33)) as start from docs)),
        repeated as (select w from windows group by w having count(*) > 1),
        covered as (
          select distinct doc_id, unnest(range(start, start + 35)) as place
          from windows where w in (select w from repeated)),
        gone as (select doc_id, list(place) as places from covered group by doc_id)
        select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(len(places), 0) as bigint) as n_removed,
               sha256(coalesce(array_to_string(
                 [words[i] for i in range(1, len(words) + 1) if places is null or not list_contains(places, i)], ' '), ''))
                 as kept_sha256
        from docs left join gone using (doc_id)""",
    "op12_hard_negatives": r"""
        with valid as (
          select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding from embeddings
          where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        parts as materialized (
          select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from valid),
        scores as materialized (
          select a.vec_id as anchor, r.vec_id as id, a.label = r.label as same,
                 cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) as bigint) as score
          from parts a join parts r on a.vec_id <> r.vec_id where a.vec_id % 50 = 0),
        positives as (
          select anchor, id, score from scores where same
          qualify row_number() over (partition by anchor order by score desc, id) <= 5),
        negatives as (
          select p.anchor, p.id as positive, p.score as positive_score, n.id as negative, n.score as negative_score,
                 row_number() over (partition by p.anchor, p.id order by n.score desc, n.id) as rank
          from positives p join scores n on n.anchor = p.anchor and not n.same
          where 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
        select anchor as anchor_id, positive as positive_id, cast(rank as integer) as rank, negative as negative_id,
               positive_score, negative_score
        from negatives where rank <= 3""",
    "op13_ngram_join": r"""
        with recursive docs as (
          select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x20\x09-\x0D]+') as words from documents),
        grams as materialized (
          select distinct doc_id, array_to_string(words[start : start + 4], ' ') as gram
          from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as start from docs where len(words) > 0)),
        sizes as materialized (select doc_id, count(*) as n from grams group by doc_id),
        linked as materialized (
          select a.doc_id as one, b.doc_id as other
          from grams a join grams b on a.gram = b.gram and a.doc_id <> b.doc_id
          join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
          group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        reached as (
          select one, other from linked
          union select reached.one, linked.other from reached join linked on reached.other = linked.one)
        select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(first, doc_id)) as component_id
        from documents left join sizes using (doc_id)
        left join (select one as doc_id, min(other) as first from reached group by one) using (doc_id)""",
}
