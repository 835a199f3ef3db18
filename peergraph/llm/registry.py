"""The ``opN_<name>`` queries over whole driver tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from peergraph.llm import bpe, divergence, extraction, mixing, pitman_yor, quality, quantization, secrets, simhash, substrings, suffixes, toolcalls, topk
from peergraph.llm import registry_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    kind = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", kind(0).alias("n_assign"), kind(1).alias("n_access"), kind(2).alias("n_hex"),
        F.sha2(secrets.spans_text(spans, 3), 256).alias("base_sha256"),
        secrets.spans_text(spans).alias("spans"), kind(3).alias("n_random"),
    )


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = topk.top_k(vectors, F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode_and_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.format_chat(_table(spark, sf_dir, "conversations"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("mark")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_boilerplate_words",
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]).cast("long"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), "kept_sha256")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source")).select(
        "lang", "source", "part", "item", "value", "rank"
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = quantization.compress(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return quantization.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(quantization.books_sha256(books)).alias("codebooks_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix_sources, op2_secret_scan, op3_exact_topk, op4_byte_bpe, op5_chat_format, op6_pitman_yor,
        op7_substring_dedup, op8_simhash, op9_quality_rules,
        op10_html_extraction, op11_suffix_dedup, op12_source_divergence, op13_vector_codes,
    )
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": """
with sized as (
  select doc_id, source, text,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size
  from documents
), sources as (
  select source, sum(size)::bigint as source_size,
         (row_number() over (order by source asc nulls last) - 1) % 3 + 1 as weight
  from sized group by source
), breaks as (
  select *, 3 * source_size as cap, (3 * source_size)::double / weight as brk,
         sum(source_size) over () as total
  from sources
), levels as (
  select *,
    (total - coalesce(sum(cap) over (order by brk, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
      / (sum(weight) over (order by brk, source nulls last rows between current row and unbounded following))::double as level
  from breaks
), level as (
  select coalesce(max(case when level <= brk then level end), 0.0) as level from levels
), targets as (
  select source, source_size, least(cap::double, level.level * weight) as target from breaks, level
), rated as (
  select doc_id, size, source_size, target, text,
         case when source_size > 0 then target / source_size else 0.0 end as rate,
         ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null:' || coalesce(text, ''))), 1, 13))::bigint::double
           / 4503599627370496.0::double as draw
  from sized join targets on sized.source is not distinct from targets.source
)
select doc_id, size, source_size, target,
       (size * (floor(rate)::bigint + case when draw < rate - floor(rate) then 1 else 0 end))::bigint as taken,
       (floor(rate)::bigint + case when draw < rate - floor(rate) then 1 else 0 end)::bigint as copies
from rated""",
    "op3_exact_topk": """
with points as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
), scored as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from points q join points c on q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5""",
    "op9_quality_rules": """
with docs as (
  select doc_id, source, coalesce(text, '') as text from documents
), words as (
  select doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from docs
), spots as (
  select doc_id, unnest(range(1, len(w) - 6)) as i, w from words where len(w) >= 8
), wins as (
  select doc_id, i, array_to_string(w[i:i + 7], ' ') as win from spots
), dup as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, win) as n from wins) where n > 1
), repeats as (
  select doc_id, sum(least(8, coalesce(nxt - i, 8)))::bigint as n_repeat_words
  from (select *, lead(i) over (partition by doc_id order by i) as nxt from dup) group by doc_id
), lines as (
  select doc_id, source, text, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) as line from docs
), hashed as (
  select doc_id, source, text, line,
         len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as n,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') as h
  from lines
), seen as (
  select source, h, count(distinct text) as seen from hashed group by source, h
), hosts as (
  select source, count(distinct text) as docs from docs group by source
), boiler as (
  select seen.source, seen.h from seen join hosts on seen.source is not distinct from hosts.source
  where seen > 10 and seen > docs * 0.01::double
), lost as (
  select doc_id, sum(n)::bigint as n from hashed join boiler using (h) where hashed.source is not distinct from boiler.source group by doc_id
), dups as (
  select doc_id, (count(*) - count(distinct line))::bigint as n_dup_lines from lines group by doc_id
), stats as (
  select doc_id, len(w)::bigint as n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         coalesce(lost.n, 0) as n_boilerplate_words
  from words left join dups using (doc_id) left join repeats using (doc_id) left join lost using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words
            or n_words - n_boilerplate_words < 20 or (n_words - n_boilerplate_words) * 100 < n_words * 50) as kept,
       n_boilerplate_words
from stats""",
    "op5_chat_format": """
select conv_id, turn, coalesce(role, '') as role, turn as anchor, 0::int as level, false as is_result,
       0::bigint as n_calls, 0::bigint as n_answered, 0::bigint as n_invalid, 'plain' as status, '' as errors,
       '{"content":' || to_json(coalesce(text, ''))::varchar || ',"role":' || to_json(coalesce(role, ''))::varchar || '}' as message
from conversations""",
    "op11_suffix_dedup": registry_sql.SUFFIX_DEDUP,
    "op12_source_divergence": registry_sql.SOURCE_DIVERGENCE,
    "op13_vector_codes": registry_sql.VECTOR_CODES,
}
