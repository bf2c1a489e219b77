"""The registered corpus queries: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.llm import chats, hamming, minhash, mixing, neighbours, packing, private, quality, toxicity
from marketlab.llm._spark import table
from marketlab.llm.substrings import remove_repeats


def op1_topk_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every fiftieth vector, among all vectors, itself included."""
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    found = hamming.top_k(codes, codes.where("id % 50 = 0"), k=10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), "distance")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.collapse_and_render(table(spark, sf_dir, "conversations"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.detect(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", "text"), F.array("source"), mixing.word_count(F.col("text")))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken")
    )


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_hamming": op1_topk_hamming,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_chat_format": op4_chat_format,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_pii": op6_pii,
    "op7_mixing": op7_mixing,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_packing": op9_packing,
    "op10_embedding_dedup": op10_embedding_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_hamming": """
with v as (select vec_id, embedding from embeddings where embedding is not null),
d as (
  select q.vec_id as query_id, v.vec_id,
    cast(list_sum(list_transform(range(1, 65), lambda i: cast(coalesce(q.embedding[i] > 0, false) <> coalesce(v.embedding[i] > 0, false) as int))) as bigint) as distance
  from v q, v where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d)
select query_id, rank, vec_id, distance from r where rank <= 10
""",
    "op4_chat_format": chats.SQL,
    "op5_substring_dedup": """
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words
  from documents),
win as (
  select r, s, md5(array_to_string(words[s:s + 34], ' ')) as h
  from (select r, words, unnest(range(1, len(words) - 33)) as s from d where len(words) >= 35)),
repeated as (select h from win group by h having count(*) > 1),
gone as (
  select distinct r, s + k as at
  from (select r, s, unnest(range(0, 35)) as k from win where h in (select h from repeated))),
w as (select r, unnest(words) as word, generate_subscripts(words, 1) as at from d),
kept as (
  select w.r, count(*) as n, string_agg(w.word, ' ' order by w.at) as text
  from w left join gone on w.r = gone.r and w.at = gone.at where gone.at is null group by w.r)
select doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept on d.r = kept.r
""",
    "op7_mixing": mixing.SQL,
    "op10_embedding_dedup": """
with recursive v as (select row_number() over () as r, vec_id, cast(embedding as double[]) as e from embeddings),
ok as (
  select r, e from v
  where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and coalesce(list_sum(list_transform(e, lambda x: x * x)), 0) > 0),
l as (
  select a.r as a, b.r as b from ok a, ok b
  where a.r <> b.r and case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) >= 0.9 else false end),
reach(r, other) as (select r, r from v union select reach.r, l.b from reach join l on l.a = reach.other),
c as (select reach.r, min(v.vec_id) as component_id from reach join v on v.r = reach.other group by reach.r),
n as (select a as r, count(*) as n from l group by a)
select v.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, c.component_id, v.vec_id is not distinct from c.component_id as kept
from v join c on v.r = c.r left join n on v.r = n.r
""",
}
