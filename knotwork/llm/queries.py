"""Queries of the corpus operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, linededup, packing, pieces, repeats, shingles, tokens, toxicity, vectors


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark, sf_dir):
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_exact_top_k(spark, sf_dir):
    return vectors.top_k(_table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark, sf_dir):
    return tokens.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_language_id(spark, sf_dir):
    return langid.held_out_language_id(_table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark, sf_dir):
    return shingles.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_suffix_dedup(spark, sf_dir):
    """The contract's columns judge strings of 400 bytes; n_passages and clean_text also passages of over 50 words."""
    return repeats.without_repeats(_table(spark, sf_dir, "documents"), words=51).drop("kept")


def op7_sampled_pieces(spark, sf_dir):
    return pieces.sampled_pieces(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), with_ids=False)


def op8_toxicity(spark, sf_dir):
    return toxicity.held_out_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_length_buckets(spark, sf_dir):
    return packing.pack_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_line_dedup(spark, sf_dir):
    return linededup.line_dedup(_table(spark, sf_dir, "documents"), min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_exact_top_k, op3_token_counts, op4_language_id, op5_jaccard_join, op6_suffix_dedup, op7_sampled_pieces, op8_toxicity, op9_length_buckets, op10_line_dedup)}

ORACLE = {
    "op2_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
}
