"""Cleaning pipeline over documents: toxicity, line dedup, n-gram Jaccard join, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of documents. Stages are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import linededup, packing, repeats, shingles, toxicity
from knotwork.llm.common import stored
from knotwork.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew where text may have changed."""
    return df.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length but empty ones that come earlier, up to one edit, go from texts; a document that had lines and lost all of them goes."""
    got = linededup.line_dedup(docs, min_chars=1)
    return _as_documents(got.filter("n_lines = 0 or n_dropped < n_lines"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity one stays."""
    return shingles.one_of_each_group(docs.select(*COLUMNS))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, and byte strings of 400 bytes and more, that occur elsewhere go from texts; a document that loses all its text goes."""
    had = docs.select(*COLUMNS)
    got = repeats.cut_repeats(had, words=51)
    return _as_documents(got.filter((F.col("text").isNull()) | (F.col("text") != "") | (F.col("n_chars") == 0)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in buckets by length in tokens and token-budget batches."""
    return packing.pack_tokens(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("jaccard join", one_per_group), ("suffix dedup", cut_passages), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents of sf_dir, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
