"""Packing by optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lengths up to EXACT have a bin each; beyond, each power of two has EXACT / 2 bins, so that the histogram stays bounded.
EXACT = 4096


def bin_of(length: F.Column) -> F.Column:
    """Upper edge of the histogram bin of a length: the length itself up to EXACT, at most 1/2048 more beyond."""
    shift = F.greatest(F.lit(0), F.length(F.bin(length)) - 12)
    step = F.pow(F.lit(2.0), shift).cast("long")
    return F.when(length <= EXACT, length).otherwise(((length + step - 1) / step).cast("long") * step)


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket upper bounds (ascending, the last the largest length) minimising sum(count * (bound - length)).

    Dynamic program over distinct lengths; best[j] of k buckets = min over i of best[i] of k - 1 buckets plus the
    padding of (i, j]. That cost satisfies the quadrangle inequality, so the best i never decreases in j and divide
    and conquer takes n log n steps a bucket. Of equal totals the fewest buckets and the smallest bounds win.
    """
    n = len(lengths)
    if not n:
        return []
    length, c = lengths.astype(np.float64), np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    s = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.float64)
    best = np.concatenate([[0], length * c[1:] - s[1:]])
    back, value = [], best[n]
    for _ in range(1, min(buckets, n)):
        new, arg = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            a, b, lo, hi = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(lo, min(hi, j - 1) + 1)
            cost = best[i] + length[j - 1] * (c[j] - c[i]) - (s[j] - s[i])
            k = int(np.argmin(cost))
            new[j], arg[j] = cost[k], i[k]
            todo += [(a, j - 1, lo, int(i[k])), (j + 1, b, int(i[k]), hi)]
        if new[n] >= value:
            break
        back.append(arg)
        best, value = new, new[n]
    out, j = [], n
    for arg in [*back[::-1], np.zeros(n + 1, np.int64)]:
        out.append(int(lengths[j - 1]))
        j = int(arg[j])
        if not j:
            break
    return out[::-1]


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 65_536, shards: int = 64, length: F.Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch_id, slot, padding of each row of docs(doc_id, text).

    length: tokens of a row (default: its words between white space; pack_tokens has a tokenizer's); null or empty text has 0. The histogram is counted
    over all rows and comes to the driver in at most 4096 + 2048 bins a power of two. A batch holds
    floor(token_budget / bucket_len) rows, one at least, so rows * bucket_len stays within the budget unless one
    row alone exceeds it. Rows are numbered by (hash of the row, doc_id) inside a bucket over shards: counts of shards give each
    shard's first number, so no bucket is sorted in one task, and only a bucket's last batch may be short.
    Equal rows get numbers of their own; an empty table gives an empty result; other columns are not read.
    """
    text = F.col("text").cast("string")
    n = length if length is not None else F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")))
    return _packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(n, F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("doc_id", text).alias("h")), buckets, token_budget, shards)


def pack_tokens(docs: DataFrame, tokenizer: str, buckets: int = 16, token_budget: int = 65_536, shards: int = 64) -> DataFrame:
    """As pack, by the tokens of each text under a tokenizer file; see token_counts. The hash of a row is that of its number and counts."""
    from .tokens import token_counts

    counts = token_counts(docs, tokenizer)
    return _packed(counts.select("doc_id", "n_tokens", F.xxhash64("doc_id", "n_bytes", "n_tokens").alias("h")), buckets, token_budget, shards)


def _packed(rows: DataFrame, buckets: int, token_budget: int, shards: int) -> DataFrame:
    """pack of rows(doc_id, n_tokens, h)."""
    from .common import stored

    rows = stored(rows.withColumn("edge", bin_of(F.col("n_tokens"))).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")), "lengths")
    hist = sorted((r["edge"], r["n"]) for r in rows.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).collect())
    bounds = boundaries(np.array([a for a, _ in hist], np.int64), np.array([b for _, b in hist], np.int64), buckets)
    bucket = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("edge") <= bounds[k], k).otherwise(bucket)
    edges = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array(F.lit(0).cast("long"))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    per = rows.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    first = per.withColumn("base", F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).select("bucket", "shard", "base")
    at = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("h", "doc_id")) - 1
    out = rows.withColumn("at", at).join(F.broadcast(first), ["bucket", "shard"])  # at most buckets * shards rows
    out = out.withColumn("bucket_len", F.element_at(edges, F.col("bucket") + 1)).withColumn("pos", F.col("base") + F.col("at"))
    per_batch = F.when(F.col("bucket_len") > 0, F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_len")))).otherwise(F.lit(token_budget)).cast("long")
    return out.withColumn("per", per_batch).select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("pos") / F.col("per")).cast("long").alias("batch_id"), (F.col("pos") % F.col("per")).cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding")
    )
