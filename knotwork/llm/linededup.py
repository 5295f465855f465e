"""Line dedup by a deletion-neighbourhood join; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A list of candidate lines up to so many rows (8 bytes each) is broadcast, a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("rk", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _half(n: F.Column) -> F.Column:
    return F.when(n < 16, F.floor(n / 2)).otherwise(F.floor(n / 16) * 8).cast("int")


def _half_keys(line: F.Column, n: F.Column) -> F.Column:
    """(side, key) of which two lines within one edit share one: an edit leaves the first or the last H characters as they are.

    H is half the length, from 16 characters on in steps of 8. A key names the length of the shorter line of the pairs it is for, so a line
    has keys for its own length and for its length less one; lines that share a key differ in length by one at most.
    """
    keys = []
    for less in (0, 1):
        h = _half(n - less)
        for side, part in ((0, F.left(line, h)), (1, F.right(line, h))):
            keys.append(F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(side), n - less, part).alias("k")))
    return F.array(*keys)


def kept_lines(docs: DataFrame, min_chars: int = 24) -> DataFrame:
    """(rk, line_no) of the lines that stay, of docs(doc_id, text, rk); see line_dedup."""
    lines = _lines(docs)
    short = lines.filter(F.length("line") < min_chars).select("rk", "line_no")
    long = lines.filter(F.length("line") >= min_chars).withColumn("h", F.xxhash64("line")).withColumn("pos", F.struct("doc_id", "rk", "line_no"))
    # Which distinct lines have a partner with which they share a key: longs only, summed up before the shuffle.
    keys = long.select("h", F.explode(_half_keys(F.col("line"), F.length("line"))).alias("x")).select("h", "x.side", "x.k").groupBy("k", "side", "h").agg(F.lit(1).alias("one"))
    hot = keys.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("k")
    cand = keys.join(hot, "k").groupBy("h").agg((F.max(1 - F.col("side")) == 1).alias("tail"), (F.max("side") == 1).alias("head"))
    cand = stored(cand, "lines-cand")
    n = cand.count()
    own = long.select("h", "line", "pos").join(F.broadcast(cand) if n <= BROADCAST_ROWS else cand, "h").groupBy("h", "head", "tail").agg(F.min("pos").alias("pos"), F.min("line").alias("line"))
    own = stored(own, "lines-own").repartition("h")
    # Deletion neighbourhood: at = 0 is the line itself, at = i the line without its i-th character. Where the first H
    # characters are shared, the edit is behind them, and so for the last. Four bytes a character, so that cuts need no scan.
    size = F.length("line")
    wide = own.withColumn("w", F.encode("line", "UTF-32")).withColumn("n", size).withColumn("h0", _half(size - 1))
    places = F.filter(F.sequence(F.lit(0), F.col("n")), lambda i: (i == 0) | (F.col("tail") & (i > F.col("h0"))) | (F.col("head") & (i <= F.col("n") - F.col("h0"))))
    cut = lambda i: F.xxhash64(F.when(i == 0, F.col("w")).otherwise(F.concat(F.substring("w", F.lit(1), 4 * i - 4), F.substring("w", 4 * i + 1, 4 * F.col("n")))))
    var = wide.select("h", "pos", F.explode(F.transform(places, lambda i: F.struct(i.alias("at"), cut(i).alias("v")))).alias("x")).select("h", "pos", "x.at", "x.v")
    var = stored(var, "variants")
    e = F.struct("pos", "h")
    # One substitution: equal variants at one place. The earliest of the group stands for all that come later.
    same = var.filter("at > 0").groupBy("v", "at").agg(F.min(e).alias("e"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("v", "at", "e")
    # One insertion or deletion: a line equal to a variant of a longer one.
    whole = var.filter("at = 0").select("v", e.alias("w"))
    dels = var.filter("at > 0").select("v", e.alias("d")).join(whole, "v")
    edges = (
        var.filter("at > 0").join(same, ["v", "at"]).select("h", "pos", "e")
        .unionByName(dels.select(F.col("d.h").alias("h"), F.col("d.pos").alias("pos"), F.col("w").alias("e")))
        .unionByName(dels.select(F.col("w.h").alias("h"), F.col("w.pos").alias("pos"), F.col("d").alias("e")))
        .filter("e.pos < pos").select("h", F.col("e.h").alias("g")).distinct()
    )
    text = own.select("h", "line")
    near = edges.join(text, "h").join(text.select(F.col("h").alias("g"), F.col("line").alias("other")), "g").filter(F.levenshtein("line", "other", 1) >= 0).select("h").distinct()
    first = long.groupBy("h").agg(F.min("pos").alias("pos")).join(near, "h", "left_anti")
    return first.select("pos.rk", "pos.line_no").unionByName(short)


def line_dedup(docs: DataFrame, min_chars: int = 24) -> DataFrame:
    """docs, all columns kept, with text cut to the lines that stay, and n_lines and n_dropped.

    min_chars = 1 compares all lines but empty ones. A line of min_chars characters or more goes if an equal line, or one within one edit (insertion, deletion or
    substitution of a character), comes earlier by (doc_id, key of the row, line number), nulls first. Shorter lines
    stay. Lines end at line feeds. A null text stays null with 0 lines; a text that loses every line becomes
    empty. Rows equal in doc_id and text come back equal. Columns n_lines and n_dropped of docs are replaced; all others are kept.
    """
    text = F.col("text").cast("string")
    key = F.xxhash64(F.col("doc_id").cast("long"), text)
    kept = kept_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("rk")), min_chars)
    per = kept.groupBy("rk").agg(F.array_sort(F.collect_set("line_no")).alias("__keep")).withColumnRenamed("rk", "__rk")
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    out = docs.select(*own).withColumn("__rk", key).join(per, "__rk", "left").withColumn("__lines", F.split(text, "\n", -1))
    rebuilt = F.array_join(F.transform(F.coalesce("__keep", F.array().cast("array<int>")), lambda i: F.get("__lines", i)), "\n")
    total = F.when(text.isNull(), 0).otherwise(F.size("__lines")).cast("long")
    left = F.coalesce(F.size("__keep"), F.lit(0)).cast("long")
    return out.select(*[F.when(text.isNotNull(), rebuilt).alias("text") if c == "text" else F.col(c) for c in own], total.alias("n_lines"), F.greatest(F.lit(0).cast("long"), total - F.when(F.col("__keep").isNull(), 0).otherwise(left)).alias("n_dropped"))
