"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all runs in one process (tests), one of our own. On a cluster the setting must be there."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="knotwork-")
    return _OWN_DIR[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already; the shared folder's owner cleans up
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/knotwork/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out.knotwork_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table behind a frame from stored() that nothing reads any more."""
    if getattr(df, "knotwork_path", None):
        _delete(df.sparkSession, df.knotwork_path)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges(u, v) by alternating large-star and small-star rounds.

    Returns (node, component), component being the smallest node; nodes without an edge to another don't appear. The
    number of rounds is logarithmic in the length of a path, and each round is a hash aggregation with partial sums
    and a join whose hot side can be split. Self-links and repeated links don't matter.
    """
    cur = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name)
    if cur.isEmpty():
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = stored(small.unionByName(mins.select("u", F.col("m").alias("v"))).distinct(), name)
        state = tuple(nxt.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first())
        dropped(cur)
        cur = nxt
        if state == seen:
            return cur.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = state
