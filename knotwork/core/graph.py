"""The graph: two DataFrames and metadata.

vertices(vid, name, ...) and arcs(slot, src, dst, len, ...); slot is an arc's ordinal, an undirected edge being two arcs on
consecutive slots. Adjacency order is newest edge first, inside an edge lower slot first.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import stored

ID_LENGTH = 160


class PanicError(ValueError):
    """A generator or transformer can't do what it is asked for; code tells why."""

    def __init__(self, code: int, why: str = ""):
        super().__init__(f"panic {code}" + (f": {why}" if why else ""))
        self.code = code


# Panic codes.
ALLOC_FAULT, NO_ROOM, EARLY_DATA_FAULT, LATE_DATA_FAULT, SYNTAX_ERROR, BAD_SPECS, VERY_BAD_SPECS, MISSING_OPERAND, INVALID_OPERAND, IMPOSSIBLE = -1, 1, 10, 11, 20, 30, 40, 50, 60, 90


def compound_id(prefix: str, inner: str, suffix: str) -> str:
    """Lineage id prefix + inner + suffix, inner cut with ...) where the whole would pass 160 characters."""
    room = ID_LENGTH - len(prefix) - len(suffix)
    return prefix + (inner if len(inner) < room else inner[: room - 5] + "...)") + suffix


def double_compound_id(prefix: str, a: str, middle: str, b: str, suffix: str) -> str:
    room = ID_LENGTH - len(prefix) - len(middle) - len(suffix)
    if len(a) + len(b) < room:
        return prefix + a + middle + b + suffix
    half = room // 2
    cut = lambda s, n: s if len(s) < n else s[: n - 5] + "...)"
    return prefix + cut(a, half) + middle + cut(b, (room - 9) // 2 + 4) + suffix


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    arcs: DataFrame
    id: str = ""
    util_types: str = "Z" * 14
    n1: int | None = None
    facts: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    def n(self) -> int:
        return self.vertices.count()

    def m(self) -> int:
        return self.arcs.count()

    def bipartite(self, n1: int) -> Graph:
        """Record the size of the first part and mark vertices by part."""
        return replace(self, n1=n1, vertices=self.vertices.withColumn("part", (F.col("vid") >= n1).cast("int")), util_types=self.util_types[:8] + "I" + self.util_types[9:])

    def adjacency(self) -> DataFrame:
        """arcs with pos, the place in the source's list: newest edge first."""
        return self.arcs.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.floor(F.col("slot") / 2)), "slot")) - 1)

    def lookup(self, names: DataFrame) -> DataFrame:
        """vid of each name in names(name)."""
        return names.join(self.vertices.select("name", "vid"), "name")

    def mated(self) -> DataFrame:
        """arcs with the length of the mate, the other arc of the same edge."""
        other = self.arcs.select((F.col("slot").bitwiseXOR(F.lit(1))).alias("slot"), F.col("len").alias("mate_len"))
        return self.arcs.join(other, "slot")


def edges_to_arcs(edges: DataFrame, order: list) -> DataFrame:
    """Two arcs for each undirected edge(u, v, len, ...), numbered in the given order; the lower end owns the first slot."""
    k = numbered(edges, order, "__k")
    both = F.explode(F.array(F.struct((2 * F.col("__k")).alias("slot"), F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")), F.struct((2 * F.col("__k") + 1).alias("slot"), F.greatest("u", "v").alias("src"), F.least("u", "v").alias("dst"))))
    return k.withColumn("__a", both).select("__a.slot", "__a.src", "__a.dst", *[c for c in edges.columns if c not in ("u", "v")])


def ordered_arcs(arcs: DataFrame, order: list) -> DataFrame:
    """Directed arcs (u, v, len, ...) numbered in the given order."""
    return numbered(arcs, order, "slot").select("slot", F.col("u").alias("src"), F.col("v").alias("dst"), *[c for c in arcs.columns if c not in ("u", "v")])


def numbered(df: DataFrame, order: list, column: str) -> DataFrame:
    """df with 0, 1, 2, ... in the given order, which must be total for the numbers to be the same each time.

    Sorted by ranges and written once; the counts of the ranges (one number a partition) give each its first number, so no task sorts or counts all rows.
    """
    t = stored(df.orderBy(*order).withColumn("__i", F.monotonically_increasing_id()), "numbered")
    per = sorted(tuple(r) for r in t.groupBy(F.shiftright("__i", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    first, total = [], 0
    for part, n in per:
        first.append((part, total))
        total += n
    base = df.sparkSession.createDataFrame(first, "__p long, __first long")
    return t.withColumn("__p", F.shiftright("__i", 33)).join(F.broadcast(base), "__p").withColumn(column, F.col("__first") + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__first", "__i")


def graph_from_edges(spark: SparkSession, names: list[str], edges: list[tuple[int, int, int]], id: str = "", directed: bool = False) -> Graph:
    """A small graph from driver lists, arcs numbered in list order."""
    v = spark.createDataFrame(list(enumerate(names)), "vid long, name string")
    e = spark.createDataFrame([(k, *x) for k, x in enumerate(edges)], "k long, u long, v long, len long")
    return Graph(v, (ordered_arcs(e, ["k"]) if directed else edges_to_arcs(e, ["k"])).drop("k"), id)
