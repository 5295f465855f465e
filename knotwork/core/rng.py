"""The portable random stream: x[n] = (x[n-55] - x[n-24]) mod 2^31, and ranking with random ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOD = 1 << 31


class Stream:
    """Subtractive lagged generator with lags 55 and 24. The seed sets up the table by 21-step strides; five rounds warm it up."""

    def __init__(self, seed: int):
        prev, nxt = seed % MOD, 1
        low = prev
        table = [0] * 56
        table[55] = low
        spin = low
        at = 21
        while at:
            table[at] = nxt
            nxt = (prev - nxt) % MOD
            spin = (spin >> 1) + (0x40000000 if spin & 1 else 0)
            nxt = (nxt - spin) % MOD
            prev = table[at]
            at = (at + 21) % 55
        self.table = table
        for _ in range(5):
            self._round()
        self.left = 54  # the last warm-up round hands out its top number

    def _round(self) -> None:
        t = self.table
        for i in range(1, 56):
            t[i] = (t[i] - t[i + 31 if i <= 24 else i - 24]) % MOD

    def next(self) -> int:
        """A number in [0, 2^31). A round's numbers are handed out from the last place down."""
        if not self.left:
            self._round()
            self.left = 55
        x = self.table[self.left]
        self.left -= 1
        return x

    def below(self, m: int) -> int:
        """Uniform in [0, m): draws in the uneven tail are thrown away."""
        limit = MOD - MOD % m
        while True:
            r = self.next()
            if r < limit:
                return r % m


def draws(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """draws(k, r): the first n numbers of a stream. The stream is sequential, so the driver makes it; callers keep n to their row bounds."""
    s = Stream(seed)
    return spark.createDataFrame([(k, s.next()) for k in range(n)], "k long, r long")


def linksort(items: Sequence[tuple[int, object]], stream: Stream) -> list:
    """Items of a list (key, value) by falling key, ties at random as the portable sort breaks them.

    The first 8 bits drawn for each item in list order, and 8 more drawn in the order of the first, decide: falling key,
    then falling second bits, then rising first bits, then list order.
    """
    n = len(items)
    k1 = [stream.next() >> 23 for _ in range(n)]
    k2 = [0] * n
    for pos in sorted(range(n), key=lambda p: (-k1[p], -p)):
        k2[pos] = stream.next() >> 23
    return [items[p] for p in sorted(range(n), key=lambda p: (-items[p][0], -k2[p], k1[p], p))]


def linksort_frame(items: DataFrame, draws: DataFrame) -> DataFrame:
    """items(pos, key, ...) with rank, by the same rule as windows over a draws(k, r) table of 2n rows."""
    n = items.count()
    a = items.join(draws.select(F.col("k").alias("pos"), F.shiftright("r", 23).alias("k1")), "pos")
    a = a.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("k1"), F.desc("pos"))) - 1 + n)
    b = a.join(draws.select(F.col("k").alias("turn"), F.shiftright("r", 23).alias("k2")), "turn").drop("turn")
    return b.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("key"), F.desc("k2"), "k1", "pos")) - 1).cast("long"))
