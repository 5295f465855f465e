"""Parameterised graphs. Vertex sets come from ranges and closed forms on the executors, small enumerations from the driver."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.graph import BAD_SPECS, INVALID_OPERAND, MISSING_OPERAND, VERY_BAD_SPECS, Graph, PanicError, compound_id, edges_to_arcs, numbered, ordered_arcs
from ..core.rng import MOD, Stream

MAX_CELLS = 1_000_000_000
MAX_D = 91


def spread(sizes: tuple[int, int, int, int], default: tuple[int, ...] = (8, 8)) -> list[int]:
    """Sizes of the coordinates: positive ones in order; the first that isn't positive ends the list, and -d asks for d coordinates by repeating them."""
    if sizes[0] <= 0:
        sizes = (*default, *(0,) * (4 - len(default)))
    out: list[int] = []
    for s in sizes:
        if s > 0:
            out.append(s)
            continue
        d = -s
        if d > MAX_D:
            raise PanicError(BAD_SPECS)
        if d:
            out = [out[i % len(out)] for i in range(d)]
        break
    cells = 1
    for s in out:
        cells *= s
    if cells > MAX_CELLS:
        raise PanicError(BAD_SPECS + 1)
    return out


def move_vectors(d: int, length: int) -> list[tuple[int, ...]]:
    """Integer vectors of that squared length whose first nonzero component is positive."""
    root = int(length**0.5) + 1
    def squares(k: int, left: int):
        if not k:
            if not left:
                yield ()
            return
        for x in range(-root, root + 1):
            if x * x <= left:
                for rest in squares(k - 1, left - x * x):
                    yield (x, *rest)
    return [v for v in squares(d, length) if next((x for x in v if x), 0) > 0]


def board(spark: SparkSession, n1: int = 0, n2: int = 0, n3: int = 0, n4: int = 0, piece: int = 1, wrap: int = 0, directed: bool = False) -> Graph:
    """Cells of a board joined by a piece's moves of squared length |piece|; a negative piece rides on, len counting its steps.

    Bit k of wrap makes coordinate k cyclic. A ride ends off the board or where it began. Each move goes one way from
    the executors' point of view: cells x move vectors x steps, filtered by the bounds, without a join.
    """
    sizes = spread((n1, n2, n3, n4))
    piece = piece or 1
    d = len(sizes)
    total = 1
    for s in sizes:
        total *= s
    cell = spark.range(total).withColumnRenamed("id", "vid")
    stride, coords = total, []
    for s in sizes:
        stride //= s
        coords.append((F.floor(F.col("vid") / stride) % s).cast("long"))
    vertices = cell.select("vid", F.concat_ws(".", *(c.cast("string") for c in coords)).alias("name"), *(c.alias(x) for c, x in zip(coords, "xyz", strict=False)))
    moves = move_vectors(d, abs(piece))
    id = f"board({n1},{n2},{n3},{n4},{piece},{wrap},{int(directed)})"
    if not moves:
        return Graph(vertices, spark.createDataFrame([], "slot long, src long, dst long, len long"), id, "ZZZIIIZZZZZZZZ")
    wraps = [bool(wrap >> k & 1) for k in range(d)]
    # a ride is over after as many steps as bring every cyclic coordinate home, or cross the longest one
    import math

    def steps(v):
        ends = [s for s, x, w in zip(sizes, v, wraps, strict=True) if x and not w]
        return min(ends) if ends else math.lcm(*(s // math.gcd(s, x) for s, x in zip(sizes, v, strict=True) if x))

    mv = F.explode(F.array(*(F.struct(F.lit(k).alias("m"), F.array(*map(F.lit, v)).alias("v"), F.lit(steps(v) if piece < 0 else 1).alias("top")) for k, v in enumerate(moves))))
    x = cell.select("vid", *(c.alias(f"c{k}") for k, c in enumerate(coords))).withColumn("mv", mv).withColumn("len", F.explode(F.sequence(F.lit(1), F.col("mv.top"))))
    to, inside = F.lit(0).cast("long"), F.lit(True)
    for k, (s, w) in enumerate(zip(sizes, wraps, strict=True)):
        y = F.col(f"c{k}") + F.col("mv.v")[k] * F.col("len")
        if w:
            y = F.pmod(y, F.lit(s))
        else:
            inside = inside & (y >= 0) & (y < s)
        to = to * s + y
    e = x.filter(inside).select(F.col("vid").alias("u"), to.cast("long").alias("v"), F.col("len").cast("long").alias("len"), F.col("mv.m").alias("m"))
    if piece < 0:
        e = e.filter("u <> v")
    order = ["m", "u", "len"]
    arcs = (ordered_arcs(e, order) if directed else edges_to_arcs(e, order)).drop("m")
    return Graph(vertices, arcs, id, "ZZZIIIZZZZZZZZ")


def complete(spark, n):
    return board(spark, n, piece=-1)


def transitive(spark, n):
    return board(spark, n, piece=-1, directed=True)


def empty(spark, n):
    return board(spark, n, piece=2)


def circuit(spark, n):
    return board(spark, n, piece=1, wrap=1)


def cycle(spark, n):
    return board(spark, n, piece=1, wrap=1, directed=True)


def bi_complete(spark: SparkSession, n1: int, n2: int, directed: bool = False) -> Graph:
    """Every vertex of the first part joined to every one of the second."""
    v = spark.range(n1 + n2).select(F.col("id").alias("vid"), F.when(F.col("id") < n1, F.format_string("0:%d", "id")).otherwise(F.format_string("1:%d", F.col("id") - n1)).alias("name"))
    e = spark.range(n1).select(F.col("id").alias("u")).crossJoin(spark.range(n1, n1 + n2).select(F.col("id").alias("v"))).withColumn("len", F.lit(1).cast("long"))
    arcs = (ordered_arcs if directed else edges_to_arcs)(e, ["u", "v"])
    return Graph(v, arcs, f"bi_complete({n1},{n2},{int(directed)})").bipartite(n1)


def wheel(spark: SparkSession, n: int, hubs: int = 1, directed: bool = False) -> Graph:
    """A ring of n vertices, each joined to all hubs; hubs have the last numbers."""
    ring = spark.range(n).select(F.col("id").alias("u"), ((F.col("id") + 1) % n).alias("v"))
    spokes = spark.range(n, n + hubs).select(F.col("id").alias("u")).crossJoin(spark.range(n).select(F.col("id").alias("v")))
    e = ring.unionByName(spokes).withColumn("len", F.lit(1).cast("long"))
    v = spark.range(n + hubs).select(F.col("id").alias("vid"), F.col("id").cast("string").alias("name"))
    return Graph(v, (ordered_arcs if directed else edges_to_arcs)(e, ["u", "v"]), f"wheel({n},{hubs},{int(directed)})")


def bounds_of(n: int, n0: int = 0, n1: int = 0, n2: int = 0, n3: int = 0, n4: int = 0) -> list[int]:
    """Upper bounds of the coordinates of a composition of n, by the list rule of the sizes; a first entry of 0 means -2."""
    n0 = n0 or -2
    if n0 < 0:
        return [n] * (1 - n0)
    out = []
    for s in (n0, n1, n2, n3, n4):
        if s > 0:
            out.append(min(s, n))
            continue
        if s < 0:
            out = [out[i % len(out)] for i in range(1 - s)]
        break
    if len(out) > MAX_D:
        raise PanicError(BAD_SPECS)
    return out


def compositions(n: int, bounds: list[int]) -> int:
    """How many vectors have sum n and components within bounds: the coefficient of a product of short geometric series."""
    coef = [1] + [0] * n
    for b in bounds:
        run = list(itertools.accumulate(coef))
        coef = [run[j] - (run[j - b - 1] if j > b else 0) for j in range(n + 1)]
    return coef[n]


def _named_arcs(v: DataFrame, e: DataFrame, directed: bool) -> DataFrame:
    """Arcs of edges given by the names of both ends (low, high), numbered in the order of the vertices; the names stay as columns."""
    at = lambda end, col: v.select(F.col("name").alias(end), F.col("vid").alias(col))
    e = e.join(at("low", "u"), "low").join(at("high", "v"), "high").select("u", "v", F.lit(1).cast("long").alias("len"), "low", "high")
    return (ordered_arcs if directed else edges_to_arcs)(e, ["u", "v"])


def _spec(*numbers, room: int = 5) -> str:
    """Parameters of an id, the first ones filled up with zeros."""
    return ",".join(map(str, [*numbers, *[0] * (room - len(numbers))]))


def _vectors(spark: SparkSession, n: int, bounds: list[int]) -> DataFrame:
    """(vid, x, name) of the vectors of sum n within bounds. vid is the place in lexicographic order, summed up coordinate by coordinate from the numbers of vectors that begin lower."""
    if compositions(n, bounds) > MAX_CELLS:
        raise PanicError(BAD_SPECS + 1)
    v = spark.range(1).select(F.array().cast("array<long>").alias("x"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("vid"))
    for k, b in enumerate(bounds):
        after = bounds[k + 1 :]
        ways = [compositions(n - t, after) for t in range(n + 1)]
        below = F.array(*(F.lit(x).cast("long") for x in itertools.accumulate(ways, initial=0)))  # ways to end from a lower total
        v = v.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(b).cast("long"), n - F.col("t")))))
        v = v.filter(n - F.col("t") - F.col("c") <= sum(after)).select(F.concat("x", F.array("c")).alias("x"), (F.col("t") + F.col("c")).alias("t"), (F.col("vid") + F.get(below, (F.col("t") + F.col("c")).cast("int")) - F.get(below, F.col("t").cast("int"))).alias("vid"))
    return v.select("vid", "x", F.array_join(F.transform("x", lambda c: c.cast("string")), ".").alias("name"))


def simplex(spark: SparkSession, n: int, *sizes: int, directed: bool = False) -> Graph:
    """Vectors of sum n within bounds, in lexicographic order, joined where one unit moves between two coordinates.

    Vectors grow by one coordinate at a time on the executors; partial sums that can't reach n are dropped as they appear.
    """
    bounds = bounds_of(n, *sizes)
    v = _vectors(spark, n, bounds)
    moved = F.explode(F.array(*(F.array(*((F.col("x")[i] + (1 if i == a else -1 if i == b else 0)).cast("long") for i in range(len(bounds)))) for a in range(len(bounds)) for b in range(len(bounds)) if a > b)))
    to = v.select("name", moved.alias("y")).filter(F.forall("y", lambda c: c >= 0)).withColumn("to", F.array_join(F.transform("y", lambda c: c.cast("string")), "."))
    e = to.select(F.col("to").alias("low"), F.col("name").alias("high"))
    return Graph(v, _named_arcs(v, e, directed), f"simplex({n},{_spec(*sizes)},{int(directed)})", "VVZIIIZZZZZZZZ")


def subsets(spark: SparkSession, n: int, *sizes: int, size_bits: int = 1, directed: bool = False) -> Graph:
    """The vectors of simplex, joined (u <= v) where bit s of size_bits is set for s the sum of componentwise minima. All pairs are compared, by definition."""
    v = _vectors(spark, n, bounds_of(n, *sizes))
    w = v.select(F.col("x").alias("y"), F.col("name").alias("other"))
    meet = F.aggregate(F.zip_with("x", "y", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda s, c: s + c)
    e = v.join(w, F.col("name") <= F.col("other")).withColumn("s", meet).filter(F.expr(f"shiftright(cast({size_bits} as bigint), cast(s as int)) & 1 = 1"))
    return Graph(v, _named_arcs(v, e.select(F.col("name").alias("low"), F.col("other").alias("high")), directed), f"subsets({n},{_spec(*sizes)},{size_bits:#x},{int(directed)})", "ZZZIIIZZZZZZZZ")


def disjoint_subsets(spark: SparkSession, n: int, k: int) -> Graph:
    """The k-element subsets of n things, joined where they are disjoint."""
    return subsets(spark, k, 1, 1 - n, size_bits=1)


def petersen(spark):
    return disjoint_subsets(spark, 5, 2)


def perms(spark: SparkSession, counts: list[int], max_inv: int | None = None, directed: bool = False) -> Graph:
    """Arrangements of a multiset (counts[i] copies of letter i) with at most max_inv inversions, joined by swaps of neighbours.

    Words grow letter by letter on the executors; a letter adds one inversion for each larger one before it.
    """
    total = sum(counts)
    top = sum(a * b for a, b in itertools.combinations(counts, 2))
    max_inv = top if max_inv is None or max_inv <= 0 or max_inv > top else max_inv
    v = spark.range(1).select(F.array().cast("array<int>").alias("x"), F.lit(0).alias("inv"))
    left = F.array(*map(F.lit, counts))
    for _ in range(total):
        used = lambda c: F.size(F.filter("x", lambda y: y == c))
        letters = F.filter(F.sequence(F.lit(0), F.lit(len(counts) - 1)), lambda c: used(c) < F.element_at(left, c + 1))
        v = v.withColumn("c", F.explode(letters)).select(F.concat("x", F.array("c")).alias("x"), (F.col("inv") + F.size(F.filter("x", lambda y: y > F.col("c")))).alias("inv")).filter(F.col("inv") <= max_inv)
    name = lambda x: F.array_join(F.transform(x, lambda c: F.char((c + 48).cast("long"))), "")
    v = numbered(v.select("x", "inv", name("x").alias("name")), ["x"], "vid")
    at = F.explode(F.sequence(F.lit(1), F.lit(total - 1))) if total > 1 else F.explode(F.array().cast("array<int>"))
    swap = v.withColumn("k", at).filter(F.element_at("x", F.col("k")) < F.element_at("x", F.col("k") + 1))
    swapped = F.transform("x", lambda c, i: F.when(i + 1 == F.col("k"), F.element_at("x", F.col("k") + 1)).when(i == F.col("k"), F.element_at("x", F.col("k"))).otherwise(c))
    e = swap.select(F.col("name").alias("low"), name(swapped).alias("high"))
    return Graph(v, _named_arcs(v, e, directed), f"perms({_spec(*counts)},{max_inv},{int(directed)})", "VVZZZZZZZZZZZZ")


def all_perms(spark: SparkSession, n: int, directed: bool = False) -> Graph:
    """The permutations of n letters."""
    return perms(spark, [1] * n, directed=directed)


def parts(spark: SparkSession, n: int, max_parts: int | None = None, max_size: int | None = None, directed: bool = False) -> Graph:
    """Partitions of n (parts falling) in increasing order, joined where splitting one part in two makes the other."""
    max_parts, max_size = (x if x and 0 < x <= n else n for x in (max_parts, max_size))
    if max_parts > MAX_D:
        raise PanicError(BAD_SPECS)
    v = spark.range(1).select(F.array().cast("array<int>").alias("x"), F.lit(n).alias("r"))
    done = []
    for _ in range(min(max_parts, n)):
        top = F.least(F.lit(max_size), F.col("r"), F.when(F.size("x") > 0, F.element_at("x", -1)).otherwise(F.lit(n)))
        v = v.filter("r > 0").withColumn("c", F.explode(F.sequence(F.lit(1), top))).select(F.concat("x", F.array("c")).alias("x"), (F.col("r") - F.col("c")).alias("r"))
        done.append(v.filter("r = 0").select("x"))
    all_ = done[0]
    for x in done[1:]:
        all_ = all_.unionByName(x)
    name = lambda x: F.array_join(F.transform(x, lambda c: c.cast("string")), "+")
    v = numbered(all_.select("x", name("x").alias("name")), ["x"], "vid")
    part = v.withColumn("p", F.explode(F.array_distinct("x"))).filter("p > 1").withColumn("a", F.explode(F.sequence(F.lit(1), F.floor(F.col("p") / 2).cast("int"))))
    at = F.array_position("x", F.col("p")).cast("int")
    rest = F.filter("x", lambda c, i: i + 1 != at)
    split = F.reverse(F.array_sort(F.concat(rest, F.array(F.col("a"), F.col("p") - F.col("a")))))
    e = part.select(F.col("name").alias("low"), name(split).alias("high")).distinct()
    return Graph(v, _named_arcs(v, e, directed), f"parts({n},{max_parts},{max_size},{int(directed)})", "VVZZZZZZZZZZZZ")


def all_parts(spark: SparkSession, n: int, directed: bool = False) -> Graph:
    """All partitions of n."""
    return parts(spark, n, directed=directed)


def binary(spark: SparkSession, n: int, max_height: int | None = None, directed: bool = False) -> Graph:
    """Binary trees with n inner nodes and at most max_height levels of them, as codes of . (inner) and x (leaf), joined by rotations ((a b) c) to (a (b c)).

    Codes grow symbol by symbol on the executors. todo holds, for each subtree still to come, the levels that it may have;
    a code goes as soon as they can't hold the inner nodes that are left.
    """
    max_height = max_height if max_height and 0 < max_height <= n else n
    if max_height > 30:
        raise PanicError(VERY_BAD_SPECS)
    v = spark.range(1).select(F.lit("").alias("name"), F.array(F.lit(max_height)).alias("todo"), F.lit(n).alias("left"))
    room = F.expr("aggregate(todo, 0L, (s, h) -> s + shiftleft(1L, h) - 1L)")
    fits = (room >= F.col("left")) & ((F.size("todo") > 0) | (F.col("left") == 0))
    v = v.filter(fits)
    if 2**max_height - 1 < n:  # known before any code is begun
        v = v.filter("false")
    else:
        for _ in range(2 * n + 1):
            own, rest = F.element_at("todo", 1), F.slice("todo", 2, F.size("todo"))
            v = v.withColumn("c", F.explode(F.array(F.lit("."), F.lit("x")))).filter((F.col("c") == "x") | ((own > 0) & (F.col("left") > 0)))
            v = v.select(F.concat("name", "c").alias("name"), F.when(F.col("c") == ".", F.concat(F.array(own - 1, own - 1), rest)).otherwise(rest).alias("todo"), (F.col("left") - (F.col("c") == ".").cast("int")).alias("left")).filter(fits)
    v = numbered(v.select("name"), ["name"], "vid")
    # deep[i] is the number of inner nodes less that of leaves before place i: a subtree from place i ends where that falls by one
    size = 2 * n + 1
    deep = F.aggregate(F.sequence(F.lit(1), F.lit(size)), F.array(F.lit(0)), lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + F.when(F.substring("name", i, F.lit(1)) == ".", 1).otherwise(-1))))
    inner = F.filter(F.sequence(F.lit(0), F.lit(size - 2)), lambda i: F.substring("name", i + 1, F.lit(2)) == "..") if n > 1 else F.array().cast("array<int>")
    end = lambda i: f"{i} + cast(array_position(slice(deep, {i} + 2, {size}), element_at(deep, {i} + 1) - 1) as int)"
    turned = v.withColumn("deep", deep).withColumn("i", F.explode(inner)).withColumn("j", F.expr("i + 2")).withColumn("a", F.expr(end("j")))
    e = turned.select(F.col("name").alias("low"), F.expr("concat(substring(name, 1, i + 1), substring(name, i + 3, a - i - 2), '.', substring(name, a + 1))").alias("high"))
    return Graph(v, _named_arcs(v, e, directed), f"binary({n},{max_height},{int(directed)})", "VVZZZZZZZZZZZZ")


def all_trees(spark: SparkSession, n: int, directed: bool = False) -> Graph:
    """All binary trees with n inner nodes."""
    return binary(spark, n, directed=directed)


def alias_table(dist: list[int], size: int) -> list[tuple[int, int]]:
    """(cut, alias) of each of size columns, a power of 2 and not under len(dist): a draw of 31 bits falls into the column of its top bits and stands for it up to the cut, for the alias beyond."""
    per = (MOD >> 1) // size
    low: list[tuple[int, int]] = []
    high: list[tuple[int, int]] = []
    for i in reversed(range(size)):
        d = dist[i] if i < len(dist) else 0
        (high if d > per else low).append((d, i))
    out = [(0, 0)] * size
    while high:
        (e, j), (d, i) = high.pop(), low.pop()
        out[i] = 2 * (per * i + d) - 1, j
        e -= per - d
        (high if e > per else low).append((e, j))
    for _, i in low:
        out[i] = 2 * per * (i + 1) - 1, i
    return out


def checked_distribution(dist: list[int], n: int, codes: tuple[int, int, int]) -> None:
    """n nonnegative integers of sum 2^30; panics with the first code at a negative one, the second where the sum passes 2^30, the third where it stays under it or numbers lack."""
    total = 0
    for d in dist[:n]:
        if d < 0:
            raise PanicError(codes[0])
        total += d
        if total > MOD >> 1:
            raise PanicError(codes[1])
    if total != MOD >> 1 or len(dist) < n:
        raise PanicError(codes[2])


def _columns(n: int) -> int:
    return 1 << (n - 1).bit_length()


def picker(stream: Stream, n: int, dist: list[int] | None) -> Callable[[], int]:
    """Draws from 0 to n - 1 out of the stream, uniform or by a distribution of sum 2^30."""
    if dist is None:
        return lambda: stream.below(n)
    size = _columns(n)
    table, shift = alias_table(dist[:n], size), 31 - (size.bit_length() - 1)

    def pick() -> int:
        r = stream.next()
        k = r >> shift
        return k if r <= table[k][0] else table[k][1]

    return pick


def _length_range(min_len: int, max_len: int, wide: int) -> None:
    if max_len < min_len:
        raise PanicError(VERY_BAD_SPECS)
    if max_len - min_len >= MOD:
        raise PanicError(wide)


def _dist_code(dist: list[int] | None) -> str:
    return "0" if dist is None else "dist"


def _sign(x: int) -> int:
    return (x > 0) - (x < 0)


def random_graph(spark: SparkSession, n: int, m: int, multi: int = 0, self_loops: bool = False, directed: bool = False, min_len: int = 1, max_len: int = 1, seed: int = 0, dist_from: list[int] | None = None, dist_to: list[int] | None = None) -> Graph:
    """m random edges or arcs drawn one after another from the portable stream; ends are uniform or by distributions of n integers of sum 2^30.

    multi > 0 keeps repeats, 0 draws again, < 0 keeps the least length. Draws depend on all before them, so the driver makes them;
    random_native has the same distribution on the executors.
    """
    if n < 1:
        raise PanicError(BAD_SPECS)
    _length_range(min_len, max_len, BAD_SPECS + 1)
    for dist, code in ((dist_from, INVALID_OPERAND), (dist_to, INVALID_OPERAND + 5)):
        if dist is not None:
            checked_distribution(dist, n, (code, code + 1, code + 2))
    s = Stream(seed)
    tail, tip = picker(s, n, dist_from), picker(s, n, dist_to)
    out: list[tuple[int, int, int]] = []
    first: dict[tuple[int, int], int] = {}
    left = m
    while left:
        u, v = tail(), tip()
        if u == v and not self_loops:
            continue
        key = (u, v) if directed else (min(u, v), max(u, v))
        if key in first and multi == 0:
            continue
        length = min_len if min_len == max_len else min_len + s.below(max_len - min_len + 1)
        left -= 1
        if key in first and multi < 0:
            i = first[key]
            out[i] = (*key, min(out[i][2], length))
            continue
        first[key] = len(out)
        out.append((*key, length))
    e = spark.createDataFrame([(k, *x) for k, x in enumerate(out)], "k long, u long, v long, len long")
    v = spark.range(n).select(F.col("id").alias("vid"), F.col("id").cast("string").alias("name"))
    id = f"random_graph({n},{m},{_sign(multi)},{int(self_loops)},{int(directed)},{_dist_code(dist_from)},{_dist_code(dist_to)},{min_len},{max_len},{seed})"
    return Graph(v, (ordered_arcs if directed else edges_to_arcs)(e, ["k"]).drop("k"), id)


def native_picks(arcs: DataFrame, column: str, n: int, dist: list[int] | None, seed: int) -> DataFrame:
    """arcs with a column of independent draws from 0 to n - 1, by a distribution of sum 2^30 through its alias table (as long as the distribution given)."""
    if dist is None:
        return arcs.withColumn(column, F.floor(F.rand(seed) * n).cast("long"))
    checked_distribution(dist, n, (INVALID_OPERAND, INVALID_OPERAND + 1, INVALID_OPERAND + 2))
    size = _columns(n)
    table = arcs.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(alias_table(dist[:n], size))], "__k long, __cut long, __alias long")
    drawn = arcs.withColumn("__r", F.floor(F.rand(seed) * MOD).cast("long")).withColumn("__k", F.floor(F.col("__r") / (MOD // size)).cast("long"))
    return drawn.join(table, "__k").withColumn(column, F.when(F.col("__r") <= F.col("__cut"), F.col("__k")).otherwise(F.col("__alias"))).drop("__r", "__k", "__cut", "__alias")


def random_native(spark: SparkSession, n: int, m: int, multi: int = 0, self_loops: bool = False, max_len: int = 1, seed: int = 0, dist_from: list[int] | None = None, dist_to: list[int] | None = None) -> DataFrame:
    """m independent draws on the executors: src, dst, len. multi > 0 keeps repeats, 0 one of them, < 0 the shortest; loops go unless self_loops."""
    e = spark.range(m).withColumn("len", (1 + F.floor(F.rand(seed * 3 + 3) * max_len)).cast("long")).drop("id")
    e = native_picks(native_picks(e, "src", n, dist_from, seed * 3 + 1), "dst", n, dist_to, seed * 3 + 2).select("src", "dst", "len")
    e = e if self_loops else e.filter("src <> dst")
    return e if multi > 0 else e.groupBy("src", "dst").agg(F.min("len").alias("len")) if multi < 0 else e.dropDuplicates(["src", "dst"])


def random_bigraph(spark: SparkSession, n1: int, n2: int, m: int, multi: int = 0, min_len: int = 1, max_len: int = 1, seed: int = 0, dist1: list[int] | None = None, dist2: list[int] | None = None) -> Graph:
    """Random edges between n1 and n2 vertices: a random graph whose tails have the first part's distribution and whose tips have the second's, nearly uniform where none is given."""
    if n1 < 1 or n2 < 1:
        raise PanicError(BAD_SPECS)
    _length_range(min_len, max_len, BAD_SPECS + 1)
    even = lambda n: [((MOD >> 1) + k) // n for k in range(n)]
    tails = list(dist1[:n1] if dist1 is not None else even(n1)) + [0] * n2
    tips = [0] * n1 + list(dist2[:n2] if dist2 is not None else even(n2))
    g = random_graph(spark, n1 + n2, m, multi, False, False, min_len, max_len, seed, tails, tips)
    id = f"random_bigraph({n1},{n2},{m},{_sign(multi)},{_dist_code(dist1)},{_dist_code(dist2)},{min_len},{max_len},{seed})"
    return replace(g, id=id).bipartite(n1)


def random_lengths(g: Graph | None, directed: bool, min_len: int, max_len: int, dist: list[int] | None = None, seed: int = 0) -> Graph:
    """New lengths from the portable stream, drawn in the order of vertices and their lists; unless directed, both arcs of an edge get one draw, that of the lower end.

    dist has max_len - min_len + 1 integers of sum 2^30. The stream is sequential: the driver makes one draw an arc.
    """
    if g is None:
        raise PanicError(MISSING_OPERAND)
    _length_range(min_len, max_len, BAD_SPECS)
    span = max_len - min_len + 1
    if dist is not None:
        checked_distribution(dist, span, (-1, 1, 2))
    s = Stream(seed)
    pick = (lambda: 0) if dist is None and span == 1 else picker(s, span, dist)
    a = g.adjacency().select("slot", "src", "pos")
    own = numbered(a if directed else a.filter(F.col("slot") % 2 == 0), ["src", "pos"], "turn")
    table = g.spark.createDataFrame([(k, min_len + pick()) for k in range(own.count())], "turn long, l long")
    new = own.join(table, "turn").select(F.col("slot") if directed else F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot"), "l")
    id = compound_id("random_lengths(", g.id, f",{int(directed)},{min_len},{max_len},{_dist_code(dist)},{seed})")
    return replace(g, arcs=g.arcs.drop("len").join(new, "slot").withColumnRenamed("l", "len"), id=id)


def _residue(x: int, q: int) -> bool:
    return pow(x, (q - 1) // 2, q) == 1


def raman_kind(p: int, q: int, kind: int) -> tuple[int, int]:
    """(kind, number of vertices) of a projective graph of degree p + 1: 1 the points of the line over Z_q, 2 pairs of them, 3 and 4 projective matrices, those with square determinants where p is a square modulo q (3), else all (4); 0 stands for 3 or 4."""
    prime = lambda x: x > 1 and all(x % k for k in range(2, int(x**0.5) + 1))
    if not 3 <= q <= 46337:
        raise PanicError(VERY_BAD_SPECS)
    if p < 2:
        raise PanicError(VERY_BAD_SPECS + 1)
    if not prime(q):
        raise PanicError(BAD_SPECS + 1)
    if p == 2 and not (_residue(13, q) and _residue(-2, q)):
        raise PanicError(BAD_SPECS + 2)
    if p % q == 0:
        raise PanicError(BAD_SPECS + 3)
    fits = 3 if _residue(p, q) else 4
    kind = kind or fits
    if kind > 2 and kind != fits:
        raise PanicError(BAD_SPECS + 4)
    if kind > 2 and q > 1289:
        raise PanicError(BAD_SPECS + 5)
    n = {1: q + 1, 2: q * (q + 1) // 2, 3: (q**3 - q) // 2, 4: q**3 - q}[kind]
    if p >= 0x3FFFFFFF // n:
        raise PanicError(BAD_SPECS + 6)
    if not prime(p):
        raise PanicError(BAD_SPECS + 7)
    return kind, n


def raman(spark: SparkSession, p: int, q: int, kind: int = 1) -> DataFrame:
    """Arcs (src, dst, gen) of the (p + 1)-regular graph of a kind, see raman_kind, one for each vertex and generator.

    Generators are the integer quaternions of norm p as matrices modulo q; the table has p + 1 rows whatever q is, and the
    executors apply all of them to all vertices by column arithmetic; inverses modulo q come from a table of q rows. On the line, q
    stands for infinity. Matrices (1, b; c, bc + k) come first, by b, c and k, then (0, 1; c, d) by the determinant -c and d.
    """
    kind, n = raman_kind(p, q, kind)
    gens = quaternion_matrices(p, q)
    g = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(x).cast("long").alias(c) for c, x in zip("abcd", m, strict=True))) for k, m in enumerate(gens))))
    inverse = F.broadcast(spark.createDataFrame([(x, pow(x, -1, q) if x else 0) for x in range(q)], "of long, inv long"))  # 46337 rows at most

    def over(df: DataFrame, den: str, inv: str) -> DataFrame:
        return df.join(inverse.select(F.col("of").alias(den), F.col("inv").alias(inv)), den)

    def act(df: DataFrame, x: str, to: str) -> DataFrame:
        df = df.withColumn("num", F.when(F.col(x) == q, F.col("g.a")).otherwise((F.col("g.a") * F.col(x) + F.col("g.b")) % q))
        df = df.withColumn("den", F.when(F.col(x) == q, F.col("g.c")).otherwise((F.col("g.c") * F.col(x) + F.col("g.d")) % q))
        return over(df, "den", "inv").withColumn(to, F.when(F.col("den") == 0, F.lit(q).cast("long")).otherwise((F.col("num") * F.col("inv")) % q)).drop("num", "den", "inv")

    if kind < 3:
        line = spark.range(q + 1)
        if kind == 1:
            return act(line.withColumn("g", g), "id", "dst").select(F.col("id").alias("src"), "dst", F.col("g.k").cast("long").alias("gen"))
        pairs = line.select(F.col("id").alias("a")).join(spark.range(q + 1).select(F.col("id").alias("b")), F.col("a") < F.col("b"))
        out = act(act(pairs.withColumn("g", g), "a", "x"), "b", "y")
        name = lambda u, v: F.least(u, v) * (q + 1) + F.greatest(u, v)
        return out.select(name(F.col("a"), F.col("b")).alias("src"), name(F.col("x"), F.col("y")).alias("dst"), F.col("g.k").cast("long").alias("gen"))
    dets = [k for k in range(1, q) if kind == 4 or _residue(k, q)]
    m, place = len(dets), {k: i for i, k in enumerate(dets)}
    det, rank = (F.array(*(F.lit(x).cast("long") for x in xs)) for xs in (dets, [place.get(k, 0) for k in range(q)]))
    at = lambda xs, i: F.get(xs, i.cast("int"))
    number = lambda a, b, c, d, k: F.when(a == 1, (b * q + c) * m + at(rank, k)).otherwise(q * q * m + at(rank, (q - c) % q) * q + d)
    i = F.col("id")
    first = i < q * q * m
    low = i - q * q * m
    b, c = F.floor(i / (q * m)) % q, F.floor(i / m) % q
    v = spark.range(n).select("id", first.cast("long").alias("a"), F.when(first, b).otherwise(1).cast("long").alias("b"), F.when(first, c).otherwise((q - at(det, F.floor(low / q))) % q).cast("long").alias("c"))
    v = v.withColumn("d", F.when(first, (F.col("b") * F.col("c") + at(det, i % m)) % q).otherwise(low % q).cast("long")).withColumn("g", g)
    row = lambda x, y: ((F.col(x) * F.col("g.a") + F.col(y) * F.col("g.c")) % q, (F.col(x) * F.col("g.b") + F.col(y) * F.col("g.d")) % q)
    (wa, wb), (wc, wd) = row("a", "b"), row("c", "d")
    w = over(v.select("id", F.col("g.k").alias("k"), wa.alias("wa"), wb.alias("wb"), wc.alias("wc"), wd.alias("wd")).withColumn("lead", F.when(F.col("wa") > 0, F.col("wa")).otherwise(F.col("wb"))), "lead", "inv")
    w = w.select("id", "k", *((F.col(f"w{x}") * F.col("inv") % q).alias(x) for x in "abcd"))
    a, b, c, d = (F.col(x) for x in "abcd")
    return w.select(F.col("id").alias("src"), number(a, b, c, d, F.pmod(d - b * c, F.lit(q))).cast("long").alias("dst"), F.col("k").cast("long").alias("gen"))


def raman_graph(spark: SparkSession, p: int, q: int, kind: int = 0, reduce: int = 0) -> Graph:
    """raman as a graph. With reduce loops and repeated edges go; else an edge stands for a generator at one end and its inverse at the other."""
    kind, n = raman_kind(p, q, kind)
    arcs = raman(spark, p, q, kind)
    v = spark.range(n).withColumnRenamed("id", "vid")
    if kind == 2:
        v = spark.range((q + 1) ** 2).select(F.col("id").alias("vid")).filter(F.floor(F.col("vid") / (q + 1)) < F.col("vid") % (q + 1))
    if reduce:
        e = arcs.filter("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min("gen").alias("gen"))
    else:
        back = F.array(*(F.lit(k) for k in inverse_generators(quaternion_matrices(p, q), q)))
        e = arcs.filter((F.col("src") < F.col("dst")) | ((F.col("src") == F.col("dst")) & (F.col("gen") <= F.get(back, F.col("gen").cast("int"))))).select(F.col("src").alias("u"), F.col("dst").alias("v"), "gen")
    g = edges_to_arcs(e.withColumn("len", F.lit(1).cast("long")), ["u", "gen", "v"])
    return Graph(v.withColumn("name", F.col("vid").cast("string")), g, f"raman({p},{q},{kind},{reduce})", "ZZZIIIIZZZZZZZ" if kind > 2 else "ZZZIIZIZZZZZZZ" if kind == 2 else "ZZZIZZIZZZZZZZ")


def inverse_generators(gens: list[tuple[int, int, int, int]], q: int) -> list[int]:
    """For each matrix the number of the one that undoes it projectively."""

    def form(m):
        lead = pow(next(x for x in m if x), -1, q)
        return tuple(x * lead % q for x in m)

    of: dict = {}
    for k, (a, b, c, d) in enumerate(gens):
        of.setdefault(form((a, b, c, d)), []).append(k)
    return [of[form((d, -b % q, -c % q, a))][0] for a, b, c, d in gens]


def quaternion_matrices(p: int, q: int) -> list[tuple[int, int, int, int]]:
    """The p + 1 generator matrices (a, b, c, d) modulo q of a prime p: the solutions of a0^2 + a1^2 + a2^2 + a3^2 = p that stand for classes up to units; for p = 2 three matrices made of the roots of -2 and -26."""
    if p == 2:
        s = next(x for x in range(q) if (x * x + 2) % q == 0)
        t = next(x for x in range(q) if (x * x + 26) % q == 0)
        return [(1, 0, 0, q - 1), ((2 + s) % q, t, t, (2 - s) % q), ((2 - s) % q, -t % q, -t % q, (2 + s) % q)]
    g, h = next((g, h) for g in range(q) for h in range(q) if (g * g + h * h + 1) % q == 0)
    r = int(p**0.5) + 1
    odd = p % 4 == 1
    sols = []
    for a0, a1, a2, a3 in itertools.product(range(-r, r + 1), repeat=4):
        if a0 * a0 + a1 * a1 + a2 * a2 + a3 * a3 != p or (a0 % 2 == 1) != odd or any((x % 2 == 1) == odd for x in (a1, a2, a3)):
            continue
        if a0 > 0 or a0 == 0 and next(x for x in (a1, a2, a3) if x) > 0:
            sols.append((a0, a1, a2, a3))
    if len(sols) != p + 1:
        # elements of norm p with a zero real part are their own inverses up to sign
        raise PanicError(BAD_SPECS + 7)
    return [((a0 + a1 * g + a3 * h) % q, (a2 + a3 * g - a1 * h) % q, (-a2 + a3 * g - a1 * h) % q, (a0 - a1 * g - a3 * h) % q) for a0, a1, a2, a3 in sols]
