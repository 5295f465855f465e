"""Graphs from the data files: books, the economy, football games, cities, words, the thesaurus, the picture; plane triangulation."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.graph import BAD_SPECS, IMPOSSIBLE, NO_ROOM, SYNTAX_ERROR, VERY_BAD_SPECS, Graph, PanicError, edges_to_arcs, numbered, ordered_arcs
from ..core.rng import Stream, linksort
from ..core.store import stored
from ..sources import datafile
from .tables import clique_edges, greedy_hierarchy, hamming_edges, in_out_counts, overlap_sums, regions, threshold_bipartite

LIMIT = 1_000_000


def ranked_characters(spark: SparkSession, path: str, n: int = 0, x: int = 0, first: int = 0, last: int = 0, in_weight: int = 0, out_weight: int = 0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(characters with vid, n_in, n_out, weight; scenes): ranks x + 1 to n by weight in_weight * n_in + out_weight * n_out, ties from the random stream."""
    if abs(in_weight) > LIMIT or abs(out_weight) > LIMIT:
        raise PanicError(BAD_SPECS)
    cast, scenes = datafile.book_tables(spark, path)
    chapters = scenes.agg(F.max("chapter")).first()[0]
    first, last = max(1, first), chapters if last <= 0 or last > chapters else last
    counts = in_out_counts(scenes, "chapter", "code", first, last)
    rows = cast.join(counts, cast.code == counts.item, "left").fillna(0).orderBy(F.desc("pos")).collect()  # a cast of at most some hundred
    items = [(r.n_in * in_weight + r.n_out * out_weight + (1 << 30), r) for r in rows]
    order = linksort(items, Stream(seed))[x : n or None]
    table = [(v, r.code, r.name, r.descr, r.n_in, r.n_out) for v, (_, r) in enumerate(order)]
    return spark.createDataFrame(table, "vid long, code string, name string, descr string, n_in long, n_out long"), scenes.filter(F.col("chapter").between(first, last))


def _book_id(kind: str, path: str, scenes: DataFrame, args: dict) -> str:
    first, last = scenes.agg(F.min("chapter"), F.max("chapter")).first()
    got = {"first": first, "last": last} | {k: v for k, v in args.items() if k not in ("first", "last")}
    numbers = (got.get(k, 0) for k in ("n", "x", "first", "last", "in_weight", "out_weight", "seed"))
    return f'{kind}("{Path(path).stem}",{",".join(map(str, numbers))})'


def book(spark: SparkSession, path: str, **args) -> Graph:
    """Characters joined where they meet in a scene; arcs keep the first chapter."""
    v, scenes = ranked_characters(spark, path, **args)
    met = scenes.join(v.select("code", "vid"), "code").select((F.col("chapter") * 10_000 + F.col("scene")).alias("place"), "vid")
    e = clique_edges(met, "place", "vid").withColumn("chapter", F.floor(F.col("first") / 10_000)).drop("first").withColumn("len", F.lit(1).cast("long"))
    return Graph(v, edges_to_arcs(e, ["chapter", "u", "v"]), _book_id("book", path, scenes, args), "IZZIISIZZZZZZZ")


def bi_book(spark: SparkSession, path: str, **args) -> Graph:
    """Characters joined to the chapters in which they appear; chapters follow the characters."""
    v, scenes = ranked_characters(spark, path, **args)
    n1 = v.count()
    low = scenes.agg(F.min("chapter")).first()[0]
    e = scenes.join(v.select("code", "vid"), "code").select(F.col("vid").alias("u"), (F.col("chapter") - low + n1).cast("long").alias("v")).distinct().withColumn("len", F.lit(1).cast("long"))
    chap = scenes.select((F.col("chapter") - low + n1).cast("long").alias("vid"), F.col("label").alias("name")).distinct()
    return Graph(v.unionByName(chap, allowMissingColumns=True), edges_to_arcs(e, ["v", "u"]), _book_id("bi_book", path, scenes, args), "IZZIISIZZZZZZZ").bipartite(n1)


#: The two sectors that aren't in the tree, by code.
ADJUSTMENTS, USERS = 80, 81


def subtree_counts(kids: dict[int, tuple[int, int]], root: int) -> dict[int, dict[int, int]]:
    """For each node the number of subtrees from it down with k leaves: products of the children's counts, or the node alone."""
    ways: dict[int, dict[int, int]] = {}
    for p in range(root + len(kids) * 2, root - 1, -1):  # preorder numbers, so children come first this way
        w = {1: 1}
        for j, x in ways[kids[p][0]].items() if p in kids else ():
            for k, y in ways[kids[p][1]].items():
                w[j + k] = w.get(j + k, 0) + x * y
        ways[p] = w
    return ways


def random_subtree(kids: dict[int, tuple[int, int]], root: int, leaves: int, stream: Stream) -> set[int]:
    """The leaves of a random subtree from the root down with so many of them, all such subtrees being (nearly) equally likely.

    The root's counts pass 31 bits where 29 < leaves < 67; there the left side's are taken in units of 1024, rounded up.
    """
    ways, out, todo = subtree_counts(kids, root), set(), [(root, leaves)]
    while todo:  # in preorder, as the draws go
        p, n = todo.pop()
        if n == 1 or p not in kids:
            out.add(p)
            continue
        left, right = kids[p]
        if left not in kids or right not in kids:
            mine = 1 if left not in kids else n - 1
        else:
            scaled = p == root and 29 < n < 67
            size = lambda k, a=ways[left], b=ways[right], n=n, scaled=scaled: (a.get(k, 0) + 1023 >> 10 if scaled else a.get(k, 0)) * b.get(n - k, 0)
            low = max(1, n - max(ways[right]))
            rest = stream.below(sum(size(k) for k in range(low, min(n - 1, max(ways[left])) + 1)))
            mine = low
            while rest >= size(mine):
                rest -= size(mine)
                mine += 1
        todo += [(right, n - mine), (left, mine)]
    return out


def econ(spark: SparkSession, path: str, n: int = 0, omit: int = 0, threshold: int = 0, seed: int = 0) -> Graph:
    """n sectors of the economy joined where a flow passes threshold / 65536 of all that the receiver takes in.

    Sectors of the tree are put together until n remain, with Adjustments (left out for omit 2) and Users (left out for omit 1
    and 2): those of a random subtree, or, for seed 0, by splitting the largest total again and again. vertices have total and
    the codes put together. The file has 81 sectors at most, so the driver does this.
    """
    omit = omit if 0 <= omit <= 2 else 2
    if not 0 < n <= USERS - omit:
        n = USERS - omit
    elif n + omit < 3:
        omit = 3 - n
    threshold = threshold if 0 <= threshold <= 65536 else 65536
    sectors, table = datafile.econ_tables(spark, path)
    nodes = sectors.orderBy("node").collect()
    flow: dict[tuple[int, int], int] = {}
    for r in table.collect():
        flow[r.src, r.dst] = flow.get((r.src, r.dst), 0) + r.flow
    kids: dict[int, tuple[int, ...]] = {}
    for r in nodes:
        if r.parent is not None:
            kids[r.parent] = (*kids.get(r.parent, ()), r.node)
    into = {k: sum(x for (_, d), x in flow.items() if d == k) for k in range(1, USERS)}
    codes = {r.node: [r.sic] for r in nodes if r.sic is not None}
    for r in reversed(nodes):
        if r.node in kids:
            codes[r.node] = [c for k in kids[r.node] for c in codes[k]]
    want = n + omit - 2
    if want == ADJUSTMENTS - 1:
        kept = {r.node for r in nodes if r.sic is not None}
    elif seed:
        kept = random_subtree(kids, 0, want, Stream(seed))
    else:
        kept = set(greedy_hierarchy([(r.node, r.parent, sum(into[c] for c in codes[r.node])) for r in nodes], want))
    group = {codes[k][0]: codes[k] for k in kept} | {ADJUSTMENTS: [ADJUSTMENTS]}
    image = {c: k for k, own in group.items() for c in own} | {USERS: USERS}
    title = {codes[r.node][0]: r.title for r in nodes if r.node in kept} | {ADJUSTMENTS: "Adjustments", USERS: "Users"}
    total = {k: sum(into[c] for c in own) for k, own in group.items()}
    merged: dict[tuple[int, int], int] = {}
    for (a, b), x in flow.items():
        merged[image[a], image[b]] = merged.get((image[a], image[b]), 0) + x
    if omit == 0:  # what the users take is what comes in but doesn't go out
        for k in group:
            merged[k, USERS] = total[k] - sum(x for (a, b), x in merged.items() if a == k and b != USERS)
        total[USERS] = sum(x for (a, _), x in merged.items() if a == USERS)
    order = sorted([k for k in group if k != ADJUSTMENTS or omit < 2] + [USERS] * (omit == 0))
    at = {k: i for i, k in enumerate(order)}
    v = spark.createDataFrame([(i, title[k], total[k], group.get(k, [])) for i, k in enumerate(order)], "vid long, name string, total long, codes array<int>")
    arcs = [(at[a], at[b], 1, x) for a in reversed(order) for b in reversed(order) if (x := merged.get((a, b), 0)) and (not threshold or x * 65536 > total[b] * threshold)]
    e = spark.createDataFrame([(k, *x) for k, x in enumerate(arcs)], "k long, u long, v long, len long, flow long")
    return Graph(v, ordered_arcs(e, ["k"]).drop("k"), f"econ({n},{omit},{threshold},{seed})", "ZZZZIAIZZZZZZZ")


def games(spark: SparkSession, path: str, n: int = 0, ap0: int = 0, upi0: int = 0, ap1: int = 0, upi1: int = 0, first: int = 0, last: int = 0, seed: int = 0) -> Graph:
    """The n best teams by weighted polls, two arcs for each game between them from day first to last; len is the own score."""
    from .tables import match_pairs

    if max(map(abs, (ap0, upi0, ap1, upi1))) > 1 << 17:
        raise PanicError(BAD_SPECS)
    last = last if 0 < last <= 128 else 128
    teams, played = datafile.games_tables(spark, path)
    rows = teams.orderBy(F.desc("pos")).collect()  # 120 teams
    items = [(r.ap0 * ap0 + r.upi0 * upi0 + r.ap1 * ap1 + r.upi1 * upi1 + (1 << 30), r) for r in rows]
    order = linksort(items, Stream(seed))[: n or None]
    v = spark.createDataFrame([(k, r.name, r.abbr, r.nick, r.conf, r.ap0 << 16 | r.ap1, r.upi0 << 16 | r.upi1) for k, (_, r) in enumerate(order)], "vid long, name string, abbr string, nick string, conf string, ap long, upi long")
    g = played.filter(F.col("day").between(first, last))
    g = g.join(v.select(F.col("vid").alias("a"), F.col("abbr").alias("team_a")), "team_a").join(v.select(F.col("vid").alias("b"), F.col("abbr").alias("team_b")), "team_b")
    # venue 1: the first team is away, so it is the arc of the home team that has 3
    arcs = match_pairs(g).withColumn("k", F.monotonically_increasing_id()).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("len").cast("long").alias("len"), "venue", "day", F.col("mate").alias("mate_len"))
    return Graph(v, ordered_arcs(arcs, ["day", F.least("u", "v"), F.greatest("u", "v"), "u"]), f"games({len(order)},{ap0},{upi0},{ap1},{upi1},{first},{last},{seed})", "IIZSSSIIZZZZZZ")


#: Bounds of latitude, longitude (hundredths of a degree) and population in the city file.
LATITUDES, LONGITUDES, POPULATIONS = (2672, 5042), (7180, 12312), (2521, 875538)
#: Complementary distances from here on are not among those that max_degree counts.
COUNTED = 1 << 24


def miles(spark: SparkSession, path: str, n: int = 0, north_weight: int = 0, west_weight: int = 0, pop_weight: int = 0, max_distance: int = 0, max_degree: int = 0, seed: int = 0) -> Graph:
    """The n cities of largest weight, joined at their distance where both count the other among their max_degree nearest within max_distance (0: no bound).

    Ties of weight and of distance come from the random stream. vertices have pop, x, y and index_no; facts["miles"] keeps
    the distance from vid to vid, negative where the first city gave the second up. The file has 128 cities at most, so the driver does this.
    """
    if max(abs(north_weight), abs(west_weight)) > 100_000 or abs(pop_weight) > 100:
        raise PanicError(BAD_SPECS)
    cities, dist = datafile.miles_tables(spark, path)
    rows = cities.orderBy("idx").collect()
    for k, (low, high) in enumerate((LATITUDES, LONGITUDES, POPULATIONS)):
        if any(not low <= r[k + 2] <= high for r in rows):
            raise PanicError(SYNTAX_ERROR + 1 + k, "a city out of bounds")
    n = n if 0 < n <= len(rows) else len(rows)
    max_degree = max_degree if 0 < max_degree < n else n - 1
    stream = Stream(seed)
    weight = lambda r: north_weight * (r.lat - LATITUDES[0]) + west_weight * (r.lon - LONGITUDES[0]) + pop_weight * (r.pop - POPULATIONS[0]) + (1 << 30)
    chosen = [r for _, r in linksort([(weight(r), r) for r in rows], stream)][:n]
    vid = {r.idx: k for k, r in enumerate(chosen)}
    far = {}
    for r in dist.collect():
        if r.i in vid and r.j in vid:
            far[vid[r.i], vid[r.j]] = far[vid[r.j], vid[r.i]] = r.miles
    bound = max_distance or 30_000
    for a in (vid[i] for i in sorted(vid, reverse=True)):
        near = [b for b in (vid[i] for i in sorted(vid)) if b != a and far[a, b] <= bound]
        ranked = [b for k, b in linksort([(bound - far[a, b], b) for b in near], stream) if k < COUNTED]
        for b in ranked[max_degree:] + [b for b in range(n) if b != a and far[a, b] > bound]:
            far[a, b] = -far[a, b]
    v = [(k, r.name, r.pop, LONGITUDES[1] - r.lon, (r.lat - LATITUDES[0]) * 3 // 2, len(rows) - 1 - r.idx) for k, r in enumerate(chosen)]
    e = [(a, b, far[a, b]) for a in range(n) for b in range(a + 1, n) if far[a, b] > 0 and far[b, a] > 0]
    frame = spark.createDataFrame(v, "vid long, name string, pop long, x long, y long, index_no long")
    spec = f"miles({n},{north_weight},{west_weight},{pop_weight},{max_distance},{max_degree},{seed})"
    return Graph(frame, edges_to_arcs(spark.createDataFrame(e, "u long, v long, len long"), ["u", "v"]), spec, "ZZIIIIZZZZZZZZ", facts={"miles": far})


def miles_distance(g: Graph, u: int, v: int) -> int:
    """Miles between two vertices of a graph of cities, negative where u gave v up; the two directions can differ."""
    return g.facts["miles"][u, v]


#: Weights of a word (common, advanced, seven counts) and the largest count of each kind in the word file.
WORD_WEIGHTS, LARGEST_COUNTS = (100, 10, 4, 2, 2, 1, 1, 1, 1), (15194, 3560, 4467, 460, 6976, 756, 362)
#: Categories of the thesaurus; rows, columns and greatest grey of the picture.
CATEGORIES, PICTURE_ROWS, PICTURE_COLS, GREYEST = 1022, 360, 250, 255


def words(spark: SparkSession, path: str, n: int = 0, weights: tuple[int, ...] | None = None, threshold: int = 0, seed: int = 0) -> Graph:
    """The n five-letter words of largest weight that reaches threshold (0: all), joined where they differ at one place; arcs keep that place as pos.

    weights are those of common and of advanced words and of the seven counts. Ties come from the random stream, so the driver
    ranks the words (5757 in the file); tables.weighted_top ranks tables of any size. vertices have weight.
    """
    own = tuple(weights or WORD_WEIGHTS)
    most = max(abs(own[0]), abs(own[1])) + sum(abs(w) * c for w, c in zip(own[2:], LARGEST_COUNTS, strict=True))
    if most >= 0x60000000:
        raise PanicError(VERY_BAD_SPECS)
    if most >= 1 << 30:
        raise PanicError(BAD_SPECS)
    items = []
    for r in datafile.words_table(spark, path).orderBy(F.desc("pos")).collect():
        if r.cls not in "*+ ":
            raise PanicError(SYNTAX_ERROR, r.word)
        if len(r.counts) > len(LARGEST_COUNTS):
            raise PanicError(SYNTAX_ERROR + 1, r.word)
        if any(c > most_of for c, most_of in zip(r.counts, LARGEST_COUNTS, strict=False)):
            raise PanicError(SYNTAX_ERROR + 2, r.word)
        weight = {"*": own[0], "+": own[1], " ": 0}[r.cls] + sum(c * w for c, w in zip(r.counts, own[2:], strict=False))
        if weight >= threshold:
            items.append((weight, r.word))
    order = linksort(items, Stream(seed))[: n or None]
    v = spark.createDataFrame([(k, word, weight) for k, (weight, word) in enumerate(order)], "vid long, name string, weight long")
    e = hamming_edges(v.select(F.col("name").alias("word"))).join(v.select(F.col("name").alias("a"), F.col("vid").alias("u")), "a").join(v.select(F.col("name").alias("b"), F.col("vid").alias("v")), "b")
    e = e.select("u", "v", F.lit(1).cast("long").alias("len"), "pos")
    vector = "0" if weights is None else "{" + ",".join(map(str, own)) + "}"
    return Graph(v, edges_to_arcs(e, [F.greatest("u", "v"), "pos", F.least("u", "v")]), f"words({len(order)},{vector},{threshold},{seed})", "IZZZZZIZZZZZZZ")


def chosen_references(refs: list[tuple[int, int]], n: int, min_distance: int, prob: int, seed: int, total: int = CATEGORIES) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """(vid of each of n of total categories chosen at random, references between them): at least min_distance apart, each kept where a 16-bit draw reaches prob."""
    s = Stream(seed)
    pool, number = list(range(1, total + 1)), {}
    for v in range(n - 1, -1, -1):
        j = s.below(len(pool))
        number[pool[j]] = v
        pool[j] = pool[-1]
        pool.pop()
    return number, [(number[a], number[b]) for a, b in refs if a in number and b in number and abs(a - b) >= min_distance and (not prob or (s.next() >> 15) >= prob)]


def roget(spark: SparkSession, path: str, n: int = 0, min_distance: int = 0, prob: int = 0, seed: int = 0) -> Graph:
    """n random categories of the thesaurus with an arc for each cross reference between them that is at least min_distance long and that a 16-bit draw of at least prob keeps.

    vertices have cat, the category's number. References are drawn in the order of the file (1022 categories), so the driver does this.
    """
    n = n if 0 < n <= CATEGORIES else CATEGORIES
    cats, refs = datafile.roget_tables(spark, path)
    name = {r.cat: r["name"] for r in cats.collect()}
    pairs = [(r.src, r.dst) for r in refs.collect()]
    if any(b > CATEGORIES for _, b in pairs):
        raise PanicError(SYNTAX_ERROR + 2)
    if sorted(name) != list(range(1, CATEGORIES + 1)):
        raise PanicError(IMPOSSIBLE, "categories lack or come twice")
    number, arcs = chosen_references(pairs, n, min_distance, prob, seed)
    v = spark.createDataFrame([(k, name[c], c) for c, k in sorted(number.items(), key=lambda x: x[1])], "vid long, name string, cat long")
    e = spark.createDataFrame([(k, *x, 1) for k, x in enumerate(arcs)], "k long, u long, v long, len long")
    return Graph(v, ordered_arcs(e, ["k"]).drop("k"), f"roget({n},{min_distance},{prob},{seed})", "IZZZZZZZZZZZZZ")


def lisa(spark: SparkSession, path: str, m: int = 0, n: int = 0, d: int = 0, m0: int = 0, m1: int = 0, n0: int = 0, n1: int = 0, d0: int = 0, d1: int = 0) -> tuple[DataFrame, tuple[int, ...]]:
    """(cells(i, j, val), the nine parameters with their defaults filled in): rows m0 to m1 and columns n0 to n1 of the picture as an m x n matrix.

    A new cell's sum of greys times shares of area is scaled from [d0, d1) to [0, d]; sums are whole, and so is the division.
    """
    m1 = m1 if 0 < m1 <= PICTURE_ROWS else PICTURE_ROWS
    if m1 <= m0:
        raise PanicError(BAD_SPECS + 1)
    n1 = n1 if 0 < n1 <= PICTURE_COLS else PICTURE_COLS
    if n1 <= n0:
        raise PanicError(BAD_SPECS + 2)
    rows, cols = m1 - m0, n1 - n0
    m, n, d, d1 = m or rows, n or cols, d or GREYEST, d1 or GREYEST * rows * cols
    if d1 <= d0:
        raise PanicError(BAD_SPECS + 3)
    if d1 >= 1 << 31:
        raise PanicError(BAD_SPECS + 4)
    if m * n >= 1 << 31:
        raise PanicError(NO_ROOM + 1)
    window = datafile.picture_table(spark, path).filter(F.col("row").between(m0, m1 - 1) & F.col("col").between(n0, n1 - 1))
    s = overlap_sums(window.select((F.col("row") - m0).alias("i"), (F.col("col") - n0).alias("j"), F.col("grey").alias("val")), rows, cols, m, n)
    val = F.when(F.col("s") <= d0, 0).when(F.col("s") >= d1, d).otherwise(F.expr(f"({d}L * (s - {d0}L)) div {d1 - d0}L"))
    return s.select(F.col("r").cast("long").alias("i"), F.col("c").cast("long").alias("j"), val.cast("long").alias("val")), (m, n, d, m0, m1, n0, n1, d0, d1)


def plane_lisa(spark: SparkSession, path: str, *spec: int) -> Graph:
    """The regions of equal value of lisa(spec), numbered by their first cells and joined where they touch; vertices have val, first and last, their cells in reading order."""
    cells, full = lisa(spark, path, *spec)
    return region_graph(stored(cells, "lisa"), full[0], full[1], f"plane_lisa({','.join(map(str, full))})")


def region_graph(cells: DataFrame, m: int, n: int, id: str) -> Graph:
    """The graph of the 4-connected regions of equal value of an m x n matrix cells(i, j, val); edges come in the order in which reading the cells meets them, the cell above before the one to the left."""
    at = (F.col("i") * n + F.col("j")).cast("long")
    own = stored(cells.withColumn("cell", at).join(regions(cells, n), "cell"), "region_cells")
    v = numbered(own.groupBy("region").agg(F.max("cell").alias("last"), F.first("val").alias("val")), ["region"], "vid")
    vid = v.select("region", F.col("vid").alias("u"))
    here = own.join(vid, "region").select("i", "j", "cell", "u")
    up = here.select((F.col("i") + 1).alias("i"), "j", F.col("u").alias("v"), F.lit(0).alias("side"))
    left = here.select("i", (F.col("j") + 1).alias("j"), F.col("u").alias("v"), F.lit(1).alias("side"))
    met = here.join(up.unionByName(left), ["i", "j"]).filter("u <> v")
    e = met.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(2 * F.col("cell") + F.col("side")).alias("place")).withColumn("len", F.lit(1).cast("long"))
    frame = v.select("vid", F.col("vid").cast("string").alias("name"), "val", F.col("region").alias("first"), "last")
    return Graph(frame, edges_to_arcs(e, ["place"]).drop("place"), id, "ZZZIIIZZIIZZZZ", facts={"rows": m, "cols": n})


def bi_lisa(spark: SparkSession, path: str, m: int = 0, n: int = 0, m0: int = 0, m1: int = 0, n0: int = 0, n1: int = 0, threshold: int = 0, below: bool = False) -> Graph:
    """Rows r0, r1, ... of the picture in m x n cells joined to columns c0, c1, ... where the cell, in 65536 greys, reaches threshold (below: is under it); arcs have its value as b."""
    cells, (m, n, _, m0, m1, n0, n1, _, _) = lisa(spark, path, m, n, 65535, m0, m1, n0, n1)
    v = spark.range(m + n).select(F.col("id").alias("vid"), F.when(F.col("id") < m, F.concat(F.lit("r"), F.col("id"))).otherwise(F.concat(F.lit("c"), F.col("id") - m)).alias("name"))
    e = threshold_bipartite(cells, threshold, below).select(F.col("src").alias("u"), (F.col("dst") + m).alias("v"), F.lit(1).cast("long").alias("len"), "b")
    return Graph(v, edges_to_arcs(e, ["u", "v"]), f"bi_lisa({m},{n},{m0},{m1},{n0},{n1},{threshold},{int(below)})", "ZZZZZZZIZZZZZZ").bipartite(m)


def orientation(a, b, c) -> int:
    """Sign of the area of the triangle a b c, exact for integers; ties of collinear points are broken by order."""
    d = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (d > 0) - (d < 0)


def in_circle(a, b, c, d) -> int:
    """Positive where d is inside the circle through a, b, c in counterclockwise order; exact for integers."""
    m = [(p[0] - d[0], p[1] - d[1], (p[0] - d[0]) ** 2 + (p[1] - d[1]) ** 2) for p in (a, b, c)]
    det = m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    return (det > 0) - (det < 0)


def delaunay(points: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Edges of the Delaunay triangulation of distinct points with integer coordinates, by insertion into a triangle that holds all of them."""
    n = len(points)
    if n < 2:
        return set()
    far = 4 * (1 + max(max(abs(x), abs(y)) for x, y in points)) ** 3
    p = [*points, (-far, -far), (far, -far), (0, far)]
    triangles = {(n, n + 1, n + 2)}
    for i in range(n):
        bad = [t for t in triangles if in_circle(*(p[v] for v in t), p[i]) > 0]
        rim: set[tuple[int, int]] = set()
        for a, b, c in bad:
            for e in ((a, b), (b, c), (c, a)):
                if e[::-1] in rim:
                    rim.discard(e[::-1])
                else:
                    rim.add(e)
        triangles -= set(bad)
        for a, b in rim:
            if orientation(p[a], p[b], p[i]) > 0:
                triangles.add((a, b, i))
    return {(min(e), max(e)) for a, b, c in triangles for e in ((a, b), (b, c), (c, a)) if max(e) < n}


def plane(spark: SparkSession, n: int, x_range: int, y_range: int, prob: int = 0, seed: int = 0) -> Graph:
    """n random points joined by their Delaunay triangulation, an edge kept where a 16-bit draw reaches prob; len is 1024 times the distance, rounded."""
    from math import isqrt

    s = Stream(seed)
    pts: list[tuple[int, int]] = []
    while len(pts) < n:
        q = s.below(x_range), s.below(y_range)
        if q not in pts:
            pts.append(q)
    e = []
    for u, v in sorted(delaunay(pts)):
        if not prob or (s.next() >> 15) >= prob:
            d2 = (pts[u][0] - pts[v][0]) ** 2 + (pts[u][1] - pts[v][1]) ** 2
            r = isqrt(d2 << 20)
            e.append((u, v, r + ((d2 << 20) - r * r > r)))
    v = spark.createDataFrame([(k, str(k), x, y) for k, (x, y) in enumerate(pts)], "vid long, name string, x long, y long")
    return Graph(v, edges_to_arcs(spark.createDataFrame(e, "u long, v long, len long"), ["u", "v"]), f"plane({n},{x_range},{y_range},0,{prob},{seed})", "ZZZIIIZZZZZZZZ")
