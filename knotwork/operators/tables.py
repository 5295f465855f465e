"""Graphs derived from tables: word lists, cliques, flows, games, pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weighted_top(items: DataFrame, key: str, weight: F.Column, n: int, threshold: int = 0) -> DataFrame:
    """items whose weight reaches threshold, the n heaviest, ties by key; weight and rank are added."""
    w = items.withColumn("weight", weight.cast("long")).filter(F.col("weight") >= threshold).orderBy(F.desc("weight"), key).limit(n)
    return w.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), key)).cast("long"))


def hamming_edges(words: DataFrame, length: int = 5) -> DataFrame:
    """Pairs of words(word) of that length that differ at one place: a < b and the place. Each word is masked once at each place, equal masks join."""
    k = F.explode(F.sequence(F.lit(0), F.lit(length - 1)))
    m = words.withColumn("pos", k).withColumn("mask", F.concat(F.substring("word", F.lit(1), F.col("pos")), F.lit("*"), F.substring("word", F.col("pos") + 2, F.lit(length))))
    other = m.select("mask", F.col("word").alias("b"))
    return m.join(other, "mask").filter(F.col("word") < F.col("b")).select(F.col("word").alias("a"), "b", F.col("pos").cast("long").alias("pos"))


def find_word(words: DataFrame, query: str) -> DataFrame:
    """The word itself if it is there, else the words one letter away."""
    from .algorithms import hamming

    d = words.filter(F.length("word") == len(query)).withColumn("d", hamming(F.col("word"), F.lit(query))).filter("d <= 1")
    return d.withColumn("low", F.min("d").over(Window.partitionBy())).filter("d = low").select("word", "d")


def link_filter(arcs: DataFrame, min_distance: int) -> DataFrame:
    return arcs.filter(F.abs(F.col("src") - F.col("dst")) >= min_distance)


def degree_cap(pairs: DataFrame, max_len: int, max_degree: int) -> DataFrame:
    """Edges (u, v, len) of at most max_len that both ends count among their max_degree shortest, ties by the other end."""
    near = pairs.filter(F.col("len") <= max_len)
    ends = near.select(F.col("u").alias("a"), F.col("v").alias("b"), "len").unionByName(near.select(F.col("v").alias("a"), F.col("u").alias("b"), "len"))
    kept = ends.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("len", "b"))).filter(F.col("r") <= max_degree)
    u = kept.filter("a < b").select(F.col("a").alias("u"), F.col("b").alias("v"), "len")
    v = kept.filter("a > b").select(F.col("b").alias("u"), F.col("a").alias("v"))
    return u.join(v, ["u", "v"], "left_semi")


def clique_edges(members: DataFrame, group: str, item: str) -> DataFrame:
    """Edges u < v between items that share a group, with the first group they share."""
    m = members.select(F.col(group).alias("g"), F.col(item).alias("u")).distinct()
    return m.join(m.withColumnRenamed("u", "v"), "g").filter("u < v").groupBy("u", "v").agg(F.min("g").alias("first"))


def in_out_counts(members: DataFrame, group: str, item: str, first: int, last: int) -> DataFrame:
    """Distinct groups of each item inside [first, last] and outside."""
    inside = F.col(group).between(first, last)
    return members.groupBy(F.col(item).alias("item")).agg(F.count_distinct(F.when(inside, F.col(group))).alias("n_in"), F.count_distinct(F.when(~inside, F.col(group))).alias("n_out"))


def bipartite_groups(members: DataFrame, group: str, item: str, kept: DataFrame) -> DataFrame:
    """For each group, how many distinct items are in kept(item) and how many aren't."""
    m = members.select(F.col(group).alias("grp"), F.col(item).alias("item")).distinct().join(kept.select("item", F.lit(1).alias("in_")), "item", "left")
    return m.groupBy("grp").agg(F.count_if(F.col("in_").isNotNull()).alias("kept"), F.count_if(F.col("in_").isNull()).alias("dropped"))


def flow_merge(flows: DataFrame, mapping: DataFrame, threshold: int) -> DataFrame:
    """Flows (src, dst, len) summed over mapping(vid, image); an arc stays where 65536 * flow > threshold * total inflow of its receiver, and any nonzero flow does for threshold 0."""
    s = flows.join(mapping.select(F.col("vid").alias("src"), F.col("image").alias("s")), "src").join(mapping.select(F.col("vid").alias("dst"), F.col("image").alias("d")), "dst")
    merged = s.groupBy("s", "d").agg(F.sum("len").alias("flow"))
    total = merged.groupBy("d").agg(F.sum("flow").alias("total"))
    return merged.join(total, "d").filter((F.col("flow") != 0) & ((F.lit(threshold) == 0) | (F.col("flow") * 65536 > F.col("total") * threshold))).select(F.col("s").alias("src"), F.col("d").alias("dst"), "flow")


def greedy_hierarchy(totals: list[tuple[int, int | None, int]], n: int) -> list[int]:
    """Categories (node, parent, total): start from the root and split the category of largest total until there are n."""
    import heapq

    kids: dict = {}
    for node, parent, total in totals:
        kids.setdefault(parent, []).append((-total, node))
    # of equal totals the one that came last is split first
    heap = [(total, -i, node) for i, (total, node) in enumerate(kids.get(None, []))]
    heapq.heapify(heap)
    done, came = [], len(heap)
    while heap and len(heap) + len(done) < n:
        x = heapq.heappop(heap)
        if x[2] in kids:
            for total, node in kids[x[2]]:
                heapq.heappush(heap, (total, -came, node))
                came += 1
        else:
            done.append(x)
    return sorted(node for *_, node in [*heap, *done])


def match_pairs(games: DataFrame) -> DataFrame:
    """Two arcs for each game(day, a, score_a, b, score_b, venue): len is the own score, venue is mirrored (1 home, 2 neutral, 3 away)."""
    one = games.select("day", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("score_a").alias("len"), "venue", F.col("score_b").alias("mate"))
    two = games.select("day", F.col("b").alias("src"), F.col("a").alias("dst"), F.col("score_b").alias("len"), (4 - F.col("venue")).alias("venue"), F.col("score_a").alias("mate"))
    return one.unionByName(two)


def overlap_sums(cells: DataFrame, rows: int, cols: int, m: int, n: int) -> DataFrame:
    """cells(i, j, val) of a rows x cols matrix dealt to an m x n one (r, c): sums s of values times shares of area, in which a new cell has rows * cols shares.

    In units of 1/m and 1/n of a cell all overlaps are whole numbers: old cell i spans [i m, (i + 1) m), new cell r spans [r rows, (r + 1) rows).
    Each old cell is split over the new cells that it meets, so there is no join at all.
    """
    part = lambda i, big, small: F.explode(F.sequence(F.floor(F.col(i) * small / big).cast("int"), F.floor(((F.col(i) + 1) * small - 1) / big).cast("int")))
    over = lambda i, r, big, small: F.least((F.col(i) + 1) * small, (F.col(r) + 1) * big) - F.greatest(F.col(i) * small, F.col(r) * big)
    x = cells.withColumn("r", part("i", rows, m)).withColumn("c", part("j", cols, n))
    x = x.withColumn("w", (over("i", "r", rows, m) * over("j", "c", cols, n)).cast("long"))
    return x.groupBy("r", "c").agg(F.sum(F.col("val") * F.col("w")).alias("s"))


def regrid(cells: DataFrame, rows: int, cols: int, m: int, n: int, d0: int, d1: int, d: int) -> DataFrame:
    """cells(i, j, val) of a rows x cols matrix as an m x n one: area-weighted means, then floor of (x - d0) * d / (d1 - d0), held within 0 and d."""
    s = overlap_sums(cells, rows, cols, m, n)
    area = rows * cols
    scaled = F.floor((F.col("s") - d0 * area).cast("decimal(38,0)") * d / ((d1 - d0) * area)).cast("long")
    return s.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.least(F.lit(d), F.greatest(F.lit(0), scaled)).cast("long").alias("val"))


def regions(cells: DataFrame, cols: int) -> DataFrame:
    """(cell, region) of cells(i, j, val): 4-connected cells of equal value, named by their first cell in reading order."""
    from ..core.store import components

    c = cells.select((F.col("i") * cols + F.col("j")).cast("long").alias("cell"), "i", "j", "val")
    to = c.select((F.col("i") - F.lit(1)).alias("i"), "j", F.col("cell").alias("v"), "val").unionByName(c.select("i", (F.col("j") - F.lit(1)).alias("j"), F.col("cell").alias("v"), "val"))
    comp = components(c.join(to, ["i", "j", "val"]).select(F.col("cell").alias("u"), "v"))
    return c.join(comp, F.col("cell") == F.col("node"), "left").select("cell", F.coalesce("component", "cell").alias("region"))


def region_arcs(cells: DataFrame, region: DataFrame, cols: int) -> DataFrame:
    """Pairs of adjacent regions, once each."""
    c = cells.select((F.col("i") * cols + F.col("j")).cast("long").alias("cell"), "i", "j").join(region, "cell")
    to = c.select((F.col("i") - F.lit(1)).alias("i"), "j", F.col("region").alias("b")).unionByName(c.select("i", (F.col("j") - F.lit(1)).alias("j"), F.col("region").alias("b")))
    return c.join(to, ["i", "j"]).filter("region <> b").select(F.least("region", "b").alias("u"), F.greatest("region", "b").alias("v")).distinct()


def threshold_bipartite(cells: DataFrame, threshold: int, below: bool = False) -> DataFrame:
    """Rows joined to columns where the cell is at least threshold (below: under it)."""
    return cells.filter((F.col("val") < threshold) if below else (F.col("val") >= threshold)).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("val").alias("b"))
