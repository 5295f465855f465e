"""Graph transformers as joins, unions and aggregations over arcs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.graph import Graph, double_compound_id


def complement(pairs: DataFrame, left: DataFrame, right: DataFrame, copy: bool = False, self_loops: bool = False) -> DataFrame:
    """Arcs of length 1 between vertices of left(vid) and right(vid) that pairs(src, dst) doesn't join; with copy, those it does.

    The output is of the order of left times right, so callers pass vertex sets, not fact tables. self_loops keeps src = dst.
    """
    every = left.select(F.col("vid").alias("src")).crossJoin(right.select(F.col("vid").alias("dst")))
    out = every.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi" if copy else "left_anti")
    return (out if self_loops else out.filter("src <> dst")).withColumn("len", F.lit(1).cast("long"))


def gunion(a: DataFrame, b: DataFrame, multi: bool = False) -> DataFrame:
    """Arcs of both graphs, matched by vertex number; without multi the shortest of each pair."""
    both = a.select("src", "dst", "len").unionByName(b.select("src", "dst", "len"))
    return both if multi else both.groupBy("src", "dst").agg(F.min("len").alias("len"))


def intersection(a: DataFrame, b: DataFrame, multi: bool = False) -> DataFrame:
    """Pairs that both graphs join. Length: the larger of the two least lengths.

    With multi, as many arcs as the graph with fewer has, taken from b by rising length, each at least as long as a's shortest.
    """
    ga = a.groupBy("src", "dst").agg(F.min("len").alias("la"), F.count(F.lit(1)).alias("na"))
    if not multi:
        gb = b.groupBy("src", "dst").agg(F.min("len").alias("lb"))
        return ga.join(gb, ["src", "dst"]).select("src", "dst", F.greatest("la", "lb").alias("len"))
    nth = F.row_number().over(Window.partitionBy("src", "dst").orderBy("len"))
    return b.select("src", "dst", "len", nth.alias("nth")).join(ga, ["src", "dst"]).filter("nth <= na").select("src", "dst", F.greatest("len", "la").alias("len"))


def lines_directed(arcs: DataFrame) -> DataFrame:
    """Line graph: arc (a, b) leads to arc (b, c). Vertices are named a->b; columns src, dst, len."""
    name = lambda s, d: F.concat_ws("->", F.col(s).cast("string"), F.col(d).cast("string"))
    first = arcs.select(name("src", "dst").alias("src_name"), F.col("dst").alias("mid"))
    second = arcs.select(F.col("src").alias("mid"), name("src", "dst").alias("dst_name"))
    return first.join(second, "mid").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), F.lit(1).cast("long").alias("len"))


def lines_undirected(edges: DataFrame) -> DataFrame:
    """Line graph of edges(eid, u, v): pairs of edges that share an end, lower eid first, once each."""
    ends = edges.select("eid", F.explode(F.array_distinct(F.array("u", "v"))).alias("end"))
    other = ends.select(F.col("eid").alias("other"), "end")
    return ends.join(other, "end").filter("eid < other").select(F.col("eid").alias("src"), F.col("other").alias("dst"), F.lit(1).cast("long").alias("len")).distinct()


def product(a_vertices: DataFrame, a: DataFrame, b_vertices: DataFrame, b: DataFrame, kind: str, width: int) -> DataFrame:
    """Arcs of the product graph; vertex (i, j) is i * width + j. cartesian keeps lengths, direct takes the smaller one, strong has both."""
    vid = lambda i, j: (F.col(i) * width + F.col(j)).cast("long")
    out = []
    if kind in ("cartesian", "strong"):
        out.append(a_vertices.select(F.col("vid").alias("i")).crossJoin(b).select(vid("i", "src").alias("src"), vid("i", "dst").alias("dst"), "len"))
        out.append(b_vertices.select(F.col("vid").alias("j")).crossJoin(a).select(vid("src", "j").alias("src"), vid("dst", "j").alias("dst"), "len"))
    if kind in ("direct", "strong"):
        other = b.select(F.col("src").alias("s2"), F.col("dst").alias("d2"), F.col("len").alias("len2"))
        out.append(a.crossJoin(other).select(vid("src", "s2").alias("src"), vid("dst", "d2").alias("dst"), F.least("len", "len2").alias("len")))
    if not out:
        raise ValueError(kind)
    res = out[0]
    for x in out[1:]:
        res = res.unionByName(x)
    return res


def induced(arcs: DataFrame, mapping: DataFrame, self_loops: bool = False, multi: bool = False) -> DataFrame:
    """Arcs between the images of vertices under mapping(vid, image): no row deletes a vertex, several clone it, shared images merge.

    Loops go unless self_loops; without multi the shortest arc of each pair stays. A small mapping is broadcast by Catalyst's own size rule.
    """
    s = mapping.select(F.col("vid").alias("src"), F.col("image").alias("s"))
    d = mapping.select(F.col("vid").alias("dst"), F.col("image").alias("d"))
    out = arcs.join(s, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "len")
    out = out if self_loops else out.filter("src <> dst")
    return out if multi else out.groupBy("src", "dst").agg(F.min("len").alias("len"))


def mapping_of(codes: DataFrame) -> DataFrame:
    """mapping(vid, image) of codes(vid, code): 0 deletes, 1 keeps, k > 1 makes k clones, k < 0 merges into the image named k."""
    named = lambda j: F.concat(F.col("vid").cast("string"), F.when(j == 0, F.lit("")).when(j == 1, F.lit("'")).otherwise(F.concat(F.lit(":"), j.cast("string"))))
    kept = codes.filter("code > 0").withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("code") - 1).cast("int")))).select("vid", named(F.col("j")).alias("image"))
    return kept.unionByName(codes.filter("code < 0").select("vid", F.col("code").cast("string").alias("image")))


def substitute(arcs: DataFrame, inner: DataFrame, at: DataFrame) -> DataFrame:
    """Replace vertices at(vid) by a copy of inner(src, dst, len) with vertices named vid:w; arcs into a replaced vertex reach every copy."""
    w = inner.select(F.col("src").alias("w")).unionByName(inner.select(F.col("dst").alias("w"))).distinct()
    rest = arcs.select(F.col("src").alias("vid")).unionByName(arcs.select(F.col("dst").alias("vid"))).distinct().join(at, "vid", "left_anti")
    mapping = at.crossJoin(w).select("vid", F.concat_ws(":", "vid", "w").alias("image")).unionByName(rest.select("vid", F.col("vid").cast("string").alias("image")))
    copies = at.crossJoin(inner).select(F.concat_ws(":", "vid", "src").alias("src"), F.concat_ws(":", "vid", "dst").alias("dst"), "len")
    return induced(arcs, mapping).unionByName(copies)


def union_of(g: Graph, h: Graph, multi: bool = False, directed: bool = False) -> Graph:
    """gunion of two graphs with ids: vertices are g's, arcs of h beyond them are left out."""
    inside = h.arcs.join(g.vertices.select(F.col("vid").alias("src")), "src", "left_semi").join(g.vertices.select(F.col("vid").alias("dst")), "dst", "left_semi")
    return replace(g, arcs=gunion(g.arcs, inside, multi), id=double_compound_id("gunion(", g.id, ",", h.id, f",{int(multi)},{int(directed)})"))
