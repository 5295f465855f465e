"""Combinatorial generators: ids, sizes and orders of the published samples, one arc schema for all, numbers without gaps."""

import duckdb
import pytest
from pyspark.sql import functions as F

from knotwork.core.graph import PanicError, numbered
from knotwork.operators import generators as G
from knotwork.operators import transforms as X
from knotwork.plans import queries
from knotwork.sources import gbtext


def names(g):
    return [r["name"] for r in g.vertices.orderBy("vid").collect()]


def test_samples(spark):
    g = G.perms(spark, [1, 1, 1])
    assert (g.id, g.n(), g.m(), g.util_types) == ("perms(1,1,1,0,0,3,0)", 6, 12, "VVZZZZZZZZZZZZ") and names(g)[0] == "012" and "210" in names(g)
    g = G.parts(spark, 6)
    assert (g.id, g.n()) == ("parts(6,6,6,0)", 11) and (names(g)[0], names(g)[10]) == ("1+1+1+1+1+1", "6")
    g = G.binary(spark, 4)
    assert (g.id, g.n()) == ("binary(4,4,0)", 14) and all(len(x) == 9 for x in names(g))
    g = G.binary(spark, 100, 5)
    assert (g.n(), g.m()) == (0, 0)
    for f, code in ((lambda: G.parts(spark, 100, 92), 30), (lambda: G.binary(spark, 40, 31), 40)):
        with pytest.raises(PanicError) as e:
            f()
        assert e.value.code == code


def test_heights(spark):
    def levels(code):
        it = iter(code)
        f = lambda: 0 if next(it) == "x" else 1 + max(f(), f())
        return f()

    every = names(G.all_trees(spark, 5))
    assert len(every) == 42
    for h in (3, 4):
        assert names(G.binary(spark, 5, h)) == [x for x in every if levels(x) <= h]


@pytest.mark.parametrize("make", [lambda s: G.simplex(s, 4, 3, -2), lambda s: G.petersen(s), lambda s: G.all_perms(s, 4), lambda s: G.all_parts(s, 7), lambda s: G.all_trees(s, 4)])
def test_one_schema(spark, tmp_path, make):
    """Numbers of vertices and slots have no gaps; adjacency, mates, unions and files work on all of them."""
    g = make(spark)
    v = [r.vid for r in g.vertices.orderBy("vid").collect()]
    assert v == list(range(len(v))) and names(g) == [r["name"] for r in g.vertices.orderBy("x").collect()] if "x" in g.vertices.columns else True
    arcs = g.arcs.orderBy("slot").collect()
    assert [a.slot for a in arcs] == list(range(len(arcs))) and {"slot", "src", "dst", "len"} <= set(g.arcs.columns)
    assert all((a.src, a.dst) == (b.dst, b.src) for a, b in zip(arcs[::2], arcs[1::2], strict=True))
    assert g.adjacency().count() == g.mated().count() == len(arcs)
    gbtext.save(g, tmp_path / "g.gb")
    back = gbtext.restore(spark, tmp_path / "g.gb")
    assert (back.n(), back.m(), back.id) == (g.n(), g.m(), g.id)


def test_numbers_follow_the_order(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = numbered(df, ["a"], "k").orderBy("k").collect()
    assert [r.k for r in got] == list(range(1000)) and [r.a for r in got] == list(range(1000))
    assert numbered(df.limit(0), ["a"], "k").count() == 0


@pytest.mark.parametrize("name", ["binary_trees", "simplex", "subsets", "parts", "perms", "petersen", "raman_line", "raman_pairs", "raman_matrices"])
def test_queries_against_sql(spark, name):
    want = duckdb.sql(queries.ORACLE[name])
    cols = sorted(want.columns)
    out = queries.QUERIES[name](spark, "")
    assert sorted(out.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(r) for r in out.select(*cols).collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def layers(arcs):
    """Diameter and girth from vertex 0 of a graph that looks the same from everywhere; arcs (src, dst) both ways."""
    to = {}
    for a in arcs:
        to.setdefault(a.src, []).append(a.dst)
    far, girth, last, via = {0: 0}, None, [0], {0: None}
    while last:
        nxt = []
        for u in last:
            back = via[u]
            for v in to[u]:
                if v not in far:
                    far[v], via[v] = far[u] + 1, u
                    nxt.append(v)
                elif v == back:
                    back = None  # the edge that u was reached by, once
                else:
                    girth = min(girth or 10**9, far[u] + far[v] + 1)
        last = nxt
    return max(far.values()), girth, len(far)


@pytest.mark.parametrize("p,q,n,far,girth", [(3, 7, 336, 6, 8), (2, 17, 2448, 15, 9), (5, 3, 24, 3, 4), (7, 11, 1320, 6, 6), (3, 5, 120, 6, 6)])
def test_diameter_and_girth_of_matrices(spark, p, q, n, far, girth):
    arcs = G.raman(spark, p, q, 0).collect()
    assert len(arcs) == n * (p + 1)
    assert layers(arcs) == (far, girth, n)


def test_raman_graphs(spark):
    g = G.raman_graph(spark, 31, 3, 0, 4)
    assert (g.id, g.n(), g.m(), g.util_types) == ("raman(31,3,3,4)", 12, 96, "ZZZIIIIZZZZZZZ")
    g = G.raman_graph(spark, 5, 3, 1, 0)
    assert (g.n(), g.util_types) == (4, "ZZZIZZIZZZZZZZ")
    g = G.raman_graph(spark, 3, 5, 4, 0)
    assert g.m() == 120 * 4 and g.arcs.groupBy("src").count().filter("count <> 4").count() == 0
    for args, code in (((31, 2, 0), 40), ((1, 3, 0), 41), ((6, 3, 0), 33), ((31, 3, 4), 34), ((3, 9, 1), 31), ((2, 7, 0), 32), ((9, 5, 1), 37)):
        with pytest.raises(PanicError) as e:
            G.raman_graph(spark, *args)
        assert e.value.code == code, args
