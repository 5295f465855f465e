"""Random graphs with distributions, and words, thesaurus and picture on small files; goldens are published results."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.core.graph import PanicError, graph_from_edges
from knotwork.core.rng import MOD, Stream, linksort
from knotwork.operators import generators as G
from knotwork.operators import library as L
from knotwork.sources import datafile

DIST = [0x20000000, 0x10000000, 0x10000000]


def arcs_of(g):
    return [tuple(r) for r in g.arcs.orderBy("slot").select("src", "dst", "len").collect()]


def panics(code, f, *args, **named):
    with pytest.raises(PanicError) as e:
        f(*args, **named)
    assert e.value.code == code


def test_alias_table():
    table = G.alias_table(DIST, 4)
    assert [cut for cut, _ in table] == [0x1FFFFFFF, 0x3FFFFFFF, 0x5FFFFFFF, 0x5FFFFFFF] and table[3][1] == 0
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 8, 13):
        cuts = sorted(rng.integers(0, MOD >> 1, n - 1).tolist())
        dist = [b - a for a, b in itertools.pairwise([0, *cuts, MOD >> 1])]
        size = 1 << (n - 1).bit_length()
        wide, mass = MOD // size, Counter()
        for k, (cut, alias) in enumerate(G.alias_table(dist, size)):
            mass[k] += cut + 1 - k * wide
            mass[alias] += (k + 1) * wide - cut - 1
        assert [mass[k] for k in range(size)] == [2 * d for d in dist] + [0] * (size - n)


def test_random_graph(spark):
    g = G.random_graph(spark, 3, 10, 1, True, False, 1, 2, 1, None, DIST)
    assert (g.id, g.n(), g.m()) == ("random_graph(3,10,1,1,0,0,dist,1,2,1)", 3, 20)
    assert g.mated().filter("len <> mate_len or len not between 1 and 2").count() == 0
    g = G.random_graph(spark, 4, 7, 1, True, True, 5, 9, 3)
    assert g.m() == 7 and [x[1:] for x in arcs_of(g) if x[0] == 2] == [(0, 5)]
    g = G.random_graph(spark, 3, 8, -1, True, False, 1, 5, 11)
    assert (g.id, g.m()) == ("random_graph(3,8,-1,1,0,0,0,1,5,11)", 6)
    panics(30, G.random_graph, spark, 0, 1)
    panics(40, G.random_graph, spark, 3, 1, min_len=2)
    panics(31, G.random_graph, spark, 3, 1, min_len=-(1 << 30), max_len=1 << 30)
    for dist, code in (([1, 1, 1], 2), ([-1, 1, MOD >> 1], 0), ([MOD >> 1, 1, 0], 1)):
        panics(60 + code, G.random_graph, spark, 3, 1, dist_from=dist)
        panics(65 + code, G.random_graph, spark, 3, 1, dist_to=dist)


def test_random_bigraph(spark):
    g = G.random_bigraph(spark, 2, 3, 5, 0, 1, 3, 5)
    assert (g.id, g.m(), g.n1) == ("random_bigraph(2,3,5,0,0,0,1,3,5)", 10, 2)
    assert g.arcs.filter("(src < 2) = (dst < 2)").count() == 0
    g = G.random_bigraph(spark, 2, 3, 4, 1, 1, 1, 9, [0x30000000, 0x10000000], DIST)
    assert g.id == "random_bigraph(2,3,4,1,dist,dist,1,1,9)"
    g = G.random_bigraph(spark, 2, 3, 3, 1, 1, 1, 5, [MOD >> 1, 0], [0, 0, MOD >> 1])
    assert arcs_of(g) == [(0, 4, 1), (4, 0, 1)] * 3
    panics(30, G.random_bigraph, spark, 0, 1, 1)
    panics(40, G.random_bigraph, spark, 1, 1, 1, min_len=2)
    panics(31, G.random_bigraph, spark, 1, 1, 1, min_len=-(1 << 30), max_len=1 << 30)
    panics(62, G.random_bigraph, spark, 2, 1, 1, dist1=[1, 1])


def test_random_lengths(spark):
    path = graph_from_edges(spark, ["0", "1", "2"], [(1, 2, 1), (0, 1, 1)], directed=True)
    g = G.random_lengths(path, True, 10, 12, DIST, 4)
    assert [x for x in arcs_of(g) if x[0] == 0] == [(0, 1, 12)] and g.id == "random_lengths(,1,10,12,dist,4)"
    hand = graph_from_edges(spark, ["a", "b"], [(0, 1, 4), (1, 1, 4)], "hand")
    g = G.random_lengths(hand, False, 7, 7, None, 5)
    assert g.id == "random_lengths(hand,0,7,7,0,5)" and {x[2] for x in arcs_of(g)} == {7} and g.m() == 4
    big = G.random_lengths(G.random_graph(spark, 12, 40, 1, True, False, 1, 1, 6), False, 1, 1000, None, 8)
    assert big.mated().filter("len <> mate_len").count() == 0
    s = Stream(8)
    drawn = [r.len for r in big.adjacency().filter("slot % 2 = 0").orderBy("src", "pos").collect()]
    assert drawn == [1 + s.below(1000) for _ in drawn] and len(drawn) == 40
    panics(50, G.random_lengths, None, False, 0, 0)
    panics(40, G.random_lengths, hand, False, 3, 1)
    panics(30, G.random_lengths, hand, False, -(1 << 30), 1 << 30)
    panics(1, G.random_lengths, hand, False, 1, 2, [MOD >> 1, 1])
    panics(-1, G.random_lengths, hand, False, 0, 1, [-1, (MOD >> 1) + 1])
    panics(2, G.random_lengths, hand, False, 0, 1, [1 << 28, 1 << 28])


def test_random_native_follows_its_distribution(spark):
    e = G.random_native(spark, 3, 40_000, 1, True, 5, 2, DIST, [0, MOD >> 1, 0])
    got = {r.src: r["count"] for r in e.groupBy("src").count().collect()}
    assert sum(got.values()) == 40_000 and all(abs(got[k] / 40_000 - DIST[k] / 2**30) < 0.015 for k in range(3))
    assert e.filter("dst <> 1 or len not between 1 and 5").count() == 0


def test_words(spark, tmp_path):
    letters, path = "abc", tmp_path / "words.dat"
    names = ["".join(x) + "e" for x in itertools.product(letters, repeat=4)]
    np.random.default_rng(3).shuffle(names)
    lines = [(w + "*+ "[k % 3] + ",".join(str((k * j) % 7) for j in range(1, 1 + k % 4))).rstrip() for k, w in enumerate(names)]
    datafile.write_lines(path, "Words", lines)
    weight = {w: (100, 10, 0)[k % 3] + sum((k * j) % 7 * (4, 2, 2)[j - 1] for j in range(1, 1 + k % 4)) for k, w in enumerate(names)}
    want = [(x, w) for x, w in linksort([(weight[w], w) for w in reversed(names) if weight[w] >= 12], Stream(69))][:40]
    g = L.words(spark, path, 40, None, 12, 69)
    assert (g.id, g.util_types) == ("words(40,0,12,69)", "IZZZZZIZZZZZZZ")
    assert [(r.weight, r["name"]) for r in g.vertices.orderBy("vid").collect()] == want
    order, edges = [w for _, w in want], []
    for v, word in enumerate(order):
        edges += [(u, v, k) for k in range(5) for u in range(v) if [i for i in range(5) if order[u][i] != word[i]] == [k]]
    got = [tuple(r) for r in g.arcs.filter("slot % 2 = 0").orderBy("slot").select("src", "dst", "pos").collect()]
    assert got == edges and g.m() == 2 * len(edges) and edges
    own = (100, -80589, 50000, 18935, -18935, 18935, 18935, 18935, 18935)
    panics(30, L.words, spark, path, 100, own)
    assert L.words(spark, path, 100, (100, -80588, *own[2:]), 1 << 30, 69).id == f"words(0,{{100,-80588,{','.join(map(str, own[2:]))}}},{1 << 30},69)"
    panics(40, L.words, spark, path, 100, (1 << 31, *own[1:]))
    for line, code in (("aback?", 20), ("aback*" + ",".join("1" * 8), 21), ("aback 15195", 22)):
        datafile.write_lines(path, "Words", [line])
        panics(code, L.words, spark, path)


def test_roget(spark, tmp_path):
    path, rng = tmp_path / "roget.dat", np.random.default_rng(5)
    refs = {c: sorted(set(rng.integers(1, 1023, int(rng.integers(0, 9))).tolist())) for c in range(1, 1023)}
    lines = []
    for c, own in refs.items():
        half = len(own) // 2
        lines += [f"{c}name{c}:{' '.join(map(str, own[:half]))}\\", f" {' '.join(map(str, own[half:]))}"] if half and c % 3 == 0 else [f"{c}name{c}:{' '.join(map(str, own))}"]
    datafile.write_lines(path, "Categories", lines)
    g = L.roget(spark, path)
    assert (g.id, g.n(), g.m(), g.util_types) == ("roget(1022,0,0,0)", 1022, sum(map(len, refs.values())), "IZZZZZZZZZZZZZ")
    g = L.roget(spark, path, 1000, 3, 1009, 1009)
    v = {r.vid: r.cat for r in g.vertices.collect()}
    assert len(set(v.values())) == 1000 and g.vertices.filter("name <> concat('name', cat)").count() == 0
    # the first two goldens of the full thesaurus depend on the stream alone
    assert v[40] == 461 and L.roget(spark, path).vertices.filter("vid = 1000").first().cat == 636
    s, there = Stream(1009), {c: k for k, c in v.items()}
    for k in range(1000):
        s.below(1022 - k)
    want = [(there[a], there[b], 1) for a in refs for b in refs[a] if a in there and b in there and abs(a - b) >= 3 and s.next() >> 15 >= 1009]
    assert arcs_of(g) == want
    datafile.write_lines(path, "Categories", lines[:-1])
    panics(90, L.roget, spark, path)


def picture(path, grey):
    out = []
    for row in grey:
        text = ""
        for k in range(0, len(row), 4):
            part = row[k : k + 4]
            v = int.from_bytes(bytes(part), "big")
            text += "".join(datafile.char_of(v // 85**i % 85) for i in reversed(range(5 if len(part) == 4 else 3)))
        out += [text[k : k + 75] for k in range(0, len(text), 75)]
    datafile.write_lines(path, "Picture", out)


def test_lisa(spark, tmp_path):
    grey = np.random.default_rng(6).integers(0, 256, (360, 250))
    grey[::7] = grey[::7] // 9
    path = tmp_path / "lisa.dat"
    picture(path, grey.tolist())
    assert [r.grey for r in datafile.picture_table(spark, path).filter("row = 11").orderBy("col").collect()] == grey[11].tolist()
    cells, full = L.lisa(spark, path, 4, 4, 255)
    assert full == (4, 4, 255, 0, 360, 0, 250, 0, 22950000)
    spec = (3, 7, 50, 100, 110, 20, 33, 4000, 30000)
    fine = np.kron(grey[100:110, 20:33], np.ones((3, 7), int)).reshape(3, 10, 7, 13).sum((1, 3))
    want = np.clip((fine - 4000) * 50 // 26000, 0, 50)
    got = np.zeros((3, 7), int)
    for r in L.lisa(spark, path, *spec)[0].collect():
        got[r.i, r.j] = r.val
    assert (got == want).all()
    g = L.bi_lisa(spark, path, 10, 8, 100, 110, 100, 108, 20000, True)
    cut = {(i, 10 + j): int(grey[100 + i, 100 + j] * 65535 // 255) for i in range(10) for j in range(8)}
    assert (g.id, g.n(), g.n1, g.util_types) == ("bi_lisa(10,8,100,110,100,108,20000,1)", 18, 10, "ZZZZZZZIIZZZZZ")
    assert {(r.src, r.dst): r.b for r in g.arcs.filter("src < dst").collect()} == {k: x for k, x in cut.items() if x < 20000} and g.vertices.filter("vid = 12").first()["name"] == "c2"
    for bad, code in (((5, 5, 0, 10, 10), 31), ((5, 5, 0, 0, 0, 9, 9), 32), ((5, 5, 0, 0, 0, 0, 0, 7, 7), 33), ((5, 5, 0, 0, 0, 0, 0, 0, 1 << 31), 34)):
        panics(code, L.lisa, spark, path, *bad)


def test_regions_of_the_picture(spark, tmp_path):
    grey = np.random.default_rng(7).integers(0, 3, (360, 250)) * 100
    path = tmp_path / "lisa.dat"
    picture(path, grey.tolist())
    m, n = 9, 12
    g = L.plane_lisa(spark, path, m, n, 255, 5, 5 + m, 40, 40 + n)
    val = grey[5 : 5 + m, 40 : 40 + n]
    assert g.id == f"plane_lisa(9,12,255,5,14,40,52,0,{255 * m * n})" and g.facts == {"rows": 9, "cols": 12}
    own, spans = {}, []
    for cell in itertools.product(range(m), range(n)):
        if cell in own:
            continue
        todo, mine = [cell], []
        own[cell] = len(spans)
        while todo:
            i, j = todo.pop()
            mine.append(i * n + j)
            for x in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if 0 <= x[0] < m and 0 <= x[1] < n and x not in own and val[x] == val[cell]:
                    own[x] = len(spans)
                    todo.append(x)
        spans.append((len(spans), str(len(spans)), int(val[cell]), min(mine), max(mine)))
    assert [tuple(r) for r in g.vertices.orderBy("vid").collect()] == spans
    edges = []
    for i, j in itertools.product(range(m), range(n)):
        for x in ((i - 1, j), (i, j - 1)):
            if min(x) >= 0 and own[x] != own[i, j] and (e := tuple(sorted((own[x], own[i, j])))) not in edges:
                edges.append(e)
    assert [tuple(r) for r in g.arcs.filter("slot % 2 = 0").orderBy("slot").select("src", "dst").collect()] == edges
    assert g.arcs.filter(F.col("len") != 1).count() == 0
