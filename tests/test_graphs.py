"""Golden constants, brute force and round trips for the graph side."""

import itertools

import numpy as np
import pytest

from knotwork.core.graph import PanicError, compound_id, graph_from_edges
from knotwork.core.rng import Stream, linksort
from knotwork.operators import algorithms as A
from knotwork.operators import circuits as C
from knotwork.operators import generators as G
from knotwork.operators import library as L
from knotwork.operators import transforms as X
from knotwork.sources import datafile, gbtext


def test_stream_golden():
    assert Stream(-314159).next() == 119318998


def test_linksort_is_a_permutation_by_falling_key():
    items = [(k % 5, k) for k in range(40)]
    got = linksort(items, Stream(3))
    assert sorted(got) == sorted(items) and [k for k, _ in got] == sorted((k for k, _ in items), reverse=True)


def test_linksort_whole_ranks_all_customers(spark, tmp_path):
    from knotwork.plans import queries as Q

    bal = {k: 100.0 * (k * 37 % 90) for k in range(3, 303)}
    spark.createDataFrame(list(bal.items()), "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    want = [c for _, c in linksort([(int(b // 1000), k) for k, b in bal.items()], Stream(314159))]
    assert [r.c_custkey for r in Q.linksort_whole(spark, str(tmp_path)).orderBy("rank").collect()] == want


def test_assignment_whole_takes_all_nations(spark, tmp_path, monkeypatch):
    from knotwork.plans import queries as Q

    m = np.random.default_rng(8).integers(1, 90, (7, 7))
    spark.range(7).selectExpr("cast(id as int) as n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    monkeypatch.setattr(Q, "nation_flow", lambda spark, _: spark.createDataFrame([(i, j, int(m[i, j])) for i in range(7) for j in range(7)], "src long, dst long, len long"))
    assert Q.assignment_whole(spark, str(tmp_path)).first().total == min(sum(m[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(7)))


def test_queen(spark):
    q = X.union_of(G.board(spark, 3, 4, piece=-1), G.board(spark, 3, 4, piece=-2))
    assert (q.n(), q.m()) == (12, 92)
    assert q.id == "gunion(board(3,4,0,0,-1,0,0),board(3,4,0,0,-2,0,0),0,0)"


def test_board_panics(spark):
    with pytest.raises(PanicError) as e:
        G.board(spark, 1_000_000, 1_000_000)
    assert e.value.code == 31


def test_petersen(spark):
    g = G.petersen(spark)
    assert g.vertices.count() == 10 and g.m() == 2 * 15  # two arcs an edge


def test_counts_of_families(spark):
    assert G.binary(spark, 4).vertices.count() == 14
    assert G.parts(spark, 6).vertices.count() == 11
    assert G.perms(spark, [1, 1, 1, 1]).vertices.count() == 24
    assert G.compositions(10, [10] * 3) == G.simplex(spark, 10, -2).vertices.count() == 66


def test_raman_degrees_and_layers(spark):
    arcs = G.raman(spark, 5, 13, 1).collect()
    assert all(sum(r.src == v for r in arcs) == 6 for v in range(14))
    assert sorted((r.src, r.dst) for r in arcs) == sorted((r.dst, r.src) for r in arcs)


def test_save_and_restore(spark, tmp_path):
    g = G.board(spark, 3, 4, piece=-1)
    gbtext.save(g, tmp_path / "a.gb")
    h = gbtext.restore(spark, tmp_path / "a.gb")
    assert h.id == g.id and sorted(map(tuple, h.arcs.select("slot", "src", "dst", "len").collect())) == sorted(map(tuple, g.arcs.select("slot", "src", "dst", "len").collect()))
    text = (tmp_path / "a.gb").read_text().replace('"0.1"', '"0.7"')
    (tmp_path / "a.gb").write_text(text)
    with pytest.raises(PanicError):
        gbtext.restore(spark, tmp_path / "a.gb")


def test_datafile_envelope(tmp_path, spark):
    datafile.write_lines(tmp_path / "b.dat", "test", ["AA Ann, first", "BB Bob, second", "CC Cy, third", "", "1:AA,BB;CC", "&:AA,CC", "2:BB,CC"])
    cast, scenes = datafile.book_tables(spark, tmp_path / "b.dat")
    assert cast.count() == 3 and scenes.count() == 7 and scenes.filter("label = '1'").count() == 5
    g = L.book(spark, str(tmp_path / "b.dat"), in_weight=1)
    assert g.n() == 3 and g.m() == 6
    bad = (tmp_path / "b.dat").read_text().replace("Bob", "Rob")
    (tmp_path / "b.dat").write_text(bad)
    with pytest.raises(PanicError) as e:
        datafile.read_lines(tmp_path / "b.dat")
    assert e.value.code == 11


def test_games(tmp_path, spark):
    datafile.write_lines(tmp_path / "g.dat", "test", ["AA Alpha(As)North;3,;,4", "BB Beta(Bs)South;,1;2,", ">A26", "AA31@BB10", ">S1", "BB7,AA7"])
    g = L.games(spark, str(tmp_path / "g.dat"), ap0=1)
    rows = sorted(tuple(r) for r in g.arcs.select("src", "dst", "len", "venue", "day").collect())
    assert rows == [(0, 1, 7, 2, 6), (0, 1, 31, 1, 0), (1, 0, 7, 2, 6), (1, 0, 10, 3, 0)]


def test_compound_id_cut():
    assert len(compound_id("complement(", "x" * 300, ",1)")) <= 160


def test_dijkstra_and_rounds(spark):
    rng = np.random.default_rng(1)
    arcs = [(int(u), int(v), int(n)) for u, v, n in rng.integers(0, [20, 20, 9], (80, 3))]
    rows = {r.vid: r.dist for r in A.shortest_paths(spark.createDataFrame(arcs, "src long, dst long, len long"), 0).collect()}
    for v in range(20):
        d, path = A.dijkstra(arcs, 0, v)
        assert rows.get(v, -1) == d
        assert not path or path[0] == 0 and path[-1] == v


def test_mst_agrees(spark):
    rng = np.random.default_rng(2)
    edges = [(int(u), int(v), int(n)) for u, v, n in rng.integers(0, [15, 15, 50], (60, 3)) if u != v]
    total, _ = A.kruskal(edges)
    got = A.minimum_spanning_forest(spark.createDataFrame([(k, *e) for k, e in enumerate(edges)], "eid long, u long, v long, len long"))
    assert total == A.prim(edges) == sum(r.len for r in got.collect())


def test_supplier_graphs_take_all_suppliers(spark, tmp_path):
    """Numbers on both sides of 100 and equal balances, against all pairs."""
    from knotwork.plans import queries as Q

    rng = np.random.default_rng(6)
    x = {int(u): int(c) for u, c in zip([*range(1, 40), *range(95, 140), *range(5000, 5030)], rng.integers(0, 60, 114) * 40_000 - 900_000, strict=True)}
    spark.createDataFrame([(u, c / 100) for u, c in x.items()], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    best = {u: sorted((abs(x[u] - x[v]), v) for v in x if v != u and abs(x[u] - x[v]) <= 100_000)[:4] for u in x}
    want = {(u, v, n) for u in x for n, v in best[u] if u < v and (n, u) in best[v]}
    assert {tuple(r) for r in Q.degree_cap(spark, str(tmp_path)).select("u", "v", "len").collect()} == want
    assert Q.mst_total(spark, str(tmp_path)).first().total == max(x.values()) - min(x.values())
    assert {r.vid: r.dist for r in Q.shortest_paths(spark, str(tmp_path)).collect()} == {v: abs(x[1] - x[v]) for v in x}


@pytest.mark.parametrize("balances", [[], [None], [12.5], [12.5, None], [None, -3.0, 12.5, None]])
def test_mst_total_of_few_suppliers_is_that_of_its_sql(spark, tmp_path, balances):
    """A supplier alone makes a total of 0, and one without a balance doesn't count."""
    import duckdb

    from knotwork.plans import queries as Q

    spark.createDataFrame(list(enumerate(balances, 1)), "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
        assert [tuple(r) for r in Q.mst_total(spark, str(tmp_path)).collect()] == c.execute(Q.ORACLE["mst_total"]).fetchall()


def test_supplier_paths_take_few_arcs(spark, tmp_path, monkeypatch):
    """Distances of all pairs from arcs in proportion to the suppliers, and null to those without a balance."""
    from knotwork.plans import queries as Q

    rng = np.random.default_rng(7)
    x = {int(u): int(c) for u, c in zip(rng.permutation(600) + 1, rng.integers(-90_000, 900_000, 600), strict=True)}
    spark.createDataFrame([*((u, c / 100) for u, c in x.items()), (700, None), (701, None)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    search = A.shortest_paths

    def counted(arcs, source):
        assert arcs.count() <= 40 * len(x)
        return search(arcs, source)

    monkeypatch.setattr(A, "shortest_paths", counted)
    got = Q.shortest_paths(spark, str(tmp_path)).collect()
    assert {r.vid: r.dist for r in got} == {v: abs(x[1] - x[v]) for v in x} | {700: None, 701: None}
    assert len(got) == 602


@pytest.mark.parametrize("suppliers", [[], [(1, 5.0)], [(1, None), (2, 1.5)], [(2, 1.5), (3, 2.5)], [(1, 2.5), (2, None), (3, -0.5)], [(1, 2.5), (2, None), (3, None)]])
def test_supplier_paths_of_few_suppliers_are_those_of_their_sql(spark, tmp_path, suppliers):
    """With null balances the search must end."""
    import duckdb

    from knotwork.plans import queries as Q

    spark.createDataFrame(suppliers, "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
        want = c.execute(Q.ORACLE["shortest_paths"]).fetchall()
    assert sorted(tuple(r) for r in Q.shortest_paths(spark, str(tmp_path)).collect()) == sorted(want)


@pytest.mark.parametrize("suppliers", [[(None, 5.0)], [(1, 5.0), (None, 5.0), (None, None)], [*((u, 7.0 * (u % 9)) for u in range(1, 25)), *((None, 7.0 * u + c) for u in range(9) for c in (-1, -0.01, 0, 0, 0, 0, 0, 0.01, 1))]])
@pytest.mark.parametrize("name", ["degree_cap", "mst_total", "shortest_paths"])
def test_suppliers_without_number_take_no_part(spark, tmp_path, name, suppliers):
    """As in the SQL, and they take no place from others."""
    import duckdb

    from knotwork.plans import queries as Q

    spark.createDataFrame(suppliers, "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
        want = c.execute(Q.ORACLE[name]).fetchall()
    assert sorted(tuple(r) for r in Q.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want)


def test_assignment_brute_force():
    rng = np.random.default_rng(3)
    for shape in ((4, 4), (3, 6), (6, 3)):
        m = rng.integers(0, 50, shape)
        w = m if shape[0] <= shape[1] else m.T
        best = min(sum(w[i, c] for i, c in enumerate(cols)) for cols in itertools.permutations(range(w.shape[1]), w.shape[0]))
        total, cols, u, v = A.assignment(m)
        assert total == best
        if shape[0] <= shape[1]:
            assert (m - u[:, None] - v[None, :] >= 0).all()


def test_biconnected():
    blocks, cuts = A.biconnected([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)])
    assert cuts == {2, 3} and sorted(map(sorted, blocks)) == [[0, 1, 2], [2, 3], [3, 4, 5]]


def test_descend_matches_recount():
    m = np.random.default_rng(4).integers(0, 30, (9, 9))
    for greedy in (False, True):
        score, order, _ = A.descend(m, list(range(9)), greedy)
        assert score == sum(m[order[i], order[j]] for i in range(9) for j in range(i))


def test_multiplier_and_reduction():
    c = C.product(3, 4)
    pairs = [(a, b) for a in range(8) for b in range(16)]
    bits = np.array([[a >> k & 1 for k in range(3)] + [b >> k & 1 for k in range(4)] for a, b in pairs])
    assert list(c.evaluate(bits) @ (1 << np.arange(7))) == [a * b for a, b in pairs]
    small, frozen = C.partial(c, 3, 0, 7)
    value = sum(b << k for k, b in enumerate(frozen[3:]))
    assert len(small.gates) < len(c.gates)
    assert list(small.evaluate(bits) @ (1 << np.arange(7))) == [a * value for a, _ in pairs]


def test_delaunay_empty_circles():
    rng = np.random.default_rng(5)
    pts = list({(int(x), int(y)) for x, y in rng.integers(0, 1000, (25, 2))})
    edges = L.delaunay(pts)
    hull = len(edges) - 3 * len(pts) + 3
    assert hull < 0 and all(0 <= u < v < len(pts) for u, v in edges)


def test_lists_are_newest_first(spark):
    g = graph_from_edges(spark, ["a", "b", "c"], [(0, 1, 5), (0, 2, 6)])
    first = {(r.src, r.pos): r.dst for r in g.adjacency().collect()}
    assert first[0, 0] == 2 and first[0, 1] == 1
