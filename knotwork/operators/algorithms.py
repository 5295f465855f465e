"""Graph algorithms: frontier and label rounds on the executors, sequential cores on the driver for graphs of bounded size."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.store import components, dropped, stored

#: Arcs that a driver-side core takes at most; beyond, PanicError tells so.
DRIVER_ARCS = 2_000_000


def _driver(arcs: DataFrame, *columns: str) -> list[tuple]:
    rows = arcs.select(*columns).limit(DRIVER_ARCS + 1).collect()
    if len(rows) > DRIVER_ARCS:
        from ..core.graph import NO_ROOM, PanicError

        raise PanicError(NO_ROOM, f"more than {DRIVER_ARCS} arcs for a sequential core")
    return [tuple(r) for r in rows]


def bfs_layers(arcs: DataFrame, sources: DataFrame, max_layers: int = 1_000_000) -> DataFrame:
    """(vid, dist) of vertices reachable along arcs(src, dst) from sources(vid).

    Only the frontier joins the arcs; each round's new layer and the visited set are tables, so lineage stays short.
    """
    seen = stored(sources.select("vid", F.lit(0).alias("dist")).distinct(), "bfs")
    front = seen
    for d in range(1, max_layers):
        step = arcs.join(front.select(F.col("vid").alias("src")), "src").select(F.col("dst").alias("vid")).distinct()
        new = stored(step.join(seen.select("vid"), "vid", "left_anti").withColumn("dist", F.lit(d)), "bfs-front")
        if new.isEmpty():
            return seen
        both = stored(seen.unionByName(new), "bfs")
        dropped(seen)
        seen, front = both, new
    return seen


def girth_from(arcs: DataFrame, source: int) -> int:
    """Length of the shortest closed walk without turning back that the search from source closes: least dist(u) + dist(v) + 1 over arcs off the tree."""
    d = bfs_layers(arcs, arcs.sparkSession.createDataFrame([(source,)], "vid long"))
    du = arcs.join(d.select(F.col("vid").alias("src"), F.col("dist").alias("du")), "src").join(d.select(F.col("vid").alias("dst"), F.col("dist").alias("dv")), "dst")
    level = du.filter("du = dv").agg(F.min(2 * F.col("du") + 1)).first()[0]
    up = du.filter("dv = du + 1").groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("dv").alias("dv")).filter("n > 1").agg(F.min(2 * F.col("dv"))).first()[0]
    return min((x for x in (level, up) if x is not None), default=0)


def shortest_paths(arcs: DataFrame, source: int, potential: DataFrame | None = None, max_rounds: int = 1_000_000) -> DataFrame:
    """(vid, dist, back) from source along arcs(src, dst, len >= 0): rounds that relax only from vertices improved the round before.

    potential(vid, h) with len >= h(src) - h(dst) reweighs arcs toward a goal; distances are given back unweighed. Of equal distances the smallest back wins.
    """
    if potential is not None:
        h = potential.select("vid", "h")
        arcs = arcs.join(h.select(F.col("vid").alias("src"), F.col("h").alias("hs")), "src").join(h.select(F.col("vid").alias("dst"), F.col("h").alias("hd")), "dst").select("src", "dst", (F.col("len") - F.col("hs") + F.col("hd")).alias("len"))
    spark = arcs.sparkSession
    best = stored(spark.createDataFrame([(source, 0, None)], "vid long, dist long, back long"), "sp")
    front = best
    for _ in range(max_rounds):
        step = front.select(F.col("vid").alias("src"), "dist").join(arcs, "src").groupBy("dst").agg(F.min(F.struct((F.col("dist") + F.col("len")).alias("dist"), F.col("src").alias("back"))).alias("b")).select(F.col("dst").alias("vid"), "b.dist", "b.back")
        new = stored(step.join(best.select("vid", F.col("dist").alias("old")), "vid", "left").filter("old is null or dist < old").select("vid", "dist", "back"), "sp-front")
        if new.isEmpty():
            break
        both = stored(best.join(new.select("vid"), "vid", "left_anti").unionByName(new), "sp")
        dropped(best)
        best, front = both, new
    if potential is None:
        return best
    hs = potential.filter(F.col("vid") == source).first()["h"]
    return best.join(potential, "vid").select("vid", (F.col("dist") - F.col("h") + hs).alias("dist"), "back")


def dijkstra(arcs: list[tuple[int, int, int]], source: int, goal: int, h: Callable[[int], int] = lambda v: 0) -> tuple[int, list[int]]:
    """(length, path) between two vertices of a small graph, -1 and no path if there is none. Ties leave the queue first in, first out; only a strict gain relaxes."""
    out: dict[int, list[tuple[int, int]]] = {}
    for u, v, n in arcs:
        out.setdefault(u, []).append((v, n))
    tick = itertools.count()
    dist, back, heap, done = {source: 0}, {}, [(0, next(tick), source)], set()
    while heap:
        d, _, u = heapq.heappop(heap)
        if u in done or d > dist[u]:
            continue
        if u == goal:
            path = [u]
            while path[-1] != source:
                path.append(back[path[-1]])
            return d + h(source) - h(goal), path[::-1]
        done.add(u)
        for v, n in out.get(u, ()):
            e = d + n - h(u) + h(v)
            if v not in dist or e < dist[v]:
                dist[v], back[v] = e, u
                heapq.heappush(heap, (e, next(tick), v))
    return -1, []


def connected_components(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """(vid, component), component being the smallest vid reachable."""
    c = components(arcs.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return vertices.select("vid").join(c, F.col("vid") == F.col("node"), "left").select("vid", F.coalesce("component", "vid").alias("component"))


def strong_components(vertices: DataFrame, arcs: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(vid, component): smallest vid of the strong component.

    Forward-backward colouring: each open vertex takes the smallest open vid that reaches it; within a colour, what
    reaches back to that vid along arcs of the colour is its component. Finished vertices leave, and so do vertices without arcs in or out.
    """
    left = stored(vertices.select("vid"), "scc-open")
    live = stored(arcs.select("src", "dst").distinct().filter("src <> dst"), "scc-arcs")
    out = None
    for _ in range(rounds):
        # trim: no arc in or no arc out is a component by itself
        core = live.select(F.col("src").alias("vid")).distinct().join(live.select(F.col("dst").alias("vid")).distinct(), "vid", "left_semi")
        alone = left.join(core, "vid", "left_anti").select("vid", F.col("vid").alias("component"))
        colour = stored(left.join(core, "vid", "left_semi").select("vid", F.col("vid").alias("c")), "scc-colour")
        while True:
            step = live.join(colour.select(F.col("vid").alias("src"), F.col("c")), "src").groupBy(F.col("dst").alias("vid")).agg(F.min("c").alias("d"))
            nxt = stored(colour.join(step, "vid", "left").select("vid", F.least("c", F.coalesce("d", "c")).alias("c")), "scc-colour")
            same = nxt.join(colour.withColumnRenamed("c", "o"), "vid").filter("c <> o").isEmpty()
            colour = nxt
            if same:
                break
        a = colour.select(F.col("vid").alias("src"), F.col("c").alias("cs"))
        b = colour.select(F.col("vid").alias("dst"), F.col("c").alias("cd"))
        inner = live.join(a, "src").join(b, "dst").filter("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = bfs_layers(inner, colour.filter("vid = c").select("vid")).select("vid")
        found = stored(alone.unionByName(colour.join(back, "vid").select("vid", F.col("c").alias("component"))), "scc")
        out = found if out is None else out.unionByName(found)
        left = stored(left.join(found, "vid", "left_anti"), "scc-open")
        if left.isEmpty():
            return out
        live = stored(live.join(left.select(F.col("vid").alias("src")), "src", "left_semi").join(left.select(F.col("vid").alias("dst")), "dst", "left_semi"), "scc-arcs")
    raise RuntimeError("rounds used up")


def component_links(arcs: DataFrame, comp: DataFrame) -> DataFrame:
    """One arc, the smallest (src, dst), for each ordered pair of components that an arc joins."""
    c = lambda end, name: comp.select(F.col("vid").alias(end), F.col("component").alias(name))
    return arcs.join(c("src", "from_comp"), "src").join(c("dst", "to_comp"), "dst").filter("from_comp <> to_comp").groupBy("from_comp", "to_comp").agg(F.min(F.struct("src", "dst")).alias("a")).select("from_comp", "to_comp", F.col("a.src").alias("src"), F.col("a.dst").alias("dst"))


def biconnected(arcs: list[tuple[int, int]]) -> tuple[list[set[int]], set[int]]:
    """Blocks and articulation points of a small graph by depth-first search with low points."""
    out: dict[int, list[int]] = {}
    for u, v in arcs:
        if u != v:
            out.setdefault(u, []).append(v)
            out.setdefault(v, []).append(u)
    order: dict[int, int] = {}
    low, cuts, blocks, edges = {}, set(), [], []
    for root in sorted(out):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        kids, walk = 0, [(root, None, iter(out[root]))]
        while walk:
            u, parent, rest = walk[-1]
            for v in rest:
                if v not in order:
                    order[v] = low[v] = len(order)
                    edges.append((u, v))
                    walk.append((v, u, iter(out[v])))
                    break
                if v != parent and order[v] < order[u]:
                    edges.append((u, v))
                    low[u] = min(low[u], order[v])
            else:
                walk.pop()
                if parent is None:
                    continue
                low[parent] = min(low[parent], low[u])
                kids += parent == root
                if low[u] >= order[parent]:
                    block = set()
                    while True:
                        e = edges.pop()
                        block |= {*e}
                        if e == (parent, u):
                            break
                    blocks.append(block)
                    if parent != root:
                        cuts.add(parent)
        if kids > 1:
            cuts.add(root)
    return blocks, cuts


def articulation_points(arcs: DataFrame) -> DataFrame:
    """vid of articulation points. Components are cut apart on the executors; each is searched in one group, as depth-first search is sequential."""
    comp = components(arcs.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    tagged = arcs.select("src", "dst").join(comp.select(F.col("node").alias("src"), "component"), "src")

    def search(pdf):
        import pandas as pd

        return pd.DataFrame({"vid": sorted(biconnected(list(zip(pdf["src"], pdf["dst"], strict=True)))[1])}, dtype="int64")

    return tagged.groupBy("component").applyInPandas(search, "vid long")


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges (eid, u, v, len) of a minimum spanning forest: each round every component takes its least (len, eid) edge and merges; log n rounds."""
    live = stored(edges.filter("u <> v").select("eid", "u", "v", "len", F.col("u").alias("cu"), F.col("v").alias("cv")), "mst")
    chosen = None
    while not live.isEmpty():
        ends = live.select(F.col("cu").alias("c"), "eid", "len").unionByName(live.select(F.col("cv").alias("c"), "eid", "len"))
        best = ends.groupBy("c").agg(F.min(F.struct("len", "eid")).alias("b")).select(F.col("b.eid").alias("eid")).distinct()
        took = stored(live.join(best, "eid"), "mst-took")
        part = took.select("eid", "u", "v", "len")
        chosen = part if chosen is None else chosen.unionByName(part)
        c = components(took.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        label = lambda col: c.select(F.col("node").alias(col), F.col("component").alias(col + "2"))  # noqa: E731, B023
        live = stored(live.join(label("cu"), "cu", "left").join(label("cv"), "cv", "left").select("eid", "u", "v", "len", F.coalesce("cu2", "cu").alias("cu"), F.coalesce("cv2", "cv").alias("cv")).filter("cu <> cv"), "mst")
    return chosen if chosen is not None else edges.select("eid", "u", "v", "len").limit(0)


def kruskal(edges: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
    """(length, edges) of a spanning forest of a small graph, union by size."""
    boss: dict[int, int] = {}
    size: dict[int, int] = {}

    def find(x):
        boss.setdefault(x, x)
        while boss[x] != x:
            boss[x] = boss[boss[x]]
            x = boss[x]
        return x

    took = []
    for u, v, n in sorted(edges, key=lambda e: e[2]):
        a, b = find(u), find(v)
        if a != b:
            if size.get(a, 1) < size.get(b, 1):
                a, b = b, a
            boss[b], size[a] = a, size.get(a, 1) + size.get(b, 1)
            took.append((u, v, n))
    return sum(n for *_, n in took), took


def prim(edges: list[tuple[int, int, int]]) -> int:
    """Length of a spanning forest by growing trees with a heap."""
    out: dict[int, list[tuple[int, int]]] = {}
    for u, v, n in edges:
        out.setdefault(u, []).append((n, v))
        out.setdefault(v, []).append((n, u))
    seen, total = set(), 0
    for root in out:
        heap = [(0, root)]
        while heap:
            n, u = heapq.heappop(heap)
            if u not in seen:
                seen.add(u)
                total += n
                for e in out[u]:
                    if e[1] not in seen:
                        heapq.heappush(heap, e)
    return total


def assignment(cost: np.ndarray) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """Least total cost of giving each row of an m x n matrix (m <= n, else it is turned over) a column of its own, the columns, and duals that prove it."""
    a = np.asarray(cost, np.int64)
    if a.shape[0] > a.shape[1]:
        total, cols, u, v = assignment(a.T)
        rows = [-1] * a.shape[0]
        for r, c in enumerate(cols):
            rows[c] = r
        return total, rows, v, u
    m, n = a.shape
    u, v, owner = np.zeros(m + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    big = np.iinfo(np.int64).max // 4
    for i in range(1, m + 1):  # shortest augmenting path from row i over reduced costs
        owner[0], j0 = i, 0
        slack, way, used = np.full(n + 1, big), np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
        while owner[j0]:
            used[j0] = True
            i0 = owner[j0]
            free = np.flatnonzero(~used[1:]) + 1
            red = a[i0 - 1, free - 1] - u[i0] - v[free]
            better = red < slack[free]
            slack[free[better]], way[free[better]] = red[better], j0
            j1 = free[np.argmin(slack[free])]
            step = slack[j1]
            u[owner[used]] += step
            v[used] -= step
            slack[free] -= step
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    cols = [-1] * m
    for j in range(1, n + 1):
        if owner[j]:
            cols[owner[j] - 1] = j - 1
    return int(sum(a[i, c] for i, c in enumerate(cols))), cols, u[1:], v[1:]


def column_minima(cells: DataFrame) -> DataFrame:
    """cells(i, j, val) with each column's minimum taken off: a cheap start for the assignment."""
    low = cells.groupBy("j").agg(F.min("val").alias("low"))
    return cells.join(low, "j").select("i", "j", (F.col("val") - F.col("low")).alias("val"))


def feed_forward_bound(flows: DataFrame) -> DataFrame:
    """bound: no order of sectors has less flow against it than the sum of the smaller flow of each pair. flows(src, dst, len)."""
    back = flows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("len").alias("back"))
    return flows.filter("src < dst").join(back, ["src", "dst"]).agg(F.coalesce(F.sum(F.least("len", "back")), F.lit(0)).cast("long").alias("bound"))


def order_score(flows: DataFrame, order: DataFrame) -> DataFrame:
    """score: flow from later to earlier places of order(vid, place)."""
    p = lambda end, name: order.select(F.col("vid").alias(end), F.col("place").alias(name))
    return flows.join(p("src", "ps"), "src").join(p("dst", "pd"), "dst").filter("ps > pd").agg(F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("score"))


def descend(matrix: np.ndarray, order: list[int], greedy: bool = False) -> tuple[int, list[int], int]:
    """Local search over moves of one sector to another place: (score, order, steps). Cautious takes the smallest gain, greedy the largest."""
    m, order, steps = np.asarray(matrix, np.int64), list(order), 0
    while True:
        a = m[np.ix_(order, order)]
        # moving k left over j saves a[k, j] and costs a[j, k]
        best = None
        for k in range(len(order)):
            left = np.cumsum((a[k, :k] - a[:k, k])[::-1])
            right = np.cumsum(a[k + 1 :, k] - a[k, k + 1 :])
            for places, run in ((range(k - 1, -1, -1), left), (range(k + 1, len(order)), right)):
                for j, g in zip(places, run.tolist(), strict=True):
                    if g > 0 and (best is None or (g > best[0] if greedy else g < best[0])):
                        best = (g, k, j)
        if best is None:
            return int(np.tril(a, -1).sum()), order, steps
        _, k, j = best
        order.insert(j, order.pop(k))
        steps += 1


def greedy_chain(margins: DataFrame, start: int, goal: int) -> list[tuple[int, int, int]]:
    """A chain of games (src, dst, margin) from start to goal: the largest margin among opponents not met that still reach the goal; the goal itself only as a last resort."""
    out: dict[int, dict[int, int]] = {}
    for u, v, d in _driver(margins, "src", "dst", "del"):
        out.setdefault(u, {})
        out[u][v] = max(d, out[u].get(v, d))

    def reaches(v, met):
        todo, seen = [v], {*met, v}
        while todo:
            for w in out.get(todo.pop(), {}):
                if w == goal:
                    return True
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return False

    chain, u, met = [], start, {start}
    while u != goal:
        some = [(d, -v, v) for v, d in out.get(u, {}).items() if v not in met and v != goal and reaches(v, met)]
        if not some:
            if goal not in out.get(u, {}):
                return []
            chain.append((u, goal, out[u][goal]))
            break
        d, _, v = max(some)
        chain.append((u, v, d))
        met.add(v)
        u = v
    return chain


def beam_chain(margins: DataFrame, start: int, goal: int, width: int) -> list[tuple[int, int, int]]:
    """The best chain that a search keeping width partial chains a length finds."""
    out: dict[int, dict[int, int]] = {}
    for u, v, d in _driver(margins, "src", "dst", "del"):
        out.setdefault(u, {})[v] = max(d, out.get(u, {}).get(v, d))
    beam, best = [(0, (start,))], None
    while beam:
        nxt = []
        for total, path in beam:
            for v, d in out.get(path[-1], {}).items():
                if v == goal:
                    if best is None or total + d > best[0]:
                        best = (total + d, (*path, v))
                elif v not in path:
                    nxt.append((total + d, (*path, v)))
        beam = heapq.nlargest(width, nxt)
    if best is None:
        return []
    return [(u, v, out[u][v]) for u, v in itertools.pairwise(best[1])]


def diameter_bounds(n: int, degree: int) -> tuple[int, int]:
    """(least possible diameter, largest possible girth) of a graph with n vertices of that degree, from the sizes of balls."""
    reach, layer, d = 1, degree, 0
    while reach < n:
        reach, layer, d = reach + layer, layer * (degree - 1), d + 1
    g, ball, layer, k = 1, 1, degree, 0
    while True:  # odd girth 2k + 1 needs balls of radius k, even girth 2k two balls around an edge
        odd = 1 + degree * sum((degree - 1) ** i for i in range(k + 1))
        even = 2 * sum((degree - 1) ** i for i in range(k + 2))
        if odd <= n:
            g = 2 * (k + 1) + 1
        if even <= n:
            g = max(g, 2 * (k + 2))
        if odd > n:
            return d, max(g, 3)
        k += 1


def freq_cost(weight: F.Column) -> F.Column:
    """16 less the number of binary digits of a weight, not below 0."""
    return F.greatest(F.lit(0), 16 - F.when(weight > 0, F.length(F.bin(weight))).otherwise(0))


def hamming(a: F.Column, b: F.Column) -> F.Column:
    letters = lambda c: F.split(c, "")
    return F.aggregate(F.zip_with(letters(a), letters(b), lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def alphabetic(a: F.Column, b: F.Column) -> F.Column:
    """Sum of the distances between letters at equal places."""
    letters = lambda c: F.split(c, "")
    return F.aggregate(F.zip_with(letters(a), letters(b), lambda x, y: F.abs(F.ascii(x) - F.ascii(y))), F.lit(0), lambda s, x: s + x)
