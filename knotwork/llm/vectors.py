"""Vector operators: near-duplicates by rotated binary codes, exact top-k search by ball trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, mix, stored

#: Of a pair at the threshold, the probability that all bands miss it is at most MISS.
MISS = 0.002
#: Members of one bucket in one group; larger buckets are cut into pairs of parts of this size.
PART, TILE = 4096, 1024
#: Groups of up to SMALL rows are estimated together by size; groups come together until there are CHUNK rows.
SMALL, CHUNK = 64, 8192
#: Standard deviations of the estimate that the confidence bound takes.
SIGMAS = 4.5
SHARD, QUERY_BLOCK, LEAF = 8192, 2048, 64


def usable(v: F.Column) -> F.Column:
    """True for vectors without null and non-finite components and with at least one component."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(col: pa.Array, kind=np.float64) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(col), -1)


@lru_cache(maxsize=64)
def rotation(dim: int, number: int) -> np.ndarray:
    """Random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number, 11]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def banding(n: int, dim: int, threshold: float) -> tuple[int, int]:
    """Bits of a band and number of bands for n vectors: buckets hold about 16 vectors, all bands miss a pair at the threshold with probability MISS."""
    bits = int(min(24, max(6, round(math.log2(max(n, 2)) - 4))))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-hit)))


def codes(u: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Bucket of each unit vector in each band: signs of rotated components, bits of them to a band."""
    dim = u.shape[1]
    signs = np.concatenate([u @ rotation(dim, k).T > 0 for k in range(1, 2 + bits * bands // dim)], axis=1)[:, : bits * bands]
    weight = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    return (signs.reshape(len(u), bands, bits) * weight).sum(2)


def estimated(rot_a: np.ndarray, signs_b: np.ndarray, factor_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of unit vectors a with the coded b, and half the width of their confidence bounds.

    b is known by the signs of its rotated components and factor = <b, code>, a by its rotated components.
    <a, code> / factor estimates <a, b>; its error shrinks with the square root of dim - 1. Stacks of matrices give stacks.
    """
    dim = rot_a.shape[-1]
    est = (rot_a @ np.swapaxes(signs_b, -1, -2)) / math.sqrt(dim) / factor_b
    half = SIGMAS * np.sqrt(np.maximum(0, 1 - factor_b**2) / factor_b**2 / max(1, dim - 1))
    return est, half


def _candidates(rot: np.ndarray, signs: np.ndarray, factor: np.ndarray, starts: np.ndarray, sizes: np.ndarray, own: np.ndarray, mixed: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of rows of one group that the bounds don't rule out; groups are runs of rows. In mixed groups only pairs of different parts.

    Groups of one size are estimated together, as most hold a few rows only; larger ones go tile by tile.
    """
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        same = np.flatnonzero(sizes == size)
        upper = np.triu(np.ones((size, size), bool), 1)
        step = max(1, (1 << 20) // int(size * max(size, rot.shape[1])))
        for a in range(0, len(same), step):
            g = same[a : a + step]
            at = starts[g][:, None] + np.arange(size)
            est, half = estimated(rot[at], signs[at], factor[at][:, None, :])
            m = (est + half >= threshold - 1e-5) & upper & (~mixed[g][:, None, None] | (own[at][:, :, None] != own[at][:, None, :]))
            k, i, j = np.nonzero(m)
            yield at[k, i], at[k, j]
    for g in np.flatnonzero(sizes > SMALL):
        first, last = starts[g], starts[g] + sizes[g]
        for a in range(first, last, TILE):
            for b in range(a, last, TILE):
                p, q = slice(a, min(a + TILE, last)), slice(b, min(b + TILE, last))
                est, half = estimated(rot[p], signs[q], factor[q][None, :])
                i, j = np.nonzero(est + half >= threshold - 1e-5)
                i, j = i + a, j + b
                m = i < j
                if mixed[g]:
                    m &= own[i] != own[j]
                yield i[m], j[m]


def _links(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, band: np.ndarray, own: np.ndarray, mixed: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs i < j of the groups of x that meet in no earlier band than their group's. Codes are made for rows of linked pairs only."""
    dim = x.shape[1]
    norm = np.sqrt((x * x).sum(1))
    u = x / norm[:, None]
    rot = (u @ rotation(dim, 0).T).astype(np.float32)
    signs = np.where(rot > 0, np.float32(1), np.float32(-1))
    factor = np.abs(rot).sum(1) / math.sqrt(dim)
    found = [(np.zeros(0, np.int64),) * 2]
    for i, j in _candidates(rot, signs, factor, starts, sizes, own, mixed, threshold):
        for c in range(0, len(i), 1 << 16):
            p, q = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
            m = (x[p] * x[q]).sum(1) / (norm[p] * norm[q]) >= threshold
            found.append((p[m], q[m]))
    i, j = (np.concatenate(f) for f in zip(*found, strict=True))
    if not len(i):
        return i, j
    bits, bands = banding(n, dim, threshold)
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    code = np.concatenate([codes(u[rows[c : c + 4096]], bits, bands) for c in range(0, len(rows), 4096)])
    new = np.ones(len(i), bool)
    for c in range(0, len(i), 1 << 16):
        p, q = at[: len(i)][c : c + (1 << 16)], at[len(i) :][c : c + (1 << 16)]
        new[c : c + (1 << 16)] = ~((code[p] == code[q]) & (np.arange(bands) < band[i[c : c + (1 << 16)]][:, None])).any(1)
    return i[new], j[new]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors(vec_id, embedding).

    Rows link when the cosine in double precision is at least threshold. Null and zero vectors, and vectors with null or
    non-finite components, link with nothing; vectors of different length don't link. n_links counts other rows; equal
    vectors are one class with a multiplicity, and so are many copies. component_id is the smallest vec_id reachable.
    Equal vectors are told by a 64-bit hash; an empty table gives an empty result; other columns are not read.
    Rows with one vec_id count as separate vectors. No linked pair is below the threshold; a pair at the threshold is missed with probability
    MISS at most (fewer for more similar ones), as pairs are found in buckets of sign bits. Inside a bucket, rotated binary codes
    with their correction factors give an estimate and a bound, and only pairs that the bound doesn't rule out are computed exactly.
    """
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    ok = usable(v) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("k", F.when(ok, F.xxhash64("embedding")))
    classes = stored(rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("low"), F.first("embedding").alias("e")).withColumn("dim", F.size("e")), "classes")
    n = classes.count()

    def banded(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                x = _matrix(part.column("e"))
                bits, bands = banding(n, int(d), threshold)
                # scaled before squaring, so that large components don't overflow
                x = x / np.abs(x).max(1)[:, None]
                c = codes(x / np.sqrt((x * x).sum(1))[:, None], bits, bands)
                for k in range(bands):
                    h = mix(c[:, k].astype(np.uint64) + np.uint64(int(d) << 40 | k << 32)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(c), k, np.int32)), part.column("k"), part.column("m")], names=["g", "band", "k", "m"])

    place = stored(classes.select("k", "m", "e", "dim").mapInArrow(banded, "g long, band int, k long, m long"), "bands")
    count = place.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")
    met = place.join(count, "g").withColumn("parts", parts).withColumn("own", own)
    met = met.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", "band", "k", "m", "own", F.least("own", "t").alias("i"), F.greatest("own", "t").alias("j"))
    met = met.join(classes.select("k", "e"), "k").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "k")

    def solve(t: pa.Table, cut: np.ndarray):
        """Links of the groups of t, runs of rows that begin at cut."""
        dims = pc.list_value_length(t.column("e")).to_numpy()
        sizes = np.diff(cut, append=len(t))
        for d in np.unique(dims[cut]).tolist():
            part = t.filter(pa.array(dims == d)).combine_chunks()  # vectors of one group have one length
            count = sizes[dims[cut] == d]
            key, m, own, band, i, j = (part.column(c).to_numpy() for c in ("k", "m", "own", "band", "i", "j"))
            x = _matrix(part.column("e").combine_chunks())
            starts = np.cumsum(count) - count
            i, j = _links(x / np.abs(x).max(1)[:, None], starts, count, band, own, (i != j)[starts], n, threshold)
            links = np.bincount(i, m[j], len(key)) + np.bincount(j, m[i], len(key))
            lab = np.arange(len(key))
            while True:
                old = lab.copy()
                np.minimum.at(lab, i, old[j])
                np.minimum.at(lab, j, old[i])
                lab = lab[lab]
                if (lab == old).all():
                    break
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(key[lab[at]]), pa.array(links[at].astype(np.int64))], names=["u", "v", "n"])

    def verify(batches):
        """Whole groups, CHUNK rows and more at a time; the last group of what has come waits for its other rows."""
        held = []

        def cuts(t):
            g, i, j = (t.column(c).to_numpy() for c in ("g", "i", "j"))
            return np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1])

        for b in batches:
            if not len(b):
                continue
            held.append(b)
            if sum(map(len, held)) < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            cut = cuts(t)
            if len(cut) > 1:
                yield from solve(t.slice(0, cut[-1]), cut[:-1])
            held = t.slice(cut[-1]).to_batches()
        if held:
            yield from solve(t := pa.Table.from_batches(held), cuts(t))

    found = stored(met.mapInArrow(verify, "u long, v long, n long"), "vector-links")
    comp = components(found.select("u", "v"), "vector-cc")
    links = found.groupBy("u").agg(F.sum("n").alias("other"))
    per = classes.select("k", "m", "low").join(comp, F.col("k") == F.col("node"), "left").join(links, F.col("k") == F.col("u"), "left").select("k", "low", F.coalesce("component", "k").alias("c"), (F.col("m") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"))
    per = stored(per, "vector-classes")
    low = per.groupBy("c").agg(F.min("low").alias("component_id"))
    got = rows.select("vec_id", "k").join(per.join(low, "c").select(F.col("k").alias("kk"), "n_links", "component_id"), F.col("k") == F.col("kk"), "left")
    component = F.when(F.col("kk").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


class BallTree:
    """Balls over integer vectors: each node's centre, radius and rows; halves by the widest component until LEAF rows."""

    def __init__(self, x: np.ndarray, whole: np.ndarray | None = None):
        """whole: x as 64-bit integers, where sums of products don't fit into a double exactly."""
        self.x, self.whole = x, whole
        self.nodes: list[tuple[np.ndarray, float, np.ndarray, tuple[int, int] | None]] = []
        self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        p = self.x[rows]
        centre = p.mean(0)
        radius = float(np.sqrt(((p - centre) ** 2).sum(1).max()))
        self.nodes.append((centre, radius, rows, None))
        spread = p.max(0) - p.min(0)
        if len(rows) > LEAF and spread.max() > 0:
            order = rows[np.argsort(p[:, int(np.argmax(spread))], kind="stable")]
            kids = self._build(order[: len(order) // 2]), self._build(order[len(order) // 2 :])
            self.nodes[at] = (centre, radius, rows, kids)
        return at

    def bounds(self, q: np.ndarray, norm: np.ndarray, node: int) -> np.ndarray:
        """No inner product of q with a row of the node is larger; a little is added for rounding."""
        centre, radius, *_ = self.nodes[node]
        b = q @ centre + norm * radius
        return b + 1e-9 * np.abs(b) + 1e-6 * (1 + norm * (np.sqrt(centre @ centre) + radius) * 1e-6)

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, start: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best rows for each query. start: scores that k rows elsewhere are known to reach.

        Nodes come off a heap by their largest upper bound; queries whose kth score is above the bound leave a node.
        """
        none = np.iinfo(np.int64).max
        worst, falling = (-np.inf, np.negative) if whole is None else (np.iinfo(np.int64).min, np.invert)
        best, who = np.full((len(q), k), worst), np.full((len(q), k), none)
        norm = np.sqrt((q * q).sum(1))
        heap = [(0.0, 0, np.arange(len(q)), self.bounds(q, norm, 0))]
        while heap:
            _, node, active, bound = heapq.heappop(heap)
            m = bound >= np.maximum(best[active, k - 1], start[active])
            active = active[m]
            if not len(active):
                continue
            _, _, rows, kids = self.nodes[node]
            if kids:
                for kid in kids:
                    b = self.bounds(q[active], norm[active], kid)
                    heapq.heappush(heap, (-float(b.max()), kid, active, b))
                continue
            score = q[active] @ self.x[rows].T
            if whole is not None:
                if np.abs(score).max(initial=0) >= 2.0**63:
                    raise OverflowError("an inner product is beyond the range of long")
                score = whole[active] @ self.whole[rows].T
            score[own[active][:, None] == ids[rows][None, :]] = worst
            both = np.concatenate([best[active], score], axis=1)
            name = np.concatenate([who[active], np.broadcast_to(ids[rows], score.shape)], axis=1)
            order = np.lexsort((name, falling(both)), axis=1)[:, :k]
            best[active], who[active] = np.take_along_axis(both, order, 1), np.take_along_axis(name, order, 1)
        return best, who


def quantised(v: F.Column, scale: int = 256) -> F.Column:
    """floor(scale * x) of each component, x as double; beyond the range of long the nearest long."""
    return F.transform(v.cast("array<double>"), lambda x: F.floor(x * scale))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors(vec_id, embedding) with vec_id divisible by every, the k largest inner products with other rows.

    Components are floor(256 * x); scores are exact integers, ties go to the smaller vec_id. Rows with a null vec_id, a
    null vector or null or non-finite components take no part, nor do pairs of different length. Rows with a query's own vec_id are its own.
    A vec_id that comes twice is two candidates; as a query it is answered once. Where components are so large that sums
    may pass 2^53, products are summed in 64-bit integers; a score beyond long raises OverflowError. An empty table gives an empty result.

    Shards of about SHARD rows have a ball tree each; blocks of queries meet shards, so no task holds all rows or all
    queries. A first round over one shard gives each query a score that k rows reach; the other shards start from it,
    and inside a shard the current kth score prunes nodes, taken in the order of their upper bounds.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding").cast("array<double>")))
    rows = rows.select("vec_id", quantised(F.col("embedding")).alias("x"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q"), F.max(F.size("x")).alias("d"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("top")).first()
    large = bool(facts["n"]) and facts["d"] * facts["top"] ** 2 >= 1 << 53
    shards, blocks = max(1, -(-facts["n"] // SHARD)), max(1, -(-(facts["q"] or 0) // QUERY_BLOCK))
    rows = rows.withColumn("d", F.size("x")).withColumn("shard", F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards)).cast("int"))
    ask = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))

    def search(key, t):
        q = pc_filter(t, True)
        c = pc_filter(t, False)
        names = ["query_id", "vec_id", "score"]
        if not len(q) or not len(c):
            return pa.table({x: pa.array([], pa.int64()) for x in names})
        ids = c.column("vec_id").to_numpy()
        own = q.column("vec_id").to_numpy()
        start = q.column("start").to_numpy().astype(np.float64)
        start[np.isnan(start)] = -np.inf
        cx, qx = c.column("x").combine_chunks(), q.column("x").combine_chunks()
        cw, qw = (_matrix(cx, np.int64), _matrix(qx, np.int64)) if large else (None, None)
        best, who = BallTree(_matrix(cx), cw).search(_matrix(qx), own, ids, k, start, qw)
        m = best > np.iinfo(np.int64).min  # a query itself and empty places have no score
        return pa.table([pa.array(np.repeat(own, m.sum(1))), pa.array(who[m]), pa.array(best[m].astype(np.int64))], names=names)

    def round_(only: F.Column, ask: DataFrame, numbers: F.Column) -> DataFrame:
        cand = rows.filter(only).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("d", "shard", "block", F.lit(False).alias("asks"), "vec_id", "x", F.lit(None).cast("double").alias("start"))
        asks = ask.withColumn("shard", F.explode(numbers)).select("d", "shard", "block", F.lit(True).alias("asks"), "vec_id", "x", "start")
        return cand.unionByName(asks).groupBy("d", "shard", "block").applyInArrow(search, "query_id long, vec_id long, score long")

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = stored(round_(F.col("shard") == 0, ask.withColumn("start", F.lit(None).cast("double")), F.array(F.lit(0))), "top-first")
    if shards > 1:
        known = first.groupBy("query_id").agg(F.min("score").cast("double").alias("start"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("query_id", "start")
        more = ask.join(known, F.col("vec_id") == F.col("query_id"), "left").drop("query_id")
        first = first.unionByName(round_(F.col("shard") > 0, more, F.sequence(F.lit(1), F.lit(shards - 1))))
    return first.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pc_filter(t: pa.Table, asks: bool) -> pa.Table:
    return t.filter(pc.equal(t.column("asks"), asks)).combine_chunks()
