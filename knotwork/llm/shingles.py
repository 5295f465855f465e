"""N-gram Jaccard join over word shingles: prefix filter and parity bits for candidates, prefix-tree join to decide them.

Sets are 48-bit hashes of shingles in one global order: shingles that are frequent anywhere come last, the most
frequent at the very end, the others are ordered by hash. Any order gives exact results; this one keeps passages that many documents share out of the
prefixes. A set is known by a 64-bit key of its members, so exact copies are one set from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, INV, TABLE, components, dropped, keyed, lean, mix, powers, slices, stored, tables

#: Shingles in HEAVY_DOCS sets or more of a block are reported as frequent, at most HEAVY_BLOCK a block; the HEAVY most frequent of all make the tail of the order.
HEAVY_DOCS, HEAVY_BLOCK, HEAVY = 3, 4096, (1 << 16) - 1
BLOCK_BYTES = 1 << 20
#: So many sets at most are tried against one set in one group.
TRIE_SETS = 256
#: Bytes of sets that a worker holds before it decides or hands them on.
GROUP_BYTES = 2 << 20
#: Sets tried in one round against all others of a shingle, and rounds at most; the last one takes every pair across components.
CENTRES, ROUNDS = 8, 2
_SEED = np.random.default_rng(20240531)
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: 64-bit words of a set's parity bits.
WORDS = 8
#: Pairs up to so many (about 100 bytes each) are broadcast to the texts; more are joined by a shuffle.
BROADCAST_PAIRS = 100_000


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts in buf (cut at off), and the text of each. A-Z count as a-z; words are runs of bytes other than 0x20 and 0x09 to 0x0D."""
    low = buf + ((buf >= 65) & (buf <= 90)) * np.uint8(32)
    gap = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    begin = ~gap & (edge[:-1] | np.concatenate([[True], gap[:-1]]))
    end = ~gap & (edge[1:] | np.concatenate([gap[1:], [True]]))
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        power, inverse = tables() if len(buf) <= TABLE else (powers(len(buf), BASE), powers(len(buf), INV))
        total = np.zeros(len(buf) + 1, np.uint64)
        total[1:] = _BYTE[low]
        total[1:] *= power[: len(buf)]
        np.cumsum(total, out=total)
        h = (total[b] - total[a]) * inverse[a]
        return mix(h + (b - a).astype(np.uint64)), np.searchsorted(off, a, "right") - 1


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by (text, hash), and the offsets of the texts; null texts have none."""
    n = len(texts)
    texts = texts.fill_null("").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    h, text = word_hashes(raw[off[0] : off[-1]], off - off[0])
    words = np.bincount(text, minlength=n)
    owner, hashes = [np.flatnonzero((words > 0) & (words < k))], []
    first = np.cumsum(words) - words
    with np.errstate(over="ignore"):
        odd = np.random.default_rng(k).integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)
        hashes.append(mix(np.array([(h[first[i] : first[i] + words[i]] * odd[: words[i]]).sum(dtype=np.uint64) + np.uint64(words[i]) for i in owner[0]], np.uint64)))
        if len(h) >= k:
            s = h[: len(h) - k + 1] * odd[0]
            for j in range(1, k):
                s += h[j : len(h) - k + 1 + j] * odd[j]
            whole = text[: len(s)] == text[k - 1 :]
            owner.append(text[: len(s)][whole])
            hashes.append(mix(s[whole] + np.uint64(k)))
    # one sort of (text, 48 bits of hash); a block has fewer than 2^16 texts
    key = np.unique(np.concatenate(owner).astype(np.uint64) << np.uint64(48) | np.concatenate(hashes) >> np.uint64(16)) if n else np.zeros(0, np.uint64)
    return key & np.uint64((1 << 48) - 1), np.concatenate([[0], np.cumsum(np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=n))])


def set_keys(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set as a signed integer; an empty set has key 0."""
    with np.errstate(over="ignore"):
        c = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
        n = np.diff(off)
        return np.where(n > 0, mix(c[off[1:]] - c[off[:-1]] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0)).view(np.int64)


def parities(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words for each set: bit i is the parity of the number of members that fall on i.

    Two sets whose words differ in d bits differ in d members at least, which bounds what they share from above.
    """
    with np.errstate(over="ignore"):
        place = mix(s ^ np.uint64(0x5C5C5C5C5C5C5C5C)) % np.uint64(64 * WORDS)
    out = np.zeros((len(off) - 1, WORDS), np.uint64)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    np.bitwise_xor.at(out, (owner, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    return out.view(np.int64)


def wide_parities(s: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """As parities, with as many bits as a set has members, rounded up to a power of two; None for sets that the fixed words suit. Folding the upper half of the bits onto the lower one gives those of half the size."""
    with np.errstate(over="ignore"):
        place = mix(s ^ np.uint64(0x5C5C5C5C5C5C5C5C))
    out: list[bytes | None] = []
    for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        bits = 1 << max(z - a - 1, 0).bit_length()
        out.append(None if bits <= 64 * WORDS else np.packbits((np.bincount((place[a:z] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes())
    return out


def parities_differ(x: bytes, y: bytes) -> int:
    """Bits in which two sets' wide parities differ; the longer are folded to the length of the shorter."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0) ^ a).sum())


def _ordered(s: np.ndarray, off: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Members of each set in the global order: by (place among the frequent, hash). heavy: frequent shingles, sorted, and their places from 1, the rarest first."""
    if not len(s) or not len(heavy[0]):
        return s
    at = np.minimum(np.searchsorted(heavy[0], s), len(heavy[0]) - 1)
    return s[np.lexsort((s, np.where(heavy[0][at] == s, heavy[1][at], 0), np.repeat(np.arange(len(off) - 1), np.diff(off))))]


def _sequence(s: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set as keys in the global order read from its end: (place among the frequent, hash), largest first, as big-endian bytes compare."""
    if len(s) and len(heavy[0]):
        at = np.minimum(np.searchsorted(heavy[0], s), len(heavy[0]) - 1)
        s = s | np.where(heavy[0][at] == s, heavy[1][at], 0).astype(np.uint64) << np.uint64(48)
    return (~np.sort(s)[::-1]).astype(">u8")


def trie_join(x: np.ndarray, others: list[tuple[int, np.ndarray]], num: int, den: int) -> list[int]:
    """Ids of those others whose Jaccard with x is at least num / den; sets are ascending sequences in one global order.

    The others are walked as a prefix tree: sorted by their sequences, so that two neighbours share the path down
    to their common prefix and with it the overlap counted along that path. A subtree is left when the overlap so far
    plus what remains of the shorter side can't reach what the pair needs.
    """
    seqs = sorted(((y, i) for i, y in others), key=lambda t: t[0].tobytes())
    x = x.astype(np.uint64)
    out, path, over, behind, dead = [], np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), -1
    for raw, i in seqs:
        y = raw.astype(np.uint64)
        m = min(len(path), len(y))
        diff = np.flatnonzero(path[:m] != y[:m])
        common = int(diff[0]) if len(diff) else m
        need = -(-num * (len(x) + len(y)) // (num + den))
        if 0 <= dead <= common and over[dead] + min(len(y) - dead, behind[dead]) < need:
            continue  # under a node that is out of reach for this length, too
        tail = y[common:]
        at = np.minimum(np.searchsorted(x, tail), max(len(x) - 1, 0))
        over = np.concatenate([over[: common + 1], over[common] + np.cumsum(x[at] == tail) if len(x) else np.zeros(len(tail), np.int64)])
        path, dead = y, -1
        # what can still follow a node: the rest of y, and of x what lies behind y's last key
        behind = len(x) - np.concatenate([[0], np.searchsorted(x, y, "right")])
        bound = over + np.minimum(len(y) - np.arange(len(y) + 1), behind)
        short = np.flatnonzero(bound < need)
        if len(short):
            dead = int(short[0])
        elif den * over[-1] >= num * (len(x) + len(y) - over[-1]):
            out.append(i)
    return out


def _blocks(batches):
    ids, texts, held = [], [], 0
    for batch in batches:
        for b in slices(batch, "text", BLOCK_BYTES, 8192):
            ids.append(b.column("rk"))
            texts.append(b.column("text"))
            held += b.column("text").nbytes + 128 * len(b)
            if held >= BLOCK_BYTES:
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, held = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, set_key of each row of docs(doc_id, text).

    A row's set: distinct k-word shingles, or the whole sequence as one where words are fewer; without words (null
    and empty texts) empty and linked with nothing. Two rows link when den * intersection >= num * union.
    component_id: smallest doc_id reachable by links, itself included. Null ids count as larger than all others and
    keep a null component when nothing else is reachable. Rows that come twice are returned twice; an empty table gives an empty result.

    Steps: sizes and keys of the sets; prefix shingles dealt out by shingle; each set of a shingle is tried
    with the one of smallest key first (a star, not all pairs); while all pairs across components would be more than
    CENTRES a row, CENTRES sets of each shingle are tried in a round (the same ones for near copies, by the order of a
    hash), which joins most components; then all pairs across components are tried. Equal sets are one all along.
    """
    src = keyed(docs)
    bit = [f"w{i}" for i in range(WORDS)]
    schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("a", "b", "n", *bit)), ("wide", pa.binary())])
    text = src.select("rk", "text")

    def sizes(batches):
        for ids, texts in _blocks(batches):
            s, off = shingle_sets(texts, k)
            key, n = set_keys(s, off), np.diff(off)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), np.int32)), ids, pa.array(key), pa.array(n), *(pa.array(w) for w in np.ascontiguousarray(parities(s, off).T)), pa.array(wide_parities(s, off), pa.binary())], schema=schema)
            _, one = np.unique(key, return_index=True)
            mine = np.repeat(np.isin(np.arange(len(key)), one), n)
            v, c = np.unique(s[mine], return_counts=True)
            top = np.flatnonzero(c >= HEAVY_DOCS)
            top = top[np.argsort(-c[top], kind="stable")[:HEAVY_BLOCK]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(top), np.int32)), pa.array(v[top].view(np.int64)), pa.array(np.zeros(len(top), np.int64)), pa.array(c[top].astype(np.int64)), *[pa.nulls(len(top), pa.int64())] * WORDS, pa.nulls(len(top), pa.binary())], schema=schema)

    facts = stored(text.mapInArrow(lean(sizes), ", ".join(["kind int, a long, b long, n long", *(f"{c} long" for c in bit), "wide binary"])), "sets")
    frequent = facts.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(HEAVY).select("a").toPandas()["a"]  # HEAVY rows at most
    frequent = frequent.to_numpy(np.int64).view(np.uint64)
    up = np.argsort(frequent)
    heavy = docs.sparkSession.sparkContext.broadcast((frequent[up], (len(frequent) - up).astype(np.int32)))
    rows = facts.filter("kind = 0").select(F.col("a").alias("rk"), F.col("b").alias("set_key"), F.col("n").alias("n_shingles"))

    one = rows.groupBy("set_key").agg(F.min("rk").alias("rk"))
    words = stored(facts.filter("kind = 0 and n > 0").groupBy("b").agg(F.first("n").alias("n"), F.first("wide").alias("wide"), *(F.first(c).alias(c) for c in bit)), "parities")

    def with_words(df: DataFrame, key: str, mark: str) -> DataFrame:
        return df.join(words.select(F.col("b").alias(key), *(F.col(c).alias(c + mark) for c in bit)), key)

    def in_reach(a: str, b: str) -> F.Column:
        """Not so many parities differ that the sets (sizes a and b) can't be similar enough."""
        differ = sum((F.bit_count(F.col(c + "x").bitwiseXOR(F.col(c + "y"))) for c in bit), F.lit(0))
        return differ * (num + den) <= (F.col(a) + F.col(b)) * (den - num)

    def in_wide_reach(pairs: DataFrame) -> DataFrame:
        """Those pairs (x, y) whose wide parities, where both have them, don't rule them out."""
        for c in ("x", "y"):
            pairs = pairs.join(words.filter("wide is not null").select(F.col("b").alias(c), F.col("n").alias(c + "n"), F.col("wide").alias(c + "w")), c, "left")

        def reach(batches):
            for batch in batches:
                xw, yw = batch.column("xw"), batch.column("yw")
                xn, yn = batch.column("xn").to_pylist(), batch.column("yn").to_pylist()
                keep = [not (u.is_valid and v.is_valid) or parities_differ(u.as_py(), v.as_py()) * (num + den) <= (a + b) * (den - num) for u, v, a, b in zip(xw, yw, xn, yn, strict=True)]
                yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

        return pairs.select("x", "y", "xn", "yn", "xw", "yw").mapInArrow(lean(reach), "x long, y long")

    def prefixes(batches):
        for _, texts in _blocks(batches):
            s, off = shingle_sets(texts, k)
            key = set_keys(s, off)
            s, n = _ordered(s, off, heavy.value), np.diff(off)
            _, one = np.unique(key, return_index=True)
            length = np.where(np.isin(np.arange(len(n)), one) & (n > 0), n + (-num * n) // den + 1, 0)
            owner = np.repeat(np.arange(len(n)), length)
            at = off[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
            for a in range(0, len(owner), 200_000):
                o = owner[a : a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(s[at[a : a + 200_000]].view(np.int64)), pa.array(key[o]), pa.array(n[o].astype(np.int32)), pa.array((at[a : a + 200_000] - off[:-1][o]).astype(np.int32))], names=["t", "k", "n", "p"])

    # Lengths allow it, and so does what follows the shared shingle: if it is the first one that they share, no more than the rest of either set is shared.
    near = lambda a, b, i, j: (F.least(a, b) * den >= F.greatest(a, b) * num) & (F.least(F.col(a) - F.col(i), F.col(b) - F.col(j)) * (num + den) >= (F.col(a) + F.col(b)) * num)
    w = Window.partitionBy("t").orderBy("k")
    post = text.mapInArrow(lean(prefixes), "t long, k long, n int, p int").select("*", F.lag("k").over(w).alias("pk"), F.lead("k").over(w).alias("nk"), F.first("k").over(w).alias("fk"), F.first("n").over(w).alias("fn"), F.first("p").over(w).alias("fp"))
    shared = stored(post.filter("pk <> k or nk <> k"), "shared")
    first = shared.filter((F.col("fk") != F.col("k")) & near("fn", "n", "fp", "p")).select(F.col("fk").alias("x"), F.col("k").alias("y"), F.col("fn").alias("xn"), F.col("n").alias("yn")).distinct()
    first = stored(with_words(with_words(first, "x", "x"), "y", "y").filter(in_reach("xn", "yn")).select("x", "y"), "first")
    links = _verified(in_wide_reach(first), text, one, k, num, den, heavy)
    comp = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")), "cc1")
    tested = first
    for number in range(1, ROUNDS + 1):
        label = shared.select("t", "k", "n", "p").distinct().join(comp, F.col("k") == F.col("node"), "left").select("t", "k", "n", "p", F.coalesce("component", "k").alias("c"))
        label = stored(label, "label")
        # What may still join two components: shingles whose sets are in more than one, and how many pairs they give.
        per = label.groupBy("t", "c").agg(F.count(F.lit(1)).cast("double").alias("m")).groupBy("t").agg(F.sum("m").alias("m"), F.sum(F.col("m") ** 2).alias("sq"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        mixed = stored(per.select("t", "m", ((F.col("m") ** 2 - F.col("sq")) / 2).alias("pairs")), "mixed")
        cost = mixed.agg(F.sum("m").alias("rows"), F.sum("pairs").alias("pairs")).first()
        if cost["rows"] is None:
            break
        open_ = stored(with_words(label.join(mixed.select("t"), "t"), "k", "x"), "mixed-sets")
        marks, other = [c + "x" for c in bit], [F.col(c + "x").alias(c + "y") for c in bit]
        right = open_.select("t", F.col("k").alias("y"), F.col("n").alias("yn"), F.col("p").alias("yp"), F.col("c").alias("yc"), *other)
        last = number == ROUNDS or cost["pairs"] <= CENTRES * cost["rows"]
        if last:
            met = open_.join(right, "t").filter("c <> yc and (n < yn or (n = yn and k < y))")
        else:
            order = F.xxhash64("k", F.lit(number))
            centre = open_.groupBy("t", F.pmod(order, F.lit(CENTRES)).alias("b")).agg(F.min(F.struct(order.alias("o"), "k", "n", "p", "c", *marks)).alias("m"))
            met = centre.select("t", *(F.col(f"m.{c}").alias(c) for c in ("k", "n", "p", "c", *marks))).join(right, "t").filter("c <> yc")
        pairs = met.filter(near("n", "yn", "p", "yp") & in_reach("n", "yn")).select(F.col("k").alias("x"), "y").distinct()
        both = tested.unionByName(tested.select(F.col("y").alias("x"), F.col("x").alias("y")))
        pairs = stored(pairs.join(both, ["x", "y"], "left_anti"), "open")
        more = _verified(in_wide_reach(pairs), text, one, k, num, den, heavy)
        for table in (label, mixed, open_):
            dropped(table)
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")), "cc2")
        if last:
            break
        tested = tested.unionByName(pairs)
    dropped(shared)
    dropped(first)
    dropped(words)
    # Back to rows: a set's component, then the smallest doc_id of all rows in it. An empty set is alone.
    ids = src.select("rk", "doc_id")
    out = rows.join(comp, F.col("set_key") == F.col("node"), "left").select("rk", "set_key", "n_shingles", F.coalesce("component", "set_key").alias("c"))
    out = stored(ids.join(out.groupBy("rk").agg(*(F.first(c).alias(c) for c in ("set_key", "n_shingles", "c"))), "rk"), "rows")
    dropped(facts)
    # stored, so that the join below deals out its left side by itself and can split a large component
    low = stored(out.filter("n_shingles > 0").groupBy("c").agg(F.min("doc_id").alias("low")), "low")
    linked = F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("doc_id"))
    return out.join(low, "c", "left").select("doc_id", "n_shingles", linked.alias("component_id"), "set_key", "rk")


def _verified(pairs: DataFrame, text: DataFrame, one: DataFrame, k: int, num: int, den: int, heavy) -> DataFrame:
    """Those pairs (x, y) of set keys whose sets are similar enough, as a table. x's set meets groups of TRIE_SETS others at most.

    one: a row key for each set key; its text gives the set. Texts without a pair are left out before anything is dealt out.
    """
    pairs = stored(pairs, "reach")
    deg = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("deg"))
    part = F.pmod(F.xxhash64("y"), F.ceil(F.col("deg") / TRIE_SETS)).cast("int")
    grouped = pairs.join(deg, "x").select("x", "y", part.alias("part"))
    todo = grouped.unionByName(grouped.select("x", F.col("x").alias("y"), "part").distinct())
    todo = stored(todo.join(one, F.col("y") == F.col("set_key")).groupBy("rk", "y").agg(F.collect_set(F.struct("x", "part")).alias("at")), "todo")
    small = pairs.count() <= BROADCAST_PAIRS
    mine = text.join(F.broadcast(todo) if small else todo, "rk").select("y", "at", "text")

    def packed(out) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], names=["x", "part", "other", "y", "members"])

    def members(batches):
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                s, off = shingle_sets(b.column("text"), k)
                six = s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()  # 48 bits of each member
                out, held = [], 0
                for i, y in enumerate(b.column("y").to_pylist()):
                    own = six[6 * off[i] : 6 * off[i + 1]]
                    for a in b.column("at")[i].as_py():
                        out.append((a["x"], a["part"], a["x"] != y, y, own))
                        held += len(own) + 64
                        if held >= GROUP_BYTES:
                            yield packed(out)
                            out, held = [], 0
                if out:
                    yield packed(out)

    full = mine.mapInArrow(lean(members), "x long, part int, other boolean, y long, members binary")
    full = full.repartition("x", "part").sortWithinPartitions("x", "part", "other")

    def unpack(raw) -> np.ndarray:
        wide = np.zeros((len(raw) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        return wide.view(np.uint64).ravel()

    def run(batches):
        cur, x, ys, held = None, None, [], 0

        def decide():
            if x is None or not ys:
                return []
            return [(cur[0], i) for i in trie_join(x, ys, num, den)]

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("x", "part", "other", "y")]
            out = []
            for i, (g, p, other, y) in enumerate(zip(*cols, strict=True)):
                if (g, p) != cur:
                    out += decide()
                    cur, x, ys, held = (g, p), None, [], 0
                m = _sequence(unpack(b.column("members")[i].as_buffer()), heavy.value)
                if other:
                    ys.append((y, m))
                    held += m.nbytes
                    if held >= GROUP_BYTES:  # each pair is decided by itself, so a group can be decided in pieces
                        out += decide()
                        ys, held = [], 0
                else:
                    x = m
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int64())], names=["x", "y"])
        out = decide()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int64())], names=["x", "y"])

    out = stored(full.mapInArrow(lean(run), "x long, y long"), "links")
    dropped(todo)
    dropped(pairs)
    return out


def one_of_each_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns kept, one of each group of linked rows: the one with the smallest (doc_id, key).

    Of rows equal in doc_id and text one stays, too, unless their set is empty; rows with an empty set all stay.
    """
    got = jaccard_components(docs, k, num, den)
    alone = got.filter("n_shingles = 0").select("rk", F.lit(True).alias("all"))
    best = got.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk")).alias("b")).select(F.col("b.rk").alias("rk"), F.lit(False).alias("all"))
    keep = alone.distinct().unionByName(best).withColumnRenamed("rk", "__rk").withColumnRenamed("all", "__all")
    own = docs.columns
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.withColumn("__rk", key).join(keep, "__rk")
    many = out.filter("__all").select(*own)
    return many.unionByName(out.filter("not __all").dropDuplicates(["__rk"]).select(*own))
