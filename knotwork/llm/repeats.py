"""Removal of byte strings that occur more than once, over all texts.

Exact up to collisions of 64-bit hashes, in these steps. (1) Each text is cut into contexts: the smallest hash of a
48-byte gram within 400 bytes is an anchor, and the 400-byte strings with one anchor start in one run. Equal
strings have equal anchors at equal offsets, so only contexts with equal anchors share one. (2) A context that occurs
twice as a whole is repeated as a whole. (3) Contexts with equal anchors but other bytes are cut into cells of 64
offsets. All strings of a cell have its 337 middle bytes, the core; a cell whose core is nowhere else holds no repeat.
(4) Cells with one core are written as left bytes, one symbol for the core, right bytes, and joined; the
Burrows-Wheeler transform of that is extended backward breadth first. Common prefixes come out by increasing value,
and what has none when the minimum length is reached is a repeat.

Passages of so many words, whatever their bytes, come out by the same first step over words: the smallest hash of a gram
of words inside a passage is its anchor, and only passages whose anchor comes twice are hashed and counted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TABLE, dropped, keyed, lean, mix, slices, stored, tables

MIN_LENGTH, GRAM = 400, 48
_T = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
CELL = 64
#: Words of a gram that can be an anchor of a passage; bytes that pieces of one text overlap by.
WORD_GRAM, OVERLAP = 8, 1 << 16
#: Symbols that one transform takes, about; a core with more than HOT_CELLS different cells goes by hashed strings instead, which can be split over tasks.
TRANSFORM, HOT_CELLS = 1 << 19, 4096


def _hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[b] - sums[a]) * tables()[1][a] + (b - a).astype(np.uint64))


def _smallest(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest value in each window of w values, ties to the left; of the value the top 40 bits count. At most 2^24 values."""
    n = len(h)
    v = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    x = np.concatenate([v, np.full(-n % w, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[: n - w + 1], left[w - 1 : n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def contexts(buf: np.ndarray, off: np.ndarray, length: int = MIN_LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of the texts in buf (cut at off, TABLE bytes at most): number of the text, anchor hash, anchor place, first and last start of the strings of length bytes with that anchor (places in the text), hash of the context."""
    n = len(buf)
    if n < length:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_T[buf] * tables()[0][:n], dtype=np.uint64)])
        g = (sums[gram:] - sums[: n - gram + 1]) * tables()[1][: n - gram + 1] + np.uint64(gram)
    h = mix(g)
    place = _smallest(h, length - gram + 1)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(place)]
    inside = np.arange(length, n + 1) <= off[1:][owner]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]]) & inside
    first = np.flatnonzero(new)
    stop = np.flatnonzero(np.concatenate([new[1:] | ~inside[1:], [True]]) & inside)
    pos, own = place[first], owner[first]
    with np.errstate(over="ignore"):
        ctx = mix(_hash(sums, first, stop + length) + (pos - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (stop - first).astype(np.uint64))
    base = off[:-1][own]
    return own, h[pos], pos - base, first - base, stop - base, ctx


def _pieces(ids: pa.Array, texts: pa.Array, length: int = MIN_LENGTH, limit: int = TABLE):
    """(key, place of the piece, bytes) groups of at most limit bytes; a longer text comes in pieces that overlap by length - 1."""
    held, size = [], 0
    for k, t in zip(ids.to_pylist(), texts, strict=True):
        raw = np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid and len(t.as_buffer()) else np.zeros(0, np.uint8)
        step = limit - length + 1
        for at in range(0, max(1, len(raw) - length + 1), step):
            part = raw[at : at + limit]
            if held and size + len(part) > limit:
                yield held
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
    if held:
        yield held


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t sorted by their first depth symbols at least, by prefix doubling from as many symbols as a key of 63 bits holds."""
    n = len(t)
    bits = int(t.max()).bit_length()
    h, order = max(1, 63 // bits), None
    x = np.concatenate([t.astype(np.uint64), np.zeros(h, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(h):
        key = key << np.uint64(bits) | x[j : j + n]
    while True:
        order = np.argsort(key, kind="stable") if order is None else np.argsort(key)
        new = np.empty(n, np.int64)
        new[0] = 0
        np.cumsum(key[order[1:]] != key[order[:-1]], out=new[1:])
        if h >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n + 1, np.int64)
        rank[order], rank[n] = new + 1, 0
        ahead = np.zeros(n, np.int64)
        if h < n:
            ahead[: n - h] = rank[h:n]
        key = rank[:n].astype(np.uint64) * np.uint64(n + 1) + ahead.astype(np.uint64)
        h *= 2


def bounded_lcp(t: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each place in the suffix order: True where the common prefix with the place before is under limit.

    Breadth-first search over intervals of the Burrows-Wheeler transform. The queue holds intervals of all suffixes
    that start with one string of length l; extending it backward by each symbol gives the intervals of length l + 1.
    The place after an interval's end has the common prefix l; an interval is followed only if that place had no value
    yet, so each place is set once and the search ends with the queue or at limit. t ends with its smallest symbol, once.
    """
    n = len(t)
    bwt = t[order - 1]
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    done = np.zeros(n + 1, bool)
    done[0] = done[n] = True
    lo, hi = np.array([0], np.int64), np.array([n], np.int64)  # half open
    for _ in range(limit):
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(len(which))
        to = lf[at]
        # positions of one interval with one symbol keep their order under lf and stay side by side
        o = np.lexsort((to, which)) if len(lo) > 1 else np.argsort(to)
        to, sym, which = to[o], bwt[at[o]], which[o]
        cut = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (sym[1:] != sym[:-1])]))
        lo, hi = to[cut], np.concatenate([to[cut[1:] - 1], to[-1:]]) + 1
        fresh = ~done[hi]
        lo, hi = lo[fresh], hi[fresh]
        if not len(lo):
            break
        # of intervals with one end the first stands; they can't differ at one length
        done[hi] = True
    return done[:n]


def repeated_starts(parts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each sequence of symbols >= 2: True at starts of its substrings of that length that also start elsewhere in the sequences."""
    sizes = np.array([len(p) for p in parts], np.int64)
    t = np.concatenate([x for p in parts for x in (p.astype(np.int64), np.ones(1, np.int64))] + [np.zeros(1, np.int64)])
    order = suffix_array(t, length + 1)
    joined = ~bounded_lcp(t, order, length)  # equal to the place before on length symbols
    twin = np.zeros(len(t), bool)
    twin[order] = joined | np.concatenate([joined[1:], [False]])
    start = np.cumsum(sizes + 1) - sizes - 1
    return [twin[s : s + max(0, m - length + 1)] for s, m in zip(start, sizes, strict=True)]


def cells(raw: bytes, pos: int, first: int, last: int, length: int = MIN_LENGTH):
    """Cells of a context: (cell, core, left bytes, right bytes, last start of the cell)."""
    for j in range((pos - last) // CELL, (pos - first) // CELL + 1):
        low, high = max(pos - last, j * CELL), min(pos - first, j * CELL + CELL - 1)
        core = pos - j * CELL, pos - j * CELL - CELL + 1 + length
        yield j, raw[core[0] : core[1]], raw[pos - high : core[0]], raw[core[1] : pos - low + length], pos - high


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def repeated_spans(docs: DataFrame, length: int = MIN_LENGTH) -> DataFrame:
    """(rk, s, e): byte spans [s, e) of texts of docs(doc_id, text, rk) covered by strings of length bytes that also start elsewhere. Spans may overlap."""
    import xxhash

    text = docs.select("rk", "text")

    def find(batches):
        for batch in batches:
            for b in slices(batch, "text", TABLE):
                for held in _pieces(b.column("rk"), b.column("text"), length):
                    off = np.cumsum([0, *(len(x) for *_, x in held)])
                    own, a, pos, first, last, c = contexts(np.concatenate([x for *_, x in held]), off, length)
                    at = np.array([x for _, x, _ in held], np.int64)[own] if len(own) else own
                    ids = np.array([x for x, *_ in held], np.int64)[own] if len(own) else own
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), c.view(np.int64), ids, first + at, last + at, pos + at)], names=["a", "c", "rk", "first", "last", "pos"])

    ctx = stored(text.mapInArrow(lean(find), "a long, c long, rk long, first long, last long, pos long"), "contexts")
    # stored, so that the join deals out contexts by itself and can split a common anchor
    anchors = stored(ctx.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("n > 1").select("a", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    occ = stored(ctx.join(anchors, "a"), "occurrences")
    dropped(anchors)
    whole = F.struct("rk", "first", "last", "pos")
    distinct = stored(occ.filter("mixed").groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min(whole).alias("w")), "distinct")
    dropped(ctx)
    span = ["rk", F.col("first").alias("s"), (F.col("last") + length).alias("e")]
    full = occ.filter("not mixed").select(*span).unionByName(occ.filter("mixed").join(distinct.filter("n > 1").select("a", "c"), ["a", "c"]).select(*span))
    want = distinct.groupBy(F.col("w.rk").alias("rk")).agg(F.collect_list(F.struct("a", F.col("n").cast("long").alias("n"), "w.first", "w.last", "w.pos")).alias("ctx"))

    def cut(batches):
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                out: list[tuple] = []
                for rk, ctxs, t in zip(b.column("rk").to_pylist(), b.column("ctx").to_pylist(), b.column("text").to_pylist(), strict=True):
                    raw = t.encode()
                    for c in ctxs:
                        for j, core, left, right, start in cells(raw, c["pos"], c["first"], c["last"], length):
                            key = xxhash.xxh64_intdigest(core, c["a"] % (1 << 64) ^ j) - (1 << 63)
                            own = xxhash.xxh64_intdigest(left + b"\0" + right, len(left)) - (1 << 63)
                            out.append((key, own, min(c["n"], 2), rk, start, left, right))
                    if len(out) > 20_000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    names = ["core", "cell", "n", "rk", "start", "left", "right"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)

    found = stored(text.join(want, "rk").mapInArrow(lean(cut), "core long, cell long, n long, rk long, start long, left binary, right binary"), "cells")
    per = found.groupBy("core").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).filter("total > 1")
    open_ = found.join(per, "core").select(*names, (F.col("k") > HOT_CELLS).alias("hot"))
    dealt = open_.filter("not hot").repartition("core").sortWithinPartitions("core", "cell", "rk", "start")

    def decide(batches):
        groups, size, cur, rows = [], 0, None, []

        def solve():
            parts, which, out = [], [], []
            for g, (core, members) in enumerate(groups):
                times: dict[int, int] = {}
                for m in members:
                    times[m[1]] = times.get(m[1], 0) + m[2]
                seen = set()
                for m in members:
                    if m[1] not in seen:
                        seen.add(m[1])
                        parts.append(np.concatenate([np.frombuffer(m[5], np.uint8).astype(np.int64) + 2, [300 + g], np.frombuffer(m[6], np.uint8).astype(np.int64) + 2]))
                        which.append((m, times[m[1]]))
            got = repeated_starts(parts, CELL) if len(parts) > 1 else [np.zeros(len(p) - CELL + 1, bool) for p in parts]
            flags = {(m[0], m[1]): f | (t > 1) for (m, t), f in zip(which, got, strict=True)}
            for _, members in groups:
                for m in members:
                    if m[2] == 1:
                        out += [(m[3], m[4] + x, m[4] + y - 1 + length) for x, y in _runs(flags[m[0], m[1]])]
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["rk", "s", "e"])

        for b in batches:
            for m in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if m[0] != cur:
                    if len(rows) > 1:
                        groups.append((cur, rows))
                        size += len(rows) * 2 * CELL
                    elif rows and rows[0][2] > 1:
                        pass  # one context, whole already
                    cur, rows = m[0], []
                    if size > TRANSFORM:
                        yield solve()
                        groups, size = [], 0
                rows.append(m)
        if len(rows) > 1:
            groups.append((cur, rows))
        if groups:
            yield solve()

    def hashed(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                b = batch.slice(at, 500)
                out = []
                for core, _, n, rk, start, left, right in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                    for i in range(len(left) + len(right) + 2 - CELL):
                        rest = CELL - 1 - (len(left) - i)
                        out.append((xxhash.xxh64_intdigest(left[i:] + b"\0" + right[:rest], core % (1 << 64)) - (1 << 63), n, rk, start + i))
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["h", "n", "rk", "s"])

    strings = open_.filter("hot").mapInArrow(lean(hashed), "h long, n long, rk long, s long")
    twice = strings.groupBy("h").agg(F.sum("n").alias("total")).filter("total > 1").select("h")
    hot = strings.filter("n = 1").join(twice, "h").select("rk", "s", (F.col("s") + length).alias("e"))
    return full.unionByName(dealt.mapInArrow(lean(decide), "rk long, s long, e long")).unionByName(hot)


def passages(buf: np.ndarray, off: np.ndarray, words: int, gram: int = WORD_GRAM) -> tuple[np.ndarray, ...]:
    """Of the texts in buf (cut at off, each ended by a line feed, TABLE bytes at most), each run of so many words: number of the text, anchor hash, anchor place, start of the first word, first and last byte, hash.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D. A passage leaves out what stands before the first letter,
    digit or byte over 127 of its first word and after the last of its last word. Places are in buf.
    """
    edge = np.flatnonzero(np.diff(np.concatenate([[True], (buf == 32) | ((buf >= 9) & (buf <= 13)), [True]]).astype(np.int8)))
    a, z = edge[::2], edge[1::2]
    n = len(a) - words + 1
    if n < 1:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4, np.zeros(0, np.uint64))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_T[buf] * tables()[0][: len(buf)], dtype=np.uint64)])
    g = _hash(sums, a[: len(a) - gram + 1], z[gram - 1 :])
    place = _smallest(g[1:], words - 1 - gram)[:n] + 1  # grams of the words inside, which are whole in every copy
    plain = np.flatnonzero(((buf >= 48) & (buf <= 57)) | ((buf >= 65) & (buf <= 90)) | ((buf >= 97) & (buf <= 122)) | (buf > 127))
    plain = np.concatenate([[-1], plain, [len(buf)]])
    s, e = plain[np.searchsorted(plain, a)], plain[np.searchsorted(plain, z) - 1] + 1
    s, e = np.where(s < z, s, a)[:n], np.where(e > a, e, z)[words - 1 :]
    own = np.searchsorted(off, a, "right") - 1
    ok = np.flatnonzero(own[:n] == own[words - 1 :])
    return own[ok], g[place[ok]], a[place[ok]], a[ok], s[ok], e[ok], _hash(sums, s[ok], e[ok])


def _text_passages(ids: list[int], texts: pa.Array, words: int, limit: int = TABLE >> 1):
    """(key, anchor hash, anchor place, first byte, last byte, hash) arrays of the passages of texts, places in the text. A text over limit bytes comes in pieces; a passage over OVERLAP bytes may be left out of it."""
    held, size = [], 0

    def found():
        off = np.cumsum([0, *(len(x) + 1 for *_, x in held)])
        own, g, pos, first, s, e, h = passages(np.concatenate([y for *_, x in held for y in (x, np.full(1, 10, np.uint8))]), off, words)
        key, at, stop, lo, size = (np.array(x, np.int64)[own] for x in zip(*((k, at, stop, lo, total) for k, at, stop, lo, total, _ in held), strict=True))
        move = lo - off[:-1][own]
        edge = off[1:][own] - 1 + move
        mine = np.flatnonzero((first + move >= at) & (first + move < stop) & ((e + move < edge) | (edge == size)))
        return [x[mine] for x in (key, g.view(np.int64), pos + move, s + move, e + move, h.view(np.int64))]

    for k, t in zip(ids, texts, strict=True):
        raw = np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid and len(t.as_buffer()) else np.zeros(0, np.uint8)
        for at in range(0, max(1, len(raw)), limit):
            lo = max(0, at - 1)
            part = raw[lo : at + limit + OVERLAP]
            if held and size + len(part) + 1 > limit + OVERLAP:
                yield found()
                held, size = [], 0
            held.append((k, at, at + limit, lo, len(raw), part))
            size += len(part) + 1
    if held:
        yield found()


def _passage_runs(key: np.ndarray, pos: np.ndarray, s: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First passage of each run of passages with one anchor, and a hash of the run: of its passages in order and of where the anchor lies."""
    first = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (key[1:] != key[:-1])])) if len(pos) else np.zeros(0, np.int64)
    if not len(first):
        return first, np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(pos)]]))
    nth = (np.arange(len(pos)) - np.repeat(first, size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        c = np.add.reduceat(mix(h.view(np.uint64) + nth * np.uint64(0x9E3779B97F4A7C15)), first)
        return first, mix(c + (pos[first] - s[first]).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64)).view(np.int64)


def repeated_passages(docs: DataFrame, words: int) -> DataFrame:
    """(rk, s, e): byte spans of texts of docs(doc_id, text, rk) covered by passages of so many words that also come elsewhere, byte for byte. Spans may overlap.

    Passages with one anchor form a run. A run that occurs twice is repeated as a whole; of the other runs with an anchor that comes twice, and of one of
    each repeated run, the passages are counted.
    """
    text = docs.filter("text is not null").select("rk", "text")

    def find(batches):
        for batch in batches:
            for b in slices(batch, "text", TABLE >> 1):
                for key, g, pos, s, e, h in _text_passages(b.column("rk").to_pylist(), b.column("text"), words):
                    first, c = _passage_runs(key, pos, s, h)
                    last = np.concatenate([first[1:], [len(pos)]])[: len(first)] - 1
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g[first], c, key[first], pos[first], s[first], e[last])], names=["a", "c", "rk", "pos", "s", "e"])

    def cut(batches):
        for batch in batches:
            for b in slices(batch, "text", TABLE >> 1):
                want = {(rk, x["pos"], x["s"]): x["n"] for rk, runs in zip(b.column("rk").to_pylist(), b.column("runs").to_pylist(), strict=True) for x in runs}
                for key, _, pos, s, e, h in _text_passages(b.column("rk").to_pylist(), b.column("text"), words):
                    first, _ = _passage_runs(key, pos, s, h)
                    size = np.diff(np.concatenate([first, [len(pos)]])) if len(first) else first
                    n = np.repeat(np.array([want.get(x, 0) for x in zip(key[first].tolist(), pos[first].tolist(), s[first].tolist(), strict=True)], np.int64), size)
                    keep = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, n, key, s, e)], names=["h", "n", "rk", "s", "e"])

    runs = stored(text.mapInArrow(lean(find), "a long, c long, rk long, pos long, s long, e long"), "runs")
    anchors = stored(runs.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("n > 1").select("a", (F.col("lo") != F.col("hi")).alias("mixed")), "word-anchors")
    occ = stored(runs.join(anchors, "a"), "run-occurrences")
    dropped(anchors)
    dropped(runs)
    distinct = stored(occ.filter("mixed").groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rk", "pos", "s")).alias("w")), "run-kinds")
    full = occ.filter("not mixed").select("rk", "s", "e").unionByName(occ.filter("mixed").join(distinct.filter("n > 1").select("a", "c"), ["a", "c"]).select("rk", "s", "e"))
    want = distinct.groupBy(F.col("w.rk").alias("rk")).agg(F.collect_list(F.struct("w.pos", "w.s", F.least(F.col("n"), F.lit(2)).cast("long").alias("n"))).alias("runs"))
    found = stored(text.join(want, "rk").mapInArrow(lean(cut), "h long, n long, rk long, s long, e long"), "passages")
    twice = stored(found.groupBy("h").agg(F.sum("n").alias("total")).filter("total > 1").select("h"), "passages-twice")
    return full.unionByName(found.filter("n = 1").join(twice, "h").select("rk", "s", "e"))


def _merged(spans, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, min(e, n)])
    return [(s, min(e, n)) for s, e in out]


def without_repeats(docs: DataFrame, length: int = MIN_LENGTH, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each row of docs(doc_id, text).

    A byte goes if a string of length bytes that covers it also starts at another place, in this text or another;
    strings are judged on the input. Null and empty texts have 0 bytes. Rows equal in doc_id and text are two
    texts, so that both lose all they share; an empty table gives an empty result. A very long text is one row's work, in pieces of 2 MB.

    With words two columns follow, which leave the others as they are: n_passages, the maximal runs that repeated passages of
    so many words cover, however few bytes they have, and clean_text, the text without them and without the repeated strings.
    """
    more = [("n_passages", pa.int64()), ("clean_text", pa.string())] if words is not None else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), *more])
    docs = keyed(docs)
    spans = repeated_spans(docs, length).withColumn("words", F.lit(False))
    if words is not None:
        spans = spans.unionByName(repeated_passages(docs, words).withColumn("words", F.lit(True)))
    spans = spans.groupBy("rk").agg(F.collect_set(F.struct("words", "s", "e")).alias("spans"))

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                out = []
                for i, t, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                    raw = (t or "").encode()
                    found = [[(x["s"], x["e"]) for x in spans or () if x["words"] == kind] for kind in (False, True)]
                    cut = _merged(found[0], len(raw))
                    kept = _left(raw, cut)
                    row = (i, len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept)
                    if more:
                        row += (len(_merged(found[1], len(raw))), None if t is None else _left(raw, _merged(found[0] + found[1], len(raw))).decode("utf-8", "ignore"))
                    out.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return docs.select("rk", "doc_id", "text").join(spans, "rk", "left").mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary" + ", n_passages long, clean_text string" * bool(more))


def _left(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    edge = [0, *(x for s in cut for x in s), len(raw)]
    return b"".join(raw[a:z] for a, z in zip(edge[::2], edge[1::2], strict=True))


def cut_repeats(docs: DataFrame, length: int = MIN_LENGTH, words: int | None = None) -> DataFrame:
    """docs, all columns kept, with repeated strings of length bytes cut out of text, and with words also repeated passages of so many words (10 at least), however short. Bytes of a character that a cut divides go, too; a null text stays null."""
    own = docs.columns
    keys = docs.withColumn("__rk", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    spans = repeated_spans(keyed(docs), length)
    if words is not None:
        spans = spans.unionByName(repeated_passages(keyed(docs), words))
    spans = spans.groupBy("rk").agg(F.collect_set(F.struct("s", "e")).alias("__spans")).withColumnRenamed("rk", "__rk")

    def cut(batches):
        for batch in batches:
            for b in slices(batch, "__text", 2 << 20):
                out = []
                for t, spans in zip(b.column("__text"), b.column("__spans"), strict=True):
                    raw = t.as_buffer().to_pybytes() if t.is_valid else None
                    out.append(raw if raw is None or not spans.is_valid else _left(raw, _merged([(x["s"], x["e"]) for x in spans.as_py()], len(raw))).decode("utf-8", "ignore").encode())
                text = pa.array(out, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([text if c == "text" else b.column(c) for c in own], names=own)

    schema = ", ".join(f"`{c}` {'string' if c == 'text' else kind}" for c, kind in docs.dtypes)
    return keys.join(spans, "__rk", "left").withColumn("__text", F.col("text").cast("string")).drop("__rk", "text").withColumn("text", F.lit(None).cast("string")).select(*own, "__text", "__spans").mapInArrow(lean(cut), schema)
