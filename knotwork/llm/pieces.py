"""Sampled segmentation into sentence pieces, and decoding.

A text is cut at its spaces into units (a word with the mark of its space). The lattice of a unit has an edge for each
vocabulary piece that matches, and a byte-fallback edge for a character that no piece is. Forward filtering sums
the weights of all paths into each node, once for each distinct unit while a worker remembers it; backward sampling then draws one path
for each occurrence, with numbers that depend on the row key, the unit's place and the step alone.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices

MARK = "▁"
#: Bytes of texts that are sampled together, and edges of the lattices that a worker remembers (about 25 bytes each).
BLOCK_BYTES, EDGES = 1 << 20, 1 << 21


class Lattice:
    """A piece vocabulary as a trie with edge weights. The weight of a piece is (rank + 2) ** -theta, its rank being minus its score."""

    def __init__(self, model: bytes, theta: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        trie, ends, width = {}, {}, 1
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) or MARK in p[1:]:
                continue
            node = 0
            for c in p:
                nxt = trie.get((node, ord(c)))
                if nxt is None:
                    nxt = trie[node, ord(c)] = width
                    width += 1
                node = nxt
            ends[node] = (i, -theta * np.log(max(0.0, -sp.get_score(i)) + 2))
        keys = np.array([a << 21 | c for a, c in trie], np.int64)
        self.shift = np.uint64(64 - (4 * len(keys)).bit_length())
        self.keys, self.to = np.full(1 << (64 - int(self.shift)), -1, np.int64), np.zeros(1 << (64 - int(self.shift)), np.int64)
        values, slot = np.fromiter(trie.values(), np.int64, len(trie)), self._slot(keys)
        while len(keys):  # open addressing: the first taker of a free slot stays, the others move on
            free = np.flatnonzero(self.keys[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.to[slot[free]] = keys[free], values[free]
            rest = np.setdiff1d(np.arange(len(keys)), free, assume_unique=True)
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) % len(self.keys)
        self.piece, self.weight = np.full(width, -1, np.int64), np.zeros(width)
        for node, (i, w) in ends.items():
            self.piece[node], self.weight[node] = i, w
        self.fallback = -theta * np.log(sp.get_piece_size() + 2.0)
        text = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.get_piece_size())]
        self.text = text
        self.text_len = np.array([len(x) for x in text], np.int64)
        self.text_at = np.cumsum(self.text_len) - self.text_len
        self.text_all = np.frombuffer(b"".join(text), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The trie node behind each node's edge with a character, -1 where there is none."""
        key = node << 21 | char
        out, slot, todo = np.full(len(key), -1, np.int64), self._slot(key), np.arange(len(key))
        while len(todo):
            found = self.keys[slot]
            hit = found == key[todo]
            out[todo[hit]] = self.to[slot[hit]]
            go = ~hit & (found >= 0)
            todo, slot = todo[go], (slot[go] + 1) % len(self.keys)
        return out

    def edges(self, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By length from 1: starts of edges in ascending order, and their trie nodes (-1: bytes of the character). chars: code points of all units, -1 after each, which no edge crosses."""
        here = np.flatnonzero(chars >= 0)
        node = self.child(np.zeros(len(here), np.int64), chars[here])
        out = [(here, np.where((node >= 0) & (self.piece[node] >= 0), node, -1))]
        here, node = here[node >= 0], node[node >= 0]
        while len(here):
            c = chars[here + len(out)]
            here, node, c = here[c >= 0], node[c >= 0], c[c >= 0]
            node = self.child(node, c)
            here, node = here[node >= 0], node[node >= 0]
            full = self.piece[node] >= 0
            out.append((here[full], node[full]))
        return out


def _filtered(lat: Lattice, units: list[str]) -> dict[str, np.ndarray]:
    """Lattices of units after forward filtering: for each unit its first and last node, for each node its edges (lo, n), for each edge its start, the running sum of probabilities inside its end node, and its ids."""
    marked = [MARK + u for u in units]
    lens = np.array([len(u) for u in marked], np.int64)
    chars = np.frombuffer("\0".join([*marked, ""]).encode("utf-32-le", "surrogatepass"), np.int32).astype(np.int64)
    last = np.cumsum(lens + 1) - 1
    first = last - lens
    raw = chars.copy()
    chars = np.where(chars == ord(MARK), 0x1FFFFF, chars)  # a mark inside a text is a character of its own
    chars[first] = ord(MARK)
    chars[last] = -1
    by_length = lat.edges(chars)
    # edges lie by (end, length): a node has at most one edge of each length
    n = np.zeros(len(chars), np.int64)
    rank = []
    for k, (a, _) in enumerate(by_length):
        rank.append(n[a + k + 1])
        n[a + k + 1] += 1
    lo = np.cumsum(n) - n
    total = int(n.sum())
    start, node = np.empty(total, np.int64), np.empty(total, np.int64)
    for k, (a, x) in enumerate(by_length):
        at = lo[a + k + 1] + rank[k]
        start[at], node[at] = a, x
    piece = np.where(node >= 0, lat.piece[node], -1)
    weight = np.where(node >= 0, lat.weight[node], lat.fallback)
    # forward filtering, by place in the unit
    place = np.arange(len(chars)) - np.repeat(first, lens + 1)
    nodes = np.argsort(place.astype(np.uint16) if len(place) and place.max() < 1 << 16 else place, kind="stable")
    nodes = nodes[n[nodes] > 0]
    cuts = np.searchsorted(place[nodes], np.arange(1, int(place.max()) + 2)) if len(nodes) else np.zeros(1, np.int64)
    score = np.full(len(chars), -np.inf)
    score[first] = 0
    run = np.empty(total)
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        m = n[nodes[a:z]]
        head = np.cumsum(m) - m
        e = np.repeat(lo[nodes[a:z]] - head, m) + np.arange(int(m.sum()))
        x = score[start[e]] + weight[e]
        top = np.maximum.reduceat(x, head)
        p = np.exp(x - np.repeat(top, m))
        sums = np.add.reduceat(p, head)
        score[nodes[a:z]] = top + np.log(sums)
        run[e] = p / np.repeat(sums, m)
    busy, k = np.flatnonzero(n > 1), 1
    while len(busy):  # summed node by node, so that it doesn't depend on what else is in the block
        run[lo[busy] + k] += run[lo[busy] + k - 1]
        k += 1
        busy = busy[n[busy] > k]
    # ids of each edge: its piece, or the bytes of its character
    lone = np.flatnonzero(piece < 0)
    as_bytes = [chr(c).encode("utf-8", "surrogatepass") for c in raw[start[lone]]]
    width = np.ones(len(piece), np.int32)
    width[lone] = [len(b) for b in as_bytes]
    at = np.cumsum(width, dtype=np.int64) - width
    flat = np.repeat(piece, width)
    if len(lone):
        flat[np.repeat(at[lone], width[lone]) + np.arange(int(width[lone].sum())) - np.repeat(np.cumsum(width[lone]) - width[lone], width[lone])] = lat.byte[np.frombuffer(b"".join(as_bytes), np.uint8)]
    small = lambda x: x.astype(np.int32)
    return {"first": small(first), "last": small(last), "lo": small(lo), "n": small(n), "start": small(start), "run": run, "width": width, "at": small(at), "flat": small(flat)}


class Known:
    """Filtered lattices of the units met so far, those of EDGES edges about; beyond that the memory starts anew, which changes nothing in what is drawn."""

    def __init__(self, lat: Lattice):
        self.lat, self.index, self.t = lat, {}, _filtered(lat, [])

    def of(self, units: list[str]) -> np.ndarray:
        """Number of each of the distinct units; those not met yet are filtered now."""
        new = [u for u in units if u not in self.index]
        if new and len(self.t["start"]) > EDGES:
            self.index, self.t, new = {}, _filtered(self.lat, []), units
        if new:
            got, old = _filtered(self.lat, new), self.t
            nodes, edges, ids = len(old["lo"]), len(old["start"]), len(old["flat"])
            for name, more in (("first", nodes), ("last", nodes), ("lo", edges), ("start", nodes), ("at", ids)):
                got[name] += np.int32(more)
            self.t = {name: np.concatenate([old[name], got[name]]) for name in got}
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        return np.fromiter((self.index[u] for u in units), np.int64, len(units))


def sample_units(known: Known, units: list[str], unit: np.ndarray, seeds: np.ndarray):
    """A sampled path for each occurrence: (ids of all occurrences in order, number of ids of each). unit: its unit's number among the distinct units; seeds: 64 bits each."""
    name = known.of(units)[unit]
    t = known.t
    at, stop, who, step, drawn = t["last"][name], t["first"][name], np.arange(len(unit), dtype=np.int32), 0, []
    count = np.zeros(len(unit), np.int64)
    # backward sampling of all occurrences at once
    with np.errstate(over="ignore"):
        while len(who):
            e = t["lo"][at]
            open_ = np.flatnonzero(t["n"][at] > 1)
            r = (mix(seeds[who[open_]] + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            end = e[open_] + t["n"][at[open_]] - 1
            pick = e[open_]
            todo = np.arange(len(open_), dtype=np.int32)
            while len(todo):
                todo = todo[(t["run"][pick[todo]] <= r[todo]) & (pick[todo] < end[todo])]
                pick[todo] += 1
            e[open_] = pick
            count[who] += t["width"][e]
            drawn.append((who, e))
            at = t["start"][e]
            go = at != stop
            at, stop, who = at[go], stop[go], who[go]
            step += 1
    fill = np.cumsum(count)
    ids = np.empty(int(fill[-1]) if len(fill) else 0, np.int32)
    for who, e in drawn:  # from the last piece to the first
        w = t["width"][e]
        fill[who] -= w
        if (w == 1).all():
            ids[fill[who]] = t["flat"][t["at"][e]]
        else:
            inner = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            ids[np.repeat(fill[who], w) + inner] = t["flat"][np.repeat(t["at"][e], w) + inner]
    return ids, count


def segment(known: Known, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of the texts) of non-null texts; an empty text has no ids."""
    parts = pc.split_pattern(texts, " ")
    lens = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    lens[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = 0
    if len(lens) and (lens == 0).any():
        parts = parts.filter(pa.array(lens > 0))
    flat = parts.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(lens)), lens)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens)
    with np.errstate(over="ignore"):
        seeds = mix(keys.view(np.uint64)[owner] + mix(nth.astype(np.uint64) + np.uint64(1)))
    ids, count = sample_units(known, flat.dictionary.to_pylist(), flat.indices.to_numpy(), seeds) if len(flat) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, count, len(lens)).astype(np.int64))])


def decode_ids(lat: Lattice, ids: np.ndarray) -> bytes:
    """Bytes of a text from its piece ids: pieces joined, marks as spaces, byte pieces as bytes, the first space dropped."""
    return b"".join([lat.text[i] for i in ids.tolist()])[1:]


def sampled_pieces(docs: DataFrame, model: str, theta: float = 0.8, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_sha256 (of the ids as little-endian int32), lossless and, with_ids, ids of each row of docs(doc_id, text).

    model: path of a sentencepiece model with byte pieces on the driver; its content goes to the executors (under 1 MB). Pieces don't cross
    a space: "a b" is the units "_a", "_b". Larger theta favours frequent and so longer pieces. The same (doc_id, text, seed) gives the same pieces, whatever the partitions; equal rows get
    equal pieces. lossless tells that decoding gives the text back, byte for byte. Null and empty texts have no pieces and are lossless.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("lossless", pa.bool_())] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches):
        lat = Lattice(spec.value, theta)
        known = Known(lat)

        def flush(held):
            b = pa.Table.from_batches(held).combine_chunks()
            texts = b.column("text").combine_chunks() if b.column("text").num_chunks != 1 else b.column("text").chunk(0)
            texts = pc.fill_null(texts, "")
            ids, off = segment(known, texts, b.column("k").to_numpy())
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
            wide = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            n = lat.text_len[ids]
            back = lat.text_all[np.repeat(lat.text_at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            cut = np.concatenate([[0], np.cumsum(n)])[off]
            four = ids.astype("<i4")
            digest = [hashlib.sha256(four[a:z]).hexdigest() for a, z in zip(off[:-1], off[1:], strict=True)]
            same = [(z - a == (m + 1 if m else 0)) and bool((back[a + 1 : z] == raw[s : s + m]).all()) and (not m or back[a] == 32) for a, z, s, m in zip(cut[:-1], cut[1:], wide[:-1], size, strict=True)]
            cols = [b.column("doc_id").combine_chunks(), pa.array(size), pa.array(np.diff(off)), pa.array(digest), pa.array(same)]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield from pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], schema=schema).to_batches()

        held, size = [], 0
        for batch in batches:
            for b in slices(batch, "text", BLOCK_BYTES):
                if size + b.column("text").nbytes > BLOCK_BYTES and held:
                    yield from flush(held)
                    held, size = [], 0
                held.append(b)
                size += b.column("text").nbytes
        if held:
            yield from flush(held)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64("doc_id", "text", F.lit(seed)))
    return read.mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, lossless boolean" + (", ids array<int>" if with_ids else ""))


def decoded(pieces: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids) of sampled_pieces; ids that aren't valid UTF-8 together give replacement characters, null ids a null text."""
    spec = pieces.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches):
        lat = Lattice(spec.value, 1.0)
        for b in batches:
            text = [None if x is None else decode_ids(lat, np.array(x, np.int64)).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return pieces.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
