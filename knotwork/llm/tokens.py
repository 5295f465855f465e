"""Token counts of whole texts without materialising token ids.

The tasks that read documents reduce each block of texts to postings: one row for each pre-token that the block
holds, with the (document, frequency) pairs packed into bytes. The postings are dealt out by pre-token, so that the
tokenizer sees each distinct pre-token once, and the piece count times the frequency is summed by document.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

#: The byte-level pattern of the vocabulary, for chunks of these characters only; other chunks go to the library.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_SAFE = re.compile(rf"[ -~\n\t\r{_L}]*")
_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
#: Where cutting before a space isn't safe: white space after it, or nothing.
_UNSAFE = r" [\s\p{Z}\x0b\x1c-\x1f\x{85}]| \z"
#: Classes of the bytes of texts that hold characters of the pattern only: letter (both bytes of those beyond ASCII), digit, other, space, other white space.
_LETTER, _DIGIT, _OTHER, _SPACE, _WHITE = range(5)
_CLASS = np.full(256, _LETTER, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = _DIGIT if _c.isdigit() else _LETTER if _c.isalpha() else _SPACE if _c == " " else _WHITE if _c in "\n\t\r" else _OTHER
_BEYOND = rf"[^ -~\n\t\r{_L}]"
#: Bytes of texts and rows that are reduced together; rows of a block are numbered in 16 bits.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 60_000
OPEN_BLOCKS = 256
#: Chunks whose pre-tokens, and pre-tokens whose pieces, a worker remembers (about 200 and 100 bytes each); beyond that it starts anew.
KNOWN_CHUNKS, KNOWN_TOKENS = 50_000, 300_000


def _tokenizer(spec: str):
    from tokenizers import Tokenizer

    kind = json.loads(spec)
    split = kind.get("pre_tokenizer") or {}
    if kind.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("a byte-level vocabulary with its own pattern, no added space and no normalizer is wanted")
    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t, sorted((x.content for x in t.get_added_tokens_decoder().values()), key=len, reverse=True)


class _Splitter:
    """Pre-tokens of texts; a chunk between spaces is split once and remembered."""

    def __init__(self, spec: str):
        self.tok, special = _tokenizer(spec)
        self.names = special
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.known: dict[str, list[str]] = {}

    def whole(self, text: str) -> list[str]:
        out = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(part)
            elif part:
                out += [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def chunk(self, c: str) -> list[str]:
        if _SAFE.fullmatch(c) and (self.special is None or "<" not in c):
            return _PATTERN.findall(c)
        got = self.known.get(c)
        if got is None:
            if len(self.known) > KNOWN_CHUNKS:
                self.known.clear()
            got = self.known[c] = self.whole(c)
        return got


def _starts(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the bytes of texts of the pattern's characters, one text after another; first: where non-empty texts start.

    A pre-token is a run of one class with the one space before it; of a longer run of white space before something the
    last character stands apart, or is that space; an apostrophe that begins a pre-token takes s, t, re, ve, m, ll or d.
    """
    n = len(buf)
    kind = _CLASS[buf]
    begin = np.zeros(n + 1, bool)
    begin[first] = begin[n] = True
    white = kind >= _SPACE
    cut = begin[:-1].copy()
    cut[1:] |= (kind[1:] != kind[:-1]) & ~(white[1:] & white[:-1]) & (kind[:-1] != _SPACE)
    at = np.flatnonzero(white)
    ends = begin[at + 1]
    after = at[~ends]
    cut[after[~white[after + 1]]] = True
    at = np.flatnonzero(buf == 39)
    at = at[cut[at] & ~begin[at + 1]]
    one = buf[at + 1]
    two = np.where(begin[at + 2], 0, buf[np.minimum(at + 2, n - 1)]) if len(at) else one
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    cut[at[short | long] + 1] = False
    to = np.concatenate([at[short] + 2, at[long] + 3])
    cut[to[to < n]] = True
    return np.flatnonzero(cut)


def _runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of texts of the pattern's characters: distinct pre-tokens, number of each pre-token's string, pre-tokens of each text."""
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], wide)[: len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off -= off[0]
    at = _starts(buf, off[:-1][np.diff(off) > 0])
    ends = np.append(at, len(buf)).astype(np.int32)
    each = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(buf)]).dictionary_encode()
    return each.dictionary, each.indices.to_numpy(), np.diff(np.searchsorted(at, off))


def _block(split: _Splitter, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of non-null texts: the distinct pre-tokens, and by (pre-token, document) sorted arrays of both and the frequency.

    Texts of the pattern's characters without special strings are cut by classes of bytes; of the others, those in which
    cutting before each space is safe go by chunks, the rest whole.
    """
    match = lambda x, pattern: pc.match_substring_regex(x, pattern).to_numpy(zero_copy_only=False)
    named = "|".join(map(re.escape, split.names))
    other = match(texts, _BEYOND)
    if named:
        other |= match(texts, named)
    known, toks = pa.array([], pa.string()), []  # toks: pre-token and, in the lower 16 bits, document
    at = np.flatnonzero(~other)
    if len(at):
        known, code, n = _runs(texts.take(pa.array(at)))
        toks.append(code.astype(np.int64) << 16)
        toks[-1] |= np.repeat(at, n)
    at = np.flatnonzero(other)
    if len(at):
        names, tok = _slow(split, texts.take(pa.array(at)), at)
        both = pa.concat_arrays([known, names]).dictionary_encode()
        new = both.indices.to_numpy().astype(np.int64)[len(known) :]  # those known keep their numbers
        toks.append(new[tok >> 16] << 16 | tok & 0xFFFF)
        known = both.dictionary
    if not toks:
        return known, *(np.zeros(0, np.int64),) * 3
    pair, freq = np.unique(np.concatenate(toks), return_counts=True)
    return known, pair >> 16, pair & 0xFFFF, freq


def _slow(split: _Splitter, texts: pa.Array, number: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct pre-tokens of texts of any kind, and for each pre-token its place there and, in the lower 16 bits, its text's number."""
    odd = pc.match_substring_regex(texts, "|".join([_UNSAFE, *map(re.escape, split.names)])).to_numpy(zero_copy_only=False)
    vocab: dict[str, int] = {}
    toks = []
    at = np.flatnonzero(~odd)
    if len(at):
        parts = pc.split_pattern(texts.take(pa.array(at)), " ")
        lens = pc.list_value_length(parts).to_numpy()
        first = np.zeros(int(lens.sum()), bool)
        first[np.cumsum(lens) - lens] = True
        flat = parts.flatten().dictionary_encode()
        code = flat.indices.to_numpy().astype(np.int32) * 2 + ~first  # odd: a space came before it
        seen = np.zeros(2 * len(flat.dictionary), bool)
        seen[code] = True
        chunks = np.flatnonzero(seen)
        inverse = (np.cumsum(seen, dtype=np.int32) - 1)[code]
        names = flat.dictionary.to_pylist()
        ids, width = [], np.empty(len(chunks), np.int32)
        for k, c in enumerate(chunks.tolist()):
            s = names[c >> 1]
            got = split.chunk(" " + s if c & 1 else s) if s or c & 1 else []
            width[k] = len(got)
            ids += [vocab.setdefault(x, len(vocab)) for x in got]
        start = np.cumsum(width, dtype=np.int32) - width
        n = width[inverse]
        where = np.repeat(start[inverse] - (np.cumsum(n, dtype=np.int32) - n), n) + np.arange(int(n.sum()), dtype=np.int32)
        toks.append(np.asarray(ids, np.int64)[where] << 16)
        toks[-1] |= np.repeat(np.repeat(number[at], lens), n)
    for d in np.flatnonzero(odd):
        got = split.whole(texts[int(d)].as_py())
        toks.append(np.fromiter((vocab.setdefault(x, len(vocab)) for x in got), np.int64, len(got)) << 16 | number[d])
    return pa.array(list(vocab), pa.string()), np.concatenate(toks)


def _packed(tok: np.ndarray, doc: np.ndarray, freq: np.ndarray) -> pa.Array:
    """A byte string for each pre-token: count of documents with it once, these as uint16, then others, then their frequencies as uint32."""
    many = freq > 1
    order = np.argsort(tok << 17 | many.astype(np.int64) << 16 | doc)
    tok, doc, freq, many = tok[order], doc[order].astype("<u2"), freq[order].astype("<u4"), many[order]
    n = int(tok[-1]) + 1 if len(tok) else 0
    total, more = np.bincount(tok, minlength=n), np.bincount(tok, weights=many, minlength=n).astype(np.int64)
    size = 4 + 2 * total + 4 * more
    end = np.cumsum(size)
    start = end - size
    out = np.zeros(int(end[-1]) if n else 0, np.uint8)
    out[(start[:, None] + np.arange(4)).ravel()] = (total - more).astype("<u4").view(np.uint8)
    within = np.arange(len(tok)) - np.repeat(np.cumsum(total) - total, total)
    at = start[tok] + 4 + 2 * within
    out[(at[:, None] + np.arange(2)).ravel()] = doc.view(np.uint8)
    m = np.flatnonzero(many)
    at = (start + 4 + 2 * total)[tok[m]] + 4 * (within[m] - (total - more)[tok[m]])
    out[(at[:, None] + np.arange(4)).ravel()] = freq[m].view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], end]).astype(np.int32)), pa.py_buffer(out)])


def _unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, document and frequency of each posting."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(col.buffers()[2], np.uint8)
    u4 = lambda at: buf[at].astype(np.int64) | buf[at + 1].astype(np.int64) << 8 | buf[at + 2].astype(np.int64) << 16 | buf[at + 3].astype(np.int64) << 24
    once, size = u4(off[:-1]), np.diff(off)
    more = (size - 4 - 2 * once) // 6
    total = once + more
    row = np.repeat(np.arange(len(col)), total)
    within = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
    at = off[:-1][row] + 4 + 2 * within
    doc = buf[at].astype(np.int64) | buf[at + 1].astype(np.int64) << 8
    freq = np.ones(len(row), np.int64)
    m = np.flatnonzero(within >= once[row])
    freq[m] = u4((off[:-1] + 4 + 2 * total)[row[m]] + 4 * (within[m] - once[row[m]]))
    return row, doc, freq


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


_BYTES = _byte_chars()


def count_pieces(tok, special: set[str], names: list[str]) -> dict[str, int]:
    """Pieces of each pre-token; its bytes go to the merge table directly."""
    cut, space = tok.model.tokenize, _BYTES[32]
    shown = lambda x: x.replace(" ", space) if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(_BYTES)
    return {x: 1 if x in special else len(cut(shown(x))) for x in names}


#: A row with a null token holds a block's documents: id, null flag and bytes of each as three runs of long.
_POSTINGS = pa.schema([("token", pa.string()), ("block", pa.int64()), ("salt", pa.int64()), ("docs", pa.binary())])
#: facts: such a row again; otherwise sums: a long for each document of the block.
_PARTS = pa.schema([("block", pa.int64()), ("facts", pa.bool_()), ("sums", pa.binary())])
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of docs(doc_id, text).

    tokenizer: path of a byte-level tokenizer file of the tokenizers library on the driver (others raise ValueError); its
    content goes to the executors (a few MB, whatever the input). Counts equal encode(text, add_special_tokens=False); special strings inside a
    text count as the one token they are. A null or empty text has 0 bytes and 0 tokens; a row that comes twice is
    returned twice; an empty table gives an empty result; other columns are not read.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def postings(batches):
        split, part, number = _Splitter(spec.value), TaskContext.get().partitionId() if TaskContext.get() else 0, 0

        def flush(ids, texts):
            nonlocal number
            block = part << 24 | number
            number += 1
            ids, texts = pa.concat_arrays(ids), pa.concat_arrays(texts)
            n = len(texts)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            facts = np.concatenate([pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.int64), size.to_numpy()]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([block]), pa.array([block]), pa.array([facts])], schema=_POSTINGS)
            names, tok, doc, freq = _block(split, pc.fill_null(texts, ""))
            packed = _packed(tok, doc, freq)
            for a in range(0, len(names), 50_000):
                k = min(50_000, len(names) - a)
                yield pa.RecordBatch.from_arrays([names.slice(a, k), pa.array(np.full(k, block)), pa.array(np.zeros(k, np.int64)), packed.slice(a, k)], schema=_POSTINGS)

        ids, texts, held, rows = [], [], 0, 0
        for batch in batches:
            for b in slices(batch, "text", BLOCK_BYTES, BLOCK_DOCS):
                size = int(pc.sum(pc.fill_null(pc.binary_length(b.column("text")), 0)).as_py() or 0)
                if texts and (held + size > BLOCK_BYTES or rows + len(b) > BLOCK_DOCS):
                    yield from flush(ids, texts)
                    ids, texts, held, rows = [], [], 0, 0
                ids.append(b.column("doc_id"))
                texts.append(b.column("text"))
                held, rows = held + size, rows + len(b)
        if texts:
            yield from flush(ids, texts)

    def summed(batches):
        tok, special = _tokenizer(spec.value)
        special = set(special)
        pieces: dict[str, int] = {}
        sums: dict[int, np.ndarray] = {}

        def flush():
            for block, s in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([False]), pa.array([s.astype("<i8").tobytes()])], schema=_PARTS)
            sums.clear()

        for b in batches:
            facts = pc.is_null(b.column("token"))
            d = b.filter(facts)
            if len(d):
                yield pa.RecordBatch.from_arrays([d.column("block"), pa.array([True] * len(d)), d.column("docs")], schema=_PARTS)
            b = b.filter(pc.invert(facts))
            if not len(b):
                continue
            enc = b.column("token").dictionary_encode()
            names = enc.dictionary.to_numpy(zero_copy_only=False).tolist()
            new = [x for x in names if x not in pieces]
            if len(pieces) + len(new) > KNOWN_TOKENS:
                pieces.clear()
                new = names
            pieces.update(count_pieces(tok, special, new))
            per = np.fromiter((pieces[x] for x in names), np.int64, len(names))[enc.indices.to_numpy()]
            row, doc, freq = _unpacked(b.column("docs"))
            value, block = per[row] * freq, b.column("block").to_numpy()
            kinds, which = np.unique(block, return_inverse=True)
            for k, name in enumerate(kinds.tolist()):
                m = which[row] == k if len(kinds) > 1 else slice(None)
                got = np.bincount(doc[m], weights=value[m]).astype(np.int64)
                s = sums.get(name)
                if s is None:
                    sums[name] = got
                elif len(s) < len(got):
                    got[: len(s)] += s
                    sums[name] = got
                else:
                    s[: len(got)] += got
            if len(sums) > OPEN_BLOCKS:
                yield from flush()
        yield from flush()

    def counted(batches):
        """The blocks of a task one after another: facts come first, sums are added up as they come."""
        cur, facts, total = None, None, None

        def out():
            if facts is None:
                return
            n = len(facts) // 3
            yield pa.RecordBatch.from_arrays([pa.array(facts[:n], mask=facts[n : 2 * n] > 0), pa.array(facts[2 * n :]), pa.array(total)], schema=_COUNTS)

        for b in batches:
            for block, is_facts, raw in zip(*(b.column(c).to_pylist() for c in ("block", "facts", "sums")), strict=True):
                got = np.frombuffer(raw, "<i8").astype(np.int64)
                if block != cur:
                    yield from out()
                    cur, facts = block, None
                if is_facts:
                    facts, total = got, np.zeros(len(got) // 3, np.int64)
                else:
                    total[: len(got)] += got
        yield from out()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = read.mapInArrow(lean(postings), "token string, block long, salt long, docs binary").repartition("token", "salt")
    parts = dealt.mapInArrow(lean(summed), "block long, facts boolean, sums binary").repartition("block").sortWithinPartitions("block", F.desc("facts"))
    return parts.mapInArrow(lean(counted), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
