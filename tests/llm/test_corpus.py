"""Corpus operators on small tables: brute force, round trips, and edge cases (nulls, empty and long texts, repeats, clashing columns, empty tables)."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from knotwork.llm import langid, linededup, packing, pieces, repeats, shingles, tokens, toxicity, vectors
from knotwork.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, rk string, n long, k string, spans string"


def random_text(rng, n, sep=" "):
    return sep.join("".join(chr(97 + c) for c in rng.integers(0, 6, rng.integers(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    base = random_text(rng, 150)
    w = base.split()
    out = [base, base, " ".join([*w[:70], "zzzz", *w[71:]]), " ".join([*w[:40], *w[90:]]), None, "", "   ", "Short one", "ÉTÉ naïve ▁ 日本語 \x00 <|endoftext|> it's\n\n  x ", random_text(rng, 4000), base + "\n" + random_text(rng, 90), random_text(rng, 120), "ab " * 400, "12 34"]
    table = [(i, t) for i, t in enumerate(out)]
    return [*table, table[2], (None, "null id " + base[:500]), (99, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "k", "s") for i, t in rows], SCHEMA).repartition(3)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = []
    for i, x in rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want.append((i, len((x or "").encode()), n, n > 512))
    df = tokens.token_counts(docs, tokenizer_file("byte_bpe_50k.json"))
    assert got(df, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert tokens.token_counts(docs.limit(0), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_repeats(docs, rows):
    counts = collections.Counter(r[k : k + 400] for _, t in rows for r in [(t or "").encode()] for k in range(len(r) - 399))
    want = []
    for i, t in rows:
        r = (t or "").encode()
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - 399):
            if counts[r[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        want.append((i, len(r), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert got(repeats.without_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_pipeline_cuts_passages_of_over_50_words(spark):
    """Planted passages of 51 words go whatever their bytes, of 50 they stay; the first and the last word may have marks about them."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    own = lambda: " ".join(word(7) for _ in range(60))
    short, plain, marked, fifty = (" ".join(word(n) for _ in range(k)) for n, k in ((1, 51), (4, 51), (5, 51), (5, 50)))
    parts = [(own(), own()) for _ in range(8)]
    join = lambda i, x: f"{parts[i][0]} {x} {parts[i][1]}"
    inside = [short, short, plain, plain, f'"{marked}."', f"({marked},", fifty, fifty]
    left = ["", "", "", "", '"."', "(,", fifty, fifty]
    docs = spark.createDataFrame([(i, join(i, x), "en", "s", len(join(i, x))) for i, x in enumerate(inside)] + [(8, None, "en", "s", None), (9, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert max(map(len, (short, plain, marked))) < 400
    want = sorted([*((i, join(i, x)) for i, x in enumerate(left)), (8, None), (9, "")], key=repr)
    assert got(corpus_pipeline.cut_passages(spark, docs, ""), "doc_id", "text") == want
    # the query says so too, and its other columns don't change
    both = repeats.without_repeats(docs, words=51)
    assert got(both, "doc_id", "clean_text") == want and got(both, "doc_id", "n_passages") == sorted([(i, int(i < 6)) for i in range(10)], key=repr)
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    assert got(both, *cols) == got(repeats.without_repeats(docs), *cols)
    assert repeats.without_repeats(docs.limit(0), words=51).count() == 0


def test_passages_of_long_texts_in_pieces():
    import pyarrow as pa

    rng = np.random.default_rng(12)
    texts = [random_text(rng, n) for n in (3, 80, 900, 60, 0, 51)]
    whole, pieces_ = ({(int(k), int(s), int(e)): int(h) for part in repeats._text_passages(list(range(6)), pa.array(texts), 51, limit) for k, _, _, s, e, h in zip(*part, strict=True)} for limit in (1 << 20, 701))
    assert whole == pieces_ and len(whole) == 30 + 850 + 10 + 1


def test_interval_expansion_against_counting():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(2, 9))
        parts = [rng.integers(2, 5, rng.integers(0, 60)) for _ in range(4)]
        c = collections.Counter(tuple(p[i : i + n]) for p in parts for i in range(len(p) - n + 1))
        for p, f in zip(parts, repeats.repeated_starts(parts, n), strict=True):
            assert list(f) == [c[tuple(p[i : i + n])] > 1 for i in range(len(p) - n + 1)]


def test_hot_cores_go_by_hash(docs, monkeypatch):
    cols = ("doc_id", "n_removed", "kept_sha256")
    plain = got(repeats.without_repeats(docs), *cols)
    monkeypatch.setattr(repeats, "HOT_CELLS", 0)
    assert got(repeats.without_repeats(docs), *cols) == plain


def jaccard_wanted(rows):
    """Every pair of sets compared."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(low))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    boss = list(range(len(rows)))

    def find(a):
        while boss[a] != a:
            a = boss[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            boss[find(b)] = find(a)
    want = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        want.append((i, len(sets[a]), (min(ids) if ids else None) if sets[a] else i))
    return sorted(want, key=repr)


def test_jaccard(docs, rows):
    assert got(shingles.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == jaccard_wanted(rows)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    for size in (0, 1, 30, 3000):
        x = np.unique(rng.integers(0, 1 << 48, size, dtype=np.uint64))
        for lost in (0, size // 10, size // 2):
            y = np.unique(np.concatenate([x[lost:], rng.integers(0, 1 << 48, lost // 2, dtype=np.uint64)]))
            a, b = shingles.parities(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])).view(np.uint64)
            differ = sum(int(w).bit_count() for w in a ^ b)
            assert differ <= len(np.setxor1d(x, y)) and (differ == 0) == (lost == 0)
            u, v = shingles.wide_parities(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            if u and v:
                assert len(u) * 8 >= len(x) and differ <= shingles.parities_differ(u, v) <= len(np.setxor1d(x, y))


def test_jaccard_rounds_of_centres(spark, monkeypatch):
    """Near copies whose links lie about the threshold, with so few centres that rounds are made before all pairs."""
    monkeypatch.setattr(shingles, "CENTRES", 1)
    monkeypatch.setattr(shingles, "GROUP_BYTES", 2000)
    rng = random.Random(5)
    texts = []
    for group in range(2):
        base = [f"w{group}x{j}" for j in range(100)]
        for i in range(40):
            words = base.copy()
            for j in rng.sample(range(100), rng.choice([1, 1, 2, 3])):
                words[j] = f"edit{group}y{i}z{j}"
            texts.append((len(texts), " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert got(shingles.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == jaccard_wanted(texts)


def test_trie_join_against_sets():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sets = [np.unique(rng.integers(0, 25, rng.integers(1, 20))).astype(">u8") for _ in range(12)]
        want = [i for i, y in enumerate(sets[1:]) if 10 * len(np.intersect1d(sets[0], y)) >= 6 * len(np.union1d(sets[0], y))]
        assert sorted(shingles.trie_join(sets[0], list(enumerate(sets[1:])), 6, 10)) == want


def test_line_dedup(spark):
    a, b = "the first long line of text here, indeed", "another line that is long enough to count"
    texts = [(1, f"{a}\nshort\n{b}"), (2, f"{a}\nshort"), (3, f"{b[:10]}X{b[11:]}\nunique line number three, long enough"), (4, f"{b[:7]}{b[8:]}"), (5, None), (6, ""), (7, f"{a[:-3]}XYZ"), (None, a)]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, rk string")
    out = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.line_dedup(df).collect()}
    lev = lambda s, t: next(d for d in (0, 1, 2) if d == 2 or d == _edits(s, t))
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = [], {}
    for i, t in order:
        kept = []
        for line in [] if t is None else t.split("\n"):
            if len(line) < 24 or all(lev(line, s) > 1 for s in seen):
                kept.append(line)
            if len(line) >= 24:
                seen.append(line)
        want[i] = (None if t is None else "\n".join(kept), 0 if t is None else t.count("\n") + 1, 0 if t is None else t.count("\n") + 1 - len(kept))
    assert out == want
    assert linededup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_has_no_length_floor(spark, tmp_path):
    """The query and the pipeline's stage against all pairs, lines of 0 to 40 characters about the steps of the half keys."""
    import corpus_pipeline
    from knotwork.llm.queries import op10_line_dedup

    rng = random.Random(9)
    lines = ["".join(rng.choices("abÉ", k=n)) for n in (1, 1, 1, 2, 3, 5, 7, 8, 14, 15, 16, 17, 22, 23, 24, 31, 32, 33, 40) for _ in range(2)]
    lines += ["All rights reserved.", "All rights reserved", "", " "]
    texts = []
    for i in range(60):
        some = rng.sample(lines, 6)
        for k in range(3):
            at, line = rng.randrange(len(some[k]) + 1), some[k]
            some[k] = rng.choice([line[:at] + "a" + line[at:], line[:at] + line[at + 1 :], line[:at] + "b" + line[at + 1 :]])
        texts.append((i, "\n".join(some), "en", "s", 1))
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = [], []
    for i, t, *_ in texts:
        kept = []
        for line in t.split("\n"):
            if not line or all(_edits(line, s) > 1 for s in seen):
                kept.append(line)
            if line:
                seen.append(line)
        want.append((i, 6, 6 - len(kept), "\n".join(kept)))
    assert got(op10_line_dedup(spark, str(tmp_path)), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(((*w[:3], hashlib.sha256(w[3].encode()).hexdigest()) for w in want), key=repr)
    stage = corpus_pipeline.drop_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert got(stage, "doc_id", "text") == sorted(((w[0], w[3]) for w in want if w[2] < 6), key=repr)


def _edits(s, t):
    if s == t:
        return 0
    if abs(len(s) - len(t)) > 1:
        return 2
    p = len(next(iter([s[: k] for k in range(min(len(s), len(t)), -1, -1) if s[:k] == t[:k]])))
    return 1 if s[p + 1 :] == t[p + 1 :] or s[p + 1 :] == t[p:] or s[p:] == t[p + 1 :] else 2


def test_packing(docs, rows):
    got_ = packing.pack(docs, buckets=3, token_budget=500, shards=4).collect()
    assert len(got_) == len(rows) and all(r.padding >= 0 for r in got_)
    per = collections.defaultdict(list)
    for r in got_:
        per[r.bucket, r.batch_id].append(r)
    for batch in per.values():
        assert len(batch) == 1 or len(batch) * batch[0].bucket_len <= 500 or batch[0].bucket_len == 0
        assert sorted(r.slot for r in batch) == list(range(len(batch)))


def test_query_and_stage_pack_by_tokens(spark, tmp_path, docs, rows):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from knotwork.llm.queries import op9_length_buckets

    more = [*rows, (50, "nospacesatall" * 9000), (51, "日本語" * 3000)]
    table = spark.createDataFrame(more, "doc_id long, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = sorted(((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in more), key=repr)
    for df in (op9_length_buckets(spark, str(tmp_path)), corpus_pipeline.pack(spark, table, str(tmp_path))):
        assert got(df, "doc_id", "n_tokens") == want
        batches = collections.Counter((r.bucket, r.batch_id, r.bucket_len) for r in df.collect())
        assert all(n == 1 or n * size <= 65_536 for (*_, size), n in batches.items())


def test_boundaries_against_all_choices():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x = np.unique(rng.integers(1, 60, 9))
        c = rng.integers(1, 9, len(x))
        cost = lambda bounds: sum(n * (min(b for b in bounds if b >= v) - v) for v, n in zip(x, c, strict=True))
        best = min(cost([*s, x[-1]]) for s in itertools.combinations(x[:-1].tolist(), min(2, len(x) - 1)))
        assert cost(packing.boundaries(x, c, 3)) == best


def test_pieces_round_trip(docs, rows):
    model = tokenizer_file("piece_bpe_32k.model")
    df = pieces.sampled_pieces(docs, model)
    out = df.collect()
    assert all(r.lossless for r in out) and len(out) == len(rows)
    assert got(pieces.decoded(df, model), "doc_id", "text") == sorted(((i, t or "") for i, t in rows), key=repr)
    assert got(pieces.sampled_pieces(docs.repartition(5), model), "doc_id", "ids_sha256") == got(df, "doc_id", "ids_sha256")


def test_sampling_frequencies():
    lat = pieces.Lattice(open(tokenizer_file("piece_bpe_32k.model"), "rb").read(), 0.3)
    n = 20_000
    ids, count = pieces.sample_units(pieces.Known(lat), ["ab"], np.zeros(n, np.int64), pieces.mix(np.arange(n, dtype=np.uint64)))
    weight = dict(zip(lat.piece.tolist(), np.exp(lat.weight).tolist(), strict=True))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    paths = [p for p in (["▁ab"], ["▁a", "b"], ["▁", "ab"], ["▁", "a", "b"]) if all(sp.piece_to_id(x) for x in p)]
    w = np.array([np.prod([weight[sp.piece_to_id(x)] for x in p]) for p in paths])
    seen = collections.Counter(tuple(ids[e - c : e].tolist()) for e, c in zip(np.cumsum(count), count, strict=True))
    for p, share in zip(paths, w / w.sum(), strict=True):
        assert abs(seen[tuple(sp.piece_to_id(x) for x in p)] / n - share) < 0.02


def test_language_and_toxicity(spark, docs, rows):
    rng = np.random.default_rng(4)
    words = {"xx": ["lamo", "rita", "sule", "noka"], "yy": ["dwerg", "schtal", "brunk", "flim"]}
    make = lambda l: " ".join(rng.choice(words[l], 60))
    train = [(i, make("xx" if i % 2 else "yy"), "xx" if i % 2 else "yy") for i in range(80)]
    d = spark.createDataFrame([*train, (100, None, "xx"), (101, "123 !!", None), (102, "", "yy")], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.held_out_language_id(d).collect()}
    assert all(out[i].lang_pred == l for i, _, l in train) and all(out[i].lang_pred == "und" for i in (100, 101, 102))
    t = spark.createDataFrame([(1, "You are an idiot."), (2, "He is not an idiot."), (3, "Nothing here."), (4, None), (5, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.held_out_toxicity(t, none).collect()}
    assert score[1] > score[2] > score[3] == score[4] == score[5]
    assert got(toxicity.without_toxic(t, none), "doc_id") == [(2,), (3,), (4,), (5,)]


def test_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 16))
    x[50:60] = x[0] + 0.05 * rng.standard_normal((10, 16))
    x[60:64] = x[1]
    data = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = ((u @ u.T) >= 0.9).sum(1) - 1
    out = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert [out[i].n_links for i in range(300)] == links.tolist() and len(out) == 305
    assert out[55].component_id == 0 and out[61].component_id == 1 and out[302].kept and out[302].n_links == 0
    q = np.floor(256 * x).astype(np.int64)
    want = [(i, r + 1, int(j), int(q[i] @ q[j])) for i in range(0, 300, 50) for r, j in enumerate([j for j in np.lexsort((np.arange(300), -(q @ q[i]))) if j != i][:5])]
    assert got(vectors.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert vectors.top_k(df.limit(0)).count() == 0 and vectors.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(7)
    d = 64
    a, b = (v / np.linalg.norm(v, axis=1)[:, None] for v in rng.standard_normal((2, 400, d)))
    r = vectors.rotation(d, 0)
    rot = b @ r.T
    est, half = vectors.estimated((a @ r.T), np.where(rot > 0, 1.0, -1.0), np.abs(rot).sum(1) / np.sqrt(d))
    err = est - a @ b.T
    assert abs(err.mean()) < 0.002 and (np.abs(err) <= half[None, :]).mean() > 0.999


def test_groups_of_vectors_are_verified_together():
    """Links of many groups at once, small, large and cut into parts, against each group alone; a pair counts in the first band where it meets."""
    rng = np.random.default_rng(8)
    n, dim = 5000, 16
    sizes = np.array([1, 3, 3, 40, vectors.SMALL + 1, 7, 2, vectors.TILE + 50, 40])
    starts = np.cumsum(sizes) - sizes
    near = rng.standard_normal((12, dim))
    x = near[rng.integers(0, 12, sizes.sum())] + 0.25 * rng.standard_normal((sizes.sum(), dim))
    own, mixed = rng.integers(0, 2, len(x)), np.arange(len(sizes)) % 3 == 2
    band = np.repeat(np.array([0, 1, 0, 2, 3, 0, 5, 1, 0]), sizes)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    c = vectors.codes(u, *vectors.banding(n, dim, 0.9))
    want = set()
    for a, k, cross in zip(starts, sizes, mixed, strict=True):
        for i in range(a, a + k):
            j = np.arange(i + 1, a + k)
            ok = (u[j] @ u[i] >= 0.9) & ~(c[j, : band[a]] == c[i, : band[a]]).any(1) & (~cross | (own[j] != own[i]))
            want |= {(i, int(v)) for v in j[ok]}
    i, j = vectors._links(x, starts, sizes, band, own, mixed, n, 0.9)
    assert len(want) > 1000 and len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_repeated_passages_against_counting(spark):
    """Every passage of so many words counted, in texts that share runs of words of all lengths; also with texts cut into pieces."""
    rng = random.Random(21)
    pool = [" ".join(rng.choices(["al", "be", "ga", "de", "ep"], k=60)) for _ in range(4)]
    texts = []
    for _ in range(40):
        w = []
        for _ in range(rng.randrange(1, 5)):
            some = rng.choice(pool).split()
            a = rng.randrange(40)
            w += some[a : a + rng.randrange(1, 30)] + rng.choices(["zu", "yo", "xi"], k=rng.randrange(3))
        texts.append(" ".join(w))
    texts += [texts[0], texts[1]]
    count = collections.Counter()
    places = []
    for t in texts:
        at = [m.span() for m in re.finditer(r"\S+", t)]
        own = [(at[k][0], at[k + 11][1]) for k in range(len(at) - 11)]
        places.append(own)
        count.update(t[a:z] for a, z in own)
    want = [sorted({x for a, z in own if count[t[a:z]] > 1 for x in range(a, z)}) for t, own in zip(texts, places, strict=True)]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, rk long").repartition(3)
    gone = collections.defaultdict(set)
    for r in repeats.repeated_passages(df, 12).collect():
        gone[r.rk] |= set(range(r.s, r.e))
    assert [sorted(gone[i]) for i in range(len(texts))] == want and any(want)
