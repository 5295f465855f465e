"""Edge cases of the corpus operators: rows a batch, large components, ties, repeated rows and ids, clashing columns, empty tables, long texts; and every query and stage called once."""

import collections
import hashlib
import itertools

import numpy as np
import pytest

import corpus_pipeline
from knotwork.llm import common, langid, linededup, packing, pieces, queries, repeats, shingles, tokens, toxicity, vectors
from knotwork.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with small tables that hold nulls, repeated rows, ties, copies, shared passages and one long text."""
    path = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(31)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 20, rng.integers(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, shared = text(120), text(60)
    texts = [base, base, base + " tail", text(80) + " " + shared + " " + text(80), text(70) + " " + shared, None, "", "you are a stupid idiot\n" + text(40), "x" * 70_000, text(30_000), "one line\none line\n" + text(9)]
    rows = [(i, t, "aa" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], (None, text(20), "bb", "s", 1)]
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 0, 0), (7, 1, 1), (None, 1, None), (99, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vec = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(60)]
    vec += [(60, vec[0][1]), (0, vec[0][1]), (61, None), (62, [0.0] * 8), (None, vec[3][1])]
    spark.createDataFrame(vec, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_returns_a_row_for_each_row(spark, sf, name):
    out = queries.QUERIES[name](spark, sf)
    n = out.count()
    assert n == {"op1": 65, "op2": n}.get(name.split("_")[0], 13)
    if name.startswith("op2"):
        assert 0 < n <= 2 * 5


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage on what the one before kept: documents' columns stay, clean rows stay, decisions take effect."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    assert ids["toxicity"] == {0, 1, 2, 3, 4, 5, 6, 8, 9, 10, None}
    assert {0, 3, 4, 5, 6, 8, 9, None} <= ids["line dedup"] and not {1} & ids["line dedup"]
    assert ids["jaccard join"] <= ids["line dedup"] and {0, 3, 4, 9} <= ids["jaccard join"] and len([r for r in seen["jaccard join"] if r.doc_id == 2]) <= 1
    cut = {r.doc_id: r.text for r in seen["suffix dedup"]}
    before = {r.doc_id: r.text for r in seen["jaccard join"]}
    assert len(cut[3]) < len(before[3]) and cut[9] == before[9] and cut[5] is None and cut[6] == ""
    assert ids["packing"] == ids["suffix dedup"]
    assert got(corpus_pipeline.run(spark, sf), "doc_id", "n_tokens") == sorted(((r.doc_id, r.n_tokens) for r in seen["packing"]), key=repr)


def test_empty_tables(spark, sf):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model, vocab = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.json")
    for df in (langid.held_out_language_id(docs), shingles.jaccard_components(docs), shingles.one_of_each_group(docs), repeats.without_repeats(docs, words=51), repeats.cut_repeats(docs, words=51), pieces.sampled_pieces(docs, model), toxicity.held_out_toxicity(docs, labels), toxicity.held_out_toxicity(docs, labels.limit(0)), packing.pack(docs), packing.pack_tokens(docs, vocab), linededup.line_dedup(docs, min_chars=1), tokens.token_counts(docs, vocab)):
        assert df.count() == 0


def test_token_counts_of_many_rows_in_a_batch(spark):
    """70,000 rows in one Arrow batch; blocks number their rows in 16 bits."""
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "200000", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 30)}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 70_000, 1, 1).selectExpr("id as doc_id", "concat('w', id) as text")
        out = tokens.token_counts(df, tokenizer_file("byte_bpe_50k.json")).toPandas().set_index("doc_id").n_tokens
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = [len(e.ids) for e in t.encode_batch([f"w{i}" for i in range(70_000)], add_special_tokens=False)]
    assert out.loc[range(70_000)].tolist() == want


def test_plain_texts_are_cut_without_the_splitter():
    """Texts of the pattern's characters are cut by classes of bytes, in the library's way; others still go to the splitter."""
    import pyarrow as pa

    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        split = tokens._Splitter(f.read())
    rng = np.random.default_rng(4)
    some = [*"''''strevemldSx1 2  \n\t\r.!éÑ", "'s", "'re", "'ve", "'ll", " '", "  "]
    plain = ["", " ", "  ", "'", "'s", "x'l", "it's", "''s", " 's", "a\n's", "'s't", "x  ", "  x", "\n x", " \nx", *("".join(rng.choice(some, rng.integers(0, 25))) for _ in range(600))]

    def counted(texts):
        names, tok, doc, freq = tokens._block(split, pa.array(texts, pa.string()))
        names = names.to_pylist()
        assert len(set(names)) == len(names) and (np.diff(tok << 16 | doc) > 0).all()
        out = [collections.Counter() for _ in texts]
        for t, d, n in zip(tok.tolist(), doc.tolist(), freq.tolist(), strict=True):
            out[d][names[t]] += n
        return out

    mixed = [*plain[:40], "日本語 it's  x", "x × y÷2", "a\x0b b", *plain[40:80], "<|endoftext|> it's", "1² 　x "]
    assert counted(mixed) == [collections.Counter(split.whole(x)) for x in mixed]
    want = [collections.Counter(split.whole(x)) for x in plain]
    split.chunk = split.whole = None
    assert counted(plain) == want


def test_workers_give_memory_back():
    """Tables of rolling hashes go with the task, also where it is broken off."""
    for end in (list, next):
        common.tables()
        end(got := common.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2])))
        got.close()
        assert common.tables.cache_info().currsize == 0


def test_stages_run_without_pandas(spark, sf):
    """Texts go through workers in slices, not as pandas columns of a whole batch."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.cut_passages):
        plan = stage(spark, docs, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(Exception, match="byte-level"):
        tokens.token_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tokenizer_file("word_bpe_49k.json")).count()


def test_top_k_of_large_components(spark):
    """Integer scores beyond 2^53 stay exact; ties go to the smaller id."""
    rng = np.random.default_rng(5)
    x = [[float(v) for v in rng.integers(-(10**6), 10**6, 4)] for _ in range(30)]
    x[50 % 30], x[7], x[9] = [1e6, 2e6, -1e6, 1e7], x[6], x[6]
    q = [[256 * int(v) for v in row] for row in x]
    df = spark.createDataFrame([(i + 50, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = []
    for a in (0,):
        s = sorted(((-sum(u * v for u, v in zip(q[a], q[b])), b) for b in range(30) if b != a))[:5]
        want += [(a + 50, r + 1, b + 50, -score) for r, (score, b) in enumerate(s)]
    assert got(vectors.top_k(df), "query_id", "rank", "vec_id", "score") == want


def test_line_dedup_columns_and_repeats(spark):
    line = "a line of some length that stays the same"
    rows = [(1, line, 5, "x"), (1, line, 6, "y"), (2, line, 7, "z"), (3, line[:-1] + "\n" + "é" * 3000, 8, "w")]
    out = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, n_lines long, line string"), min_chars=1)
    assert sorted(out.columns) == ["doc_id", "line", "n_dropped", "n_lines", "text"]
    assert got(out, "doc_id", "text", "n_lines", "n_dropped", "line") == sorted([(1, line, 1, 0, "x"), (1, line, 1, 0, "y"), (2, "", 1, 1, "z"), (3, "é" * 3000, 2, 1, "w")], key=repr)


def test_long_unit_is_sampled_and_decoded(spark):
    text = "unbroken" * 3000
    df = pieces.sampled_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer_file("piece_bpe_32k.model"))
    assert df.first().lossless and pieces.decoded(df, tokenizer_file("piece_bpe_32k.model")).first().text == text


def test_language_against_plain_compression(spark):
    """Predictions equal those of zstandard with the same dictionaries called text by text; ties and repeated rows too."""
    rng = np.random.default_rng(14)
    sound = {"xx": ["lamo", "rita", "sule", "noka"], "yy": ["dwerg", "schtal", "brunk", "flim"]}
    rows = [(i, " ".join(rng.choice(sound[k], 50)), k) for i in range(60) for k in (("xx", "yy")[i % 2],)]
    rows += [rows[0], (None, "lamo rita", None), (200, "lamo " * 20_000, "xx"), (201, "…", "yy")]
    df = spark.createDataFrame([(*r, "c", 0.5) for r in rows], "doc_id long, text string, lang string, score string, p double")
    out = langid.held_out_language_id(df).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    right = {i: k for i, _, k in rows if i is not None}
    assert all(r.lang_pred == right[r.doc_id] for r in out if r.doc_id is not None and r.doc_id != 201)
    assert [r.lang_pred for r in out if r.doc_id == 201] == ["und"]


def test_bins_beyond_the_exact_ones(spark):
    n = spark.createDataFrame([(i,) for i in (0, 1, 4095, 4096, 4097, 5000, 8191, 8192, 8193, 123_457, 10**9)], "n long")
    rows = n.withColumn("edge", packing.bin_of(n.n)).collect()
    assert all(r.edge == r.n if r.n <= 4096 else r.n <= r.edge <= r.n * (1 + 1 / 1024) for r in rows)
