"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, slices

#: Documented bounds of the sample that dictionaries are made of.
DOCS_PER_LANG, CHARS_PER_DOC, DICT_BYTES, MAX_LANGS = 300, 1500, 96 << 10, 400
CHUNK, LEVEL, MIN_MARGIN = 4096, 3, 0.015


def fit(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, chars_per_doc: int = CHARS_PER_DOC, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from a bounded sample of labelled(doc_id, text, lang).

    Of each language the docs_per_lang rows with the smallest hash of id and text, of each the chars_per_doc
    characters from the middle; the language with most rows comes first. Rows without text or lang are left out. The rank filter is pushed below the shuffle,
    so a language that holds most rows sends docs_per_lang rows a task.
    """
    t = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h")).filter("lang is not null and text is not null")
    start = F.greatest(F.lit(1), ((F.length("text") - chars_per_doc) / 2).cast("int"))
    t = t.select("lang", "h", F.substring("text", start, F.lit(chars_per_doc)).alias("text"))
    picked = t.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("r") <= docs_per_lang)
    made: dict[str, list[str]] = {}
    for lang, _, text in sorted(tuple(x) for x in picked.select("lang", "r", "text").collect()):
        made.setdefault(lang, []).append(text)
    if len(made) > MAX_LANGS:
        raise ValueError(f"{len(made)} languages; dictionaries for {MAX_LANGS} at most are kept in memory")
    seen = {r["lang"]: r["n"] for r in t.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS).collect()}
    return {k: "\n".join(made[k]).encode()[:dict_bytes] for k in sorted(made, key=lambda k: (-seen.get(k, 0), k))}


def compressors(dictionaries: dict[str, bytes]):
    import zstandard as z

    out = []
    for lang, data in dictionaries.items():
        d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def classify(text: str | None, coders, min_margin: float) -> tuple[str, float, bool]:
    """Language, margin 1 - smallest / second smallest size, rejected. A rejected text gets the language learned from most rows."""
    if text is None or not coders or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    raw = text.encode()
    parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
    sizes = [sum(len(c.compress(p)) for p in parts) for _, c in coders]
    order = np.argsort(sizes, kind="stable")
    margin = 1 - sizes[order[0]] / sizes[order[1]] if len(sizes) > 1 else 1.0
    if margin < min_margin:
        return coders[0][0], margin, True
    return coders[order[0]][0], margin, False


def language_id(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score (the margin, 0 to 1) and rejected of each row of docs(doc_id, text).

    Each text is encoded whole, in chunks of 4 KB, with each language's dictionary. rejected tells that the margin
    is under min_margin: then the compression decides nothing, and lang_pred is the language learned from most rows.
    Null texts, texts without a letter, and any text when no language was learned give und, 0, rejected.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(dictionaries)
    schema = pa.schema([("doc_id", pa.int64()), ("text_crc", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        coders = compressors(shipped.value)
        for batch in batches:
            for b in slices(batch, "text"):
                got = [classify(t, coders, min_margin) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_crc"), *(pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True))], schema=schema)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), crc_of_id().alias("text_crc"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, text_crc long, lang_pred string, score double, rejected boolean")


def held_out_language_id(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 4 is not 2, predict all."""
    got = language_id(docs, fit(docs.filter(crc_of_id() % 4 != 2)))
    return got.select("doc_id", (F.col("text_crc") % 4 == 2).alias("held_out"), "lang_pred", "score", "rejected")
