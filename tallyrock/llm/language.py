"""Language identification by compression: the dictionary that packs a text smallest names it.

Each language has one zstandard raw-content dictionary, whole training texts one after the
other up to ``DICT_BYTES``. They come from about ``SAMPLE`` rows of each language, those
with the smallest hash of their id: a share of the rows that the language's count sets, so
the sample stays that small however large the input is. What reaches the driver and is
broadcast is at most DICT_BYTES for each language.

Of every text all words are packed, in lower case and without other characters, once with each
dictionary. ``score`` is 1 - smallest / second smallest
encoded size (0 with one language only, clipped to 0..1); ties go to the language with
more rows to learn from, then by name; ``accepted`` is false where the score is under ``MARGIN`` or the language
is ``und``.

Defined results: a null text, one without a letter, or no learned language gives ``und`` and
score 0. Null languages and null texts are not learned from. Repeated rows each get a row.
A row with a null id is not learned from; its held_out is null. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrock.llm.text import table

DICT_BYTES, SAMPLE, LEVEL, MARGIN = 112 << 10, 400, 9, 0.01
UNDEFINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """What is packed of a text: its words in lower case, letters only, blanks between them."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def fold(id_col: str, parts: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def training_rows(docs: DataFrame, id_col: str, text: str, lang: str) -> tuple[DataFrame, dict[str, int]]:
    """(lang, rank, text) of the rows to learn from, and how many each language has."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(F.col(id_col)).alias("rank"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language
    return rows, {r["lang"]: r["n"] for r in sorted(counts, key=lambda r: (-r["n"], r["lang"]))}


def dictionaries(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """The raw content of each language's dictionary, the language with most rows first."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        parts, room = [], dict_bytes
        for t in frame.sort_values(["rank", "text"], kind="stable")["text"].drop_duplicates():
            raw = letters(t)
            if 0 < len(raw) < room:
                parts.append(raw)
                room -= len(raw) + 1
        if not parts:  # only texts beyond the bound: the end of the first one
            parts = [letters(frame.sort_values(["rank", "text"])["text"].iloc[0])[-dict_bytes:]]
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "content": [b" ".join(reversed(parts))]})

    rows, counts = training_rows(docs, id_col, text, lang)
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * sample / n))])
    # the rank is even over -2^63 .. 2^63
    rows = rows.where(F.col("rank") / F.lit(2.0**64) + 0.5 <= F.element_at(share, F.col("lang"))).where(F.length("text") > 0)
    packed = rows.groupBy("lang").applyInPandas(pack, "lang string, content binary")
    got = {r["lang"]: bytes(r["content"]) for r in packed.collect()}
    return {k: got[k] for k in counts if k in got}


def compressors(contents: dict[str, bytes], level: int) -> list[tuple[str, object]]:
    import zstandard

    out = []
    for name in contents:
        data = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        out.append((name, zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_dict_id=False)))
    return out


def identify(text: str | None, packers: list[tuple[str, object]]) -> tuple[str, float]:
    if not text or not packers or not any(map(str.isalpha, text)):
        return UNDEFINED, 0.0
    raw = letters(text)
    sizes = [len(packer.compress(raw)) for _, packer in packers]
    best = int(np.argmin(sizes))
    second = min(sizes[:best] + sizes[best + 1 :], default=sizes[best])
    return packers[best][0], min(1.0, max(0.0, 1 - sizes[best] / second))


def predicted(docs: DataFrame, contents: dict[str, bytes], text: str = "text", level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score and accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(contents)

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packers = compressors(shared.value, level)
        for texts in batches:
            yield pd.DataFrame([identify(t, packers) for t in texts], columns=["lang_pred", "score"])

    df = docs.withColumn("_lang", of(F.col(text)))
    df = df.withColumns({"lang_pred": F.col("_lang.lang_pred"), "score": F.col("_lang.score")}).drop("_lang")
    return df.withColumn("accepted", (F.col("lang_pred") != UNDEFINED) & (F.col("score") >= margin))


def op7_language_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    contents = dictionaries(docs.where(fold("doc_id", 3) != 1))
    found = predicted(docs.select("doc_id", "text"), contents)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")
