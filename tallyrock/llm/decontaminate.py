"""Benchmark decontamination by winnowing.

Words are hashed; a gram is ``gram`` consecutive words. Each window of ``span - gram + 1``
grams keeps its smallest gram hash (the rightmost of equal ones), in documents and items
alike, so that two texts that share ``span`` consecutive words share a kept gram at the same
place in them. Kept grams are joined, and each hit is extended word by word to both sides; it
counts when the run reaches ``span`` words. Items shorter than ``span`` are one window, which
has no kept gram of its own: documents are searched for the whole item at every place.

The documents are read once and not shuffled: a task emits, beside each document's id and
word count, the kept grams that a bitmap of the items' grams lets through, each with the
``span - gram`` word hashes around it. The bitmap has ``BITS`` bits whatever the size of the
benchmark, which is why it may be broadcast; what it lets through too much, the join drops.

Defined results: a null or empty text has no words and no hits; a null or empty item has no
window. Repeated document rows each get a row (they are told apart by their place in the
input). Repeated items count once per distinct item id; a null item id has windows, but is
not listed. Empty tables give empty results or no hits. Texts are read whole, however long;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrock.llm.text import alnum_words, table
from tallyrock.sources.shared import cut

SPAN, GRAM = 10, 5
#: Bits of the filter that is broadcast (512 KB).
BITS = 1 << 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
HIT = "struct<h:bigint,n:int,at:int,before:array<bigint>,after:array<bigint>>"


def word_hashes(text: str | None) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = alnum_words(text)
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words: a polynomial of their hashes, then mixed."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = np.full(count, n, np.uint64)
    for k in range(n):
        h = h * _MULTIPLIER + words[k : k + count]
    h ^= h >> np.uint64(32)
    return h * _MULTIPLIER ^ h >> np.uint64(29)


def kept_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of each window's smallest hash, the rightmost of equal ones."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], width)
    return np.unique(len(hashes) - 1 - (np.arange(len(windows)) + windows.argmin(axis=1)))


def grams_of(words: np.ndarray, span: int, gram: int, short: tuple[int, ...] | None, passes) -> list[dict]:
    """Kept grams of a text and, for each length in ``short``, all its runs of that length.

    ``short`` None: the text is an item; one of fewer than ``span`` words is a single run.
    """
    found = []

    def add(h: int, n: int, at: int, reach: int) -> None:
        before = words[max(0, at - reach) : at][::-1].view(np.int64).tolist()
        found.append({"h": h, "n": n, "at": at, "before": before, "after": words[at + n : at + n + reach].view(np.int64).tolist()})

    lengths = short if short is not None else ((len(words),) if 0 < len(words) < span else ())
    if len(words) >= span:
        hashes = gram_hashes(words, gram)
        at = kept_places(hashes, span - gram + 1)
        for k in at[passes(hashes[at])].tolist():
            add(int(hashes[k : k + 1].view(np.int64)[0]), gram, k, span - gram)
    for n in lengths:
        hashes = gram_hashes(words, n) * np.uint64(3)  # apart from kept grams of as many words
        for k in np.flatnonzero(passes(hashes)).tolist():
            add(int(hashes[k : k + 1].view(np.int64)[0]), -n, k, 0)
    return found


def item_grams(items: DataFrame, item_col: str, text: str, span: int, gram: int) -> DataFrame:
    """(h, n, item, before, after) of every kept gram of the items."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(item, found) for item, t in zip(frame["item"], frame["text"], strict=True) if (found := grams_of(word_hashes(t), span, gram, None, lambda h: np.ones(len(h), bool)))]
            yield pd.DataFrame({"item": pd.Series([r[0] for r in rows], dtype=object), "found": pd.Series([r[1] for r in rows], dtype=object)})

    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text).alias("text")).mapInPandas(of, f"item string, found array<{HIT}>")
    return rows.select("item", F.inline("found")).drop("at").distinct()


def bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """One byte per ``bits``-th part of the hashes that occur; at most bits / 64 rows reach the driver."""
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = grams.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast((h & {bits - 1}) & 63 as int)))").alias("m")).collect()
    packed = np.zeros(bits // 64, np.int64)
    for r in words:
        packed[r["w"]] = r["m"]
    return packed


def hits(docs: DataFrame, items: DataFrame, id_col: str, text: str, item_col: str, item_text: str, span: int, gram: int, bits: int) -> DataFrame:
    """(row, id, n_words, item, first, last): runs [first, last) of document words inside occurrences of item windows; item null: none."""
    known = cut(item_grams(items, item_col, item_text, span, gram), "item-grams")
    packed = bitmap(known, bits)
    short = tuple(-r["n"] for r in known.where("n < 0").select("n").distinct().collect())  # at most span - 1 lengths
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    last = np.uint64(bits - 1)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"))

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = np.unpackbits(shared.value.view(np.uint8), bitorder="little").astype(bool)
        for frame in frames:
            words = [word_hashes(t) for t in frame["text"]]
            found = [grams_of(w, span, gram, short, lambda h: flags[(h & last).astype(np.int64)]) for w in words]
            yield pd.DataFrame({"row": frame["row"], "id": frame["id"], "n_words": np.array([len(w) for w in words], np.int64), "found": pd.Series(found, dtype=object)})

    found = rows.mapInPandas(of, f"row long, id {dict(rows.dtypes)['id']}, n_words long, found array<{HIT}>")
    found = found.select("row", "id", "n_words", F.inline_outer("found"))
    # rows without a gram get a hash of their own, or they would all meet at the join's null
    found = found.withColumns({"n": F.coalesce("n", F.lit(0)), "h": F.coalesce("h", "row")})
    known = known.select("h", "n", "item", F.col("before").alias("item_before"), F.col("after").alias("item_after"))
    joined = found.join(known, ["h", "n"], "left")
    same = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    joined = joined.withColumns({"_l": same("before", "item_before"), "_r": same("after", "item_after")})
    whole = F.col("item_before").isNotNull() & ((F.col("n") < 0) | (F.col("n") + F.col("_l") + F.col("_r") >= span))
    first, end = F.col("at") - F.col("_l"), F.col("at") + F.abs("n") + F.col("_r")
    return joined.select("row", "id", "n_words", F.when(whole, F.col("item")).alias("item"), F.when(whole, first).alias("first"), F.when(whole, end).alias("last"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """(id_col, n_words, n_hit, items): per document row its words, those inside item windows, and the sorted item ids."""
    found = hits(docs, items, id_col, text, item_col, item_text, span, gram, bits)
    grouped = found.groupBy("row").agg(
        F.first("id").alias(id_col),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("first").isNotNull(), F.struct("first", "last")))).alias("runs"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    add = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(s["to"], r["first"]))).alias("n"), F.greatest(s["to"], r["last"]).alias("to"))
    return grouped.select(id_col, "n_words", F.aggregate("runs", start, add, lambda s: s["n"]).cast("long").alias("n_hit"), "items")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
