"""Quality rules: text counts and a hashed n-gram likelihood ratio, in DataFrame functions only.

A document is kept if it passes the count rules and the log-likelihood ratio of its
hashed word 1- and 2-grams, trusted documents against the raw corpus, is at least
``threshold`` per n-gram. Both multinomials are smoothed by one pseudo-count per
bucket; the raw one counts every document, the trusted one the texts of at most
``trusted_rows`` labelled rows (those with the smallest hash of their id). The ratios
are whole ten-thousandths of a nat, so that their sum does not depend on any order.

Defined results: a null or empty text has no words, fails the count rules and is not
kept. Null ids are kept as rows of their own and are never trusted. Repeated rows each
get a row. Empty tables give empty results. Without trusted rows every ratio is that of
the smoothing alone. Other columns are left alone; names that begin with ``_q_`` are
used for scratch columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrock.llm.text import lower_ascii, space_words, table

#: Hash buckets of the two multinomials: the most numbers that reach the driver and go into the plan.
BUCKETS = 1 << 13
#: The most labelled rows from which the trusted multinomial is counted.
TRUSTED_ROWS = 50_000
#: Mean log ratio per n-gram, in nats, from which a document is kept.
THRESHOLD = -0.08
UNIT = 10_000
SYMBOLS = r"[#*$%&|<>]"
TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def shifted(array: str, by: int, length: int) -> Column:
    """``length`` elements fewer at the end, and ``by`` fewer at the front."""
    return F.slice(array, F.lit(by + 1), F.greatest(F.size(array) - length, F.lit(0)))


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_q_words": space_words(F.col(text)), "_q_lines": lines, "n_symbols": F.regexp_count(raw, F.lit(SYMBOLS)).cast("long")})
    df = df.withColumns(
        {
            "n_words": F.size("_q_words").cast("long"),
            "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_one": F.transform("_q_words", lambda w: F.xxhash64(w)),
        }
    )
    pair = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn("_q_two", F.zip_with(shifted("_q_one", 0, 1), shifted("_q_one", 1, 1), pair))
    df = df.withColumn("_q_four", F.zip_with(shifted("_q_two", 0, 2), shifted("_q_two", 2, 2), pair))
    df = df.withColumn("_q_five", F.zip_with(shifted("_q_four", 0, 1), shifted("_q_one", 4, 4), pair))
    df = df.withColumn("_q_twice", F.size("_q_five") > F.size(F.array_distinct("_q_five")))
    ranked = F.sort_array(F.transform("_q_five", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_q_ranked", F.when(F.col("_q_twice"), ranked))
    df = df.withColumn("n_repeat_words", F.when(F.col("_q_twice"), covered_words(repeated_places("_q_ranked"), 5)).otherwise(0).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.drop("_q_words", "_q_lines", "_q_one", "_q_two", "_q_four", "_q_five", "_q_twice", "_q_ranked")


def repeated_places(ranked: str) -> Column:
    """Places of the windows whose hash occurs twice or more, from (hash, place) sorted by hash."""
    n = F.size(ranked)
    same = F.zip_with(F.slice(ranked, F.lit(1), n - 1), F.slice(ranked, F.lit(2), n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    return F.sort_array(F.array_distinct(F.flatten(same)))


def covered_words(places: Column, width: int) -> Column:
    """Words that lie in a window of ``width`` words at one of the sorted ``places``."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
    add = lambda s, i: F.struct((s["n"] + F.least(F.lit(width), i - s["last"])).alias("n"), i.alias("last"))
    return F.aggregate(places, start, add, lambda s: s["n"])


def gram_buckets(df: DataFrame, text: str, buckets: int) -> DataFrame:
    """Add _q_grams: for each word or symbol run, the bucket of it and that of it and its successor."""
    tokens = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKENS), F.lit(0))
    df = df.withColumn("_q_tokens", F.transform(tokens, lambda w: F.xxhash64(w)))
    bucket = lambda *h: F.pmod(F.xxhash64(*h), F.lit(buckets)).cast("int")
    two = F.zip_with(shifted("_q_tokens", 0, 1), shifted("_q_tokens", 1, 1), lambda a, b: bucket(a, b))
    return df.withColumn("_q_grams", F.concat(F.transform("_q_tokens", lambda h: bucket(h)), two)).drop("_q_tokens")


def trusted_ids(labels: DataFrame, rows: int) -> DataFrame:
    """Ids labelled good and not toxic, at most ``rows``, those with the smallest hash."""
    good = labels.where((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").alias("_q_trusted")).distinct().orderBy(F.xxhash64("_q_trusted"), "_q_trusted").limit(rows)


def gram_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text: str, buckets: int) -> DataFrame:
    """(_q_gram, raw, target): how often each bucket occurs in all texts and in trusted ones.

    The trusted ids are broadcast; ``trusted_ids`` bounds their number.
    """
    rows = docs.select(F.col(id_col).alias("_q_id"), F.col(text).alias("_q_text"))
    rows = rows.join(F.broadcast(trusted), F.col("_q_id") == F.col("_q_trusted"), "left").select(F.col("_q_trusted").isNotNull().alias("_q_good"), "_q_text")
    grams = gram_buckets(rows, "_q_text", buckets).select("_q_good", F.explode_outer("_q_grams").alias("_q_gram"))
    counts = grams.groupBy("_q_gram").agg(F.count(F.lit(1)).alias("raw"), F.count_if("_q_good").alias("target"))
    return counts.where(F.col("_q_gram").isNotNull())


def ratio_table(counts: DataFrame, buckets: int) -> list[int]:
    """For each bucket the smoothed log ratio of target and raw frequency, in 1/UNIT nats."""
    import math

    got = {r["_q_gram"]: (r["raw"], r["target"]) for r in counts.collect()}  # at most ``buckets`` rows
    raw, target = (sum(x[k] for x in got.values()) + buckets for k in (0, 1))
    pairs = (got.get(b, (0, 0)) for b in range(buckets))
    return [round(UNIT * (math.log((t + 1) / target) - math.log((r + 1) / raw))) for r, t in pairs]


def with_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the counts, base_failed, n_grams, llr (nats per n-gram) and kept.

    Reads ``docs`` twice: once to count n-grams, once to score, without a shuffle of texts.
    """
    ratios = ratio_table(gram_counts(docs, trusted_ids(labels, trusted_rows), id_col, text, buckets), buckets)
    looked_up = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    df = gram_buckets(text_counts(docs, text), text, buckets)
    total = F.aggregate("_q_grams", F.lit(0).cast("long"), lambda s, g: s + F.get(looked_up, g))
    df = df.withColumns({"n_grams": F.size("_q_grams").cast("long"), "_q_sum": total}).drop("_q_grams")
    df = df.withColumn("llr", F.when(F.col("n_grams") > 0, F.col("_q_sum") / (F.col("n_grams") * UNIT)).otherwise(0.0)).drop("_q_sum")
    # Spark moves no filter below a column that depends on a row's place; a filter on ``kept`` that
    # moved down would take all the counts with it and compute them over and over
    placed = F.monotonically_increasing_id() >= 0
    return df.withColumn("kept", F.when(placed & F.col("base_failed"), False).otherwise(F.col("llr") >= threshold))


def op2_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_quality(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "llr")
