"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``, with the columns
of documents; the last returns the encoded rows. A stage works on all its predecessor kept.
Stages that have to tell documents apart number their rows, so a document stays or goes by its
own text, whatever its id: rows without an id, and rows that share one, are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrock.llm import decontaminate, pieces, pii, quality, similar
from tallyrock.llm.text import table
from tallyrock.sources.shared import cut, drop_table, scratch

#: Words in a row that make a document contaminated, and the share of its words that must be hit for it to go.
SPAN, MOST_HIT = 10, 0.0
#: Words of a shingle, and the Jaccard similarity of two documents' shingles from which they are near-duplicates.
SHINGLE, ALIKE = 5, 0.8


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, and the new name of each column; operators add columns of their own."""
    names = {c: f"_own_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows, names = _apart(docs)
    return _back(quality.with_quality(rows, table(spark, sf_dir, "labels"), names["doc_id"], names["text"]).where("kept"), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, by operator 8's links and by exact ones (SHINGLE, ALIKE): the one with the smallest id, a null id last."""
    rows, names = _apart(docs)
    rows, copies = similar.near_copies(rows, names["doc_id"], names["text"], shingle=SHINGLE, least=ALIKE)
    return _back(rows.join(copies, "_key", "left_anti"), names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of words that they share with the benchmark."""
    rows, names = _apart(docs)
    keyed = cut(rows.withColumn("_key", F.monotonically_increasing_id()), "pipeline-rows")
    found = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="_key", text=names["text"], span=SPAN)
    # written, so that Spark knows its size and need not shuffle the texts for few hits
    hit = cut(found.where(F.col("n_hit") > MOST_HIT * F.col("n_words")).select("_key"), "pipeline-hits")
    return _back(keyed.join(hit, "_key", "left_anti"), names)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by the name of its kind."""
    rows, names = _apart(docs)
    text, size = names["text"], names["n_chars"]
    masked = pii.with_spans(rows, text).withColumn(text, pii.redacted(F.col(text), F.col("spans")))
    return _back(masked.withColumn(size, F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col(size))), names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document's text."""
    return pieces.encoded(docs).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "lossless", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("pieces", encode),
]
#: Hashes, trees and merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; each stage's result is written and read again as the next one's input.

    A stage's own tables, and its input if a stage wrote it, are removed once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch() as keep:
            kept = keep(cut(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if k:
            drop_table(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
