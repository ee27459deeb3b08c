"""Near copies by SimHash and by the exact Jaccard similarity of word shingles: every row's class, and which row of it stays.

Rows link as in operator 8, where the fingerprints that its BK-trees hold differ in few bits; edits of a few words
mostly change more bits than that, so an exact join follows, and a class is what both kinds of links connect.

A text is the set of its shingles of ``SHINGLE`` words, ASCII letters in lower case; a text of fewer
words is one shingle. Texts of equal sets count once. Two sets at ``LEAST`` or more link, and the links are
those of the exact join in ``jaccard``, so none is missed. A group of near copies is first tested against its
leaders, one pair a set; only sets that are still in several classes are compared with each other.

Defined results: null texts and those without words are copies of each other. A null id comes
after all others. Repeated rows each get a row. Texts are read whole, however long. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrock.llm import simhash
from tallyrock.llm.jaccard import HOT, PART, SHINGLE, links_of, ordered_places, with_sets
from tallyrock.operators.components import connected_components
from tallyrock.sources.shared import cut, scratch

LEAST = 0.8


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST, hot: int = HOT, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_key``, a number of the row, and (_key, _least) of rows that are not their class's first: its key, by smallest id."""
    percent = round(100 * least)
    keyed = cut(docs.withColumn("_key", F.monotonically_increasing_id()), "similar-rows")
    texts = keyed.select(F.col("_key").alias("node"), F.col(text).alias("_text"))
    with scratch() as keep:
        rows = cut(with_sets(keyed.select("_key", F.col(id_col).alias("_id"), F.col(text).alias("_text")), shingle, percent), "similar-sets")
        order = F.struct(F.col("_id").isNull(), "_id", "_key")
        distinct = cut(rows.groupBy("high", "low").agg(F.min("_key").alias("node"), F.min(order).alias("least")), "similar-distinct")
        once = rows.join(distinct.select(F.col("node").alias("_key")), "_key", "left_semi").select(F.col("_key").alias("node"), "n", "first", "own", "lower")
        links = links_of(ordered_places(once, texts, shingle, percent, hot), once.drop("first"), texts, shingle, percent, part)
        links = links.select("a", "b").unionByName(_links_by_fingerprint(keyed, text, rows, distinct))
        classed = distinct.join(connected_components(links, "a", "b"), "node", "left").withColumn("class", F.coalesce("component", "node"))
        chosen = classed.groupBy("class").agg(F.min("least").alias("first")).select("class", F.col("first._key").alias("_least"))
        named = classed.join(chosen, "class").select("high", "low", "_least")
        copies = keep(cut(rows.select("_key", "high", "low").join(named, ["high", "low"]).where("_key <> _least").select("_key", "_least"), "similar-copies"))
    return keyed, copies


def _links_by_fingerprint(keyed: DataFrame, text: str, rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): nodes of ``distinct`` that operator 8 puts into one class; each row links with the first of its class."""
    classes = simhash.near_duplicates(keyed, "_key", text).where("_key <> component_id").select("_key", "component_id")
    at = rows.join(distinct.select("high", "low", "node"), ["high", "low"]).select("_key", "node")
    # copies are one node, so a large group of them brings one row
    found = classes.join(at.withColumnRenamed("node", "a"), "_key").select("component_id", "a").distinct().join(at.select(F.col("_key").alias("component_id"), F.col("node").alias("b")), "component_id")
    return cut(found.where("a <> b").select("a", "b").distinct(), "similar-simhash")
