"""Order-dependent one-to-one matching over candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrock.operators.components import connected_components
from tallyrock.sources.shared import cut

#: Candidate edges of a group that is not taken apart.
MOST_EDGES = 500_000


def _taken(frames: Iterator[pd.DataFrame], keys: list[str], shared: bool, columns: list[str]) -> Iterator[pd.DataFrame]:
    """Edges arrive by piece in the order of their lefts: each left takes the first right that is still free.

    Only the ends that are taken are held, not the edges.
    """
    piece, last, used = None, None, set()
    for frame in frames:
        keep = np.zeros(len(frame), bool)
        at = list(zip(*(frame[k] for k in keys), strict=True))
        for k, (key, left, right) in enumerate(zip(at, frame["left"].tolist(), frame["right"].tolist(), strict=True)):
            if key != piece:
                piece, last, used = key, None, set()
            if left == last or right in used or (shared and left in used):
                continue
            keep[k], last = True, left
            used.add(right)
            if shared:
                used.add(left)
        yield frame.loc[keep, columns]


def greedy_match(edges: DataFrame, group: str, left_order: list[str], preference: list[str], most: int = MOST_EDGES, shared: bool = False) -> DataFrame:
    """The edges that are matched, where all lefts share one order and each takes its best free right.

    ``edges`` has ``left`` and ``right``; the order columns must end in a unique one of the lefts, the
    preference in one of the rights. With ``shared`` both ends are of one kind and a match uses up both.

    A match changes nothing beyond the edges that are connected with it, so a group of more than
    ``most`` edges is taken apart into its connected components, each matched by itself. A piece's
    edges stream through a task in order, so that what it holds are its matched ends; a chain of equal amounts,
    of whatever length, takes one pass.
    """
    columns = edges.columns
    edges = cut(edges, "candidates")
    large = cut(edges.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(group), "large-groups")
    if large.isEmpty():
        pieces = edges.withColumn("_piece", F.lit(""))
    else:
        end = lambda side, name: F.concat_ws("|", F.col(group).cast("string"), F.lit("" if shared else side), F.col(name).cast("string"))
        big = edges.join(large, group, "left_semi").withColumns({"_left": end("l", "left"), "_right": end("r", "right")})
        classes = cut(connected_components(big, "_left", "_right"), "match-pieces")
        named = big.join(classes, big["_left"] == classes["node"], "left").withColumn("_piece", F.coalesce("component", F.lit("")))
        pieces = edges.join(large, group, "left_anti").withColumn("_piece", F.lit("")).unionByName(named.select(*columns, "_piece"))
    keys = [group, "_piece"]
    dealt = pieces.repartition(*keys).sortWithinPartitions(*keys, *left_order, *preference)
    return dealt.mapInPandas(lambda frames: _taken(frames, keys, shared, columns), edges.schema)
