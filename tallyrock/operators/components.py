"""Connected components: by union-find where the edges fit one task, else by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrock.sources.shared import cut, drop_table

#: Edges that one task unites; 16 MB of numbers.
ONE_TASK = 1 << 20


def _united(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of all edges of a task; a root is the least of its class."""
    up: dict = {}

    def root(x):
        while (at := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(at, at)
        return x

    for frame in frames:
        for u, v in zip(frame["u"], frame["v"], strict=True):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        yield pd.DataFrame({"node": list(up), "component": [root(x) for x in up]})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least node around each node: the larger ones, or the smaller ones and itself."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of an edge list; component is the smallest node of its class.

    Nodes are numbers or strings. Up to ``one_task`` distinct edges are united in one task, as
    shuffles of so little would only take time; more go through rounds of stars over the whole
    cluster, about log of the longest path's length of them, each cut off from its past by a
    table in the shared folder. Loops are ignored, so a node that only has a loop is not listed;
    null ends are dropped.
    """
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    if now.count() <= one_task:
        kind = dict(now.dtypes)["u"]
        return now.coalesce(1).mapInPandas(_united, f"node {kind}, component {kind}")
    seen = None
    for _ in range(max_rounds):
        last, now = now, cut(_star(_star(now, large=True), large=False), "components")
        drop_table(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = state
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
