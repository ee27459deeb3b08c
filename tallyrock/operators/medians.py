"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrock.sources.shared import cut

#: Values of a group that one task may hold (8 MB), and ranges that a pass tells apart.
MOST, RANGES = 1 << 20, 1024


def exact_median(rows: DataFrame, keys: list[str], value: str, least: int = 1, most: int = MOST, ranges: int = RANGES) -> DataFrame:
    """(keys, median, n) of groups of ``least`` values or more; null values do not count.

    A group of up to ``most`` values is held by one task. Of a larger one the two values in the middle
    are looked for: each pass counts the values of ``ranges`` equal parts of where they must lie
    and keeps the part that holds them, until it has ``most`` values or a single one.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).where(F.col("n") >= least), "median-sizes")
    large = sizes.where(F.col("n") > most)
    if large.isEmpty():
        return rows.groupBy(*keys).agg(F.median("_v").alias("median"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    small = rows.join(sizes.where(F.col("n") <= most).select(*keys), keys, "left_semi").groupBy(*keys).agg(F.median("_v").alias("median"), F.count(F.lit(1)).alias("n"))
    # one row for each of the two middle ranks: values between low and high, of which ``rank`` come before it
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    open_ = cut(large.select(*keys, F.explode(ranks).alias("middle"), "n", "_low", "_high").withColumn("rank", F.col("middle")), "median-open")
    found = None
    while not open_.isEmpty():
        part = F.when(F.col("_high") > F.col("_low"), F.least(F.lit(ranges - 1), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * ranges))).otherwise(0)
        near = rows.join(open_, keys).where(F.col("_v").between(F.col("_low"), F.col("_high"))).withColumn("part", part)
        counts = near.groupBy(*keys, "middle", "n", "rank", "part").agg(F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = F.sum("_in").over(Window.partitionBy(*keys, "middle").orderBy("part")) - F.col("_in")
        kept = counts.withColumn("_before", before).where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_in")))
        kept = cut(kept.select(*keys, "middle", "n", (F.col("rank") - F.col("_before")).alias("rank"), "_in", "_low", "_high"), "median-part")
        single = kept.where("_low = _high").select(*keys, "middle", "n", F.col("_low").alias("_v"))
        few = kept.where((F.col("_in") <= most) & (F.col("_low") < F.col("_high")))
        near = rows.join(few, keys).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        chosen = near.groupBy(*keys, "middle", "n", "rank").agg(F.sort_array(F.collect_list("_v")).alias("_all")).select(*keys, "middle", "n", F.get("_all", F.col("rank").cast("int")).alias("_v"))
        found = single.unionByName(chosen) if found is None else found.unionByName(single).unionByName(chosen)
        open_ = cut(kept.where((F.col("_in") > most) & (F.col("_low") < F.col("_high"))).drop("_in"), "median-open")
    halves = found.groupBy(*keys, "n").agg(F.avg("_v").alias("median"))
    return small.unionByName(halves.select(*keys, "median", "n"))
