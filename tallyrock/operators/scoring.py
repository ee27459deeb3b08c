"""Rules over features, and their aggregation to a probability by log-odds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrock.constants import COVERED_BY, FEATURE_KEYS, RULES, Thresholds
from tallyrock.operators.features import round3

KEYS = (
    "income_multiple", "cash_share", "cash_to_income_peak", "near_threshold_density", "aggregate_threshold_evasion", "bank_fragmentation_index", "round_number_share", "benford_mad",
    "pass_through_ratio", "quick_out_share", "internal_circulation_share", "velocity_burst_z", "dormancy_reactivation", "high_risk_geo_share", "narrative_vagueness_share", "fan_in_count",
)
MOST_IDS = 50


def evaluate_rules(features: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, rule_id, fired, weight, txn_ids): every rule of every case, fired or not."""
    wide = features.groupBy("case_id").pivot("key", list(KEYS)).agg(F.first("value").alias("v"), F.first("zone").alias("z"))
    df = evidence.join(wide, "case_id", "left")
    val = lambda k: F.coalesce(F.col(f"{k}_v"), F.lit(0.0))
    zone = lambda k: F.coalesce(F.col(f"{k}_z"), F.lit("gated"))
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    ids = lambda c: F.coalesce(F.slice(c, 1, MOST_IDS), F.array().cast("array<bigint>"))
    open_ = lambda k: zone(k) != "gated"
    flow, black = val("pass_through_ratio"), num("n_black") > 0
    table: dict[str, tuple[Column, Column | None, Column]] = {
        "R-STRUCT-01": (open_("near_threshold_density") & (num("n_near") >= 4) & (val("near_threshold_density") >= 0.2), F.when(val("near_threshold_density") >= 0.35, 1.4), ids("near_ids")),
        "R-STRUCT-02": (num("multi_days") >= 2, None, ids("multi_ids")),
        "R-STRUCT-03": ((num("split_days") >= 1) & (val("aggregate_threshold_evasion") >= 1), F.when(num("split_days") < 3, 0.45), ids("split_ids")),
        "R-SMURF-01": (open_("bank_fragmentation_index") & (val("bank_fragmentation_index") >= 0.45) & (num("n_cash_in") >= 8), None, ids("cash_ids")),
        "R-LAYER-01": ((zone("pass_through_ratio") == "elevated") | (flow.between(0.95, 1.05) & (F.col("credits") >= 10000)), None, F.array().cast("array<bigint>")),
        "R-LAYER-02": ((val("quick_out_share") >= 0.35) & (num("n_quick") >= 3), F.when(val("quick_out_share") >= 0.6, 1.2), ids("quick_ids")),
        "R-LAYER-03": (num("n_relay") >= 2, None, ids("relay_ids")),
        "R-CIRC-01": (val("internal_circulation_share") >= 0.25, None, F.array().cast("array<bigint>")),
        "R-CASH-01": (open_("income_multiple") & ((val("cash_to_income_peak") >= 2) | ((val("income_multiple") >= 3) & (val("cash_share") >= 0.4))), F.when(val("cash_to_income_peak") >= 4, 1.5), ids("cash_ids")),
        "R-CASH-02": (open_("round_number_share") & (val("round_number_share") >= 0.6) & (num("n_round") >= 10), None, ids("round_ids")),
        "R-GEO-01": (black | (val("high_risk_geo_share") >= 0.02), F.when(black, 1.3), ids("geo_ids")),
        "R-VEL-01": (open_("velocity_burst_z") & (val("velocity_burst_z") >= 2.5), F.when(val("velocity_burst_z") >= 3.5, 0.9), ids("burst_ids")),
        "R-DORM-01": (val("dormancy_reactivation") >= 1, None, ids("dormancy_ids")),
        "R-NARR-01": ((val("narrative_vagueness_share") >= 0.5) & (num("n_vague_high") >= 5), None, ids("vague_ids")),
        "R-FUNNEL-01": ((val("fan_in_count") >= 12) & (flow >= 0.8) & (F.col("top_share").isNull() | (F.col("top_share") >= 0.5)), None, ids("fan_ids")),
        "R-VA-01": (num("n_crypto") >= 2, None, ids("crypto_ids")),
        "R-BENF-01": (open_("benford_mad") & (val("benford_mad") >= 0.015), None, F.array().cast("array<bigint>")),
    }
    rows = []
    for n, rule in enumerate(RULES):
        fired, other, txns = table[rule.rule_id]
        weight = F.coalesce(F.when(fired, other), F.lit(rule.weight)) if other is not None else F.lit(rule.weight)
        rows.append(F.struct(F.lit(n).alias("n"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.family).alias("family"), F.lit(rule.floor).alias("floor"), fired.alias("fired"), weight.alias("weight"), F.when(fired, txns).otherwise(F.array().cast("array<bigint>")).alias("txn_ids")))
    return df.select("case_id", F.inline(F.array(*rows)))


def rule_evidence(hits: DataFrame) -> DataFrame:
    """Fired rules with what each adds: the strongest of a family in full, the others by half."""
    w = Window.partitionBy("case_id", "family").orderBy(F.desc("weight"), "n")
    return hits.where("fired").withColumn("added", F.when(F.row_number().over(w) == 1, F.col("weight")).otherwise(F.col("weight") * 0.5))


def residual_evidence(features: DataFrame, hits: DataFrame) -> DataFrame:
    """Hot features that no fired rule covers: at most three critical ones, then elevated ones in what room is left, each in the features' order."""
    cover = F.element_at(F.create_map(*[F.lit(x) for kv in COVERED_BY.items() for x in kv]), F.col("key"))
    hot = features.where(F.col("zone").isin("elevated", "critical")).withColumn("rule_id", F.coalesce(cover, F.lit("")))
    left = hot.join(hits.where("fired").select("case_id", "rule_id"), ["case_id", "rule_id"], "left_anti")
    order = Window.partitionBy("case_id", "zone").orderBy(F.array_position(F.array(*[F.lit(k) for k in FEATURE_KEYS]), F.col("key")), "key")
    left = left.withColumns({"r": F.row_number().over(order), "critical": F.count_if(F.col("zone") == "critical").over(Window.partitionBy("case_id"))})
    room = F.when(F.col("zone") == "critical", 3).otherwise(6 - 2 * F.least(F.col("critical"), F.lit(3)))
    return left.where(F.col("r") <= room).select("case_id", "key", "zone", F.when(F.col("zone") == "critical", 0.3).otherwise(0.15).alias("added"))


def band(p: Column) -> Column:
    return F.when(p < 0.05, "Low").when(p < 0.2, "Moderate").when(p < 0.5, "Elevated").when(p < 0.8, "High").otherwise("Critical")


def posterior(cases: DataFrame, features: DataFrame, hits: DataFrame, quality: DataFrame | None = None, limits: Thresholds = Thresholds()) -> DataFrame:
    """(case_id, probability, log_odds, band, evidence, shrink, n_fired); quality is 1 where none is given."""
    rules = rule_evidence(hits).groupBy("case_id").agg(F.sum(F.col("added").cast("decimal(20,6)")).cast("double").alias("rules"), F.max("floor").alias("floor"), F.count(F.lit(1)).alias("n_fired"))
    rest = residual_evidence(features, hits).groupBy("case_id").agg(F.sum(F.col("added").cast("decimal(20,6)")).cast("double").alias("rest"))
    df = cases.select("case_id").join(rules, "case_id", "left").join(rest, "case_id", "left").fillna({"rules": 0.0, "floor": 0.0, "n_fired": 0, "rest": 0.0})
    df = df.join(quality.select("case_id", "quality"), "case_id", "left").fillna({"quality": 1.0}) if quality is not None else df.withColumn("quality", F.lit(1.0))
    q = F.col("quality")
    df = df.withColumns({"evidence": F.col("rest") + F.col("rules"), "shrink": F.when(q >= 0.9, 1.0).otherwise(F.greatest(F.lit(0.55), q / 0.9)), "least": F.when(q < 0.7, F.col("floor") * 0.75).otherwise(F.col("floor"))})
    df = df.withColumn("odds", F.lit(math.log(limits.prior / (1 - limits.prior))) + F.col("evidence") * F.col("shrink"))
    df = df.withColumn("p", 1 / (1 + F.exp(-F.col("odds"))))
    raised = F.col("p") < F.col("least")
    df = df.withColumns({"odds": F.when(raised, F.log(F.col("least") / (1 - F.col("least")))).otherwise(F.col("odds")), "p": F.least(F.lit(limits.probability_cap), F.when(raised, F.col("least")).otherwise(F.col("p")))})
    return df.select("case_id", (F.floor(F.col("p") * 10000 + 0.5) / 10000).alias("probability"), round3(F.col("odds")).alias("log_odds"), band(F.col("p")).alias("band"), "evidence", "shrink", "n_fired")


def drivers(scores: DataFrame, features: DataFrame, hits: DataFrame, limits: Thresholds = Thresholds(), most: int = 16) -> DataFrame:
    """(case_id, drivers): the prior, rules, residual features and the loss by poor data, by size."""
    base = scores.select("case_id", "shrink", "evidence")
    parts = base.select("case_id", F.lit("prior").alias("source"), F.lit("prior").alias("label"), F.lit(math.log(limits.prior / (1 - limits.prior))).alias("c"), F.array().cast("array<bigint>").alias("txn_ids"))
    rules = rule_evidence(hits).join(base, "case_id").select("case_id", F.lit("rule").alias("source"), F.col("rule_id").alias("label"), (F.col("added") * F.col("shrink")).alias("c"), F.slice("txn_ids", 1, 25).alias("txn_ids"))
    rest = residual_evidence(features, hits).join(base, "case_id").select("case_id", F.lit("feature").alias("source"), F.col("key").alias("label"), (F.col("added") * F.col("shrink")).alias("c"), F.array().cast("array<bigint>").alias("txn_ids"))
    lost = base.where("shrink < 1 and evidence > 0").select("case_id", F.lit("data_quality").alias("source"), F.lit("data_quality").alias("label"), (F.col("evidence") * F.col("shrink") - F.col("evidence")).alias("c"), F.array().cast("array<bigint>").alias("txn_ids"))
    every = parts.unionByName(rules).unionByName(rest).unionByName(lost).withColumn("c", round3(F.col("c")))
    ranked = every.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(F.abs("c")), "source", "label"))).where(F.col("r") <= most)
    return ranked.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("r", "source", "label", F.col("c").alias("contribution"), "txn_ids"))).alias("drivers"))
