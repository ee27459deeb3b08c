"""The 25 features of a case, their zones, and the transactions behind them.

``value`` is rounded to three places, zones are judged on the unrounded value, but for those of
bursts and parties where ``shown`` asks for the rounded one. Features whose
support is missing are left out or gated with 0, as each one's definition says.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrock.constants import Thresholds
from tallyrock.functions.narrative import country_risk, identifiable, is_crypto, is_self, is_vague
from tallyrock.operators.identities import party_spellings
from tallyrock.operators.matching import greedy_match
from tallyrock.operators.netting import money
from tallyrock.sources.shared import cut

#: Ids that a rule names as evidence, of one kind.
MOST_IDS = 50


def round3(col: Column) -> Column:
    return F.floor(col * 1000 + 0.5) / 1000


def zone(value: Column, elevated: float, critical: float, reverse: bool = False) -> Column:
    if reverse:
        return F.when(value <= critical, "critical").when(value <= elevated, "elevated").otherwise("normal")
    return F.when(value >= critical, "critical").when(value >= elevated, "elevated").otherwise("normal")


def share(part: Column | str, whole: Column | str) -> Column:
    return F.coalesce(F.try_divide(F.col(part) if isinstance(part, str) else part, F.col(whole) if isinstance(whole, str) else whole), F.lit(0.0))


def one(key: str, value: Column, zoned: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), round3(value).cast("double").alias("value"), zoned.alias("zone"))


def gated(key: str, enough: Column, value: Column, zoned: Column, keep: bool = False) -> Column:
    """The feature, or a gated one that keeps its value or has 0."""
    return one(key, value if keep else F.when(enough, value).otherwise(0.0), F.when(enough, zoned).otherwise("gated"))


SLIM = ("case_id", "id", "posting_date", "direction", "amount_kwd", "channel")


def marked(txns: DataFrame, pairs: DataFrame, kept: tuple[str, ...] | None = None) -> DataFrame:
    """``txns`` with ``leg``, not null for legs of pairs, and what narratives, names and countries say; each distinct narrative is read once, however many rows have it.

    Of the other columns ``kept`` ones stay, if they are given, so that less is shuffled to meet the legs; ``sums_of`` reads ``SLIM``.
    """
    legs = pairs.select("case_id", F.explode(F.array("debit_id", "credit_id")).alias("id"), F.lit(True).alias("leg"))
    text = F.col("narrative")
    told = txns.where(text.isNotNull()).select("narrative").distinct().select("narrative", is_self(text).alias("_own"), is_vague(text).alias("_vague"), is_crypto(text).alias("_crypto"))
    rows = txns.join(cut(told, "narratives"), "narrative", "left")
    rows = rows.withColumns({"_own": F.coalesce("_own", F.lit(False)), "_vague": F.coalesce("_vague", F.lit(True)), "_crypto": F.coalesce("_crypto", F.lit(False)), "_risk": country_risk(F.col("counterparty_country")), "_named": identifiable(F.col("counterparty_name"))})
    if kept:
        rows = rows.select(*kept, "_own", "_vague", "_crypto", "_risk", "_named")
    return rows.join(legs, ["case_id", "id"], "left")


def predicates(limits: Thresholds) -> dict[str, Column]:
    """Kinds of rows that sums count and whose ids are evidence."""
    amount, ext = F.col("amount_kwd"), F.col("leg").isNull()
    cash_in, cash = ext & (F.col("channel") == "cash_deposit"), ext & F.col("channel").isin("cash_deposit", "cash_withdrawal")
    return {
        "near": cash_in & (amount >= limits.near_low) & (amount < limits.cash_limit), "round": cash & (amount >= 100) & (F.abs(amount % 100) < 0.001), "geo": ext & F.col("_risk").isNotNull(),
        "black": ext & (F.col("_risk") == "black"), "vague": ext & F.col("_vague") & (amount >= 1000), "crypto": ext & F.col("_crypto"), "cash": cash_in,
    }


def first_ids(rows: DataFrame, kinds: dict[str, Column], most: int = MOST_IDS) -> DataFrame:
    """(case_id, <kind>_ids): the ``most`` smallest ids of each kind. Ranked before they are collected, so a large case's rows never meet."""
    named = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in kinds.items()]), lambda k: k.isNotNull())
    each = rows.select("case_id", "id", F.explode(named).alias("kind"))
    top = each.withColumn("r", F.row_number().over(Window.partitionBy("case_id", "kind").orderBy("id"))).where(F.col("r") <= most)
    return top.groupBy("case_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("id")))).alias(f"{k}_ids") for k in kinds])


def case_sums(txns: DataFrame, pairs: DataFrame, limits: Thresholds) -> DataFrame:
    """All plain conditional aggregates of a case in one grouping."""
    return sums_of(marked(txns, pairs, SLIM), limits)


def sums_of(df: DataFrame, limits: Thresholds) -> DataFrame:
    """The aggregates of ``marked`` rows."""
    is_ = predicates(limits)
    amount, ext = F.col("amount_kwd"), F.col("leg").isNull()
    credit, debit = ext & (F.col("direction") == "credit"), ext & (F.col("direction") == "debit")
    cash_in = ext & (F.col("channel") == "cash_deposit")
    cash = ext & F.col("channel").isin("cash_deposit", "cash_withdrawal")
    own, vague, risk = F.col("_own"), F.col("_vague"), F.col("_risk")
    unexplained = credit & ~F.col("channel").isin("salary", "interest", "cash_deposit") & ~own & ~F.col("_named")
    # columns of their own, so that they are evaluated once for each row and not in every aggregate
    digit = F.when(ext & (amount >= 1), F.substring(F.format_number(amount, 6), 1, 1).cast("int"))
    df = df.withColumns({"_money": amount.cast("decimal(20,6)"), "_digit": digit})
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("_money"))).cast("double"), F.lit(0.0))
    # months apart, as a distinct count beside the sums would make a row of them for each month
    months = df.select("case_id", (F.year("posting_date") * 12 + F.month("posting_date")).alias("_month")).distinct()
    months = months.groupBy("case_id").agg(F.greatest(F.lit(1), F.count("_month")).alias("active_months"))
    found = df.groupBy("case_id").agg(
        total(F.lit(True)).alias("turnover"), total(credit).alias("credits"), total(debit).alias("debits"), total(cash_in).alias("cash_total"),
        F.count_if(ext).alias("n_ext"), F.count_if(cash_in).alias("n_cash_in"), F.count_if(cash_in & (amount >= 300)).alias("n_countable"), F.count_if(is_["near"]).alias("n_near"),
        F.count_if(cash).alias("n_cash"), F.count_if(is_["round"]).alias("n_round"), F.count_if(ext & (amount >= 1)).alias("n_benford"),
        *[F.count_if(F.col("_digit") == d).alias(f"d{d}") for d in range(1, 10)],
        total(ext & own).alias("own_value"), F.count_if(ext & F.dayofweek("posting_date").isin(6, 7)).alias("n_weekend"),
        total(ext & risk.isNotNull()).alias("geo_value"), F.count_if(is_["black"]).alias("n_black"), total(ext & vague).alias("vague_value"),
        total(unexplained).alias("unexplained_value"), F.count_if(is_["crypto"]).alias("n_crypto"), F.count_if(is_["vague"]).alias("n_vague_high"),
        total(credit & (amount >= 500)).alias("big_credit_value"),
    )
    return found.join(months, "case_id", "left")


def sum_features(sums: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, key, value, zone) of the features that need the sums only."""
    df = sums.join(cases.select("case_id", "income"), "case_id", "left")
    col = F.col
    known = F.coalesce(col("income") > 0, F.lit(False))
    multiple = F.when(known, col("credits") / col("active_months") / col("income"))
    flow, cash, near, rounds = share("debits", "credits"), share("cash_total", "credits"), share("n_near", "n_countable"), share("n_round", "n_cash")
    benford = sum((F.abs(col(f"d{d}") / F.nullif(col("n_benford"), F.lit(0)) - math.log10(1 + 1 / d)) for d in range(1, 10)), F.lit(0.0)) / 9
    circle = share(2 * F.coalesce(col("paired_kwd"), F.lit(0.0)) + col("own_value"), "turnover")
    weekend, geo, vague, unexplained = share("n_weekend", "n_ext"), share("geo_value", "turnover"), share("vague_value", "turnover"), share("unexplained_value", "credits")
    crypto = col("n_crypto").cast("double")
    rows = F.array(
        one("total_turnover_kwd", col("turnover"), F.lit("normal")),
        gated("income_multiple", known, multiple, zone(multiple, 3, 6)),
        gated("cash_share", col("credits") >= 1000, cash, zone(cash, 0.4, 0.7), keep=True),
        gated("near_threshold_density", col("n_countable") >= 5, near, zone(near, 0.2, 0.35), keep=True),
        gated("round_number_share", col("n_cash") >= 10, rounds, zone(rounds, 0.6, 0.8), keep=True),
        gated("benford_mad", col("n_benford") >= 300, benford, zone(benford, 0.012, 0.015)),
        gated("pass_through_ratio", col("credits") >= 2000, flow, F.when(flow.between(0.95, 1.05) & (col("credits") >= 10000), "elevated").otherwise("normal"), keep=True),
        one("internal_circulation_share", circle, zone(circle, 0.25, 0.45)),
        F.when(col("n_ext") >= 50, one("weekend_share", weekend, zone(weekend, 0.45, 0.6))),
        one("high_risk_geo_share", geo, F.when(col("n_black") > 0, "critical").otherwise(zone(geo, 0.02, 0.1))),
        one("narrative_vagueness_share", vague, zone(vague, 0.5, 0.75)),
        one("unexplained_inflow_share", unexplained, zone(unexplained, 0.35, 0.55)),
        one("crypto_exposure_count", crypto, zone(crypto, 2, 6)),
    )
    return df.select("case_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("f")).select("case_id", "f.*")


def cash_peak(ext: DataFrame, cases: DataFrame) -> DataFrame:
    """Largest cash deposited within 30 days and the days between, against monthly income."""
    day = F.datediff("posting_date", F.lit("1970-01-01").cast("date"))
    daily = ext.where("channel = 'cash_deposit'").groupBy("case_id", day.alias("day")).agg(F.sum(F.col("amount_kwd").cast("decimal(20,6)")).alias("cash"))
    rolled = daily.withColumn("rolled", F.sum("cash").over(Window.partitionBy("case_id").orderBy("day").rangeBetween(-30, 0)))
    peak = rolled.groupBy("case_id").agg(F.max("rolled").cast("double").alias("peak"))
    df = cases.where("income > 0").join(peak, "case_id", "left").withColumn("v", F.coalesce("peak", F.lit(0.0)) / F.col("income"))
    return df.select("case_id", one("cash_to_income_peak", F.col("v"), zone(F.col("v"), 2, 4)).alias("f")).select("case_id", "f.*")


def split_days(ext: DataFrame, limits: Thresholds) -> DataFrame:
    """Days whose cash deposits are all under the limit and together reach it; at one bank at least two of them."""
    days = ext.where("channel = 'cash_deposit'").groupBy("case_id", "posting_date").agg(
        F.max("amount_kwd").alias("most"), money("amount_kwd").alias("total"), F.count_distinct("bank").alias("banks"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids")
    )
    days = days.where((F.col("most") < limits.cash_limit) & (F.col("total") >= limits.cash_limit) & ((F.col("banks") >= 2) | (F.col("n") >= 2)))
    return days.withColumn("multibank", F.col("banks") >= 2)


def day_features(cases: DataFrame, days: DataFrame, limits: Thresholds) -> DataFrame:
    found = days.groupBy("case_id").agg(F.count_if("multibank").alias("multi"), F.max(F.when(~F.col("multibank"), F.col("total") / limits.cash_limit)).alias("ratio"))
    df = cases.select("case_id").join(found, "case_id", "left").select("case_id", F.coalesce("multi", F.lit(0)).cast("double").alias("multi"), F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
    rows = F.array(one("same_day_multibank_cash_days", F.col("multi"), zone(F.col("multi"), 2, 5)), one("aggregate_threshold_evasion", F.col("ratio"), zone(F.col("ratio"), 0.8, 1.0)))
    return df.select("case_id", F.explode(rows).alias("f")).select("case_id", "f.*")


def fragmentation(cases: DataFrame, ext: DataFrame) -> DataFrame:
    """Entropy of cash over banks, for its full weight four of them."""
    banks = ext.where("channel = 'cash_deposit'").groupBy("case_id", "bank").agg(money("amount_kwd").alias("v"), F.count(F.lit(1)).alias("n"))
    banks = banks.withColumn("p", F.col("v") / F.sum("v").over(Window.partitionBy("case_id")))
    found = banks.groupBy("case_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("banks"), F.sum(F.when(F.col("v") > 0, -F.col("p") * F.log("p")).otherwise(0.0)).alias("h"))
    df = cases.select("case_id").join(found, "case_id", "left")
    v = F.when(F.col("banks") > 1, F.col("h") / F.log(F.col("banks").cast("double"))).otherwise(0.0) * F.least(F.lit(1.0), (F.col("banks") - 1) / 3)
    return df.select("case_id", gated("bank_fragmentation_index", F.coalesce(F.col("n") >= 5, F.lit(False)), v, zone(v, 0.45, 0.7)).alias("f")).select("case_id", "f.*")


def dwell_matches(ext: DataFrame) -> DataFrame:
    """Credits of 500 or more, by date, each with the earliest free debit within 30 days and 5 %.

    Candidates meet by amount buckets of 5 % and bins of 31 days, own and neighbouring.
    """
    amount = F.col("amount_kwd")
    bucket = F.floor(F.log(amount) / F.log(F.lit(1.0527))).cast("long")
    credits = ext.where((F.col("direction") == "credit") & (amount >= 500)).select("case_id", F.col("id").alias("left"), F.col("posting_date").alias("c_date"), amount.alias("c_amount"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    days = lambda date: F.floor(F.datediff(date, F.lit("1970-01-01").cast("date")) / 31)
    credits = credits.withColumn("bin", F.explode(F.array(days("c_date"), days("c_date") + 1)))
    debits = ext.where((F.col("direction") == "debit") & (amount >= 250)).select("case_id", F.col("id").alias("right"), F.col("posting_date").alias("d_date"), amount.alias("d_amount"), bucket.alias("bucket"), days("posting_date").alias("bin"))
    edges = credits.join(debits, ["case_id", "bucket", "bin"]).withColumn("gap", F.datediff("d_date", "c_date"))
    edges = edges.where(F.col("gap").between(0, 30) & (F.abs(F.col("d_amount") - F.col("c_amount")) <= F.greatest(F.lit(1.0), F.col("c_amount") * 0.05))).drop("bucket", "bin")
    return greedy_match(edges, "case_id", ["c_date", "left"], ["d_date", "right"])


def dwell_features(cases: DataFrame, matches: DataFrame, sums: DataFrame) -> DataFrame:
    found = matches.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.median("gap").alias("mid"), money(F.when(F.col("gap") <= 3, F.col("c_amount"))).alias("quick"))
    df = cases.select("case_id").join(found, "case_id", "left").join(sums.select("case_id", "big_credit_value"), "case_id", "left")
    quick = share(F.coalesce("quick", F.lit(0.0)), "big_credit_value")
    rows = F.array(gated("dwell_median_days", F.coalesce(F.col("n") >= 5, F.lit(False)), F.col("mid"), zone(F.col("mid"), 3, 1.5, reverse=True)), one("quick_out_share", quick, zone(quick, 0.35, 0.6)))
    return df.select("case_id", F.explode(rows).alias("f")).select("case_id", "f.*")


def relay_chains(ext: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with an inflow of like size at the first bank up to 3 days before, and an outflow at the second up to 3 days after; first of each."""
    amount = F.col("amount_kwd")
    legs = pairs.select("case_id", "debit_id", "credit_id", F.col("amount_kwd").alias("moved"), "from_bank", "to_bank", "debit_date", "credit_date")
    inflow = ext.where((F.col("direction") == "credit") & (amount >= 1000)).select("case_id", F.col("bank").alias("from_bank"), F.col("posting_date").alias("day"), F.col("id").alias("feeder"), amount.alias("a"))
    outflow = ext.where("direction = 'debit'").select("case_id", F.col("bank").alias("to_bank"), F.col("posting_date").alias("day"), F.col("id").alias("exit"), amount.alias("a"))
    fed = legs.withColumn("day", F.explode(F.sequence(F.date_sub("debit_date", 3), F.col("debit_date")))).join(inflow, ["case_id", "from_bank", "day"])
    fed = fed.where(F.abs(F.col("a") - F.col("moved")) <= F.greatest(F.lit(5.0), F.col("moved") * 0.1)).groupBy("case_id", "debit_id", "credit_id", "moved", "to_bank", "credit_date").agg(F.min("feeder").alias("feeder"))
    left = fed.withColumn("day", F.explode(F.sequence("credit_date", F.date_add("credit_date", 3)))).join(outflow, ["case_id", "to_bank", "day"])
    left = left.where(F.abs(F.col("a") - F.col("moved")) <= F.greatest(F.lit(5.0), F.col("moved") * 0.15))
    return left.groupBy("case_id", "debit_id", "credit_id", "feeder").agg(F.min("exit").alias("exit"))


def count_feature(cases: DataFrame, found: DataFrame, key: str, elevated: float, critical: float) -> DataFrame:
    df = cases.select("case_id").join(found.groupBy("case_id").agg(F.count(F.lit(1)).cast("double").alias("n")), "case_id", "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    return df.select("case_id", one(key, F.col("n"), zone(F.col("n"), elevated, critical)).alias("f")).select("case_id", "f.*")


def bursts(ext: DataFrame) -> DataFrame:
    """Per case the peak of 30-day windows, every 15 days from the first date, against the others."""
    # both written, so that Spark knows their size and need not shuffle the rows for them
    span = cut(ext.groupBy("case_id").agg(F.min("posting_date").alias("first"), F.datediff(F.max("posting_date"), F.min("posting_date")).alias("span")).where("span >= 180"), "spans")
    windows = span.select("case_id", "first", F.explode(F.sequence(F.lit(0), F.floor((F.col("span") - 30) / 15).cast("int"))).alias("k"))
    at = F.floor(F.datediff("posting_date", "first") / 15).cast("int")
    # a window is two steps of 15 days, which are summed first
    steps = ext.join(span, "case_id").groupBy("case_id", at.alias("at")).agg(F.sum(F.col("amount_kwd").cast("decimal(20,6)")).alias("v"))
    totals = steps.select("case_id", F.explode(F.array(F.col("at") - 1, F.col("at"))).alias("k"), "v").groupBy("case_id", "k").agg(F.sum("v").cast("double").alias("v"))
    joined = windows.join(totals, ["case_id", "k"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    ranked = joined.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("v"), "k")))
    found = ranked.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("r") == 1, F.col("v"))).alias("peak"), F.avg(F.when(F.col("r") > 1, F.col("v"))).alias("mean"),
        F.stddev_pop(F.when(F.col("r") > 1, F.col("v"))).alias("sd"), F.min_by("k", "r").alias("k"), F.first("first").alias("first"),
    )
    found = cut(found, "peaks")
    top = ext.join(found.select("case_id", "k", "first"), "case_id").where((at - F.col("k")).isin(0, 1)).withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy("posting_date", "id"))).where("r <= 60")
    ids = top.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("ids"))
    return found.drop("first").join(ids, "case_id", "left").where("n >= 6").withColumn("z", (F.col("peak") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))


def burst_feature(cases: DataFrame, found: DataFrame, shown: bool = False) -> DataFrame:
    df = cases.select("case_id").join(found, "case_id", "left")
    z = round3(F.col("z")) if shown else F.col("z")
    return df.select("case_id", gated("velocity_burst_z", F.col("z").isNotNull(), z, zone(z, 2.5, 3.5)).alias("f")).select("case_id", "f.*")


def dormancy(txns: DataFrame) -> DataFrame:
    """Per case the first account, in ledger order, that moved much after 180 silent days."""
    account = Window.partitionBy("case_id", "bank", "account_id")
    order = account.orderBy("posting_date", "id")
    value = F.col("amount_kwd").cast("decimal(20,6)")
    df = txns.select("case_id", "bank", "account_id", "id", "posting_date", value.alias("v"), F.datediff("posting_date", F.lit("1970-01-01").cast("date")).alias("day"))
    df = df.withColumns(
        {
            "size": F.count(F.lit(1)).over(account), "first_id": F.min("id").over(account), "first_day": F.min("day").over(account), "last_day": F.lag("day").over(order),
            "before": F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, -1)), "after": F.sum("v").over(account.orderBy("day").rangeBetween(0, 29)),
        }
    )
    monthly = F.col("before").cast("double") / (F.greatest(F.lit(30), F.col("last_day") - F.col("first_day")) / 30.44)
    woken = df.where((F.col("size") >= 5) & (F.col("day") - F.col("last_day") >= 180) & (F.col("after") >= 2000) & (F.col("after").cast("double") > 3 * F.greatest(F.lit(1.0), monthly)))
    ranked = woken.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy("first_id", "posting_date", "id")))
    first = cut(ranked.where("r = 1").select("case_id", "bank", "account_id", (F.col("day") - F.col("last_day")).alias("gap_days"), F.col("after").cast("double").alias("value"), F.col("day").alias("woken")), "woken")
    # the waking account's rows of the next 30 days, 40 of them
    rows = txns.join(first.select("case_id", "bank", "account_id", "woken"), ["case_id", "bank", "account_id"]).withColumn("day", F.datediff("posting_date", F.lit("1970-01-01").cast("date"))).where("day between woken and woken + 29")
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy("day", "id"))).where("r <= 40")
    ids = top.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("ids"))
    return first.drop("woken").join(ids, "case_id", "left")


def flag_feature(cases: DataFrame, found: DataFrame, key: str) -> DataFrame:
    df = cases.select("case_id").join(found.select("case_id", F.lit(1.0).alias("v")), "case_id", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return df.select("case_id", one(key, F.col("v"), F.when(F.col("v") > 0, "elevated").otherwise("normal")).alias("f")).select("case_id", "f.*")


def month_break(ext: DataFrame) -> DataFrame:
    """Peak month against the median month, of four months or more."""
    months = ext.groupBy("case_id", F.date_format("posting_date", "yyyy-MM").alias("month")).agg(money("amount_kwd").alias("v"))
    found = months.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("peak"), F.median("v").alias("mid")).where("n >= 4")
    v = F.when(F.col("mid") > 0, F.col("peak") / F.col("mid")).otherwise(0.0)
    return found.select("case_id", one("structural_break_factor", v, zone(v, 4, 8)).alias("f")).select("case_id", "f.*")


def party_sums(clustered: DataFrame) -> DataFrame:
    """Per case: parties, their concentration, distinct payers, and the largest payee's share of named outflow."""
    named = clustered.where("cluster is not null")
    credit, debit = F.col("direction") == "credit", F.col("direction") == "debit"
    by = named.groupBy("case_id", "cluster").agg(money("amount_kwd").alias("v"), F.coalesce(money(F.when(debit, F.col("amount_kwd"))), F.lit(0.0)).alias("out"), F.count_if(credit & ~is_self(F.col("narrative"))).alias("pays"))
    return _party_sums(by)


def spelled_sums(txns: DataFrame, parties: DataFrame, own: Column | None = None) -> DataFrame:
    """``party_sums`` of rows whose parties are known by spelling (scope, spelling, cluster); rows are summed by spelling before they meet the parties."""
    credit, debit, value = F.col("direction") == "credit", F.col("direction") == "debit", F.col("amount_kwd").cast("decimal(20,6)")
    named = txns.where("counterparty_name is not null").groupBy("case_id", F.col("counterparty_name").alias("spelling"))
    said = named.agg(F.sum(value).alias("v"), F.sum(F.when(debit, value)).alias("out"), F.count_if(credit & ~(is_self(F.col("narrative")) if own is None else own)).alias("pays"))
    by = said.join(parties.withColumnRenamed("scope", "case_id"), ["case_id", "spelling"]).groupBy("case_id", "cluster")
    return _party_sums(by.agg(F.sum("v").cast("double").alias("v"), F.coalesce(F.sum("out").cast("double"), F.lit(0.0)).alias("out"), F.sum("pays").alias("pays")))


def _party_sums(by: DataFrame) -> DataFrame:
    by = by.withColumn("p", F.try_divide(F.col("v"), F.sum("v").over(Window.partitionBy("case_id"))))
    return by.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("parties"), F.sum(F.col("p") * F.col("p")).alias("hhi"), F.count_if(F.col("pays") > 0).alias("fan_in"),
        F.try_divide(F.max("out"), F.sum("out")).alias("top_share"), F.max_by(F.when(F.col("out") > 0, F.col("cluster")), F.struct("out", "cluster")).alias("top_party"),
    )


def party_features(cases: DataFrame, parties: DataFrame, shown: bool = False) -> DataFrame:
    df = cases.select("case_id").join(parties, "case_id", "left")
    fan = F.coalesce("fan_in", F.lit(0)).cast("double")
    hhi = F.coalesce(round3(F.col("hhi")) if shown else "hhi", F.lit(0.0))
    rows = F.array(gated("counterparty_concentration_hhi", F.coalesce(F.col("parties") >= 3, F.lit(False)), hhi, zone(hhi, 0.4, 0.65)), one("fan_in_count", fan, zone(fan, 15, 40)))
    return df.select("case_id", F.explode(rows).alias("f")).select("case_id", "f.*")


def features(txns: DataFrame, pairs: DataFrame, cases: DataFrame, limits: Thresholds = Thresholds(), clustered: DataFrame | None = None, shown: bool = False) -> tuple[DataFrame, DataFrame]:
    """(case_id, key, value, zone), and one row per case of evidence for the rules.

    What several features need is written once: the external rows, the sums, and the parties of
    spellings, unless ``clustered`` rows are given. With ``shown``, bursts and parties are judged by their values of three
    places, as SQL over the results of their own queries does.
    """
    rows = cut(marked(txns, pairs, (*SLIM, "bank", "account_id", "counterparty_name")), "marked")
    ext = rows.where("leg is null").drop("leg")
    paired = pairs.groupBy("case_id").agg(money("amount_kwd").alias("paired_kwd"))
    sums = cut(sums_of(rows, limits).join(paired, "case_id", "left"), "sums")
    if clustered is None:
        spelled = party_spellings(ext)
        payers = ext.where("direction = 'credit' and not _own").join(cut(spelled.select(F.col("spelling").alias("counterparty_name")).distinct(), "usable"), "counterparty_name", "left_semi")
    else:
        payers = clustered.where(~is_self(F.col("narrative"))).where("direction = 'credit' and cluster is not null")
    days, matches, chains = cut(split_days(ext, limits), "days"), cut(dwell_matches(ext), "dwell"), cut(relay_chains(ext, pairs), "chains")
    burst, woken, parties = cut(bursts(ext), "bursts"), cut(dormancy(txns), "dormancy"), cut(party_sums(clustered) if clustered is not None else spelled_sums(ext, spelled, F.col("_own")), "parties")
    every = [
        sum_features(sums, cases), cash_peak(ext, cases), day_features(cases, days, limits), fragmentation(cases, ext), dwell_features(cases, matches, sums),
        count_feature(cases, chains, "relay_chain_count", 2, 4), burst_feature(cases, burst, shown), flag_feature(cases, woken, "dormancy_reactivation"), month_break(ext), party_features(cases, parties, shown),
    ]
    out = every[0]
    for part in every[1:]:
        out = out.unionByName(part)
    flat = lambda ids: F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(ids)), lambda s: s["ids"]))), 1, MOST_IDS)
    ranked = lambda df, order: df.withColumn("_r", F.row_number().over(Window.partitionBy("case_id").orderBy(*order)))
    some = F.col("_r") <= MOST_IDS
    of = lambda df, order, count, name, ids: ranked(df, order).groupBy("case_id").agg(F.count(F.lit(1)).alias(count), flat(F.when(some, F.struct("_r", ids.alias("ids")))).alias(name))
    multi = of(days.where("multibank"), ["posting_date"], "multi_days", "multi_ids", F.col("ids"))
    split = of(days.where("not multibank"), ["posting_date"], "split_days", "split_ids", F.col("ids"))
    quick = of(matches.where("gap <= 3"), ["c_date", "left"], "n_quick", "quick_ids", F.array("left", "right"))
    relay = of(chains, ["debit_id"], "n_relay", "relay_ids", F.array("feeder", "debit_id", "credit_id", "exit"))
    fan = first_ids(payers, {"fan": F.lit(True)})
    evidence = sums.select("case_id", "credits", "n_near", "n_cash_in", "n_round", "n_black", "n_vague_high", "n_crypto")
    for more in (first_ids(rows, predicates(limits)), multi, split, quick, relay, fan, parties.select("case_id", (round3(F.col("top_share")) if shown else F.col("top_share")).alias("top_share")), burst.select("case_id", F.col("ids").alias("burst_ids")), woken.select("case_id", F.col("ids").alias("dormancy_ids"))):
        evidence = evidence.join(more, "case_id", "left")
    return cut(out, "features"), cut(evidence, "evidence")
