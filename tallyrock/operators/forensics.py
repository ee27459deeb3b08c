"""Forensic tests of a case: evidence beside the score, which they never move.

Each test gives rows (case_id, finding, severity, metric, txn_ids, caveat); ``gates`` says which tests
of a case could not run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrock.operators.features import round3
from tallyrock.operators.matching import greedy_match
from tallyrock.operators.medians import exact_median
from tallyrock.operators.netting import money
from tallyrock.sources.shared import cut


def severity(critical: Column, high: Column) -> Column:
    return F.when(critical, "critical").when(high, "high").otherwise("medium")


#: What a finding of each test cannot show.
CAVEATS = {
    "TECH-NET-01": "Masked references name no legal person; several of them may be one party.",
    "TECH-XB-01": "Spellings may be joined wrongly or missed; masked references match by their visible part only.",
    "TECH-XB-02": "Only months in which both banks have rows are compared; months do not show which bank moved first.",
    "TECH-XB-03": "Channels rest on how rows were read, and a household that lives on cash can look alike.",
    "TECH-XB-04": "Dates do not show which leg of one day came first; echoes are no proof of a route.",
}
GAPS = "Statements have gaps of more than two months; only active months are compared."
POOR = 0.85


def finding(df: DataFrame, name: str, critical: Column, high: Column, metric: Column, ids: Column | str) -> DataFrame:
    """Rows of a test; ``caveat`` is null where there is none."""
    note = F.when(F.col("gaps"), GAPS) if "gaps" in df.columns else F.lit(CAVEATS.get(name)).cast("string")
    return df.select("case_id", F.lit(name).alias("finding"), severity(critical, high).alias("severity"), round3(metric.cast("double")).alias("metric"), (F.col(ids) if isinstance(ids, str) else ids).alias("txn_ids"), note.alias("caveat"))


def largest_ids(rows: DataFrame, most: int) -> DataFrame:
    """(case_id, ids): the ids of a case's ``most`` largest rows. Ranked first, so no case's rows are all collected."""
    w = Window.partitionBy("case_id").orderBy(F.desc("amount_kwd"), "id")
    top = rows.select("case_id", "id", "amount_kwd").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return top.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("ids"))


def matched_ids(matches: DataFrame, most: int) -> DataFrame:
    """(case_id, n, v, ids): matches, their smaller sides' sum, and both ids of the first ``most`` by date."""
    w = Window.partitionBy("case_id").orderBy("l_date", "left")
    ranked = matches.withColumn("r", F.row_number().over(w)).withColumn("pair", F.when(F.col("r") <= most, F.struct("r", "left", "right")))
    pairs = F.array_sort(F.collect_list("pair"))
    return ranked.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), money(F.least("l_amount", "r_amount")).alias("v"), F.flatten(F.transform(pairs, lambda s: F.array(s["left"], s["right"]))).alias("ids"))


def amount_outliers(ext: DataFrame) -> DataFrame:
    """Modified z-score of 4 or more among at least six rows of a bank and direction, 500 or more; the twelve strongest."""
    key = ["case_id", "bank", "direction"]
    mid = exact_median(ext, key, "amount_kwd", least=6).withColumnRenamed("median", "mid")
    rows = ext.join(mid, key).withColumn("off", F.abs(F.col("amount_kwd") - F.col("mid")))
    mad = exact_median(rows, key, "off").withColumnRenamed("median", "mad").drop("n").where("mad > 0")
    rows = rows.join(mad, key).withColumn("z", 0.6745 * F.col("off") / F.col("mad")).where("z >= 4 and amount_kwd >= 500")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("z"), "id"))).where("r <= 12")
    top = ranked.groupBy("case_id").agg(F.max("z").alias("z"), F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("ids"))
    return finding(top, "TECH-AMT-01", F.col("z") >= 8, F.col("z") >= 6, F.col("z"), "ids")


def middle(values: Column) -> Column:
    """The median of a list of numbers."""
    at = lambda line, k: F.get(line, F.floor(k / 2).cast("int"))
    # the lambda's variable holds the sorted list, which would else be sorted for each use
    found = F.transform(F.array(F.sort_array(F.array_compact(values))), lambda line: at(line, F.size(line) - 1) * 0.5 + at(line, F.size(line)) * 0.5)
    return F.get(found, F.lit(0))


def behaviour_change(ext: DataFrame) -> DataFrame:
    """The split of six or more active months, three on each side, whose medians differ most: threefold and by 2000."""
    months = ext.groupBy("case_id", F.date_format("posting_date", "yyyy-MM").alias("month")).agg(money("amount_kwd").alias("v"))
    w = Window.partitionBy("case_id")
    apart = F.months_between(F.to_date("month", "yyyy-MM"), F.to_date(F.lag("month").over(w.orderBy("month")), "yyyy-MM"))
    months = months.withColumns({"n": F.count(F.lit(1)).over(w), "apart": apart}).where("n >= 6")
    gaps = months.groupBy("case_id").agg(F.coalesce(F.max("apart") > 2, F.lit(False)).alias("gaps"))
    # a case has one row a month, so its months are one list, and no row is written once for every split
    listed = months.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("month", "v"))).alias("m")).select("case_id", F.col("m.month").alias("month"), F.col("m.v").alias("v"), F.size("m").alias("n"))
    split = lambda s: F.struct(s.alias("split"), middle(F.slice("v", F.lit(1), s)).alias("a"), middle(F.slice("v", s + 1, F.col("n") - s)).alias("b"), F.get("month", s).alias("since"))
    sides = listed.select("case_id", F.explode(F.transform(F.sequence(F.lit(3), F.col("n") - 3), split)).alias("s")).select("case_id", "s.*")
    best = sides.where("a > 0 and b > a").withColumn("ratio", F.col("b") / F.col("a")).withColumn("r", F.row_number().over(w.orderBy(F.desc("ratio"), "split"))).where("r = 1 and ratio >= 3 and b - a >= 2000")
    ids = largest_ids(ext.join(best.select("case_id", "since"), "case_id").where(F.date_format("posting_date", "yyyy-MM") >= F.col("since")), 25)
    return finding(best.join(gaps, "case_id").join(ids, "case_id"), "TECH-TMP-01", F.col("ratio") >= 8, F.col("ratio") >= 5, F.col("ratio"), "ids")


def concentration(clustered: DataFrame) -> DataFrame:
    """Concentration of a direction with three parties and 3000 or more; the more concentrated direction. Ids: its largest party's 20 largest."""
    named = clustered.where("cluster is not null")
    best = _concentrated(named.groupBy("case_id", "direction", "cluster").agg(money("amount_kwd").alias("v")))
    return _concentration(best, named.join(best.select("case_id", "direction", "cluster"), ["case_id", "direction", "cluster"], "left_semi"))


def spelled_concentration(txns: DataFrame, parties: DataFrame) -> DataFrame:
    """``concentration`` of rows whose parties are known by spelling (scope, spelling, cluster); rows are summed by spelling before they meet the parties."""
    of = parties.withColumnRenamed("scope", "case_id")
    said = txns.where("counterparty_name is not null").groupBy("case_id", "direction", F.col("counterparty_name").alias("spelling")).agg(F.sum(F.col("amount_kwd").cast("decimal(20,6)")).alias("v"))
    by = said.join(of, ["case_id", "spelling"]).groupBy("case_id", "direction", "cluster").agg(F.sum("v").cast("double").alias("v"))
    best = cut(_concentrated(by), "concentrated")
    # written, so that Spark knows its size and need not shuffle the rows for it
    names = cut(of.join(best.select("case_id", "direction", "cluster"), ["case_id", "cluster"]).select("case_id", "direction", F.col("spelling").alias("counterparty_name")), "concentrated-names")
    return _concentration(best, txns.join(names, ["case_id", "direction", "counterparty_name"], "left_semi"))


def _concentrated(by: DataFrame) -> DataFrame:
    """The more concentrated direction of a case by its parties' sums ``v``, if it is concentrated."""
    by = by.withColumn("total", F.sum("v").over(Window.partitionBy("case_id", "direction"))).withColumn("p", F.col("v") / F.col("total"))
    sides = by.groupBy("case_id", "direction").agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total"), F.sum(F.col("p") * F.col("p")).alias("hhi"), F.max("p").alias("top"), F.max_by("cluster", F.struct("v", "cluster")).alias("cluster")).where("n >= 3 and total >= 3000")
    return sides.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(F.greatest("hhi", "top")), "direction"))).where("r = 1 and (hhi >= 0.35 or top >= 0.5)")


def _concentration(best: DataFrame, rows: DataFrame) -> DataFrame:
    ids = largest_ids(rows, 20)
    return finding(best.join(ids, "case_id"), "TECH-NET-01", (F.col("top") >= 0.75) & (F.col("total") >= 10000), F.col("hhi") >= 0.5, F.col("hhi"), "ids")


def _near(ext: DataFrame, left: Column, right: Column, first_day: int, last_day: int, share: float, cross_bank: bool) -> DataFrame:
    """Edges between rows of like amount, the right one ``first_day`` to ``last_day`` days later; joined by day and amount bucket."""
    amount = F.col("amount_kwd")
    bucket = F.floor(F.log(amount) / F.log(F.lit(1 + 1.1 * share))).cast("long")
    a = ext.where(left).select("case_id", F.col("id").alias("left"), F.col("bank").alias("l_bank"), F.col("posting_date").alias("l_date"), amount.alias("l_amount"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    a = a.withColumn("r_date", F.explode(F.sequence(F.date_add("l_date", first_day), F.date_add("l_date", last_day))))
    b = ext.where(right).select("case_id", F.col("id").alias("right"), F.col("bank").alias("r_bank"), F.col("posting_date").alias("r_date"), amount.alias("r_amount"), bucket.alias("bucket"))
    edges = a.join(b, ["case_id", "bucket", "r_date"]).where(F.abs(F.col("r_amount") - F.col("l_amount")) <= F.col("l_amount") * share)
    return edges.where("l_bank <> r_bank").drop("bucket") if cross_bank else edges.drop("bucket")


def sequences(ext: DataFrame) -> DataFrame:
    """T4: credits of 500 that leave within 1 to 3 days, within 5 %, one to one; two of them and 3000 or more."""
    edges = _near(ext, (F.col("direction") == "credit") & (F.col("amount_kwd") >= 500), (F.col("direction") == "debit") & (F.col("amount_kwd") >= 475), 1, 3, 0.05, False)
    got = greedy_match(edges, "case_id", ["l_date", "left"], ["r_date", "right"])
    df = matched_ids(got, 12).where("n >= 2 and v >= 3000")
    return finding(df, "TECH-SEQ-01", (F.col("n") >= 8) | (F.col("v") >= 30000), (F.col("n") >= 4) | (F.col("v") >= 10000), F.col("n"), "ids")


def funnel(clustered: DataFrame) -> DataFrame:
    """T5: eight named payers or more and 40 % of named outflow to one party. Ids: the 18 largest named credits, then the party's 12 largest."""
    named = clustered.where("cluster is not null")
    credit = F.col("direction") == "credit"
    by = named.groupBy("case_id", "cluster").agg(F.coalesce(money(F.when(~credit, F.col("amount_kwd"))), F.lit(0.0)).alias("out"), F.count_if(credit).alias("pays"))
    df = by.groupBy("case_id").agg(F.count_if(F.col("pays") > 0).alias("fan_in"), F.try_divide(F.max("out"), F.sum("out")).alias("top_share"), F.max_by("cluster", F.struct("out", "cluster")).alias("top"))
    df = df.where("fan_in >= 8 and top_share >= 0.4")
    into = largest_ids(named.where(credit).join(df.select("case_id"), "case_id", "left_semi"), 18).withColumnRenamed("ids", "into")
    out = largest_ids(named.where(~credit).join(df.select("case_id", F.col("top").alias("cluster")), ["case_id", "cluster"], "left_semi"), 12)
    df = df.join(into, "case_id", "left").join(out, "case_id", "left").withColumn("ids", F.slice(F.array_distinct(F.concat("into", "ids")), 1, 30))
    return finding(df, "TECH-NET-02", (F.col("fan_in") >= 30) & (F.col("top_share") >= 0.7), (F.col("fan_in") >= 15) & (F.col("top_share") >= 0.5), F.col("fan_in"), "ids")


#: Days within which money comes back, the variance it may have, and the loops whose four ids are shown.
LOOP_DAYS, LOOP_SHARE, LOOPS_SHOWN = 30, 0.1, 8


def loop_edges(txns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(case_id, left, l_date, right, r_date, amount, ids): pairs and those that later go back, joined by accounts, month and amount bucket."""
    account = F.concat_ws("|", "bank", "account_id")
    at = txns.select("case_id", "id", account.alias("account"))
    df = pairs.select("case_id", "pair_id", "debit_id", "credit_id", "amount_kwd", "debit_date")
    df = df.join(at.select("case_id", F.col("id").alias("debit_id"), F.col("account").alias("src")), ["case_id", "debit_id"]).join(at.select("case_id", F.col("id").alias("credit_id"), F.col("account").alias("dst")), ["case_id", "credit_id"])
    span = F.floor(F.datediff("debit_date", F.lit("1970-01-01").cast("date")) / LOOP_DAYS)
    # amounts within the variance lie in one bucket or in neighbours
    bucket = F.floor(F.log("amount_kwd") / F.log(F.lit(1.001 / (1 - LOOP_SHARE))))
    df = cut(df.where("src <> dst").withColumns({"span": span, "bucket": bucket, "ids": F.array("debit_id", "credit_id")}), "own-moves")
    a = df.select("case_id", "src", "dst", F.col("pair_id").alias("left"), F.col("debit_date").alias("l_date"), F.col("amount_kwd").alias("x"), F.col("ids").alias("l_ids"), F.explode(F.array("span", F.col("span") + 1)).alias("span"), "bucket")
    a = a.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, "bucket", F.col("bucket") + 1)))
    b = df.select("case_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "span", "bucket", F.col("pair_id").alias("right"), F.col("debit_date").alias("r_date"), F.col("amount_kwd").alias("y"), F.col("ids").alias("r_ids"))
    days = F.datediff("r_date", "l_date")
    both = a.join(b, ["case_id", "src", "dst", "span", "bucket"]).where(days.between(1, LOOP_DAYS) & (F.abs(F.col("x") - F.col("y")) / F.greatest("x", "y") <= LOOP_SHARE))
    return both.select("case_id", "left", "l_date", "right", "r_date", F.least("x", "y").alias("amount"), F.concat("l_ids", "r_ids").alias("ids"))


def return_loops(txns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Own transfers that come back to the account they left within 30 days and 10 %, 3000 or more; each transfer in one loop.

    By date each takes the first later one back that is free. Ids: those of the first loops by date.
    """
    got = greedy_match(loop_edges(txns, pairs), "case_id", ["l_date", "left"], ["r_date", "right"], shared=True)
    ranked = got.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy("l_date", "left"))).withColumn("shown", F.when(F.col("r") <= LOOPS_SHOWN, F.struct("r", "ids")))
    ids = F.slice(F.flatten(F.transform(F.array_sort(F.collect_list("shown")), lambda s: s["ids"])), 1, 30)
    found = ranked.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), money("amount").alias("v"), ids.alias("ids"))
    return finding(found.where("v >= 3000"), "TECH-NET-03", (F.col("n") >= 4) | (F.col("v") >= 50000), (F.col("n") >= 2) | (F.col("v") >= 15000), F.col("n"), "ids")


def bridging(clustered: DataFrame) -> DataFrame:
    """Parties with 1000 or more at two banks or more. Ids: the largest party's rows by amount, then the next one's, up to 30."""
    named = clustered.where("cluster is not null")
    by = named.groupBy("case_id", "cluster").agg(F.count_distinct("bank").alias("banks"), money("amount_kwd").alias("v")).where("banks >= 2 and v >= 1000")
    w = Window.partitionBy("case_id").orderBy(F.desc("v"), "cluster", F.desc("amount_kwd"), "id")
    shown = named.select("case_id", "cluster", "id", "amount_kwd").join(by.select("case_id", "cluster", "v"), ["case_id", "cluster"]).withColumn("r", F.row_number().over(w)).where("r <= 30")
    ids = shown.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("ids"))
    df = by.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max("banks").alias("banks"), money("v").alias("v")).join(ids, "case_id")
    return finding(df, "TECH-XB-01", (F.col("banks") >= 3) | (F.col("v") >= 20000), (F.col("n") >= 2) | (F.col("v") >= 8000), F.col("n"), "ids")


def burst_synchronisation(ext: DataFrame) -> DataFrame:
    """Two banks of six months or more whose burst months coincide at least twice and three times as often as by chance."""
    months = ext.groupBy("case_id", "bank", F.date_format("posting_date", "yyyy-MM").alias("month")).agg(money("amount_kwd").alias("v"))
    mid = months.groupBy("case_id", "bank").agg(F.median("v").alias("mid"), F.count(F.lit(1)).alias("n")).where("n >= 6")
    months = months.join(mid, ["case_id", "bank"]).withColumn("burst", (F.col("v") >= 2 * F.col("mid")) & (F.col("v") >= 1000))
    a = months.select("case_id", "month", F.col("bank").alias("a"), F.col("burst").alias("x"))
    b = months.select("case_id", "month", F.col("bank").alias("b"), F.col("burst").alias("y"))
    both = a.join(b, ["case_id", "month"]).where("a < b").groupBy("case_id", "a", "b").agg(F.count(F.lit(1)).alias("joint"), F.count_if("x").alias("na"), F.count_if("y").alias("nb"), F.count_if(F.col("x") & F.col("y")).alias("both"))
    df = both.withColumn("lift", F.try_divide(F.col("both") * F.col("joint"), F.col("na") * F.col("nb"))).where("joint >= 6 and both >= 2 and lift >= 3")
    best = df.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("lift"), "a", "b"))).where("r = 1")
    burst = months.where("burst")
    x, y = burst.select("case_id", "month", F.col("bank").alias("a")), burst.select("case_id", "month", F.col("bank").alias("b"))
    joint = best.select("case_id", "a", "b").join(x, ["case_id", "a"]).join(y, ["case_id", "b", "month"])
    rows = joint.select("case_id", "month", F.explode(F.array("a", "b")).alias("bank"))
    ids = largest_ids(ext.withColumn("month", F.date_format("posting_date", "yyyy-MM")).join(rows, ["case_id", "bank", "month"], "left_semi"), 30)
    return finding(best.join(ids, "case_id"), "TECH-XB-02", (F.col("both") >= 3) & (F.col("lift") >= 8), (F.col("both") >= 3) | (F.col("lift") >= 5), F.col("lift"), "ids")


def bank_roles(ext: DataFrame) -> DataFrame:
    """(case_id, bank, v, role) of banks with three movements and 1000 each way; role is null where 60 % of neither side's value fits one."""
    credit = F.col("direction") == "credit"
    total = lambda when: F.coalesce(money(F.when(when, F.col("amount_kwd"))), F.lit(0.0))
    banks = ext.groupBy("case_id", "bank").agg(
        F.count_if(credit).alias("nc"), F.count_if(~credit).alias("nd"), total(credit).alias("c"), total(~credit).alias("d"), total(credit & (F.col("channel") == "cash_deposit")).alias("ci"),
        total(~credit & (F.col("channel") == "cash_withdrawal")).alias("co"), total(credit & (F.col("channel") == "transfer_in")).alias("ti"), total(~credit & (F.col("channel") == "transfer_out")).alias("to"),
    ).where("nc >= 3 and nd >= 3 and c >= 1000 and d >= 1000")
    role = F.when((F.col("ci") / F.col("c") >= 0.6) & (F.col("to") / F.col("d") >= 0.6), "placement").when((F.col("ti") / F.col("c") >= 0.6) & (F.col("co") / F.col("d") >= 0.6), "extraction")
    return banks.select("case_id", "bank", (F.col("c") + F.col("d")).alias("v"), role.alias("role"))


def role_specialisation(ext: DataFrame) -> DataFrame:
    """Banks that take cash and send transfers, or the reverse, in cases with two banks or more to compare."""
    banks = bank_roles(ext)
    df = banks.groupBy("case_id").agg(F.count(F.lit(1)).alias("profiled"), F.count("role").alias("n"), F.count_distinct("role").alias("roles"), money(F.when(F.col("role").isNotNull(), F.col("v"))).alias("v"))
    df = df.where("profiled >= 2 and n >= 1")
    rows = ext.join(banks.where("role is not null").join(df.select("case_id"), "case_id", "left_semi").select("case_id", "bank", "role"), ["case_id", "bank"])
    fits = F.when(F.col("role") == "placement", F.expr("(direction = 'credit' and channel = 'cash_deposit') or (direction = 'debit' and channel = 'transfer_out')"))
    ids = largest_ids(rows.where(fits.otherwise(F.expr("(direction = 'credit' and channel = 'transfer_in') or (direction = 'debit' and channel = 'cash_withdrawal')"))), 30)
    both = F.col("roles") >= 2
    return finding(df.join(ids, "case_id", "left"), "TECH-XB-03", both & (F.col("v") >= 30000), both | (F.col("v") >= 15000), F.col("n"), "ids")


def amount_echoes(ext: DataFrame) -> DataFrame:
    """Money that leaves one bank and reaches another within 3 days and 2 %, one to one; two of them and 3000 or more."""
    out = (F.col("direction") == "debit") & F.col("channel").isin("cash_withdrawal", "transfer_out", "cheque", "other") & (F.col("amount_kwd") >= 500)
    back = (F.col("direction") == "credit") & F.col("channel").isin("cash_deposit", "transfer_in", "cheque", "other") & (F.col("amount_kwd") >= 500)
    got = greedy_match(_near(ext, out, back, 0, 3, 0.02, True), "case_id", ["l_date", "left"], ["r_date", "right"])
    df = matched_ids(got, 15).where("n >= 2 and v >= 3000")
    return finding(df, "TECH-XB-04", (F.col("n") >= 5) | (F.col("v") >= 30000), (F.col("n") >= 3) | (F.col("v") >= 10000), F.col("n"), "ids")


def gates(clustered: DataFrame, cases: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """(case_id, test, reason): tests without the rows, months, parties or banks they need.

    ``clustered`` holds the external rows with ``cluster``; ``loops`` (case_id) are cases with own transfers that came back.
    """
    ext, named = clustered, clustered.where("cluster is not null")
    group = ["case_id", "bank", "direction"]
    mid = exact_median(ext, group, "amount_kwd", least=6).withColumnRenamed("median", "mid").drop("n")
    spread = exact_median(ext.join(mid, group).withColumn("off", F.abs(F.col("amount_kwd") - F.col("mid"))), group, "off").withColumnRenamed("median", "mad").drop("n")
    peers = spread.where("mad > 0").groupBy("case_id").agg(F.count(F.lit(1)).alias("peers"))
    counted = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    base = ext.groupBy("case_id").agg(
        F.count_distinct(F.date_format("posting_date", "yyyy-MM")).alias("months"), F.count_distinct("bank").alias("banks"),
        counted("direction = 'credit' and amount_kwd >= 500", "credits"), counted("direction = 'debit' and amount_kwd >= 475", "debits"),
        counted("direction = 'debit' and amount_kwd >= 500 and channel in ('cash_withdrawal', 'transfer_out', 'cheque', 'other')", "outs"),
        counted("direction = 'credit' and amount_kwd >= 500 and channel in ('cash_deposit', 'transfer_in', 'cheque', 'other')", "ins"),
    )
    sides = named.groupBy("case_id", "direction").agg(F.count_distinct("cluster").alias("parties"), money("amount_kwd").alias("v")).where("parties >= 3 and v >= 3000")
    sides = sides.groupBy("case_id").agg(F.count(F.lit(1)).alias("sides"))
    known = named.groupBy("case_id").agg(F.count_distinct("bank").alias("named_banks"), counted("direction = 'credit'", "inflow"))
    months = ext.select("case_id", "bank", F.date_format("posting_date", "yyyy-MM").alias("month")).distinct()
    months = months.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("case_id", "bank"))).where("n >= 6")
    long = months.groupBy("case_id").agg(F.count_distinct("bank").alias("profiles"))
    a, b = months.select("case_id", "month", F.col("bank").alias("a")), months.select("case_id", "month", F.col("bank").alias("b"))
    joint = a.join(b, ["case_id", "month"]).where("a < b").groupBy("case_id", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n >= 6").groupBy("case_id").agg(F.count(F.lit(1)).alias("joint"))
    roles = bank_roles(ext).groupBy("case_id").agg(F.count(F.lit(1)).alias("profiled"))
    df = cases.select("case_id")
    back = (loops if loops is not None else df.where("false")).select("case_id").distinct().withColumn("loops", F.lit(1))
    for more in (base, peers, sides, known, long, joint, roles, back):
        df = df.join(more, "case_id", "left")
    df = df.fillna(0)
    when = lambda cond, text: F.when(F.expr(cond), text)
    cross = when("banks < 2", "Fewer than two banks have external activity.")
    tests = {
        "robust_amount_outliers": when("peers = 0", "No bank and direction has six amounts that differ."),
        "behavioral_change_point": when("months < 6", "Fewer than six active months."),
        "counterparty_concentration": when("sides = 0", "No direction has three named parties and 3000."),
        "rapid_pass_through_sequences": when("credits < 2 or debits < 2", "Fewer than two sizeable credits or debits."),
        "network_circulation": when("inflow < 8 and loops = 0", "Too few named credits, and no own transfer came back."),
        "cross_bank_counterparty_bridging": F.coalesce(cross, when("named_banks < 2", "Named parties at fewer than two banks.")),
        "cross_bank_burst_synchronization": F.coalesce(cross, when("profiles < 2", "Fewer than two banks have six active months."), when("joint = 0", "No two banks share six active months.")),
        "cross_bank_role_specialization": F.coalesce(cross, when("profiled < 2", "Fewer than two banks have enough movements each way.")),
        "cross_bank_amount_echoes": F.coalesce(cross, when("outs = 0 or ins = 0", "No sizeable movements to compare.")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("test"), v.alias("reason")) for k, v in tests.items()])
    return df.select("case_id", F.inline(F.filter(rows, lambda r: r["reason"].isNotNull())))


def technical(txns: DataFrame, ext: DataFrame, pairs: DataFrame, clustered: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """All findings; with ``quality`` (case_id, quality) those of a case below ``POOR`` say so in their caveat."""
    every = [amount_outliers(ext), behaviour_change(ext), concentration(clustered), sequences(ext), funnel(clustered), return_loops(txns, pairs), bridging(clustered), burst_synchronisation(ext), role_specialisation(ext), amount_echoes(ext)]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    if quality is None:
        return out
    poor = F.when(F.col("quality") < POOR, F.format_string("Data quality is %d %%; take sizes and sequences as provisional.", F.round(F.col("quality") * 100).cast("int")))
    return out.join(quality.select("case_id", "quality"), "case_id", "left").withColumn("caveat", F.nullif(F.concat_ws(" ", poor, "caveat"), F.lit(""))).drop("quality")
