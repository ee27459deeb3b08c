"""Quality of statement files and of a case's ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrock.sources.shared import cut

ACCOUNT = ["case_id", "bank", "account_id"]
MOST_ITEMS, MOST_IDS = 8, 12
QUALITY_GATE = 0.7


def reconcile_balances(rows: DataFrame) -> DataFrame:
    """(file_id, account_id, checked, breaks): steps where balance and amount disagree by more than 0.01, in the better of both row orders.

    ``rows`` has file_id, account_id, row_index, direction, amount, running_balance.
    """
    known = rows.where(F.col("running_balance").isNotNull())
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    w = Window.partitionBy("file_id", "account_id")
    down, up = F.lag("running_balance").over(w.orderBy("row_index")), F.lag("running_balance").over(w.orderBy(F.desc("row_index")))
    off = lambda before: F.coalesce(F.abs(before + signed - F.col("running_balance")) > 0.01, F.lit(False)).cast("int")
    marked = known.select("file_id", "account_id", off(down).alias("a"), off(up).alias("b"))
    found = marked.groupBy("file_id", "account_id").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return found.where("n >= 2").select("file_id", "account_id", (F.col("n") - 1).alias("checked"), F.least("a", "b").alias("breaks"))


def three_places(col: Column) -> Column:
    return F.format_string("%.3f", col)


def file_duplicates(rows: DataFrame) -> DataFrame:
    """(file_id, duplicates): rows beyond the first of equal date, direction, amount and narrative."""
    key = ["file_id", "posting_date", "direction", three_places(F.col("amount_kwd")).alias("a"), F.coalesce("narrative", F.lit("")).alias("t")]
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("file_id").agg((F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


def file_quality(counts: DataFrame, balances: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(file_id, quality) from rows parsed and skipped, the share of balance steps that hold, and duplicates."""
    held = balances.groupBy("file_id").agg((1 - F.sum("breaks") / F.sum("checked")).alias("balance"))
    df = counts.join(held, "file_id", "left").join(duplicates, "file_id", "left")
    rate = F.coalesce(F.try_divide("rows_parsed", F.col("rows_parsed") + F.col("rows_skipped")), F.lit(0.0))
    penalty = F.least(F.lit(1.0), F.coalesce("duplicates", F.lit(0)) / F.greatest(F.lit(1.0), 0.05 * F.col("rows_parsed")))
    quality = 0.55 * rate + 0.3 * F.coalesce("balance", F.lit(0.85)) + 0.15 * (1 - penalty)
    return df.select("file_id", F.greatest(F.lit(0.05), F.least(F.lit(1.0), quality)).alias("quality"))


def file_issues(counts: DataFrame, balances: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(file_id, issues array<string>): what a reader of the file should know; ``balance_integrity`` reads them."""
    steps = balances.groupBy("file_id").agg(F.sum("checked").alias("checked"), F.sum("breaks").alias("breaks"))
    df = counts.join(steps, "file_id", "left").join(duplicates, "file_id", "left").fillna(0, ["checked", "breaks", "duplicates"])
    total = F.col("rows_parsed") + F.col("rows_skipped")
    many = lambda n: F.when(F.col(n) == 1, "").otherwise("s")
    broken = F.format_string("%d balance reconciliation break%s across %d checked rows", "breaks", many("breaks"), "checked")
    issues = F.array(
        F.when(F.col("checked") == 0, "No running-balance column: completeness cannot be verified.").when(F.col("breaks") > 0, broken),
        F.when(F.col("duplicates") > 0, F.format_string("%d potential duplicate row%s", "duplicates", many("duplicates"))),
        F.when((F.col("rows_skipped") > 0) & (F.col("rows_parsed") < 0.98 * total), F.format_string("%d of %d rows could not be converted", "rows_skipped", total)),
    )
    return df.select("file_id", F.filter(issues, lambda x: x.isNotNull()).alias("issues"))


def case_quality(files: DataFrame) -> DataFrame:
    """(case_id, quality, issue): mean of the files' quality by their rows, and what to say of one below the gate."""
    weight = F.greatest(F.lit(1), F.col("rows_parsed"))
    # a sum of doubles would depend on the order of the files
    total = F.sum((F.col("quality") * weight).cast("decimal(30,12)")).cast("double")
    found = files.groupBy("case_id").agg((total / F.sum(weight)).alias("quality"))
    said = F.format_string("Consolidated data quality %.2f is below the 0.70 gate", "quality")
    return found.withColumn("issue", F.when(F.col("quality") < QUALITY_GATE, said))


def status(value: Column, ok: float, warn: float) -> Column:
    return F.when(value >= ok, "pass").when(value >= warn, "warn").otherwise("fail")


def parse_coverage(files: DataFrame) -> DataFrame:
    df = files.groupBy("case_id").agg(F.sum("rows_parsed").alias("p"), F.sum("rows_skipped").alias("s"))
    share = F.coalesce(F.try_divide("p", F.col("p") + F.col("s")), F.lit(1.0))
    return df.select("case_id", F.lit("parse_coverage").alias("check"), status(share, 0.98, 0.9).alias("status"), share.alias("metric"))


def balance_integrity(files: DataFrame) -> DataFrame:
    """Worst of the issues that speak of balances; breaks in a file of quality below 0.7 fail."""
    issue = F.lower(F.coalesce("issue", F.lit("")))
    rank = F.when(~issue.contains("balance"), 0).when(issue.contains("break") & (F.col("quality") < 0.7), 2).otherwise(1)
    df = files.select("case_id", "quality", F.explode_outer("issues").alias("issue")).groupBy("case_id").agg(F.max(rank).alias("r"))
    return df.select("case_id", F.lit("balance_integrity").alias("check"), F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.col("r") + 1).alias("status"), F.col("r").cast("double").alias("metric"))


def statement_overlap(files: DataFrame) -> DataFrame:
    """(case_id, account_id, file_a, file_b, days): files of one account whose periods overlap by more than a day.

    In the order of their starts, a file that begins when all before it have ended opens a new
    run; only files of a run are compared.
    """
    one = files.select("case_id", "file_id", F.explode("accounts").alias("account_id"), "period_start", "period_end").where("period_start is not null and period_end is not null")
    order = Window.partitionBy("case_id", "account_id").orderBy("period_start", "file_id")
    ended = F.max("period_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.datediff(ended, "period_start") <= 1, F.lit(True)).cast("int")
    runs = one.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order))
    key = ["case_id", "account_id", "_run"]
    side = lambda n: runs.select(*key, F.col("file_id").alias(f"file_{n}"), F.col("period_start").alias(f"start_{n}"), F.col("period_end").alias(f"end_{n}"))
    both = side("a").join(side("b"), key).where("file_a < file_b")
    days = F.datediff(F.least("end_a", "end_b"), F.greatest("start_a", "start_b"))
    return both.select("case_id", "account_id", "file_a", "file_b", days.alias("days")).where("days > 1")


def _marked(txns: DataFrame) -> DataFrame:
    """``txns`` with ``_mark``, the text or balance that is signed; rows without, too weak to be called equal, are left out."""
    text = F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce("narrative", F.lit(""))), r"[\s\x{A0}]+", " ")), 1, 80)
    balance = three_places(F.col("running_balance")) if "running_balance" in txns.columns else F.lit(None).cast("string")
    mark = F.when(F.length(text) >= 6, text).otherwise(balance)
    return txns.withColumn("_mark", mark).where("_mark is not null")


def _said() -> Column:
    """What is signed of ``_marked`` rows."""
    return F.concat_ws("|", "account_id", F.col("posting_date").cast("string"), "direction", three_places(F.col("amount_kwd")), "_mark")


def signed(txns: DataFrame) -> DataFrame:
    """``txns`` with ``signature``; rows that are too weak to be called equal are left out."""
    return _marked(txns).withColumn("signature", F.sha2(_said(), 256)).drop("_mark")


def cross_file_duplicates(txns: DataFrame) -> DataFrame:
    """(case_id, signature, n, files): equal rows that several files report."""
    found = signed(txns).groupBy("case_id", "signature").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("files"))
    return found.where("n > 1 and files > 1")


def coverage_gaps(txns: DataFrame) -> DataFrame:
    """(case, bank, account, gap_start, gap_end, days): more than 45 silent days within an account active for 60 or more."""
    days = txns.select(*ACCOUNT, "posting_date").distinct()
    w = Window.partitionBy(*ACCOUNT)
    span = F.datediff(F.max("posting_date").over(w), F.min("posting_date").over(w))
    gaps = days.withColumns({"gap_start": F.lag("posting_date").over(w.orderBy("posting_date")), "span": span}).withColumn("days", F.datediff("posting_date", "gap_start"))
    return gaps.where("span >= 60 and days > 45").select(*ACCOUNT, "gap_start", F.col("posting_date").alias("gap_end"), "days")


def fx_share(txns: DataFrame) -> DataFrame:
    foreign = F.count_if(~F.upper("currency").isin("KWD", "KD")) / F.count(F.lit(1))
    return txns.groupBy("case_id").agg(foreign.alias("metric")).select("case_id", F.lit("fx_share").alias("check"), F.when(F.col("metric") > 0.5, "warn").otherwise("pass").alias("status"), "metric")


def currency_counts(txns: DataFrame) -> DataFrame:
    """(case_id, currency, n) of foreign currencies."""
    return txns.where(~F.upper("currency").isin("KWD", "KD")).groupBy("case_id", F.upper("currency").alias("currency")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_ids(txns: DataFrame) -> DataFrame:
    """(case_id, signature, id, nth, line) of the rows that several files report, written once; ``nth`` counts a signature's rows by id, and its first has the line.

    Rows that agree in a short hash with rows of another file are few, and all that have to be signed. Those of a signature
    share its hash, so they are counted where they are found, without another shuffle.
    """
    hashed = _marked(txns).withColumn("_hash", F.xxhash64(_said()))
    hashed = hashed.select("case_id", "id", "file_id", "account_id", "posting_date", "direction", "amount_kwd", "_mark", "_hash")
    w = Window.partitionBy("case_id", "_hash")
    alike = hashed.withColumns({"_low": F.min("file_id").over(w), "_high": F.max("file_id").over(w)}).where("_low <> _high")
    same = Window.partitionBy("case_id", "_hash", "signature")
    rows = alike.withColumn("signature", F.sha2(_said(), 256)).withColumn("_file", F.dense_rank().over(same.orderBy("file_id")))
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(same), "files": F.max("_file").over(same), "nth": F.row_number().over(same.orderBy("id", "file_id"))}).where("files > 1")
    line = F.format_string("%s %s %s %.3f KWD - in %d files (%d rows)", "account_id", F.col("posting_date").cast("string"), "direction", "amount_kwd", "files", "n")
    return cut(rows.select("case_id", "signature", "id", "nth", F.when(F.col("nth") == 1, line).alias("line")), "alike")


def top_items(rows: DataFrame, item: Column, *order: Column | str) -> DataFrame:
    """(case_id, items, n): the first ``MOST_ITEMS`` lines of each case; ranked before they are collected."""
    w = Window.partitionBy("case_id")
    ranked = rows.withColumn("item", item).withColumns({"r": F.row_number().over(w.orderBy(*order, "item")), "n": F.count(F.lit(1)).over(w)}).where(F.col("r") <= MOST_ITEMS)
    return ranked.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "item"))), lambda x: x["item"]).alias("items"), F.first("n").alias("n"))


def dq_report(txns: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, report): the six checks, each with status, metric, up to eight lines and up to twelve row ids."""
    cases = files.select("case_id").distinct()
    bank = F.col("bank") if "bank" in files.columns else F.col("filename")
    said = files.select("case_id", "file_id", bank.alias("bank"), F.explode("issues").alias("issue")).where(F.lower("issue").contains("balance"))
    skipped = files.where("rows_skipped > 0")
    copies = duplicate_ids(txns)
    groups = copies.where("nth = 1").withColumnRenamed("id", "first")
    ids = copies.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy("signature", "id"))).where(F.col("r") <= MOST_IDS).groupBy("case_id").agg(F.sort_array(F.collect_list("id")).alias("txn_ids"))
    lines = {
        "parse_coverage": top_items(skipped, F.format_string("%s: %d rows skipped (%s)", bank, "rows_skipped", "filename"), "file_id"),
        "balance_integrity": top_items(said, F.format_string("%s: %s", "bank", "issue"), "file_id"),
        "statement_overlap": top_items(statement_overlap(files), F.format_string("%s: files %d and %d share %d days", "account_id", "file_a", "file_b", "days"), "account_id", "file_a", "file_b"),
        "cross_file_duplicates": top_items(groups, F.col("line"), "first"),
        "coverage_gaps": top_items(coverage_gaps(txns), F.format_string("%s: no activity %s to %s (%d days)", "account_id", F.col("gap_start").cast("string"), F.col("gap_end").cast("string"), "days"), "account_id", "gap_start"),
        "fx_share": top_items(currency_counts(txns), F.format_string("%s: %d transactions", "currency", "n"), F.desc("n"), "currency"),
    }
    known = {"parse_coverage": parse_coverage(files), "balance_integrity": balance_integrity(files), "fx_share": fx_share(txns)}
    worst = {"statement_overlap": "warn", "cross_file_duplicates": "fail", "coverage_gaps": "warn"}
    parts = []
    for check, items in lines.items():
        df = cases.join(items, "case_id", "left")
        if check in known:
            df = df.join(known[check].drop("check"), "case_id", "left")
        else:
            df = df.withColumns({"status": F.when(F.col("n") > 0, worst[check]).otherwise("pass"), "metric": F.coalesce(F.col("n"), F.lit(0)).cast("double")})
        df = df.join(ids, "case_id", "left") if check == "cross_file_duplicates" else df.withColumn("txn_ids", F.array().cast("array<bigint>"))
        parts.append(df.select("case_id", F.lit(check).alias("check"), "status", "metric", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("txn_ids", F.array().cast("array<bigint>")).alias("txn_ids")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("check", "status", "metric", "items", "txn_ids"))).alias("report"))
