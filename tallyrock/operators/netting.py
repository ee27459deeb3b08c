"""Own-account netting: pairs of legs that are one movement between a subject's accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrock.functions.names import name_similarity
from tallyrock.functions.narrative import is_self
from tallyrock.operators.matching import greedy_match

DAYS = 3
#: Days of a block of the candidates' join.
BLOCK = 4


def money(col: Column | str) -> Column:
    """A sum whose value does not depend on the order of its terms."""
    return F.sum((F.col(col) if isinstance(col, str) else col).cast("decimal(20,6)")).cast("double")


def transferish(txns: DataFrame) -> DataFrame:
    return txns.where(F.col("channel").isin("transfer_in", "transfer_out") | ((F.col("channel") == "other") & (F.col("amount_kwd") >= 100)) | is_self(F.col("narrative")))


def bank_matches(label: Column, bank: Column) -> Column:
    """Either name holds the other, or a word of the bank's of more than three letters."""
    a, b = F.upper(label), F.upper(bank)
    words = F.filter(F.split(b, r"\s+"), lambda w: F.length(w) > 3)
    return F.coalesce(a.contains(b) | b.contains(a) | F.exists(words, lambda w: a.contains(w)), F.lit(False))


def block(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BLOCK)


def bucket(amount: Column) -> Column:
    return F.when(amount < 100, F.floor(amount / 2)).otherwise(50 + F.floor(F.log(amount / 100) / F.log(F.lit(1.02)))).cast("long")


def asking(debits: DataFrame, day: Column, amount: Column) -> DataFrame:
    """A row for each ``block`` and ``bucket`` that may hold a debit's credits, at most four."""
    # a little more than the tolerance, so that rounding loses no pair
    off = F.greatest(F.lit(0.5), amount * 0.005) * 1.000001
    debits = debits.withColumn("block", F.explode(F.sequence(block(day), block(F.date_add(day, DAYS)))))
    return debits.withColumn("bucket", F.explode(F.sequence(bucket(amount - off), bucket(amount + off))))


def pair_candidates(txns: DataFrame) -> DataFrame:
    """Debits with credits of another account, 0 to 3 days later, at most 0.5 or 0.5 % apart.

    The range join is an equi-join: each debit asks the one or two blocks of ``BLOCK`` days that it may be credited in,
    and the one or two amount buckets (of 2 up to 100, of 2 % above) that its tolerance touches, which
    also keeps the days of a very large case apart.
    """
    fields = ["id", "bank", "account_id", "posting_date", "amount_kwd", "narrative", "counterparty_name", "counterparty_bank"]
    rows = transferish(txns)
    side = lambda d, x: rows.where(F.col("direction") == d).select("case_id", *[F.col(f).alias(f"{x}_{f}") for f in fields])
    debits = asking(side("debit", "d"), F.col("d_posting_date"), F.col("d_amount_kwd"))
    credits = side("credit", "c").withColumns({"block": block(F.col("c_posting_date")), "bucket": bucket(F.col("c_amount_kwd"))})
    both = debits.join(credits, ["case_id", "block", "bucket"]).where(F.datediff("c_posting_date", "d_posting_date").between(0, DAYS))
    diff = F.abs(F.col("d_amount_kwd") - F.col("c_amount_kwd"))
    apart = (F.col("d_bank") != F.col("c_bank")) | (F.col("d_account_id") != F.col("c_account_id"))
    both = both.where(apart & (diff <= F.greatest(F.lit(0.5), F.col("d_amount_kwd") * 0.005)))
    return both.withColumns({"diff": diff, "gap": F.datediff("c_posting_date", "d_posting_date")}).drop("block", "bucket")


def pair_confidence(candidates: DataFrame, cases: DataFrame) -> DataFrame:
    """Candidates with ``raw`` confidence of 0.55 or more and the text of what it rests on."""
    df = candidates.join(cases.select("case_id", "subject_name"), "case_id", "left")
    own = is_self(F.col("d_narrative")) | is_self(F.col("c_narrative"))
    similar = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", name_similarity(F.col(c), F.col("subject_name"))).otherwise(0.0)
    named = F.greatest(similar("d_counterparty_name"), similar("c_counterparty_name")) >= 0.5
    bank = bank_matches(F.col("d_counterparty_bank"), F.col("c_bank")) | bank_matches(F.col("c_counterparty_bank"), F.col("d_bank"))
    exact, near, cross = F.col("diff") < 0.001, F.col("gap") <= 1, F.col("d_bank") != F.col("c_bank")
    raw = F.lit(0.35)
    for when, more in ((exact, 0.15), (near, 0.1), (own, 0.2), (named, 0.2), (bank, 0.1), (cross, 0.05)):
        raw = F.when(when, raw + more).otherwise(raw)
    basis = F.concat_ws(
        "; ",
        F.when(exact, "exact amount").otherwise(F.format_string("amount within %.3f KWD", "diff")),
        F.when(F.col("gap") == 0, "same day").when(F.col("gap") == 1, "next day").otherwise(F.format_string("%d-day gap", "gap")),
        F.when(own, "own-transfer narrative"),
        F.when(named, "counterparty name matches subject"),
        F.when(bank, "counterparty bank matches receiving bank"),
    )
    return df.withColumns({"raw": raw, "match_basis": basis}).where("raw >= 0.55")


def find_internal_pairs(txns: DataFrame, cases: DataFrame) -> DataFrame:
    """One-to-one pairs: debits by amount take their best free credit; ids count in that order.

    A credit whose confidence passes 0.99 is held at 0.99, so that the last of them wins.
    """
    edges = pair_confidence(pair_candidates(txns), cases)
    high = F.col("raw") > 0.99
    edges = edges.withColumns(
        {"left": F.col("d_id"), "right": F.col("c_id"), "by_amount": -F.col("d_amount_kwd"), "first": F.when(high, 0.0).otherwise(-F.col("raw")) - F.when(high, 2.0).otherwise(0.0), "then": F.when(high, -F.col("c_id")).otherwise(F.col("c_id"))}
    )
    got = greedy_match(edges, "case_id", ["by_amount", "left"], ["first", "then"])
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("by_amount", "left"))
    return got.select(
        "case_id", number.alias("pair_id"), F.col("d_id").alias("debit_id"), F.col("c_id").alias("credit_id"), F.col("d_amount_kwd").alias("amount_kwd"), F.col("gap").alias("date_gap_days"),
        F.col("d_bank").alias("from_bank"), F.col("c_bank").alias("to_bank"), "match_basis", F.least(F.col("raw"), F.lit(0.99)).alias("confidence"),
        F.col("d_posting_date").alias("debit_date"), F.col("c_posting_date").alias("credit_date"),
    )


def _legs(pairs: DataFrame) -> DataFrame:
    return pairs.select("case_id", F.col("pair_id").alias("internal_pair_id"), F.explode(F.array("debit_id", "credit_id")).alias("id"))


def mark_internal(txns: DataFrame, pairs: DataFrame) -> DataFrame:
    out = txns.drop("internal_pair_id", "is_internal_transfer").join(_legs(pairs), ["case_id", "id"], "left")
    return out.withColumn("is_internal_transfer", F.col("internal_pair_id").isNotNull())


def external(txns: DataFrame, pairs: DataFrame) -> DataFrame:
    return txns.join(_legs(pairs).select("case_id", "id"), ["case_id", "id"], "left_anti")


def bank_breakdown(txns: DataFrame) -> DataFrame:
    of = lambda d: F.coalesce(money(F.when(F.col("direction") == d, F.col("amount_kwd"))), F.lit(0.0))
    return txns.groupBy("case_id", "bank").agg(
        F.count(F.lit(1)).alias("txn_count"), of("credit").alias("credits_kwd"), of("debit").alias("debits_kwd"),
        F.min("posting_date").alias("first_date"), F.max("posting_date").alias("last_date"), F.sort_array(F.collect_set("account_id")).alias("accounts"),
    )


def case_totals(txns: DataFrame, pairs: DataFrame) -> DataFrame:
    of = lambda d: F.coalesce(money(F.when(F.col("direction") == d, F.col("amount_kwd"))), F.lit(0.0))
    sums = txns.groupBy("case_id").agg(F.count(F.lit(1)).alias("txn_count"), of("credit").alias("credits_kwd"), of("debit").alias("debits_kwd"), F.min("posting_date").alias("period_start"), F.max("posting_date").alias("period_end"))
    paired = pairs.groupBy("case_id").agg(F.count(F.lit(1)).alias("pairs"), money("amount_kwd").alias("paired_kwd"))
    return sums.join(paired, "case_id", "left").fillna({"pairs": 0, "paired_kwd": 0.0})
