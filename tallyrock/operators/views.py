"""Timelines, flows, networks, searches and run comparisons of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrock.functions.names import name_tokens, names_likely_same
from tallyrock.operators.netting import money

CASH = ("cash_deposit", "cash_withdrawal")


def _sums() -> list[Column]:
    credit = F.col("direction") == "credit"
    total = lambda when, name: F.coalesce(money(F.when(when, F.col("amount_kwd"))), F.lit(0.0)).alias(name)
    return [total(credit, "credits"), total(~credit, "debits"), total(F.col("channel") == CASH[0], "cash_in"), total(F.col("channel") == CASH[1], "cash_out"), F.count(F.lit(1)).alias("n")]


def timeline(txns: DataFrame) -> DataFrame:
    return txns.groupBy("case_id", F.date_format("posting_date", "yyyy-MM").alias("month"), "bank").agg(*_sums())


def monthly_flows(txns: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Months of a case; a case whose ledger no longer has its run's row count is dropped."""
    out = txns.groupBy("case_id", F.date_format("posting_date", "yyyy-MM").alias("month")).agg(*_sums())
    if runs is None:
        return out
    same = txns.groupBy("case_id").agg(F.count(F.lit(1)).alias("txn_count")).join(runs.select("case_id", "txn_count"), ["case_id", "txn_count"], "left_semi")
    return out.join(same.select("case_id"), "case_id", "left_semi")


def quarterly_flows(monthly: DataFrame, most_months: int = 30) -> DataFrame:
    """Quarters of cases with more months than ``most_months``, with the month of the largest inflow and cash's share of it all."""
    long = monthly.groupBy("case_id").agg(F.count(F.lit(1)).alias("months")).where(F.col("months") > most_months).select("case_id")
    quarter = F.concat(F.substring("month", 1, 4), F.lit("-Q"), F.ceil(F.substring("month", 6, 2).cast("int") / 3).cast("string"))
    return monthly.join(long, "case_id", "left_semi").groupBy("case_id", quarter.alias("quarter")).agg(
        money("credits").alias("credits"), money("debits").alias("debits"), F.max_by("month", F.struct("credits", "month")).alias("peak_month"),
        F.coalesce(F.try_divide(money("cash_in"), money("credits")), F.lit(0.0)).alias("cash_share"), F.sum("n").alias("n"),
    )


def channel_mix(txns: DataFrame) -> DataFrame:
    return txns.groupBy("case_id", "channel", "direction").agg(F.count(F.lit(1)).alias("n"), money("amount_kwd").alias("value"))


def _ends(clustered: DataFrame) -> DataFrame:
    """Each row with the nodes it moves between: account, and cash or the counterparty's cluster."""
    account = F.concat_ws("|", F.lit("acct"), "bank", "account_id")
    other = F.when(F.col("channel").isin(*CASH), F.lit("cash")).when(F.col("cluster").isNotNull(), F.concat(F.lit("cp|"), "cluster"))
    credit = F.col("direction") == "credit"
    df = clustered.withColumns({"account": account, "other": other})
    return df.withColumns({"source": F.when(credit, F.col("other")).otherwise(F.col("account")), "target": F.when(credit, F.col("account")).otherwise(F.col("other"))})


def _with_flagged(out: DataFrame, flagged: DataFrame) -> DataFrame:
    """Nodes with their kind, an account's last figures and the first eight of their ``flagged`` (case_id, node, id)."""
    kind = F.when(F.col("node") == "cash", "cash").when(F.col("node").startswith("acct|"), "account").otherwise("counterparty")
    # ranked before they are collected, so no node's rows are all held
    few = flagged.withColumn("r", F.row_number().over(Window.partitionBy("case_id", "node").orderBy("id"))).where("r <= 8")
    ids = few.groupBy("case_id", "node").agg(F.sort_array(F.collect_list("id")).alias("flagged_ids"))
    out = out.join(ids, ["case_id", "node"], "left").withColumn("flagged_ids", F.coalesce("flagged_ids", F.array().cast("array<bigint>")))
    digits = F.regexp_replace(F.coalesce("account_id", F.lit("")), "[^0-9]", "")
    return out.withColumns({"kind": kind, "tail": F.when(kind == "account", F.right(digits, F.lit(4))), "country": F.when(kind == "counterparty", F.col("country"))}).drop("account_id")


def network_nodes(clustered: DataFrame, flags: Column | None = None) -> DataFrame:
    """(case_id, node, kind, inflow, outflow, n, flagged, flagged_ids, country, tail) of accounts, cash and counterparties."""
    ends = _ends(clustered).withColumn("flagged", flags if flags is not None else F.lit(False))
    sides = lambda node, credit: ends.where(F.col(node).isNotNull()).select("case_id", F.col(node).alias("node"), (F.col("direction") == credit).alias("in_"), "amount_kwd", "id", "flagged", "counterparty_country", "account_id")
    rows = sides("account", "credit").unionByName(sides("other", "debit"))
    out = rows.groupBy("case_id", "node").agg(
        F.coalesce(money(F.when(F.col("in_"), F.col("amount_kwd"))), F.lit(0.0)).alias("inflow"), F.coalesce(money(F.when(~F.col("in_"), F.col("amount_kwd"))), F.lit(0.0)).alias("outflow"),
        F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"),
        F.min_by("counterparty_country", F.when(F.col("counterparty_country").isNotNull(), F.col("id"))).alias("country"), F.first("account_id").alias("account_id"),
    )
    return _with_flagged(out, rows.where("flagged").select("case_id", "node", "id"))


def party_nodes(txns: DataFrame, parties: DataFrame, flags: Column) -> DataFrame:
    """The nodes of ``network_nodes`` for rows whose parties are known by spelling (scope, spelling, cluster).

    Rows are summed by account and by spelling before they meet the parties, so that only these sums
    are joined, and of the rows none but the flagged.
    """
    rows = txns.withColumns({"flagged": flags, "cash": F.coalesce(F.col("channel").isin(*CASH), F.lit(False)), "account": F.concat_ws("|", F.lit("acct"), "bank", "account_id")})
    rows = rows.withColumn("spelling", F.when(~F.col("cash"), F.col("counterparty_name")))
    paid = rows.where("cash or spelling is not null")

    def sums(into: str) -> list[Column]:
        exact = lambda of: F.sum(F.when(of, F.col("amount_kwd")).cast("decimal(20,6)"))
        inward = F.col("direction") == into
        return [exact(inward).alias("in_sum"), exact(~inward).alias("out_sum"), F.count(F.lit(1)).alias("k"), F.count_if("flagged").alias("f")]

    def other(df: DataFrame) -> DataFrame:
        of = parties.select(F.col("scope").alias("_scope"), F.col("spelling").alias("_spelling"), "cluster")
        known = df.join(of, (F.col("case_id") == F.col("_scope")) & (F.col("spelling") == F.col("_spelling")), "left")
        return known.withColumn("node", F.when(F.col("cash"), "cash").when(F.col("cluster").isNotNull(), F.concat(F.lit("cp|"), "cluster"))).where("node is not null")

    none = F.lit(None).cast("string")
    accounts = rows.groupBy("case_id", "account", "account_id").agg(*sums("credit"), F.min("id").alias("least")).withColumnRenamed("account", "node").withColumn("country", none)
    # the country is a key, as a sum beside a text would be sorted instead of hashed
    said = paid.groupBy("case_id", "cash", "spelling", F.when(~F.col("cash"), F.col("counterparty_country")).alias("country")).agg(*sums("debit"), F.min("id").alias("least"))
    parts = accounts.unionByName(other(said).withColumn("account_id", none).select(*accounts.columns))
    out = parts.groupBy("case_id", "node").agg(
        F.coalesce(F.sum("in_sum").cast("double"), F.lit(0.0)).alias("inflow"), F.coalesce(F.sum("out_sum").cast("double"), F.lit(0.0)).alias("outflow"),
        F.sum("k").alias("n"), F.sum("f").alias("flagged"), F.min_by("country", F.when(F.col("country").isNotNull(), F.col("least"))).alias("country"), F.min("account_id").alias("account_id"),
    )
    flagged = rows.where("flagged").select("case_id", F.col("account").alias("node"), "id").union(other(paid.where("flagged").select("case_id", "cash", "spelling", "id")).select("case_id", "node", "id"))
    return _with_flagged(out, flagged)


def network_edges(clustered: DataFrame, pairs: DataFrame) -> DataFrame:
    """(case_id, source, target, kind, value, n): flows summed by direction; a paired transfer is one edge with its larger value."""
    legs = pairs.select("case_id", "pair_id", F.explode(F.array("debit_id", "credit_id")).alias("id"))
    rows = _ends(clustered).join(legs, ["case_id", "id"], "left")
    flows = rows.where("pair_id is null and source is not null and target is not null").groupBy("case_id", "source", "target").agg(money("amount_kwd").alias("value"), F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("flow"))
    debit = F.col("direction") == "debit"
    moved = rows.where("pair_id is not null").groupBy("case_id", "pair_id").agg(F.max(F.when(debit, F.col("account"))).alias("source"), F.max(F.when(~debit, F.col("account"))).alias("target"), F.max("amount_kwd").alias("v"))
    internal = moved.groupBy("case_id", "source", "target").agg(money("v").alias("value"), F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("internal"))
    return flows.unionByName(internal)


def network_budget(nodes: DataFrame, edges: DataFrame, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """Nodes with the ``most`` counterparties of a case, flagged first, then by value; edges between kept nodes."""
    w = Window.partitionBy("case_id", "kind").orderBy(F.desc(F.col("flagged") > 0), F.desc(F.col("inflow") + F.col("outflow")), "node")
    kept = nodes.withColumn("r", F.row_number().over(w)).where((F.col("kind") != "counterparty") | (F.col("r") <= most)).drop("r")
    end = lambda name: kept.select("case_id", F.col("node").alias(name))
    return kept, edges.join(end("source"), ["case_id", "source"], "left_semi").join(end("target"), ["case_id", "target"], "left_semi")


def top_neighbours(edges: DataFrame, most: int = 8) -> DataFrame:
    both = edges.select("case_id", F.col("source").alias("node"), F.col("target").alias("neighbour"), "value").union(edges.select("case_id", "target", "source", "value"))
    both = both.groupBy("case_id", "node", "neighbour").agg(money("value").alias("value"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("case_id", "node").orderBy(F.desc("value"), "neighbour")))
    return ranked.where(F.col("rank") <= most)


MOST_ASKED = 500


def search_transactions(txns: DataFrame, case_id: int | None = None, bank: str | None = None, channel: str | None = None, direction: str | None = None, ids: list[int] | None = None, text: str | None = None, sort: str = "date", page: int = 1, size: int = 50, flagged: bool | None = None, internal: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(one page of the rows found, a frame with their count). ``sort`` is date, amount or id; more than 500 ids are an error."""
    df = txns
    if flagged is not None:
        df = df.where((F.coalesce(F.size("flags"), F.lit(0)) > 0) == flagged)
    if internal is not None:
        df = df.where(F.coalesce("is_internal_transfer", F.lit(False)) == internal)
    for name, value in (("case_id", case_id), ("bank", bank), ("channel", channel), ("direction", direction)):
        if value is not None:
            df = df.where(F.col(name) == value)
    if ids is not None:
        if len(ids) > MOST_ASKED:
            raise ValueError(f"more than {MOST_ASKED} ids")
        df = df.where(F.col("id").isin(ids))
    if text:
        like = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        columns = ("narrative", "counterparty_name", "counterparty_bank", "account_id")
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.col(c).ilike(like), F.lit(False))
        df = df.where(found)
    order = {"date": [F.desc("posting_date"), F.desc("id")], "amount": [F.desc("amount_kwd"), "id"], "id": ["id"]}[sort]
    return df.orderBy(*order).offset((page - 1) * size).limit(size), df.agg(F.count(F.lit(1)).alias("total"))


def latest_runs(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy("case_id").orderBy(F.desc("created_at"), F.desc("id"))
    return runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def run_history(runs: DataFrame) -> DataFrame:
    w = Window.partitionBy("case_id").orderBy(F.desc("created_at"), F.desc("id"))
    return runs.select("case_id", "id", "created_at", "probability", "band", F.size(F.filter("rule_hits", lambda h: h["fired"])).alias("n_fired"), F.row_number().over(w).alias("position"))


def compare_runs(base: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rule changes (case_id, rule_id, change, delta) and the six largest relative feature moves of each case."""
    hits = lambda df: df.select("case_id", F.inline("rule_hits")).where("fired").select("case_id", "rule_id", "weight")
    a, b = hits(base), hits(other)
    added = b.join(a, ["case_id", "rule_id"], "left_anti").select("case_id", "rule_id", F.lit("added").alias("change"), F.col("weight").alias("delta"))
    removed = a.join(b, ["case_id", "rule_id"], "left_anti").select("case_id", "rule_id", F.lit("removed").alias("change"), (-F.col("weight")).alias("delta"))
    moved = a.join(b.withColumnRenamed("weight", "w2"), ["case_id", "rule_id"]).where(F.abs(F.col("w2") - F.col("weight")) > 0.001).select("case_id", "rule_id", F.lit("weight").alias("change"), (F.col("w2") - F.col("weight")).alias("delta"))
    values = lambda df, name: df.select("case_id", F.inline("features")).select("case_id", "key", F.col("value").alias(name))
    both = values(base, "before").join(values(other, "after"), ["case_id", "key"]).where("before <> after")
    both = both.withColumn("move", F.abs(F.col("after") - F.col("before")) / F.greatest(F.abs("before"), F.lit(0.001)))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("move"), "key"))).where("r <= 6").drop("r")
    return added.unionByName(removed).unionByName(moved), ranked


def rule_performance(runs: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Per rule over latest runs: cases fired, how they were decided, and the share decided that was escalated; most fired first."""
    fired = latest_runs(runs).select(F.col("id").alias("run_id"), "case_id", F.inline("rule_hits")).where("fired").select("run_id", "case_id", "rule_id")
    df = fired.join(dispositions.select("run_id", "decision"), "run_id", "left")
    count = lambda d: F.count_if(F.col("decision") == d).alias(d)
    found = df.groupBy("rule_id").agg(F.count(F.lit(1)).alias("fired"), count("escalate"), count("watchlist"), count("close"), F.count_if(F.col("decision").isNull()).alias("undecided"))
    decided = F.col("fired") - F.col("undecided")
    return found.withColumns({"decided": decided, "escalated_share": F.try_divide("escalate", decided)}).orderBy(F.desc("fired"), "rule_id")


def upsert_disposition(dispositions: DataFrame, new: DataFrame) -> DataFrame:
    """One decision per run; the last written wins, of equal times the one with the larger id."""
    w = Window.partitionBy("run_id").orderBy(F.desc("created_at"), F.desc("id"))
    return dispositions.unionByName(new).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def portfolio_summary(cases: DataFrame, txns: DataFrame, runs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: cases beyond intake, files and their mean quality, transactions, value, and latest runs by band."""
    k = F.lit(1).alias("k")
    bands = latest_runs(runs).groupBy(k).agg(*[F.count_if(F.col("band") == b).alias(b.lower()) for b in ("Low", "Moderate", "Elevated", "High", "Critical")])
    open_ = F.coalesce(F.col("status") != "intake", F.lit(True)) if "status" in cases.columns else F.lit(True)
    n = cases.groupBy(k).agg(F.count_if(open_).alias("cases"))
    t = txns.groupBy(k).agg(F.count(F.lit(1)).alias("transactions"), money("amount_kwd").alias("value"))
    out = n.join(t, "k", "left").join(bands, "k", "left")
    if files is not None:
        out = out.join(files.groupBy(k).agg(F.count(F.lit(1)).alias("files"), (F.floor(F.avg("quality") * 1000 + 0.5) / 1000).alias("quality")), "k", "left")
    return out.drop("k")


def newest_runs(runs: DataFrame, cases: DataFrame, dispositions: DataFrame, most: int = 8) -> DataFrame:
    """The newest runs with their subjects and decisions."""
    top = runs.orderBy(F.desc("created_at"), F.desc("id")).limit(most).select("id", "case_id", "created_at", "probability", "band")
    decided = dispositions.select(F.col("run_id").alias("id"), "decision")
    return top.join(cases.select("case_id", "subject_name"), "case_id", "left").join(decided, "id", "left")


def case_stats(cases: DataFrame, txns: DataFrame, runs: DataFrame, dispositions: DataFrame) -> DataFrame:
    counted = txns.groupBy("case_id").agg(F.count_distinct("file_id").alias("files"), F.count(F.lit(1)).alias("txn_count"), F.count_distinct("bank").alias("banks"))
    last = latest_runs(runs).select("case_id", F.col("id").alias("run_id"), "band").join(dispositions.select("run_id", "decision"), "run_id", "left")
    return cases.select("case_id").join(counted, "case_id", "left").join(last, "case_id", "left").fillna({"files": 0, "txn_count": 0, "banks": 0})


def counterparty_intel(clustered: DataFrame, cases: DataFrame, names: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(clusters, their rows by case) of parties that stand in two cases or more of the portfolio.

    ``clustered`` are external rows with ``cluster``, ``names`` (cluster, display, kind). A cluster
    that may be the subject of a case names that case in ``subject_of``; such come first, then
    those of most cases, then of most value. A row by case has counts, sums and flagged rows.
    """
    credit, amount = F.col("direction") == "credit", F.col("amount_kwd")
    total = lambda when: F.coalesce(money(F.when(when, amount)), F.lit(0.0))
    flagged = F.count_if(F.size("flags") > 0) if "flags" in clustered.columns else F.count_if(F.lit(False))
    by = clustered.where("cluster is not null").groupBy("cluster", "case_id").agg(F.count(F.lit(1)).alias("n"), money(amount).alias("total"), total(credit).alias("inflow"), total(~credit).alias("outflow"), flagged.alias("flagged"))
    found = by.groupBy("cluster").agg(F.count(F.lit(1)).alias("cases"), F.sum("n").alias("n"), money("total").alias("total"), money("inflow").alias("inflow"), money("outflow").alias("outflow")).where("cases >= 2").join(names, "cluster")
    # likely the same are equal sets of tokens, or names of the same first letters with a common token of three letters, one of the two with a token of at most two
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), " ")

    def blocks(df: DataFrame, text: str, name: str, every: str, shorts: str) -> DataFrame:
        df = df.withColumn(name, name_tokens(F.col(text)))
        letters, long = joined(F.transform(name, lambda t: F.substring(t, 1, 1))), F.array_distinct(F.filter(name, lambda t: F.length(t) >= 3))
        near = lambda mark: F.transform(long, lambda t: F.concat(F.lit(mark), letters, F.lit(" "), t))
        some = F.when(F.exists(name, lambda t: F.length(t) <= 2), near(shorts)).otherwise(F.array().cast("array<string>"))
        return df.withColumn("block", F.explode(F.concat(F.array(F.concat(F.lit("=:"), joined(F.col(name)))), near(every), some)))

    a = blocks(found.where("kind = 'name'").select("cluster", "display"), "display", "ta", "s:", "f:")
    b = blocks(cases.select(F.col("case_id").alias("subject_case"), "subject_name"), "subject_name", "tb", "f:", "s:")
    same = a.join(b, "block").where(names_likely_same(F.col("ta"), F.col("tb"))).groupBy("cluster").agg(F.sort_array(F.collect_set("subject_case")).alias("subject_of"))
    ranked = found.join(same, "cluster", "left").withColumn("subject_of", F.coalesce("subject_of", F.array().cast("array<bigint>")))
    top = ranked.orderBy(F.desc(F.size("subject_of")), F.desc("cases"), F.desc("total"), "cluster").limit(most)
    status = F.col("status") if "status" in cases.columns else F.lit("unknown")
    rows = by.join(top.select("cluster"), "cluster", "left_semi").join(cases.select("case_id", "subject_name", status.alias("status")), "case_id", "left")
    return top, rows


def citation_audit(sections: DataFrame, txns: DataFrame) -> DataFrame:
    """(case_id, section, checked, valid): transaction ids that a text cites as ``[txn N]``, or ``ids`` lists, and those that exist in its case."""
    told = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?i)\[txns?[: #]*(\d+)\]"), F.lit(1)), lambda x: x.try_cast("long"))
    given = F.coalesce("ids", F.array().cast("array<bigint>")) if "ids" in sections.columns else F.array().cast("array<bigint>")
    cited = sections.select("case_id", "section", F.explode_outer(F.concat(F.array_distinct(told), F.array_distinct(given))).alias("id"))
    known = txns.select("case_id", "id", F.lit(True).alias("known"))
    return cited.join(known, ["case_id", "id"], "left").groupBy("case_id", "section").agg(F.count("id").alias("checked"), F.count_if("known").alias("valid"))


def plain(text: Column) -> Column:
    """Letters and digits of a reference, in lower case, other runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def value_audit(quotes: DataFrame, features: DataFrame) -> DataFrame:
    """(case_id, section, checked, valid) of quoted (case_id, section, feature, value): valid within 0.01 or 1 % of the case's feature."""
    known = features.select("case_id", plain(F.col("key")).alias("k"), F.col("value").alias("actual")).where("actual is not null")
    df = quotes.where("feature is not null and value is not null").withColumn("k", plain(F.col("feature"))).join(known, ["case_id", "k"], "left")
    right = F.coalesce(F.abs(F.col("value") - F.col("actual")) <= F.greatest(F.lit(0.01), F.abs("actual") * 0.01), F.lit(False))
    return df.groupBy("case_id", "section").agg(F.count(F.lit(1)).alias("checked"), F.count_if(right).alias("valid"))


#: Letters of the pieces by which references and names meet; shorter references are not judged.
GRAM = 4


def reference_audit(references: DataFrame, known: DataFrame) -> DataFrame:
    """(case_id, section, checked, valid) of (case_id, section, reference): valid where a ``known`` name (case_id, name) holds it or is held by it; under four letters always.

    A text that holds another has the other's first piece of four letters among its own, so the two
    meet there, and no reference is compared with all names of its case.
    """
    asked = references.where("reference is not null").select("case_id", "section", plain(F.col("reference")).alias("r"))
    names = known.select("case_id", plain(F.col("name")).alias("p")).where(F.length("p") >= GRAM).distinct()
    distinct = asked.where(F.length("r") >= GRAM).select("case_id", "r").distinct()
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (GRAM - 1)), lambda i: F.substr(F.col(c), i, F.lit(GRAM))))
    first = lambda c: F.substr(F.col(c), F.lit(1), F.lit(GRAM)).alias("gram")
    inside = distinct.select("*", first("r")).join(names.select("*", F.explode(grams("p")).alias("gram")), ["case_id", "gram"]).where(F.col("p").contains(F.col("r")))
    around = names.select("*", first("p")).join(distinct.select("*", F.explode(grams("r")).alias("gram")), ["case_id", "gram"]).where(F.col("r").contains(F.col("p")))
    good = inside.select("case_id", "r").union(around.select("case_id", "r")).distinct().withColumn("good", F.lit(True))
    judged = asked.join(good, ["case_id", "r"], "left").withColumn("good", (F.length("r") < GRAM) | F.coalesce("good", F.lit(False)))
    return judged.groupBy("case_id", "section").agg(F.count(F.lit(1)).alias("checked"), F.count_if("good").alias("valid"))

