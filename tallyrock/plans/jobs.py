"""The five jobs from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrock.operators import features as ft
from tallyrock.operators import forensics, netting, normalize, quality, sanctions, scoring, views
from tallyrock.operators.identities import cluster_display, resolved
from tallyrock.sources.ledger import flag_ledger
from tallyrock.sources.shared import cut


def ingest_ledger(rows: DataFrame, files: DataFrame, cases: DataFrame, supplied: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ledger, column maps, parsed rows, banks) of statement rows; the ledger is not written, for those who read it once. ``supplied`` as in ``ingest``."""
    maps = cut(normalize.column_maps(normalize.find_header(rows), supplied), "column-maps")
    parsed = normalize.best_sheet(normalize.parse_rows(rows, maps))
    good = parsed.where("reason is null").withColumn("account_id", F.col("account"))
    banks = normalize.infer_bank(normalize.bank_labels(files, maps, parsed))
    if supplied is not None and "bank_label" in supplied.columns:
        given = supplied.select("file_id", F.nullif(F.trim("bank_label"), F.lit("")).alias("_given"))
        banks = banks.join(given, "file_id", "left").select("file_id", F.coalesce("_given", "bank").alias("bank"))
    banks = cut(banks, "file-banks")
    txns = good.join(files.select("file_id", "case_id"), "file_id").join(banks, "file_id")
    txns = normalize.fill_account(normalize.suppress_self(txns, cases))
    return txns.withColumn("id", F.xxhash64("file_id", "sheet", "row_index")), maps, parsed, banks


def ingest(rows: DataFrame, files: DataFrame, cases: DataFrame, supplied: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Statement rows of files (file_id, case_id, filename) to (ledger, file reports).

    ``supplied`` as in ``column_maps``; its bank_label, where it has one, names a file's bank.
    """
    txns, maps, parsed, banks = ingest_ledger(rows, files, cases, supplied)
    txns = cut(txns, "ledger")
    skipped = parsed.groupBy("file_id").agg(F.count_if(F.col("reason").isNull()).alias("rows_parsed"), F.count_if(F.col("reason").isNotNull()).alias("rows_skipped"))
    balances, copies = quality.reconcile_balances(txns), quality.file_duplicates(txns)
    side = lambda d: F.coalesce(netting.money(F.when(F.col("direction") == d, F.col("amount_kwd"))), F.lit(0.0))
    totals = txns.groupBy("file_id").agg(F.min("posting_date").alias("period_start"), F.max("posting_date").alias("period_end"), F.sort_array(F.collect_set("account_id")).alias("accounts"), side("credit").alias("total_credits"), side("debit").alias("total_debits"))
    report = skipped.join(quality.file_quality(skipped, balances, copies), "file_id").join(quality.file_issues(skipped, balances, copies), "file_id")
    report = report.join(normalize.mapping_notes(maps, parsed), "file_id", "left")
    return txns, report.join(totals, "file_id", "left").join(banks, "file_id").join(files, "file_id")


def score(txns: DataFrame, cases: DataFrame, pairs: DataFrame, case_quality: DataFrame | None = None, clustered: DataFrame | None = None, shown: bool = False) -> dict[str, DataFrame]:
    """Features, hits and scores of a ledger whose own pairs are known; each is written once. ``shown`` as in ``features``."""
    found, evidence = ft.features(txns, pairs, cases, clustered=clustered, shown=shown)
    hits = cut(scoring.evaluate_rules(found, evidence), "hits")
    return {"features": found, "hits": hits, "scores": cut(scoring.posterior(cases, found, hits, case_quality), "scores")}


def score_cases(txns: DataFrame, cases: DataFrame, files: DataFrame | None = None, entries: DataFrame | None = None) -> dict[str, DataFrame]:
    """Pairs, features, hits, scores, drivers, findings, gates, flagged ledger and, with ``entries``, screening.

    ``screening`` says for every case whether it was screened; a list that is too short makes it unavailable.
    """
    pairs = cut(netting.find_internal_pairs(txns, cases), "pairs")
    ext = cut(netting.external(txns, pairs), "external")
    clustered = resolved(ext)[2]
    case_quality = quality.case_quality(files) if files is not None else None
    out = {"pairs": pairs} | score(txns, cases, pairs, case_quality, clustered)
    out["drivers"], out["ledger"] = scoring.drivers(out["scores"], out["features"], out["hits"]), flag_ledger(txns, pairs, out["hits"])
    out["findings"] = cut(forensics.technical(txns, ext, pairs, clustered, case_quality), "findings")
    out["gates"] = forensics.gates(clustered, cases, out["findings"].where("finding = 'TECH-NET-03'"))
    if files is not None:
        out["quality"], out["case_quality"] = quality.dq_report(txns, files), case_quality
    if entries is not None:
        out["matches"], out["screening"] = sanctions.screening(txns, cases, entries)
    return out


def shared_counterparties(external: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parties of several cases over one index of all spellings; see ``views.counterparty_intel``."""
    names, clusters, rows = resolved(external, scope=None)
    shown = cluster_display(names, clusters).select("cluster", "display", "kind")
    return views.counterparty_intel(rows, cases, shown)


def portfolio(runs: DataFrame, dispositions: DataFrame, txns: DataFrame, cases: DataFrame) -> dict[str, DataFrame]:
    """Rule performance, shared counterparties, summary and case statistics."""
    external = txns.where("internal_pair_id is null") if "internal_pair_id" in txns.columns else txns
    clusters, by_case = shared_counterparties(external, cases)
    return {
        "rules": views.rule_performance(runs, dispositions), "counterparties": clusters, "counterparty_cases": by_case, "newest": views.newest_runs(runs, cases, dispositions),
        "summary": views.portfolio_summary(cases, txns, runs), "cases": views.case_stats(cases, txns, runs, dispositions),
    }


def rescreen(runs: DataFrame, txns: DataFrame, cases: DataFrame, entries: DataFrame, version: str, before: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Latest runs that were screened on another list version, and whose totals change; ``before`` as in ``rescreen_stale``."""
    return sanctions.rescreen_stale(runs, version, cut(sanctions.names_to_screen(txns, cases), "asked"), entries, before)


def backfill_dq(runs: DataFrame, txns: DataFrame, files: DataFrame) -> DataFrame:
    """The data-quality report of cases whose latest run lacks one (``has_report``)."""
    lacking = views.latest_runs(runs).where("not has_report").select("case_id")
    lacking = cut(lacking, "lacking")
    return quality.dq_report(txns.join(lacking, "case_id", "left_semi"), files.join(lacking, "case_id", "left_semi"))


__all__ = ["backfill_dq", "ingest", "ingest_ledger", "portfolio", "rescreen", "score_cases"]
