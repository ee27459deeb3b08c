"""Steps whose cost once grew faster than their input."""

import datetime as dt
import os
import random
import statistics

from pyspark.sql import functions as F

from tallyrock import forensic_queries, queries
from tallyrock.constants import Thresholds
from tallyrock.functions import narrative
from tallyrock.operators import features, forensics, identities, netting, quality, views
from tallyrock.sources.ledger import SCHEMAS, merge_flags, write_ledger
from tallyrock.sources.shared import shared_dir


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tables(spark):
    folder = shared_dir(spark).removeprefix("file:").replace("///", "/").replace("//", "/")
    return {x: f"{folder}/{x}" for x in (os.listdir(folder) if os.path.isdir(folder) else [])}


def test_merged_ledger_is_written_once(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMAS["ledger"])
    rows = spark.range(20).selectExpr("id % 4 as case_id", "id")
    write_ledger(rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema]), str(tmp_path), 3)
    pairs = spark.createDataFrame([], "case_id long, pair_id long, debit_id long, credit_id long")
    hits = spark.createDataFrame([(1, "R", True, [1])], "case_id long, rule_id string, fired boolean, txn_ids array<long>")
    before = set(tables(spark))
    merge_flags(spark, str(tmp_path), pairs, hits, spark.createDataFrame([(1,)], "case_id long"), 3)
    assert {x.rpartition("-")[0] for x in set(tables(spark)) - before} == {"merged-cases"}


def test_only_rows_alike_are_signed(spark):
    day = dt.date(2025, 1, 1)
    rows = [(1, k, k % 3, "A", "B", day + dt.timedelta(k % 40 if k < 60 else k), "debit", 1.5, "KWD", f"text of row {k if k % 20 else 0}") for k in range(90)]
    txns = spark.createDataFrame(rows, "case_id long, id long, file_id long, bank string, account_id string, posting_date date, direction string, amount_kwd double, currency string, narrative string")
    before = set(tables(spark))
    got = {r["id"] for r in quality.duplicate_ids(txns).collect()}
    groups = {}
    for r in rows:
        groups.setdefault((r[5], r[9]), []).append(r)
    want = {r[1] for g in groups.values() if len({r[2] for r in g}) > 1 for r in g}
    signed = [p for x, p in tables(spark).items() if x not in before and x.startswith("alike-")]
    assert got == want and len(want) > 1 and len(signed) == 1 and spark.read.parquet(signed[0]).count() == len(want)


def test_splits_of_months_are_not_rows(spark):
    r = random.Random(5)
    rows = [(c, c * 1000 + k, dt.date(2020 + k // 12, k % 12 + 1, 3), float(r.randrange(100, 900) * (30 if k > 11 + c else 1))) for c in range(6) for k in range(24 + c)]
    ext = spark.createDataFrame(rows, "case_id long, id long, posting_date date, amount_kwd double")
    found = forensics.behaviour_change(ext)
    want = {}
    for c in range(6):
        v = [x[3] for x in rows if x[0] == c]
        best = max((statistics.median(v[s:]) / statistics.median(v[:s]), -s) for s in range(3, len(v) - 2))
        want[c] = round(best[0], 2)
    assert {x["case_id"]: round(x["metric"], 2) for x in found.collect()} == want
    assert "median" not in plan_of(found) and "percentile" not in plan_of(found)
    lines = spark.createDataFrame([([3.0, None, 1.0],), ([4.0, 1.0, 2.0, 9.0],), ([],)], "v array<double>").select(forensics.middle(F.col("v")).alias("m"))
    assert [x["m"] for x in lines.collect()] == [2.0, 3.0, None]


def test_a_row_is_read_once_for_all_sums(spark):
    rows = [(1, 1, "debit", "other", 9.5, "Own account transfer"), (1, 2, "debit", "other", 0.5, None), (1, 3, "credit", "other", 1234.0, ""), (1, 4, "credit", "other", 70.0, "Binance purchase")]
    txns = spark.createDataFrame(rows, "case_id long, id long, direction string, channel string, amount_kwd double, narrative string")
    txns = txns.withColumns({"posting_date": F.lit("2025-01-03").cast("date"), "counterparty_country": F.lit(None).cast("string"), "counterparty_name": F.lit(None).cast("string")})
    pairs = spark.createDataFrame([], "case_id long, pair_id long, debit_id long, credit_id long")
    sums = features.case_sums(txns, pairs, Thresholds())
    assert plan_of(sums).count("format_number") == 1 and "RLIKE (?i)" not in plan_of(sums).split("cast(sum")[0]
    got = sums.first()
    assert (got["own_value"], got["vague_value"], got["n_crypto"], got["d9"], got["d1"], got["d7"], got["n_benford"]) == (9.5, 1234.5, 1, 1, 1, 1, 3)


def test_pair_candidates_at_the_borders(spark):
    r = random.Random(2)
    amounts = [99.4, 99.9, 100.0, 100.4, 100.5, 101.0, 102.0, 104.04, 0.4, 0.9, 2.0, 2.5, 5000.0, 5025.0, 4975.0, 5025.01]
    rows = [(1, k, "AB"[k % 2], "a", dt.date(2025, 1, 1) + dt.timedelta(r.randrange(-4, 9)), "debit" if k < 150 else "credit", r.choice(amounts), "transfer_out", None, None, None) for k in range(300)]
    txns = spark.createDataFrame(rows, "case_id long, id long, bank string, account_id string, posting_date date, direction string, amount_kwd double, channel string, narrative string, counterparty_name string, counterparty_bank string")
    got = [(x["d_id"], x["c_id"]) for x in netting.pair_candidates(txns).collect()]
    want = [(d[1], c[1]) for d in rows[:150] for c in rows[150:] if d[2] != c[2] and 0 <= (c[4] - d[4]).days <= 3 and abs(d[6] - c[6]) <= max(0.5, d[6] * 0.005)]
    assert sorted(got) == sorted(want) and len(want) > 100
    asked = netting.asking(txns.where("direction = 'debit'"), F.col("posting_date"), F.col("amount_kwd"))
    assert asked.groupBy("id").count().agg(F.max("count")).first()[0] <= 4


def test_channels_of_what_is_said_alike(spark):
    said = [("ATM cash", None, "debit", False), ("ATM cash", None, "debit", False), (None, "salary", "credit", True), (None, None, None, None), ("misc", None, "credit", True)]
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(said)], "id long, narrative string, extra string, direction string, party boolean")
    got = {x["id"]: x["_channel"] for x in narrative.with_channel(rows, "narrative", "extra", "direction", "party").collect()}
    one = rows.select("id", narrative.classify_channel(F.col("narrative"), F.col("extra"), F.col("direction"), F.col("party")).alias("c"))
    assert got == {x["id"]: x["c"] for x in one.collect()} and got[0] == "cash_withdrawal"


def test_the_ledger_is_made_once(spark):
    txns, pairs, ext, _ = queries.parts(spark, "/root/testdata/sf0.001")
    assert all("lineitem" not in plan_of(x) and x.inputFiles() and not any("lineitem" in f for f in x.inputFiles()) for x in (txns, pairs, ext))


def test_screening_writes_names_only(spark):
    """The wide ledger was written before its names were read twice."""
    before = set(tables(spark))
    asked = forensic_queries.x1_names_to_screen(spark, "/root/testdata/sf0.001")
    made = {x.rpartition("-")[0]: p for x, p in tables(spark).items() if x not in before}
    said = spark.read.parquet(made["spelled"]).where("spelling is not null")
    assert set(made) == {"spelled", "spellings"} and set(said.columns) == {"scope", "spelling", "n"}
    rows = queries.td.ledger(spark, "/root/testdata/sf0.001").where("counterparty_name is not null")
    assert said.agg(F.sum("n")).first()[0] == rows.count() > said.count() and asked.count() > 0


def test_parties_meet_sums_not_rows(spark):
    """Every row was joined with its party and written once more, with all columns."""
    names = ("ALI HASSAN", "Ali  Hassan", "ALI H", None, "CO", " ", "Account 123X")
    rows = [(None if k % 41 == 40 else k % 3, k, (None, "A", "B")[k % 3], (None, "x12345")[k % 2], (None, "debit", "credit", "credit")[k % 4], k / 7, (None, "pos", "cash_deposit")[k % 5 % 3], names[k % 7], (None, "KUWAIT", "LEBANON")[k // 7 % 3]) for k in range(400)]
    txns = spark.createDataFrame(rows, "case_id long, id long, bank string, account_id string, direction string, amount_kwd double, channel string, counterparty_name string, counterparty_country string").repartition(4)
    flags = F.when(F.col("id") % 4 < 3, F.col("id") % 4 == 0)
    before = set(tables(spark))
    got = views.party_nodes(txns, identities.party_spellings(txns), flags)
    made = {x.rpartition("-")[0]: p for x, p in tables(spark).items() if x not in before}
    assert "clustered" not in made and spark.read.parquet(made["parties"]).count() < 30
    want = views.network_nodes(identities.resolved(txns)[2], flags)
    named = lambda df: sorted(map(str, df.where("node <> 'acct'").select(*want.columns).collect()))
    assert len(named(got)) > 20 and named(got) == named(want)
    # an account without bank and number is no counterparty, so it has no country, as in the SQL
    assert {r["country"] for r in got.where("node = 'acct'").collect()} == {None}


def test_statements_are_written_once_and_put_in_no_order(spark):
    from tallyrock.operators import normalize
    from tallyrock.plans import jobs

    body = lambda n: [["05/01/2025", "one", "(1,234.5)"]] + [[None, " ", None]] * n + [["06/01/2025", "two", "7"]]
    made = [(f, "1", k, cells, f"file-{f}") for f, n in ((1, 80), (2, 81)) for k, cells in enumerate([["Date", "Details", "Amount"], *body(n)])]
    rows = spark.createDataFrame(made, "file_id long, sheet string, row_index int, cells array<string>, filename string")
    maps = normalize.column_maps(normalize.find_header(rows))
    assert "Window" not in plan_of(normalize.table_rows(rows.where("file_id = 1"), maps))
    files = rows.selectExpr("file_id", "file_id as case_id", "filename").distinct()
    cases = spark.createDataFrame([(1, "SOME ONE", 1.0)], "case_id long, subject_name string, income double")
    before = set(tables(spark))
    txns = jobs.ingest_ledger(rows, files, cases)[0]
    # the one table of all rows; the others hold a row for each file, header, narrative or case
    written = {x.rpartition("-")[0] for x in set(tables(spark)) - before}
    assert "cells" in written and not {"ingest", "ledger"} & written
    # 81 empty rows end a sheet, 80 do not
    assert sorted((x["file_id"], x["narrative"], x["amount"], x["direction"]) for x in txns.collect()) == [(1, "one", 1234.5, "debit"), (1, "two", 7.0, "credit"), (2, "one", 1234.5, "debit")]


def test_plain_amounts_are_read_as_odd_ones(spark):
    r = random.Random(7)
    made = {"".join(r.choice("0123456789,.()+-") for _ in range(r.randrange(1, 9))) for _ in range(3000)} | {f"({k:,.2f})" for k in (1, 1234, 12345678)} | {"5\n", "(5", "5)", "+5", "1,2345", "0,123", " 7 "}
    rows = spark.createDataFrame([(x,) for x in sorted(made)], "t string").select("t", narrative.parse_amount(F.col("t")).alias("a"), narrative._odd_amount(F.trim("t")).alias("b")).collect()
    assert [x["t"] for x in rows if x["a"] != x["b"]] == [] and any(x["a"] is not None for x in rows)


def test_rows_are_summed_before_they_meet_their_parties(spark):
    r = random.Random(11)
    names = ["OMAR HASSAN", "Omar  Hassan", "OMAR H", "SALEM TRADING CO", "Salem Trading", "NOUR SAID", "??", None]
    day = dt.date(2025, 1, 1)
    made = [(k % 3, k, r.choice(("credit", "debit")), float(r.randrange(1, 90_000)) / 10, r.choice(names), r.choice((None, "own transfer", "rent")), day) for k in range(400)]
    rows = spark.createDataFrame(made, "case_id long, id long, direction string, amount_kwd double, counterparty_name string, narrative string, posting_date date")
    clustered, parties = identities.resolved(rows)[2], identities.party_spellings(rows)
    of = lambda df: sorted((tuple(x) for x in df.collect()), key=str)
    assert of(features.spelled_sums(rows, parties)) == of(features.party_sums(clustered)) and features.party_sums(clustered).count() == 3
    assert of(forensics.spelled_concentration(rows, parties)) == of(forensics.concentration(clustered)) != []


def test_rows_meet_the_legs_without_their_texts(spark):
    day = lambda k: dt.date(2025, 1, 1) + dt.timedelta(k)
    made = [(1, k, "credit", 500.0, day(20 * k), "salary", "Payer One" if k % 2 else None, "KUWAIT", "text") for k in range(10)]
    rows = spark.createDataFrame(made, "case_id long, id long, direction string, amount_kwd double, posting_date date, channel string, counterparty_name string, counterparty_country string, narrative string")
    pairs = spark.createDataFrame([(1, 1, 2)], "case_id long, debit_id long, credit_id long")
    assert not {"narrative", "counterparty_name", "counterparty_country"} & set(features.marked(rows, pairs, features.SLIM).columns)
    sums = features.case_sums(rows, pairs, Thresholds())
    assert "Expand" not in plan_of(sums) and "count(distinct" not in plan_of(sums)
    assert (x := sums.first())["active_months"] == len({m[4].month for m in made}) and x["n_ext"] == 8 and x["turnover"] == 5000.0


def test_reported_rows_come_from_one_reading(spark):
    from tallyrock.plans import testdata as td

    rows = spark.createDataFrame([(k * 10, 3, "x") for k in range(12)], "id long, file_id long, bank string")
    got = td.reported(rows)
    assert "Union" not in plan_of(got) and plan_of(got).count("LogicalRDD") == 1
    want = rows.unionByName(rows.where("id % 50 = 0").withColumns({"file_id": F.col("file_id") + 5, "id": F.col("id") + 700_000_000_000}))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema == want.schema


def test_copies_are_counted_where_they_are_found(spark):
    day = dt.date(2025, 1, 1)
    made = [(1, k, f, "A", day, "debit", 1.5, text) for k, (f, text) in enumerate([(1, "rent of may"), (2, "rent of may"), (2, "rent of may"), (3, "rent of june"), (3, "rent of june"), (4, "rent of july")])]
    txns = spark.createDataFrame(made, "case_id long, id long, file_id long, account_id string, posting_date date, direction string, amount_kwd double, narrative string")
    before = set(tables(spark))
    got = quality.duplicate_ids(txns)
    assert sorted((x["id"], x["nth"], x["line"]) for x in got.collect()) == [(0, 1, "A 2025-01-01 debit 1.500 KWD - in 2 files (3 rows)"), (1, 2, None), (2, 3, None)]
    # what is written is the rows of copies alone: nothing is left to join or to group
    assert {x.rpartition("-")[0] for x in set(tables(spark)) - before} == {"alike"} and "Join" not in plan_of(got) and "Aggregate" not in plan_of(got)
