import datetime as dt

from tallyrock.plans import jobs
from tallyrock.sources.ledger import read_statement_rows, write_runs


def test_statements_to_scores(spark, tmp_path):
    lines = ["My bank,,,,", "Date,Description,Debit,Credit,Account", "05/01/2025,CASH DEPOSIT BRANCH,,2600.5,A1", "06/01/2025,TRANSFER TO OWN ACCOUNT,2600.5,,A1"]
    (tmp_path / "gulf.csv").write_text("\n".join(lines))
    (tmp_path / "burgan.csv").write_text("\n".join(["Date,Description,Debit,Credit,Account", "07/01/2025,TRANSFER FROM OWN ACCOUNT,,2600.5,B1"]))
    rows = read_statement_rows(spark, str(tmp_path / "*.csv")).cache()
    files = rows.select("file_id", "filename").distinct().selectExpr("file_id", "1L as case_id", "filename")
    cases = spark.createDataFrame([(1, "SOME ONE", 500.0)], "case_id long, subject_name string, income double")
    txns, reports = jobs.ingest(rows, files, cases)
    assert sorted(r["bank"] for r in reports.collect()) == ["Burgan Bank", "Gulf Bank"]
    txns = txns.cache()
    out = jobs.score_cases(txns, cases)
    assert out["pairs"].count() == 1 and out["scores"].first()["band"] in ("Low", "Moderate", "Elevated")
    assert out["ledger"].where("is_internal_transfer").count() == 2 and out["gates"].count() > 0


def test_parties_and_issues_of_statements(spark, tmp_path):
    head = "Posting Date;Txn Type;D/C;Amount;Amount KWD;CCY;Sender Name;Beneficiary Name;Sender Bank;Receiver Bank;Ordering Country;Benef Country;Details;Remarks;Balance"
    lines = [
        head, "01-01-2025;wire;C;100;30.7;USD;ALI HASSAN;;BOUBKWKW;;LEBANON;;first;part;30.7", "02-01-2025;wire;D;20;20;KWD;X;OMAR SAID;;GULBKWKW;;KUWAIT;second;;10.7",
        "03-01-2025;Credit note;;5;5;KD;Central Bank of Kuwait;;;;;;third;;99", "bad;x;C;5;5;KWD;;;;;;;;;", ";;;;;;;;;;;;total;;",
    ]
    (tmp_path / "export.csv").write_text("\n".join(lines))
    (tmp_path / "copy.csv").write_text("\n".join(lines[:3]))
    rows = spark.read.text(str(tmp_path / "*.csv"), wholetext=True).selectExpr("xxhash64(_metadata.file_name) as file_id", "_metadata.file_name as filename", "posexplode(split(value, '\n')) as (row_index, line)")
    rows = rows.selectExpr("file_id", "'1' as sheet", "row_index", "split(line, ';') as cells", "filename").cache()
    files = rows.selectExpr("file_id", "1L as case_id", "filename").distinct()
    cases = spark.createDataFrame([(1, "SOME ONE", 500.0)], "case_id long, subject_name string, income double")
    txns, reports = jobs.ingest(rows, files, cases)
    got = [(r["direction"], r["amount_kwd"], r["currency"], r["counterparty_name"], r["counterparty_bank"], r["counterparty_country"], r["narrative"]) for r in txns.join(reports.where("filename = 'export.csv'").select("file_id"), "file_id").orderBy("row_index").collect()]
    assert got == [("credit", 30.7, "USD", "ALI HASSAN", "BOUBKWKW", "LEBANON", "first | part"), ("debit", 20.0, "KWD", "OMAR SAID", "GULBKWKW", "KUWAIT", "second"), ("credit", 5.0, "KWD", None, None, None, "third")]
    report = {r["filename"]: r for r in reports.collect()}
    assert report["export.csv"]["issues"] == ["1 balance reconciliation break across 2 checked rows", "1 of 4 rows could not be converted"] and report["export.csv"]["bank"] == "Boubyan Bank"
    out = jobs.score_cases(txns, cases, files=reports)
    checks = {c["check"]: c for c in out["quality"].first()["report"]}
    assert checks["balance_integrity"]["status"] == "warn" and checks["cross_file_duplicates"]["status"] == "fail" and len(checks["cross_file_duplicates"]["txn_ids"]) == 4
    assert checks["fx_share"]["items"] == ["USD: 2 transactions"] and checks["parse_coverage"]["items"] == ["Boubyan Bank: 1 rows skipped (export.csv)"]
    assert out["scores"].count() == 1 and "quality" in out
    named = spark.createDataFrame([(r["file_id"], {"date": "Posting Date", "amount": "Amount KWD", "indicator": "D/C", "narrative": "Remarks"}) for r in reports.collect()], "file_id long, named map<string,string>")
    plain, _ = jobs.ingest(rows, files, cases, named)
    assert {r["narrative"] for r in plain.collect()} == {"part", None}


def test_portfolio(spark):
    rows = [(c, k, d, v, n, [] if k % 2 else ["R"]) for k, (c, d, v, n) in enumerate([(1, "credit", 10.0, "ANWAR H"), (2, "debit", 20.0, "ANWAR HAMAD"), (2, "credit", 5.0, "OTHER MAN"), (3, "debit", 7.0, "ANWAR HAMAD"), (3, "debit", 1.0, "Account 123X"), (1, "debit", 2.0, "Account 123X")])]
    txns = spark.createDataFrame(rows, "case_id long, id long, direction string, amount_kwd double, counterparty_name string, flags array<string>").withColumns({"file_id": jobs.F.lit(1), "bank": jobs.F.lit("B")})
    cases = spark.createDataFrame([(1, "X Y", "open"), (2, "Z", "open"), (3, "MR ANWAR HAMAD", "intake")], "case_id long, subject_name string, status string")
    hit = [{"rule_id": "R-1", "fired": True, "weight": 1.0}]
    runs = spark.createDataFrame([(1, 1, dt.datetime(2025, 1, 2), 0.9, "Critical", hit), (2, 2, dt.datetime(2025, 1, 3), 0.1, "Moderate", hit)], "id long, case_id long, created_at timestamp, probability double, band string, rule_hits array<struct<rule_id:string,fired:boolean,weight:double>>")
    decided = spark.createDataFrame([(1, 1, "escalate")], "id long, run_id long, decision string")
    out = jobs.portfolio(runs, decided, txns, cases)
    top = out["counterparties"].collect()
    assert [(r["display"], r["cases"], r["n"], r["total"], r["subject_of"]) for r in top] == [("ANWAR HAMAD", 3, 3, 37.0, [3]), ("Account 123X", 2, 2, 3.0, [])]
    by_case = {(r["cluster"], r["case_id"]): r for r in out["counterparty_cases"].collect()}
    assert len(by_case) == 5 and by_case[top[0]["cluster"], 3]["status"] == "intake" and by_case[top[0]["cluster"], 1]["flagged"] == 1
    assert (r := out["rules"].first())["fired"] == 2 and r["decided"] == 1 and r["escalated_share"] == 1.0
    assert out["summary"].first()["cases"] == 2 and [r["id"] for r in out["newest"].orderBy(jobs.F.desc("created_at")).collect()] == [2, 1]


def test_runs_are_written_by_day(spark, tmp_path):
    runs = spark.createDataFrame([(1, 1, dt.datetime(2025, 1, 2, 3)), (2, 1, dt.datetime(2025, 1, 3, 3))], "id long, case_id long, created_at timestamp")
    write_runs(runs, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).where("run_date = '2025-01-03'").count() == 1


def test_rows_of_any_width_and_quotes(spark, tmp_path):
    wide = ["Date", *[f"X{k}" for k in range(60)], "Amount", "Remarks"]
    (tmp_path / "wide.csv").write_text("﻿" + "\t".join(wide) + "\n" + "\t".join(["05/01/2025", *["-"] * 60, "7.5", "last of 63"]) + "\n")
    (tmp_path / "quoted.csv").write_text('Date;Details;Amount\n05/01/2025;"two\nlines; and ""quotes""";"1,234.5"\n\n06/01/2025;;3\n')
    (tmp_path / "plain.csv").write_text("\n".join(f"{k},{k + 1}" for k in range(500)))
    rows = read_statement_rows(spark, str(tmp_path / "*.csv")).collect()
    cells = {n: [r["cells"] for r in sorted((r for r in rows if r["filename"] == n), key=lambda r: r["row_index"])] for n in ("wide.csv", "quoted.csv", "plain.csv")}
    assert cells["wide.csv"][0] == wide and cells["wide.csv"][1][-2:] == ["7.5", "last of 63"]
    assert cells["quoted.csv"] == [["Date", "Details", "Amount"], ["05/01/2025", 'two\nlines; and "quotes"', "1,234.5"], [None], ["06/01/2025", None, "3"]]
    assert cells["plain.csv"] == [[str(k), str(k + 1)] for k in range(500)]


def test_order_of_a_file_in_many_splits(spark, tmp_path):
    (tmp_path / "long.csv").write_text("\n".join(f"{k},x" for k in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        rows = read_statement_rows(spark, str(tmp_path / "long.csv")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 20_000 and all(r["cells"][0] == str(r["row_index"]) for r in rows)


def test_bundled_exports_read_as_their_files(spark, tmp_path):
    exports = {"a-1": 'Date;Details;Amount\n05/01/2025;"two\nlines; and\ttab";"1,234.5"\n\n06/01/2025;;3', "b-2": "\n".join(f"{k},{k + 1}" for k in range(3000)), "c-3": "\ufeffDate\tAmount\n1\t2"}
    (tmp_path / "one").mkdir()
    (tmp_path / "all").mkdir()
    for name, text in exports.items():
        (tmp_path / "one" / name).write_text(text)
    (tmp_path / "all" / "part-0").write_text("\n".join(f"{n}\t{line}" for n in ("a-1", "b-2") for line in exports[n].split("\n")))
    (tmp_path / "all" / "part-1").write_text("\n".join(f"c-3\t{line}" for line in exports["c-3"].split("\n")))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        of = lambda df: sorted((r["filename"], r["row_index"], r["cells"]) for r in df.collect())
        rows = read_statement_rows(spark, str(tmp_path / "all"), bundled=True).cache()
        assert of(rows) == of(read_statement_rows(spark, str(tmp_path / "one"))) and rows.select("file_id").distinct().count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_given_labels_and_credit_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text("My statement,,,\nDate,Details,Side,Amount\n05/01/2025,one,X,5\n06/01/2025,two,Y,6\nbad,three,X,7\n")
    rows = read_statement_rows(spark, str(tmp_path / "a.csv")).cache()
    files = rows.selectExpr("file_id", "1L as case_id", "filename").distinct()
    cases = spark.createDataFrame([(1, "SOME ONE", 500.0)], "case_id long, subject_name string, income double")
    named = files.selectExpr("file_id", "map('date', 'Date', 'amount', 'Amount', 'indicator', 'Side', 'narrative', 'Details') as named", "array('x') as credit_values", "'My Bank' as bank_label")
    txns, reports = jobs.ingest(rows, files, cases, named)
    assert sorted((r["direction"], r["amount_kwd"], r["bank"], r["account_id"]) for r in txns.collect()) == [("credit", 5.0, "My Bank", "My Bank - main account"), ("debit", 6.0, "My Bank", "My Bank - main account")]
    assert reports.first()["notes"] == ["Header detected on sheet row 2.", "Column map: date=Date, amount=Amount, indicator=Side, narrative=[Details]", "Skipped 1 row: row without a parsable date (subtotal/footer)."]


def entry_rows(version):
    """Entries of two versions: some go, some come, some change their names."""
    names = [f"{a} {b}" for a in ("OMAR", "ALI", "SALEM", "NOUR") for b in ("HASSAN", "TRADING", "SAID")]
    kept = [(k, n) for k, n in enumerate(names) if (k + version) % 4]
    return [("OFAC", f"E{k}", "entity", [], [{"text": t, "tokens": t.split(), "is_alias": j > 0} for j, t in enumerate([n] + ([f"{n} CO"] if version and k % 3 == 0 else []))]) for k, n in kept]


def test_rescreening_of_changes_equals_screening_anew(spark, monkeypatch):
    from tallyrock.operators import sanctions

    schema = "list string, entry_id string, type string, programs array<string>, names array<struct<text:string,tokens:array<string>,is_alias:boolean>>"
    old, new = (spark.createDataFrame(entry_rows(v), schema) for v in (0, 1))
    asked = ["OMAR HASSAN", "ALI H SAID", "SALEM TRADING", "NOUR SAID", "ALI HASSAN OMAR", "NOBODY"]
    names = spark.createDataFrame([(k % 2, f"name:{n}", n.split(), n, 1, False) for k, n in enumerate(asked)], "case_id long, key string, tokens array<string>, display string, n long, is_subject boolean")
    rows = lambda df: sorted(tuple(r) for r in df.select("key", "entry_id", "tier", "listed_name").collect())
    anew = rows(sanctions.screen(names, new))
    assert rows(sanctions.rescreened(names, sanctions.screen(names, old), old, new)) == anew != rows(sanctions.screen(names, old))
    runs = spark.createDataFrame([(k, k, dt.datetime(2025, 1, 1), "v1", 0, 0, 0) for k in (0, 1)], "id long, case_id long, created_at timestamp, list_version string, exact long, strong long, possible long")
    # both lists are far too short to be believed
    assert sanctions.rescreen_stale(runs, "v2", names, new).isEmpty()
    monkeypatch.setattr(sanctions, "LEAST", {"OFAC": 1})
    plain, changed = (sorted(tuple(r) for r in sanctions.rescreen_stale(runs, "v2", names, new, b).collect()) for b in (None, (sanctions.screen(names, old), old)))
    assert plain == changed and plain


def test_references_that_hold_each_other(spark):
    import random
    import re

    from tallyrock.operators import views

    r = random.Random(1)
    text = lambda: "".join(r.choice("ab-1 ") for _ in range(r.randrange(1, 9)))
    asked, known = [(k % 3, text()) for k in range(200)], [(k % 3, text()) for k in range(30)]
    norm = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    good = lambda c, t: len(norm(t)) < 4 or any(x == c and len(norm(p)) >= 4 and (norm(p) in norm(t) or norm(t) in norm(p)) for x, p in known)
    found = views.reference_audit(spark.createDataFrame([(c, "s", t) for c, t in asked], "case_id long, section string, reference string"), spark.createDataFrame(known, "case_id long, name string"))
    assert {x["case_id"]: (x["checked"], x["valid"]) for x in found.collect()} == {c: (sum(x == c for x, _ in asked), sum(good(x, t) for x, t in asked if x == c)) for c in range(3)}


def test_overlaps_against_all_pairs(spark):
    import random

    from tallyrock.operators import quality

    r = random.Random(3)
    day = lambda k: dt.date(2025, 1, 1) + dt.timedelta(k)
    rows = [(1, k, r.sample(["A", "B", "C"], 2), s, s + r.choice((0, 1, 2, 5, 40))) for k in range(60) for s in [r.randrange(300)]]
    files = spark.createDataFrame([(c, k, a, day(s), day(e)) for c, k, a, s, e in rows], "case_id long, file_id long, accounts array<string>, period_start date, period_end date")
    want = {(x, a[1], b[1], min(a[4], b[4]) - max(a[3], b[3])) for a in rows for b in rows if a[1] < b[1] for x in set(a[2]) & set(b[2]) if min(a[4], b[4]) - max(a[3], b[3]) > 1}
    assert {tuple(x)[1:] for x in quality.statement_overlap(files).collect()} == want


def test_sinks_written_again(spark, tmp_path):
    from tallyrock.sources.ledger import SCHEMAS, merge_flags, read_table, write_ledger

    path = str(tmp_path / "ledger")
    empty = spark.createDataFrame([], SCHEMAS["ledger"])
    txns = spark.range(40).selectExpr("id % 4 as case_id", "id")
    write_ledger(txns.select(*[jobs.F.col(f.name) if f.name in txns.columns else jobs.F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema]), path, 3)
    pairs = spark.createDataFrame([(1, 7, 1, 5)], "case_id long, pair_id long, debit_id long, credit_id long")
    hits = spark.createDataFrame([(1, "R", True, [1, 9]), (2, "R", True, [2])], "case_id long, rule_id string, fired boolean, txn_ids array<long>")
    for _ in range(2):
        merge_flags(spark, path, pairs, hits, spark.createDataFrame([(1,)], "case_id long"), 3)
    back = {x["id"]: x for x in read_table(spark, "ledger", path).collect()}
    assert len(back) == 40 and {k for k, x in back.items() if x["flags"]} == {1, 9} and {k for k, x in back.items() if x["is_internal_transfer"]} == {1, 5}
