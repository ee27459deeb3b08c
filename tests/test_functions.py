import datetime as dt

from pyspark.sql import functions as F

from tallyrock import forensic_queries
from tallyrock.functions import names, narrative
from tallyrock.operators import declarations, features, forensics, identities, matching, netting, normalize, quality, sanctions
from tallyrock.operators.components import connected_components


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_identity_strings(spark):
    rows = ["Account 100600XXXX", "InstaPay 6999XXXX", "ALBURAIMI AUTO RENT COMPANY", "ALBURAIMI AUTO RENT CO", "MR  anwar al-hamad", "شركة", None, "CO", " "]
    keys = values(spark, rows, lambda c: names.parse_identity(c)["key"])
    assert keys == ["acct:100600XXXX", "ip:6999XXXX", "name:ALBURAIMI AUTO RENT", "name:ALBURAIMI AUTO RENT", "name:ANWAR ALHAMAD", None, None, "name:CO", None]


def test_a_spelling_is_parsed_once(spark, monkeypatch):
    tables, cut = {}, identities.cut
    monkeypatch.setattr(identities, "cut", lambda df, name: tables.setdefault(name, cut(df, name)))
    rows = [(k % 3, k, n) for k in range(60) for n in ("ALI HASSAN", "Ali  Hassan", "ALI H", None, "CO", " ")] + [(None, 99, "ALI H")]
    names, clusters, got = identities.resolved(spark.createDataFrame(rows, "case_id long, id long, counterparty_name string"))
    assert tables["spellings"].count() == 6 and tables["said"].count() == 13
    assert {(r["scope"], r["display"], r["n"]) for r in names.where("scope is not null").collect()} == {(c, n, 20) for c in range(3) for n in ("ALI HASSAN", "Ali Hassan", "ALI H", "CO")}
    assert got.columns == ["case_id", "id", "counterparty_name", "cluster"] and got.count() == len(rows)
    told = {(r["counterparty_name"], r["cluster"]) for r in got.where("case_id is not null").collect()}
    assert told == {("ALI HASSAN", "name:ALI H"), ("Ali  Hassan", "name:ALI H"), ("ALI H", "name:ALI H"), ("CO", "name:CO"), (None, None), (" ", None)}
    assert sorted(got.columns) == sorted(identities.with_cluster(got.drop("cluster"), clusters).columns)


def test_variants_of_a_name(spark):
    rows = [(1, n) for n in ("ANWAR H A", "ANWAR H", "ANWAR HAMAD ALI", "MOHAMMED A", "MOHAMMED K", "FAISAL AL MUTAIRI", "FAISAL AL AZMI", "AL RASHID TRADING", "Al Rashid  Trading", "RASHID", "Account 123X")] + [(2, "ANWAR H")]
    df = spark.createDataFrame(rows, "case_id long, counterparty_name string")
    found = identities.identities(df)
    clusters = {}
    resolved = identities.resolve(found)
    for r in resolved.collect():
        clusters.setdefault((r["scope"], r["cluster"]), set()).add(r["key"])
    assert {"name:ANWAR H A", "name:ANWAR H", "name:ANWAR HAMAD ALI"} in clusters.values() and {"name:MOHAMMED A"} in clusters.values() and {"name:FAISAL ALAZMI"} in clusters.values()
    shown = {(r["scope"], r["cluster"]): r["display"] for r in identities.cluster_display(found, resolved).collect()}
    assert shown[1, "name:ANWAR H"] == "ANWAR HAMAD ALI" and shown[2, "name:ANWAR H"] == "ANWAR H"


def test_blocks_lose_no_pair(spark):
    import random

    r = random.Random(2)
    pool = ["ANWAR", "HAMAD", "ALI", "HUDA", "OMAR", "H", "A", "AL", "OM"]
    keys = sorted({" ".join(r.sample(pool, r.randrange(1, 4))) for _ in range(150)})
    df = spark.createDataFrame([(1, k) for k in keys], "case_id long, counterparty_name string")
    found = identities.identities(df)
    a, b = found.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), found.select(F.col("key").alias("b"), F.col("tokens").alias("tb"))
    every = {(x["a"], x["b"]) for x in a.join(b, F.col("a") < F.col("b")).where(names.names_likely_same(F.col("ta"), F.col("tb"))).collect()}
    got = {(x["a"], x["b"]) for x in identities.variant_edges(found).collect()}

    def classes(edges):
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for x, y in edges:
            up[root(x)] = root(y)
        return {frozenset(y for y in up if root(y) == root(x)) for x in list(up)}

    assert classes(got) == classes(every) and every


def test_narratives(spark):
    rows = ["himself", "own account", "USDT buy", "busdtx", None, "TRANSFER", "trf payment", "12345", "Payment for invoice services", "ab 12 cd", "12 ab cd"]
    assert values(spark, rows, narrative.is_self) == [True, True] + [False] * 9
    assert values(spark, rows, narrative.is_crypto) == [False, False, True] + [False] * 8
    assert values(spark, rows, narrative.is_vague) == [False, False, False, False, True, True, True, True, False, False, True]
    parties = ["x INTERNAL OPERATIONS To  # 22926,y", "INWARD SWIFT PAYMENT # X | 46000.000 KWD,FAHAD | z", "INWARD SWIFT PAYMENT # X, 46000.000 KWD,FAHAD | z", "POS PRCH\nALKUBAIZI MOTOR   SHUWEKH  KWT", "POS-ALRAWAD EXCHANGE EST  SHARQ", "PURCHASE\n DUBAI", "InstaPay Credit : 865887-663XXXXX", "Transfer from  01326XXXXX ANWAR H", "Transfer From: 100600XXXX"]
    assert values(spark, parties, narrative.extract_party) == ["Account 22926", "FAHAD", None, "ALKUBAIZI MOTOR", "ALRAWAD EXCHANGE EST", None, "InstaPay 663XXXXX", "ANWAR H", "Account 100600XXXX"]
    channel = lambda d: lambda c: narrative.classify_channel(c, F.lit(None).cast("string"), F.lit(d), F.lit(False))
    assert values(spark, ["KNT WDL-NBK x", "KNT BAL INQ-NBK x"], channel("debit")) == ["cash_withdrawal", "other"]


def test_cells(spark):
    dates = ["2024-02-29", "2023-02-29", "5 Mar 24", "5  Mar, 2024", "31/12/2020", "12/31/2020", "45000", "1899-01-01", "x", None]
    d = dt.date
    assert values(spark, dates, narrative.parse_date) == [d(2024, 2, 29), None, d(2024, 3, 5), None, d(2020, 12, 31), d(2020, 12, 31), d(2023, 3, 15), None, None, None]
    assert values(spark, ["1,234.50", "(5)", "(-5)", "7,5", "100 DR", "100 CR.", "", None, "abc"], narrative.parse_amount) == [1234.5, -5.0, 5.0, 7.5, -100.0, 100.0, None, None, None]


def test_greedy_match_against_one_pass(spark):
    import random

    r = random.Random(4)
    edges = sorted({(g, r.randrange(12), 100 + r.randrange(12), r.random()) for g in (1, 2) for _ in range(60)})
    df = spark.createDataFrame([(g, a, b, p) for g, a, b, p in edges], "g long, left long, right long, p double")
    expected = set()
    for g in (1, 2):
        taken = set()
        for a in range(12):
            for p, b in sorted((p, b) for x, y, b, p in edges if x == g and y == a):
                if b not in taken and (g, a) not in {(x, y) for x, y, _ in expected}:
                    taken.add(b)
                    expected.add((g, a, b))
    # whole groups; groups taken apart into components
    for most in (1000, 10):
        got = matching.greedy_match(df.repartition(7), "g", ["left"], ["p", "right"], most=most)
        assert {(x["g"], x["left"], x["right"]) for x in got.collect()} == expected


def test_greedy_match_of_one_kind_and_long_chains(spark):
    import random

    r = random.Random(8)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(90)) if a != b})
    used, expected = set(), set()
    for a, b in edges:
        if a not in used and b not in used:
            used |= {a, b}
            expected.add((a, b))
    df = spark.createDataFrame([(1, a, b) for a, b in edges], "g long, left long, right long")
    for most in (1000, 10):
        got = matching.greedy_match(df.repartition(5), "g", ["left"], ["right"], most=most, shared=True)
        assert {(x["left"], x["right"]) for x in got.collect()} == expected
    # equal amounts on many days: each left may take the next four rights, and gets its own
    n = 100_000
    chain = spark.range(n).selectExpr("1L as g", "id as left", "explode(sequence(id, id + 3)) as right")
    for most in (1 << 30, 1000):
        got = matching.greedy_match(chain, "g", ["left"], ["right"], most=most)
        assert got.count() == n and got.where("left <> right").isEmpty()


def test_exact_medians_of_large_groups(spark):
    import random
    import statistics

    from tallyrock.operators.medians import exact_median

    r = random.Random(2)
    groups = {"a": [r.lognormvariate(3, 2) for _ in range(1001)], "b": [r.random() for _ in range(500)], "c": [5.0] * 300, "d": [1.0, 2.0], "e": [1.0] * 50 + [1e9] * 50, "f": [3.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double").repartition(6)
    for most, ranges in ((1 << 20, 1024), (20, 4)):
        got = {x["g"]: (x["median"], x["n"]) for x in exact_median(rows, ["g"], "v", least=2, most=most, ranges=ranges).collect()}
        assert got == {g: (statistics.median(vs), len(vs)) for g, vs in groups.items() if g != "f"}


def test_return_loops_against_one_pass(spark):
    import random

    r = random.Random(6)
    moves = [(k, r.choice("AB"), dt.date(2026, 1, 1) + dt.timedelta(r.randrange(70)), r.choice((5000.0, 5300.0, 4600.0, 6000.0))) for k in range(60)]
    rows, pairs = [], []
    for k, source, day, amount in moves:
        other = "B" if source == "A" else "A"
        rows += [(source, "1", day.isoformat(), "debit", amount, None), (other, "1", day.isoformat(), "credit", amount, None)]
        pairs.append((1, k, 2 * k + 1, 2 * k + 2, amount, day))
    used, ids, value = set(), [], 0.0
    ordered = sorted(moves, key=lambda m: (m[2], m[0]))
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if a[0] not in used and b[0] not in used and a[1] != b[1] and 0 < (b[2] - a[2]).days <= 30 and abs(a[3] - b[3]) / max(a[3], b[3]) <= 0.1:
                used |= {a[0], b[0]}
                ids += [2 * a[0] + 1, 2 * a[0] + 2, 2 * b[0] + 1, 2 * b[0] + 2]
                value += min(a[3], b[3])
                break
    known = spark.createDataFrame(pairs, "case_id long, pair_id long, debit_id long, credit_id long, amount_kwd double, debit_date date")
    loop = forensics.return_loops(ledger(spark, rows), known).first()
    assert (loop["metric"], loop["txn_ids"]) == (len(used) / 2, ids[:30])


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, None)]
    # one task, and rounds over the cluster
    one, got = ({r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", one_task=n).collect()} for n in (100, 0))
    none = spark.createDataFrame([], "a string, b string")
    assert connected_components(none, "a", "b").count() == connected_components(none, "a", "b", one_task=0).count() == 0
    assert one == got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


def ledger(spark, rows):
    schema = "case_id long, id long, bank string, account_id string, posting_date date, direction string, amount_kwd double, channel string, counterparty_name string, counterparty_bank string, counterparty_country string, narrative string"
    return spark.createDataFrame([(1, k, b, a, dt.date.fromisoformat(d), x, float(v), "transfer", n, None, "Kuwait", None) for k, (b, a, d, x, v, n) in enumerate(rows, 1)], schema)


def test_forensics(spark):
    rows = [("T", "A", f"2026-{m:02d}-05", "credit", v, "N") for m, v in enumerate((1000, 1100, 900, 5000, 5200, 4800), 1)]
    found = forensics.behaviour_change(ledger(spark, rows)).first()
    assert found["finding"] == "TECH-TMP-01" and found["metric"] >= 4
    same_day = [("T", "A", "2026-01-01", d, 2000, "N") for d in ("credit", "debit")] * 3
    assert forensics.sequences(ledger(spark, same_day)).count() == 0
    three = [("T", "A", f"2026-01-{k:02d}", "credit", 11000, "N") for k in (1, 8, 15)] + [("T", "A", f"2026-01-{k:02d}", "debit", 11000, "N") for k in (2, 9, 16)]
    found = forensics.sequences(ledger(spark, three)).first()
    assert (found["severity"], found["txn_ids"]) == ("critical", [1, 4, 2, 5, 3, 6])
    later = [("T", "A", f"2026-01-{k:02d}", "credit", 2000 + k, "N") for k in (1, 8)] + [("T", "A", f"2026-01-{k:02d}", "debit", 2000, "N") for k in (2, 9)]
    assert forensics.sequences(ledger(spark, later)).first()["metric"] == 2
    txns = ledger(spark, [("A", "1", "2026-01-01", "debit", 5000, None), ("B", "2", "2026-01-01", "credit", 5000, None), ("B", "2", "2026-01-08", "debit", 4900, None), ("A", "1", "2026-01-08", "credit", 4900, None)])
    pairs = spark.createDataFrame([(1, 1, 1, 2, 5000.0, dt.date(2026, 1, 1)), (1, 2, 3, 4, 4900.0, dt.date(2026, 1, 8))], "case_id long, pair_id long, debit_id long, credit_id long, amount_kwd double, debit_date date")
    loop = forensics.return_loops(txns, pairs).first()
    assert (loop["finding"], loop["metric"], loop["txn_ids"]) == ("TECH-NET-03", 1.0, [1, 2, 3, 4])


def test_cross_bank_forensics(spark):
    role = lambda bank, into, out: [(bank, "1", f"2026-0{m}-0{d}", x, 2000, None) for m in (1, 2, 3) for d, x in ((2, "credit"), (5, "debit"))]
    rows = ledger(spark, role("A", 0, 0) + role("B", 0, 0))
    channel = F.when(F.col("bank") == "A", F.when(F.col("direction") == "credit", "cash_deposit").otherwise("transfer_out"))
    one = forensics.role_specialisation(rows.withColumn("channel", F.coalesce(channel, F.lit("pos")))).first()
    assert (one["metric"], one["severity"], len(one["txn_ids"])) == (1.0, "medium", 6)
    other = F.when(F.col("direction") == "credit", "transfer_in").otherwise("cash_withdrawal")
    both = forensics.role_specialisation(rows.withColumn("channel", F.coalesce(channel, other))).first()
    assert (both["metric"], both["severity"]) == (2.0, "high") and both["caveat"]
    # one placement bank alone has nothing to be compared with
    assert forensics.role_specialisation(rows.withColumn("channel", F.coalesce(channel, F.lit("pos"))).where("bank = 'A'")).count() == 0
    months = [(b, "1", f"2026-{m:02d}-05", "credit", 6000 if m in (3, 6) else 700, None) for b in "AB" for m in range(1, 9)]
    burst = forensics.burst_synchronisation(ledger(spark, months)).first()
    assert (burst["metric"], burst["severity"], burst["txn_ids"]) == (4.0, "medium", [3, 6, 11, 14])
    echoes = [("A", "1", f"2026-01-{k:02d}", "debit", v, None) for k, v in ((1, 2000), (9, 1500))] + [("B", "1", f"2026-01-{k:02d}", "credit", v, None) for k, v in ((2, 1990), (9, 1485))]
    echo = forensics.amount_echoes(ledger(spark, echoes).withColumn("channel", F.lit("other"))).first()
    assert (echo["metric"], echo["severity"], echo["txn_ids"]) == (2.0, "medium", [1, 3, 2, 4])
    paid = [("A", "1", f"2026-01-{k + 1:02d}", "credit", 500 + 10 * k, f"PAYER {chr(65 + k) * 3}") for k in range(9)] + [("A", "1", "2026-02-01", "debit", 5000, "SINK")] * 2
    clustered = ledger(spark, paid).withColumn("cluster", F.col("counterparty_name"))
    funnel = forensics.funnel(clustered).first()
    assert (funnel["metric"], funnel["severity"], funnel["txn_ids"][:3], funnel["txn_ids"][-1]) == (9.0, "medium", [9, 8, 7], 11)
    poor = spark.createDataFrame([(1, 0.8)], "case_id long, quality double")
    none = spark.createDataFrame([], "case_id long, pair_id long, debit_id long, credit_id long, amount_kwd double, debit_date date")
    assert all("80 %" in r["caveat"] for r in forensics.technical(ledger(spark, paid), ledger(spark, paid), none, clustered, poor).collect())
    few = {r["test"] for r in forensics.gates(clustered.limit(2), spark.createDataFrame([(1,)], "case_id long")).collect()}
    assert len(few) == 9


def test_confidence_adds_in_order(spark):
    base = [("A", "1", "2026-01-01", "debit", 1000.0, None), ("B", "2", "2026-01-01", "credit", 1000.0, None)]
    df = ledger(spark, base).withColumn("channel", F.when(F.col("direction") == "debit", "transfer_out").otherwise("transfer_in"))
    cases = spark.createDataFrame([(1, "X Y", None)], "case_id long, subject_name string, income double")
    got = netting.find_internal_pairs(df, cases).collect()
    assert len(got) == 1 and abs(got[0]["confidence"] - 0.65) < 1e-9 and got[0]["match_basis"] == "exact amount; same day"
    assert netting.find_internal_pairs(df.withColumn("account_id", F.lit("1")).withColumn("bank", F.lit("A")), cases).count() == 0


def test_sanctions(spark, tmp_path):
    (tmp_path / "sdn.csv").write_text('9001,"MOHAMMED AHMED\nHUSSAIN",individual,"SDGT] [IRAN",-0- ,-0-\n9002,"GLOBAL TRADING HOUSE",-0- ,"X ""Y""",-0-,-0-\n9003,"ABU BIN LADEN",individual,"SDGT",-0-,-0-\n')
    (tmp_path / "alt.csv").write_text('9001,1,"a.k.a.","ABU AHMED",-0-\n9001,2,"weak alias","HIDDEN NAME",-0-\n9001,3,"a.k.a.","Abu  Ahmed",-0-\n')
    entries = sanctions.read_ofac(spark, str(tmp_path / "sdn.csv"), str(tmp_path / "alt.csv"))
    got = {r["entry_id"]: r for r in entries.collect()}
    assert got["SDN-9001"]["programs"] == ["SDGT", "IRAN"] and got["SDN-9002"]["type"] == "entity" and len(got["SDN-9001"]["names"]) == 2
    (tmp_path / "un.xml").write_text("<L><INDIVIDUAL><DATAID>123</DATAID><FIRST_NAME>SALEH</FIRST_NAME><SECOND_NAME>ALI</SECOND_NAME><THIRD_NAME>HASSAN</THIRD_NAME><INDIVIDUAL_ALIAS><ALIAS_NAME>KARIM WAHID</ALIAS_NAME></INDIVIDUAL_ALIAS></INDIVIDUAL><ENTITY><DATAID>7</DATAID><FIRST_NAME>OMEGA HOLDING</FIRST_NAME></ENTITY></L>")
    entries = entries.unionByName(sanctions.read_un_list(spark, str(tmp_path / "un.xml")))
    names = ["MR MOHAMMED AHMED HUSSAIN", "M A HUSSAIN", "ABU AHMED", "GLOBAL HOUSE NETWORK", "GLOBAL LOGISTICS", "AHMED KHALID", "SALEH ALI HASSAN", "KARIM WAHID", "ABU BIN SALEM"]
    txns = spark.createDataFrame([(1, n) for n in names], "case_id long, counterparty_name string")
    cases = spark.createDataFrame([(1, "SOMEONE ELSE")], "case_id long, subject_name string")
    asked = sanctions.names_to_screen(txns, cases)
    screened = {r["display"]: (r["entry_id"], r["tier"]) for r in sanctions.top_matches(asked, sanctions.screen(asked, entries))[0].collect()}
    assert screened == {"MR MOHAMMED AHMED HUSSAIN": ("SDN-9001", "exact"), "M A HUSSAIN": ("SDN-9001", "strong"), "ABU AHMED": ("SDN-9001", "exact"), "GLOBAL HOUSE NETWORK": ("SDN-9002", "possible"), "SALEH ALI HASSAN": ("UN-123", "exact"), "KARIM WAHID": ("UN-123", "exact")}
    aliases = {r["display"]: (r["listed_name"], r["alias"]) for r in sanctions.top_matches(asked, sanctions.screen(asked, entries))[0].collect()}
    assert aliases["ABU AHMED"] == ("MOHAMMED AHMED HUSSAIN", "ABU AHMED") and aliases["M A HUSSAIN"] == ("MOHAMMED AHMED HUSSAIN", None)
    assert {r["list"]: r["status"] for r in sanctions.guard_list_size(entries).collect()} == {"OFAC": "unavailable", "UN": "unavailable"}
    # a list that is too short is no clean result
    matches, status = sanctions.screening(txns, cases, entries)
    assert matches.count() == 0 and [(r["status"], r["exact"]) for r in status.collect()] == [("unavailable", None)]
    many = spark.range(1000).select(F.lit("OFAC").alias("list"), F.concat(F.lit("N-"), "id").alias("entry_id"), F.lit("entity").alias("type"), F.array().cast("array<string>").alias("programs"), F.array(F.struct(F.concat(F.lit("NOBODY "), "id").alias("text"), F.array(F.lit("NOBODY"), F.col("id").cast("string")).alias("tokens"), F.lit(False).alias("is_alias"))).alias("names"))
    matches, status = sanctions.screening(txns, cases, entries.select("list", "entry_id", "type", "programs", "names").unionByName(many).unionByName(many.withColumn("list", F.lit("UN"))))
    assert [(r["status"], r["names"], r["exact"], r["strong"], r["possible"]) for r in status.collect()] == [("complete", 10, 4, 1, 1)]


def test_statement_rows(spark):
    cells = [["My bank statement"], ["Date", "Description", "Debit", "Credit", "Balance"], ["01/02/2024", "KNET POS SHOP", "10.5", "", "89.5"], ["", "", "", "", ""], ["02/02/2024", "salary", "", "1,000", "1089.5"], ["bad", "x", "5", "", ""], ["03/02/2024", "x", "5", "6", ""], ["04/02/2024", "x", "", "", ""]]
    rows = spark.createDataFrame([(1, "s", k, c) for k, c in enumerate(cells)], "file_id long, sheet string, row_index int, cells array<string>")
    maps = normalize.column_maps(normalize.find_header(rows))
    parsed = normalize.parse_rows(rows, maps)
    good = normalize.best_sheet(parsed).where("reason is null").orderBy("row_index").collect()
    assert [(r["posting_date"].isoformat(), r["direction"], r["amount_kwd"], r["channel"], r["running_balance"]) for r in good] == [("2024-02-01", "debit", 10.5, "pos", 89.5), ("2024-02-02", "credit", 1000.0, "salary", 1089.5)]
    assert {r["reason"]: r["n"] for r in normalize.skip_reasons(parsed).collect()} == {"no_date": 1, "both_sides": 1, "no_amount": 1}
    files = spark.createDataFrame([(1, "nbk jan.xlsx", ""), (2, "x.xlsx", "KFHKKWKW"), (3, "plain.csv", None)], "file_id long, filename string, party_banks string").withColumn("label", F.col("filename"))
    assert {r["file_id"]: r["bank"] for r in normalize.infer_bank(files).collect()} == {1: "National Bank of Kuwait", 2: "Kuwait Finance House", 3: "plain"}


def test_declarations(spark):
    form = (
        '{"case_id": 1, "declarant": {"name": " A ", "civil_id": "12", "phone": "+965 9999 8888", "nationality": "Kuwait", "salary": 900}, "sectionsMarkedNone": ["realEstate", "debtsOwed"], '
        '"bankAccountsAndDeposits": [{"institution": "x", "valueKwd": 5, "institutionCountry": "UK", "kind": "a / b"}, {"institution": " ", "valueKwd": 1}, {"institution": "البنك الوطني", "valueKwd": 10000, "kind": "حساب"}], '
        '"realEstate": [{"ownerName": "أحمد محمد فهد", "location": "حطين", "areaSqm": 500, "ownershipPct": 10}, {"ownerName": "سالم", "location": "حطين", "areaSqm": 500}], '
        '"minorChildren": [{"name": "سالم", "idType": "بطاقة مدنية", "idNumber": "٢٨٨٠١٠١٠٠٠٠١"}, {"name": "Bob", "idNumber": "28xxxx"}], "valuableMovables": [{"description": "car", "totalValueKwd": 7, "count": 1}]}'
    )
    import tempfile

    path = tempfile.mkdtemp() + "/f.json"
    with open(path, "w") as f:
        f.write(form)
    forms = declarations.read_declarations(spark, path)
    items = declarations.declaration_items(forms)
    assert {(r["section"], r["row_index"], r["label"]) for r in items.where("section = 'bankAccountsAndDeposits'").collect()} == {("bankAccountsAndDeposits", 0, "x"), ("bankAccountsAndDeposits", 2, "البنك الوطني")}
    left = declarations.flag_uncertain_items(declarations.drop_example_rows(items)).collect()
    assert {(r["section"], r["row_index"], r["uncertain"]) for r in left} == {("bankAccountsAndDeposits", 0, True), ("realEstate", 1, False), ("minorChildren", 0, False), ("valuableMovables", 0, False)}
    assert [r["id_number"] for r in left if r["section"] == "minorChildren"] == ["288010100001"]
    assert [tuple(r) for r in declarations.none_ticks(forms, items).collect()] == [(1, "debtsOwed")]
    person = declarations.flag_uncertain(declarations.declarants(forms)).first()
    assert person["uncertain"] == ["civil_id", "name"] and person["phone"] == "+965 9999 8888"
    assert {(r["section"], r["n"], r["total"]) for r in declarations.section_totals(items.where("value is not null")).collect()} == {("bankAccountsAndDeposits", 2, 10005.0), ("valuableMovables", 1, 7.0)}
    p = declarations.profile_from_declaration(forms).first()
    assert (p["subject_name"], p["income"], p["expected_countries"]) == ("A", 900.0, ["Kuwait", "UK"])
    assert values(spark, ["٢٥/١٢/٢٠٢٠", "2020/1/2", "soon"], declarations.form_date) == ["2020-12-25", "2020-01-02", "soon"]
    assert values(spark, ["+965 9999 8888", "1234"], declarations.kuwait_phone) == ["99998888", None]
    assert values(spark, ["إدارة-أعمال", None], declarations.arabic_key) == ["اداره اعمال", None]


def test_return_loops_query_shows_whole_loops(spark, monkeypatch):
    loop = (("A", "1", "debit"), ("B", "2", "credit"), ("B", "2", "debit"), ("A", "1", "credit"))
    txns = ledger(spark, [(b, a, f"2026-{m:02d}-{1 + k // 2:02d}", d, 5000 * 2**m, None) for m in range(1, 10) for k, (b, a, d) in enumerate(loop)])
    day = lambda i: dt.date(2026, 1 + i // 4, 1 + i % 4 // 2)
    pairs = spark.createDataFrame([(1, i, i + 1, i + 2, 5000.0 * 2 ** (1 + i // 4), day(i), day(i)) for i in range(0, 36, 2)], "case_id long, pair_id long, debit_id long, credit_id long, amount_kwd double, debit_date date, credit_date date")
    monkeypatch.setattr(forensic_queries, "parts", lambda *_: (txns, pairs, None, None))
    found = forensic_queries.t6_return_loops(spark, "").first()
    assert found["metric"] == 9.0 and found["ids"] == ",".join(str(i) for i in range(1, 29))


def test_phones_that_no_subscriber_has(spark):
    people = spark.createDataFrame([(1, "12100002"), (2, "+965 9999 0001"), (3, "1200001"), (4, None)], "case_id long, phone string").selectExpr("*", "cast(null as string) as name", "cast(null as string) as civil_id", "0D as salary")
    marks = lambda **o: {r["case_id"]: r["uncertain"] for r in declarations.flag_uncertain(people, **o).collect()}
    assert marks() == {1: [], 2: [], 3: ["phone"], 4: []}
    assert marks(first="24569") == {1: ["phone"], 2: [], 3: ["phone"], 4: []}


def test_zones_of_shown_values(spark):
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    found = spark.createDataFrame([(1, 2.4996), (2, 2.4994)], "case_id long, z double")
    parties = spark.createDataFrame([(1, 3, 0.6496, 1), (2, 2, 0.9, 0)], "case_id long, parties long, hhi double, fan_in long")
    zones = lambda df: {(r["case_id"], r["key"]): (r["value"], r["zone"]) for r in df.collect()}
    key, hhi = "velocity_burst_z", "counterparty_concentration_hhi"
    assert zones(features.burst_feature(cases, found)) == {(1, key): (2.5, "normal"), (2, key): (2.499, "normal")}
    assert zones(features.burst_feature(cases, found, True)) == {(1, key): (2.5, "elevated"), (2, key): (2.499, "normal")}
    assert zones(features.party_features(cases, parties))[1, hhi] == (0.65, "elevated")
    assert (shown := zones(features.party_features(cases, parties, True)))[1, hhi] == (0.65, "critical") and shown[2, hhi] == (0.0, "gated")


def test_quality_of_a_case_in_any_order(spark):
    rows = [(1, k, q, n) for k, (q, n) in enumerate([(0.1, 3), (0.7, 1), (0.2, 7), (0.61, 1), (0.93, 5)] * 40)]
    files = spark.createDataFrame(rows, "case_id long, file_id long, quality double, rows_parsed long")
    orders = [files.coalesce(1).orderBy(o) for o in ("file_id", F.desc("file_id"), "quality", F.desc("quality"))]
    assert {quality.case_quality(o).first()["quality"] for o in orders} == {sum(round(100 * q) * n for _, _, q, n in rows) / 100 / sum(n for *_, n in rows)}
