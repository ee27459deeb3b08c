"""Seven ledgers with known outcomes, as rows. All names, dates and amounts are fixed values: the outcomes rest on them."""

from __future__ import annotations

import datetime as dt

SCHEMA = "case_id long, id long, file_id long, bank string, account_id string, posting_date date, direction string, amount_kwd double, currency string, channel string, counterparty_name string, counterparty_bank string, counterparty_country string, narrative string"
CASES = "case_id long, subject_name string, income double"
EXPECTED = {
    1: (set(), "Low", 0.0, 0.05),
    2: (set(), "Low", 0.0, 0.05),
    3: ({"R-CASH-01", "R-STRUCT-01", "R-STRUCT-02"}, "Elevated", 0.35, 0.5),
    4: ({"R-FUNNEL-01", "R-LAYER-01", "R-NARR-01"}, "Elevated", 0.2, 0.5),
    5: ({"R-CIRC-01", "R-LAYER-01", "R-LAYER-02", "R-LAYER-03"}, "Elevated", 0.2, 0.5),
    6: ({"R-DORM-01", "R-VEL-01"}, "Moderate", 0.05, 0.2),
    7: ({"R-CASH-01", "R-GEO-01", "R-LAYER-03", "R-STRUCT-01", "R-STRUCT-02"}, "Critical", 0.8, 1.01),
}
SUBJECTS = [(1, "ABDULLA AL HOUTI", 2500.0), (2, "UMM KHALED AL RASHED", 1200.0), (3, "SULTAN AL QASSAR", 1500.0), (4, "SALEM AL AWADHI", 800.0), (5, "BADER AL HAJRI", 2000.0), (6, "MUNIRA AL SALEH", 600.0), (7, "JASSIM AL FARSI", 1200.0)]
PAYERS = (
    "FAISAL AL MUTAIRI", "NOURA AL AJMI", "KHALED AL ENEZI", "MARIAM AL SHAMMARI", "YOUSEF AL RASHIDI", "DALAL AL HARBI", "SAAD AL DHAFEERI", "HESSA AL OTAIBI", "BADER AL AZMI",
    "LULWA AL KANDARI", "TALAL AL SUBAIE", "AISHA AL FADHLI", "NASSER AL MUTAWA", "SARA AL QATTAN", "HAMAD AL BUAIJAN", "GHALIA AL SANEA", "MISHAL AL THUWAINI", "FARAH AL BAHAR",
)


def months(year, month, n):
    return [f"{year + (month - 1 + k) // 12}-{(month - 1 + k) % 12 + 1:02d}" for k in range(n)]


def rows():
    out, ids = [], {}

    def add(case, bank, account, date, direction, amount, channel, narrative=None, name=None, country=None):
        ids[case] = ids.get(case, 0) + 1
        out.append((case, case * 1000 + ids[case], case, bank, account, dt.date.fromisoformat(date), direction, float(amount), "KWD", channel, name, None, country, narrative))

    nbk = ("National Bank of Kuwait", "10001")
    for m in months(2024, 1, 24):
        add(1, *nbk, f"{m}-25", "credit", 2500, "salary", "SALARY PAYMENT ACME ENGINEERING CO", "ACME ENGINEERING CO")
        for d, a, n in (("03", 412.35, "LULU HYPERMARKET SALMIYA"), ("09", 187.1, "SULTAN CENTER FARWANIYA"), ("14", 95.75, "CARREFOUR THE AVENUES")):
            add(1, *nbk, f"{m}-{d}", "debit", a, "pos", f"KNET POS {n}")
        add(1, *nbk, f"{m}-18", "debit", 180.5, "cash_withdrawal", "ATM CASH WITHDRAWAL SALMIYA BRANCH")
        add(1, *nbk, f"{m}-06", "debit", 95.25, "transfer_out", "ELECTRICITY AND WATER BILL MEW", "MINISTRY OF ELECTRICITY AND WATER")
    burgan = ("Burgan Bank", "20002")
    for m in months(2024, 1, 18):
        add(2, *burgan, f"{m}-27", "credit", 1200, "salary", "PENSION PAYMENT PIFSS MONTHLY", "PUBLIC INSTITUTION FOR SOCIAL SECURITY")
        add(2, *burgan, f"{m}-05", "debit", 89.4, "pos", "KNET POS COOP SOCIETY HAWALLI")
        add(2, *burgan, f"{m}-12", "debit", 34.6, "pos", "KNET POS DAWAA PHARMACY")
        add(2, *burgan, f"{m}-15", "debit", 150.25, "cash_withdrawal", "ATM CASH WITHDRAWAL HAWALLI BRANCH")
        add(2, *burgan, f"{m}-20", "debit", 60, "transfer_out", "MONTHLY FAMILY SUPPORT AHMAD", "AHMAD AL RASHED")
    a, b = ("Gulf Bank", "30003"), ("Warba Bank", "30004")
    deposits = [(a, "01-04", 2465.5), (a, "01-16", 2890.5), (a, "01-22", 745.5), (a, "02-03", 2540.25), (a, "02-18", 2610.75), (a, "03-08", 2620.5), (b, "03-08", 2705.25), (a, "03-21", 2480.5), (a, "04-06", 2755.5), (b, "04-25", 2830.25), (a, "05-11", 2590.75), (b, "05-11", 2660.5), (a, "05-27", 2915.25), (a, "06-05", 2585.25), (a, "06-19", 640.75)]
    for where, day, amount in deposits:
        add(3, *where, f"2025-{day}", "credit", amount, "cash_deposit", "CASH DEPOSIT BRANCH COUNTER")
    for m in months(2025, 1, 6):
        add(3, *a, f"{m}-28", "debit", 2400.5, "transfer_out", "MONTHLY TRANSFER TO AL TIJARI EXCHANGE", "AL TIJARI EXCHANGE CO")
    cbk, k = ("Commercial Bank of Kuwait", "40005"), 0
    for m in months(2025, 1, 8):
        for d in ("03", "09", "16", "23"):
            payer = PAYERS[k % len(PAYERS)]
            add(4, *cbk, f"{m}-{d}", "credit", 610.5 + k * 11.25, "transfer_in", f"TRANSFER FROM {payer} INVOICE {1000 + k}", payer)
            k += 1
    for n, (day, amount) in enumerate((("01-12", 1150.5), ("02-12", 1275.25), ("03-12", 1330.75), ("05-12", 1180.25), ("06-12", 1420.5), ("07-12", 1255.75))):
        add(4, *cbk, f"2025-{day}", "credit", amount, "transfer_in", "TRANSFER", PAYERS[n])
    for m, amount in zip(months(2025, 1, 8), (3960.5, 3985.25, 3940.75, 3975.5, 3952.25, 3988.75, 3945.25, 3998.5), strict=True):
        add(4, *cbk, f"{m}-26", "debit", amount, "transfer_out", "TRF", "COLLECTOR GENERAL TRADING CO")
    a, b = ("Gulf Bank", "50006"), ("Boubyan Bank", "50007")
    for m, feed, leave, shell in zip(months(2025, 1, 4), (5037.5, 5075.25, 5112.75, 5150.5), (4936.75, 4973.75, 5010.5, 5047.5), ("ONE", "TWO", "THREE", "FOUR"), strict=True):
        add(5, *a, f"{m}-06", "credit", feed, "transfer_in", f"INCOMING SWIFT TRANSFER SHELLCORP {shell} FZE CONSULTING FEES", f"SHELLCORP {shell} FZE")
        add(5, *a, f"{m}-07", "debit", feed, "transfer_out", "TRANSFER TO OWN ACCOUNT BOUBYAN")
        add(5, *b, f"{m}-08", "credit", feed, "transfer_in", "TRANSFER FROM OWN ACCOUNT GULF BANK")
        add(5, *b, f"{m}-09", "debit", leave, "transfer_out", "OUTGOING TRANSFER EXIT GENERAL TRADING", "EXIT GENERAL TRADING CO")
    add(5, *a, "2025-05-10", "debit", 45.5, "pos", "KNET POS SULTAN CENTER")
    add(5, *a, "2025-05-20", "debit", 62.25, "pos", "KNET POS LULU HYPERMARKET")
    nbk = ("National Bank of Kuwait", "60008")
    for m in months(2024, 1, 3):
        add(6, *nbk, f"{m}-10", "credit", 300.5, "transfer_in", "FAMILY SUPPORT KHALED", "KHALED AL DABBOUS")
        add(6, *nbk, f"{m}-15", "debit", 120.25, "pos", "KNET POS COOP SOCIETY")
    for day, d, amount, channel, text, name in (
        ("01", "credit", 1850.5, "transfer_in", "INCOMING TRANSFER OMAR URGENT", "OMAR AL SHATTI"), ("04", "credit", 2240.25, "transfer_in", "INCOMING TRANSFER REEM URGENT", "REEM AL BAGHLI"),
        ("05", "debit", 1650.5, "cash_withdrawal", "ATM CASH WITHDRAWAL FAHAHEEL", None), ("08", "credit", 1780.75, "transfer_in", "INCOMING TRANSFER SALEH URGENT", "SALEH AL QALLAF"),
        ("09", "debit", 1900.25, "cash_withdrawal", "ATM CASH WITHDRAWAL FAHAHEEL", None), ("11", "credit", 2005.5, "transfer_in", "INCOMING TRANSFER HUDA URGENT", "HUDA AL MULLA"),
        ("13", "debit", 2100.75, "transfer_out", "TRANSFER TO EXCHANGE HOUSE", "GOLDEN EXCHANGE CO"), ("16", "debit", 1950.5, "transfer_out", "TRANSFER TO EXCHANGE HOUSE", "GOLDEN EXCHANGE CO"),
    ):
        add(6, *nbk, f"2024-11-{day}", d, amount, channel, text, name)
    a, b, c = ("Gulf Bank", "70009"), ("Warba Bank", "70010"), ("Boubyan Bank", "70011")
    for where, day, amount in [(a, "01-05", 2610.5), (a, "01-19", 2885.25), (a, "02-04", 2540.75), (a, "02-17", 2760.5), (a, "03-09", 2650.25), (b, "03-09", 2725.5), (a, "04-07", 2590.75), (a, "05-12", 2680.25), (b, "05-12", 2755.75), (a, "06-06", 2870.5)]:
        add(7, *where, f"2025-{day}", "credit", amount, "cash_deposit", "CASH DEPOSIT BRANCH COUNTER")
    for m, feed, leave, shell in (("2025-02", 4850.5, 4753.5, "REGIONAL PARTNERS LLC"), ("2025-04", 4790.25, 4694.25, "LEVANT HOLDINGS SAL")):
        add(7, *a, f"{m}-20", "credit", feed, "transfer_in", f"INCOMING SWIFT TRANSFER {shell}", shell, "LEBANON")
        add(7, *a, f"{m}-21", "debit", feed, "transfer_out", "TRANSFER TO OWN ACCOUNT BOUBYAN")
        add(7, *c, f"{m}-22", "credit", feed, "transfer_in", "TRANSFER FROM OWN ACCOUNT GULF BANK")
        add(7, *c, f"{m}-23", "debit", leave, "transfer_out", "OUTGOING TRANSFER BEIRUT TRADING HOUSE", "BEIRUT TRADING HOUSE", "LEBANON")
    for m in months(2025, 1, 6):
        add(7, *a, f"{m}-26", "debit", 3200.5, "transfer_out", "MONTHLY TRANSFER AL DIRWAZA EXCHANGE", "AL DIRWAZA EXCHANGE CO")
    return out
