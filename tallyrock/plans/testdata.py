"""The driver's tables as a ledger: the same view in DataFrame code and in SQL.

Credits come from orders, debits from line items, and every twentieth order's first debit has
a mirrored credit a day later at the next bank; those mirrors are ``declared_pairs``. Every
sixtieth order's comes back a week later, and every hundredth order's has a feeding credit before
and a debit after it. The case's last figure gives it a habit: 4 rare large amounts, 5 a rise
from 1996 on, 6 one large payee, 7 two banks with roles of their own, 9 a single bank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER_COLUMNS = ("case_id", "id", "file_id", "bank", "account_id", "posting_date", "direction", "amount_kwd", "currency", "channel", "counterparty_name", "counterparty_bank", "counterparty_country", "narrative")
NARRATIVES = (None, "TRANSFER", "Own account transfer", "Binance purchase of coins", "Payment for invoice services rendered", "Monthly salary and bonus", "misc 42")
CREDIT_CHANNELS = ("cash_deposit", "transfer_in", "salary", "other", "cheque")
DEBIT_CHANNELS = ("cash_withdrawal", "transfer_out", "pos", "fee")
PAYEE = "NORTH STAR HOLDING"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple, key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(list(enumerate(values))):
        if v is not None:
            out = F.when(key == k, v).otherwise(out)
    return out


def _country(nation: Column) -> Column:
    return F.when(nation == 0, "LEBANON").when(nation == 1, " iran ").when(nation < 20, "KUWAIT")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    base = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_date"), "o_totalprice", "o_orderpriority")
    key = F.col("o_orderkey")
    customers = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    common = lambda k: {"bank": F.concat(F.lit("BANK_"), (k % 5).cast("string")), "account_id": (F.col("o_custkey") % 3).cast("string")}
    credits = base.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").withColumns(
        common(key)
        | {
            "case_id": F.floor(F.col("o_custkey") / 15).cast("long"), "id": (key * 1000).cast("long"), "posting_date": F.col("o_date"), "direction": F.lit("credit"),
            "amount_kwd": F.floor(F.col("o_totalprice") + 0.5) / 100, "channel": _pick(CREDIT_CHANNELS, F.substring("o_orderpriority", 1, 1).cast("int") - 1),
            "counterparty_name": F.col("c_name"), "counterparty_bank": F.when(key % 11 == 0, F.concat(F.lit("Bank_"), (key % 3).cast("string"))),
            "counterparty_country": _country(F.col("c_nationkey")), "narrative": _pick(NARRATIVES, key % 7),
        }
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    items = _read(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_name")
    suppliers = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    items = items.join(base, F.col("l_orderkey") == key).join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    words = F.split(F.upper("p_name"), " ")
    second = F.get(words, F.lit(1))
    named = F.when((F.col("l_partkey") % 2 == 1) & second.isNotNull(), F.concat(F.get(words, F.lit(0)), F.lit(" "), F.substr(second, F.lit(1), F.lit(1)))).otherwise(F.upper("p_name"))
    supplier = F.col("l_suppkey")
    kind = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).when(F.col("l_linestatus") == "F", 2).otherwise(F.when(F.col("l_suppkey") % 2 == 0, 2).otherwise(3))
    debits = items.withColumns(
        common(supplier)
        | {
            "case_id": F.floor(F.col("o_custkey") / 15).cast("long"), "id": (F.col("l_orderkey") * 1000 + F.col("n")).cast("long"), "posting_date": F.col("l_shipdate").cast("date"),
            "direction": F.lit("debit"), "amount_kwd": F.floor(F.col("l_extendedprice") * 5 + 0.5) / 100, "channel": _pick(DEBIT_CHANNELS, kind),
            "counterparty_name": named, "counterparty_bank": F.when(supplier % 7 == 0, F.concat(F.lit("Bank_"), (supplier % 5).cast("string"))),
            "counterparty_country": _country(F.col("s_nationkey")), "narrative": _pick(NARRATIVES, (F.col("l_orderkey") + F.col("n")) % 7),
        }
    )
    habit = F.col("case_id") % 10
    raised = F.when((habit == 4) & (F.col("id") % 97 == 0), 40.0).when((habit == 5) & (F.col("posting_date") >= F.lit("1996-01-01").cast("date")), 6.0).otherwise(1.0)
    credits, debits = (df.withColumn("amount_kwd", F.col("amount_kwd") * raised) for df in (credits, debits))
    debits = debits.withColumn("counterparty_name", F.when((habit == 6) & (F.floor(F.col("id") / 1000) % 5 < 3), PAYEE).otherwise(F.col("counterparty_name")))
    here, there = F.concat(F.lit("BANK_"), (supplier % 5).cast("string")), F.concat(F.lit("BANK_"), ((supplier + 1) % 5).cast("string"))
    own = F.when(F.col("l_orderkey") % 40 == 0, "Own account transfer").otherwise("Payment for invoice services rendered")

    def also(every: int, by: int, days: int, direction: str, channel: str, bank: Column, text: Column, times: float = 1.0) -> Column:
        row = F.struct(F.lit(by).alias("by"), F.lit(days).alias("days"), F.lit(direction).alias("direction"), F.lit(channel).alias("channel"), bank.alias("bank"), text.alias("narrative"), F.lit(times).alias("times"))
        return F.when((F.col("l_orderkey") % every == 0) & (F.col("n") == 1), row)

    invoice = F.lit("Payment for invoice services rendered")
    made = F.array(
        also(20, 500, 1, "credit", "transfer_in", there, own), also(60, 100, 7, "debit", "transfer_out", there, own), also(60, 600, 8, "credit", "transfer_in", here, own),
        also(100, 200, -1, "credit", "transfer_in", here, invoice, 1.02), also(100, 300, 2, "debit", "transfer_out", there, invoice, 0.97),
    )
    kept = [c for c in LEDGER_COLUMNS if c in credits.columns]
    # only the first items of every twentieth order have more rows, so that most rows pass no list
    moved = debits.where((F.col("l_orderkey") % 20 == 0) & (F.col("n") == 1)).select(*[c for c in kept if c not in ("direction", "channel", "bank", "narrative")], F.inline(F.filter(made, lambda m: m.isNotNull())))
    moved = moved.withColumns({"id": F.col("id") + F.col("by"), "posting_date": F.date_add("posting_date", F.col("days")), "amount_kwd": F.col("amount_kwd") * F.col("times")})
    rows = credits.select(*kept).unionByName(debits.select(*kept)).unionByName(moved.select(*kept))
    into, last = F.col("direction") == "credit", F.substring("bank", 6, 1)
    role = F.when(last == "1", F.when(into, "cash_deposit").otherwise("transfer_out")).when(last == "2", F.when(into, "transfer_in").otherwise("cash_withdrawal"))
    rows = rows.withColumn("bank", F.when(habit == 9, "BANK_0").otherwise(F.col("bank"))).withColumn("channel", F.coalesce(F.when(habit == 7, role), F.col("channel")))
    return rows.withColumns({"file_id": F.col("case_id") * 10 + last.cast("long"), "currency": F.when(F.col("id") % 13 == 0, "USD").otherwise("KWD")}).select(*LEDGER_COLUMNS)


def declared_pairs(txns: DataFrame) -> DataFrame:
    """(case_id, pair_id, debit_id, credit_id, amount_kwd, from_bank, to_bank, debit_date, credit_date) of the mirrors."""
    mirrors = txns.where("direction = 'credit' and id % 1000 > 500").select("case_id", F.col("id").alias("credit_id"), (F.col("id") - 500).alias("debit_id"), F.col("bank").alias("to_bank"), F.col("posting_date").alias("credit_date"))
    # only every twentieth order has mirrors
    debits = txns.where("direction = 'debit' and floor(id / 1000) % 20 = 0").select("case_id", F.col("id").alias("debit_id"), "amount_kwd", F.col("bank").alias("from_bank"), F.col("posting_date").alias("debit_date"))
    return mirrors.join(debits, ["case_id", "debit_id"]).withColumn("pair_id", F.col("debit_id"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for each case: a subject of the first customer's name, income unknown for every seventh."""
    found = _read(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 15).cast("long").alias("case_id")).agg(F.min("c_name").alias("subject_name"))
    return found.withColumn("income", F.when(F.col("case_id") % 7 != 0, (800 + (F.col("case_id") % 10) * 150).cast("double")))


def _case_sql(values: tuple, key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {k} THEN '{v}'" for k, v in enumerate(values) if v is not None) + " END"


_COUNTRY = "CASE WHEN {0} = 0 THEN 'LEBANON' WHEN {0} = 1 THEN ' iran ' WHEN {0} < 20 THEN 'KUWAIT' END"
_RAISED = "* CASE WHEN case_id % 10 = 4 AND id % 97 = 0 THEN 40.0::DOUBLE WHEN case_id % 10 = 5 AND posting_date >= DATE '1996-01-01' THEN 6.0::DOUBLE ELSE 1.0::DOUBLE END"
_OWN = "CASE WHEN l_orderkey % 40 = 0 THEN 'Own account transfer' ELSE 'Payment for invoice services rendered' END"
_HERE, _THERE, _INVOICE = "'BANK_' || (l_suppkey % 5)", "'BANK_' || ((l_suppkey + 1) % 5)", "'Payment for invoice services rendered'"


def _more(every: int, by: int, days: int, direction: str, channel: str, bank: str, text: str, times: float = 1.0) -> str:
    return (
        f"SELECT case_id, id + {by}, {bank}, account_id, posting_date + {days}, '{direction}', amount_kwd * {times}::DOUBLE, '{channel}', counterparty_name, counterparty_bank, counterparty_country, {text}"
        f" FROM debits WHERE l_orderkey % {every} = 0 AND n = 1"
    )


LEDGER_SQL = f"""
raw_items AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS n FROM lineitem),
plain_debits AS (
  SELECT o_custkey // 15 AS case_id, l_orderkey * 1000 + n AS id, {_HERE} AS bank, CAST(o_custkey % 3 AS VARCHAR) AS account_id, CAST(l_shipdate AS DATE) AS posting_date,
    'debit' AS direction, floor(l_extendedprice * 5 + 0.5) / 100 AS amount_kwd,
    {_case_sql(DEBIT_CHANNELS, "(CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 WHEN l_linestatus = 'F' THEN 2 WHEN l_suppkey % 2 = 0 THEN 2 ELSE 3 END)")} AS channel,
    CASE WHEN l_partkey % 2 = 1 AND p_name LIKE '% %' THEN split_part(upper(p_name), ' ', 1) || ' ' || substr(split_part(upper(p_name), ' ', 2), 1, 1) ELSE upper(p_name) END AS counterparty_name,
    CASE WHEN l_suppkey % 7 = 0 THEN 'Bank_' || (l_suppkey % 5) END AS counterparty_bank,
    {_COUNTRY.format("s_nationkey")} AS counterparty_country, {_case_sql(NARRATIVES, "(l_orderkey + n) % 7")} AS narrative, l_orderkey, l_suppkey, n
  FROM raw_items JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey),
debits AS (SELECT * REPLACE (amount_kwd {_RAISED} AS amount_kwd, CASE WHEN case_id % 10 = 6 AND id // 1000 % 5 < 3 THEN '{PAYEE}' ELSE counterparty_name END AS counterparty_name) FROM plain_debits),
credits AS (
  SELECT o_custkey // 15 AS case_id, o_orderkey * 1000 AS id, 'BANK_' || (o_orderkey % 5) AS bank, CAST(o_custkey % 3 AS VARCHAR) AS account_id, CAST(o_orderdate AS DATE) AS posting_date,
    'credit' AS direction, floor(o_totalprice + 0.5) / 100 AS amount_kwd, {_case_sql(CREDIT_CHANNELS, "(CAST(substr(o_orderpriority, 1, 1) AS INT) - 1)")} AS channel, c_name AS counterparty_name,
    CASE WHEN o_orderkey % 11 = 0 THEN 'Bank_' || (o_orderkey % 3) END AS counterparty_bank, {_COUNTRY.format("c_nationkey")} AS counterparty_country, {_case_sql(NARRATIVES, "o_orderkey % 7")} AS narrative
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
unfiled AS (
  SELECT * REPLACE (amount_kwd {_RAISED} AS amount_kwd) FROM credits
  UNION ALL SELECT case_id, id, bank, account_id, posting_date, direction, amount_kwd, channel, counterparty_name, counterparty_bank, counterparty_country, narrative FROM debits
  UNION ALL {_more(20, 500, 1, "credit", "transfer_in", _THERE, _OWN)}
  UNION ALL {_more(60, 100, 7, "debit", "transfer_out", _THERE, _OWN)}
  UNION ALL {_more(60, 600, 8, "credit", "transfer_in", _HERE, _OWN)}
  UNION ALL {_more(100, 200, -1, "credit", "transfer_in", _HERE, _INVOICE, 1.02)}
  UNION ALL {_more(100, 300, 2, "debit", "transfer_out", _THERE, _INVOICE, 0.97)}),
placed AS (SELECT * REPLACE (CASE WHEN case_id % 10 = 9 THEN 'BANK_0' ELSE bank END AS bank) FROM unfiled),
ledger AS (
  SELECT * REPLACE (CASE WHEN case_id % 10 = 7 AND bank = 'BANK_1' THEN CASE direction WHEN 'credit' THEN 'cash_deposit' ELSE 'transfer_out' END
    WHEN case_id % 10 = 7 AND bank = 'BANK_2' THEN CASE direction WHEN 'credit' THEN 'transfer_in' ELSE 'cash_withdrawal' END ELSE channel END AS channel),
    case_id * 10 + CAST(substr(bank, 6, 1) AS BIGINT) AS file_id, CASE WHEN id % 13 = 0 THEN 'USD' ELSE 'KWD' END AS currency FROM placed),
pairs AS (
  SELECT c.case_id, d.id AS debit_id, c.id AS credit_id, d.amount_kwd, d.bank AS from_bank, c.bank AS to_bank, d.posting_date AS debit_date, c.posting_date AS credit_date
  FROM (SELECT *, id - 500 AS mirrored FROM ledger WHERE direction = 'credit' AND id % 1000 > 500) c JOIN (SELECT * FROM ledger WHERE direction = 'debit') d ON d.id = c.mirrored AND d.case_id = c.case_id),
legs AS (SELECT debit_id AS id FROM pairs UNION ALL SELECT credit_id FROM pairs),
ext AS (SELECT * FROM ledger ANTI JOIN legs USING (id)),
cases AS (SELECT c_custkey // 15 AS case_id, min(c_name) AS subject_name, CASE WHEN c_custkey // 15 % 7 <> 0 THEN CAST(800 + (c_custkey // 15 % 10) * 150 AS DOUBLE) END AS income FROM customer GROUP BY c_custkey // 15)"""


def _over(tables: str, sql: str) -> str:
    """``sql``, which may have a WITH of its own, over more common tables."""
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return start + tables.strip() + ", " + body[len(start) :]
    return "WITH " + tables.strip() + "\n" + body


def with_ledger(sql: str) -> str:
    """A query over the view's tables ledger, pairs, ext and cases."""
    return _over(LEDGER_SQL, sql)


RULE_IDS = ("R-GEO-01", "R-VEL-01", "R-CASH-01")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored runs, one for each customer: two of three hits fired by the key's remainders."""
    k = F.col("c_custkey")
    hits = F.array(*[F.struct(F.lit(r).alias("rule_id"), (k % (n + 2) == 0).alias("fired"), (F.lit(0.5) + (k % 3) * 0.25).alias("weight")) for n, r in enumerate(RULE_IDS)])
    p = F.floor((F.col("c_acctbal") + 1000) / 11000 * 9000 + 0.5) / 10000
    values = F.array(F.struct(F.lit("cash_share").alias("key"), (F.col("c_nationkey") / 25.0).alias("value")), F.struct(F.lit("fan_in_count").alias("key"), (k % 40).cast("double").alias("value")))
    band = F.when(p < 0.05, "Low").when(p < 0.2, "Moderate").when(p < 0.5, "Elevated").when(p < 0.8, "High").otherwise("Critical")
    made = _read(spark, sf_dir, "customer")
    return made.select(k.alias("id"), F.floor(k / 15).cast("long").alias("case_id"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 97).cast("int")).alias("created_at"), p.alias("probability"), band.alias("band"), hits.alias("rule_hits"), values.alias("features"))


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    decision = F.when(k % 9 == 0, "escalate").when(k % 9 == 3, "watchlist").otherwise("close")
    return _read(spark, sf_dir, "customer").where(k % 3 == 0).select(k.alias("id"), k.alias("run_id"), decision.alias("decision"), F.date_add(F.lit("2024-05-01").cast("date"), (k % 11).cast("int")).alias("created_at"))


_P = "floor((c_acctbal + 1000) / 11000 * 9000 + 0.5) / 10000"
RUNS_SQL = f"""
runs AS (SELECT c_custkey AS id, c_custkey // 15 AS case_id, DATE '2024-01-01' + CAST(c_custkey % 97 AS INT) AS created_at, {_P} AS probability,
 CASE WHEN {_P} < 0.05 THEN 'Low' WHEN {_P} < 0.2 THEN 'Moderate' WHEN {_P} < 0.5 THEN 'Elevated' WHEN {_P} < 0.8 THEN 'High' ELSE 'Critical' END AS band, c_nationkey / 25.0 AS cash_share, CAST(c_custkey % 40 AS DOUBLE) AS fan_in FROM customer),
hits AS ({" UNION ALL ".join(f"SELECT c_custkey AS run_id, c_custkey // 15 AS case_id, '{r}' AS rule_id, c_custkey % {n + 2} = 0 AS fired, 0.5 + (c_custkey % 3) * 0.25 AS weight FROM customer" for n, r in enumerate(RULE_IDS))}),
latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, id DESC) = 1),
dispositions AS (SELECT c_custkey AS id, c_custkey AS run_id, CASE WHEN c_custkey % 9 = 0 THEN 'escalate' WHEN c_custkey % 9 = 3 THEN 'watchlist' ELSE 'close' END AS decision, DATE '2024-05-01' + CAST(c_custkey % 11 AS INT) AS created_at FROM customer WHERE c_custkey % 3 = 0)"""


def with_runs(sql: str) -> str:
    return _over(LEDGER_SQL.strip() + ", " + RUNS_SQL.strip(), sql)


#: Banks of the statements by the ledger's last figure; the last is none that a name tells.
STATEMENT_BANKS = ("boubyan", "nbk", "kfh", "gulf", "other")
WIDE = 51


def _places(amount: Column) -> Column:
    return (F.floor(amount * 1000 + 0.5) / 1000).cast("decimal(20,3)")


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(statement, k, line): the ledger as bank statements of three layouts, line ``k`` of each.

    Comma: debit and credit columns below a title. Semicolon: an indicator, and both amounts. Tab: signed amounts
    behind 51 columns that say nothing. Every fiftieth row is followed by one without a date, every seventieth by one
    that is no payment.
    """
    rows = ledger(spark, sf_dir).withColumn("layout", F.col("file_id") % 3)
    bad = F.array(F.lit(0), F.when(F.col("id") % 50 == 0, 1), F.when(F.col("id") % 70 == 0, 2))
    rows = rows.withColumn("bad", F.explode(F.array_compact(bad)))
    bank = _pick(STATEMENT_BANKS, F.col("file_id") % 10)
    heads = F.when(F.col("layout") == 0, 2).otherwise(1)
    rows = rows.withColumn("statement", F.concat(bank, F.lit("-"), F.col("file_id").cast("string")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("statement").orderBy("posting_date", "id", "bad")) - 1 + heads)
    into, none, foreign = F.col("direction") == "credit", F.lit(""), F.col("currency") == "USD"
    text = lambda c: F.coalesce(F.col(c), none)
    money = _places(F.col("amount_kwd"))
    grouped = F.concat(F.lit('"'), F.format_number(money, 3), F.lit('"'))
    day = lambda f: F.when(F.col("bad") == 1, "n/a").otherwise(F.date_format("posting_date", f))
    unpaid = F.col("bad") == 2
    comma = F.concat_ws(",", day("dd/MM/yyyy"), text("narrative"), F.when(~into | unpaid, grouped).otherwise(none), F.when(into | unpaid, grouped).otherwise(none), "currency", "account_id", text("counterparty_name"), text("counterparty_bank"), text("counterparty_country"))
    other = F.when(unpaid, "0").otherwise(F.when(foreign, _places(F.col("amount_kwd") / 0.307)).otherwise(money).cast("string"))
    value = F.when(unpaid, "0").otherwise(money.cast("string"))
    names = [F.when(into == side, text(c)).otherwise(none) for c in ("counterparty_name", "counterparty_bank", "counterparty_country") for side in (True, False)]
    semicolon = F.concat_ws(";", day("yyyy-MM-dd"), F.when(into, "C").otherwise("D"), other, value, "currency", *names, text("narrative"), "account_id")
    signed = F.when(unpaid, "0").otherwise(F.when(into, money.cast("string")).otherwise(F.concat(F.lit("("), money.cast("string"), F.lit(")"))))
    tab = F.concat_ws("\t", day("dd MMM yyyy"), *[F.lit("-")] * WIDE, signed, "currency", text("narrative"), "account_id", text("counterparty_name"), text("counterparty_bank"), text("counterparty_country"))
    body = rows.select("statement", "layout", "k", F.when(F.col("layout") == 0, comma).when(F.col("layout") == 1, semicolon).otherwise(tab).alias("line"))
    first = {
        0: ["Statement of account", "Posting Date,Description,Debit,Credit,Currency,Account No,Counterparty,Counterparty Bank,Counterparty Country"],
        1: ["Txn Date;D/C;Amount;Amount KWD;CCY;Sender Name;Beneficiary Name;Sender Bank;Receiver Bank;Ordering Country;Benef Country;Details;Account Number"],
        2: ["\t".join(["Transaction Date", *[f"X{k}" for k in range(WIDE)], "Amount", "Currency", "Remarks", "Account ID", "Payee", "Bank", "Country"])],
    }
    # the first row of a statement brings the lines above it, so that the ledger is read once
    lines = F.array(F.struct("k", "line"))
    for k, texts in first.items():
        above = F.array(*[F.struct(F.lit(n).alias("k"), F.lit(t).alias("line")) for n, t in enumerate(texts)])
        lines = F.when((F.col("layout") == k) & (F.col("k") == len(texts)), F.concat(above, F.array(F.struct("k", "line")))).otherwise(lines)
    return body.select("statement", F.inline(lines))


def write_statements(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The statements in bundles, as ``read_statement_rows`` takes them: each in one file, its lines in order, behind its name."""
    # the window that numbers a statement's lines leaves them together and in order
    statement_lines(spark, sf_dir).select(F.concat_ws("\t", "statement", "line").alias("value")).write.text(path)


_BANK_OF = "CASE " + " ".join(f"WHEN file_id % 10 = {k} THEN '{b}'" for k, b in enumerate(STATEMENT_BANKS)) + " END"
STATEMENTS_SQL = f"""
lines AS (
  SELECT *, {_BANK_OF} || '-' || file_id AS statement, CAST(CAST(floor(amount_kwd * 1000 + 0.5) / 1000 AS DECIMAL(20,3)) AS DOUBLE) AS value,
    CAST(CAST(floor(amount_kwd / 0.307 * 1000 + 0.5) / 1000 AS DECIMAL(20,3)) AS DOUBLE) AS usd,
    row_number() OVER (PARTITION BY file_id ORDER BY posting_date, id, bad) - 1 + CASE WHEN file_id % 3 = 0 THEN 2 ELSE 1 END AS k
  FROM (SELECT *, unnest(list_filter([0, CASE WHEN id % 50 = 0 THEN 1 END, CASE WHEN id % 70 = 0 THEN 2 END], lambda x: x IS NOT NULL)) AS bad FROM ledger)),
statements AS (
  SELECT l.*, CASE WHEN file_id % 3 = 1 AND currency = 'USD' THEN usd ELSE value END AS paid, CASE WHEN file_id % 3 <> 1 AND currency = 'USD' THEN value * 0.307::DOUBLE ELSE value END AS kwd,
    CASE WHEN counterparty_name <> subject_name OR subject_name IS NULL THEN counterparty_name END AS party,
    CASE file_id % 10 WHEN 0 THEN 'Boubyan Bank' WHEN 1 THEN 'National Bank of Kuwait' WHEN 2 THEN 'Kuwait Finance House' WHEN 3 THEN 'Gulf Bank' ELSE statement END AS label
  FROM lines l LEFT JOIN cases USING (case_id))"""


def with_statements(sql: str) -> str:
    """A query over the view's tables and ``statements``, the rows that statements of it hold."""
    return _over(LEDGER_SQL.strip() + "," + STATEMENTS_SQL, sql)


ISSUES = ("No running-balance column: completeness cannot be verified.", "3 balance reconciliation breaks across 20 checked rows", "2 potential duplicate rows")


def reported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger, and every fiftieth row once more as a row of another file."""
    return reported(ledger(spark, sf_dir))


def reported(txns: DataFrame) -> DataFrame:
    """The rows of ``reported_rows``; the ledger is read once for both files."""
    more = F.when(F.col("id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = txns.withColumn("_copy", F.explode(more))
    return rows.withColumns({"file_id": F.col("file_id") + 5 * F.col("_copy"), "id": F.col("id") + 700_000_000_000 * F.col("_copy")}).drop("_copy")


def bank_files(rows: DataFrame) -> DataFrame:
    """Reports of the files of ``reported_rows``; quality, skipped rows and issues follow from the file's number."""
    k = F.col("file_id")
    found = rows.groupBy("case_id", "file_id").agg(
        F.min("bank").alias("bank"), F.count(F.lit(1)).alias("rows_parsed"), F.min("posting_date").alias("period_start"), F.max("posting_date").alias("period_end"), F.sort_array(F.collect_set("account_id")).alias("accounts")
    )
    issues = F.filter(F.array(*[F.when(k % 4 == n, i) for n, i in enumerate(ISSUES)]), lambda x: x.isNotNull())
    return found.withColumns({"filename": F.concat(F.lit("file-"), k.cast("string")), "rows_skipped": k % 9, "quality": (F.lit(55) + k % 41) / 100, "issues": issues})


FILES_SQL = f"""
reported AS (SELECT * FROM ledger UNION ALL SELECT * REPLACE (file_id + 5 AS file_id, id + 700000000000 AS id) FROM ledger WHERE id % 50 = 0),
files AS (SELECT case_id, file_id, min(bank) AS bank, count(*) AS rows_parsed, min(posting_date) AS period_start, max(posting_date) AS period_end, list_sort(list(DISTINCT account_id)) AS accounts, 'file-' || file_id AS filename,
  file_id % 9 AS rows_skipped, (55 + file_id % 41) / 100 AS quality, CASE file_id % 4 {" ".join(f"WHEN {n} THEN '{i}'" for n, i in enumerate(ISSUES))} END AS issue FROM reported GROUP BY case_id, file_id)"""


def with_files(sql: str) -> str:
    """A query over the view's tables, ``reported`` rows and ``files``."""
    return _over(LEDGER_SQL.strip() + "," + FILES_SQL, sql)
