"""Queries on views, portfolio and quality over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrock.constants import FX_TO_KWD, PATTERNS
from tallyrock.functions import names, narrative
from tallyrock.operators import features as ft
from tallyrock.operators import quality as dq
from tallyrock.operators import views
from tallyrock.plans import jobs
from tallyrock.plans import testdata as td
from tallyrock.queries import ORACLES, QUERIES, TRANSFERISH, listed, money, parts, query, r3, written  # noqa: F401
from tallyrock.sources.shared import cut

VIEW_SUMS = f"{money("CASE WHEN direction = 'credit' THEN amount_kwd END")} AS credits, {money("CASE WHEN direction = 'debit' THEN amount_kwd END")} AS debits, {money("CASE WHEN channel = 'cash_deposit' THEN amount_kwd END")} AS cash_in, {money("CASE WHEN channel = 'cash_withdrawal' THEN amount_kwd END")} AS cash_out, count(*) AS n"


def run_query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = td.with_runs(sql)
        return f

    return add


@query(f"SELECT case_id, strftime(posting_date, '%Y-%m') AS month, bank, {VIEW_SUMS} FROM ledger GROUP BY ALL")
def r6_timeline(spark, sf_dir):
    return views.timeline(td.ledger(spark, sf_dir))


MONTHLY = f"SELECT case_id, strftime(posting_date, '%Y-%m') AS month, {VIEW_SUMS} FROM ledger GROUP BY ALL"


@query(MONTHLY)
def r7_monthly_flows(spark, sf_dir):
    return views.monthly_flows(td.ledger(spark, sf_dir))


@query(f"""WITH m AS ({MONTHLY}) SELECT case_id, substr(month, 1, 4) || '-Q' || CAST(ceil(CAST(substr(month, 6, 2) AS INT) / 3) AS INT) AS quarter, {money('credits')} AS credits, {money('debits')} AS debits,
 arg_max(month, struct_pack(c := credits, m := month)) AS peak_month, coalesce({money('cash_in')} / nullif({money('credits')}, 0), 0.0) AS cash_share, CAST(sum(n) AS BIGINT) AS n FROM m WHERE case_id IN (SELECT case_id FROM m GROUP BY case_id HAVING count(*) > 30) GROUP BY ALL""")
def r8_quarterly_flows(spark, sf_dir):
    return views.quarterly_flows(views.monthly_flows(td.ledger(spark, sf_dir)))


@query(f"SELECT case_id, channel, direction, count(*) AS n, {money('amount_kwd')} AS value FROM ledger GROUP BY ALL")
def r9_channel_mix(spark, sf_dir):
    return views.channel_mix(td.ledger(spark, sf_dir))


def own_cluster(txns):
    """Counterparties by their spelling alone, which SQL can follow."""
    return txns.withColumn("cluster", F.col("counterparty_name"))


ENDS = """e AS (SELECT *, concat_ws('|', 'acct', bank, account_id) AS account, CASE WHEN channel IN ('cash_deposit', 'cash_withdrawal') THEN 'cash' WHEN counterparty_name IS NOT NULL THEN 'cp|' || counterparty_name END AS other FROM ledger)"""


@query(f"""WITH {ENDS}, s AS (SELECT case_id, account AS node, direction = 'credit' AS i, amount_kwd FROM e UNION ALL SELECT case_id, other, direction = 'debit', amount_kwd FROM e WHERE other IS NOT NULL)
SELECT case_id, node, {money('CASE WHEN i THEN amount_kwd END')} AS inflow, {money('CASE WHEN NOT i THEN amount_kwd END')} AS outflow, count(*) AS n FROM s GROUP BY ALL""")
def r10_network_nodes(spark, sf_dir):
    return views.network_nodes(own_cluster(td.ledger(spark, sf_dir))).select("case_id", "node", "inflow", "outflow", "n")


EDGES = f"""{ENDS}, f AS (SELECT e.*, p.debit_id AS pair FROM e LEFT JOIN (SELECT debit_id AS leg, debit_id FROM pairs UNION ALL SELECT credit_id, debit_id FROM pairs) p ON e.id = p.leg),
x AS (SELECT case_id, CASE WHEN direction = 'credit' THEN other ELSE account END AS source, CASE WHEN direction = 'credit' THEN account ELSE other END AS target, amount_kwd FROM f WHERE pair IS NULL),
y AS (SELECT case_id, pair, max(CASE WHEN direction = 'debit' THEN account END) AS source, max(CASE WHEN direction = 'credit' THEN account END) AS target, max(amount_kwd) AS v FROM f WHERE pair IS NOT NULL GROUP BY ALL),
edges AS (SELECT case_id, source, target, 'flow' AS kind, {money('amount_kwd')} AS value, count(*) AS n FROM x WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL
UNION ALL SELECT case_id, source, target, 'internal', {money('v')}, count(*) FROM y GROUP BY ALL)"""


@query(f"WITH {EDGES} SELECT case_id, source, target, kind, value, n FROM edges")
def r11_network_edges(spark, sf_dir):
    txns, pairs, _, _ = parts(spark, sf_dir)
    return views.network_edges(own_cluster(txns), pairs)


@query(f"""WITH {EDGES}, s AS (SELECT case_id, account AS node, direction = 'credit' AS i, amount_kwd FROM e UNION ALL SELECT case_id, other, direction = 'debit', amount_kwd FROM e WHERE other IS NOT NULL),
nodes AS (SELECT case_id, node, node LIKE 'cp|%' AS cp, {money('CASE WHEN i THEN amount_kwd END')} AS inflow, {money('CASE WHEN NOT i THEN amount_kwd END')} AS outflow FROM s GROUP BY ALL),
kept AS (SELECT case_id, node FROM nodes QUALIFY NOT cp OR row_number() OVER (PARTITION BY case_id, cp ORDER BY inflow + outflow DESC, node) <= 60)
SELECT case_id, source, target, kind, value, n FROM edges WHERE (case_id, source) IN (SELECT case_id, node FROM kept) AND (case_id, target) IN (SELECT case_id, node FROM kept)""")
def r12_network_budget(spark, sf_dir):
    txns, pairs, _, _ = parts(spark, sf_dir)
    clustered = own_cluster(txns)
    return views.network_budget(views.network_nodes(clustered), views.network_edges(clustered, pairs))[1]


@query("SELECT id, CAST(posting_date AS VARCHAR) AS posting_date, amount_kwd FROM ledger WHERE direction = 'debit' AND (narrative ILIKE '%own%' OR counterparty_name ILIKE '%own%' OR counterparty_bank ILIKE '%own%' OR account_id ILIKE '%own%') ORDER BY amount_kwd DESC, id LIMIT 50")
def r13_search(spark, sf_dir):
    page, _ = views.search_transactions(td.ledger(spark, sf_dir), direction="debit", text="own", sort="amount")
    return page.select("id", F.col("posting_date").cast("string").alias("posting_date"), "amount_kwd")


@query(f"""WITH {EDGES}, b AS (SELECT case_id, source AS node, target AS neighbour, value FROM edges UNION ALL SELECT case_id, target, source, value FROM edges), g AS (SELECT case_id, node, neighbour, {money('value')} AS value FROM b GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY case_id, node ORDER BY value DESC, neighbour) AS rank FROM g QUALIFY rank <= 8""")
def r16_top_neighbours(spark, sf_dir):
    txns, pairs, _, _ = parts(spark, sf_dir)
    return views.top_neighbours(views.network_edges(own_cluster(txns), pairs))


@run_query("SELECT id, case_id, CAST(created_at AS VARCHAR) AS created_at, probability, band FROM latest")
def r1_latest_runs(spark, sf_dir):
    return views.latest_runs(td.runs(spark, sf_dir)).select("id", "case_id", F.col("created_at").cast("string").alias("created_at"), "probability", "band")


@run_query("""SELECT rule_id, count(*) AS fired, count(*) FILTER (decision = 'escalate') AS escalate, count(*) FILTER (decision = 'watchlist') AS watchlist, count(*) FILTER (decision = 'close') AS close, count(*) FILTER (decision IS NULL) AS undecided, count(decision) AS decided, count(*) FILTER (decision = 'escalate') / nullif(count(decision), 0) AS escalated_share
FROM latest l JOIN hits h ON h.run_id = l.id AND h.fired LEFT JOIN dispositions d ON d.run_id = l.id GROUP BY rule_id""")
def r2_rule_performance(spark, sf_dir):
    return views.rule_performance(td.runs(spark, sf_dir), td.dispositions(spark, sf_dir))


@query()
def r3_counterparty_intel(spark, sf_dir):
    ext, cases = written(spark, sf_dir)[2:]
    return jobs.shared_counterparties(ext, cases)[1].select("cluster", "case_id", "subject_name", "n", "total", "inflow", "outflow")


@run_query(f"""SELECT (SELECT count(*) FROM cases WHERE case_id % 11 <> 0) AS cases, (SELECT count(DISTINCT file_id) FROM ledger) AS files, (SELECT floor(avg(n % 7 / 7.0) * 1000 + 0.5) / 1000 FROM (SELECT count(*) AS n FROM ledger GROUP BY file_id)) AS quality, (SELECT count(*) FROM ledger) AS transactions, (SELECT {money('amount_kwd')} FROM ledger) AS value,
 {", ".join(f"(SELECT count(*) FROM latest WHERE band = '{b}') AS {b.lower()}" for b in ('Low', 'Moderate', 'Elevated', 'High', 'Critical'))}""")
def r4_portfolio_summary(spark, sf_dir):
    cases = td.cases(spark, sf_dir).withColumn("status", F.when(F.col("case_id") % 11 == 0, "intake").otherwise("open"))
    txns = td.ledger(spark, sf_dir)
    files = txns.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).withColumn("quality", (F.col("n") % 7) / 7.0)
    return views.portfolio_summary(cases, txns, td.runs(spark, sf_dir), files)


@run_query("""SELECT c.case_id, coalesce(files, 0) AS files, coalesce(txn_count, 0) AS txn_count, coalesce(banks, 0) AS banks, l.id AS run_id, l.band, d.decision FROM cases c
LEFT JOIN (SELECT case_id, count(DISTINCT file_id) AS files, count(*) AS txn_count, count(DISTINCT bank) AS banks FROM ledger GROUP BY case_id) t USING (case_id) LEFT JOIN latest l USING (case_id) LEFT JOIN dispositions d ON d.run_id = l.id""")
def r5_case_stats(spark, sf_dir):
    return views.case_stats(td.cases(spark, sf_dir), td.ledger(spark, sf_dir), td.runs(spark, sf_dir), td.dispositions(spark, sf_dir)).select("case_id", "files", "txn_count", "banks", "run_id", "band", "decision")


@run_query("SELECT r.case_id, r.id, CAST(created_at AS VARCHAR) AS created_at, probability, band, (SELECT count(*) FROM hits h WHERE h.run_id = r.id AND h.fired) AS n_fired, row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, id DESC) AS position FROM runs r")
def r14_run_history(spark, sf_dir):
    return views.run_history(td.runs(spark, sf_dir)).withColumn("created_at", F.col("created_at").cast("string"))


ENDS_OF = "a AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY created_at, id) = 1), ha AS (SELECT h.* FROM hits h JOIN a ON a.id = h.run_id WHERE fired), hb AS (SELECT h.* FROM hits h JOIN latest l ON l.id = h.run_id WHERE fired)"


@run_query(f"""WITH {ENDS_OF} SELECT coalesce(ha.case_id, hb.case_id) AS case_id, coalesce(ha.rule_id, hb.rule_id) AS rule_id, CASE WHEN ha.case_id IS NULL THEN 'added' WHEN hb.case_id IS NULL THEN 'removed' ELSE 'weight' END AS change,
 CASE WHEN ha.case_id IS NULL THEN hb.weight WHEN hb.case_id IS NULL THEN -ha.weight ELSE hb.weight - ha.weight END AS delta FROM ha FULL JOIN hb ON ha.case_id = hb.case_id AND ha.rule_id = hb.rule_id WHERE ha.case_id IS NULL OR hb.case_id IS NULL OR abs(hb.weight - ha.weight) > 0.001""")
def r15_compare_runs(spark, sf_dir):
    runs = td.runs(spark, sf_dir)
    first = runs.withColumn("created_at", -F.datediff("created_at", F.lit("2024-01-01").cast("date"))).withColumn("id", -F.col("id"))
    return views.compare_runs(views.latest_runs(first), views.latest_runs(runs))[0]


@run_query("SELECT run_id, CASE WHEN run_id % 6 = 0 THEN 'watchlist' ELSE decision END AS decision FROM dispositions")
def s9_upsert_disposition(spark, sf_dir):
    old = td.dispositions(spark, sf_dir)
    new = old.where("run_id % 6 = 0").withColumns({"id": F.col("id") + 1_000_000_000, "decision": F.lit("watchlist"), "created_at": F.date_add("created_at", 1)})
    return views.upsert_disposition(old, new).select("run_id", "decision")


@query("WITH c AS (SELECT DISTINCT case_id, bank || strftime(posting_date, ' %Y-%m') AS section, CASE WHEN id % 5 = 0 THEN id + 999 ELSE id END AS cited FROM ledger) SELECT c.case_id, section, count(*) AS checked, count(l.id) AS valid FROM c LEFT JOIN ledger l ON l.case_id = c.case_id AND l.id = cited GROUP BY ALL")
def r17_citation_audit(spark, sf_dir):
    txns = td.ledger(spark, sf_dir)
    cited = F.when(F.col("id") % 5 == 0, F.col("id") + 999).otherwise(F.col("id"))
    texts = txns.groupBy("case_id", F.concat_ws(" ", "bank", F.date_format("posting_date", "yyyy-MM")).alias("section")).agg(F.concat_ws(" ", F.collect_list(F.format_string("see [txn %d]", cited))).alias("text"))
    return views.citation_audit(texts, txns)


@query("WITH g AS (SELECT file_id, posting_date, direction, printf('%.3f', amount_kwd) AS a, coalesce(narrative, '') AS t, count(*) AS n FROM ledger GROUP BY ALL) SELECT file_id, CAST(sum(n) - count(*) AS BIGINT) AS duplicates FROM g GROUP BY file_id")
def q2_file_duplicates(spark, sf_dir):
    return dq.file_duplicates(td.ledger(spark, sf_dir))


BALANCED = "b AS (SELECT file_id, account_id, id AS row_index, direction, amount_kwd AS amount, CASE WHEN id % 9 <> 0 THEN CAST(sum(CAST(CASE WHEN direction = 'credit' THEN amount_kwd ELSE -amount_kwd END AS DECIMAL(20,6))) OVER (PARTITION BY file_id, account_id ORDER BY id) AS DOUBLE) END AS running_balance FROM ledger)"


@query(f"""WITH {BALANCED}, k AS (SELECT *, CASE WHEN direction = 'credit' THEN amount ELSE -amount END AS s FROM b WHERE running_balance IS NOT NULL),
m AS (SELECT file_id, account_id, coalesce(abs(lag(running_balance) OVER (PARTITION BY file_id, account_id ORDER BY row_index) + s - running_balance) > 0.01, false) AS a, coalesce(abs(lag(running_balance) OVER (PARTITION BY file_id, account_id ORDER BY row_index DESC) + s - running_balance) > 0.01, false) AS b FROM k)
SELECT file_id, account_id, count(*) - 1 AS checked, least(count(*) FILTER (a), count(*) FILTER (b)) AS breaks FROM m GROUP BY ALL HAVING count(*) >= 2""")
def q1_reconcile_balances(spark, sf_dir):
    from pyspark.sql import Window

    signed = F.when(F.col("direction") == "credit", F.col("amount_kwd")).otherwise(-F.col("amount_kwd")).cast("decimal(20,6)")
    w = Window.partitionBy("file_id", "account_id").orderBy("id")
    rows = td.ledger(spark, sf_dir).withColumn("running_balance", F.when(F.col("id") % 9 != 0, F.sum(signed).over(w).cast("double")))
    return dq.reconcile_balances(rows.withColumns({"row_index": F.col("id"), "amount": F.col("amount_kwd")}))


@query("""WITH d AS (SELECT DISTINCT case_id, bank, account_id, posting_date FROM ledger), w AS (SELECT *, lag(posting_date) OVER (PARTITION BY case_id, bank, account_id ORDER BY posting_date) AS p, date_diff('day', min(posting_date) OVER (PARTITION BY case_id, bank, account_id), max(posting_date) OVER (PARTITION BY case_id, bank, account_id)) AS span FROM d)
SELECT case_id, bank, account_id, CAST(p AS VARCHAR) AS gap_start, CAST(posting_date AS VARCHAR) AS gap_end, date_diff('day', p, posting_date) AS days FROM w WHERE span >= 60 AND date_diff('day', p, posting_date) > 45""")
def q9_coverage_gaps(spark, sf_dir):
    return dq.coverage_gaps(td.ledger(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in ("gap_start", "gap_end")})


@query("SELECT case_id, 'fx_share' AS check, CASE WHEN m > 0.5 THEN 'warn' ELSE 'pass' END AS status, m AS metric FROM (SELECT case_id, count(*) FILTER (upper(currency) NOT IN ('KWD', 'KD')) / count(*) AS m FROM ledger GROUP BY case_id)")
def q10_fx_share(spark, sf_dir):
    return dq.fx_share(td.ledger(spark, sf_dir))


TWICE = "t AS (SELECT case_id, account_id, posting_date, direction, amount_kwd, narrative, file_id FROM ledger UNION ALL SELECT case_id, account_id, posting_date, direction, amount_kwd, narrative, file_id + 5 FROM ledger WHERE id % 50 = 0)"


@query(f"""WITH {TWICE}, s AS (SELECT case_id, file_id, concat_ws('|', account_id, CAST(posting_date AS VARCHAR), direction, printf('%.3f', amount_kwd), substr(trim(regexp_replace(lower(narrative), '\\s+', ' ', 'g')), 1, 80)) AS sig FROM t WHERE length(trim(narrative)) >= 6)
SELECT case_id, sha256(sig) AS signature, count(*) AS n, count(DISTINCT file_id) AS files FROM s GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT file_id) > 1""")
def q8_cross_file_duplicates(spark, sf_dir):
    txns = td.ledger(spark, sf_dir)
    return dq.cross_file_duplicates(txns.unionByName(txns.where("id % 50 = 0").withColumn("file_id", F.col("file_id") + 5)))


P = {k: v.replace("'", "''") for k, v in PATTERNS.items()}
_IS = lambda n: f"(t <> '' AND regexp_matches(t, '{P[n]}', 'i'))"


#: The channel of a row with cr (is a credit), cp (has a party) and t (its texts in lower case).
CHANNEL = f"""CASE WHEN cr AND {_IS('cash_deposit')} THEN 'cash_deposit' WHEN NOT cr AND {_IS('atm')} THEN 'cash_withdrawal' WHEN cr AND {_IS('salary')} THEN 'salary' WHEN NOT cr AND {_IS('pos')} THEN 'pos' WHEN {_IS('cheque')} THEN 'cheque'
 WHEN {_IS('interest')} THEN 'interest' WHEN NOT cr AND {_IS('fee')} THEN 'fee' WHEN {_IS('transfer')} THEN CASE WHEN cr THEN 'transfer_in' ELSE 'transfer_out' END WHEN {_IS('cash')} THEN CASE WHEN cr THEN 'cash_deposit' ELSE 'cash_withdrawal' END
 WHEN cr AND NOT cp AND {_IS('deposit')} THEN 'cash_deposit' WHEN NOT cr AND NOT cp AND {_IS('withdrawal')} THEN 'cash_withdrawal' WHEN cp THEN CASE WHEN cr THEN 'transfer_in' ELSE 'transfer_out' END ELSE 'other' END"""


@query(f"""WITH t AS (SELECT id, direction = 'credit' AS cr, counterparty_bank IS NOT NULL AS cp, lower(trim(coalesce(narrative, '') || ' ' || coalesce(channel, ''))) AS t FROM ledger)
SELECT id, {CHANNEL} AS channel FROM t""")
def n9_classify_channel(spark, sf_dir):
    txns = cut(td.ledger(spark, sf_dir), "ledger").withColumn("party", F.col("counterparty_bank").isNotNull())
    return narrative.with_channel(txns, "narrative", "channel", "direction", "party").select("id", F.col("_channel").alias("channel"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders")
def n4_parse_date(spark, sf_dir):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    written = F.when(k == 0, d.cast("string")).when(k == 1, F.date_format(d, "d MMM yyyy")).when(k == 2, F.date_format(d, "dd/MM/yyyy")).otherwise(F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", narrative.parse_date(written).cast("string").alias("d"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 2) THEN -o_totalprice ELSE o_totalprice END AS v FROM (SELECT o_orderkey, floor(o_totalprice * 100) / 100 AS o_totalprice FROM orders)")
def n5_parse_amount(spark, sf_dir):
    k, v = F.col("o_orderkey") % 4, F.floor(F.col("o_totalprice") * 100) / 100
    plain = F.format_number(v, 2)
    written = F.when(k == 0, plain).when(k == 1, F.concat(F.lit("("), plain, F.lit(")"))).when(k == 2, F.concat(plain, F.lit(" DR"))).otherwise(F.concat(plain, F.lit(" CR.")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", narrative.parse_amount(written).alias("v"))


@query("SELECT id, CASE currency WHEN 'USD' THEN amount_kwd * 0.307 ELSE amount_kwd END AS kwd FROM ledger")
def n8_to_kwd(spark, sf_dir):
    from tallyrock.operators.normalize import to_kwd

    rows = td.ledger(spark, sf_dir).withColumn("countervalue", F.lit(None).cast("double"))
    return to_kwd(rows, "amount_kwd", "currency", "countervalue").select("id", F.col("kwd"))


@query("SELECT id, 'name:' || upper(trim(regexp_replace(regexp_replace(counterparty_name, '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) AS key FROM ledger")
def i2_parse_identity(spark, sf_dir):
    return td.ledger(spark, sf_dir).select("id", names.parse_identity(F.col("counterparty_name"))["key"].alias("key"))
