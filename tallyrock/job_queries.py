"""Queries of the jobs, readers and sinks: what they need from files, they write from the driver's tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrock.forensic_queries import TOTALS, entries
from tallyrock.functions.names import name_similarity
from tallyrock.functions.narrative import extract_party
from tallyrock.operators.features import round3
from tallyrock.operators import declarations, normalize, quality, sanctions, scoring, views
from tallyrock.plans import jobs
from tallyrock.plans import testdata as td
from tallyrock.queries import ORACLES, QUERIES, SCORED_COLUMNS, with_pairs
from tallyrock.sources.ledger import SCHEMAS, merge_flags, read_statement_rows, read_table, write_ledger, write_runs
from tallyrock.sources.shared import cut, new_path
from tallyrock.view_queries import CHANNEL


def query(sql: str | None = None):
    """Register a query under its function's name, with its whole SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def statement_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statement rows, files, cases) of the statements that the tables make."""
    path = new_path(spark, "statements")
    td.write_statements(spark, sf_dir, path)
    rows = cut(read_statement_rows(spark, path, bundled=True), "statement-rows")
    number = F.regexp_extract("filename", r"-(\d+)$", 1).cast("long")
    files = cut(rows.select("file_id", "filename").distinct().withColumn("case_id", F.floor(number / 10).cast("long")), "statement-files")
    return rows, files, td.cases(spark, sf_dir)


@query(td.with_statements(f"""SELECT statement, k AS row_index, case_id, label AS bank, account_id, CAST(posting_date AS VARCHAR) AS posting_date, direction, paid AS amount, kwd AS amount_kwd, currency, narrative,
 party AS counterparty_name, counterparty_bank, trim(counterparty_country) AS counterparty_country, {CHANNEL} AS channel
FROM (SELECT *, direction = 'credit' AS cr, counterparty_name IS NOT NULL AS cp, lower(trim(coalesce(narrative, ''))) AS t FROM statements WHERE bad = 0)"""))
def j1_ingest_ledger(spark, sf_dir):
    txns = jobs.ingest_ledger(*statement_files(spark, sf_dir))[0]
    return txns.select(
        F.col("filename").alias("statement"), F.col("row_index").cast("long").alias("row_index"), "case_id", "bank", "account_id", F.col("posting_date").cast("string").alias("posting_date"), "direction", "amount", "amount_kwd",
        "currency", "narrative", "counterparty_name", "counterparty_bank", "counterparty_country", "channel",
    )


@query(td.with_statements("""WITH same AS (SELECT statement, sum(n - 1) AS dups FROM (SELECT statement, count(*) AS n FROM statements WHERE bad = 0 GROUP BY statement, posting_date, direction, printf('%.3f', kwd), narrative) GROUP BY statement),
g AS (SELECT statement, any_value(label) AS bank, count(*) FILTER (bad = 0) AS rows_parsed, count(*) FILTER (bad > 0) AS rows_skipped, count(*) FILTER (bad = 1) AS no_date, count(*) FILTER (bad = 2) AS unpaid, any_value(file_id) AS f,
 CAST(min(posting_date) FILTER (bad = 0) AS VARCHAR) AS period_start, CAST(max(posting_date) FILTER (bad = 0) AS VARCHAR) AS period_end,
 coalesce(CAST(sum(CAST(kwd AS DECIMAL(20,6))) FILTER (bad = 0 AND direction = 'credit') AS DOUBLE), 0.0) AS total_credits, coalesce(CAST(sum(CAST(kwd AS DECIMAL(20,6))) FILTER (bad = 0 AND direction = 'debit') AS DOUBLE), 0.0) AS total_debits,
 array_to_string(list_sort(list(DISTINCT account_id)), ',') AS accounts FROM statements GROUP BY statement)
SELECT statement, bank, rows_parsed, rows_skipped, no_date, CASE WHEN f % 3 = 0 THEN unpaid ELSE 0 END AS both_sides, CASE WHEN f % 3 = 0 THEN 0 ELSE unpaid END AS no_amount, period_start, period_end, total_credits, total_debits, accounts,
 floor((0.55 * rows_parsed / (rows_parsed + rows_skipped) + 0.3 * 0.85 + 0.15 * (1 - least(1.0, dups / greatest(1.0, 0.05 * rows_parsed)))) * 1000000 + 0.5) / 1000000 AS quality FROM g JOIN same USING (statement)"""))
def j1_file_reports(spark, sf_dir):
    reports = jobs.ingest(*statement_files(spark, sf_dir))[1]
    line = F.array_join("notes", " ")
    skipped = lambda reason: F.coalesce(F.nullif(F.regexp_extract(line, rf"Skipped (\d+) rows?: {reason}", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    day = lambda c: F.col(c).cast("string").alias(c)
    return reports.select(
        F.col("filename").alias("statement"), "bank", "rows_parsed", "rows_skipped", skipped("row without a parsable date").alias("no_date"), skipped("row with both").alias("both_sides"), skipped("row without a monetary").alias("no_amount"),
        day("period_start"), day("period_end"), "total_credits", "total_debits", F.array_join("accounts", ",").alias("accounts"), (F.floor(F.col("quality") * 1000000 + 0.5) / 1000000).alias("quality"),
    )


R6 = lambda expr: f"floor(({expr}) * 1000000 + 0.5) / 1000000"


def six(col) -> F.Column:
    return F.floor(col * 1000000 + 0.5) / 1000000


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows, file reports), each written once."""
    rows = cut(td.reported_rows(spark, sf_dir), "reported")
    return rows, cut(td.bank_files(rows), "files")


@query(td.with_files(f"""WITH q AS (SELECT case_id, sum(quality * greatest(1, rows_parsed)) / sum(greatest(1, rows_parsed)) AS q FROM files GROUP BY case_id)
SELECT case_id, {R6('q')} AS quality, CASE WHEN q < 0.7 THEN printf('Consolidated data quality %.2f is below the 0.70 gate', q) END AS issue FROM q"""))
def q4_case_quality(spark, sf_dir):
    return quality.case_quality(files(spark, sf_dir)[1]).withColumn("quality", six(F.col("quality")))


PARSED = """p AS (SELECT case_id, sum(rows_parsed) / sum(rows_parsed + rows_skipped) AS v FROM files GROUP BY case_id)"""


@query(td.with_files(f"WITH {PARSED} SELECT case_id, 'parse_coverage' AS \"check\", CASE WHEN v >= 0.98 THEN 'pass' WHEN v >= 0.9 THEN 'warn' ELSE 'fail' END AS status, {R6('v')} AS metric FROM p"))
def q5_parse_coverage(spark, sf_dir):
    return quality.parse_coverage(files(spark, sf_dir)[1]).withColumn("metric", six(F.col("metric")))


BALANCE = """b AS (SELECT case_id, max(CASE WHEN issue IS NULL OR lower(issue) NOT LIKE '%balance%' THEN 0 WHEN lower(issue) LIKE '%break%' AND quality < 0.7 THEN 2 ELSE 1 END) AS r FROM files GROUP BY case_id)"""


@query(td.with_files(f"WITH {BALANCE} SELECT case_id, 'balance_integrity' AS \"check\", ['pass', 'warn', 'fail'][r + 1] AS status, CAST(r AS DOUBLE) AS metric FROM b"))
def q6_balance_integrity(spark, sf_dir):
    return quality.balance_integrity(files(spark, sf_dir)[1])


OVERLAP = """u AS (SELECT case_id, file_id, period_start, period_end, unnest(accounts) AS account_id FROM files),
o AS (SELECT a.case_id, a.account_id, a.file_id AS file_a, b.file_id AS file_b, date_diff('day', greatest(a.period_start, b.period_start), least(a.period_end, b.period_end)) AS days FROM u a JOIN u b ON a.case_id = b.case_id AND a.account_id = b.account_id AND a.file_id < b.file_id)"""


@query(td.with_files(f"WITH {OVERLAP} SELECT case_id, account_id, file_a, file_b, days FROM o WHERE days > 1"))
def q7_statement_overlap(spark, sf_dir):
    return quality.statement_overlap(files(spark, sf_dir)[1])


#: The six checks of a case, each with its lines and row ids.
REPORT = f"""{PARSED}, {BALANCE}, {OVERLAP}, g AS (SELECT case_id, bank, account_id, posting_date, lag(posting_date) OVER w AS before, date_diff('day', min(posting_date) OVER (PARTITION BY case_id, bank, account_id), max(posting_date) OVER (PARTITION BY case_id, bank, account_id)) AS span
  FROM (SELECT DISTINCT case_id, bank, account_id, posting_date FROM reported) WINDOW w AS (PARTITION BY case_id, bank, account_id ORDER BY posting_date)),
gaps AS (SELECT *, date_diff('day', before, posting_date) AS days FROM g WHERE span >= 60 AND date_diff('day', before, posting_date) > 45),
marked AS (SELECT *, substr(trim(regexp_replace(lower(narrative), '\\s+', ' ', 'g')), 1, 80) AS t FROM reported WHERE length(trim(narrative)) >= 6),
sig AS (SELECT *, sha256(concat_ws('|', account_id, CAST(posting_date AS VARCHAR), direction, printf('%.3f', amount_kwd), t)) AS s, printf('%s %s %s %.3f KWD', account_id, CAST(posting_date AS VARCHAR), direction, amount_kwd) AS line FROM marked WHERE length(t) >= 6),
twice AS (SELECT case_id, s, count(*) AS n, count(DISTINCT file_id) AS f, min(id) AS first, any_value(line) AS line FROM sig GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT file_id) > 1),
ids AS (SELECT case_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM (SELECT sig.case_id, id, row_number() OVER (PARTITION BY sig.case_id ORDER BY s, id) AS r FROM sig JOIN twice USING (case_id, s)) WHERE r <= 12 GROUP BY case_id),
fx AS (SELECT case_id, currency, count(*) AS n FROM reported WHERE currency NOT IN ('KWD', 'KD') GROUP BY ALL), foreign_share AS (SELECT case_id, count(*) FILTER (currency NOT IN ('KWD', 'KD')) / count(*) AS v FROM reported GROUP BY case_id),
lines AS (
  SELECT case_id, 'parse_coverage' AS k, printf('%s: %d rows skipped (%s)', bank, rows_skipped, filename) AS item, row_number() OVER (PARTITION BY case_id ORDER BY file_id) AS r FROM files WHERE rows_skipped > 0
  UNION ALL SELECT case_id, 'balance_integrity', bank || ': ' || issue, row_number() OVER (PARTITION BY case_id ORDER BY file_id) FROM files WHERE lower(issue) LIKE '%balance%'
  UNION ALL SELECT case_id, 'statement_overlap', printf('%s: files %d and %d share %d days', account_id, file_a, file_b, days), row_number() OVER (PARTITION BY case_id ORDER BY account_id, file_a, file_b) FROM o WHERE days > 1
  UNION ALL SELECT case_id, 'cross_file_duplicates', printf('%s - in %d files (%d rows)', line, f, n), row_number() OVER (PARTITION BY case_id ORDER BY first) FROM twice
  UNION ALL SELECT case_id, 'coverage_gaps', printf('%s: no activity %s to %s (%d days)', account_id, CAST(before AS VARCHAR), CAST(posting_date AS VARCHAR), days), row_number() OVER (PARTITION BY case_id ORDER BY account_id, before, printf('%s: no activity %s to %s (%d days)', account_id, CAST(before AS VARCHAR), CAST(posting_date AS VARCHAR), days)) FROM gaps
  UNION ALL SELECT case_id, 'fx_share', printf('%s: %d transactions', currency, n), row_number() OVER (PARTITION BY case_id ORDER BY n DESC, currency) FROM fx),
told AS (SELECT case_id, k, string_agg(item, '; ' ORDER BY r) FILTER (r <= 8) AS items, count(*) AS n FROM lines GROUP BY ALL),
checks AS (SELECT DISTINCT case_id, unnest(['parse_coverage', 'balance_integrity', 'statement_overlap', 'cross_file_duplicates', 'coverage_gaps', 'fx_share']) AS k FROM files),
report AS (SELECT c.case_id, c.k AS "check", CASE c.k WHEN 'parse_coverage' THEN CASE WHEN p.v >= 0.98 THEN 'pass' WHEN p.v >= 0.9 THEN 'warn' ELSE 'fail' END WHEN 'balance_integrity' THEN ['pass', 'warn', 'fail'][b.r + 1] WHEN 'fx_share' THEN CASE WHEN x.v > 0.5 THEN 'warn' ELSE 'pass' END
   ELSE CASE WHEN coalesce(t.n, 0) = 0 THEN 'pass' WHEN c.k = 'cross_file_duplicates' THEN 'fail' ELSE 'warn' END END AS status,
  {R6("CASE c.k WHEN 'parse_coverage' THEN p.v WHEN 'balance_integrity' THEN b.r WHEN 'fx_share' THEN x.v ELSE coalesce(t.n, 0) END")} AS metric, coalesce(t.items, '') AS items, CASE WHEN c.k = 'cross_file_duplicates' THEN coalesce(i.ids, '') ELSE '' END AS txn_ids
  FROM checks c LEFT JOIN told t ON t.case_id = c.case_id AND t.k = c.k JOIN p ON p.case_id = c.case_id JOIN b ON b.case_id = c.case_id JOIN foreign_share x ON x.case_id = c.case_id LEFT JOIN ids i ON i.case_id = c.case_id)"""


def report_rows(report: DataFrame) -> DataFrame:
    rows = report.select("case_id", F.inline("report"))
    return rows.select("case_id", "check", "status", six(F.col("metric")).alias("metric"), F.array_join("items", "; ").alias("items"), F.array_join("txn_ids", ",").alias("txn_ids"))


@query(td.with_files(f"WITH {REPORT} SELECT * FROM report"))
def q11_dq_report(spark, sf_dir):
    return report_rows(quality.dq_report(*files(spark, sf_dir)))


@query(td.with_files(f"WITH {REPORT}, latest AS (SELECT c_custkey AS id, c_custkey // 15 AS case_id FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey // 15 ORDER BY c_custkey % 97 DESC, c_custkey DESC) = 1) SELECT report.* FROM report JOIN latest USING (case_id) WHERE latest.id % 3 <> 0"))
def j5_backfill_dq(spark, sf_dir):
    runs = td.runs(spark, sf_dir).withColumn("has_report", F.col("id") % 3 == 0)
    return report_rows(jobs.backfill_dq(runs, *files(spark, sf_dir)))


QUOTES = "quotes AS (SELECT case_id, band AS section, unnest([{'k': 'Cash Share', 'v': CASE WHEN id % 4 = 0 THEN cash_share + 0.5 ELSE cash_share END}, {'k': 'fan_in_count', 'v': fan_in}, {'k': 'no_such', 'v': 1.0}]) AS q FROM runs)"


@query(td.with_runs(f"""WITH {QUOTES}, known AS (SELECT case_id, 'cash share' AS k, cash_share AS v FROM latest UNION ALL SELECT case_id, 'fan in count', fan_in FROM latest)
SELECT q.case_id, section, count(*) AS checked, count(*) FILTER (abs(q.q.v - k.v) <= greatest(0.01, abs(k.v) * 0.01)) AS valid FROM quotes q LEFT JOIN known k ON k.case_id = q.case_id AND k.k = replace(lower(q.q.k), '_', ' ') GROUP BY q.case_id, section"""))
def r17_value_audit(spark, sf_dir):
    runs = cut(td.runs(spark, sf_dir), "runs")
    share = F.get(F.filter("features", lambda f: f["key"] == "cash_share"), 0)["value"]
    fan = F.get(F.filter("features", lambda f: f["key"] == "fan_in_count"), 0)["value"]
    made = [("Cash Share", F.when(F.col("id") % 4 == 0, share + 0.5).otherwise(share)), ("fan_in_count", fan), ("no_such", F.lit(1.0))]
    quotes = runs.select("case_id", F.col("band").alias("section"), F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in made])))
    known = views.latest_runs(runs).select("case_id", F.inline("features")).select("case_id", "key", "value")
    return views.value_audit(quotes, known)


TOLD = ("R-GEO-01", "the rule r_vel 01, which fired", "velocity", "vel", "GEO 01", "CASH-01 and more")


@query(td.with_runs(f"""WITH told AS (SELECT case_id, band AS section, trim(regexp_replace(lower([{", ".join(f"'{t}'" for t in TOLD)}][id % {len(TOLD)} + 1]), '[^a-z0-9]+', ' ', 'g')) AS r FROM runs),
known AS (SELECT DISTINCT h.case_id, trim(regexp_replace(lower(rule_id), '[^a-z0-9]+', ' ', 'g')) AS p FROM hits h JOIN latest l ON l.id = h.run_id WHERE fired)
SELECT case_id, section, count(*) AS checked, count(*) FILTER (length(r) < 4 OR EXISTS (SELECT 1 FROM known k WHERE k.case_id = t.case_id AND (contains(k.p, t.r) OR contains(t.r, k.p)))) AS valid FROM told t GROUP BY ALL"""))
def r17_reference_audit(spark, sf_dir):
    runs = cut(td.runs(spark, sf_dir), "runs")
    told = F.get(F.array(*[F.lit(t) for t in TOLD]), (F.col("id") % len(TOLD)).cast("int"))
    known = views.latest_runs(runs).select("case_id", F.inline("rule_hits")).where("fired").select("case_id", F.col("rule_id").alias("name"))
    return views.reference_audit(runs.select("case_id", F.col("band").alias("section"), told.alias("reference")), known)


def screened_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the list version and totals that they were screened with."""
    k = F.col("id")
    return td.runs(spark, sf_dir).withColumns({"list_version": F.when(k % 3 == 0, "v2").when(k % 3 == 1, "v1"), "exact": F.lit(26).cast("long") - k % 2, "strong": F.lit(0).cast("long"), "possible": F.lit(12).cast("long")})


@query(td.with_runs(f"""WITH {TOTALS}, stale AS (SELECT case_id, id FROM latest WHERE id % 3 <> 0), moved AS (SELECT s.case_id, 26 - id % 2 AS exact, 0 AS strong, 12 AS possible, coalesce(t.exact, 0) AS new_exact, coalesce(t.strong, 0) AS new_strong, coalesce(t.possible, 0) AS new_possible FROM stale s LEFT JOIN totals t USING (case_id))
SELECT * FROM moved WHERE exact <> new_exact OR strong <> new_strong OR possible <> new_possible"""))
def x5_rescreen_stale(spark, sf_dir):
    """The last version lacked every fifth entry and knew others by fewer names."""
    new = cut(entries(spark, sf_dir), "entries")
    mark = F.abs(F.xxhash64("entry_id")) % 5
    old = new.where(mark != 0).withColumn("names", F.when(mark == 1, F.slice("names", 1, 1)).otherwise(F.col("names")))
    txns, cases = cut(td.ledger(spark, sf_dir), "ledger"), td.cases(spark, sf_dir)
    names = cut(sanctions.names_to_screen(txns, cases), "asked")
    matches = cut(sanctions.screen(names, old), "matches")
    return jobs.rescreen(screened_runs(spark, sf_dir), txns, cases, new, "v2", (matches, old))


@query(td.with_runs("SELECT id, case_id, CAST(created_at AS VARCHAR) AS run_date, probability, band, 1 AS hits FROM runs"))
def s7_write_runs(spark, sf_dir):
    """Runs written twice, the second time in two batches of which one is written again."""
    path = new_path(spark, "runs")
    runs = td.runs(spark, sf_dir).withColumns({"created_at": F.col("created_at").cast("timestamp"), "rule_hits": F.array(F.struct(F.lit("R-GEO-01").alias("rule_id"), F.lit(True).alias("fired"), F.lit(0.9).alias("weight"), F.array(F.col("id")).alias("txn_ids")))})
    even, odd = runs.where("id % 2 = 0"), runs.where("id % 2 = 1")
    for batch, part in (("even", even), ("odd", odd), ("even", even)):
        write_runs(part.drop("features"), path, batch)
    return read_table(spark, "runs", path).select("id", "case_id", F.col("created_at").cast("date").cast("string").alias("run_date"), "probability", "band", F.size("rule_hits").cast("long").alias("hits"))


@query(td.with_ledger("""WITH legs2 AS (SELECT case_id, debit_id AS id, debit_id AS pair FROM pairs UNION ALL SELECT case_id, credit_id, debit_id FROM pairs),
flags AS (SELECT case_id, id, CASE WHEN id % 4 = 0 AND case_id % 3 <> 0 THEN CASE WHEN id % 6 = 0 THEN 'R-A,R-B' ELSE 'R-A' END WHEN id % 6 = 0 AND case_id % 3 <> 0 THEN 'R-B' ELSE '' END AS flags FROM ledger)
SELECT l.case_id, l.id, l.amount_kwd, f.flags, p.pair AS internal_pair_id, p.pair IS NOT NULL AS is_internal_transfer FROM ledger l JOIN flags f USING (case_id, id) LEFT JOIN legs2 p ON p.case_id = l.case_id AND p.id = l.id"""))
def s8_flag_ledger(spark, sf_dir):
    """A written ledger whose flags are merged twice: once wrongly for all cases, then rightly for cases in two runs."""
    path = new_path(spark, "ledger")
    txns = td.ledger(spark, sf_dir)
    wanted = spark.createDataFrame([], SCHEMAS["ledger"]).schema
    whole = txns.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in txns.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])
    write_ledger(whole, path, 8)
    txns = read_table(spark, "ledger", path)
    pairs = cut(td.declared_pairs(txns), "pairs")
    of = lambda rule, every: txns.where(F.col("id") % every == 0).groupBy("case_id").agg(F.collect_list("id").alias("txn_ids")).select("case_id", F.lit(rule).alias("rule_id"), (F.col("case_id") % 3 != 0).alias("fired"), "txn_ids")
    cases, hits = cut(txns.select("case_id").distinct(), "cases"), cut(of("R-A", 4).unionByName(of("R-B", 6)), "hits")
    merge_flags(spark, path, pairs.where("false"), hits.withColumn("fired", F.lit(True)), cases, 8)
    for part in (0, 1):
        merge_flags(spark, path, pairs, hits, cases.where(F.col("case_id") % 2 == part), 8)
    return read_table(spark, "ledger", path).select("case_id", "id", "amount_kwd", F.array_join("flags", ",").alias("flags"), "internal_pair_id", "is_internal_transfer")


def lists(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """Paths of a list of customers with aliases as quoted files, some fields over two lines, and of one of suppliers and nations as XML."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    empty = F.lit("-0- ")
    remarks = F.when(k % 5 == 0, quoted(F.concat(F.lit('Phone "'), "c_mktsegment", F.lit('",\nsecond line')))).otherwise(empty)
    sdn = F.concat_ws(",", k.cast("string"), quoted(F.col("c_name")), F.when(k % 3 == 0, '"individual"').otherwise(empty), F.when(k % 2 == 0, '"SDGT] [IRAN"').otherwise('"SDGT"'), *[empty] * 7, remarks)
    alt = F.array(
        F.concat_ws(",", k.cast("string"), k.cast("string"), F.when(k % 4 == 0, '"a.k.a."').otherwise('"low"'), quoted(F.concat(F.lit("Alias, "), "c_name")), empty),
        F.concat_ws(",", k.cast("string"), k.cast("string"), F.lit('"aka"'), quoted(F.upper(F.replace("c_name", F.lit("#"), F.lit(" ")))), empty), F.concat_ws(",", k.cast("string"), k.cast("string"), F.lit('"fka"'), empty, empty),
    )
    paths = tuple(new_path(spark, n) for n in ("sdn", "alt", "un"))
    customers.select(sdn.alias("value")).write.text(paths[0])
    customers.select(F.explode(alt).alias("value")).write.text(paths[1])
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    people = suppliers.select(F.col("s_suppkey").cast("string").alias("DATAID"), F.col("s_name").alias("FIRST_NAME"), F.when(F.col("s_suppkey") % 2 == 0, "A & B").alias("SECOND_NAME"), F.col("n_name").alias("FOURTH_NAME"), F.lit("Al-Qaida").alias("UN_LIST_TYPE"),
        F.concat(F.lit("QDi."), "s_suppkey").alias("REFERENCE_NUMBER"), F.array(F.struct(F.concat("s_name", F.lit(" <junior>")).alias("ALIAS_NAME")), F.struct(F.lit(" ").alias("ALIAS_NAME"))).alias("INDIVIDUAL_ALIAS"))
    firms = nations.select(F.concat(F.lit("9"), "n_nationkey").alias("DATAID"), F.col("n_name").alias("FIRST_NAME"), F.lit("DPRK").alias("UN_LIST_TYPE"), F.concat(F.lit("2001-01-"), F.lpad(F.col("n_nationkey") + 1, 2, "0")).alias("LISTED_ON"))
    people.write.format("xml").option("rowTag", "INDIVIDUAL").option("rootTag", "INDIVIDUALS").save(f"{paths[2]}/people")
    firms.write.format("xml").option("rowTag", "ENTITY").option("rootTag", "ENTITIES").save(f"{paths[2]}/firms")
    return paths


def listed(entries: DataFrame) -> DataFrame:
    return entries.select("entry_id", "type", F.array_join("programs", "|").alias("programs"), F.array_join(F.transform("names", lambda n: n["text"]), "|").alias("names"), "reference", "listed_on", "remarks")


@query("""SELECT 'SDN-' || c_custkey AS entry_id, CASE WHEN c_custkey % 3 = 0 THEN 'individual' ELSE 'entity' END AS type, CASE WHEN c_custkey % 2 = 0 THEN 'SDGT|IRAN' ELSE 'SDGT' END AS programs,
 c_name || CASE WHEN c_custkey % 4 = 0 THEN '|Alias, ' || c_name ELSE '' END AS names, NULL::VARCHAR AS reference, NULL::VARCHAR AS listed_on, CASE WHEN c_custkey % 5 = 0 THEN 'Phone "' || c_mktsegment || '", second line' END AS remarks FROM customer""")
def s3_read_ofac(spark, sf_dir):
    sdn, alt, _ = lists(spark, sf_dir)
    return listed(sanctions.read_ofac(spark, sdn, alt))


@query("""SELECT 'UN-' || s_suppkey AS entry_id, 'individual' AS type, 'Al-Qaida' AS programs, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' A & B' ELSE '' END || ' ' || n_name || '|' || s_name || ' <junior>' AS names, 'QDi.' || s_suppkey AS reference, NULL AS listed_on, NULL::VARCHAR AS remarks
FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'UN-9' || n_nationkey, 'entity', 'DPRK', n_name, NULL, '2001-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0'), NULL FROM nation""")
def s4_read_un_list(spark, sf_dir):
    return listed(sanctions.read_un_list(spark, f"{lists(spark, sf_dir)[2]}/*"))


ARABIC = "٠١٢٣٤٥٦٧٨٩"


def form_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): a wealth form of every customer as a line of JSON; every fiftieth line is cut off."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    arabic = lambda c: F.translate(c.cast("string"), "0123456789", ARABIC)
    civil = F.lpad(k.cast("string"), 12, "2")
    person = F.struct(
        F.when(k % 5 == 0, "illegible").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("name"), F.when(k % 2 == 1, arabic(civil)).otherwise(civil).alias("civil_id"),
        F.when(k % 3 == 0, F.concat(F.lit("12"), k)).otherwise(F.concat(F.lit("+965 9999"), F.lpad((k % 10000).cast("string"), 4, "0"))).alias("phone"), F.col("n_name").alias("nationality"),
        F.when(k % 4 == 0, "1,250").when(k % 4 == 1, "0").when(k % 4 == 2, "-5").otherwise(arabic(900 + k)).alias("salary"),
    )
    plots = F.array(F.struct(F.col("c_name").alias("ownerName"), F.concat(F.lit("Plot "), k).alias("location"), arabic(k * 10).alias("areaSqm"), F.when(k % 6 == 0, "150").otherwise("50").alias("ownershipPct")), F.struct(F.lit(None).cast("string").alias("ownerName"), F.lit(" ").alias("location"), F.lit("7").alias("areaSqm"), F.lit("n/a").alias("ownershipPct")))
    account = lambda name, value, country, kind: F.struct(name.alias("institution"), value.alias("valueKwd"), country.alias("institutionCountry"), kind.alias("kind"))
    accounts = F.array_compact(F.array(
        F.when(k % 10 == 0, account(F.lit("الوطني"), F.lit("10000"), F.lit("Kuwait"), F.lit("حساب"))), account(F.concat(F.lit("Bank "), k % 7), F.format_number(k * 100, 0), F.col("n_name"), F.when(k % 8 == 0, "a / b").otherwise("saving")),
    ))
    form = F.to_json(F.struct(k.alias("case_id"), person.alias("declarant"), plots.alias("realEstate"), accounts.alias("bankAccountsAndDeposits"), F.array(F.lit("debtsOwed"), F.lit("realEstate")).alias("sectionsMarkedNone")))
    return people.select(F.when(k % 50 == 0, F.substr(form, F.lit(1), F.lit(60))).otherwise(form).alias("value"))


def forms(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    """(path of the forms, forms as they are read, their items without printed examples), the latter two written once."""
    path = new_path(spark, "forms")
    form_lines(spark, sf_dir).write.text(path)
    read = cut(declarations.read_declarations(spark, path), "forms")
    return path, read, cut(declarations.flag_uncertain_items(declarations.drop_example_rows(declarations.declaration_items(read))), "items")


FORMS = "f AS (SELECT c_custkey AS k, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 <> 0)"
ITEMS = f"""{FORMS}, items AS (SELECT k AS case_id, 'realEstate' AS section, 0 AS row_index, c_name AS owner_name, 'Plot ' || k AS label, NULL AS kind, NULL AS country, CAST(k * 10 AS DOUBLE) AS area_sqm, CASE WHEN k % 6 <> 0 THEN 50.0::DOUBLE END AS ownership_pct, NULL::DOUBLE AS value, true AS uncertain FROM f
 UNION ALL SELECT k, 'bankAccountsAndDeposits', CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END, NULL, 'Bank ' || (k % 7), CASE WHEN k % 8 = 0 THEN 'a / b' ELSE 'saving' END, n_name, NULL, NULL, CAST(k * 100 AS DOUBLE), k % 8 = 0 FROM f)"""


@query(f"WITH {ITEMS} SELECT * FROM items")
def d1_declaration_items(spark, sf_dir):
    return forms(spark, sf_dir)[2].select("case_id", "section", "row_index", "owner_name", "label", "kind", "country", "area_sqm", "ownership_pct", "value", "uncertain")


@query(f"""WITH {FORMS} SELECT k AS case_id, CASE WHEN k % 5 <> 0 THEN c_name END AS name, lpad(k::VARCHAR, 12, '2') AS civil_id, CASE WHEN k % 3 = 0 THEN '12' || k ELSE '+965 9999' || lpad((k % 10000)::VARCHAR, 4, '0') END AS phone, n_name AS nationality,
 CASE k % 4 WHEN 0 THEN 1250.0::DOUBLE WHEN 3 THEN CAST(900 + k AS DOUBLE) END AS salary, concat_ws(',', CASE WHEN k % 5 <> 0 THEN 'name' END, CASE WHEN k % 3 = 0 THEN 'phone' END) AS uncertain, CASE WHEN k % 5 = 0 THEN 'name' ELSE '' END AS noted FROM f""")
def d2_declarants(spark, sf_dir):
    people = declarations.scrub_placeholders(declarations.declarants(forms(spark, sf_dir)[1]), ["name", "occupation"])
    # numbers that Kuwait gives to subscribers; others of eight digits, as 12 and a key of six figures, are misread
    marked = declarations.flag_uncertain(people.withColumn("noted", F.array_join("uncertain", ",")), first="24569")
    return marked.select("case_id", "name", "civil_id", "phone", "nationality", "salary", F.array_join("uncertain", ",").alias("uncertain"), "noted")


@query(f"WITH {FORMS} SELECT k AS case_id, CASE WHEN k % 5 = 0 THEN 'illegible' ELSE c_name END AS subject_name, CASE k % 4 WHEN 0 THEN 1250.0::DOUBLE WHEN 3 THEN CAST(900 + k AS DOUBLE) END AS income, n_name || CASE WHEN k % 10 = 0 THEN ',Kuwait' ELSE '' END AS expected_countries FROM f")
def d3_profile(spark, sf_dir):
    found = declarations.profile_from_declaration(forms(spark, sf_dir)[1])
    return found.select("case_id", "subject_name", "income", F.array_join("expected_countries", ",").alias("expected_countries"))


@query(f"WITH {ITEMS} SELECT case_id, section, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE) AS total FROM items GROUP BY case_id, section")
def d4_section_totals(spark, sf_dir):
    return declarations.section_totals(forms(spark, sf_dir)[2])


@query(f"WITH {FORMS} SELECT k AS case_id, 'debtsOwed' AS section FROM f")
def d9_none_ticks(spark, sf_dir):
    _, read, items = forms(spark, sf_dir)
    return declarations.none_ticks(read, items)


@query(f"""WITH {FORMS} SELECT c.c_custkey AS case_id, CAST(DATE '2024-01-01' + CAST(c.c_custkey % 97 AS INT) AS VARCHAR) AS uploaded_at, CASE WHEN f.k % 5 <> 0 THEN f.c_name WHEN f.k IS NOT NULL THEN 'illegible' END AS declarant FROM customer c LEFT JOIN f ON f.k = c.c_custkey WHERE c.c_custkey % 2 = 0 AND c.c_custkey % 3 <> 1""")
def d10_intake_queue(spark, sf_dir):
    people = declarations.declarants(forms(spark, sf_dir)[1])
    k = F.col("c_custkey")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    cases = customers.select(k.alias("case_id"), F.when(k % 2 == 0, "intake").otherwise("open").alias("status"))
    uploads = customers.where(k % 3 != 1).select(k.alias("case_id"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 97).cast("int")).alias("uploaded_at"))
    return declarations.intake_queue(cases, uploads, people).select("case_id", F.col("uploaded_at").cast("string").alias("uploaded_at"), "declarant")


@query("SELECT c_custkey AS case_id FROM customer WHERE c_custkey % 50 = 0")
def s6_broken_declarations(spark, sf_dir):
    found = declarations.broken_declarations(spark, forms(spark, sf_dir)[0])
    return found.select(F.regexp_extract("line", r'"case_id":(\d+)', 1).cast("long").alias("case_id"))


def scored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Features, hits and scores of the ledger's cases by the quality of their files."""
    txns, pairs, cases = with_pairs(spark, sf_dir, (*SCORED_COLUMNS, "file_id"))
    # the reports are read once, from the ledger that is written already
    return jobs.score(txns, cases, pairs, cut(quality.case_quality(td.bank_files(td.reported(txns))), "quality"), shown=True)


@query()
def b3_scores_by_quality(spark, sf_dir):
    return scored(spark, sf_dir)["scores"].select("case_id", "probability", "log_odds", round3(F.col("shrink")).alias("shrink"), "n_fired")


@query()
def b5_drivers(spark, sf_dir):
    out = scored(spark, sf_dir)
    return scoring.drivers(out["scores"], out["features"], out["hits"]).select("case_id", F.inline("drivers")).select("case_id", "r", "source", "label", "contribution")


@query(td.with_ledger("""WITH w AS (SELECT DISTINCT case_id, counterparty_name, subject_name, list_distinct(list_filter(string_split_regex(trim(regexp_replace(upper(coalesce(counterparty_name, '')), '[^A-Z ]+', ' ', 'g')), ' +'), lambda x: length(x) > 1)) AS a,
 list_distinct(list_filter(string_split_regex(trim(regexp_replace(upper(coalesce(subject_name, '')), '[^A-Z ]+', ' ', 'g')), ' +'), lambda x: length(x) > 1)) AS b FROM ledger JOIN cases USING (case_id))
SELECT case_id, counterparty_name, floor(coalesce(len(list_intersect(a, b)) / nullif(least(len(a), len(b)), 0), 0.0) * 1000 + 0.5) / 1000 AS similarity FROM w"""))
def i6_name_similarity(spark, sf_dir):
    rows = td.ledger(spark, sf_dir).join(td.cases(spark, sf_dir), "case_id").select("case_id", "counterparty_name", "subject_name").distinct()
    return rows.select("case_id", "counterparty_name", round3(name_similarity(F.col("counterparty_name"), F.col("subject_name"))).alias("similarity"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'InstaPay ' || (1000000 + c_custkey) WHEN 1 THEN 'SALEM ' || c_mktsegment WHEN 2 THEN 'Account ' || (10000 + c_custkey) WHEN 3 THEN 'Account ' || (20000 + c_custkey) WHEN 4 THEN 'Account ' || (30000 + c_custkey)
 WHEN 5 THEN 'OMAR ' || c_mktsegment WHEN 6 THEN 'NOUR ' || c_mktsegment END AS party FROM customer""")
def n10_extract_counterparty(spark, sf_dir):
    k = F.col("c_custkey")
    told = [
        F.concat(F.lit("InstaPay Credit : 865887-"), 1000000 + k), F.concat(F.lit("Transfer from: SALEM "), "c_mktsegment", F.lit(" | ref 5")), F.concat(F.lit("TRANSFER TO "), 10000 + k), F.concat(F.lit("Account transfer from "), 20000 + k),
        F.concat(F.lit("INTERNAL OPERATIONS To  # "), 30000 + k), F.concat(F.lit("INWARD SWIFT PAYMENT # X | 46000.000 KWD,OMAR "), "c_mktsegment", F.lit(" | z")), F.concat(F.lit("POS PRCH\nNOUR "), "c_mktsegment", F.lit("   SHUWEKH  KWT")), F.lit("Monthly fee"),
    ]
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    narrative = F.coalesce(*[F.when(k % len(told) == n, t) for n, t in enumerate(told)])
    return rows.select(k.alias("id"), extract_party(narrative).alias("party"))


INDICATORS, KINDS = ("C", "DR", None, "credit note", "سحب"), ("Debit card", "credit", None)


@query("""WITH r AS (SELECT c_custkey AS k, c_custkey % 5 = 0 AND c_custkey > 0 AS d, c_custkey % 7 = 0 AND c_custkey > 0 AS c, c_custkey % 11 = 0 AS none, c_custkey % 2 = 0 AS negative, c_custkey % 4 AS i, c_custkey % 3 AS t FROM customer)
SELECT k AS id, CASE WHEN d AND c THEN NULL WHEN d THEN 'debit' WHEN c THEN 'credit' WHEN none THEN NULL WHEN i IN (0, 3) THEN 'credit' WHEN i = 1 THEN 'debit' WHEN t = 0 THEN 'debit' WHEN t = 1 THEN 'credit' WHEN negative THEN 'debit' ELSE 'credit' END AS direction,
 CASE WHEN (d AND c) OR (NOT d AND NOT c AND none) THEN NULL ELSE CAST(k AS DOUBLE) END AS amount, CASE WHEN d AND c THEN 'both_sides' WHEN NOT d AND NOT c AND none THEN 'no_amount' END AS reason FROM r""")
def n6_resolve_direction(spark, sf_dir):
    k = F.col("c_custkey")
    value = lambda when, v: F.when(when, v).cast("double")
    pick = lambda values, n: F.coalesce(*[F.when(k % n == j, v) for j, v in enumerate(values) if v], F.lit(None).cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    found = normalize.resolve_direction(value(k % 5 == 0, k), value(k % 7 == 0, k), value(k % 11 != 0, F.when(k % 2 == 0, -k).otherwise(k)), pick(INDICATORS[:4], 4), pick(KINDS, 3))
    return rows.select(k.alias("id"), found.alias("f")).select("id", "f.*")
