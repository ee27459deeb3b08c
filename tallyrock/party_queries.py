"""Queries over parties that spellings resolve to, with SQL that finds the same components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrock.forensic_queries import HEAD, severity
from tallyrock.operators import features as ft
from tallyrock.operators import forensics, identities, views
from tallyrock.plans import testdata as td
from tallyrock.queries import ORACLES, SELF, money, query, r3, written


def _covered(a: str, b: str) -> str:
    """Each token of a is in b, or an initial of one of b's, or begins with one."""
    fits = "x = y OR (length(x) <= 2 AND starts_with(y, x)) OR (length(x) > 2 AND length(y) <= 2 AND starts_with(x, y))"
    return f"len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: {fits})) = 0)) = 0"


#: Spellings of a case, the pairs of them that likely are one party, and the least key that can be reached.
PARTIES = f"""spelled AS (SELECT *, trim(regexp_replace(counterparty_name, ' +', ' ', 'g')) AS display, 'name:' || upper(trim(regexp_replace(regexp_replace(counterparty_name, '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) AS key FROM ext),
keys AS (SELECT DISTINCT case_id, key, string_split(substr(key, 6), ' ') AS t FROM spelled WHERE key IS NOT NULL),
words AS (SELECT *, unnest(t) AS w, len(list_filter(t, lambda x: length(x) <= 2)) > 0 AS short, list_sort(list_distinct(t)) AS same FROM keys),
alike AS (SELECT DISTINCT a.case_id, a.key AS a, b.key AS b FROM words a JOIN words b ON a.case_id = b.case_id AND a.w = b.w AND length(a.w) >= 3 AND a.key <> b.key WHERE (a.short OR b.short OR a.same = b.same) AND {_covered('a.t', 'b.t')} AND {_covered('b.t', 'a.t')}),
reach AS (SELECT case_id, key, key AS other FROM keys UNION SELECT r.case_id, r.key, s.b FROM reach r JOIN alike s ON s.case_id = r.case_id AND s.a = r.other),
parties AS (SELECT case_id, key, min(other) AS cluster FROM reach GROUP BY ALL),
resolved AS (SELECT spelled.*, cluster FROM spelled LEFT JOIN parties USING (case_id, key))"""


def resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(identities, their clusters, external rows with clusters)"""
    return identities.resolved(written(spark, sf_dir)[2])


def spelled(spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(external rows of these columns, the parties of their spellings); pairs need the bank and the date besides."""
    ext = written(spark, sf_dir, tuple(dict.fromkeys((*columns, "bank", "posting_date", "direction", "amount_kwd"))), columns)[2]
    return ext, identities.party_spellings(ext)


@query(f"WITH RECURSIVE {PARTIES} SELECT case_id AS scope, key, cluster FROM parties")
def i3_resolve_identities(spark, sf_dir):
    return resolved(spark, sf_dir)[1]


@query(f"""WITH RECURSIVE {PARTIES}, n AS (SELECT case_id, cluster, display, key, count(*) AS n FROM resolved WHERE key IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, cluster ORDER BY len(list_filter(string_split(substr(key, 6), ' '), lambda x: length(x) >= 3)) DESC, length(display) DESC, n DESC, display) AS r FROM n)
SELECT case_id AS scope, cluster, display, 'name' AS kind FROM r WHERE r = 1""")
def i4_cluster_display(spark, sf_dir):
    names, clusters, _ = resolved(spark, sf_dir)
    return identities.cluster_display(names, clusters)


@query(f"WITH RECURSIVE {PARTIES} SELECT id, cluster FROM resolved")
def i5_cluster_key(spark, sf_dir):
    return resolved(spark, sf_dir)[2].select("id", "cluster")


SUMS = f"""WITH RECURSIVE {PARTIES}, b AS (SELECT case_id, cluster, {money('amount_kwd')} AS v, {money("CASE WHEN direction = 'debit' THEN amount_kwd END")} AS out, count(*) FILTER (direction = 'credit' AND NOT {SELF}) AS pays FROM resolved WHERE cluster IS NOT NULL GROUP BY ALL),
p AS (SELECT *, v / sum(v) OVER (PARTITION BY case_id) AS p, row_number() OVER (PARTITION BY case_id ORDER BY out DESC, cluster DESC) AS r FROM b)"""


@query(f"""{SUMS} SELECT case_id, count(*) AS parties, {r3('sum(p * p)')} AS hhi, count(*) FILTER (pays > 0) AS fan_in, {r3('max(out) / nullif(sum(out), 0)')} AS top_share, max(CASE WHEN r = 1 AND out > 0 THEN cluster END) AS top_party FROM p GROUP BY case_id""")
def f20_f22_parties(spark, sf_dir):
    found = ft.spelled_sums(*spelled(spark, sf_dir, ("case_id", "id", "direction", "amount_kwd", "counterparty_name", "narrative")))
    return found.withColumns({"hhi": ft.round3(F.col("hhi")), "top_share": ft.round3(F.col("top_share"))})


@query(f"""WITH RECURSIVE {PARTIES}, b AS (SELECT case_id, direction, cluster, {money('amount_kwd')} AS v FROM resolved WHERE cluster IS NOT NULL GROUP BY ALL), p AS (SELECT *, sum(v) OVER (PARTITION BY case_id, direction) AS t FROM b),
s AS (SELECT case_id, direction, any_value(t) AS t, sum(v / t * (v / t)) AS hhi, max(v / t) AS top, max_by(cluster, {{'v': v, 'c': cluster}}) AS cluster FROM p GROUP BY ALL HAVING count(*) >= 3 AND any_value(t) >= 3000),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY greatest(hhi, top) DESC, direction) AS r FROM s), k AS (SELECT * FROM r WHERE r = 1 AND (hhi >= 0.35 OR top >= 0.5)),
i AS (SELECT k.case_id, e.id, row_number() OVER (PARTITION BY k.case_id ORDER BY e.amount_kwd DESC, e.id) AS n FROM k JOIN resolved e USING (case_id, direction, cluster))
SELECT k.case_id, 'TECH-NET-01' AS finding, {severity('top >= 0.75 AND t >= 10000', 'hhi >= 0.5')}, {r3('hhi')} AS metric, (SELECT string_agg(id::VARCHAR, ',' ORDER BY n) FROM i WHERE i.case_id = k.case_id AND n <= 20) AS ids FROM k""")
def t3_resolved_concentration(spark, sf_dir):
    return forensics.spelled_concentration(*spelled(spark, sf_dir, ("case_id", "id", "direction", "amount_kwd", "counterparty_name"))).select(*HEAD, F.array_join("txn_ids", ",").alias("ids"))


@query(f"""WITH RECURSIVE {PARTIES}, b AS (SELECT case_id, cluster, count(DISTINCT bank) AS banks, {money('amount_kwd')} AS v FROM resolved WHERE cluster IS NOT NULL GROUP BY ALL HAVING count(DISTINCT bank) >= 2 AND {money('amount_kwd')} >= 1000),
i AS (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY v DESC, cluster, amount_kwd DESC, id) AS n FROM resolved JOIN b USING (case_id, cluster)), ids AS (SELECT case_id, string_agg(id::VARCHAR, ',' ORDER BY n) AS ids FROM i WHERE n <= 30 GROUP BY case_id)
SELECT case_id, 'TECH-XB-01' AS finding, {severity(f"max(banks) >= 3 OR {money('v')} >= 20000", f"count(*) >= 2 OR {money('v')} >= 8000")}, CAST(count(*) AS DOUBLE) AS metric, any_value(ids) AS ids FROM b JOIN ids USING (case_id) GROUP BY case_id""")
def t7_resolved_bridging(spark, sf_dir):
    return forensics.bridging(resolved(spark, sf_dir)[2]).select(*HEAD, F.array_join("txn_ids", ",").alias("ids"))


NODES = f"""{PARTIES}, e AS (SELECT *, concat_ws('|', 'acct', bank, account_id) AS account, CASE WHEN channel IN ('cash_deposit', 'cash_withdrawal') THEN 'cash' WHEN cluster IS NOT NULL THEN 'cp|' || cluster END AS other, id % 9 = 0 AS flagged FROM resolved),
s AS (SELECT id, flagged, case_id, account AS node, direction = 'credit' AS i, amount_kwd, counterparty_country AS c, account_id FROM e UNION ALL SELECT id, flagged, case_id, other, direction = 'debit', amount_kwd, counterparty_country, account_id FROM e WHERE other IS NOT NULL),
f AS (SELECT case_id, node, id, row_number() OVER (PARTITION BY case_id, node ORDER BY id) AS n FROM s WHERE flagged)"""


#: What the nodes are made of; pairs need the date besides.
NODE_COLUMNS = ("case_id", "id", "bank", "account_id", "direction", "amount_kwd", "channel", "counterparty_name", "counterparty_country")


@query(f"""WITH RECURSIVE {NODES} SELECT case_id, node, CASE WHEN node = 'cash' THEN 'cash' WHEN starts_with(node, 'acct|') THEN 'account' ELSE 'counterparty' END AS kind, {money('CASE WHEN i THEN amount_kwd END')} AS inflow, {money('CASE WHEN NOT i THEN amount_kwd END')} AS outflow, count(*) AS n,
 count(*) FILTER (flagged) AS flagged, coalesce((SELECT string_agg(id::VARCHAR, ',' ORDER BY n) FROM f WHERE f.case_id = s.case_id AND f.node = s.node AND n <= 8), '') AS flagged_ids, CASE WHEN starts_with(node, 'cp|') THEN min_by(c, id) FILTER (c IS NOT NULL) END AS country, CASE WHEN starts_with(node, 'acct|') THEN right(min(account_id), 4) END AS tail FROM s GROUP BY case_id, node""")
def r10_resolved_nodes(spark, sf_dir):
    ext = written(spark, sf_dir, (*NODE_COLUMNS, "posting_date"))[2].select(*NODE_COLUMNS)
    nodes = views.party_nodes(ext, identities.party_spellings(ext), F.col("id") % 9 == 0)
    return nodes.select("case_id", "node", "kind", "inflow", "outflow", "n", "flagged", F.array_join("flagged_ids", ",").alias("flagged_ids"), "country", "tail")


#: The same over all cases: one scope, so that spellings of several cases meet.
EVERYWHERE = PARTIES.replace("keys AS (SELECT DISTINCT case_id, key", "keys AS (SELECT DISTINCT 0 AS case_id, key").replace("parties USING (case_id, key)", "(SELECT key, cluster FROM parties) USING (key)")

ORACLES["r3_counterparty_intel"] = td.with_ledger(f"""WITH RECURSIVE {EVERYWHERE}, b AS (SELECT cluster, case_id, count(*) AS n, {money('amount_kwd')} AS total, {money("CASE WHEN direction = 'credit' THEN amount_kwd END")} AS inflow, {money("CASE WHEN direction = 'debit' THEN amount_kwd END")} AS outflow FROM resolved WHERE cluster IS NOT NULL GROUP BY ALL),
g AS (SELECT cluster, count(*) AS cases, {money('total')} AS total FROM b GROUP BY cluster HAVING count(*) >= 2), top AS (SELECT cluster FROM g ORDER BY cases DESC, total DESC, cluster LIMIT 200)
SELECT b.cluster, b.case_id, subject_name, n, total, inflow, outflow FROM b JOIN top USING (cluster) LEFT JOIN cases USING (case_id)""")
