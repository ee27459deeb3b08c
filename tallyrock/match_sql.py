"""SQL of the one-to-one matchings: each left in turn takes its best right that is free."""

from __future__ import annotations

from tallyrock import queries
from tallyrock.forensic_queries import severity
from tallyrock.plans import testdata as td
from tallyrock.queries import TRANSFERISH, money, r3, zone


def matched(edges: str, shared: bool = False) -> str:
    """Common tables that end in got (case_id, l, r); ``edges`` gives case_id, l, r, lk (place of the left in its case) and rk (of the right for its left)."""
    free = "NOT list_contains(s.used, e.r)" + (" AND NOT list_contains(s.used, e.l)" if shared else "")
    taken = "list_append(list_append(s.used, arg_min(e.r, e.rk)), min(e.l))" if shared else "list_append(s.used, arg_min(e.r, e.rk))"
    return f"""e AS ({edges}), most AS (SELECT case_id, max(lk) AS n FROM e GROUP BY case_id),
steps AS (SELECT case_id, 0::BIGINT AS k, NULL::BIGINT AS l, NULL::BIGINT AS r, []::BIGINT[] AS used FROM most
 UNION ALL SELECT s.case_id, s.k + 1, min(e.l), arg_min(e.r, e.rk), CASE WHEN min(e.r) IS NULL THEN s.used ELSE {taken} END
 FROM steps s JOIN most m ON m.case_id = s.case_id AND s.k < m.n LEFT JOIN e ON e.case_id = s.case_id AND e.lk = s.k + 1 AND {free} GROUP BY s.case_id, s.k, s.used),
got AS (SELECT case_id, l, r FROM steps WHERE r IS NOT NULL)"""


PLACES = "dense_rank() OVER (PARTITION BY a.case_id ORDER BY {0}) AS lk, row_number() OVER (PARTITION BY a.case_id, a.id ORDER BY {1}) AS rk"
BY_DATE = PLACES.format("a.posting_date, a.id", "b.posting_date, b.id")
DAYS = "b.posting_date BETWEEN a.posting_date + {0} AND a.posting_date + {1}"
PAIRED = "p AS (SELECT g.case_id, a.id AS l, b.id AS r, a.posting_date AS l_date, least(a.amount_kwd, b.amount_kwd) AS v FROM got g JOIN ext a ON a.id = g.l JOIN ext b ON b.id = g.r)"


def shown(most: int) -> str:
    """Ids of the first matches of a case by date."""
    return f"""i AS (SELECT case_id, string_agg(l::VARCHAR || ',' || r::VARCHAR, ',' ORDER BY n) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY l_date, l) AS n FROM p) WHERE n <= {most} GROUP BY case_id),
t AS (SELECT case_id, count(*) AS n, {money('v')} AS v FROM p GROUP BY case_id)"""


DWELL = matched(f"SELECT a.case_id, a.id AS l, b.id AS r, {BY_DATE} FROM ext a JOIN ext b ON a.case_id = b.case_id AND a.direction = 'credit' AND a.amount_kwd >= 500 AND b.direction = 'debit' AND b.amount_kwd >= 250 AND {DAYS.format(0, 30)} AND abs(b.amount_kwd - a.amount_kwd) <= greatest(1.0, a.amount_kwd * 0.05)")
SEQUENCES = matched(f"SELECT a.case_id, a.id AS l, b.id AS r, {BY_DATE} FROM ext a JOIN ext b ON a.case_id = b.case_id AND a.direction = 'credit' AND a.amount_kwd >= 500 AND b.direction = 'debit' AND b.amount_kwd >= 475 AND {DAYS.format(1, 3)} AND abs(b.amount_kwd - a.amount_kwd) <= a.amount_kwd * 0.05")
ECHOES = matched(
    f"SELECT a.case_id, a.id AS l, b.id AS r, {BY_DATE} FROM ext a JOIN ext b ON a.case_id = b.case_id AND a.direction = 'debit' AND a.amount_kwd >= 500 AND a.channel IN ('cash_withdrawal', 'transfer_out', 'cheque', 'other') AND b.direction = 'credit' AND b.amount_kwd >= 500"
    f" AND b.channel IN ('cash_deposit', 'transfer_in', 'cheque', 'other') AND a.bank <> b.bank AND {DAYS.format(0, 3)} AND abs(b.amount_kwd - a.amount_kwd) <= a.amount_kwd * 0.02"
)
LOOPS = matched(
    f"SELECT a.case_id, a.id AS l, b.id AS r, {BY_DATE} FROM moves a JOIN moves b ON a.case_id = b.case_id AND a.src = b.dst AND a.dst = b.src AND a.src <> a.dst AND {DAYS.format(1, 30)} AND abs(a.amount_kwd - b.amount_kwd) / greatest(a.amount_kwd, b.amount_kwd) <= 0.1", shared=True,
)

queries.PLAIN["f12_f13_dwell"] = (f"""WITH RECURSIVE {DWELL}, p AS (SELECT g.case_id, date_diff('day', a.posting_date, b.posting_date) AS gap, a.amount_kwd AS v FROM got g JOIN ext a ON a.id = g.l JOIN ext b ON b.id = g.r),
t AS (SELECT case_id, count(*) AS n, median(gap) AS mid, {money('CASE WHEN gap <= 3 THEN v END')} AS quick FROM p GROUP BY case_id), big AS (SELECT case_id, {money('amount_kwd')} AS v FROM ext WHERE direction = 'credit' AND amount_kwd >= 500 GROUP BY case_id),
s AS (SELECT c.case_id, coalesce(t.n, 0) AS n, t.mid, coalesce(coalesce(t.quick, 0.0) / nullif(big.v, 0), 0.0) AS q FROM cases c LEFT JOIN t USING (case_id) LEFT JOIN big USING (case_id))
SELECT case_id, 'dwell_median_days' AS key, CASE WHEN n >= 5 THEN {r3('mid')} ELSE 0.0 END AS value, CASE WHEN n < 5 THEN 'gated' WHEN mid <= 1.5 THEN 'critical' WHEN mid <= 3 THEN 'elevated' ELSE 'normal' END AS zone FROM s
UNION ALL SELECT case_id, 'quick_out_share', {r3('q')}, {zone('q', 0.35, 0.6)} FROM s""")
queries.ORACLES["f12_f13_dwell"] = td.with_ledger(queries.PLAIN["f12_f13_dwell"])
QUICK = f"""WITH RECURSIVE {DWELL} SELECT g.case_id, count(*) AS n FROM got g JOIN ext a ON a.id = g.l JOIN ext b ON b.id = g.r WHERE b.posting_date - a.posting_date <= 3 GROUP BY g.case_id"""

queries.ORACLES["t4_sequences"] = td.with_ledger(f"WITH RECURSIVE {SEQUENCES}, {PAIRED}, {shown(12)} SELECT case_id, 'TECH-SEQ-01' AS finding, {severity('n >= 8 OR v >= 30000', 'n >= 4 OR v >= 10000')}, CAST(n AS DOUBLE) AS metric, ids FROM t JOIN i USING (case_id) WHERE n >= 2 AND v >= 3000")
queries.ORACLES["t10_amount_echoes"] = td.with_ledger(f"WITH RECURSIVE {ECHOES}, {PAIRED}, {shown(15)} SELECT case_id, 'TECH-XB-04' AS finding, {severity('n >= 5 OR v >= 30000', 'n >= 3 OR v >= 10000')}, CAST(n AS DOUBLE) AS metric, ids FROM t JOIN i USING (case_id) WHERE n >= 2 AND v >= 3000")
queries.ORACLES["t6_return_loops"] = td.with_ledger(f"""WITH RECURSIVE moves AS (SELECT p.case_id, p.debit_id AS id, p.credit_id, p.amount_kwd, p.debit_date AS posting_date, d.bank || '|' || d.account_id AS src, c.bank || '|' || c.account_id AS dst FROM pairs p JOIN ledger d ON d.id = p.debit_id JOIN ledger c ON c.id = p.credit_id),
{LOOPS}, p AS (SELECT g.case_id, a.posting_date AS l_date, a.id AS l, least(a.amount_kwd, b.amount_kwd) AS v, concat_ws(',', a.id, a.credit_id, b.id, b.credit_id) AS four FROM got g JOIN moves a ON a.id = g.l JOIN moves b ON b.id = g.r),
i AS (SELECT case_id, string_agg(four, ',' ORDER BY n) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY l_date, l) AS n FROM p) WHERE n <= 7 GROUP BY case_id), t AS (SELECT case_id, count(*) AS n, {money('v')} AS v FROM p GROUP BY case_id)
SELECT case_id, 'TECH-NET-03' AS finding, {severity('n >= 4 OR v >= 50000', 'n >= 2 OR v >= 15000')}, CAST(n AS DOUBLE) AS metric, ids FROM t JOIN i USING (case_id) WHERE v >= 3000""")

CONFIDENT = f"""c AS (SELECT d.case_id, d.id AS d_id, c.id AS c_id, d.amount_kwd, abs(d.amount_kwd - c.amount_kwd) AS diff, date_diff('day', d.posting_date, c.posting_date) AS gap, d.bank AS from_bank, c.bank AS to_bank, d.own OR c.own AS own,
  coalesce(starts_with(d.counterparty_name, 'Customer#'), false) OR coalesce(starts_with(c.counterparty_name, 'Customer#'), false) AS named, coalesce(upper(d.counterparty_bank) = c.bank, false) OR coalesce(upper(c.counterparty_bank) = d.bank, false) AS bank
 FROM (SELECT *, unnest(range(0, 4)) AS later FROM t WHERE direction = 'debit') d JOIN t c ON d.case_id = c.case_id AND c.direction = 'credit' AND c.posting_date = d.posting_date + CAST(later AS INT)
 WHERE (d.bank <> c.bank OR d.account_id <> c.account_id) AND abs(d.amount_kwd - c.amount_kwd) <= greatest(0.5, d.amount_kwd * 0.005)),
rated AS (SELECT *, 0.35::DOUBLE + CASE WHEN diff < 0.001 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN gap <= 1 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN own THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN named THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN bank THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN from_bank <> to_bank THEN 0.05::DOUBLE ELSE 0 END AS raw FROM c)"""
EDGES = "SELECT case_id, d_id AS l, c_id AS r, dense_rank() OVER (PARTITION BY case_id ORDER BY -amount_kwd, d_id) AS lk, row_number() OVER (PARTITION BY case_id, d_id ORDER BY CASE WHEN raw > 0.99 THEN -2.0 ELSE -raw END, CASE WHEN raw > 0.99 THEN -c_id ELSE c_id END) AS rk FROM rated WHERE raw >= 0.55"
queries.ORACLES["c5_internal_pairs"] = td.with_ledger(f"""WITH RECURSIVE t AS ({TRANSFERISH}), {CONFIDENT}, {matched(EDGES)}
SELECT g.case_id, row_number() OVER (PARTITION BY g.case_id ORDER BY -amount_kwd, d_id) AS pair_id, d_id AS debit_id, c_id AS credit_id, amount_kwd, gap AS date_gap_days, from_bank, to_bank,
 concat_ws('; ', CASE WHEN diff < 0.001 THEN 'exact amount' ELSE printf('amount within %.3f KWD', diff) END, CASE gap WHEN 0 THEN 'same day' WHEN 1 THEN 'next day' ELSE printf('%d-day gap', gap) END, CASE WHEN own THEN 'own-transfer narrative' END,
 CASE WHEN named THEN 'counterparty name matches subject' END, CASE WHEN bank THEN 'counterparty bank matches receiving bank' END) AS match_basis, least(raw, 0.99::DOUBLE) AS confidence
FROM got g JOIN rated ON rated.d_id = g.l AND rated.c_id = g.r""")
