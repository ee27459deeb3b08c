"""SQL of all features, rules and scores, put together from the features' own."""

from __future__ import annotations

from tallyrock import party_queries  # noqa: F401  registers the parties' SQL
from tallyrock.constants import COVERED_BY, FEATURE_KEYS, RULES
from tallyrock.match_sql import QUICK
from tallyrock.plans import testdata as td
from tallyrock.queries import ORACLES, PLAIN, SUM_CTE, VAGUE, r3, zone

_DAYS = "SELECT case_id, posting_date, max(amount_kwd) AS most, CAST(sum(CAST(amount_kwd AS DECIMAL(20,6))) AS DOUBLE) AS total, count(DISTINCT bank) AS banks, count(*) AS n FROM ext WHERE channel = 'cash_deposit' GROUP BY ALL"
FEATURES = f"""split AS (SELECT case_id, count(*) FILTER (banks >= 2) AS multi_days, count(*) FILTER (banks < 2) AS split_days FROM ({_DAYS}) WHERE most < 3000 AND total >= 3000 AND (banks >= 2 OR n >= 2) GROUP BY case_id),
relay AS (SELECT c.case_id, count(f.debit_id) AS n FROM cases c LEFT JOIN ({PLAIN['f14_relay_chains']}) f USING (case_id) GROUP BY c.case_id), burst AS ({PLAIN['f16_bursts']}), woken AS ({PLAIN['f17_dormancy']}), party AS ({PLAIN['f20_f22_parties']}), quick AS ({QUICK}),
features AS ({" UNION ALL ".join(f"SELECT case_id, key, CAST(value AS DOUBLE) AS value, zone FROM ({PLAIN[q]})" for q in ("f_sum_features", "f4_cash_peak", "f6_f7_split_days", "f8_fragmentation", "f12_f13_dwell", "f19_month_break"))}
 UNION ALL SELECT case_id, 'relay_chain_count', CAST(n AS DOUBLE), {zone('n', 2, 4)} FROM relay
 UNION ALL SELECT c.case_id, 'velocity_burst_z', coalesce(z, 0.0), CASE WHEN z IS NULL THEN 'gated' ELSE {zone('z', 2.5, 3.5)} END FROM cases c LEFT JOIN burst USING (case_id)
 UNION ALL SELECT c.case_id, 'dormancy_reactivation', CASE WHEN w.case_id IS NULL THEN 0.0 ELSE 1.0 END, CASE WHEN w.case_id IS NULL THEN 'normal' ELSE 'elevated' END FROM cases c LEFT JOIN woken w USING (case_id)
 UNION ALL SELECT c.case_id, 'counterparty_concentration_hhi', CASE WHEN parties >= 3 THEN {r3('hhi')} ELSE 0.0 END, CASE WHEN coalesce(parties >= 3, false) THEN {zone('hhi', 0.4, 0.65)} ELSE 'gated' END FROM cases c LEFT JOIN party USING (case_id)
 UNION ALL SELECT c.case_id, 'fan_in_count', CAST(coalesce(fan_in, 0) AS DOUBLE), {zone('coalesce(fan_in, 0)', 15, 40)} FROM cases c LEFT JOIN party USING (case_id))"""

#: When a rule fires, and the weight that then stands in for its own.
_V, _OPEN = (lambda k: f"coalesce({k}, 0)"), (lambda k: f"coalesce({k}_z, 'gated') <> 'gated'")
CONDITIONS = {
    "R-STRUCT-01": (f"{_OPEN('near_threshold_density')} AND n_near >= 4 AND {_V('near_threshold_density')} >= 0.2", f"WHEN {_V('near_threshold_density')} >= 0.35 THEN 1.4"),
    "R-STRUCT-02": ("coalesce(multi_days, 0) >= 2", ""), "R-STRUCT-03": (f"coalesce(split_days, 0) >= 1 AND {_V('aggregate_threshold_evasion')} >= 1", "WHEN split_days < 3 THEN 0.45"),
    "R-SMURF-01": (f"{_OPEN('bank_fragmentation_index')} AND {_V('bank_fragmentation_index')} >= 0.45 AND n_cash_in >= 8", ""),
    "R-LAYER-01": (f"coalesce(pass_through_ratio_z = 'elevated', false) OR ({_V('pass_through_ratio')} BETWEEN 0.95 AND 1.05 AND credits >= 10000)", ""),
    "R-LAYER-02": (f"{_V('quick_out_share')} >= 0.35 AND coalesce(n_quick, 0) >= 3", f"WHEN {_V('quick_out_share')} >= 0.6 THEN 1.2"), "R-LAYER-03": ("coalesce(n_relay, 0) >= 2", ""),
    "R-CIRC-01": (f"{_V('internal_circulation_share')} >= 0.25", ""),
    "R-CASH-01": (f"{_OPEN('income_multiple')} AND ({_V('cash_to_income_peak')} >= 2 OR ({_V('income_multiple')} >= 3 AND {_V('cash_share')} >= 0.4))", f"WHEN {_V('cash_to_income_peak')} >= 4 THEN 1.5"),
    "R-CASH-02": (f"{_OPEN('round_number_share')} AND {_V('round_number_share')} >= 0.6 AND n_round >= 10", ""), "R-GEO-01": (f"n_black > 0 OR {_V('high_risk_geo_share')} >= 0.02", "WHEN n_black > 0 THEN 1.3"),
    "R-VEL-01": (f"{_OPEN('velocity_burst_z')} AND {_V('velocity_burst_z')} >= 2.5", f"WHEN {_V('velocity_burst_z')} >= 3.5 THEN 0.9"), "R-DORM-01": (f"{_V('dormancy_reactivation')} >= 1", ""),
    "R-NARR-01": (f"{_V('narrative_vagueness_share')} >= 0.5 AND n_vague_high >= 5", ""), "R-FUNNEL-01": (f"{_V('fan_in_count')} >= 12 AND {_V('pass_through_ratio')} >= 0.8 AND (top_share IS NULL OR top_share >= 0.5)", ""),
    "R-VA-01": ("n_crypto >= 2", ""), "R-BENF-01": (f"{_OPEN('benford_mad')} AND {_V('benford_mad')} >= 0.015", ""),
}
_WIDE = ", ".join(f"max(value) FILTER (key = '{k}') AS {k}, max(zone) FILTER (key = '{k}') AS {k}_z" for k in FEATURE_KEYS)
_HITS = " UNION ALL ".join(
    f"SELECT case_id, {n} AS n, '{r.rule_id}' AS rule_id, '{r.family}' AS family, {r.floor} AS floor, {c} AS fired, CAST(CASE {more} ELSE {r.weight} END AS DOUBLE) AS weight FROM wide" if (more := CONDITIONS[r.rule_id][1]) else
    f"SELECT case_id, {n}, '{r.rule_id}', '{r.family}', {r.floor}, {c}, CAST({r.weight} AS DOUBLE) FROM wide" for n, r in enumerate(RULES) for c in (CONDITIONS[r.rule_id][0],)
)
_COVER = "CASE key " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in COVERED_BY.items()) + " ELSE '' END"
SCORES = f"""{FEATURES}, {SUM_CTE}, more AS (SELECT case_id, count(*) FILTER (channel = 'cash_deposit') AS n_cash_in, count(*) FILTER ({VAGUE} AND amount_kwd >= 1000) AS n_vague_high FROM ext GROUP BY case_id),
wide AS (SELECT s.case_id, any_value(s.credits) AS credits, any_value(n_near) AS n_near, any_value(n_round) AS n_round, any_value(n_black) AS n_black, any_value(n_crypto) AS n_crypto, any_value(n_cash_in) AS n_cash_in, any_value(n_vague_high) AS n_vague_high, any_value(multi_days) AS multi_days, any_value(split_days) AS split_days,
 any_value(quick.n) AS n_quick, any_value(relay.n) AS n_relay, any_value(party.top_share) AS top_share, {_WIDE} FROM s JOIN features f USING (case_id) LEFT JOIN more USING (case_id) LEFT JOIN split USING (case_id) LEFT JOIN quick USING (case_id) LEFT JOIN relay USING (case_id) LEFT JOIN party USING (case_id) GROUP BY s.case_id),
hits AS ({_HITS}), fired AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY case_id, family ORDER BY weight DESC, n) = 1 THEN weight ELSE weight * 0.5 END AS added FROM hits WHERE fired),
hot AS (SELECT f.* FROM features f WHERE zone IN ('elevated', 'critical') AND NOT EXISTS (SELECT 1 FROM fired h WHERE h.case_id = f.case_id AND h.rule_id = {_COVER})),
admitted AS (SELECT *, row_number() OVER (PARTITION BY case_id, zone ORDER BY list_position([{", ".join(f"'{k}'" for k in FEATURE_KEYS)}], key), key) AS r, count(*) FILTER (zone = 'critical') OVER (PARTITION BY case_id) AS c FROM hot),
rest AS (SELECT case_id, CAST(sum(CASE zone WHEN 'critical' THEN 0.3 ELSE 0.15 END) AS DOUBLE) AS rest FROM admitted WHERE r <= CASE zone WHEN 'critical' THEN 3 ELSE 6 - 2 * least(c, 3) END GROUP BY case_id),
ruled AS (SELECT case_id, CAST(sum(CAST(added AS DECIMAL(20,6))) AS DOUBLE) AS rules, CAST(max(floor) AS DOUBLE) AS floor, count(*) AS n_fired, string_agg(rule_id, ',' ORDER BY rule_id) AS names FROM fired GROUP BY case_id),
rated AS (SELECT c.case_id, coalesce(rest, 0.0) + coalesce(rules, 0.0) AS evidence, coalesce(floor, 0.0) AS floor, coalesce(n_fired, 0) AS n_fired, names, coalesce(q.q, 1.0) AS q FROM cases c LEFT JOIN ruled USING (case_id) LEFT JOIN rest USING (case_id) LEFT JOIN known_quality q USING (case_id)),
base AS (SELECT *, CASE WHEN q >= 0.9 THEN 1.0::DOUBLE ELSE greatest(0.55::DOUBLE, q / 0.9) END AS shrink, CASE WHEN q < 0.7 THEN floor * 0.75 ELSE floor END AS least_p FROM rated),
odds AS (SELECT *, ln(0.02 / 0.98) + evidence * shrink AS o FROM base), raised AS (SELECT *, 1 / (1 + exp(-o)) < least_p AS up FROM odds),
scored AS (SELECT *, least(0.97, CASE WHEN up THEN least_p ELSE 1 / (1 + exp(-o)) END) AS p, CASE WHEN up THEN ln(least_p / (1 - least_p)) ELSE o END AS lo FROM raised)"""

ORACLES["features_all"] = td.with_ledger(f"WITH {FEATURES} SELECT * FROM features")
#: Quality of 1 for all cases, and that of the cases' files.
ONE = "known_quality AS (SELECT case_id, 1.0::DOUBLE AS q FROM cases)"
OF_FILES = "known_quality AS (SELECT case_id, sum(quality * greatest(1, rows_parsed)) / sum(greatest(1, rows_parsed)) AS q FROM files GROUP BY case_id)"
ORACLES["rules_and_score"] = td.with_ledger(f"""WITH {ONE}, {SCORES} SELECT case_id, floor(p * 10000 + 0.5) / 10000 AS probability, {r3('lo')} AS log_odds, CASE WHEN p < 0.05 THEN 'Low' WHEN p < 0.2 THEN 'Moderate' WHEN p < 0.5 THEN 'Elevated' WHEN p < 0.8 THEN 'High' ELSE 'Critical' END AS band,
 evidence, shrink, n_fired, names AS rules FROM scored""")
PRIOR = "ln(0.02 / 0.98)"
ORACLES["b3_scores_by_quality"] = td.with_files(f"WITH {OF_FILES}, {SCORES} SELECT case_id, floor(p * 10000 + 0.5) / 10000 AS probability, {r3('lo')} AS log_odds, {r3('shrink')} AS shrink, n_fired FROM scored")
ORACLES["b5_drivers"] = td.with_files(f"""WITH {OF_FILES}, {SCORES}, parts AS (SELECT case_id, 'prior' AS source, 'prior' AS label, {PRIOR} AS c FROM base UNION ALL SELECT case_id, 'rule', rule_id, added * shrink FROM fired JOIN base USING (case_id)
 UNION ALL SELECT case_id, 'feature', key, CASE zone WHEN 'critical' THEN 0.3::DOUBLE ELSE 0.15::DOUBLE END * shrink FROM admitted JOIN base USING (case_id) WHERE r <= CASE zone WHEN 'critical' THEN 3 ELSE 6 - 2 * least(c, 3) END
 UNION ALL SELECT case_id, 'data_quality', 'data_quality', evidence * shrink - evidence FROM base WHERE shrink < 1 AND evidence > 0), told AS (SELECT case_id, source, label, {r3('c')} AS contribution FROM parts)
SELECT * FROM (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY abs(contribution) DESC, source, label) AS r, source, label, contribution FROM told) WHERE r <= 16""")
