from tests import golden

from tallyrock.operators import features, netting, scoring


def test_seven_cases_in_one_ledger(spark):
    txns = spark.createDataFrame(golden.rows(), golden.SCHEMA).cache()
    cases = spark.createDataFrame(golden.SUBJECTS, golden.CASES)
    pairs = netting.find_internal_pairs(txns, cases).cache()
    assert {r["case_id"]: r["count"] for r in pairs.groupBy("case_id").count().collect()} == {5: 4, 7: 2}
    found, evidence = features.features(txns, pairs, cases)
    found = found.cache()
    hits = scoring.evaluate_rules(found, evidence).cache()
    fired = {}
    for r in hits.where("fired").collect():
        fired.setdefault(r["case_id"], set()).add(r["rule_id"])
    scores = {r["case_id"]: r for r in scoring.posterior(cases, found, hits).collect()}
    for case, (rules, band, low, high) in golden.EXPECTED.items():
        assert fired.get(case, set()) == rules, case
        assert scores[case]["band"] == band and low <= scores[case]["probability"] < high, scores[case]
    p = {c: s["probability"] for c, s in scores.items()}
    assert p[1] < p[6] < min(p[4], p[5]) and max(p[3], p[4], p[5]) < p[7]
    assert found.where("case_id = 1 and zone in ('elevated', 'critical')").count() == 0
    assert scoring.drivers(scoring.posterior(cases, found, hits), found, hits).count() == 7
