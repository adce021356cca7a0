"""Features of accounts come from payments dealt once by account."""

from test_activity import LOW, warned

from sarraf.operators import activity, detectors
from sarraf.plans import fixtures


def test_features_read_dealt_payments(spark, sf, monkeypatch):
    rows = detectors.prepared(fixtures.ledger(spark, sf))
    whole = warned(detectors.features_of(detectors.partials(rows, LOW), LOW))
    found = detectors.features(rows, LOW)
    assert "dealt_" in found._jdf.queryExecution().executedPlan().toString() and warned(found) == whole
    monkeypatch.setattr(activity, "CROWDS", 40)
    monkeypatch.setattr(activity, "BUSY", 150)
    assert warned(detectors.features(rows, LOW)) == whole


def test_group_detectors_read_dealt_payments(spark, sf):
    found = detectors.group_detectors(detectors.features(detectors.prepared(fixtures.ledger(spark, sf)), LOW), LOW)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not found.isEmpty() and "dealt_" in plan and "l_orderkey" not in plan


def test_row_evidence_reads_dealt_features(spark, sf):
    from sarraf.plans.queries import QUERIES

    for name in ("f11_party_evidence", "f12_row_evidence"):
        assert "dealt_" in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
