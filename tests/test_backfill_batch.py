"""A backfill's batch holds the columns that it renews and its key, and nothing else of the payments travels."""

from sarraf.plans import detail_queries
from sarraf.sources import sinks


def test_backfill_writes_back_renewed_columns_alone(spark, sf, monkeypatch):
    batches, upsert = [], sinks.upsert_ledger
    monkeypatch.setattr(sinks, "upsert_ledger", lambda held, batch: batches.append(batch.columns) or upsert(held, batch))
    detail_queries.k5_backfill(spark, sf)
    assert set(batches[0]) == {*sinks.KEY, "transaction_category", "category_confidence", "category_source", "category_rule_id", "needs_review"}
