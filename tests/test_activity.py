"""Detectors from stored partial sums: the same warnings as from all payments, whatever the batches."""

from datetime import date, datetime

import pytest
from test_operators import LEDGER, TRANSIT, tx

from sarraf.operators import activity, detectors
from sarraf.plans import fixtures
from sarraf.sources import sinks, versions

LOW = detectors.Thresholds(min_rows=1, flush_credit=1, flush_debit=1, flush_ratio=0.01, spike_rows=2, repeat_count=2, repeat_share=0.0, party_rows=2, party_turnover=1, mismatch_rows=1, fan_credits=1, fan_senders=1)


def batch(spark, rows):
    return spark.createDataFrame([(*r, r[0]) for r in rows], LEDGER + ", row_hash string")


def warned(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def folders(monkeypatch):
    """Data folders of the ledger that a refresh reads."""
    seen, real = [], versions.read

    def read(spark, path, keys=None, version=None):
        v = version if isinstance(version, versions.Version) else versions.latest(spark, path)
        if path.endswith("ledger"):
            seen.extend(f for k, fs in v.parts.items() if keys is None or k in keys for f in fs)
        return real(spark, path, keys, version)

    monkeypatch.setattr(activity.versions, "read", read)
    return seen


def test_batches_add_up(spark, tmp_path, folders):
    ledger, table = str(tmp_path / "ledger"), str(tmp_path / "partials")
    mend = lambda rows, project, file="f": [(r[0] + f"{project}{file}", project, file, *r[3:]) for r in rows]
    both = [(*r[:7], r[7], r[7], *r[9:]) for r in mend(TRANSIT[:3], "p", "both")]  # credit and debit in one row
    undated = [(*r[:3], None, None, *r[5:]) for r in mend(TRANSIT[:2], "p", "undated")]
    first = mend(TRANSIT[:6], "p") + mend(TRANSIT, "") + mend(TRANSIT, None) + both + undated
    second = mend(TRANSIT[4:], "p") + [tx(50, 9, debit=300_000, purpose="частный", file="f2")]

    def check():
        whole = versions.read(spark, ledger).drop("row_hash")
        assert warned(detectors.detect_stored(spark, ledger, table, LOW)) == warned(detectors.detect(whole, LOW))

    one = sinks.upsert_stored(batch(spark, first), ledger)
    check()
    folders.clear()
    two = sinks.upsert_stored(batch(spark, second), ledger)
    folders.clear()
    detectors.detect_stored(spark, ledger, table, LOW)
    fresh = {f for fs in two.parts.values() for f in fs} - {f for fs in one.parts.values() for f in fs}
    assert fresh and set(folders) == fresh  # the second batch reads its own rows and nothing else
    check()
    folders.clear()
    number = versions.latest(spark, table).number
    detectors.detect_stored(spark, ledger, table, LOW)
    assert not folders and versions.latest(spark, table).number == number
    renewed = batch(spark, second).withColumn("transaction_category", versions.F.lit("снятие"))
    sinks.upsert_stored(renewed, ledger)  # the category decides what is cash
    check()
    sinks.purge_stored(spark, {"ledger": ledger}, "")
    check()
    assert versions.key("") not in versions.latest(spark, table).parts
    number = versions.latest(spark, table).number
    assert warned(detectors.detect_stored(spark, ledger, table)) == warned(detectors.detect(versions.read(spark, ledger).drop("row_hash")))  # other limits: counted anew
    assert versions.latest(spark, table).number == number + (LOW.small_limit != detectors.Thresholds().small_limit)
    versions.vacuum(spark, ledger, keep=1, grace=-60)
    sinks.upsert_stored(batch(spark, mend(TRANSIT, "q")), ledger)
    versions.vacuum(spark, ledger, keep=1, grace=-60)  # what the partials last counted is not to be had any more
    check()


def test_a_refresh_that_breaks_off_counts_nothing_twice(spark, tmp_path, monkeypatch):
    ledger, table = str(tmp_path / "ledger"), str(tmp_path / "partials")
    sinks.upsert_stored(batch(spark, TRANSIT), ledger)
    monkeypatch.setattr(versions, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("power cut")))
    with pytest.raises(RuntimeError):
        detectors.detect_stored(spark, ledger, table)
    monkeypatch.undo()
    for _ in range(2):
        assert warned(detectors.detect_stored(spark, ledger, table)) == warned(detectors.detect(versions.read(spark, ledger).drop("row_hash")))


def test_partials_merge(spark, sf):
    rows = detectors.prepared(fixtures.ledger(spark, sf))
    whole = activity.of(rows, 1e5, 2e5)
    parts = [activity.of(rows.filter(f"pmod(xxhash64(tx_id), 2) = {i}"), 1e5, 2e5) for i in (0, 1)]
    cols = sorted(whole.columns)
    both = activity.merged(parts[0].unionByName(parts[1]))
    assert sorted(map(str, both.select(*cols).collect())) == sorted(map(str, whole.select(*cols).collect()))
    split = parts[0].unionByName(parts[1])
    for of in (activity.by_group, activity.by_day, activity.by_party, activity.by_amount, lambda x: activity.repeated_credits(x, 2)):
        assert warned(of(split)) == warned(of(whole))


def test_sums_do_not_depend_on_order(spark):
    rows = [tx(i, 3, credit=c) for i, c in enumerate(["0.10", "0.20", "299999.70"])]
    for order in (rows, rows[::-1]):
        f = detectors.features(detectors.prepared(spark.createDataFrame(order, LEDGER).coalesce(1))).first()
        assert (f["credit"], f["n_rows"], f["active_days"]) == (300_000.0, 3, 1)
    assert rows[0][3] == datetime(2024, 1, 3, 12) and rows[0][4] == date(2024, 1, 3)
