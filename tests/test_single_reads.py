"""What a query reads and writes: the ledger is joined once, and tasks are fewer than ranges."""

from pyspark.sql import functions as F

from sarraf.operators import activity, analytics, detectors
from sarraf.plans import fixtures
from sarraf.plans.queries import QUERIES


def test_sorts_read_one_stored_copy(spark, sf):
    assert "lineitem" not in QUERIES["h1_sorts"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_payments_meet_parts_before_parties(spark, sf):
    """The joins' order is Spark's own matter: the rows are those of the shared SQL."""
    a, b = fixtures.ledger(spark, sf), fixtures._sql(spark, sf, fixtures.LEDGER_SQL)
    assert a.schema == b.schema and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    last = next(x for x in a._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    assert "l_orderkey" in last and "o_orderkey" in last


def test_amounts_alone_are_those_of_the_partials(spark, sf):
    rows = detectors.prepared(fixtures.ledger(spark, sf))
    both = [x.select("project_id", "file_id", "dir", "a", "n") for x in (activity.amounts(rows), detectors.partials(rows).filter("kind = 'amount'").groupBy("project_id", "file_id", "dir", "a").agg(F.sum("n").alias("n")))]
    assert both[0].exceptAll(both[1]).isEmpty() and both[1].exceptAll(both[0]).isEmpty()


def test_a_task_writes_many_ranges(spark, tmp_path):
    order = [F.asc("id")]
    pages = analytics.Ordered.build(spark.range(2000).repartition(3), str(tmp_path / "o"), order, 10)
    tasks = {f.name.split("-")[1] for f in (tmp_path / "o" / "rows").rglob("part-*.parquet")}
    assert len(tasks) <= 4 and pages.directory().count() >= 200
    assert [r["id"] for r in pages.page(7, 30).orderBy("place").collect()] == list(range(180, 210))


def test_evidence_reads_one_stored_copy(spark, sf):
    for name in ("f11_party_evidence", "f12_row_evidence"):
        assert "lineitem" not in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString() and "l_orderkey" not in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
