"""Pages of a table that is stored in ranges, and what is told of a result."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sarraf.functions.text import format_dt
from sarraf.operators.analytics import Ordered, described


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 != 0, F.pmod(F.xxhash64("id"), F.lit(7))).alias("v")).repartition(5)  # many ties, some nulls
    order = [F.col("v").desc_nulls_last(), F.asc("id")]
    return df, order, Ordered.build(df, str(tmp_path_factory.mktemp("pages")), order, 90)


@pytest.mark.parametrize(("number", "size"), [(1, 10), (7, 33), (100, 10), (101, 10), (2, 600), (1, 5000), (11, 100)])
def test_pages_are_those_of_the_whole_order(stored, number, size):
    df, order, pages = stored
    want = [r["id"] for r in df.orderBy(*order).collect()][(number - 1) * size : number * size]
    got = sorted((r["place"], r["id"]) for r in pages.page(number, size).collect())
    assert [i for _, i in got] == want and [p for p, _ in got] == list(range((number - 1) * size + 1, (number - 1) * size + 1 + len(want)))
    assert pages.total_pages(size) == -(-1000 // size)


def test_a_page_reads_its_ranges_only(stored):
    _, _, pages = stored
    page = pages.page(50, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert pages.directory().count() >= 8 and "Limit" not in plan and "TakeOrdered" not in plan
    assert plan.count("PartitionFilters: [") and "range" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_an_empty_table_has_no_pages(spark, tmp_path):
    pages = Ordered.build(spark.range(0), str(tmp_path / "none"), [F.asc("id")])
    assert pages.total_pages(10) == 0 and pages.page(1, 10).count() == 0


def test_small_results_are_shown_whole(spark):
    df = spark.range(16).select("id", (F.col("id") % 3).alias("v"))
    what, rows = described(df, ["v"], "id")
    assert [r["id"] for r in rows.collect()] == [0, 1, 2, 3, 4] and what.filter("column = 'v'").first()["count"] == 16
    what, rows = described(df.limit(15), ["v"], "id")
    assert what is None and rows.count() == 15


def test_times_of_payments(spark):
    df = spark.createDataFrame([(datetime(2024, 2, 1, 9, 5), None), (None, date(2024, 2, 1)), (None, None)], "t timestamp, d date")
    assert [r[0] for r in df.select(format_dt(df["t"], df["d"])).collect()] == ["01.02.2024 09:05", "01.02.2024", "Без даты"]
