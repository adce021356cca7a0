"""Batches of a stream that arrive out of the order of their payments."""

from datetime import datetime

from sarraf.sources import versions
from sarraf.streaming import streams


def test_older_statement_arrives_later(spark, tmp_path):
    schema = "project_id string, row_hash string, operation_ts timestamp, operation_date date, amount_kzt double"
    batches = [[("p", "new", datetime(2024, 6, 1, 12), None, 1.0)], [("p", "old", datetime(2024, 1, 1, 12), None, 2.0), ("p", "old", datetime(2024, 1, 1, 12), None, 2.0)], [("p", "new", datetime(2024, 6, 1, 12), None, 1.0), ("p", "older", datetime(2023, 1, 1, 12), None, 3.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.ingest_stream(source, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r["row_hash"] for r in versions.read(spark, str(tmp_path / "table")).collect()) == ["new", "old", "older"]


def test_only_touched_projects_are_rewritten(spark, tmp_path):
    schema = "project_id string, row_hash string, operation_ts timestamp, operation_date date, transaction_category string"
    at, table = datetime(2024, 6, 1, 12), str(tmp_path / "table")

    def arrive(rows):
        spark.createDataFrame([(p, h, at, None, c) for p, h, c in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.ingest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "check")).awaitTermination(120)
        return sorted((r["project_id"] or "", r["row_hash"], r["transaction_category"]) for r in versions.read(spark, table).collect())

    files = lambda project: versions.latest(spark, table).parts[versions.key(project)]
    assert arrive([("7", "a", "OTHER"), ("8", "b", "OTHER"), (None, "n", "OTHER")]) == [("", "n", "OTHER"), ("7", "a", "OTHER"), ("8", "b", "OTHER")]
    seven, eight = files("7"), files("8")
    assert arrive([("7", "a", "CASH"), ("7", "c", "OTHER"), (None, "n", "CASH")]) == [("", "n", "CASH"), ("7", "a", "CASH"), ("7", "c", "OTHER"), ("8", "b", "OTHER")]
    assert files("8") == eight and files("7") != seven
    assert arrive([("7", "c", "CASH")]) == [("", "n", "CASH"), ("7", "a", "CASH"), ("7", "c", "CASH"), ("8", "b", "OTHER")]
