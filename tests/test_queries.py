"""Registered queries against DuckDB, streams, and the driver's contract."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from sarraf.plans import fixtures, queries
from sarraf.sources import versions
from sarraf.streaming import streams


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6)) if math.isfinite(v) else str(v)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_duckdb(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    cur = duck.execute(queries.SQL[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == cols
    want = sorted(tuple(plain(r[at.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_coarse_index_recall(spark, sf):
    exact = {(r["query_id"], r["vec_id"]) for r in queries.l2_knn(spark, sf).collect()}
    near = {(r["query_id"], r["vec_id"]) for r in queries.l6_coarse_index(spark, sf).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_streams(spark, sf, tmp_path):
    rows = fixtures.payments(spark, sf)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.activity_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 3, "100 days")
    q = stream.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in streams.activity_stream(rows, 3).collect()}
    assert {tuple(r) for r in spark.table("days").collect()} == want


def test_ingest_stream_replays(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    rows = fixtures.ledger(spark, sf).filter("file_id = '10'").select("project_id", F.col("tx_id").alias("row_hash"), "operation_ts", "amount_kzt")
    n = rows.count()
    for k in (1, 2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        streams.ingest_stream(source, str(tmp_path / "table"), str(tmp_path / f"check{k}")).awaitTermination(120)
        assert versions.read(spark, str(tmp_path / "table")).count() == n


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
