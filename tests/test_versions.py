"""Stored tables by version: odd keys, broken-off writers, writers at once, purges."""

import os
import threading
from datetime import datetime

import pytest

from sarraf.sources import sinks, versions
from sarraf.streaming import streams

ROW = "project_id string, row_hash string, source_row_no int, transaction_category string, needs_review boolean, tx_id string"
ODD = [None, "", "a/b", "a", "A", "null", "v", "x=1", "имя", "%2F", " ", "l" * 300, "l" * 301]


def rows(spark, data):
    return spark.createDataFrame([(p, h, i, c, r, f"t{i}") for i, (p, h, c, r) in enumerate(data)], ROW)


def held(spark, path, *cols):
    return sorted(map(str, (tuple(r) for r in versions.read(spark, path).select(*(cols or ("project_id", "row_hash", "transaction_category", "needs_review"))).collect())))


def told(data):
    return sorted(map(str, data))


def test_keys_say_the_same_in_spark_and_python(spark):
    df = spark.createDataFrame([(p,) for p in ODD], "p string")
    got = {r["p"]: r["k"] for r in df.select("p", versions.key_of(df["p"]).alias("k")).collect()}
    assert got == {p: versions.key(p) for p in ODD} and len(set(got.values())) == len(ODD)


def test_no_row_is_lost_for_null_and_empty_projects(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_stored(rows(spark, [(p, f"h{i}", "A", True) for i, p in enumerate(ODD)]), path)
    sinks.upsert_stored(rows(spark, [(p, "again", "B", None) for p in ODD]), path)
    want = [(p, f"h{i}", "A", True) for i, p in enumerate(ODD)] + [(p, "again", "B", None) for p in ODD]
    assert held(spark, path) == told(want)
    assert versions.numbers(spark, path) == [1, 2]
    for p in ODD:
        assert {r["project_id"] for r in versions.read(spark, path, [versions.key(p)]).collect()} == {p}


def test_replays_renew_with_nulls_and_the_first_row_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = [("p", "h", "CASH", True), ("p", "h", "LATER", True), (None, None, "X", None)]
    sinks.upsert_stored(rows(spark, batch).repartition(3), path)
    assert held(spark, path) == told([("p", "h", "CASH", True), (None, None, "X", None)])
    assert sinks.upsert_stored(rows(spark, batch), path).number == 1  # nothing changes, nothing is published
    sinks.upsert_stored(rows(spark, [("p", "h", None, None), ("p", "new", "FX", False)]).withColumn("transaction_category", versions.F.when(versions.F.col("row_hash") == "new", "FX")), path)
    assert held(spark, path) == told([("p", "h", None, None), ("p", "new", "FX", False), (None, None, "X", None)])
    assert {r["tx_id"] for r in versions.read(spark, path).filter("row_hash = 'h'").collect()} == {"t0"}  # the rest of a known row stays
    assert held(spark, path, "row_hash") == told([("h",), ("new",), (None,)])


def test_a_batch_of_new_rows_rewrites_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    one = sinks.upsert_stored(rows(spark, [("p", "a", "A", None), ("q", "b", "A", None)]), path)
    two = sinks.upsert_stored(rows(spark, [("p", "c", "A", None)]), path)
    assert two.parts["v71"] == one.parts["v71"] and two.parts["v70"][:1] == one.parts["v70"] and len(two.parts["v70"]) == 2
    three = sinks.upsert_stored(rows(spark, [("p", "c", "B", None)]), path)
    assert three.parts["v71"] == one.parts["v71"] and len(three.parts["v70"]) == 1 and three.parts["v70"] != one.parts["v70"]
    assert versions.read(spark, path, version=2).filter("transaction_category = 'B'").count() == 0  # old versions stay as they were


def test_columns_that_come_later(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_stored(rows(spark, [("p", "a", "A", None)]).drop("needs_review"), path)
    sinks.upsert_stored(rows(spark, [("p", "b", "B", True)]), path)
    sinks.upsert_stored(rows(spark, [("p", "a", "C", None)]).drop("needs_review", "tx_id"), path)
    assert held(spark, path) == told([("p", "a", "C", None), ("p", "b", "B", True)])


@pytest.mark.parametrize("step", ["write_parts", "publish", "after"])
def test_a_writer_that_breaks_off(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    sinks.upsert_stored(rows(spark, [("p", "a", "A", None), ("", "b", "A", None)]), path)
    before = held(spark, path)
    batch = rows(spark, [("p", "a", "B", None), (None, "c", "C", None)])
    real = {n: getattr(versions, n) for n in ("write_parts", "publish")}

    def broken(*args):
        if step != "publish":
            real["write_parts" if step == "write_parts" else "publish"](*args)
        raise RuntimeError("power cut")

    monkeypatch.setattr(versions, "write_parts" if step == "write_parts" else "publish", broken)
    with pytest.raises(RuntimeError):
        sinks.upsert_stored(batch, path)
    monkeypatch.undo()
    after = told([("p", "a", "B", None), ("", "b", "A", None), (None, "c", "C", None)])
    assert held(spark, path) == (after if step == "after" else before)
    sinks.upsert_stored(batch, path)
    assert held(spark, path) == after
    assert not [f for f in os.listdir(tmp_path / "t" / "versions") if not f.endswith(".json") and not f.endswith(".crc")]


def test_a_number_is_created_once(spark, tmp_path):
    path = str(tmp_path / "t")
    one = sinks.upsert_stored(rows(spark, [("p", "a", "A", None)]), path)
    mine = versions.replace(one, number=2)
    won = []
    threads = [threading.Thread(target=lambda: won.append(versions.publish(spark, path, mine))) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 7 + [True]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "t"), []

    def write(k):
        try:
            for i in range(2):
                sinks.upsert_stored(rows(spark, [("shared", f"{k}-{i}", "A", None), (f"own{k}", f"{i}", "A", None)]), path)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert held(spark, path, "project_id", "row_hash") == told([x for k in range(4) for i in range(2) for x in (("shared", f"{k}-{i}"), (f"own{k}", f"{i}"))])
    assert versions.numbers(spark, path) == list(range(1, 9))


def test_compact_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        sinks.upsert_stored(rows(spark, [("p", f"h{i}", "A", None)]), path)
    want = held(spark, path)
    assert len(versions.compact(spark, path, 3).parts["v70"]) == 1 and held(spark, path) == want
    assert versions.compact(spark, path, 3).number == 5
    assert versions.vacuum(spark, path, keep=1) == 0  # all folders are younger than a day
    assert versions.vacuum(spark, path, keep=1, grace=-60) == 4
    assert held(spark, path) == want and versions.numbers(spark, path) == [5]


@pytest.mark.parametrize("project", ["p", "", None])
def test_purge_is_a_version(spark, tmp_path, project):
    path = {n: str(tmp_path / n) for n in ("ledger", "ext", "log", "files", "history")}
    data = [("p", "a", "A", None), ("", "b", "A", None), (None, "c", "A", None), ("q", "d", "A", None)]
    sinks.upsert_stored(rows(spark, data), path["ledger"])
    versions.append_new(spark.createDataFrame([(f"t{i}", f"x{i}") for i in range(4)], "tx_id string, ext string"), path["ext"], None, ["tx_id"])
    files = spark.createDataFrame([(p, f"f{h}") for p, h, _, _ in data], "project_id string, file_id string")
    versions.append_new(files, path["files"], "project_id", ["file_id"])
    versions.append_new(files.select("file_id"), path["log"], None, ["file_id"])
    versions.append_new(files, path["history"], "project_id", ["file_id"])
    gone = {"p": 0, "": 1, None: 2}[project]
    done = sinks.purge_stored(spark, path, project)
    assert set(done) == set(path) and all(n == 2 for n in done.values())
    left = [i for i in range(4) if i != gone]
    assert held(spark, path["ledger"], "tx_id") == told([(f"t{i}",) for i in left])
    assert held(spark, path["ext"], "tx_id") == told([(f"t{i}",) for i in left])
    for name in ("files", "log", "history"):
        assert held(spark, path[name], "file_id") == told([(f"f{data[i][1]}",) for i in left])
    assert versions.read(spark, path["ledger"], version=1).count() == 4
    assert set(sinks.purge_stored(spark, path, project).values()) == {2}  # nothing left to do


def test_stream_of_odd_projects(spark, tmp_path):
    schema, at = "project_id string, row_hash string, operation_ts timestamp, transaction_category string", datetime(2024, 6, 1)
    for batch in ([("", "h1"), (None, "h2"), ("p", "h3")], [("", "h9")]):
        spark.createDataFrame([(p, h, at, "A") for p, h in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.ingest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "check")).awaitTermination(120)
    assert held(spark, str(tmp_path / "t"), "project_id", "row_hash") == told([("", "h1"), (None, "h2"), ("p", "h3"), ("", "h9")])
