"""Alerts with keyed state, batch by batch, against a plain version."""

import random
from datetime import datetime, timedelta

from sarraf.streaming import streams

EVENT = "tx string, account string, party string, amount double, ts timestamp"


def plain(batches, rows, delay):
    state, out, newest, mark = {}, [], None, None
    for batch in batches:
        grouped = {}
        for tx, account, party, amount, ts in batch:
            if tx is not None and account is not None and ts is not None:
                grouped.setdefault((account, ts.date()), []).append((tx, party, amount or 0.0))
        for (account, day), events in grouped.items():
            if mark is not None and mark >= datetime(day.year, day.month, day.day) + timedelta(days=1):
                out.append((account, day, "late", len(events), None, None))
                continue
            seen, parties, told = state.setdefault((account, day), ({}, set(), []))
            for tx, party, amount in events:
                if tx not in seen:
                    seen[tx] = amount
                    parties |= {party} - {None}
            if len(seen) >= rows and not told:
                told.append(True)
                out.append((account, day, "alert", len(seen), round(sum(seen.values()), 2), len(parties)))
        times = [e[4] for e in batch if e[0] is not None and e[1] is not None and e[4] is not None]
        if times:
            newest = max([*times, *([newest] if newest else [])])
            mark = newest - delay
    return out


def test_late_repeated_and_out_of_order_payments(spark, tmp_path):
    r, start, batches = random.Random(8), datetime(2024, 3, 1), []
    for b in range(6):
        batch = []
        for _ in range(60):
            day = max(0, b + r.choice([0, 0, 0, -1, -2, -4]))
            i = r.randrange(400)
            batch.append((f"t{day}-{i % 40}", f"a{i % 2}", r.choice(["x", "y", "z", None]) if i % 40 else "x", float(i % 40) + 0.1, start + timedelta(days=day, hours=r.randrange(24))))
        # what one id says is the same whenever it comes
        batches.append([(tx, a, f"p{tx[-1]}" if tx[-1] != "3" else None, amount, ts.replace(hour=ts.hour)) for tx, a, _, amount, ts in batch])
    batches[2] += [(None, "a0", "x", 1.0, start), ("n", None, "x", 1.0, start), ("m", "a0", "x", None, start + timedelta(days=2)), ("k", "a0", "x", 1.0, None)]
    ids = {}
    batches = [[(tx if tx is None else f"{tx}-{a}", a, *ids.setdefault(f"{tx}-{a}", (p, amount)), ts) for tx, a, p, amount, ts in batch] for batch in batches]
    want = plain(batches, 12, timedelta(days=1))
    kinds = {k for _, _, k, *_ in want}
    assert kinds == {"alert", "late"}
    streams.use_keyed_state(spark)
    got = []
    try:
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            found = streams.alert_stream(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), 12, "1 day")
            found.writeStream.option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).format("parquet").trigger(availableNow=True).start().awaitTermination(200)
            assert i >= 0
        got = [(x["account"], x["day"], x["kind"], x["n"], x["turnover"], x["parties"]) for x in spark.read.schema(streams.ALERTS).parquet(str(tmp_path / "out")).collect()]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(str, got)) == sorted(map(str, want))
