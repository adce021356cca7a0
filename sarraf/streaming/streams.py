"""Incremental ingestion and daily alerts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..sources.sinks import upsert_stored


def ingest_stream(batches: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Idempotent upsert of streamed rows by (project_id, row_hash): replays change nothing but the renewed columns.

    There is no watermark, since an older statement may arrive after a newer one; the upsert alone settles repeats.
    The table is published by version (sources.versions): a batch that broke off has changed nothing, and one that is
    played again finds its rows known. Rows of no project are a project of their own.
    """
    rows = batches.withColumn("operation_ts", F.col("operation_ts").cast("timestamp"))

    def write(batch: DataFrame, _: int) -> None:
        upsert_stored(batch, table)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_stream(events: DataFrame, rows: int = 10, watermark: str = "1 day", account: str = "account", ts: str = "ts", amount: str = "amount") -> DataFrame:
    """Days on which an account has at least so many payments; rows later than the watermark are dropped."""
    day = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).groupBy(F.window(ts, "1 day"), account).agg(F.count("*").alias("n"), F.round(F.sum(amount), 2).alias("turnover"))
    return day.filter(F.col("n") >= rows).select(account, F.col("window.start").cast("date").alias("day"), "n", "turnover")


def flush_stream(events: DataFrame, credit: float = 300_000, debit: float = 200_000, ratio: float = 0.80, watermark: str = "1 day", account: str = "account", ts: str = "ts") -> DataFrame:
    """Days on which most of an account's credits leave again. events has columns credit and debit."""
    day = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).groupBy(F.window(ts, "1 day"), account).agg(F.round(F.sum("credit"), 2).alias("credit"), F.round(F.sum("debit"), 2).alias("debit"))
    hit = (F.col("credit") >= credit) & (F.col("debit") >= debit) & (F.col("debit") / F.col("credit") >= ratio)
    return day.filter(hit).select(account, F.col("window.start").cast("date").alias("day"), "credit", "debit", F.round(F.col("debit") / F.col("credit"), 4).alias("ratio"))


#: Milliseconds of a day.
_DAY = 86_400_000
ALERTS = "account string, day date, kind string, n long, turnover double, parties long"


def use_keyed_state(spark: SparkSession) -> SparkSession:
    """The state store that alert_stream needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class _Alerts(StatefulProcessor):
    """State of an account's day: sums, and the payments and parties that it has seen, each under a key of its own."""

    def __init__(self, rows: int):
        self.rows = rows

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, hundredths long, parties long, told boolean")
        self.payments = handle.getMapState("payments", "id string", "seen boolean")
        self.parties = handle.getMapState("parties", "party string", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        account, day = key
        closes = int(pd.Timestamp(day).timestamp() * 1000) + _DAY
        if timerValues.getCurrentWatermarkInMs() >= closes:
            late = sum(len(batch) for batch in rows)
            yield pd.DataFrame([(account, day, "late", late, None, None)], columns=["account", "day", "kind", "n", "turnover", "parties"])
            return
        n, hundredths, parties, told = self.sums.get() if self.sums.exists() else (0, 0, 0, False)
        if not n:
            self.handle.registerTimer(closes)
        for batch in rows:
            for tx, party, amount in batch.drop_duplicates("tx")[["tx", "party", "amount"]].itertuples(index=False):
                if self.payments.containsKey((tx,)):
                    continue
                self.payments.updateValue((tx,), (True,))
                n, hundredths = n + 1, hundredths + round(amount * 100)
                if party is not None and not self.parties.containsKey((party,)):
                    self.parties.updateValue((party,), (True,))
                    parties += 1
        if n >= self.rows and not told:
            told = True
            yield pd.DataFrame([(account, day, "alert", n, hundredths / 100, parties)], columns=["account", "day", "kind", "n", "turnover", "parties"])
        self.sums.update((n, hundredths, parties, told))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for state in (self.sums, self.payments, self.parties):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def alert_stream(events: DataFrame, rows: int = 10, watermark: str = "1 day") -> DataFrame:
    """Alerts on an account's day of at least so many payments, with how many parties it had (F5), each told once.

    events: tx, account, party, amount, ts. A payment counts once, however often it arrives. A day is open until the
    watermark has passed its end; then its state goes, and payments that still come for it are told as rows of kind
    "late" with their number. An alert has the figures of the batch in which its day passed the threshold. State is kept
    by account and day, so a busy account is dealt over its days. Needs use_keyed_state(). Payments of no account, id or
    time are left out; a null amount is 0.
    """
    events = events.select("tx", F.col("account").cast("string").alias("account"), F.col("party").cast("string").alias("party"), F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"), F.col("ts").cast("timestamp").alias("ts"))
    keyed = events.filter("tx is not null and account is not null and ts is not null").withWatermark("ts", watermark)
    keyed = keyed.select(F.col("tx").cast("string").alias("tx"), "account", "party", "amount", F.to_date(F.col("ts")).alias("day"))  # without ts, so that Spark drops no late row unseen
    return keyed.groupBy("account", "day").transformWithStateInPandas(_Alerts(rows), ALERTS, "Append", "EventTime")
