"""Totals, series, comparisons, top parties, cash flow and drill-downs over the ledger.

Both sides of a payment come from one scan (an exploded pair of structs), not from two. Money is summed as
decimal and given as double. Every ranking ends with the key, so ties are settled.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import parties, text
from ..functions.numbers import delta_percent
from ..plans.runtime import cut
from .filters import cash, category_of, effective


def credit() -> Column:
    return F.col("amount_credit")


def debit() -> Column:
    return F.col("amount_debit")


def money(c: Column | str) -> Column:
    """Sum of decimals as double; 0 for nothing."""
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def turnover(when: Column | None = None) -> Column:
    """Turnover of payments in tenge."""
    return money(F.col("amount_kzt") if when is None else F.when(when, F.col("amount_kzt")))


def time_series(df: DataFrame, period: str = "month") -> DataFrame:
    form = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[period]
    out = df.withColumn("bucket", F.date_format(effective(), form)).filter("bucket is not null").groupBy("bucket").agg(money(credit()).alias("credit"), money(debit()).alias("debit"))
    label = {"year": F.col("bucket"), "month": text.month_label(F.to_date("bucket", "yyyy-MM")), "day": F.date_format(F.to_date("bucket"), "dd.MM.yyyy")}[period]
    return out.select(label.alias("label"), "bucket", "credit", "debit").orderBy("bucket")


def summary(df: DataFrame) -> DataFrame:
    return df.agg(money(credit()).alias("total_credit"), money(debit()).alias("total_debit"), money(credit() + debit()).alias("total_turnover"), F.count("*").alias("total_transactions"), F.min(effective()).alias("period_from"), F.max(effective()).alias("period_to"))


def within(start: date, end: date) -> Column:
    return F.coalesce((effective() >= F.lit(start)) & (effective() < F.lit(end + timedelta(1))), F.lit(False))


def sides(df: DataFrame) -> DataFrame:
    """A row for each side of each payment: side, name, iin_bin, account and the payment's columns."""
    pair = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_name").alias("name"), F.col(f"{s}_iin_bin").alias("iin_bin"), F.col(f"{s}_account").alias("account")) for s in ("payer", "receiver")))
    return df.withColumn("_side", F.explode(pair)).select("*", "_side.*").drop("_side")


def key(order: str = "name") -> Column:
    return parties.counterparty_key(F.col("iin_bin"), F.col("account"), F.col("name"), order)


def party_columns() -> list[Column]:
    """Aggregates that name a group of spellings of one party."""
    shown = text.display_name(F.col("name"), F.col("account"))
    return [parties.better_name(shown).alias("name"), F.max(F.when(~text.is_unknown_iin(F.col("iin_bin")), F.col("iin_bin"))).alias("iin_bin"), F.max("account").alias("account")]


def unique_counterparties(df: DataFrame) -> DataFrame:
    return sides(df).select(key("account").alias("key")).filter("key is not null").agg(F.count_distinct("key").alias("unique_counterparties"))


def compare_periods(df: DataFrame, a: tuple[date, date], b: tuple[date, date]) -> DataFrame:
    """Four metrics of two periods in one pass: turnover in and out, payments, parties."""
    in_a, in_b = within(*a), within(*b)
    part = sides(df.filter(in_a | in_b)).withColumn("key", key("account")).withColumn("in_a", in_a).withColumn("in_b", in_b).withColumn("once", F.col("side") == "payer")
    values = part.agg(*(x.alias(f"{m}_{p}") for p, f in (("a", F.col("in_a")), ("b", F.col("in_b"))) for m, x in (("credit", money(F.when(f & F.col("once"), credit()))), ("debit", money(F.when(f & F.col("once"), debit()))), ("count", F.count_if(f & F.col("once")).cast("double")), ("parties", F.count_distinct(F.when(f, F.col("key"))).cast("double")))))
    rows = F.array(*(F.struct(F.lit(m).alias("label"), F.col(f"{m}_a").alias("value_a"), F.col(f"{m}_b").alias("value_b")) for m in ("credit", "debit", "count", "parties")))
    return values.select(F.explode(rows).alias("r")).select("r.*").withColumn("absolute", F.round(F.col("value_b") - F.col("value_a"), 2)).withColumn("percent", delta_percent(F.col("value_a"), F.col("value_b")))


def compare_categories(df: DataFrame, a: tuple[date, date], b: tuple[date, date], limit: int = 10) -> DataFrame:
    in_a, in_b = within(*a), within(*b)
    out = df.filter(in_a | in_b).groupBy(category_of().alias("category")).agg(*(x for p, f in (("a", in_a), ("b", in_b)) for x in (turnover(f).alias(f"value_{p}"), F.count_if(f).alias(f"transaction_count_{p}"))))
    out = out.withColumn("delta", F.round(F.col("value_b") - F.col("value_a"), 2)).withColumn("delta_percent", delta_percent(F.col("value_a"), F.col("value_b")))
    return out.orderBy(F.abs("delta").desc(), F.desc("value_b"), F.desc("value_a"), "category").limit(limit)


#: Fixed value: the category of cash withdrawals.
CASH_CATEGORY = "Снятие наличных"


def compare_anomalies(metrics: DataFrame, categories: DataFrame) -> DataFrame:
    """Up to four notable changes between two periods, most telling first."""
    m = metrics.select(
        F.when((F.col("label") == "debit") & (F.col("percent") >= 50), F.struct(F.lit(1).alias("rank"), F.lit("debit_growth").alias("message"), F.col("percent").alias("value")))
        .when((F.col("label") == "count") & (F.col("percent") >= 30), F.struct(F.lit(2).alias("rank"), F.lit("count_growth").alias("message"), F.col("percent").alias("value")))
        .when((F.col("label") == "parties") & (F.col("absolute") >= 5), F.struct(F.lit(3).alias("rank"), F.lit("more_parties").alias("message"), F.col("absolute").alias("value"))).alias("x")
    )
    place = F.row_number().over(Window.orderBy(F.abs("delta").desc(), F.desc("value_b"), F.desc("value_a"), "category"))  # a row a category
    cash_row = (F.col("category") == CASH_CATEGORY) & (F.col("delta_percent") >= 100)
    new_row = (F.col("value_a") <= 0) & (F.col("value_b") > 0)
    said = F.array_compact(F.array(
        F.when(cash_row, F.struct(F.lit(4).alias("rank"), F.lit("cash_growth").alias("message"), F.col("delta_percent").alias("value"), "place")),
        F.when(new_row, F.struct(F.lit(5).alias("rank"), F.concat(F.lit("new_category: "), F.col("category")).alias("message"), F.col("value_b").alias("value"), "place")),
    ))
    c = categories.withColumn("place", place).select(F.explode(said).alias("x"))
    m = m.filter("x is not null").select("x.*").withColumn("place", F.lit(0))
    first = m.unionByName(c.select("x.*")).withColumn("n", F.row_number().over(Window.partitionBy("rank").orderBy("place"))).filter("n = 1")  # at most five rows
    return first.select("message", "value", "rank").orderBy("rank").limit(4).drop("rank")


def top_expenses(df: DataFrame, kind: str = "debit", limit: int = 10) -> DataFrame:
    """Parties by amount: receivers of credits or payers of debits. Spellings merge before the limit."""
    side, amount = ("receiver", credit()) if kind == "credit" else ("payer", debit())
    part = df.filter(amount > 0).select(F.col(f"{side}_name").alias("name"), F.col(f"{side}_iin_bin").alias("iin_bin"), F.col(f"{side}_account").alias("account"), amount.alias("amount"))
    groups = part.withColumn("key", key("name")).filter("key is not null").groupBy("key").agg(*party_columns(), money("amount").alias("amount"), F.count("*").alias("transaction_count"))
    total = part.agg(money("amount").alias("_total"))  # one row
    share = F.round(F.when(F.col("_total") > 0, F.col("amount") / F.col("_total") * 100).otherwise(0.0), 2)
    return groups.orderBy(F.desc("amount"), "key").limit(limit).crossJoin(F.broadcast(total)).withColumn("percentage", share).drop("_total").orderBy(F.desc("amount"), "key")


def party_totals(df: DataFrame, order: str) -> DataFrame:
    """Totals by party. Payments are summed by raw name, id and account first, so keys are made once for each of these."""
    raw = sides(df).groupBy("side", "name", "iin_bin", "account").agg(F.sum(credit()).alias("amount_credit"), F.sum(debit()).alias("amount_debit"), F.sum("amount_kzt").alias("amount_kzt"), F.count("*").alias("n"))
    return raw.withColumn("key", key(order)).filter("key is not null").groupBy("key").agg(
        *party_columns(), money(F.when(F.col("side") == "receiver", credit())).alias("total_credit"), money(F.when(F.col("side") == "payer", debit())).alias("total_debit"), turnover().alias("total_turnover"), F.sum("n").alias("transaction_count")
    )


def top_counterparties(df: DataFrame, limit: int = 20) -> DataFrame:
    return party_totals(df, "name").orderBy(F.desc("total_turnover"), F.desc("transaction_count"), "key").limit(limit)


def counterparty_search(df: DataFrame, query: str, limit: int = 20) -> DataFrame:
    match = text.any_of(text.text_match(F.col("name"), query), F.col("iin_bin").contains(query), text.norm_account(F.col("account")).contains(text.norm_account(F.lit(query))))
    part = sides(df).filter(match).withColumn("key", key("account")).filter("key is not null")
    out = part.groupBy("key").agg(*party_columns(), turnover().alias("total_turnover"), F.count("*").alias("transaction_count"))
    return out.orderBy(F.desc("total_turnover"), F.desc("transaction_count"), "key").limit(limit)


def category_summary(df: DataFrame, limit: int = 50) -> DataFrame:
    out = df.groupBy(category_of().alias("category")).agg(F.count("*").alias("transaction_count"), turnover().alias("total_turnover"), money(debit()).alias("total_debit"), money(credit()).alias("total_credit"))
    return out.orderBy(F.desc("transaction_count"), F.desc("total_turnover"), "category").limit(limit)


def cash_top(df: DataFrame, kind: str = "withdrawal", limit: int = 10) -> DataFrame:
    """Parties that take or bring cash, with their share of all such payments and the last date."""
    side, amount = ("payer", debit()) if kind == "withdrawal" else ("receiver", credit())
    part = df.filter(cash(kind) & (amount > 0)).select(F.col(f"{side}_name").alias("name"), F.col(f"{side}_iin_bin").alias("iin_bin"), F.col(f"{side}_account").alias("account"), amount.alias("amount"), effective().alias("ts"))
    total = part.agg(money("amount").alias("_total"))
    groups = part.withColumn("key", key("name")).filter("key is not null").groupBy("key").agg(*party_columns(), money("amount").alias("amount"), F.count("*").alias("transaction_count"), F.max("ts").alias("last_transaction_date"))
    share = F.round(F.when(F.col("_total") > 0, F.col("amount") / F.col("_total") * 100).otherwise(0.0), 2)
    return groups.orderBy(F.desc("amount"), "key").limit(limit).crossJoin(F.broadcast(total)).withColumn("percentage", share).drop("_total").orderBy(F.desc("amount"), "key")


def list_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), money(debit()).alias("total_debit"), money(credit()).alias("total_credit"))


DETAIL = ["tx_id", "date", "sender_name", "recipient_name", "purpose_text", "currency", "debit", "credit", "amount_kzt"]


def detail(df: DataFrame) -> DataFrame:
    return df.select("tx_id", effective().alias("date"), text.display_name(F.col("payer_name"), F.col("payer_account")).alias("sender_name"), text.display_name(F.col("receiver_name"), F.col("receiver_account")).alias("recipient_name"), "purpose_text", "currency", debit().cast("double").alias("debit"), credit().cast("double").alias("credit"), F.col("amount_kzt").cast("double").alias("amount_kzt"))


def newest(df: DataFrame, limit: int) -> DataFrame:
    return detail(df).orderBy(F.desc("date"), F.desc("tx_id")).limit(limit)


def drill_bucket(df: DataFrame, bucket: str, limit: int = 50) -> DataFrame:
    """Payments of a year, month or day; the bucket is a range, so days prune."""
    y, m, d = ([*map(int, bucket.split("-")), 0, 0])[:3]
    start = date(y, m or 1, d or 1)
    end = date(y + 1, 1, 1) if not m else date(y + m // 12, m % 12 + 1, 1) if not d else start + timedelta(1)
    return newest(df.filter(within(start, end - timedelta(1))), limit)


def drill_party(df: DataFrame, side: str, key_value: str, order: str = "name", limit: int = 50, account: str | None = None) -> DataFrame:
    """Payments of a party on one side, or on either with side "any"; key_value as the rankings give it.

    With an account, only those in which either side has it.
    """
    if account is not None:
        df = df.filter(F.coalesce(F.col("payer_account") == account, F.lit(False)) | F.coalesce(F.col("receiver_account") == account, F.lit(False)))
    has = {s: F.coalesce(parties.counterparty_key(F.col(f"{s}_iin_bin"), F.col(f"{s}_account"), F.col(f"{s}_name"), order) == key_value, F.lit(False)) for s in ("payer", "receiver")}
    return newest(df.filter(has["payer"] | has["receiver"] if side == "any" else has[side]), limit)


def drill_cash(df: DataFrame, kind: str, key_value: str, limit: int = 50) -> DataFrame:
    return drill_party(df.filter(cash(kind)), "payer" if kind == "withdrawal" else "receiver", key_value, "name", limit)


def drill_edge(df: DataFrame, a: str, b: str, limit: int = 50) -> DataFrame:
    pair = [F.least("payer_iin_bin", "receiver_iin_bin"), F.greatest("payer_iin_bin", "receiver_iin_bin")]
    return newest(df.filter((pair[0] == min(a, b)) & (pair[1] == max(a, b))), limit)


def sort_keys(by: str, descending: bool = True) -> list[Column]:
    """Sort of the ledger list: the chosen key (texts in lower case), then newest, then id."""
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    keys = {
        "date": [effective()], "debit": [debit()], "credit": [credit()], "amount": [F.col("amount_kzt")], "category": [lower(category_of())], "type": [lower(F.col("operation_type_raw"))], "purpose": [lower(F.col("purpose_text"))],
        "sender": [lower(F.col("payer_name"))], "recipient": [lower(F.col("receiver_name"))], "currency": [F.when(F.col("currency") == "KZT", 0).otherwise(1), lower(F.col("currency"))], "uploader": [lower(F.col("uploaded_by_email"))] if by == "uploader" else [],
    }[by]
    return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys] + [effective().desc_nulls_last(), F.desc("tx_id")]


def page(df: DataFrame, number: int, size: int, keys: list[Column]) -> DataFrame:
    return df.orderBy(*keys).offset((number - 1) * size).limit(size)


def total_pages(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).alias("total_pages"))


def described(df: DataFrame, columns: list[str], key: str, over: int = 15, shown: int = 5) -> tuple[DataFrame | None, DataFrame]:
    """What is told of a result: over so many rows its profile and first rows by key, else no profile and all of it."""
    few = df.limit(over + 1).count() <= over
    return (None, df.orderBy(key)) if few else (profile(df, columns), df.orderBy(key).limit(shown))


class Ordered:
    """A table stored in an order, in ranges of about so many rows, with a directory of how many rows stand before each.

    A page is read from the one or two ranges that hold it, whatever its number; only their rows are numbered. The order
    has to end with a key, else equal rows change places between pages.
    """

    #: Ranges that a task cuts, about, and room for their numbers: tasks, bounds and what they send to the driver are fewer than ranges.
    RANGES, MOST = 64, 1 << 16

    def __init__(self, spark: SparkSession, path: str, order: list[Column]):
        self.spark, self.path, self.order = spark, path, order

    @classmethod
    def build(cls, df: DataFrame, path: str, order: list[Column], range_rows: int = 100_000) -> Ordered:
        """Tasks by sampled bounds sort their rows and cut them into ranges, which are counted; the directory has a row a range."""
        tasks = max(1, -(-df.count() // (range_rows * cls.RANGES)))
        row = F.monotonically_increasing_id()  # a task's number before the place within it
        at = (F.shiftright(row, 33) * cls.MOST + F.floor(row.bitwiseAND((1 << 33) - 1) / range_rows)).cast("int")
        df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("range", at).write.partitionBy("range").parquet(f"{path}/rows")
        spark = df.sparkSession
        spark.createDataFrame([], df.schema).coalesce(1).write.parquet(f"{path}/shape")  # a table without rows has no ranges to read it from
        out = cls(spark, path, order)
        counts = sorted(tuple(r) for r in out._rows().groupBy("range").agg(F.count("*")).collect())  # a row a range
        first, told = 0, []
        for i, n in counts:
            told.append((i, n, first))
            first += n
        spark.createDataFrame(told, "range int, n long, first long").coalesce(1).write.parquet(f"{path}/directory")
        return out

    def _rows(self) -> DataFrame:
        shape = self.spark.read.parquet(f"{self.path}/shape").schema
        return self.spark.read.schema(shape.add("range", "integer")).parquet(f"{self.path}/rows")

    def directory(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/directory")

    def total_pages(self, per_page: int) -> int:
        return -(-(self.directory().agg(F.sum("n")).first()[0] or 0) // per_page)

    def page(self, number: int, per_page: int) -> DataFrame:
        """Rows of a page, numbered by `place` from 1."""
        lo, hi = (number - 1) * per_page, number * per_page
        wanted = {r["range"]: r["first"] for r in self.directory().filter((F.col("first") < hi) & (F.col("first") + F.col("n") > lo)).collect()}  # what overlaps the page
        rows = self._rows().filter(F.col("range").isin(list(wanted)))
        before = F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv))[F.col("range")] if wanted else F.lit(0)
        place = F.row_number().over(Window.partitionBy("range").orderBy(*self.order)) + before
        return rows.withColumn("place", place.cast("long")).filter((F.col("place") > lo) & (F.col("place") <= hi)).drop("range")


def capped(df: DataFrame, limit: int | None = None, cap: int = 1000) -> DataFrame:
    """The row cap of ad-hoc questions."""
    return df.limit(min(limit or cap, cap))


def rank_by(df: DataFrame, metric: str, limit: int) -> DataFrame:
    """Top rows by a metric that is there."""
    return df.filter(F.col(metric).isNotNull()).orderBy(F.col(metric).desc_nulls_last(), *sorted(set(df.columns) - {metric})).limit(limit)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, number, n): how often each value occurs; nulls are left out, number is null in columns of no numbers."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    number = lambda c: F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), number(c).alias("number")) for c in columns))
    return df.select(F.explode(cells).alias("x")).select("x.*").filter("value is not null").groupBy("column", "value", "number").agg(F.count("*").alias("n"))


def quartiles(values: DataFrame) -> DataFrame:
    """Exact quartiles of counted numbers, linear between ranks: (column, q25, q50, q75).

    Values are sorted by ranges; each range adds up its counts, and ranks follow from the sums of the ranges before,
    so that no task holds a column.
    """
    parts = cut(values.filter("number is not null").select("column", "number", "n").repartitionByRange("column", "number").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("column", "part").agg(F.sum("n").alias("rows"))  # a row a range and column
    earlier = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).withColumn("total", F.sum("rows").over(Window.partitionBy("column")))
    ranked = parts.join(F.broadcast(sizes), ["column", "part"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("column", "part").orderBy("number")))
    at = {f"q{q}": (F.col("total") - 1) * q / 100 for q in (25, 50, 75)}
    ends = ranked.groupBy("column").agg(F.max("total").alias("total"), *(F.min(F.when(F.col("upto") > side(p), F.col("number"))).alias(f"{q}_{name}") for q, p in at.items() for name, side in (("low", F.floor), ("high", F.ceil))))
    return ends.select("column", *((F.col(f"{q}_low") + (F.col(f"{q}_high") - F.col(f"{q}_low")) * (p - F.floor(p))).alias(q) for q, p in at.items()))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, distinct, mean, deviation, least, quartiles, greatest, most frequent value and its count.

    The least of equally frequent values is the top one. Columns of no numbers have only counts and top; all-null
    columns have counts of 0. Everything comes from one table of value counts.
    """
    values = cut(value_counts(df, columns))
    number, n = F.col("number"), F.col("n")
    known = F.when(number.isNotNull(), n)
    base = values.groupBy("column").agg(F.sum(n).alias("count"), F.count("*").alias("distinct"), (F.sum(number * n) / F.sum(known)).alias("mean"), F.sum(known).alias("_known"), F.min(number).alias("min"), F.max(number).alias("max"), F.min(F.struct((-n).alias("less"), "value")).alias("_top"))
    spread = values.join(F.broadcast(base.select("column", "mean")), "column").groupBy("column").agg(F.sum(n * (number - F.col("mean")) * (number - F.col("mean"))).alias("_squares"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    out = every.join(base, "column", "left").join(spread, "column", "left").join(quartiles(values), "column", "left")
    std = F.when(F.col("_known") > 1, F.sqrt(F.col("_squares") / (F.col("_known") - 1)))
    none = F.lit(0).cast("long")
    return out.select("column", F.coalesce("count", none).alias("count"), F.coalesce("distinct", none).alias("distinct"), F.round("mean", 4).alias("mean"), F.round(std, 4).alias("std"), "min", "q25", "q50", "q75", "max", F.col("_top.value").alias("top"), (-F.col("_top.less")).alias("freq"))


def sample_values(df: DataFrame, columns: list[str], limit: int = 20) -> DataFrame:
    """Distinct values over three characters of text columns, the first by order of each."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.trim(c).alias("value")) for c in columns))).alias("x")).select("x.*").filter(F.length("value") > 3).distinct()
    return long.withColumn("n", F.row_number().over(Window.partitionBy("column").orderBy("value"))).filter(F.col("n") <= limit).drop("n")
