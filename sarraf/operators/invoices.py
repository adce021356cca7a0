"""Electronic tax invoices: totals, pivots with subtotals, reconciliation with payments, ledger shadows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ids import strip_iin
from ..functions.numbers import invoice_amount
from ..plans.runtime import cut
from .analytics import money


def amount_of() -> Column:
    return invoice_amount(*(F.col(c) for c in ("total_amount", "cost_with_indirect_tax", "turnover_amount", "cost_without_indirect_tax")))


def effective() -> Column:
    return F.coalesce("turnover_date", "issue_date")


def invoice_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_records"), money("total_amount").alias("total_amount"), money("vat_amount").alias("total_vat"), money(F.when(F.col("esf_direction") == "sale", F.col("total_amount"))).alias("sales_amount"), money(F.when(F.col("esf_direction") == "purchase", F.col("total_amount"))).alias("purchase_amount"))


def invoice_summary(df: DataFrame, years: list[int]) -> DataFrame:
    """Buyer by supplier: overall total and a column a year; naming the years spares a pass."""
    keys = ["buyer_iin_bin", "supplier_iin_bin"]
    return df.groupBy(*keys).agg(F.max("buyer_name").alias("buyer_name"), F.max("supplier_name").alias("supplier_name"), money("total_amount").alias("overall_total"), *(money(F.when(F.col("year") == y, F.col("total_amount"))).alias(f"y{y}") for y in years)).orderBy(F.desc("overall_total"), *keys)


def invoice_goods_summary(df: DataFrame, years: list[int]) -> DataFrame:
    keys = ["buyer_iin_bin", "supplier_iin_bin", "tru_name", "price_with_vat", "vat_rate", "unit", "currency_code"]
    per_year = [x for y in years for x in (F.coalesce(F.sum(F.when(F.col("year") == y, F.col("quantity"))).cast("double"), F.lit(0.0)).alias(f"q{y}"), money(F.when(F.col("year") == y, F.col("total_amount"))).alias(f"y{y}"))]
    return df.groupBy(*keys).agg(F.coalesce(F.sum("quantity").cast("double"), F.lit(0.0)).alias("total_quantity"), money("total_amount").alias("total_amount"), *per_year).orderBy(F.desc("total_amount"), *keys)


def with_subtotals(df: DataFrame, years: list[int]) -> DataFrame:
    """Detail, a subtotal of each buyer and a grand total from one pass of grouping sets; buyers by total."""
    sets = df.groupingSets([["buyer_iin_bin", "supplier_iin_bin"], ["buyer_iin_bin"], []], "buyer_iin_bin", "supplier_iin_bin")
    out = sets.agg(F.grouping_id().alias("g"), money("total_amount").alias("overall_total"), *(money(F.when(F.col("year") == y, F.col("total_amount"))).alias(f"y{y}") for y in years))
    kind = F.when(F.col("g") == 0, "detail").when(F.col("g") == 1, "subtotal").otherwise("grand_total")
    buyer_total = F.max(F.when(F.col("g") == 1, F.col("overall_total"))).over(Window.partitionBy("buyer_iin_bin"))
    return out.withColumn("row_type", kind).withColumn("_buyer", buyer_total).orderBy(F.col("g") == 3, F.desc("_buyer"), "buyer_iin_bin", "g", F.desc("overall_total"), "supplier_iin_bin").drop("g", "_buyer")


def infer_owner_side(df: DataFrame) -> DataFrame:
    """One row: "buyer" if the most frequent buyer occurs more often than the most frequent supplier, else "supplier"."""
    pair = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_iin_bin").alias("id")) for s in ("buyer", "supplier"))))
    counts = df.select(pair.alias("x")).select("x.*").filter("id is not null").groupBy("side", "id").count()
    return counts.agg(F.coalesce(F.max(F.when(F.col("side") == "buyer", F.col("count"))), F.lit(0)).alias("buyer_max"), F.coalesce(F.max(F.when(F.col("side") == "supplier", F.col("count"))), F.lit(0)).alias("supplier_max")).withColumn("owner_side", F.when(F.col("buyer_max") > F.col("supplier_max"), "buyer").otherwise("supplier"))


def tokens(*cols: str) -> Column:
    return text.reference_tokens(*(F.col(c) for c in cols))


def plain_token(c: str) -> Column:
    return F.nullif(F.upper(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\"'\s]", "")), F.lit(""))


def paid() -> Column:
    return F.greatest(*(F.coalesce(F.col(c), F.lit(0)) for c in ("amount_credit", "amount_debit", "amount_kzt"))).cast("decimal(18,2)")


def _references() -> Column:
    return F.array_sort(tokens("purpose_text", "raw_note", "operation_type_raw"))


def _two_tokens(invoices: DataFrame) -> DataFrame:
    """Invoices with the tokens r and c of their registration and contract; where both are the same, c is null."""
    r, c = plain_token("registration_number"), plain_token("contract_number")
    return invoices.withColumn("r", F.coalesce(r, c)).withColumn("c", F.when(r.isNotNull() & (r != c), c)).filter("r is not null")


def named_columns() -> dict[str, Column]:
    """Of a bank's payment, what it names and pays: tokens and paid."""
    return {"tokens": F.when(F.col("source_bank") != "esf", _references()), "paid": paid()}


def named(rows: DataFrame) -> DataFrame:
    """Payments that name anything, of rows with those columns."""
    return rows.filter(F.size("tokens") > 0).select("project_id", "tokens", "paid")


def _paid_by_token(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _sums_by_token(named(ledger.withColumns(named_columns())))


def _sums_by_token(payments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payments summed by their set of tokens, and by token: (set, project_id, token, tokens, paid, payments), tokens their number, (project_id, token, paid, payments)."""
    sets = cut(payments.groupBy("project_id", "tokens").agg(F.sum("paid").alias("paid"), F.count("*").alias("payments")).withColumn("set", F.monotonically_increasing_id()))
    single = sets.select("set", "project_id", F.explode("tokens").alias("token"), F.size("tokens").alias("tokens"), "paid", "payments")
    return single, cut(single.groupBy("project_id", "token").agg(F.sum("paid").alias("paid"), F.sum("payments").alias("payments")))


def _paid_by_both(single: DataFrame, due: DataFrame) -> DataFrame:
    """(project_id, r, c, paid, payments) of payments that name both tokens of an invoice.

    Only payments of two tokens and more can, so invoices meet the tokens of these first. A pair is looked up by that of
    its tokens which is in fewer pairs, so a contract of all invoices is no key, and a payment meets at most as many
    pairs a token as the square root of twice their number; then its other token is looked up among the payment's own.
    """
    single = single.filter("tokens > 1").drop("tokens")
    beside = cut(single.select("project_id", "token").distinct())
    pairs = due.filter("c is not null").select("project_id", "r", "c")
    for x in ("r", "c"):
        pairs = pairs.join(beside.withColumnRenamed("token", x), ["project_id", x], "left_semi")
    pairs = cut(pairs.select("project_id", "r", "c").distinct())
    degree = pairs.select("project_id", F.explode(F.array("r", "c")).alias("token")).groupBy("project_id", "token").agg(F.count("*").alias("pairs"))
    of = lambda x: degree.select("project_id", F.col("token").alias(x), F.col("pairs").alias(f"{x}_pairs"))
    rare = F.col("r_pairs") <= F.col("c_pairs")
    keyed = cut(pairs.join(of("r"), ["project_id", "r"]).join(of("c"), ["project_id", "c"]).select("project_id", "r", "c", F.when(rare, F.col("r")).otherwise(F.col("c")).alias("token"), F.when(rare, F.col("c")).otherwise(F.col("r")).alias("other")))
    met = single.join(keyed, ["project_id", "token"]).select("set", "r", "c", F.col("other").alias("token"))
    return cut(met.join(single, ["set", "token"]).groupBy("project_id", "r", "c").agg(F.sum("paid").alias("paid"), F.sum("payments").alias("payments")))


def _own(invoices: DataFrame) -> list[str]:
    return ["project_id", "registration_number", "contract_number", *(c for c in ("row_hash",) if c in invoices.columns)]


def reconcile(ledger: DataFrame, invoices: DataFrame, tolerance: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Invoices whose matched payments differ from their total: difference is the invoice's total less the payments.

    A payment of a bank matches an invoice whose registration or contract number is among its reference tokens, and
    counts with the greatest of its credit, debit and tenge. Invoices and payments never meet in pairs: an invoice's
    payments are those of its one token and those of its other, less those that name both, each summed up before.
    Repeated invoices count each; `keep` names further columns of theirs to return.
    """
    return reconcile_named(named(ledger.withColumns(named_columns())), invoices, tolerance, keep)


def reconcile_named(payments: DataFrame, invoices: DataFrame, tolerance: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same from payments with their tokens (named)."""
    own = _own(invoices)
    due = cut(_two_tokens(invoices).select(*own, "r", "c", F.coalesce(F.col("total_amount"), F.lit(0)).cast("decimal(18,2)").alias("due"), *keep))
    single, by_token = _sums_by_token(payments)
    both = _paid_by_both(single, due)
    part = lambda df, mark, **names: df.select("project_id", *(F.col(k).alias(v) for k, v in names.items()), F.col("paid").alias(f"paid_{mark}"), F.col("payments").alias(f"n_{mark}"))
    out = due.join(part(by_token, "r", token="r"), ["project_id", "r"], "left").join(part(by_token, "c", token="c"), ["project_id", "c"], "left").join(part(both, "b", r="r", c="c"), ["project_id", "r", "c"], "left")
    total = lambda x: F.coalesce(F.col(f"{x}_r"), F.lit(0)) + F.coalesce(F.col(f"{x}_c"), F.lit(0)) - F.coalesce(F.col(f"{x}_b"), F.lit(0))
    out = out.withColumn("payments", total("n").cast("long")).filter("payments > 0").withColumn("paid_total", total("paid").cast("double")).withColumn("invoice_total", F.col("due").cast("double"))
    out = out.withColumn("difference", F.round((F.col("due") - total("paid")).cast("double"), 2)).filter(F.abs("difference") >= tolerance)
    return out.select(*own, "invoice_total", "paid_total", "payments", "difference", *keep)


def mismatch_parties(ledger: DataFrame, invoices: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """The party of each mismatched invoice: its buyer, else its supplier, by name and by digits of the id."""
    sides = ("buyer_name", "supplier_name", "buyer_iin_bin", "supplier_iin_bin")
    named = lambda c: F.nullif(F.trim(c), F.lit(""))
    found = reconcile(ledger, invoices, tolerance, sides)
    identifier = F.coalesce(strip_iin(F.col("buyer_iin_bin")), strip_iin(F.col("supplier_iin_bin")), F.lit("—"))
    return found.select(*_own(invoices), F.coalesce(named("buyer_name"), named("supplier_name"), F.lit("Не указан")).alias("name"), identifier.alias("identifier"), F.col("payments").alias("transaction_count"), F.col("paid_total").alias("turnover"))


def mismatch_rows(ledger: DataFrame, invoices: DataFrame, limit: int = 8, tolerance: float = 1.0) -> DataFrame:
    """Of each mismatched invoice the largest payments, the newest of equal ones, with rank.

    The largest ones of an invoice are among the largest of its two tokens, so only so many payments of a token meet
    the invoices that name it.
    """
    order = [F.desc("paid"), F.col("operation_date").desc_nulls_first(), F.col("operation_ts").desc_nulls_first(), F.col("tx_id")]
    rows = ledger.filter("source_bank <> 'esf'").select("project_id", "tx_id", paid().alias("paid"), "operation_date", "operation_ts", "direction", F.explode(_references()).alias("token"))
    rank = F.row_number().over(Window.partitionBy("project_id", "token").orderBy(*order))
    most = cut(rows.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank"))
    own = _own(invoices)
    found = reconcile(ledger, invoices, tolerance).select(*own).distinct()
    named = _two_tokens(found).select(*own, F.explode(F.array_compact(F.array("r", "c"))).alias("token"))
    met = named.join(most, ["project_id", "token"]).drop("token").distinct()
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(*order))
    return met.withColumn("rank", rank).filter(F.col("rank") <= limit).select(*own, "tx_id", F.col("paid").cast("double").alias("amount"), "operation_date", F.col("rank").cast("long").alias("rank"))


def mismatch_indicators(ledger: DataFrame, invoices: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """The four figures of each mismatched invoice as rows."""
    cells = {"invoice_total": F.col("invoice_total"), "paid_total": F.col("paid_total"), "difference": F.abs("difference"), "payments": F.col("payments").cast("double")}
    return reconcile(ledger, invoices, tolerance).select(*_own(invoices), F.explode(F.array(*(F.struct(F.lit(k).alias("indicator"), v.alias("value")) for k, v in cells.items()))).alias("x")).select(*_own(invoices), "x.*")


def invoice_shadow(invoices: DataFrame, ledger: DataFrame) -> DataFrame:
    """Invoices that the ledger lacks, as ledger rows: the supplier pays, purchases are debits and sales credits."""
    known = ledger.select("project_id", "row_hash")
    amount, buys = amount_of(), F.col("esf_direction") == "purchase"
    return invoices.join(known, ["project_id", "row_hash"], "left_anti").select(
        F.concat(F.lit("esf-"), "registration_number").alias("tx_id"), "project_id", "row_hash", F.lit("esf").alias("source_bank"), effective().alias("operation_ts"), F.coalesce("currency_code", F.lit("KZT")).alias("currency"), amount.alias("amount_kzt"),
        F.when(buys, amount).otherwise(0).alias("amount_debit"), F.when(buys, 0).otherwise(amount).alias("amount_credit"), F.when(buys, "debit").otherwise("credit").alias("direction"), F.col("tru_name").alias("purpose_text"),
        *(F.col(f"{a}_{c}").alias(f"{b}_{c}") for a, b in (("supplier", "payer"), ("buyer", "receiver")) for c in ("name", "iin_bin")),
    )


INVOICE_SORT = ["registration_number", "esf_status", "issue_date", "turnover_date", "year", "supplier_iin_bin", "supplier_name", "buyer_iin_bin", "buyer_name", "contract_number", "tru_name", "unit", "quantity", "price_without_vat", "price_with_vat", "turnover_amount", "vat_rate", "vat_amount", "total_amount", "currency_code"]


def invoice_sort(by: str, descending: bool = True) -> list[Column]:
    if by not in INVOICE_SORT:
        raise ValueError(f"no sort by {by}")
    return [F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(), effective().desc_nulls_last(), F.asc("registration_number")]
