"""Predicates over the ledger and invoices."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import effective_ts
from ..functions.numbers import debit_amount, number
from ..functions.text import any_of, derived_category, norm_account, norm_iin, norm_name, text_match


def effective() -> Column:
    """When a payment happened."""
    return effective_ts(F.col("operation_ts"), F.col("operation_date"))


def category_of() -> Column:
    return derived_category(F.col("transaction_category"), F.col("sdp_name"), F.col("purpose_text"), F.col("operation_type_raw"), F.col("direction"))


def scoped(df: DataFrame, project_id: str | None) -> DataFrame:
    return df if project_id is None else df.filter(F.col("project_id") == project_id)


def meaningful(df: DataFrame) -> DataFrame:
    """Drops rows without date, amount, party, purpose and currency."""
    text = ["payer_name", "payer_account", "receiver_name", "receiver_account", "purpose_text", "currency"]
    return df.filter(any_of(F.col("operation_ts").isNotNull(), F.col("operation_date").isNotNull(), *(number(F.col(c)) > 0 for c in ("amount_kzt", "amount_debit", "amount_credit")), *(F.trim(F.coalesce(c, F.lit(""))) != "" for c in map(F.col, text))))


def party_is(side: str, value: str) -> Column:
    v = F.lit(value)
    return any_of(norm_name(F.col(f"{side}_name")) == norm_name(v), norm_iin(F.col(f"{side}_iin_bin")) == norm_iin(v), norm_account(F.col(f"{side}_account")) == norm_account(v))


def apply_filters(
    df: DataFrame, *, project_id: str | None = None, on: date | None = None, date_from: date | None = None, date_to: date | None = None, category: str | None = None, search: str | None = None,
    min_amount: float | None = None, max_amount: float | None = None, currency: str | None = None, sender: str | None = None, recipient: str | None = None,
) -> DataFrame:
    """All given conditions; date_to includes its whole day. Amounts and days stay plain comparisons, which reach the scan."""
    df = scoped(df, project_id)
    if on:
        df = df.filter(((F.col("operation_ts") >= F.lit(on)) & (F.col("operation_ts") < F.lit(on + timedelta(1)))) | (F.col("operation_date") == F.lit(on)))
    if date_from:
        df = df.filter(effective() >= F.lit(date_from))
    if date_to:
        df = df.filter(effective() < F.lit(date_to + timedelta(1)))
    if category:
        df = df.filter(category_of() == category)
    if search:
        df = df.filter(any_of(*(text_match(F.col(c), search) for c in ("purpose_text", "payer_name", "receiver_name", "payer_account", "receiver_account", "operation_type_raw"))))
    if min_amount is not None:
        df = df.filter(F.col("amount_kzt") >= min_amount)
    if max_amount is not None:
        df = df.filter(F.col("amount_kzt") <= max_amount)
    if currency:
        df = df.filter(F.col("currency") == currency)
    for side, value in (("payer", sender), ("receiver", recipient)):
        if value:
            df = df.filter(party_is(side, value))
    return df


def list_filter(df: DataFrame, scope: str = "bank", **conditions) -> DataFrame:
    """Ledger list: invoice shadows only with scope "all"."""
    out = apply_filters(df, **conditions)
    return out if scope == "all" else out.filter(F.coalesce(F.lower("source_bank"), F.lit("")) != "esf")


def invoice_filter(df: DataFrame, *, on: date | None = None, search: str | None = None, currency: str | None = None, supplier: str | None = None, buyer: str | None = None) -> DataFrame:
    if on:
        df = df.filter((F.col("issue_date").cast("date") == F.lit(on)) | (F.col("turnover_date").cast("date") == F.lit(on)))
    if search:
        df = df.filter(any_of(*(text_match(F.col(c), search) for c in ("registration_number", "tru_name", "contract_number"))))
    if currency:
        df = df.filter(F.col("currency_code") == currency)
    for side, value in (("supplier", supplier), ("buyer", buyer)):
        if value:
            df = df.filter(any_of(text_match(F.col(f"{side}_name"), value), F.col(f"{side}_iin_bin") == value))
    return df


#: Fixed values: (column, whether case counts, words) of cash withdrawals and deposits.
CASH_OUT = [
    ("purpose_text", False, ["cash", "atm"]),
    ("purpose_text", True, ["снятие", "СНЯТИЕ", "налич", "НАЛИЧ"]),
    ("sdp_name", True, ["снятие", "Снятие", "налич", "НАЛИЧ"]),
    ("sdp_name", False, ["atm"]),
    ("operation_type_raw", True, ["снятие", "Снятие", "налич", "НАЛИЧ", "банкомат", "Банкомат"]),
    ("operation_type_raw", False, ["atm"]),
    ("operation_type_raw", True, ["исх.док", "ИСХ"]),
]
CASH_IN = [
    ("purpose_text", False, ["deposit", "cash in"]),
    ("purpose_text", True, ["взнос", "Взнос", "пополн", "Пополн"]),
    ("sdp_name", False, ["deposit"]),
    ("sdp_name", True, ["взнос", "Взнос", "пополн", "Пополн", "налич", "Налич"]),
    ("operation_type_raw", True, ["вх.док", "ВХ", "кредит", "КРЕДИТ", "взнос", "Взнос"]),
    ("operation_type_raw", False, ["deposit"]),
]


def cash(kind: str) -> Column:
    """Condition on withdrawals or deposits of cash; any outgoing document counts as a withdrawal."""
    return any_of(*((F.coalesce(F.col(c), F.lit("")) if exact else F.lower(F.coalesce(F.col(c), F.lit("")))).contains(w) for c, exact, words in (CASH_OUT if kind == "withdrawal" else CASH_IN) for w in words))


#: Words of cash-outs in the detectors.
CASH_WORDS = "снятие|налич|cash|atm|банкомат"


def has_cash_words() -> Column:
    return F.lower(F.concat_ws(" | ", "purpose_text", "operation_type_raw", "transaction_category")).rlike(CASH_WORDS)


def is_cash_out() -> Column:
    return (debit_amount(F.col("amount_debit"), F.col("direction"), F.col("amount_kzt")) > 0) & has_cash_words()
