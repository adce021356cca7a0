"""Amounts: parsing, conversion, sides, deltas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: Tenge for one unit of a currency.
RATES = {"KZT": 1.0, "USD": 475.50, "EUR": 520.30, "RUB": 5.20, "CNY": 66.00}


def number(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def parse_decimal(c: Column) -> Column:
    """The first number in a text; spaces group thousands, one comma is a decimal point, commas beside one dot group."""
    token = F.regexp_extract(F.translate(c, " ", " "), r"-?\d+(?: ?\d{3})*(?:[.,]\d+)?", 0)

    def number(t: Column) -> Column:
        commas, dots = (F.length(t) - F.length(F.replace(t, F.lit(x), F.lit(""))) for x in (",", "."))
        return F.when((commas == 1) & (dots == 0), F.replace(t, F.lit(","), F.lit("."))).when((commas >= 1) & (dots == 1), F.replace(t, F.lit(","), F.lit(""))).otherwise(t).try_cast("double")

    return once(F.replace(token, F.lit(" "), F.lit("")), number)


def to_float(c: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_replace(c, r"(?U)\s", ""), ",", ".").try_cast("double"), F.lit(0.0))


def rate(currency: Column) -> Column:
    code = F.upper(F.trim(F.coalesce(F.nullif(currency, F.lit("")), F.lit("KZT"))))
    return F.element_at(F.create_map(*(F.lit(x) for kv in RATES.items() for x in kv)), code)


def hundredth(c: Column) -> Column:
    """The nearest hundredth by whole hundredths of a double, as SQL engines round doubles; Spark's round() goes by the shortest decimal that stands for it."""
    return F.round(c * 100) / 100


def resolve_amount_kzt(kzt: Column, amount: Column, debit: Column, credit: Column, currency: Column) -> Column:
    """The tenge amount if there is one, else the currency amount or larger side at its fixed rate; 0 without a rate."""
    base = F.when(number(amount) > 0, number(amount)).otherwise(F.greatest(number(debit), number(credit)))
    return hundredth(F.when(number(kzt) > 0, number(kzt)).when(base > 0, base * F.coalesce(rate(currency), F.lit(0.0))).otherwise(0.0))


def safe_amount(amount: Column, debit: Column, credit: Column) -> Column:
    """The larger side where the amount is over 1000 times it, or over 10 billion."""
    side, a = F.greatest(number(debit), number(credit)), number(amount)
    return F.when((side > 0) & ((a / side > 1000) | (a > 1e10)), side).otherwise(a)


def credit_amount(credit: Column, direction: Column, kzt: Column) -> Column:
    return F.when(number(credit) > 0, number(credit)).when((F.lower(F.trim(direction)) == "credit") & (number(kzt) > 0), number(kzt)).otherwise(0.0)


def debit_amount(debit: Column, direction: Column, kzt: Column) -> Column:
    return F.when(number(debit) > 0, number(debit)).when((F.lower(F.trim(direction)) == "debit") & (number(kzt) > 0), number(kzt)).otherwise(0.0)


def fill_side(side: Column, mine: Column, amount: Column, kzt: Column) -> Column:
    """A side that the direction names but that is empty takes the currency or tenge amount."""
    empty = number(side) == 0
    return F.when(mine & empty, F.when(number(amount) != 0, amount).otherwise(kzt)).otherwise(side)


def invoice_amount(*amounts: Column) -> Column:
    return F.coalesce(*(F.when(a > 0, a) for a in amounts))


def optional_year(c: Column) -> Column:
    y = c.try_cast("int")
    return F.when(y.between(1900, 2100), y)


def optional_decimal(c: Column, scale: int) -> Column:
    return F.round(parse_decimal(F.nullif(F.trim(c), F.lit(""))), scale)


def delta_percent(a: Column, b: Column) -> Column:
    return F.when(F.abs(a) < 1e-9, F.when(F.abs(b) < 1e-9, 0.0)).otherwise(F.round((b - a) / F.abs(a) * 100, 2))
