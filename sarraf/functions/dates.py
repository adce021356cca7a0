"""Dates and times: the formats that statements and invoices use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: Accepted formats, in order.
FORMATS = [f"{d}{t}" for d in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy") for t in (" HH:mm:ss", " HH:mm", "")]
INVOICE_FORMATS = [*FORMATS, "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS"]


def parse_operation_datetime(c: Column, formats: list[str] | None = None) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats or FORMATS))


def parse_datetime(c: Column) -> Column:
    """Day-first; free-form dates are narrowed to the listed formats and their short-year and dashed variants."""
    t = F.regexp_replace(F.trim(c), r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})", "$1.$2.$3")
    t = F.regexp_replace(t, r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2})(?!\d)", "$1.$2.20$3")
    t = F.regexp_replace(t, r"^(\d{4})[./](\d{1,2})[./](\d{1,2})", "$1-$2-$3")
    short = ["d.M.yyyy HH:mm:ss", "d.M.yyyy HH:mm", "d.M.yyyy", "yyyy-M-d HH:mm:ss", "yyyy-M-d"]
    return once(t, lambda t: F.coalesce(parse_operation_datetime(t, INVOICE_FORMATS), *(F.try_to_timestamp(t, F.lit(f)) for f in short)))


def extract_all_dates(c: Column) -> Column:
    """All dates of a text in order, each once: first the day-first ones, then the year-first ones."""
    t = F.translate(c, "–—", "--")
    found = F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (r"(?<!\d)\d{1,2}[./-]\d{1,2}[./-]\d{2,4}(?!\d)", r"(?<!\d)\d{4}[./-]\d{1,2}[./-]\d{1,2}(?!\d)")))
    return F.array_distinct(F.array_compact(F.transform(found, lambda x: parse_datetime(x).cast("date"))))


def parse_period(c: Column) -> Column:
    dates = extract_all_dates(c)
    return F.struct(F.get(dates, F.lit(0)).alias("period_from"), F.get(dates, F.lit(1)).alias("period_to"))


def effective_ts(ts: Column, date: Column) -> Column:
    return F.coalesce(ts, date.cast("timestamp"))
