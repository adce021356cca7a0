"""Identifiers: tax ids, accounts, fingerprints, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_text, once

#: Fixed value: the namespace of transaction ids.
TX_NAMESPACE = "b7c8b2f7-8a2a-4a3f-a5ad-1a8b7ddc0e7a"


def iin12(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) == 12, digits)


def strip_iin(c: Column) -> Column:
    """Digits of a tax id, at most 12; scientific notation is written out first."""
    plain = F.when(c.rlike(r"^\s*[0-9.]+[eE][+-]?\d+\s*$"), F.trim(c).try_cast("double").try_cast("decimal(38,0)").cast("string")).otherwise(c)
    return F.nullif(F.substring(F.regexp_replace(plain, r"\D", ""), 1, 12), F.lit(""))


def iban(c: Column) -> Column:
    t = F.regexp_replace(F.upper(c), r"(?U)\s+", "")
    return F.when(t.startswith("KZ") & F.length(t).between(10, 34), t)


def header_fingerprint(headers: Column) -> Column:
    names = F.array_sort(F.filter(F.transform(headers, norm_text), lambda x: x != ""))
    return F.sha2(F.concat_ws("|", names), 256)


def row_hash(bank: Column, account: Column, ts: Column, amount: Column, payer: Column, receiver: Column, purpose: Column) -> Column:
    """Identity of a payment: equal for replays of a row, whatever file it comes from."""
    payload = F.struct(
        account.alias("account"), amount.cast("double").alias("amt"), bank.alias("bank"), payer.alias("payer"), F.substring(F.coalesce(purpose, F.lit("")), 1, 200).alias("purpose"), receiver.alias("recv"), F.coalesce(ts.cast("string"), F.lit("")).alias("ts")
    )
    return F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based version 5 UUID, as hexadecimal text."""
    variant = lambda h: F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = lambda h: F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant(h), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return once(F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))), parts)


def tx_id(project: Column, hash_: Column) -> Column:
    return uuid5(TX_NAMESPACE, F.concat(F.coalesce(project, F.lit("global")), F.lit(":"), hash_))
