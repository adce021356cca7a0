"""Parties: keys, names, direction, orientation, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .text import any_of, norm_text


def counterparty_key(iin: Column, account: Column, name: Column, order: str = "name", strict_ids: bool = False) -> Column:
    """Key of a party. order "name": id, name, account; "account": id, account, name; "fraud": digits of the id, then account, name.

    The fraud order takes the all-zero id for an id unless strict_ids is set.
    """
    known = F.when(~text.is_unknown_name(name), F.concat(F.lit("name:"), text.norm_name(name)))
    if order == "fraud":
        digits = F.regexp_replace(F.coalesce(iin, F.lit("")), r"\D", "")
        by_id = F.when((digits != "") & (~digits.rlike("^0+$") if strict_ids else F.lit(True)), F.concat(F.lit("iin:"), digits))
        acc = F.upper(F.trim(F.coalesce(account, F.lit(""))))
        plain = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\s+", " "))
        return F.coalesce(by_id, F.when(acc != "", F.concat(F.lit("acc:"), acc)), F.when(plain != "", F.concat(F.lit("name:"), plain)))
    by_id = F.when(~text.is_unknown_iin(iin), F.concat(F.lit("iin:"), text.norm_iin(iin)))
    acc = F.when(text.norm_account(account) != "", F.concat(F.lit("acc:"), text.norm_account(account)))
    return F.coalesce(by_id, known, acc) if order == "name" else F.coalesce(by_id, acc, known)


def better_name(name: Column) -> Column:
    """Aggregate: the longest name of a group, the greatest of equally long ones."""
    return F.max(F.when(name.isNotNull(), F.struct(F.length(name).alias("size"), name.alias("name"))))["name"]


#: Words that tell the direction of a payment, in order.
DIRECTION_WORDS = [
    (["дебет"], "debit"),
    (["кредит"], "credit"),
    (["исх", "списан", "списание", "расход", "переводом card to card", "перевод card to card"], "debit"),
    (["вх", "зачисл", "поступл", "приход", "зачисление"], "credit"),
]


def derive_direction(op_type: Column, purpose: Column, debit: Column, credit: Column) -> Column:
    both = F.concat_ws(" | ", F.nullif(norm_text(op_type), F.lit("")), F.nullif(norm_text(purpose), F.lit("")))

    def named(t: Column) -> Column:
        out = None
        for words, name in DIRECTION_WORDS:
            hit = any_of(*(t.contains(w) for w in words))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out

    d, c = F.coalesce(debit.cast("double"), F.lit(0.0)), F.coalesce(credit.cast("double"), F.lit(0.0))
    return F.coalesce(text.once(both, named), F.when((d != 0) & (c == 0), "debit").when((c != 0) & (d == 0), "credit"))


def party(name: Column, iin: Column, account: Column) -> Column:
    return F.struct(name.alias("name"), iin.alias("iin_bin"), account.alias("account"))


def orient(incoming: Column, owner: Column, other: Column) -> Column:
    """Payer and receiver of a payment between a statement's owner and another party."""
    return F.struct(F.when(incoming, other).otherwise(owner).alias("payer"), F.when(incoming, owner).otherwise(other).alias("receiver"))


def normalize_identity(name: Column, iin: Column, account: Column) -> Column:
    """Cleaned triple with '' for unknown; a missing name falls back to account, then id."""
    n = F.when(~text.is_unknown_name(name), F.trim(name))
    i = F.when(~text.is_unknown_iin(iin), F.trim(iin))
    a = text.clean_optional_text(account)
    return party(F.coalesce(n, a, i, F.lit("")), F.coalesce(i, F.lit("")), F.coalesce(a, F.lit("")))


def resolve_counterparty_name(name: Column, iin: Column, account: Column) -> Column:
    return F.coalesce(*(text.clean_optional_text(c) for c in (name, iin, account)))


def quality(df_cols: dict[str, Column]) -> Column:
    """2 for each name and id, 1 for each account, 1 for purpose, category and type each."""
    points = {"payer_name": 2, "payer_iin_bin": 2, "payer_account": 1, "receiver_name": 2, "receiver_iin_bin": 2, "receiver_account": 1, "purpose_text": 1, "sdp_name": 1, "operation_type_raw": 1}
    has = lambda k: ~text.is_unknown_iin(df_cols[k]) if k.endswith("iin_bin") else ~text.is_unknown_name(df_cols[k])
    return reduce(lambda a, b: a + b, (F.when(has(k), n).otherwise(0) for k, n in points.items()))


SIGNATURE = ["project_id", "operation_ts", "operation_date", "currency", "amount_currency", "amount_kzt", "amount_credit", "amount_debit", "direction", "payer_iin_bin", "payer_account", "receiver_iin_bin", "receiver_account", "purpose_text"]


def signature(cols: list[str] | None = None) -> Column:
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(norm_text(F.col(c).cast("string")), F.lit("")) for c in cols or SIGNATURE)), 256)
