"""Column functions against plain Python."""

import hashlib
import json
import uuid
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sarraf.functions import dates, ids, numbers, parties, text


def values(spark, expression, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(expression).collect()]


def test_cleaning(spark):
    assert values(spark, text.clean_optional_text(F.col("x")), [" a ", "NaN", "n/a", "", None]) == ["a", None, None, None, None]
    assert values(spark, text.norm_text(F.col("x")), ["  ИИН / БИН — ", "Сумма :  5", "“A”  b", None]) == ["иин/бин", "сумма:5", "a b", ""]
    assert values(spark, text.norm_name(F.col("x")), ['"ТОО  Ромашка"', None]) == ["тоо ромашка", ""]


def test_mojibake(spark):
    plain = ["Перевод средств", "Hello", "Рахмет", "日本"]
    garbled = ["Перевод".encode().decode("cp1251"), "Перевод".encode().decode("latin1")]
    assert values(spark, text.repair_mojibake(F.col("x")), plain + garbled) == [*plain, "Перевод", "Перевод"]


def test_numbers(spark):
    rows = ["1 234,50 KZT", "0.00 вал 0.00", "1,234.5", "нет", "-7", None]
    assert values(spark, numbers.parse_decimal(F.col("x")), rows) == [1234.5, 0.0, 1.234, None, -7.0, None]
    assert values(spark, numbers.to_float(F.col("x")), ["1 234,5", "x", None]) == [1234.5, 0.0, 0.0]
    money = numbers.resolve_amount_kzt(*(F.col(c) for c in "kacds"[:1] + "adc"), F.col("cur"))
    rows = [(5.0, 1.0, 0.0, 0.0, "USD"), (0.0, 2.0, 0.0, 0.0, "USD"), (0.0, 0.0, 3.0, 4.0, None), (0.0, 2.0, 0.0, 0.0, "XXX")]
    assert values(spark, money, rows, "k double, a double, d double, c double, cur string") == [5.0, 951.0, 4.0, 0.0]
    assert values(spark, numbers.delta_percent(F.col("a"), F.col("b")), [(0.0, 0.0), (0.0, 5.0), (4.0, 5.0)], "a double, b double") == [0.0, None, 25.0]


def test_dates(spark):
    rows = ["2024-03-01", "01.03.2024 10:20", "01/03/2024 10:20:30", "bad", None]
    assert values(spark, dates.parse_operation_datetime(F.col("x")), rows) == [datetime(2024, 3, 1), datetime(2024, 3, 1, 10, 20), datetime(2024, 3, 1, 10, 20, 30), None, None]
    assert values(spark, dates.extract_all_dates(F.col("x")), ["c 01.02.2023 по 3/4/23, снова 01.02.2023", ""]) == [[date(2023, 2, 1), date(2023, 4, 3)], []]


def test_ids(spark):
    assert values(spark, ids.iin12(F.col("x")), ["900 101-300123", "12", None]) == ["900101300123", None, None]
    assert values(spark, ids.strip_iin(F.col("x")), ["8.6e+11", "860101300123.0", ""]) == ["860000000000", "860101300123", None]
    assert values(spark, ids.iban(F.col("x")), ["kz12 3456 7890", "DE12345678", "KZ1"]) == ["KZ1234567890", None, None]
    assert values(spark, ids.uuid5(ids.TX_NAMESPACE, F.col("x")), ["global:abc", "п:1"]) == [str(uuid.uuid5(uuid.UUID(ids.TX_NAMESPACE), x)) for x in ("global:abc", "п:1")]
    h = ids.row_hash(*(F.col(c) for c in "batmprw"))
    want = {"account": None, "amt": 5.5, "bank": "kaspi", "payer": "p", "purpose": "w" * 200, "recv": "r", "ts": "2024-01-01"}
    got = values(spark, h, [("kaspi", None, "2024-01-01", 5.5, "p", "r", "w" * 300)], "b string, a string, t string, m double, p string, r string, w string")
    assert got == [hashlib.sha256(json.dumps(want, separators=(",", ":")).encode()).hexdigest()]
    headers = spark.createDataFrame([(["Б", " а ", ""],), (["а", "б"],)], "x array<string>").select(ids.header_fingerprint(F.col("x"))).collect()
    assert headers[0] == headers[1]


@pytest.mark.parametrize(("order", "want"), [("name", ["iin:1", "name:ann", "acc:KZ1", None]), ("account", ["iin:1", "acc:KZ1", "acc:KZ1", None]), ("fraud", ["iin:1", "iin:000000000000", "acc:KZ 1", None])])
def test_counterparty_keys(spark, order, want):
    rows = [("1", "KZ1", "Ann"), ("000000000000", "KZ-1", "Ann"), (None, "kz 1", "UNKNOWN"), (None, None, None)]
    assert values(spark, parties.counterparty_key(F.col("i"), F.col("a"), F.col("n"), order), rows, "i string, a string, n string") == want


def test_direction_and_tokens(spark):
    rows = [("исх.док.(дебет)", "кредит", 0.0, 1.0), (None, "зачисление", 0.0, 0.0), (None, "прочее", 2.0, 0.0), (None, None, 0.0, 0.0)]
    assert values(spark, parties.derive_direction(F.col("t"), F.col("p"), F.col("d"), F.col("c")), rows, "t string, p string, d double, c double") == ["debit", "credit", "debit", None]
    assert values(spark, text.reference_tokens(F.col("x")), ["Оплата № 12/345, ESF-KZ-1", "№ 1", ""]) == [["12/345", "ESF-KZ-1"], [], []]
    assert values(spark, text.clean_purpose(F.col("x")), ["Оплата № 55 от 01.02.2024 (ТОО) без НДС KZ12345678901234567890", None]) == ["Оплата от", ""]
    assert values(spark, text.is_service_row(F.col("x")), ["Итого: 5", "1 2 3", "Оплата", ""]) == [True, True, False, True]


def test_labels(spark):
    assert values(spark, text.format_money(F.col("x").cast("double")), ["1234567.5"]) == ["1 234 568 KZT"]
    assert values(spark, text.truncate(F.col("x"), 5), ["abcdefgh", "abc", ""]) == ["abcd…", "abc", "—"]
