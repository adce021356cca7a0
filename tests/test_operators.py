"""Operators on small hand-made ledgers, and invariants."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sarraf.operators import classify, detectors, filters, graph, invoices, sheets, vectors
from sarraf.sources import readers, sinks

LEDGER = "tx_id string, project_id string, file_id string, operation_ts timestamp, operation_date date, currency string, amount_kzt decimal(18,2), amount_credit decimal(18,2), amount_debit decimal(18,2), direction string, payer_name string, payer_iin_bin string, payer_account string, receiver_name string, receiver_iin_bin string, receiver_account string, purpose_text string, operation_type_raw string, transaction_category string, sdp_name string, raw_note string, source_bank string"


def tx(i, day, credit=0, debit=0, other="1", purpose="", file="f"):
    from decimal import Decimal

    c, d = Decimal(credit), Decimal(debit)
    me, them = ("Me", "900", "KZME"), (f"P{other}", other.zfill(12), f"KZ{other}")
    payer, receiver = (them, me) if credit else (me, them)
    return (f"t{i}", "p", file, datetime(2024, 1, day, 12), date(2024, 1, day), "KZT", c + d, c, d, "credit" if credit else "debit", *payer, *receiver, purpose, "", None, None, None, "kaspi")


def ledger(spark, rows):
    return spark.createDataFrame(rows, LEDGER)


def codes(spark, rows, **thresholds):
    return {r["code"] for r in detectors.detect(ledger(spark, rows), detectors.Thresholds(**thresholds)).collect()}


TRANSIT = [tx(i, 1 + i % 2, credit=70_000, other=str(10 + i)) for i in range(5)] + [tx(9 + i, 1 + i % 2, debit=95_000, other=str(50 + i)) for i in range(3)]


def test_transit_and_just_missed(spark):
    assert "dropper_transit" in codes(spark, TRANSIT)
    assert "dropper_transit" not in codes(spark, TRANSIT[1:])


@pytest.mark.parametrize(
    ("code", "rows", "drop"),
    [
        ("cash_out", [tx(0, 1, credit=260_000)] + [tx(1 + i, 2, debit=80_000, purpose="Снятие наличных") for i in range(2)], -1),
        ("structuring", [tx(i, 1 + i, credit=50_000, other=str(10 + i)) for i in range(6)], 0),
        ("repeated_amount_patterns", [tx(i, 1 + i, debit=777, other=str(i)) for i in range(4)], 0),
        ("high_activity_spike", [tx(i, 3, debit=100 + i, other=str(i)) for i in range(10)], 0),
        ("repeated_counterparty_flows", [tx(i, 1 + i, debit=125_000 + i) for i in range(4)], 0),
        ("fan_in_drop_account", [tx(i, 1 + i, credit=10 + i, other=str(10 + i % 5)) for i in range(8)], 0),
        ("rapid_balance_flush", [tx(0, 1, credit=300_000), tx(1, 1, debit=250_000), tx(2, 2, debit=1)], 1),
        ("purpose_mismatch", [tx(i, 1 + i, debit=200_000, purpose="Частный перевод", other=str(i)) for i in range(3)], 0),
    ],
)
def test_detectors(spark, code, rows, drop):
    assert code in codes(spark, rows)
    assert code not in codes(spark, [r for i, r in enumerate(rows) if i != drop % len(rows)])


def test_evidence(spark):
    rows = detectors.prepared(ledger(spark, TRANSIT))
    warned = detectors.detect(ledger(spark, TRANSIT))
    assert detectors.party_evidence(rows, warned, True, 2).count() == 2
    got = detectors.row_evidence(rows, warned, 4).collect()
    assert len(got) == 4 and [r["operation_ts"] for r in got] == sorted((r["operation_ts"] for r in got), reverse=True)


def test_filters(spark):
    x = ledger(spark, TRANSIT)
    assert filters.apply_filters(x, date_from=date(2024, 1, 2), date_to=date(2024, 1, 2)).count() == filters.apply_filters(x, on=date(2024, 1, 2)).count() == 3
    assert filters.apply_filters(x, sender="p11").count() == 1
    assert filters.meaningful(x).count() == len(TRANSIT)


def test_graph(spark):
    pairs = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("x", "y"), ("q", "q")], "a string, b string")
    assert {tuple(r) for r in graph.connected_components(pairs).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}
    e = spark.createDataFrame([("a", "b", 5.0, 1), ("b", "c", 4.0, 1), ("c", "d", 3.0, 1), ("a", "z", 1.0, 1)], "source string, target string, amount double, tx_count long")
    nodes, found = graph.neighbourhood(e, "a", 2, 1)
    assert {(r["id"], r["level"]) for r in nodes.collect()} == {("a", 0), ("b", 1)} and found.count() == 1
    nodes, found = graph.neighbourhood(e, "a", None, None)
    assert nodes.count() == 5 and found.count() == 4


@pytest.mark.parametrize(("purpose", "rule"), [("Комиссия за перевод в тенге", "USR_ANY_COMMISSION_01"), ("выдача займа", "LOAN_ISS_01"), ("Погашение кредита", "LOAN_REP_01"), ("выплата зп", "SAL_01"), ("Пополнение", "TOPUP_02"), ("через Recycler", "CASH_TOPUP_DIRECT"), ("абв", "DEFAULT_OTHER"), ("ипотека", "LOAN_REP_03"), ("Pin-Up", "GAMB_01")])
def test_rules(spark, purpose, rule):
    df = spark.createDataFrame([(purpose, "")], "purpose_text string, operation_type_raw string")
    assert classify.classify_rules(df).first()["category_rule_id"] == rule


def test_vector_fallback_and_reclassify(spark):
    rows = spark.createDataFrame([("1", "абв", "", [1.0, 0.1]), ("2", "зарплата", "", [1.0, 0.0]), ("3", "где", "", [0.0, -1.0])], "tx_id string, purpose_text string, operation_type_raw string, semantic_embedding array<float>")
    labels = spark.createDataFrame([("FX", [1.0, 0.0]), ("CASH", [0.0, 1.0])], "label string, embedding array<float>")
    got = {r["tx_id"]: (r["transaction_category"], r["category_source"]) for r in classify.classify_vectors(classify.classify_rules(rows), labels).collect()}
    assert got == {"1": ("FX", "vector"), "2": ("SALARY", "rule"), "3": ("OTHER", "other")}


QUESTIONS = [
    ("платежи больше 5 млн", "amount_kzt", 5e6), ("платежи больше 5 млн", "amount_op", ">"), ("суммы менее 500 тыс", "amount_kzt", 5e5), ("суммы менее 500 тыс", "amount_op", "<"), ("за 2024 год", "date_from", date(2024, 1, 1)),
    ("за март 2024", "date_to", date(2024, 3, 31)), ("за январь 2024", "date_from", date(2024, 1, 1)), ("входящие переводы", "direction", "credit"), ("исходящие платежи kaspi", "source_bank", "kaspi"), ("исходящие платежи kaspi", "direction", "debit"),
    ("операции по займам", "topic", "loan"), ("налоговые выплаты за 2023", "topic", "tax"), ("топ 10 получателей по сумме", "top_n", 10), ("покажи все транзакции", "amount_kzt", None), ("покажи все транзакции", "date_from", None), ("платежи в евро", "currency", "EUR"),
]


def test_questions(spark):
    got = {r["question"]: r for r in classify.tag_questions(spark.createDataFrame([(q,) for q in {q for q, _, _ in QUESTIONS}], "question string")).collect()}
    assert [(q, c, got[q][c]) for q, c, _ in QUESTIONS] == QUESTIONS


def test_reconcile(spark):
    inv = spark.createDataFrame([("p", "ESF-100", "D-7", 1000.0), ("p", "ESF-200", None, 500.0), ("p", "ESF-300", None, 9.0)], "project_id string, registration_number string, contract_number string, total_amount double").withColumns({c: F.lit(None).cast("double") for c in ("cost_with_indirect_tax", "turnover_amount", "cost_without_indirect_tax")})
    pay = ledger(spark, [tx(1, 1, debit=400, purpose="Оплата ESF-100 по № D-7"), tx(2, 2, debit=500, purpose="за ESF-200"), tx(3, 2, debit=1, purpose="прочее")])
    got = [(r["registration_number"], r["paid_total"], r["payments"], r["difference"]) for r in invoices.reconcile(pay, inv).collect()]
    assert got == [("ESF-100", 400.0, 1, 600.0)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("p", "a", "t1", "OTHER")], "project_id string, row_hash string, tx_id string, transaction_category string")
    new = spark.createDataFrame([("p", "a", "t9", "CASH"), ("p", "b", "t2", "FX"), ("p", "b", "t3", "FX")], old.schema)
    once = sinks.upsert_ledger(old, new)
    assert {tuple(r) for r in once.drop("tx_id").collect()} == {("p", "a", "CASH"), ("p", "b", "FX")}
    assert once.filter("row_hash = 'a'").first()["tx_id"] == "t1"
    assert sinks.upsert_ledger(once, new).count() == 2
    assert sinks.insert_ignore(old, new, ["project_id", "row_hash"]).count() == 2


CELLS = [
    (0, ["Наименование клиента: ТОО Ромашка"]),
    (2, ["Плательщик", None, "Получатель", None, "Дата операции", "Сумма по дебету", "Назначение платежа"]),
    (3, ["Наименование/ФИО", "ИИН/БИН", "Наименование/ФИО", "ИИН/БИН", None, None, None]),
    (4, ["1", "2", "3", "4", "5", "6", "7"]),
    (5, ["Анна", "900101300123", "Борис", "12", "01.02.2024", "100,50", "Оплата услуг"]),
    (6, ["Анна", "900101300123", "Вера", "900101300124", "02.02.2024", "7", "Перевод"]),
    (7, ["Итого по дебету", None, None, None, None, "107,50"]),
    (12, ["после", "трёх", "пустых", "строк"]),
]


def test_sheets(spark):
    cells = spark.createDataFrame([("f", "s", r, c, v) for r, vs in CELLS for c, v in enumerate(vs) if v is not None], readers.CELLS)
    found = sheets.block_rows(cells)
    assert found.count() == 3  # the total is dropped as a service row
    out = sheets.to_ledger(sheets.canonical(found), "p", "kaspi").orderBy("source_row_no").collect()
    assert [(r["payer_name"], r["receiver_name"], float(r["amount_debit"]), r["direction"], r["confidence_score"]) for r in out] == [("Анна", "Борис", 100.5, "debit", 0.9), ("Анна", "Вера", 7.0, "debit", 1.0)]
    assert out[0]["parse_warnings"] == "bad_iinbin:receiver_iin_bin:12"
    meta = {r["field"]: r["value"] for r in sheets.pick_metadata(sheets.metadata(cells)).collect()}
    assert meta["client_name"] == "ТОО Ромашка"
    assert {(r["field"], r["value"]) for r in sheets.footers(cells).collect()} == {("total_debit", 107.5)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("operation_ts,direction,currency,amount_currency,amount_kzt,payer_name\n01.02.2024,debit,USD,\"2,00\",,A\nbad,debit,KZT,5,,B\n2024-02-03,credit,,7,,nan\n", encoding="utf-8")
    got = readers.read_ledger_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(float(r["amount_kzt"]), float(r["amount_debit"]), float(r["amount_credit"]), r["skipped"]) for r in got] == [(951.0, 2.0, 0.0, False), (5.0, 5.0, 0.0, True), (7.0, 0.0, 7.0, False)]
    head = ";".join(["Регистрационный номер ЭСФ", "Код", "Статус ЭСФ", *map(str, range(36))])
    row = ["ESF-1", "x", "DELIVERED", "01.02.2024", "", "2024", "8.6e+11", "ТОО \"\"А\"\""] + [""] * 31 + ["more"]
    row[35] = "1 234,56"
    (tmp_path / "b.csv").write_text("\n".join(["Отчёт", head, ";".join(f'"{v}"' for v in row), ";;;"]), encoding="utf-8")
    r = readers.read_invoice_csv(spark, str(tmp_path / "b.csv")).collect()
    assert len(r) == 1 and r[0]["registration_number"] == "ESF-1" and r[0]["supplier_iin_bin"] == "860000000000" and float(r[0]["total_amount"]) == 1234.56 and r[0]["supplier_name"] == 'ТОО "А"' and r[0]["extra"] == {"extra_1": "more"}
    files = readers.register_files(spark, str(tmp_path)).collect()
    assert {f["filename"] for f in files} == {"a.csv", "b.csv"}
    raw = spark.createDataFrame([("Привет".encode("cp1251"),), ("﻿Привет".encode(),), ("Привет".encode("utf-16"),)], "b binary")
    assert [x[0] for x in raw.select(readers.decode_text(F.col("b"))).collect()] == ["Привет"] * 3


def test_vectors(spark):
    e = spark.createDataFrame([(i, [float(i), 1.0, 0.0], i % 2) for i in range(12)], "vec_id long, embedding array<float>, label int")
    got = vectors.knn(e.filter("vec_id = 3"), e, 3).collect()
    assert {r["vec_id"] for r in got} == {2, 3, 4}
    indexed, centres = vectors.ivf_build(e, 3)
    assert {r["vec_id"] for r in vectors.ivf_search(e.filter("vec_id = 3"), indexed, centres, 3, 3).collect()} == {2, 3, 4}
    assert vectors.centroids(e).count() == 2 and vectors.centroids(e, at_least=7).count() == 0


def test_headers(spark):
    h = spark.createDataFrame([("Дата операции",), ("платежа назначение",), ("???",)], "header string")
    assert {(r["header"], r["canonical"], r["method"]) for r in classify.map_headers(h).collect()} == {("Дата операции", "operation_ts", "exact"), ("платежа назначение", "purpose_text", "fuzzy")}


def test_profile_of_ties_nulls_and_nothing(spark):
    from sarraf.operators import analytics

    rows = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (2.0, None), (10.0, "a"), (None, "b")], "x double, s string").withColumn("nothing", F.lit(None).cast("int"))
    got = {r["column"]: r for r in analytics.profile(rows, ["x", "s", "nothing"]).collect()}
    x, s, none = got["x"], got["s"], got["nothing"]
    assert (x["count"], x["distinct"], x["mean"], x["std"], x["min"], x["q25"], x["q50"], x["q75"], x["max"], x["freq"]) == (4, 3, 3.75, 4.1932, 1.0, 1.75, 2.0, 4.0, 10.0, 2)
    assert (s["count"], s["distinct"], s["top"], s["freq"], s["mean"], s["q50"]) == (4, 2, "a", 2, None, None)
    assert (none["count"], none["distinct"], none["top"], none["freq"], none["min"]) == (0, 0, None, None, None)
    assert [r["count"] for r in analytics.profile(rows.limit(0), ["x", "s"]).collect()] == [0, 0]


def test_quartiles_over_many_ranges(spark):
    from sarraf.operators import analytics

    df = spark.range(0, 4001, 1, 8).select(((F.col("id") * 7919) % 4001 / 4).alias("v"), F.lit(5).alias("same"))
    got = {r["column"]: (r["q25"], r["q50"], r["q75"]) for r in analytics.profile(df, ["v", "same"]).collect()}
    assert got == {"v": (250.0, 500.0, 750.0), "same": (5.0, 5.0, 5.0)}


STORED = "tx_id string, purpose_text string, purpose_code string, operation_type_raw string, transaction_category string, category_source string, category_rule_id string, category_confidence double, needs_review boolean"


def test_backfill_keeps_others_and_heeds_its_limit(spark):
    rows = [("a", "Снятие наличных", None, "", "OTHER", "other", None, 1.0, True), ("b", "Снятие наличных", None, "", None, None, None, None, None), ("c", "Снятие наличных", None, "", "STORE", "manual", None, 1.0, False), ("d", "", "оплата товаров и услуг", "", "OTHER", "other", None, 1.0, True)]
    df = spark.createDataFrame(rows, STORED)
    both = lambda x: {r["tx_id"]: r["transaction_category"] for r in x.collect()}
    assert both(classify.reclassify(df)) == {"a": "CASH", "b": "CASH", "c": "STORE", "d": "STORE"}
    assert both(classify.reclassify(df, 1)) == {"a": "CASH", "b": None, "c": "STORE", "d": "OTHER"}
    assert both(classify.reclassify(df, 0)) == {"a": "OTHER", "b": None, "c": "STORE", "d": "OTHER"}


def grid(spark, file, lines):
    return [(file, "s", r, c, v) for r, line in enumerate(lines) for c, v in enumerate(line) if v is not None]


def test_layouts(spark):
    garbled = lambda t: t.encode("utf-8").decode("cp1251")
    lines = [["дата операции", "валюта", "сумма"], ["01.01.2024", "KZT", "5"], ["02.01.2024", "KZT", "6"]]
    cells = grid(spark, "plain", lines) + grid(spark, "garbled", [[garbled(x) for x in lines[0]], *lines[1:]]) + grid(spark, "narrow", [["дата операции", "валюта операции"], ["01.01.2024", "KZT"]])
    cells += grid(spark, "wide", [["transaction", "date", "amount", "payer", "purpose", "банк"], ["1", "01.01.2024", "5", "x", "y", "z"]])
    df = spark.createDataFrame(cells, "file_id string, sheet string, row_no int, col_no int, value string")
    count = lambda x: {(r["file_id"], r["layout"]): r["count"] for r in x.groupBy("file_id", "layout").count().collect()}
    found = sheets.by_layout(df)
    assert count(found) == {("plain", "kaspi"): 2, ("garbled", "halyk"): 2, ("wide", "universal"): 1}
    assert {tuple(sorted(r["row"])) for r in found.filter("file_id = 'garbled'").collect()} == {("валюта", "дата операции", "сумма")}
    banks = spark.createDataFrame([("plain", "halyk"), ("garbled", "kaspi"), ("wide", "unknown")], "file_id string, bank string")
    assert count(sheets.by_layout(df, banks)) == {("plain", "halyk"): 2, ("wide", "universal"): 1}


def test_yo_is_ye_in_headers(spark):
    lines = [["дата операции", "валюта операции", "номер счёта плательщика", "сумма", "назначение", "банк"], ["01.01.2024", "KZT", "KZ1", "5", "p", "b"]]
    df = spark.createDataFrame(grid(spark, "f", lines), "file_id string, sheet string, row_no int, col_no int, value string")
    assert [r["payer_account"] for r in sheets.canonical(sheets.block_rows(df)).collect()] == ["KZ1"]


def test_footers_by_magnitude(spark):
    lines = [["Итого", None, "10", "300", "20"], ["Итого", None, "7", "5", None], ["4 500", "Исходящий остаток", None, None, None], ["Входящий остаток", "9", "8", None, None]]
    df = spark.createDataFrame(grid(spark, "f", lines), "file_id string, sheet string, row_no int, col_no int, value string")
    got = {r["field"]: float(r["value"]) for r in sheets.footers(df).collect()}
    assert got == {"total_debit": 300, "total_credit": 20, "closing_balance": 4500, "opening_balance": 9}


def test_clusters_fall_back_on_label_vectors(spark):
    rows = spark.createDataFrame([("Cash/in hand", f"t{i}", [3.0, 4.0]) for i in range(5)] + [("Few", "t", [1.0, 0.0])], "label string, text string, embedding array<double>")
    own = spark.createDataFrame([("Cash/in hand", [0.0, 1.0]), ("Few", [0.0, 1.0]), ("None", [1.0, 0.0])], "label string, embedding array<double>")
    got = {r["label"]: (r["size"], [round(x, 6) for x in r["embedding"]], len(r["samples"]), r["keywords"]) for r in vectors.clusters(rows, "text", label_vectors=own).collect()}
    assert got == {"Cash/in hand": (5, [0.6, 0.8], 5, ["cash", "hand"]), "Few": (1, [0.0, 1.0], 1, ["few"]), "None": (0, [1.0, 0.0], 0, ["none"])}


def test_bump_usage_sees(spark):
    formats = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "format_id string, usage_count long, last_seen string")
    used = spark.createDataFrame([("a",), ("a",)], "format_id string")
    assert {tuple(r) for r in vectors.bump_usage(formats, used, F.lit("new")).select("format_id", "usage_count", "last_seen").collect()} == {("a", 3, "new"), ("b", 2, "old")}
