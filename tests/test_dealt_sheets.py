"""Sheets stored in buckets by file are read without shuffles; a block's header goes down its rows, and lines are normalised only where they may be headers."""

import pytest
from pyspark.sql import functions as F

from sarraf.functions import text
from sarraf.operators import sheets

HEADER = ["Дата операции", "Валюта операции", "Сумма по кредиту", "Сумма по дебету", "ИИН/БИН плательщика", "Назначение платежа"]
BODY = ["01.02.2020", "KZT", "5", None, "123", "x"]
GARBLED = [h.encode().decode("latin1") for h in HEADER]


def _cells(spark, files):
    rows = [(f, "S", r, c, v) for f, lines in files.items() for r, line in lines.items() for c, v in enumerate(line) if v is not None]
    return spark.createDataFrame(rows, "file_id string, sheet string, row_no int, col_no int, value string")


def _files():
    grouped = {
        0: ["Дата операции", "Валюта", "Сумма", "Плательщик", None, "Получатель", None, "Назначение платежа"],
        1: [None, None, None, "Наименование/ФИО", "ИИН/БИН", "Наименование/ФИО", "Номер счёта", None],
        2: ["1", "2", "3", "4", "5", "6", "7", "8"],
        3: ["01.02.2020", "KZT", "5", "А", "12", "Б", "KZ1", "x"],
    }
    two = {0: HEADER, 1: BODY, 2: ["1", "2", "3", "nan", None, "—"], 9: BODY, 20: [HEADER[5], "-", *HEADER[:4], HEADER[0]], 21: ["y", "z", "02.02.2020", "USD", "", "nan", "03.02.2020"]}
    return {"grouped": grouped, "two": two, "garbled": {3: GARBLED, 4: BODY}, "none": {0: ["a"], 1: BODY}}


def _found(df):
    return {(r["file_id"], r["block_id"], r["row_no"]): r["row"] for r in df.collect()}


def test_headers_go_down_their_blocks(spark):
    found = _found(sheets.block_rows(_cells(spark, _files())))
    plain = dict(zip([h.lower() for h in HEADER], BODY))
    del plain["сумма по дебету"]
    assert found == {
        ("grouped", 1, 3): {"дата операции": "01.02.2020", "валюта": "KZT", "сумма": "5", "payer/name": "А", "payer/iin_bin": "12", "receiver/name": "Б", "receiver/account": "KZ1", "назначение платежа": "x"},
        ("two", 1, 1): plain,
        ("two", 2, 21): {"назначение платежа": "y", "дата операции": "02.02.2020", "валюта операции": "USD"},
    }


def test_dealt_cells_are_not_shuffled(spark):
    cells = _cells(spark, _files())
    dealt = sheets.deal(cells)
    out = sheets.block_rows(dealt, dealt=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dealt_" in plan and "Exchange" not in plan and "Join" not in plan
    assert _found(out) == _found(sheets.block_rows(cells))


def test_layouts_read_files_that_are_left(spark, monkeypatch):
    seen, block_rows = [], sheets.block_rows

    def counted(cells, *args, **kwargs):
        seen.append({r[0] for r in cells.select("file_id").distinct().collect()})
        return block_rows(cells, *args, **kwargs)

    monkeypatch.setattr(sheets, "block_rows", counted)
    found = {(r["file_id"], r["layout"]) for r in sheets.by_layout(_cells(spark, _files())).collect()}
    assert ("two", "kaspi") in found and ("garbled", "halyk") in found and len({f for f, _ in found}) == len(found)
    assert seen[0] == {*_files()} and "two" not in seen[1] and seen[2] == {*_files()} - {f for f, layout in found if layout != "universal"}


def test_columns_are_looked_up_once_a_row(spark):
    """Filters on canonical columns name them some hundred times; rows are not searched for headers for each."""
    found = spark.createDataFrame([("f", "s", 1, 2, {"дата": "2", "дата операции": "1", "счет плательщика": "KZ1", "x": "y", "сумма": None})], "file_id string, sheet string, block_id int, row_no int, row map<string,string>")
    out = sheets.to_ledger(sheets.canonical(found), "p", "b")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_entries(row#") == 1 and "element_at(row#" not in plan
    row = sheets.canonical(found).first()
    assert (row["operation_ts"], row["payer_account"], row["amount_currency"], row["ext"]) == ("1", "KZ1", None, {"x": "y"})


@pytest.mark.parametrize("line", [["Ито\"го", "5"], ["Входящий", "остаток"], ["", None], ["nan", "—"], ["1", "2", "nan", "3"], ["1", "2"], ["a1", "2", "3"], ["начальный ", " баланс"], ["сальдо:1", "z"], ["Перевод", "N/A"], ["finance", "x"], ["итоговая сумма"], ["«»"], ["'", "\""]])
def test_service_rows_as_by_normal_forms(spark, line):
    df = spark.createDataFrame([[*line, None, None, None, None][:4]], "a string, b string, c string, d string")
    joined = F.trim(F.concat_ws(" ", *(F.nullif(text.norm_text(F.col(c)), F.lit("")) for c in "abcd")))
    whole = (joined == "") | joined.rlike("|".join(text.SERVICE_WORDS)) | joined.rlike(r"^(\d+\s*){3,}$")
    fast, slow = df.select(text.is_service_row(*(F.col(c) for c in "abcd")), whole).first()
    assert fast == slow


def test_every_service_word_holds_a_mark():
    assert all(any(m in w for m in text.SERVICE_MARKS) or w.startswith("итого") for w in text.SERVICE_WORDS)


def test_filled_cells_are_those_with_a_normal_form(spark):
    values = ["a", "-", "—", " ", " ", "nan", " N/A ", "“”", "/", ":", "1", "- -", " - \"", "<na>", "№", "٣"]
    cells = spark.createDataFrame([("f", "s", i, 0, v) for i, v in enumerate(values)], "file_id string, sheet string, row_no int, col_no int, value string")
    filled = {r["row_no"]: r["filled"] for r in sheets.lines(cells).collect()}
    norms = {r["row_no"]: int(r["n"] != "") for r in cells.select("row_no", text.norm_text(F.col("value")).alias("n")).collect()}
    assert filled == norms


def test_footers_of_dealt_cells_store_named_rows_alone(spark, monkeypatch):
    lines = {i: [f"x{i}", "7"] for i in range(40)} | {40: ["Итого по кредиту", None, "12,5"], 41: ["Входящий", "остаток", "3"]}
    cells, stored, cut = _cells(spark, {"a": lines, "b": lines}), [], sheets.cut

    def counted(df):
        stored.append((df._jdf.queryExecution().executedPlan().toString(), cut(df)))
        return stored[-1][1]

    monkeypatch.setattr(sheets, "cut", counted)
    found = {(r["file_id"], r["field"], r["value"], r["row_no"]) for r in sheets.footers(sheets.deal(cells)).collect()}
    assert {("a", "total_credit", 12.5, 40), ("b", "total_credit", 12.5, 40)} <= found
    ((plan, rows),) = stored
    assert "dealt_" in plan and "Exchange" not in plan and rows.count() == 2 * 5


def test_plain_texts_end_without_line_breaks(spark):
    df = spark.createDataFrame([("abc\n",), ("abc",), ("a  b",), ("a\nb",)], "x string")
    assert [r[0] for r in df.select(text.norm_text(F.col("x"))).collect()] == ["abc", "abc", "a b", "a b"]
