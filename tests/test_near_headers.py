"""Metadata above headers is found from the rows near headers alone, and is the same as from all rows."""

from sarraf.operators import sheets

HEADER = ["Дата операции", "Валюта", "Сумма", "Наз'начение", "Плательщик", "ИИН/БИН", "Номер", "счета"]


def _sheets():
    rows = {}
    # A header at 40, a second one at 300, and dates with colons in all rows.
    rows["a"] = {2: ["Клиент: А"], 35: ["ИИН:", "123"], 40: HEADER, 41: ["01.02.2020 10:00:00"] * 8, 280: ["Клиент: Б"], 300: HEADER} | {i: ["01.02.2020 10:00:00", "KZT"] for i in (50, 90, 150, 200)}
    # A grouped header right above its second row 60 rows on, and one that a line parts from the next header.
    rows["b"] = {0: ["Клиент: В"], 3: ["Плательщик", "Получатель"], 63: HEADER, 70: ["Счет: 5"]}
    rows["c"] = {0: ["Клиент: Г"], 3: ["Плательщик", "Получатель"], 50: ["x: y"], 120: HEADER, 121: ["1"]}
    # Keywords that go on in the next cell, too few keywords, and too few cells.
    rows["d"] = {1: ["Период: 1"], 5: ["код", "назначения", "виды", "операции", "категория", "-", "7"], 9: ["дата", "сумма"] + ["x"] * 5, 12: ["дата валюта сумма"]}
    return [(f, "S", r, c, v) for f, lines in rows.items() for r, line in lines.items() for c, v in enumerate(line)]


def test_rows_far_from_headers_are_not_gathered(spark, monkeypatch):
    cells = spark.createDataFrame(_sheets(), "file_id string, sheet string, row_no int, col_no int, value string").cache()
    gathered, lines = [], sheets.lines

    def counted(c):
        gathered.append(c.select("row_no").distinct().count())
        return lines(c)

    monkeypatch.setattr(sheets, "lines", counted)
    near = {name: sorted(map(tuple, f(cells).collect()), key=str) for name, f in (("pairs", sheets.metadata), ("kaspi", lambda c: sheets.bank_metadata(c, "kaspi")), ("", sheets.bank_metadata))}
    many = cells.unionByName(spark.range(400, 5000).selectExpr("'a' AS file_id", "'S' AS sheet", "int(id) AS row_no", "0 AS col_no", "'10:00' AS value"))
    assert sorted(map(tuple, sheets.metadata(many).collect()), key=str) == near["pairs"]
    assert gathered[-1] < 400
    monkeypatch.setattr(sheets, "near_headers", lambda c, *_: c)
    assert sorted(map(tuple, sheets.metadata(cells).collect()), key=str) == near["pairs"]
    assert sorted(map(tuple, sheets.bank_metadata(cells, "kaspi").collect()), key=str) == near["kaspi"]
    assert sorted(map(tuple, sheets.bank_metadata(cells).collect()), key=str) == near[""]
    assert {r[2] for r in near["pairs"]} >= {1, 2} and len(near["pairs"]) == 5
