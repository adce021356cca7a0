"""Footers and lines of large sheets."""

from sarraf.operators import sheets


def test_every_footer_label_holds_a_word_that_marks_rows():
    assert all(any(w in label for w in sheets.FOOTER_WORDS) for names in sheets.FOOTER_LABELS.values() for label in names)


def test_lines_with_numbers_beyond_a_long(spark):
    heads = ["Дата операции", "Валюта операции", "Сумма по кредиту", "Сумма по дебету", "ИИН/БИН плательщика", "Назначение платежа"]
    body = [str(10**24 + i) for i in range(6)]
    cells = [("f", "s", r, c, v) for r, line in enumerate((heads, body)) for c, v in enumerate(line)]
    df = spark.createDataFrame(cells, "file_id string, sheet string, row_no int, col_no int, value string")
    found = {r["row_no"]: (r["is_header"], r["is_index"], r["filled"]) for r in sheets.rows(df).collect()}
    assert found == {0: (True, False, 6), 1: (False, False, 6)}
    assert [sorted(r["row"].values()) for r in sheets.block_rows(df).collect()] == [body]
