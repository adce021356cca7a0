"""Files of any encoding, files that cannot be read, invoices with many further columns, owners of sheets."""

from sarraf.operators import sheets
from sarraf.sources import readers


def test_encodings(spark):
    text = "Дата;Сумма\n01.02.2024;«1 000,50» № 7\nİstanbul ё"
    cyrillic = "Дата;Сумма\n01.02.2024;№ 7"
    cases = [(text, text.encode(e)) for e in ("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be")] + [(cyrillic, cyrillic.encode("cp1251")), ("a b c ", b"a b c "), ("Привет", "Привет".encode("utf-16-le")), ("Привет", "Привет".encode("utf-16-be")), ("", b"")]
    df = spark.createDataFrame([(i, bytes(b)) for i, (_, b) in enumerate(cases)], "i int, b binary")
    got = [r["t"] for r in df.select("i", readers.decode_text(df["b"]).alias("t")).orderBy("i").collect()]
    assert got == [t for t, _ in cases]


def test_one_broken_file_keeps_no_other_from_being_read(spark, tmp_path):
    for bank in ("kaspi", "halyk"):
        (tmp_path / bank).mkdir()
    (tmp_path / "kaspi" / "a.csv").write_text('Дата;Сумма\n01.02.2024;"5;0"\n\n02.02.2024;"two\nlines"\n', encoding="utf-8")
    (tmp_path / "kaspi" / "b.csv").write_bytes("Дата\tСумма\n03.02.2024\t7\n".encode("utf-16-le"))
    (tmp_path / "halyk" / "bad.csv").write_bytes(b'a;b\nc;"d"e\n')
    (tmp_path / "halyk" / "zip.csv").write_bytes(b"PK\x03\x04\x00\x00\xff\xfe")
    (tmp_path / "halyk" / "empty.csv").write_bytes(b"\n \n")
    cells, rejects = readers.read_statements(spark, str(tmp_path))
    got = {(r["file_id"].rsplit("/", 1)[1], r["row_no"], r["col_no"]): r["value"] for r in cells.collect()}
    assert got == {("a.csv", 0, 0): "Дата", ("a.csv", 0, 1): "Сумма", ("a.csv", 1, 0): "01.02.2024", ("a.csv", 1, 1): "5;0", ("a.csv", 3, 0): "02.02.2024", ("a.csv", 3, 1): "two\nlines", ("b.csv", 0, 0): "Дата", ("b.csv", 0, 1): "Сумма", ("b.csv", 1, 0): "03.02.2024", ("b.csv", 1, 1): "7"}
    assert {r["file_id"].rsplit("/", 1)[1]: r["reason"].split(":")[0] for r in rejects.collect()} == {"bad.csv": "row 2", "zip.csv": "not a text", "empty.csv": "empty"}
    assert {tuple(r) for r in readers.read_counts(cells, rejects).collect()} == {("kaspi", 2, 0, 5), ("halyk", 0, 3, 0)}


def test_a_large_file_is_read_in_chunks():
    import tracemalloc

    import pyarrow as pa

    def peak(n):
        text = "Дата;Сумма;Назначение\n" + "01.02.2024;5,00;Оплата\n" * n
        batch = pa.RecordBatch.from_pydict({"file_id": ["f"], "source_bank": ["b"], "text": [text]})
        tracemalloc.start()
        cells = sum(b.num_rows for b in readers._parsed([batch]))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert cells == 3 * (n + 1)
        return most

    assert peak(60_000) < peak(20_000) + 5_000_000  # the text itself, but no more cells


def test_all_further_columns_of_invoices_are_kept(spark, tmp_path):
    n = len(readers.INVOICE_COLUMNS)
    head = ["Регистрационный номер ЭСФ", "Код", "Статус ЭСФ", *map(str, range(n - 3 + 40))]
    rows = [[f"ESF-{i}", *[""] * (n - 1), *(f"x{j}" if j % 2 else "" for j in range(40))] for i in range(3)] + [["ESF-9", "short"]]
    (tmp_path / "i.csv").write_text("\n".join(";".join(r) for r in [["Отчёт"], head, *rows]), encoding="utf-8")
    got = {r["registration_number"]: r["extra"] for r in readers.read_invoice_csv(spark, str(tmp_path / "i.csv")).collect()}
    assert got["ESF-0"] == {f"extra_{j + 1}": f"x{j}" for j in range(40) if j % 2} and got["ESF-9"] == {}


def test_owners_of_sheets(spark):
    """Against the rule read row by row."""
    import random
    import re

    def plain(rows):
        name = iin = account = ""
        for row in rows[:40]:
            label = (row[0] or "").strip().lower().replace("ё", "е")
            value = next((v.strip() for v in row[1:4] if v and v.strip()), "")
            if not label or not value:
                continue
            if "клиент" in label and not name:
                name = value.strip('"').strip("'")
            elif ("иин" in label or "бин" in label) and not iin:
                flat = value.replace(" ", "")
                iin = (str(round(float(flat.replace(",", ".")))) if re.fullmatch(r"[\d.,]+[eE][+-]?\d+", flat) else "".join(c for c in flat if c.isdigit()))[:12]
            elif "счет" in label and not account:
                account = value
        return name, iin, account

    r = random.Random(6)
    labels = ["Клиент", "ИИН/БИН:", "БИН клиента", "Счёт:", "Номер счета клиента", "Дата", None, " ", "иин счета"]
    values = [None, None, "", '"ТОО"', "'", '""', "900101 300123", "8.6E+11", "KZ1", "нет"]
    made = {f"f{k}": [[r.choice(labels), *(r.choice(values) for _ in range(4))] for _ in range(r.choice([2, 6, 45]))] for k in range(60)}
    made["late"] = [[None] * 5] * 40 + [["Клиент", "поздно", None, None, None]]
    cells = [(f, "s", i, j, v) for f, rows in made.items() for i, row in enumerate(rows) for j, v in enumerate(row) if v is not None or j == 4]
    got = {x["file_id"]: (x["name"], x["iin_bin"], x["account"]) for x in sheets.owner_fallback(spark.createDataFrame(cells, readers.CELLS).repartition(4)).collect()}
    assert got == {f: plain(rows) for f, rows in made.items()}
    assert len({x for x in got.values()}) > 10
