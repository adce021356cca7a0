"""Metadata above a block by each bank's rules, against the rules read row by row."""

import random
import re

import pytest

from sarraf.operators import sheets
from sarraf.plans.fixtures import CELL_HEADERS
from sarraf.sources import readers

LABELS = ["Клиент", "Клиент:", "ИИН/БИН", "БИН:", "Период", "Счет", "Тип счета", "Валюта счета:", "Дата выписки", "Входящий остаток", "Исходящий остаток:", "Валюта контракта: USD", "Contract # KZ1234567890AB", "Имя: Анна: да", "пусто:", ":"]
VALUES = [None, None, None, "-", "''", "900101300123", "ТОО Ромашка", "KZ12 3456 7890 1234 5678", "KZT", "1 000,50", "a:b"]


def norm(v):
    v = re.sub(r"\s+", " ", (v or "").strip().lower())
    v = re.sub(r"\s*([/:])\s*", r"\1", re.sub("[“”\"']", "", v))
    return v.strip(" -—")


def clean(v):
    v = (v or "").strip()
    return None if v in ("", "'", '"', "-", "—", "–", "''", '""') else v


def plain(grid, head, bank, lookback):
    pairs = {}

    def push(k, v):
        if norm(k) and clean(v) is not None:
            pairs[norm(k)] = clean(v)

    above = grid[max(0, head - lookback) : head]
    for i, row in enumerate(above):
        row = row[: 10 if bank == "kaspi" else 14]
        text = " | ".join(c.strip() for c in row if c and c.strip())
        account = re.search(r"\bKZ[A-Z0-9]{8,32}\b", re.sub(r"\s+", "", text.upper()))
        account = account[0] if account and len(account[0]) >= 20 and "contract" not in text.lower() else None
        tax = re.search(r"\b\d{12}\b", text)
        if bank == "kaspi":
            below = above[i + 1][0] if i + 1 < len(above) else None
            label, value = norm(clean(row[0])), clean(row[2]) or clean(row[1]) or clean(below)
            rules = [("клиент", label == "клиент"), ("иин/бин", "иин" in label or "бин" in label), ("period", label.startswith("период")), ("iban", "счет" in label and "валюта" not in label and "тип" not in label), ("currency", "валюта счета" in label), ("account_type", "тип счета" in label), ("statement_date", "дата выписки" in label), ("opening_balance", "входящий остаток" in label), ("closing_balance", "исходящий остаток" in label)]
            for k, hit in rules:
                if hit:
                    push(k, value)
                    break
            if account and "iban" not in pairs:
                push("iban", account)
            if tax and "иин/бин" not in pairs:
                push("иин/бин", tax[0])
            continue
        for c in row:
            if c and ":" in c:
                push(*c.strip().split(":", 1))
        if bank == "halyk":
            if tax and re.search("иин|бин", text.lower()):
                push("иин/бин", tax[0])
                push("клиент", clean(row[1]))
            if m := re.search(r"\bCONTRACT\s*#?\s*(KZ[0-9A-Z]{10,40})\b", text, re.I):
                push("contract #", m[1])
            if "валюта контракта" in text.lower() and (m := re.search(r"\b(KZT|USD|EUR|RUB|CNY)\b", text.upper())):
                push("валюта контракта", m[1])
            if account and "iban" not in pairs:
                push("iban", account)
        for j, c in enumerate(row):
            if c and c.strip().endswith(":"):
                push(c.strip().strip(" :"), next((clean(v) for v in row[j + 1 : j + 6] if clean(v)), None))
        if not bank:
            for c in row:
                if c and (m := re.search(r"\bKZ[A-Z0-9]{8,32}\b", re.sub(r"\s+", "", c.upper()))):
                    push("iban", m[0])
    return pairs


@pytest.mark.parametrize("bank", ["kaspi", "halyk", ""])
def test_against_the_rules(spark, bank):
    r, cells, want = random.Random(bank + "3"), [], {}
    for f in range(40):
        head = r.choice([1, 5, 12, 90])
        grid = [[r.choice(LABELS) if r.random() < (0.6 if j == 0 else 0.1) else r.choice(VALUES) for j in range(16)] if r.random() < 0.7 else [None] * 16 for _ in range(head)]
        want[f"f{f}"] = plain(grid, head, bank, 80)
        grid += [[h for h, _ in CELL_HEADERS], ["01.02.2024", *["x"] * 11]]
        cells += [(f"f{f}", "s", i, j, v) for i, row in enumerate(grid) for j, v in enumerate(row) if v is not None]
    got = {}
    found = sheets.bank_metadata(spark.createDataFrame(cells, readers.CELLS).repartition(4), bank).collect()
    last = {x["file_id"]: max(y["block_id"] for y in found if y["file_id"] == x["file_id"]) for x in found}
    for x in found:
        if x["block_id"] == last[x["file_id"]]:  # a row of many labels may look like a header too
            got.setdefault(x["file_id"], {})[x["key"]] = x["value"]
    assert not {f: (got.get(f, {}).items() ^ p.items()) for f, p in want.items() if got.get(f, {}) != p}
    assert sum(map(len, got.values())) > 60
