"""Rules by their literals against all patterns in turn, and the token-set ratio against a plain version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sarraf.operators import classify, rules

SEP = [" ", "  ", "\t", " ", " \n "]


def made(parts, r):
    """A text that matches parsed parts of a pattern."""
    out = ""
    for op, arg in parts:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "ANY":
            out += r.choice("ау1 -")
        elif op == "IN":
            kind, value = r.choice(arg)
            out += {"LITERAL": lambda: chr(value), "CATEGORY": lambda: r.choice(SEP) if str(value).endswith("SPACE") else r.choice("аяz7_") if str(value).endswith("WORD") else "5"}[str(kind)]()  # noqa: B023
        elif op == "BRANCH":
            out += made(r.choice(arg[1]), r)
        elif op == "SUBPATTERN":
            out += made(arg[-1], r)
        elif op == "MAX_REPEAT":
            out += "".join(made(arg[2], r) for _ in range(r.randint(arg[0], min(int(arg[1]), arg[0] + 3))))
        else:
            assert op == "AT", op
    return out


def test_rules_by_literals_are_the_rules(spark):
    r = random.Random(7)
    texts = ["", "İİ", "cash", "pİn-up", "ſalary", "ſpaſalaryſ", "ſALARY", "ᲁепᲂзиᲄ", "догᲂᲀᲂр №", "ᲃубсидия", "retaıl", "RETAİL", "\u212aaspi.kz", "Kase", "Kaspi.KZ", "ндс"]
    for _, _, _, pattern in rules.RULES:
        parsed = re._parser.parse(pattern)
        for _ in range(25):
            t = made(parsed, r)
            texts += [t, t.upper(), f"оплата № {t}, ещё", "".join(c.upper() if r.random() < 0.5 else c for c in t), f"x{t}y", t[1:]]
    texts += [f"{r.choice(texts)} {r.choice(texts)}" for _ in range(500)]
    ordered, _ = classify.rule_index()
    plain = F.lit("DEFAULT_OTHER")
    for rule_id, _, _, pattern in reversed(ordered):
        plain = F.when(F.col("t").rlike(classify.rx(pattern)), rule_id).otherwise(plain)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("c", classify.rule_candidates(F.col("t")))
    got = rows.select("t", classify.rule_of(classify.rule_place(F.col("t"), F.col("c")))["rule_id"].alias("got"), plain.alias("want"), F.bit_count("c").alias("tried")).collect()
    assert [x for x in got if x["got"] != x["want"]] == []
    hidden = {"STORE_03"}  # what it matches has a word of STORE_01, which comes before
    assert {x[0] for x in rules.RULES} - {x["got"] for x in got} <= hidden
    assert sum(x["tried"] for x in got) / len(got) < 8  # of 56


def test_literals_are_held_by_every_match():
    assert classify.required(r"договор\s*[№#N]") == {"договор"}
    assert classify.required(r"(a+bc|de?fg)x*") == {"bc", "fg"}
    assert classify.required(r"\w+") is None and classify.required(r"(abc|\d)") is None
    _, index = classify.rule_index()
    assert not [(a, b) for a in index for b in index if a != b and a.startswith(b)]


def test_a_payment_without_texts_and_a_null_code(spark):
    rows = [(1, None, None, None), (2, "", "", ""), (3, None, "алименты", None), (4, "через Recycler", None, "алименты"), (5, None, None, "atm"), (6, None, "алименты", "")]
    df = spark.createDataFrame(rows, "tx_id int, purpose_text string, operation_type_raw string, purpose_code string")
    got = {x["tx_id"]: x["category_rule_id"] for x in classify.classify_rules(df).collect()}
    assert got == {1: "DEFAULT_OTHER", 2: "DEFAULT_OTHER", 3: "ALIMONY_01", 4: "CASH_TOPUP_DIRECT", 5: "CASH_01", 6: "ALIMONY_01"}
    assert classify.classify_rules(df).columns[:4] == df.columns and classify.classify_rules(df.limit(0)).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, p, q = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (p and q):
        return 100.0
    one, two = (" ".join(filter(None, (both, s))) for s in (p, q))
    same = lambda s, t, d: 100 - 100 * d / (len(s) + len(t))
    found = [same(one, two, len(p) + len(q) - 2 * lcs(p, q))]
    if both:
        found += [same(both, s, len(s) - len(both)) for s in (one, two)]
    return max(found)


HEADERS = [*rules.HEADERS, "", "дата дата", "сумма операции", "назначенне платежа", "наименование/фио плательщика банк", "платежа код назначения", "валютa операции", "резидентство плательщикa", "😀 дата", "счетполучателя", "сумма в валюте её проведения по кредитам", "x" * 70 + " дата", "y" + "x" * 69, "аааааааааааааб", "aaaaaaaaaaaaa"]


def test_token_set_ratio_on_all_pairs_of_headers(spark):
    r = random.Random(3)
    more = ["".join(r.choice("абв ") for _ in range(r.randrange(140))) for _ in range(30)]
    pairs = [(a, b) for a in HEADERS for b in HEADERS] + [(a, b) for a in more for b in more]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", classify.token_set_ratio(F.col("a"), F.col("b")).alias("s")).collect()
    assert max(abs(x["s"] - ratio(x["a"], x["b"])) for x in got) < 1e-9


def test_lcs_beyond_one_number(spark):
    r = random.Random(5)
    pairs = [("".join(r.choice("abc") for _ in range(n)), "".join(r.choice("abcd") for _ in range(m))) for n in (0, 1, 61, 62, 63, 124, 125, 200) for m in (0, 1, 70, 150)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", classify.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(x["n"] == lcs(x["a"], x["b"]) for x in got)


def test_candidates_lose_no_header(spark):
    r, asked = random.Random(11), list(HEADERS)
    for h in list(rules.HEADERS) * 6:
        at = r.randrange(len(h))
        asked.append(r.choice([h[:at] + h[at + 1 :], h[:at] + "ъ" + h[at:], h[:at] + "ъ" + h[at + 1 :], h.replace(" ", ""), " ".join(reversed(h.split()))]))
    df = spark.createDataFrame([(h,) for h in asked], "header string")
    norm = {x["header"]: x["n"] for x in df.select("header", classify.norm_text(F.col("header")).alias("n")).collect()}
    want = {}
    for h, n in norm.items():
        if n in rules.HEADERS:
            want[h] = (rules.HEADERS[n], "exact")
            continue
        best, field = 0, None
        for k, v in rules.HEADERS.items():
            if (s := ratio(n, k)) > best:
                best, field = s, v
        if best >= 92:
            want[h] = (field, "fuzzy")
    assert {x["header"]: (x["canonical"], x["method"]) for x in classify.map_headers(df).collect()} == want
    assert any(m == "fuzzy" and not set(norm[h].split()) & set(" ".join(rules.HEADERS).split()) for h, (_, m) in want.items())  # by pairs of characters alone
    with pytest.raises(ValueError):
        classify.map_headers(df, fuzzy=80)
