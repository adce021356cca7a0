"""Reconciliation by sums of tokens against the plain double loop."""

import random
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from sarraf.operators import invoices

PAY = "tx_id string, project_id string, source_bank string, purpose_text string, raw_note string, operation_type_raw string, amount_credit decimal(18,2), amount_debit decimal(18,2), amount_kzt decimal(18,2), operation_ts timestamp, operation_date date, direction string"
BILL = "project_id string, registration_number string, contract_number string, row_hash string, total_amount decimal(18,2), buyer_name string, supplier_name string, buyer_iin_bin string, supplier_iin_bin string"


def made(spark, seed):
    r = random.Random(seed)
    token = lambda: f"ESF-{r.randrange(6)}" if r.random() < 0.5 else f"D-{r.randrange(4)}00"
    pay, bill = [], []
    for i in range(150):
        named = [token() for _ in range(r.choice([0, 1, 1, 2, 3, 5]))]
        text = " ".join(t if t.startswith("ESF") else f"№ {t}" for t in named)
        pay.append((f"t{i}", r.choice("pq"), r.choice(["kaspi", "kaspi", "esf"]), text, None, None, Decimal(r.randrange(500)), Decimal(0), None if i % 7 == 0 else Decimal(r.randrange(500)), None, None, "credit"))
    for i in range(60):
        bill.append((r.choice("pq"), r.choice([token(), None, ""]), r.choice([token(), token(), None, " d-100 "]), f"h{i % 50}", Decimal(r.randrange(3000)), r.choice(["Buyer", "", None]), "Seller", r.choice(["900101300123", "12", None]), "7 777"))
    return pay, bill


def plain(pay, bill):
    import re

    refs = lambda t: {x.upper() for x in re.findall(r"№\s*([A-ZА-Я0-9/_-]{3,})", t.upper()) + re.findall(r"(ESF[-A-Z0-9_]+)", t.upper())}
    norm = lambda v: re.sub(r"[\"'\s]", "", (v or "").upper())
    out = []
    for p, reg, con, h, due, *_ in bill:
        own = {norm(reg), norm(con)} - {""}
        hit = [x for x in pay if x[1] == p and x[2] != "esf" and refs(x[3]) & own]
        if own and hit:
            total = sum(max(x[6] or 0, x[7] or 0, x[8] or 0) for x in hit)
            if abs(due - total) >= 1:
                best = sorted(hit, key=lambda x: (-max(x[6] or 0, x[7] or 0, x[8] or 0), x[0]))[:8]
                out.append((p, reg, con, h, float(due), float(total), len(hit), float(due - total), [x[0] for x in best]))
    return out


def test_sums_of_tokens_are_the_double_loop(spark):
    for seed in range(3):
        pay, bill = made(spark, seed)
        df, inv = spark.createDataFrame(pay, PAY).repartition(3), spark.createDataFrame(bill, BILL).repartition(2)
        want = plain(pay, bill)
        got = [tuple(x) for x in invoices.reconcile(df, inv).collect()]
        assert sorted(map(str, got)) == sorted(str(x[:8]) for x in want) and len(want) > 20
        rows = defaultdict(list)
        for x in invoices.mismatch_rows(df, inv).orderBy("rank").collect():
            rows[x["project_id"], x["registration_number"], x["contract_number"], x["row_hash"]].append(x["tx_id"])
        assert rows == {x[:4]: x[8] for x in want}
        parties = invoices.mismatch_parties(df, inv).collect()
        assert len(parties) == len(want) and {x["name"] for x in parties} == {"Buyer", "Seller"}


def test_one_contract_of_all_invoices_and_payments(spark):
    """Rows of every join stay in proportion, though each invoice matches each payment."""
    n = 3000
    pay = spark.range(n).select(F.concat(F.lit("t"), "id").alias("tx_id"), F.lit("p").alias("project_id"), F.lit("kaspi").alias("source_bank"), F.concat(F.lit("№ D-1 ESF-"), "id").alias("purpose_text"), *(F.lit(None).cast("string").alias(c) for c in ("raw_note", "operation_type_raw")), *(F.lit(1).cast("decimal(18,2)").alias(c) for c in ("amount_credit", "amount_debit", "amount_kzt")))
    inv = spark.range(n).select(F.lit("p").alias("project_id"), F.concat(F.lit("ESF-"), "id").alias("registration_number"), F.lit("D-1").alias("contract_number"), F.col("id").cast("string").alias("row_hash"), F.lit(5).cast("decimal(18,2)").alias("total_amount"))
    single, by_token = invoices._paid_by_token(pay)
    assert (single.count(), by_token.count()) == (2 * n, n + 1)
    both = invoices._paid_by_both(single, invoices._two_tokens(inv))
    assert both.count() == n and both.agg(F.sum("payments")).first()[0] == n
    got = invoices.reconcile(pay, inv)
    assert got.count() == n and {(x["payments"], x["paid_total"]) for x in got.collect()} == {(n, float(n))}
