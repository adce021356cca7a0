"""Registered queries over the benchmark tables, one for each operator family, with their SQL where SQL can say it."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, ids, numbers, parties, text
from ..operators import analytics, classify, detectors, evidence, filters, graph, invoices, sheets, vectors
from ..sources import readers, sinks
from ..streaming import streams
from . import fixtures, runtime
from .fixtures import EVENTS_SQL, INVOICES_SQL, LEDGER_SQL, embeddings, ledger, payments
from .fixtures import invoices as invoice_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}

# --- what the SQL of several queries shares -------------------------------------------------------------
_L = f"WITH ledger AS ({LEDGER_SQL})"
_I = f"WITH invoices AS ({INVOICES_SQL})"
_BAD = "('nan', 'none', 'null', 'nat', '<na>', 'n/a')"
_TS = "coalesce(operation_ts, CAST(operation_date AS TIMESTAMP))"


def _unknown(n: str) -> str:
    return f"({n} IS NULL OR trim({n}) = '' OR lower(trim({n})) IN {_BAD} OR upper(trim({n})) = 'UNKNOWN')"


def _shown(n: str = "name", a: str = "account") -> str:
    return f"CASE WHEN {_unknown(n)} THEN trim({a}) ELSE trim({n}) END"


def _key(order: str, n: str = "name", i: str = "iin_bin", a: str = "account") -> str:
    by_id = f"CASE WHEN trim(coalesce({i}, '')) NOT IN ('', '0', '000000000000') THEN concat('iin:', upper({i})) END"
    by_name = f"CASE WHEN NOT {_unknown(n)} THEN concat('name:', lower(trim({n}))) END"
    by_acc = f"CASE WHEN coalesce({a}, '') <> '' THEN concat('acc:', upper({a})) END"
    if order == "fraud":
        return f"coalesce(CASE WHEN regexp_replace(coalesce({i}, ''), '[^0-9]', '', 'g') <> '' THEN concat('iin:', regexp_replace({i}, '[^0-9]', '', 'g')) END, {by_acc}, CASE WHEN trim(coalesce({n}, '')) <> '' THEN concat('name:', lower(trim({n}))) END)"
    return f"coalesce({by_id}, {by_name}, {by_acc})" if order == "name" else f"coalesce({by_id}, {by_acc}, {by_name})"


_SIDES = "sides AS (" + " UNION ALL ".join(f"SELECT *, '{s}' AS side, {s}_name AS name, {s}_iin_bin AS iin_bin, {s}_account AS account FROM ledger" for s in ("payer", "receiver")) + ")"
_PARTY = f"substring(max(concat(lpad(CAST(length({_shown()}) AS VARCHAR), 6, '0'), {_shown()})), 7) AS name, max(CASE WHEN trim(coalesce(iin_bin, '')) NOT IN ('', '0', '000000000000') THEN iin_bin END) AS iin_bin, max(account) AS account"
_CATEGORY = """CASE WHEN lower(purpose_text) LIKE '%red.kz%' OR lower(purpose_text) LIKE '%продаж%' THEN 'Продажи Kaspi / Red' WHEN lower(purpose_text) LIKE '%погаш%' OR lower(purpose_text) LIKE '%кредит%' THEN 'Погашение кредита'
  WHEN lower(purpose_text) LIKE '%снятие%' OR lower(purpose_text) LIKE '%cash%' OR lower(purpose_text) LIKE '%atm%' THEN 'Снятие наличных' WHEN lower(purpose_text) LIKE '%пополн%' THEN 'Пополнение счёта'
  WHEN lower(purpose_text) LIKE '%перевод%' AND lower(purpose_text) LIKE '%внутр%' THEN 'Внутренние операции' WHEN lower(purpose_text) LIKE '%перевод%' OR lower(operation_type_raw) LIKE '%payment%' THEN 'P2P перевод'
  WHEN lower(purpose_text) LIKE '%оплат%' THEN 'Оплата услуг' WHEN direction = 'credit' THEN 'Поступления' WHEN direction = 'debit' THEN 'Расходы' ELSE 'Прочее' END"""
_CASH_OUT = "(lower(purpose_text) LIKE '%cash%' OR lower(purpose_text) LIKE '%atm%' OR purpose_text LIKE '%налич%' OR operation_type_raw LIKE '%исх.док%')"
_MONEY = lambda c: f"coalesce(CAST(sum({c}) AS DOUBLE), CAST(0 AS DOUBLE))"
A_YEAR, B_YEAR = (date(1995, 1, 1), date(1995, 12, 31)), (date(1996, 1, 1), date(1996, 12, 31))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- B: scalar functions ---------------------------------------------------------------------------------
@query(f"""{_L} SELECT tx_id, {_shown("payer_name", "payer_account")} AS sender, {_key("name", "payer_name", "payer_iin_bin", "payer_account")} AS key_name, {_key("account", "payer_name", "payer_iin_bin", "payer_account")} AS key_account,
  {_key("fraud", "payer_name", "payer_iin_bin", "payer_account")} AS key_fraud, {_CATEGORY} AS category, {_TS} AS effective_ts FROM ledger""")
def b_party_keys(spark, d):
    x = ledger(spark, d)
    k = lambda order: parties.counterparty_key(F.col("payer_iin_bin"), F.col("payer_account"), F.col("payer_name"), order)
    return x.select("tx_id", text.display_name(F.col("payer_name"), F.col("payer_account")).alias("sender"), k("name").alias("key_name"), k("account").alias("key_account"), k("fraud").alias("key_fraud"), filters.category_of().alias("category"), filters.effective().alias("effective_ts"))


@query(f"""{_L} SELECT tx_id, CAST(floor(CASE WHEN amount_kzt > 0 THEN CAST(amount_kzt AS DOUBLE) WHEN amount_currency > 0 THEN round(CAST(amount_currency AS DOUBLE) * CASE currency WHEN 'USD' THEN CAST(475.5 AS DOUBLE) WHEN 'EUR' THEN CAST(520.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 2) ELSE CAST(0 AS DOUBLE) END / 1000) AS BIGINT) AS kzt_thousands,
  CAST(amount_debit AS DOUBLE) AS debit, CASE WHEN operation_type_raw LIKE '%дебет%' THEN 'debit' WHEN purpose_text LIKE '%кредит%' THEN 'credit' WHEN lower(purpose_text) LIKE '%перевод card to card%' THEN 'debit'
  WHEN amount_debit <> 0 AND amount_credit = 0 THEN 'debit' WHEN amount_credit <> 0 AND amount_debit = 0 THEN 'credit' END AS derived FROM ledger""")
def b_amounts_and_direction(spark, d):
    c = F.col
    kzt = numbers.resolve_amount_kzt(c("amount_kzt"), c("amount_currency"), c("amount_debit"), c("amount_credit"), c("currency"))
    return ledger(spark, d).select("tx_id", F.floor(kzt / 1000).cast("long").alias("kzt_thousands"), numbers.number(c("amount_debit")).alias("debit"), parties.derive_direction(c("operation_type_raw"), c("purpose_text"), c("amount_debit"), c("amount_credit")).alias("derived"))


@query()
def b_ids(spark, d):
    """Row hashes and version-5 ids; tests hold them against Python's."""
    x = ledger(spark, d).withColumn("row_hash", ids.row_hash(F.col("source_bank"), F.lit(None).cast("string"), F.col("operation_ts"), F.col("amount_currency"), F.coalesce("payer_iin_bin", "payer_name"), F.coalesce("receiver_iin_bin", "receiver_name"), F.col("purpose_text")))
    return x.select("tx_id", "row_hash", ids.tx_id(F.col("project_id"), F.col("row_hash")).alias("uuid"), parties.signature().alias("signature"))


@query(f"""{_L} SELECT tx_id, trim(regexp_replace(regexp_replace(purpose_text, '№\\s*\\S+', ' ', 'g'), '\\s{{2,}}', ' ', 'g')) AS clean,
  CASE WHEN contains(purpose_text, '№') THEN regexp_extract(purpose_text, '№ ([0-9]{{3,}})', 1) ELSE '' END AS token FROM ledger""")
def b_purpose_text(spark, d):
    x = ledger(spark, d)
    return x.select("tx_id", text.clean_purpose(F.col("purpose_text")).alias("clean"), F.coalesce(F.get(text.reference_tokens(F.col("purpose_text")), F.lit(0)), F.lit("")).alias("token"))


# --- C: filters ------------------------------------------------------------------------------------------
@query(f"""{_L} SELECT tx_id, CAST(amount_kzt AS DOUBLE) AS amount_kzt, {_TS} AS ts FROM ledger WHERE project_id = 'ASIA' AND {_TS} >= TIMESTAMP '1995-01-01' AND {_TS} < TIMESTAMP '1997-01-01'
  AND amount_kzt >= 1000 AND currency = 'KZT' AND contains(lower(purpose_text), 'перевод')""")
def c_filtered_ledger(spark, d):
    out = filters.list_filter(filters.meaningful(ledger(spark, d)), project_id="ASIA", date_from=A_YEAR[0], date_to=B_YEAR[1], search="перевод", min_amount=1000, currency="KZT")
    return out.select("tx_id", F.col("amount_kzt").cast("double").alias("amount_kzt"), filters.effective().alias("ts"))


# --- E: aggregations ---------------------------------------------------------------------------------------
@query(f"""{_L} SELECT concat(CASE month({_TS}) WHEN 1 THEN 'Январь' WHEN 2 THEN 'Февраль' WHEN 3 THEN 'Март' WHEN 4 THEN 'Апрель' WHEN 5 THEN 'Май' WHEN 6 THEN 'Июнь' WHEN 7 THEN 'Июль' WHEN 8 THEN 'Август' WHEN 9 THEN 'Сентябрь' WHEN 10 THEN 'Октябрь' WHEN 11 THEN 'Ноябрь' ELSE 'Декабрь' END, ' ', CAST(year({_TS}) AS VARCHAR)) AS label,
  strftime({_TS}, '%Y-%m') AS bucket, {_MONEY("amount_credit")} AS credit, {_MONEY("amount_debit")} AS debit FROM ledger GROUP BY 1, 2""")
def e1_time_series(spark, d):
    return analytics.time_series(ledger(spark, d), "month")


@query(f"{_L} SELECT {_MONEY('amount_credit')} AS total_credit, {_MONEY('amount_debit')} AS total_debit, {_MONEY('amount_credit + amount_debit')} AS total_turnover, count(*) AS total_transactions, min({_TS}) AS period_from, max({_TS}) AS period_to FROM ledger WHERE project_id = 'EUROPE'")
def e2_summary(spark, d):
    return analytics.summary(filters.scoped(ledger(spark, d), "EUROPE"))


_PERIODS = f"y AS (SELECT *, year({_TS}) AS yr FROM ledger WHERE year({_TS}) IN (1995, 1996)), ys AS (" + " UNION ALL ".join(f"SELECT yr, {_key('account', f'{s}_name', f'{s}_iin_bin', f'{s}_account')} AS k FROM y" for s in ("payer", "receiver")) + ")"


@query(f"""{_L}, {_PERIODS}, m AS (
  SELECT 'credit' AS label, {_MONEY("CASE WHEN yr = 1995 THEN amount_credit END")} AS value_a, {_MONEY("CASE WHEN yr = 1996 THEN amount_credit END")} AS value_b FROM y UNION ALL
  SELECT 'debit', {_MONEY("CASE WHEN yr = 1995 THEN amount_debit END")}, {_MONEY("CASE WHEN yr = 1996 THEN amount_debit END")} FROM y UNION ALL
  SELECT 'count', CAST(count(CASE WHEN yr = 1995 THEN 1 END) AS DOUBLE), CAST(count(CASE WHEN yr = 1996 THEN 1 END) AS DOUBLE) FROM y UNION ALL
  SELECT 'parties', CAST(count(DISTINCT CASE WHEN yr = 1995 THEN k END) AS DOUBLE), CAST(count(DISTINCT CASE WHEN yr = 1996 THEN k END) AS DOUBLE) FROM ys)
  SELECT *, round(value_b - value_a, 2) AS absolute, CASE WHEN abs(value_a) < 1e-9 THEN CASE WHEN abs(value_b) < 1e-9 THEN CAST(0 AS DOUBLE) END ELSE round((value_b - value_a) / abs(value_a) * 100, 2) END AS percent FROM m""")
def e3_compare_periods(spark, d):
    return analytics.compare_periods(ledger(spark, d), A_YEAR, B_YEAR)


@query(f"""{_L}, g AS (SELECT {_CATEGORY} AS category, {_MONEY(f"CASE WHEN year({_TS}) = 1995 THEN amount_kzt END")} AS value_a, count(CASE WHEN year({_TS}) = 1995 THEN 1 END) AS transaction_count_a,
  {_MONEY(f"CASE WHEN year({_TS}) = 1996 THEN amount_kzt END")} AS value_b, count(CASE WHEN year({_TS}) = 1996 THEN 1 END) AS transaction_count_b FROM ledger WHERE year({_TS}) IN (1995, 1996) GROUP BY 1)
  SELECT *, round(value_b - value_a, 2) AS delta, CASE WHEN abs(value_a) < 1e-9 THEN CASE WHEN abs(value_b) < 1e-9 THEN CAST(0 AS DOUBLE) END ELSE round((value_b - value_a) / abs(value_a) * 100, 2) END AS delta_percent FROM g""")
def e4_compare_categories(spark, d):
    return analytics.compare_categories(ledger(spark, d), A_YEAR, B_YEAR, 100)


_SPRING, _AUTUMN = (date(1995, 5, 1), date(1995, 6, 30)), (date(1995, 7, 1), date(1995, 12, 31))
_IN = lambda p, x: f"CASE WHEN {_TS} >= TIMESTAMP '{p[0]}' AND {_TS} < TIMESTAMP '{p[1] + timedelta(1)}' THEN {x} END"
_GROWTH = lambda a, b: f"round(({b} - {a}) / abs({a}) * 100, 2)"


@query(f"""{_L}, {_SIDES}, m AS (SELECT CAST(sum({_IN(_SPRING, "amount_debit")}) AS DOUBLE) AS da, CAST(sum({_IN(_AUTUMN, "amount_debit")}) AS DOUBLE) AS db, CAST(count({_IN(_SPRING, "1")}) AS DOUBLE) AS na, CAST(count({_IN(_AUTUMN, "1")}) AS DOUBLE) AS nb FROM ledger),
  u AS (SELECT CAST(count(DISTINCT {_IN(_AUTUMN, _key("account"))}) - count(DISTINCT {_IN(_SPRING, _key("account"))}) AS DOUBLE) AS more FROM sides),
  c AS (SELECT {_CATEGORY} AS category, {_MONEY(_IN(_SPRING, "amount_kzt"))} AS va, {_MONEY(_IN(_AUTUMN, "amount_kzt"))} AS vb FROM ledger GROUP BY 1),
  w AS (SELECT 1 AS rank, 'debit_growth' AS message, {_GROWTH("da", "db")} AS value FROM m WHERE {_GROWTH("da", "db")} >= 50 UNION ALL SELECT 2, 'count_growth', {_GROWTH("na", "nb")} FROM m WHERE {_GROWTH("na", "nb")} >= 30
    UNION ALL SELECT 3, 'more_parties', more FROM u WHERE more >= 5 UNION ALL SELECT 4, 'cash_growth', {_GROWTH("va", "vb")} FROM c WHERE category = 'Снятие наличных' AND {_GROWTH("va", "vb")} >= 100
    UNION ALL (SELECT 5, concat('new_category: ', category), vb FROM c WHERE va <= 0 AND vb > 0 ORDER BY abs(vb - va) DESC, category LIMIT 1)) SELECT message, value FROM w ORDER BY rank LIMIT 4""")
def e5_compare_anomalies(spark, d):
    x = ledger(spark, d)
    return analytics.compare_anomalies(analytics.compare_periods(x, _SPRING, _AUTUMN), analytics.compare_categories(x, _SPRING, _AUTUMN, 100))


@query(f"{_L}, {_SIDES} SELECT count(DISTINCT {_key('account')}) AS unique_counterparties FROM sides")
def e6_unique_counterparties(spark, d):
    return analytics.unique_counterparties(ledger(spark, d))


@query(f"""{_L}, part_rows AS (SELECT payer_name AS name, payer_iin_bin AS iin_bin, payer_account AS account, amount_debit AS amount FROM ledger WHERE amount_debit > 0),
  g AS (SELECT {_key("name")} AS key, {_PARTY}, {_MONEY("amount")} AS amount, count(*) AS transaction_count FROM part_rows GROUP BY 1), t AS (SELECT {_MONEY("amount")} AS total FROM part_rows)
  SELECT g.*, round(amount / total * 100, 2) AS percentage FROM g, t WHERE key IS NOT NULL ORDER BY amount DESC, key LIMIT 25""")
def e7_top_expenses(spark, d):
    return analytics.top_expenses(ledger(spark, d), "debit", 25)


@query(f"""{_L}, {_SIDES} SELECT {_key("name")} AS key, {_PARTY}, {_MONEY("CASE WHEN side = 'receiver' THEN amount_credit END")} AS total_credit, {_MONEY("CASE WHEN side = 'payer' THEN amount_debit END")} AS total_debit,
  {_MONEY("amount_kzt")} AS total_turnover, count(*) AS transaction_count FROM sides GROUP BY 1 HAVING key IS NOT NULL ORDER BY total_turnover DESC, transaction_count DESC, key LIMIT 50""")
def e8_top_counterparties(spark, d):
    return analytics.top_counterparties(ledger(spark, d), 50)


@query(f"""{_L}, {_SIDES} SELECT {_key("account")} AS key, {_PARTY}, {_MONEY("amount_kzt")} AS total_turnover, count(*) AS transaction_count FROM sides
  WHERE contains(lower(name), 'supplier 1') OR contains(iin_bin, 'supplier 1') OR contains(upper(account), 'SUPPLIER1') GROUP BY 1 HAVING key IS NOT NULL ORDER BY total_turnover DESC, transaction_count DESC, key LIMIT 20""")
def e9_counterparty_search(spark, d):
    return analytics.counterparty_search(ledger(spark, d), "supplier 1", 20)


@query(f"{_L} SELECT {_CATEGORY} AS category, count(*) AS transaction_count, {_MONEY('amount_kzt')} AS total_turnover, {_MONEY('amount_debit')} AS total_debit, {_MONEY('amount_credit')} AS total_credit FROM ledger GROUP BY 1")
def e10_category_summary(spark, d):
    return analytics.category_summary(ledger(spark, d))


@query(f"""{_L}, p AS (SELECT payer_name AS name, payer_iin_bin AS iin_bin, payer_account AS account, amount_debit AS amount, {_TS} AS ts FROM ledger WHERE amount_debit > 0 AND {_CASH_OUT}),
  g AS (SELECT {_key("name")} AS key, {_PARTY}, {_MONEY("amount")} AS amount, count(*) AS transaction_count, max(ts) AS last_transaction_date FROM p GROUP BY 1), t AS (SELECT {_MONEY("amount")} AS total FROM p)
  SELECT g.*, round(amount / total * 100, 2) AS percentage FROM g, t WHERE key IS NOT NULL ORDER BY amount DESC, key LIMIT 20""")
def e11_cash_top(spark, d):
    return analytics.cash_top(ledger(spark, d), "withdrawal", 20)


@query(f"{_L} SELECT count(*) AS total, {_MONEY('amount_debit')} AS total_debit, {_MONEY('amount_credit')} AS total_credit FROM ledger WHERE currency = 'USD'")
def e12_list_totals(spark, d):
    return analytics.list_totals(filters.apply_filters(ledger(spark, d), currency="USD"))


@query(f"""{_I} SELECT count(*) AS total_records, {_MONEY("total_amount")} AS total_amount, {_MONEY("vat_amount")} AS total_vat, {_MONEY("CASE WHEN esf_direction = 'sale' THEN total_amount END")} AS sales_amount,
  {_MONEY("CASE WHEN esf_direction = 'purchase' THEN total_amount END")} AS purchase_amount FROM invoices""")
def e13_invoice_totals(spark, d):
    return invoices.invoice_totals(invoice_rows(spark, d))


_YEARS = [1995, 1996, 1997]
_BY_YEAR = ", ".join(f"{_MONEY(f'CASE WHEN year = {y} THEN total_amount END')} AS y{y}" for y in _YEARS)


@query(f"{_I} SELECT buyer_iin_bin, supplier_iin_bin, max(buyer_name) AS buyer_name, max(supplier_name) AS supplier_name, {_MONEY('total_amount')} AS overall_total, {_BY_YEAR} FROM invoices GROUP BY 1, 2")
def e14_invoice_summary(spark, d):
    return invoices.invoice_summary(invoice_rows(spark, d), _YEARS)


@query(f"""{_I} SELECT buyer_iin_bin, supplier_iin_bin, tru_name, CAST(price_with_vat AS DOUBLE) AS price_with_vat, CAST(vat_rate AS DOUBLE) AS vat_rate, unit, currency_code, {_MONEY("quantity")} AS total_quantity, {_MONEY("total_amount")} AS total_amount,
  {", ".join(f"{_MONEY(f'CASE WHEN year = {y} THEN quantity END')} AS q{y}, {_MONEY(f'CASE WHEN year = {y} THEN total_amount END')} AS y{y}" for y in _YEARS)} FROM invoices GROUP BY ALL""")
def e15_invoice_goods(spark, d):
    return invoices.invoice_goods_summary(invoice_rows(spark, d), _YEARS).withColumns({c: F.col(c).cast("double") for c in ("price_with_vat", "vat_rate")})


@query(f"""{_I} SELECT buyer_iin_bin, supplier_iin_bin, {_MONEY("total_amount")} AS overall_total, {_BY_YEAR}, CASE WHEN grouping(buyer_iin_bin) = 1 THEN 'grand_total' WHEN grouping(supplier_iin_bin) = 1 THEN 'subtotal' ELSE 'detail' END AS row_type
  FROM invoices GROUP BY GROUPING SETS ((buyer_iin_bin, supplier_iin_bin), (buyer_iin_bin), ())""")
def e16_invoice_subtotals(spark, d):
    return invoices.with_subtotals(invoice_rows(spark, d), _YEARS)


@query(f"""{_I}, b AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM invoices GROUP BY buyer_iin_bin)), s AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM invoices GROUP BY supplier_iin_bin))
  SELECT b.m AS buyer_max, s.m AS supplier_max, CASE WHEN b.m > s.m THEN 'buyer' ELSE 'supplier' END AS owner_side FROM b, s""")
def e17_owner_side(spark, d):
    return invoices.infer_owner_side(invoice_rows(spark, d))


@query("""WITH n AS (SELECT label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS len FROM embeddings),
  u AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE) / len) AS m, count(*) AS c FROM n, range(1, 65) r(i) WHERE len > 0 GROUP BY 1, 2),
  l AS (SELECT label, sqrt(sum(m * m)) AS len FROM u GROUP BY 1) SELECT u.label, c AS n, i - 1 AS pos, round(m / len, 6) AS x FROM u JOIN l ON u.label = l.label WHERE c >= 5""")
def e18_category_centroids(spark, d):
    return vectors.centroids(embeddings(spark, d)).select("label", "n", F.posexplode("embedding").alias("pos", "x")).select("label", "n", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("""WITH t AS (SELECT DISTINCT label, concat('vec-', vec_id) AS sample FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sample) AS n FROM t), s AS (SELECT label, string_agg(sample, ';' ORDER BY sample) AS samples FROM r WHERE n <= 10 GROUP BY 1)
  SELECT e.label, count(*) AS size, count(*) >= 5 AS has_centroid, any_value(samples) AS samples FROM embeddings e JOIN s ON e.label = s.label GROUP BY 1""")
def e19_category_clusters(spark, d):
    """The centroids are those of e18."""
    named = embeddings(spark, d).withColumn("sample", F.concat(F.lit("vec-"), F.col("vec_id")))
    return vectors.clusters(named, "sample").select("label", "size", F.col("embedding").isNotNull().alias("has_centroid"), F.array_join("samples", ";").alias("samples"))


@query(f"""{_L}, b AS (SELECT tx_id, amount_kzt <= 0 AS bad, project_id, concat(file_id, direction) AS h, row_number() OVER (PARTITION BY amount_kzt <= 0, project_id, concat(file_id, direction) ORDER BY tx_id) AS n FROM ledger),
  e AS (SELECT DISTINCT project_id, concat(file_id, 'credit') AS h FROM ledger), t AS (SELECT b.*, e.h IS NOT NULL AS known FROM b LEFT JOIN e ON b.project_id = e.project_id AND b.h = e.h)
  SELECT count(*) AS total, count(CASE WHEN bad THEN 1 END) AS bad_rows, count(CASE WHEN NOT bad AND n > 1 THEN 1 END) AS duplicates, count(CASE WHEN NOT bad AND n = 1 AND known THEN 1 END) AS existing, count(CASE WHEN NOT bad AND n = 1 AND NOT known THEN 1 END) AS inserted,
  count(CASE WHEN bad THEN 1 END) + count(CASE WHEN NOT bad AND n > 1 THEN 1 END) + count(CASE WHEN NOT bad AND n = 1 AND known THEN 1 END) AS skipped FROM t""")
def e20_import_report(spark, d):
    x = ledger(spark, d)
    batch = x.withColumn("skipped", F.col("amount_kzt") <= 0).withColumn("row_hash", F.concat("file_id", "direction")).withColumn("source_row_no", F.col("tx_id"))
    return sinks.import_report(batch, x.select("project_id", F.concat("file_id", F.lit("credit")).alias("row_hash")))


_COLUMN = lambda c: f"SELECT '{c}' AS \"column\", count({c}) AS count, count(DISTINCT {c}) AS distinct_values, round(avg(CAST({c} AS DOUBLE)), 2) AS mean, CAST(min({c}) AS DOUBLE) AS min, CAST(quantile_cont(CAST({c} AS DOUBLE), 0.5) AS DOUBLE) AS q50, CAST(max({c}) AS DOUBLE) AS max FROM ledger"


@query(f"{_L} {_COLUMN('amount_currency')} UNION ALL {_COLUMN('amount_debit')}")
def e21_profile(spark, d):
    return analytics.profile(ledger(spark, d), ["amount_currency", "amount_debit"]).select("column", "count", F.col("distinct").alias("distinct_values"), F.round(F.col("mean").cast("double"), 2).alias("mean"), "min", "q50", "max")


@query(f"""{_L}, v AS (SELECT DISTINCT 'purpose_text' AS "column", trim(purpose_text) AS value FROM ledger UNION SELECT DISTINCT 'source_bank', trim(source_bank) FROM ledger),
  r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY encode(value)) AS n FROM v WHERE length(value) > 3) SELECT "column", value FROM r WHERE n <= 20""")
def e22_sample_values(spark, d):
    return analytics.sample_values(ledger(spark, d), ["purpose_text", "source_bank"])


# --- D: joins ----------------------------------------------------------------------------------------------
@query(f"""{_L}, s AS (SELECT statement_id, min(source_bank) AS client_name, CAST(CAST(sum(amount_credit - amount_debit) AS DECIMAL(18, 2)) AS DOUBLE) AS closing_balance FROM ledger GROUP BY 1)
  SELECT tx_id, client_name, closing_balance, concat_ws(' | ', nullif(trim(operation_type_raw), ''), nullif(trim(purpose_text), ''), nullif(trim(payer_name), ''), nullif(trim(receiver_name), '')) AS semantic_text FROM ledger JOIN s ON ledger.statement_id = s.statement_id""")
def d1_ledger_view(spark, d):
    x = ledger(spark, d).withColumn("semantic_text", F.lit(None).cast("string")).withColumn("purpose_code", F.lit(None).cast("string"))
    return sinks.ledger_view(x, fixtures.statements(x)).select("tx_id", "client_name", F.col("closing_balance").cast("double").alias("closing_balance"), "semantic_text")


_TOKENS = " UNION ".join(f"SELECT project_id, tx_id, unnest(regexp_extract_all(upper({c}), '{p}', 1)) AS token FROM ledger WHERE source_bank <> 'esf'" for c in ("purpose_text", "raw_note", "operation_type_raw") for p in ("№\\s*([A-ZА-Я0-9/_-]{3,})", "(ESF[-A-Z0-9_]+)"))
_RECONCILED = f"""WITH ledger AS ({LEDGER_SQL}), invoices AS ({INVOICES_SQL}), t AS ({_TOKENS}),
  i AS (SELECT project_id, registration_number, contract_number, row_hash, CAST(total_amount AS DOUBLE) AS due, unnest([upper(registration_number), upper(contract_number)]) AS token FROM invoices),
  p AS (SELECT DISTINCT i.project_id, registration_number, contract_number, row_hash, due, tx_id FROM i JOIN t ON t.project_id = i.project_id AND t.token = i.token),
  g AS (SELECT p.project_id, registration_number, contract_number, row_hash, due AS invoice_total, {_MONEY("greatest(amount_credit, amount_debit, amount_kzt)")} AS paid_total, count(*) AS payments FROM p JOIN ledger ON p.tx_id = ledger.tx_id GROUP BY 1, 2, 3, 4, 5),
  r AS (SELECT *, round(invoice_total - paid_total, 2) AS difference FROM g WHERE abs(round(invoice_total - paid_total, 2)) >= 1)"""


@query(f"{_RECONCILED} SELECT * FROM r")
def d3_reconcile_invoices(spark, d):
    return invoices.reconcile(ledger(spark, d), invoice_rows(spark, d))


@query(f"{_RECONCILED} SELECT project_id, CAST(NULL AS VARCHAR) AS file_id, 'esf_bank_amount_mismatch' AS code, 'medium' AS severity, payments AS n, abs(difference) AS amount, round(paid_total / invoice_total, 4) AS ratio FROM r")
def f10_invoice_mismatch(spark, d):
    return detectors.invoice_mismatches(ledger(spark, d), invoice_rows(spark, d)).drop("articles")


@query(f"""{_RECONCILED}, z AS (SELECT r.project_id, r.registration_number, r.contract_number, r.row_hash, ledger.tx_id, CAST(greatest(amount_credit, amount_debit, amount_kzt) AS DOUBLE) AS amount, operation_date,
  row_number() OVER (PARTITION BY r.project_id, r.registration_number, r.contract_number, r.row_hash ORDER BY greatest(amount_credit, amount_debit, amount_kzt) DESC, operation_date DESC, operation_ts DESC, ledger.tx_id) AS rank
  FROM r JOIN p ON p.project_id = r.project_id AND p.registration_number = r.registration_number AND p.contract_number = r.contract_number AND p.row_hash = r.row_hash JOIN ledger ON ledger.tx_id = p.tx_id) SELECT * FROM z WHERE rank <= 8""")
def f10_mismatch_rows(spark, d):
    """The largest payments behind each mismatched invoice."""
    return invoices.mismatch_rows(ledger(spark, d), invoice_rows(spark, d))


@query(f"{_RECONCILED} SELECT r.project_id, r.registration_number, r.contract_number, r.row_hash, i.buyer_name AS name, i.buyer_iin_bin AS identifier, payments AS transaction_count, paid_total AS turnover FROM r JOIN invoices i ON i.row_hash = r.row_hash")
def f10_mismatch_parties(spark, d):
    return invoices.mismatch_parties(ledger(spark, d), invoice_rows(spark, d))


@query(f"""{_RECONCILED} SELECT project_id, registration_number, contract_number, row_hash, unnest(['invoice_total', 'paid_total', 'difference', 'payments']) AS indicator, unnest([invoice_total, paid_total, abs(difference), CAST(payments AS DOUBLE)]) AS value FROM r""")
def f10_mismatch_indicators(spark, d):
    return invoices.mismatch_indicators(ledger(spark, d), invoice_rows(spark, d))


@query(f"""WITH ledger AS ({LEDGER_SQL}), invoices AS ({INVOICES_SQL}) SELECT concat('esf-', registration_number) AS tx_id, project_id, CAST(total_amount AS DOUBLE) AS amount_kzt, CASE WHEN esf_direction = 'purchase' THEN 'debit' ELSE 'credit' END AS direction, supplier_name AS payer_name
  FROM invoices i WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.project_id = i.project_id AND l.statement_id = i.row_hash AND l.direction = 'credit')""")
def d5_invoice_shadow(spark, d):
    known = ledger(spark, d).filter("direction = 'credit'").select("project_id", F.col("statement_id").alias("row_hash"))
    return invoices.invoice_shadow(invoice_rows(spark, d), known).select("tx_id", "project_id", F.col("amount_kzt").cast("double").alias("amount_kzt"), "direction", "payer_name")


# --- F: detectors ------------------------------------------------------------------------------------------
_SCALED = detectors.Thresholds(flush_credit=100_000, flush_debit=80_000, spike_rows=4, repeat_count=2, repeat_share=0.0)
_PREP = f"""r AS (SELECT *, CAST(amount_credit AS DOUBLE) AS cr, CAST(amount_debit AS DOUBLE) AS db, greatest(CAST(amount_credit AS DOUBLE), CAST(amount_debit AS DOUBLE), CAST(amount_kzt AS DOUBLE)) AS amount, operation_date AS dday,
  {_key("fraud", "payer_name", "payer_iin_bin", "payer_account")} AS pk, {_key("fraud", "receiver_name", "receiver_iin_bin", "receiver_account")} AS rk FROM ledger)"""
_F0 = f"""{_PREP}, f AS (SELECT project_id, file_id, count(*) AS n_rows, round(sum(amount_credit), 2) AS credit_d, CAST(sum(amount_credit) AS DOUBLE) AS credit, CAST(sum(amount_debit) AS DOUBLE) AS debit, count(CASE WHEN cr > 0 THEN 1 END) AS n_credit, count(CASE WHEN db > 0 THEN 1 END) AS n_debit,
  count(DISTINCT CASE WHEN cr > 0 THEN pk END) AS senders, count(DISTINCT CASE WHEN db > 0 THEN rk END) AS receivers, {_MONEY("CASE WHEN db > 0 AND regexp_matches(lower(purpose_text), 'снятие|налич|cash|atm|банкомат') THEN amount_debit END")} AS cash_total,
  count(CASE WHEN db > 0 AND regexp_matches(lower(purpose_text), 'снятие|налич|cash|atm|банкомат') THEN 1 END) AS cash_count, count(DISTINCT dday) AS active_days,
  count(DISTINCT CASE WHEN cr > 0 THEN dday END) + count(DISTINCT CASE WHEN db > 0 THEN dday END) - count(DISTINCT CASE WHEN cr > 0 OR db > 0 THEN dday END) AS same_days, count(CASE WHEN cr > 0 AND cr <= 100000 THEN 1 END) AS small_credits,
  count(CASE WHEN regexp_matches(lower(purpose_text), 'личн|частн') AND amount >= 200000 THEN 1 END) AS mismatches, round(coalesce(max(CASE WHEN regexp_matches(lower(purpose_text), 'личн|частн') THEN amount END), 0), 2) AS mismatch_max FROM r GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query(f"{_L}, {_F0} SELECT project_id, file_id, n_rows, credit, debit, n_credit, n_debit, senders, receivers, cash_total, cash_count, active_days, same_days, small_credits, mismatches FROM f")
def f0_group_features(spark, d):
    f = detectors.features(detectors.prepared(ledger(spark, d)))
    return f.select("project_id", "file_id", "n_rows", "credit", "debit", "n_credit", "n_debit", "senders", "receivers", "cash_total", "cash_count", "active_days", "same_days", "small_credits", "mismatches")


@query(f"""{_L}, {_F0}, c AS (SELECT *, CASE WHEN credit > 0 THEN debit / credit ELSE 0 END AS out_ratio, CASE WHEN debit > 0 THEN cash_total / debit ELSE 0 END AS cash_ratio, CASE WHEN credit > 0 THEN abs(credit - debit) / credit ELSE 1 END AS retention, same_days / active_days AS same_day_ratio, small_credits / n_credit AS small_share FROM f)
  SELECT project_id, file_id, 'dropper_transit' AS code, n_credit AS n, credit AS amount FROM c WHERE credit >= 300000 AND n_credit >= 5 AND senders >= 4 AND debit >= 200000 AND (receivers >= 3 OR cash_total >= 150000) AND out_ratio >= 0.78 AND retention <= 0.3 AND same_day_ratio >= 0.3
  UNION ALL SELECT project_id, file_id, 'cash_out', cash_count, cash_total FROM c WHERE credit >= 250000 AND cash_total >= 150000 AND cash_count >= 2 AND cash_ratio >= 0.35
  UNION ALL SELECT project_id, file_id, 'structuring', small_credits, credit FROM c WHERE n_credit > 0 AND credit >= 250000 AND small_credits >= 6 AND senders >= 4 AND small_share >= 0.6
  UNION ALL SELECT project_id, file_id, 'fan_in_drop_account', n_credit, credit FROM c WHERE n_credit >= 8 AND senders >= 5
  UNION ALL SELECT project_id, file_id, 'purpose_mismatch', mismatches, mismatch_max FROM c WHERE mismatches >= 3""")
def f1_f9_group_detectors(spark, d):
    return detectors.group_detectors(detectors.features(detectors.prepared(ledger(spark, d)))).select("project_id", "file_id", "code", "n", "amount")


@query(f"""{_L}, {_PREP}, s AS (SELECT project_id, file_id, CASE WHEN cr > 0 THEN 'credit' ELSE 'debit' END AS dir, round(amount / 10000) * 10000 AS a, count(*) AS n FROM r GROUP BY 1, 2, 3, 4 HAVING a > 0 AND count(*) >= 4),
  k AS (SELECT *, sum(n) OVER (PARTITION BY project_id, file_id) AS covered, row_number() OVER (PARTITION BY project_id, file_id ORDER BY n DESC, a DESC) AS i FROM s), z AS (SELECT project_id, file_id, count(*) AS n_rows FROM ledger GROUP BY 1, 2 HAVING count(*) >= 3)
  SELECT k.project_id, k.file_id, n, round(a, 2) AS amount, round(covered / n_rows, 4) AS ratio FROM k JOIN z ON k.project_id = z.project_id AND k.file_id = z.file_id WHERE i = 1 AND covered / n_rows >= 0.25""")
def f4_repeated_amounts(spark, d):
    return detectors.repeated_amounts(detectors.prepared(ledger(spark, d)), round_to=10_000).select("project_id", "file_id", "n", "amount", "ratio")


_DAYS = "d AS (SELECT project_id, file_id, dday, count(*) AS n, CAST(round(sum(CAST(amount AS DECIMAL(18, 2))), 2) AS DOUBLE) AS turnover, CAST(sum(amount_credit) AS DOUBLE) AS credit, CAST(sum(amount_debit) AS DOUBLE) AS debit, count(DISTINCT CASE WHEN cr > 0 THEN pk ELSE rk END) AS parties FROM r GROUP BY 1, 2, 3)"


@query(f"""{_L}, {_PREP}, {_DAYS}, k AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_id ORDER BY n DESC, turnover DESC, dday) AS i FROM d WHERE n >= 4) SELECT project_id, file_id, n, round(turnover, 2) AS amount, CAST(parties AS DOUBLE) AS ratio FROM k WHERE i = 1""")
def f5_activity_spikes(spark, d):
    return detectors.activity_spikes(detectors.days(detectors.prepared(ledger(spark, d))), _SCALED).select("project_id", "file_id", "n", "amount", "ratio")


@query(f"""{_L}, {_PREP}, x AS (SELECT project_id, file_id, CASE WHEN cr > 0 THEN pk ELSE rk END AS k, amount, dday FROM r), g AS (SELECT project_id, file_id, k, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS turnover, count(DISTINCT dday) AS days FROM x WHERE k IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 4 AND sum(CAST(amount AS DECIMAL(18, 2))) >= 500000),
  o AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_id ORDER BY n DESC, turnover DESC, k) AS i FROM g) SELECT project_id, file_id, n, turnover AS amount, CAST(days AS DOUBLE) AS ratio FROM o WHERE i = 1""")
def f6_repeated_parties(spark, d):
    return detectors.repeated_parties(detectors.prepared(ledger(spark, d))).select("project_id", "file_id", "n", "amount", "ratio")


@query(f"""{_L}, {_PREP}, {_DAYS}, h AS (SELECT *, debit / credit AS ratio FROM d WHERE credit >= 100000 AND debit >= 80000 AND debit / credit >= 0.8), k AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_id ORDER BY ratio DESC, debit DESC, dday) AS i FROM h)
  SELECT project_id, file_id, n, debit AS amount, round(ratio, 4) AS ratio FROM k WHERE i = 1""")
def f8_rapid_flushes(spark, d):
    return detectors.rapid_flushes(detectors.days(detectors.prepared(ledger(spark, d))), _SCALED).select("project_id", "file_id", "n", "amount", "ratio")


def _found(code: str, n: str, amount: str, ratio: str, source: str) -> str:
    severity, articles = detectors.DETECTORS[code]
    return f"SELECT project_id, file_id, '{code}' AS code, '{severity}' AS severity, '{', '.join(articles)}' AS articles, CAST({n} AS BIGINT) AS n, round(CAST({amount} AS DOUBLE), 2) AS amount, round(CAST({ratio} AS DOUBLE), 4) AS ratio FROM {source}"


#: Every detector at its own thresholds, as tables of groups: c has the features, a the top amounts, k and h the top days, o the top partners.
_WARNED = f"""{_F0}, {_DAYS}, c AS (SELECT *, CASE WHEN credit > 0 THEN debit / credit ELSE 0 END AS out_ratio, CASE WHEN debit > 0 THEN cash_total / debit ELSE 0 END AS cash_ratio, CASE WHEN credit > 0 THEN abs(credit - debit) / credit ELSE 1 END AS retention, CASE WHEN active_days > 0 THEN same_days / active_days ELSE 0 END AS same_day_ratio, CASE WHEN n_credit > 0 THEN small_credits / n_credit ELSE 0 END AS small_share FROM f),
  am AS (SELECT project_id, file_id, CASE WHEN cr > 0 THEN 'credit' ELSE 'debit' END AS dir, amount AS a, count(*) AS n FROM r WHERE amount > 0 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4),
  ag AS (SELECT project_id, file_id, sum(n) AS covered, count(*) AS amounts, max(struct_pack(n := n, a := a)) AS top FROM am GROUP BY 1, 2), a AS (SELECT ag.*, top.n AS top_n, top.a AS top_a, covered / n_rows AS share FROM ag JOIN f USING (project_id, file_id) WHERE covered / n_rows >= 0.25),
  k AS (SELECT d.* FROM d JOIN f USING (project_id, file_id) WHERE d.n >= 10 QUALIFY row_number() OVER (PARTITION BY project_id, file_id ORDER BY d.n DESC, d.turnover DESC, dday) = 1),
  h AS (SELECT d.*, d.debit / d.credit AS flushed FROM d JOIN f USING (project_id, file_id) WHERE d.credit >= 300000 AND d.debit >= 200000 AND d.debit / d.credit >= 0.8 QUALIFY row_number() OVER (PARTITION BY project_id, file_id ORDER BY flushed DESC, d.debit DESC, dday) = 1),
  og AS (SELECT project_id, file_id, CASE WHEN cr > 0 THEN pk ELSE rk END AS other, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS turnover, count(DISTINCT dday) AS days FROM r WHERE CASE WHEN cr > 0 THEN pk ELSE rk END IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 4 AND sum(CAST(amount AS DECIMAL(18, 2))) >= 500000),
  os AS (SELECT og.* FROM og JOIN f USING (project_id, file_id)), o AS (SELECT * FROM os QUALIFY row_number() OVER (PARTITION BY project_id, file_id ORDER BY n DESC, turnover DESC, other) = 1),
  dt AS (SELECT * FROM c WHERE credit >= 300000 AND n_credit >= 5 AND senders >= 4 AND debit >= 200000 AND (receivers >= 3 OR cash_total >= 150000) AND out_ratio >= 0.78 AND retention <= 0.3 AND same_day_ratio >= 0.3),
  co AS (SELECT * FROM c WHERE credit >= 250000 AND cash_total >= 150000 AND cash_count >= 2 AND cash_ratio >= 0.35), st AS (SELECT * FROM c WHERE credit >= 250000 AND small_credits >= 6 AND senders >= 4 AND small_share >= 0.6),
  fi AS (SELECT * FROM c WHERE n_credit >= 8 AND senders >= 5), pm AS (SELECT *, mismatches / n_rows AS mismatch_share FROM c WHERE mismatches >= 3)"""
_WARNINGS = " UNION ALL ".join(
    _found(*x) for x in (("dropper_transit", "n_credit", "credit", "out_ratio", "dt"), ("cash_out", "cash_count", "cash_total", "cash_ratio", "co"), ("structuring", "small_credits", "credit", "small_share", "st"), ("fan_in_drop_account", "n_credit", "credit", "senders", "fi"), ("purpose_mismatch", "mismatches", "mismatch_max", "mismatch_share", "pm"),
                         ("repeated_amount_patterns", "top_n", "top_a", "share", "a"), ("high_activity_spike", "n", "turnover", "parties", "k"), ("rapid_balance_flush", "n", "debit", "flushed", "h"), ("repeated_counterparty_flows", "n", "turnover", "days", "o"))
)


@query(f"{_RECONCILED}, {_WARNED} {_WARNINGS} UNION ALL {_found('esf_bank_amount_mismatch', 'payments', 'abs(difference)', 'paid_total / invoice_total', '(SELECT *, CAST(NULL AS VARCHAR) AS file_id FROM mismatched)')}".replace("  r AS (SELECT *, round(invoice_total", "  mismatched AS (SELECT *, round(invoice_total"))
def f_all_warnings(spark, d):
    """Every detector at its own thresholds, that of invoices too, with severity and articles."""
    return detectors.detect(ledger(spark, d), invoices=invoice_rows(spark, d))


@query(f"""{_L}, {_F0}, w AS (SELECT project_id, file_id FROM f WHERE n_credit >= 8 AND senders >= 5), p AS (SELECT r.project_id, r.file_id, pk AS key, count(*) AS transaction_count, CAST(sum(amount_credit) AS DOUBLE) AS turnover FROM r JOIN w ON r.project_id = w.project_id AND r.file_id = w.file_id WHERE cr > 0 AND pk IS NOT NULL GROUP BY 1, 2, 3),
  o AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_id ORDER BY turnover DESC, transaction_count DESC, key) AS rank FROM p) SELECT project_id, file_id, key, transaction_count, turnover, rank FROM o WHERE rank <= 6""")
def f11_party_evidence(spark, d):
    rows = evidence.kept(detectors.prepared(ledger(spark, d)), ("tx_id", "operation_ts", "purpose_text", "operation_type_raw", "payer_account", "receiver_name", "receiver_iin_bin", "receiver_account"))
    warned = detectors.group_detectors(detectors.features(rows, stored=True)).filter("code = 'fan_in_drop_account'")
    return detectors.party_evidence(rows, warned, True).select("project_id", "file_id", "key", "transaction_count", "turnover", F.col("rank").cast("long").alias("rank"))


@query(f"""{_L}, {_F0}, w AS (SELECT project_id, file_id FROM f WHERE n_credit >= 8 AND senders >= 5), o AS (SELECT r.project_id, r.file_id, tx_id, amount, row_number() OVER (PARTITION BY r.project_id, r.file_id ORDER BY amount DESC, operation_ts DESC, tx_id) AS rank FROM r JOIN w ON r.project_id = w.project_id AND r.file_id = w.file_id)
  SELECT project_id, file_id, tx_id, round(amount, 2) AS amount, rank FROM o WHERE rank <= 8""")
def f12_row_evidence(spark, d):
    rows = evidence.kept(detectors.prepared(ledger(spark, d)), ("operation_type_raw", "purpose_text", "payer_key", *(f"{s}_{c}" for s in ("payer", "receiver") for c in ("name", "iin_bin", "account"))))
    warned = detectors.group_detectors(detectors.features(rows, stored=True)).filter("code = 'fan_in_drop_account'")
    return detectors.row_evidence(rows.withColumn("purpose_text", F.lit("")), warned).select("project_id", "file_id", "tx_id", "amount", F.col("rank").cast("long").alias("rank"))


_CASHED = "db > 0 AND regexp_matches(lower(purpose_text), 'снятие|налич|cash|atm|банкомат')"
_OTHER = "CASE WHEN cr > 0 THEN pk ELSE rk END"


def _matched(code: str, part: str, shown: int, size: str, source: str, where: str, parties: int, side: str | None = None, times: str = "0") -> str:
    return f"SELECT r.*, '{code}' AS code, '{part}' AS part, {shown} AS shown, {size} AS size, {parties} AS parties, {repr(side) if side else 'NULL'} AS side, {times} AS times FROM r JOIN {source} USING (project_id, file_id) WHERE {where}"


#: Payments of each part of a warning.
_MATCHED = "matched AS (" + " UNION ALL ".join(
    _matched(*x)
    for x in (
        ("dropper_transit", "credits", 5, "cr", "(SELECT project_id, file_id FROM dt)", "cr > 0", 4, "payer"),
        ("dropper_transit", "debits", 5, "db", "(SELECT project_id, file_id FROM dt)", "db > 0", 4, "receiver"),
        ("cash_out", "cash", 6, "db", "(SELECT project_id, file_id FROM co)", _CASHED, 5, "receiver"),
        ("cash_out", "credits", 3, "cr", "(SELECT project_id, file_id FROM co)", "cr > 0", 0, "payer"),
        ("structuring", "small", 8, "cr", "(SELECT project_id, file_id FROM st)", "cr > 0 AND cr <= 100000", 6, "payer"),
        ("repeated_amount_patterns", "repeated", 8, "amount", "(SELECT am.project_id, am.file_id, dir, am.a, am.n FROM am JOIN a USING (project_id, file_id)) x", "dir = CASE WHEN cr > 0 THEN 'credit' ELSE 'debit' END AND x.a = amount", 6, None, "x.n"),
        ("high_activity_spike", "day", 8, "amount", "(SELECT project_id, file_id, dday AS on_day FROM k)", "dday = on_day", 6),
        ("repeated_counterparty_flows", "party", 8, "amount", "(SELECT project_id, file_id, other FROM o)", f"{_OTHER} = other", 0),
        ("fan_in_drop_account", "credits", 8, "cr", "(SELECT project_id, file_id FROM fi)", "cr > 0", 6, "payer"),
        ("rapid_balance_flush", "credits", 8, "cr", "(SELECT project_id, file_id, dday AS on_day FROM h)", "cr > 0 AND dday = on_day", 3, "payer"),
        ("rapid_balance_flush", "debits", 8, "db", "(SELECT project_id, file_id, dday AS on_day FROM h)", "db > 0 AND dday = on_day", 3, "receiver"),
        ("purpose_mismatch", "private", 8, "amount", "(SELECT project_id, file_id FROM pm)", "regexp_matches(lower(purpose_text), 'личн|частн') AND amount >= 200000", 6),
    )
) + ")"


def _identified(side: str) -> str:
    return f"coalesce(nullif(regexp_replace(coalesce({side}_iin_bin, ''), '[^0-9]', '', 'g'), ''), nullif(trim({side}_account), ''))"


def _called(side: str) -> str:
    return f"coalesce(nullif(trim({side}_name), ''), {_identified(side)})"


_ARTICLES = "CASE code " + " ".join(f"WHEN '{c}' THEN '{', '.join(x)}'" for c, (_, x) in detectors.DETECTORS.items()) + " END"


@query(f"""{_L}, {_WARNED}, {_MATCHED}, sided AS (SELECT *, coalesce(side, first_value(CASE WHEN cr > 0 THEN 'payer' ELSE 'receiver' END) OVER (PARTITION BY project_id, file_id, code, side IS NULL ORDER BY times DESC, CASE WHEN times > 0 THEN amount END DESC, dday DESC, operation_ts DESC, tx_id DESC)) AS role FROM matched WHERE parties > 0),
  e AS (SELECT *, CASE WHEN role = 'payer' THEN pk ELSE rk END AS key FROM sided), g AS (SELECT project_id, file_id, code, part, parties, role, key, min(CASE WHEN role = 'payer' THEN {_called("payer")} ELSE {_called("receiver")} END) AS name, min(CASE WHEN role = 'payer' THEN {_identified("payer")} ELSE {_identified("receiver")} END) AS identifier,
    count(*) AS transaction_count, CAST(sum(CASE WHEN role = 'payer' THEN amount_credit ELSE amount_debit END) AS DOUBLE) AS turnover FROM e WHERE key IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7),
  t AS (SELECT project_id, file_id, code, role, key, name, identifier, transaction_count, turnover, row_number() OVER (PARTITION BY project_id, file_id, code, part ORDER BY turnover DESC, transaction_count DESC, key) AS rank FROM g QUALIFY rank <= parties),
  ow AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_id ORDER BY n DESC, turnover DESC, other) AS rank FROM os QUALIFY rank <= 6),
  names AS (SELECT project_id, file_id, {_OTHER} AS other, min(CASE WHEN cr > 0 THEN {_called("payer")} ELSE {_called("receiver")} END) AS name, min(CASE WHEN cr > 0 THEN {_identified("payer")} ELSE {_identified("receiver")} END) AS identifier FROM r GROUP BY 1, 2, 3),
  z AS (SELECT * FROM t UNION ALL SELECT project_id, file_id, 'repeated_counterparty_flows', 'party', other, name, identifier, n, turnover, rank FROM ow JOIN names USING (project_id, file_id, other)) SELECT *, {_ARTICLES} AS articles FROM z""")
def f11_all_parties(spark, d):
    """Parties behind every warning; their articles are those of the warning."""
    found = evidence.Found(evidence.kept(detectors.prepared(ledger(spark, d)), ("purpose_text", "operation_type_raw")), stored=True)
    return evidence.warning_parties(found).withColumn("rank", F.col("rank").cast("long"))


@query(f"""{_L}, {_WARNED}, {_MATCHED}, s AS (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY project_id, file_id, code, part ORDER BY size DESC, dday DESC, operation_ts DESC, tx_id) <= shown),
  u AS (SELECT DISTINCT project_id, file_id, code, tx_id, CASE WHEN cr > 0 THEN 'in' ELSE 'out' END AS direction, amount, operation_ts, dday, CASE WHEN cr > 0 THEN {_called("payer")} ELSE {_called("receiver")} END AS counterparty, purpose_text AS purpose FROM s)
  SELECT project_id, file_id, code, tx_id, direction, round(amount, 2) AS amount, operation_ts, counterparty, purpose, row_number() OVER (PARTITION BY project_id, file_id, code ORDER BY u.amount DESC, dday DESC, operation_ts DESC, tx_id) AS rank FROM u QUALIFY rank <= 8""")
def f12_all_rows(spark, d):
    """Payments behind every warning, at most eight of each."""
    found = evidence.Found(evidence.kept(detectors.prepared(ledger(spark, d))), stored=True)
    return evidence.warning_rows(found).withColumn("rank", F.col("rank").cast("long"))


def _figures(code: str, source: str, numbers: dict[str, str], texts: dict[str, str] | None = None) -> str:
    cells = [f"struct_pack(indicator := '{k}', number := round(CAST({v} AS DOUBLE), 4), text := CAST(NULL AS VARCHAR))" for k, v in numbers.items()]
    cells += [f"struct_pack(indicator := '{k}', number := CAST(NULL AS DOUBLE), text := CAST({v} AS VARCHAR))" for k, v in (texts or {}).items()]
    return f"SELECT project_id, file_id, '{code}' AS code, unnest([{', '.join(cells)}], recursive := true) FROM {source}"


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_FIGURES = " UNION ALL ".join(
    _figures(*x)
    for x in (
        ("dropper_transit", "dt", _same("n_credit", "senders", "out_ratio", "same_days", "active_days", "cash_total")),
        ("cash_out", "co", _same("cash_total", "cash_ratio", "cash_count")),
        ("structuring", "st LEFT JOIN rc USING (project_id, file_id)", _same("small_credits", "small_share", "senders") | {"repeated_credits": "coalesce(rep, 0)"}),
        ("fan_in_drop_account", "fi LEFT JOIN cd USING (project_id, file_id)", _same("n_credit", "senders", "credit", "credit_days")),
        ("purpose_mismatch", "pm", _same("mismatches", "mismatch_max", "mismatch_share")),
        ("repeated_amount_patterns", "a", {"amounts": "amounts", "a": "top_a", "n": "top_n", "share": "share"}),
        ("high_activity_spike", "k", _same("n", "turnover", "parties"), {"day": "dday"}),
        ("repeated_counterparty_flows", "o", _same("n", "turnover", "days"), {"other_key": "other"}),
        ("rapid_balance_flush", "h", {"credit": "credit", "debit": "debit", "ratio": "flushed"}, {"day": "dday"}),
    )
)


@query(f"""{_L}, {_WARNED}, cd AS (SELECT project_id, file_id, count(DISTINCT dday) AS credit_days FROM r WHERE cr > 0 GROUP BY 1, 2),
  rc AS (SELECT project_id, file_id, count(*) AS rep FROM (SELECT project_id, file_id, cr FROM r WHERE cr > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 3) GROUP BY 1, 2) {_FIGURES}""")
def f_indicators(spark, d):
    """The figures of every warning, those that are numbers as such."""
    found, number = evidence.indicators(evidence.Found(detectors.prepared(ledger(spark, d)))), F.expr("try_cast(value AS double)")
    return found.select("project_id", "file_id", "code", "indicator", F.round(number, 4).alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


@query(f"{_L}, {_WARNED} {_WARNINGS}")
def f_stored_warnings(spark, d):
    """The ledger stored in two batches, and every detector of payments after each: the second time only new payments are read."""
    rows, (stored, sums) = ledger(spark, d).withColumn("row_hash", F.col("tx_id")), (f"{runtime.shared_dir(spark)}/{name}" for name in ("ledger", "partials"))
    for batch in ("direction = 'credit'", "direction <> 'credit'"):
        sinks.upsert_stored(rows.filter(batch), stored)
        found = detectors.detect_stored(spark, stored, sums)
    return found


# --- G, H: ranking and drill-down ------------------------------------------------------------------------
@query(f"{_L}, o AS (SELECT *, row_number() OVER (PARTITION BY project_id, concat(statement_id, direction) ORDER BY tx_id) AS n FROM ledger) SELECT project_id, concat(statement_id, direction) AS row_hash, tx_id FROM o WHERE n = 1")
def g1_first_in_batch(spark, d):
    return readers.upload_batches(ledger(spark, d).withColumn("row_hash", F.concat("statement_id", "direction")), "tx_id").select("project_id", "row_hash", "tx_id")


_DETAIL = f"tx_id, {_TS} AS date, {_shown('payer_name', 'payer_account')} AS sender_name, {_shown('receiver_name', 'receiver_account')} AS recipient_name, purpose_text, currency, CAST(amount_debit AS DOUBLE) AS debit, CAST(amount_credit AS DOUBLE) AS credit, CAST(amount_kzt AS DOUBLE) AS amount_kzt"


@query(f"{_L} SELECT {_DETAIL} FROM ledger ORDER BY amount_credit DESC, {_TS} DESC, tx_id DESC LIMIT 100 OFFSET 100")
def h3_sorted_page(spark, d):
    x = ledger(spark, d)
    return analytics.detail(analytics.page(x, 2, 100, analytics.sort_keys("credit")))


@query(f"{_L} SELECT row_number() OVER (ORDER BY amount_credit DESC, {_TS} DESC, tx_id DESC) AS place, tx_id, CAST(amount_credit AS DOUBLE) AS credit FROM ledger QUALIFY place > 5000 AND place <= 5100")
def h3_page_of_ranges(spark, d):
    """A far page of the ledger stored in its order: one range of it is read."""
    order = analytics.sort_keys("credit")
    stored = analytics.Ordered.build(ledger(spark, d), runtime.shared_dir(spark), order, 4096)
    return stored.page(51, 100).select("place", "tx_id", F.col("amount_credit").cast("double").alias("credit"))


@query(f"{_L} SELECT {_DETAIL} FROM ledger WHERE strftime({_TS}, '%Y-%m') = '1995-03' ORDER BY {_TS} DESC, tx_id DESC LIMIT 50")
def h4_drill_month(spark, d):
    return analytics.drill_bucket(ledger(spark, d), "1995-03")


@query(f"{_L} SELECT {_DETAIL} FROM ledger WHERE {_key('name', 'payer_name', 'payer_iin_bin', 'payer_account')} = 'iin:000000000010' OR {_key('name', 'receiver_name', 'receiver_iin_bin', 'receiver_account')} = 'iin:000000000010' ORDER BY {_TS} DESC, tx_id DESC LIMIT 50")
def h7_drill_party(spark, d):
    return analytics.drill_party(ledger(spark, d), "any", "iin:000000000010")


# --- J: graph ----------------------------------------------------------------------------------------------
_VALID = "payer_iin_bin NOT IN ('', '0', '000000000000') AND receiver_iin_bin NOT IN ('', '0', '000000000000') AND payer_iin_bin <> receiver_iin_bin"
_EDGES = f"e AS (SELECT least(payer_iin_bin, receiver_iin_bin) AS source, greatest(payer_iin_bin, receiver_iin_bin) AS target, {_MONEY('amount_kzt')} AS amount, count(*) AS tx_count FROM ledger WHERE {_VALID} GROUP BY 1, 2)"


@query(f"{_L}, {_EDGES} SELECT * FROM e")
def j1_edges(spark, d):
    return graph.edges(ledger(spark, d))


@query(f"""WITH RECURSIVE ledger AS ({LEDGER_SQL}), {_EDGES}, b AS (SELECT source AS node, target AS other, amount FROM e UNION ALL SELECT target, source, amount FROM e), k AS (SELECT node, other FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY amount DESC, other) AS n FROM b) WHERE n <= 6),
  w AS (SELECT '900000000001' AS id, 0 AS level UNION SELECT k.other, w.level + 1 FROM w JOIN k ON k.node = w.id WHERE w.level < 2) SELECT id, min(level) AS level FROM w GROUP BY 1""")
def j2_neighbourhood(spark, d):
    return graph.neighbourhood(graph.edges(ledger(spark, d)), "900000000001", 2, 6)[0]


#: Components of the edges s(source, target).
_COMPONENT_STEP = """b AS MATERIALIZED (SELECT source AS x, target AS y FROM s UNION SELECT target, source FROM s),
  w(node, root) USING KEY (node) AS (SELECT DISTINCT x, x FROM b UNION (SELECT b.x, min(w.root) FROM w JOIN b ON w.node = b.y JOIN recurring.w AS u ON u.node = b.x WHERE w.root < u.root GROUP BY b.x))"""


def _components(where: str) -> str:
    return f"WITH RECURSIVE ledger AS ({LEDGER_SQL}), {_EDGES}, s AS (SELECT source, target FROM e WHERE {where}), {_COMPONENT_STEP} SELECT node, root FROM w"


@query(_components("true"))
def j5_components(spark, d):
    """Components of the graph, over every edge."""
    return graph.connected_components(graph.linked(ledger(spark, d)).select(F.col("payer_iin_bin").alias("a"), F.col("receiver_iin_bin").alias("b")))


@query(f"""{_L}, {_EDGES}, p AS (SELECT payer_iin_bin AS id, amount_kzt AS a FROM ledger UNION ALL SELECT receiver_iin_bin, amount_kzt FROM ledger), t AS (SELECT id, {_MONEY("a")} AS turnover FROM p GROUP BY 1 ORDER BY turnover DESC, id NULLS LAST LIMIT 500),
  c AS (SELECT * FROM e WHERE source IN (SELECT id FROM t) AND target IN (SELECT id FROM t)) SELECT id, round(sum(amount), 2) AS total_turnover FROM (SELECT source AS id, amount FROM c UNION ALL SELECT target, amount FROM c) GROUP BY 1""")
def j4_global_graph(spark, d):
    return graph.global_graph(ledger(spark, d), 500)[0].select("id", "total_turnover")


@query(_components("true"))
def j6_all_components(spark, d):
    """Components of the whole graph: every edge, whatever its sum."""
    return graph.connected_components(graph.linked(ledger(spark, d)).select(F.col("payer_iin_bin").alias("a"), F.col("receiver_iin_bin").alias("b")))


_GLOBAL = f"""WITH RECURSIVE ledger AS ({LEDGER_SQL}), {_EDGES}, p AS (SELECT payer_iin_bin AS id, amount_kzt AS a FROM ledger UNION ALL SELECT receiver_iin_bin, amount_kzt FROM ledger), t AS (SELECT id, {_MONEY("a")} AS turnover FROM p GROUP BY 1 ORDER BY turnover DESC, id NULLS LAST LIMIT 200),
  s AS MATERIALIZED (SELECT * FROM e WHERE source IN (SELECT id FROM t) AND target IN (SELECT id FROM t)), {_COMPONENT_STEP}"""


@query(f"{_GLOBAL}, n AS (SELECT id, round(sum(amount), 2) AS total_turnover FROM (SELECT source AS id, amount FROM s UNION ALL SELECT target, amount FROM s) GROUP BY 1) SELECT id, total_turnover, root AS community_id FROM n JOIN w ON w.node = n.id")
def j7_graph_nodes(spark, d):
    """Nodes of the global graph at its default size, with their communities."""
    return graph.global_graph(ledger(spark, d))[0].select("id", "total_turnover", "community_id")


@query(f"{_GLOBAL} SELECT source, target, amount, tx_count FROM s")
def j8_graph_edges(spark, d):
    """Edges of the same graph."""
    return graph.global_graph(ledger(spark, d))[1]


@query()
def j3_merged_names(spark, d):
    x = ledger(spark, d)
    e = runtime.cut(graph.edges(x))
    nodes, found = graph.neighbourhood(e, "900000000001", 2, 6)
    nodes = graph.node_turnover(nodes, found).join(graph.labels(x), "id", "left")
    return graph.merge_by_name(nodes, found)[0]


# --- K: categories -------------------------------------------------------------------------------------------
@query(f"""{_L} SELECT tx_id, CASE WHEN purpose_text LIKE 'Снятие%' THEN 'CASH' WHEN purpose_text LIKE 'Оплата%' THEN 'STORE' WHEN purpose_text LIKE '%card to card%' THEN 'P2P' WHEN purpose_text LIKE 'Погашение%' THEN 'LOAN_REP' WHEN purpose_text LIKE 'Пополнение%' THEN 'TOPUP' ELSE 'OTHER' END AS category,
  CASE WHEN purpose_text LIKE 'Частный%' THEN 'DEFAULT_OTHER' WHEN purpose_text LIKE 'Снятие%' THEN 'CASH_01' WHEN purpose_text LIKE 'Оплата%' THEN 'STORE_01' WHEN purpose_text LIKE '%card to card%' THEN 'P2P_02' WHEN purpose_text LIKE 'Погашение%' THEN 'LOAN_REP_01' ELSE 'TOPUP_01' END AS rule_id FROM ledger""")
def k1_rules(spark, d):
    return classify.classify_rules(ledger(spark, d)).select("tx_id", F.col("transaction_category").alias("category"), F.col("category_rule_id").alias("rule_id"))


@query(f"WITH k AS ({SQL['k1_rules']}) SELECT CASE WHEN rule_id = 'DEFAULT_OTHER' THEN 'other' ELSE 'rule' END AS category_source, count(*) AS n FROM k GROUP BY 1")
def k6_source_counts(spark, d):
    return classify.source_counts(classify.reclassify(classify.classify_rules(ledger(spark, d))))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'входящ|кредитов|credit|incoming|зачислен|поступлен|доход|income|receipt|deposit') THEN 'credit' WHEN regexp_matches(lower(text), 'исходящ|дебетов|debit|outgoing|списан|расход|трат|expense|spend|outflow|withdraw') THEN 'debit' END AS direction,
  CASE WHEN regexp_matches(lower(text), 'kaspi|каспи') THEN 'kaspi' WHEN regexp_matches(lower(text), 'halyk|халык|народн') THEN 'halyk' WHEN regexp_matches(lower(text), 'forte|форте') THEN 'forte' WHEN regexp_matches(lower(text), 'sber|сбер') THEN 'sber' WHEN regexp_matches(lower(text), 'jusan|джусан') THEN 'jusan' WHEN regexp_matches(lower(text), 'bereke|береке') THEN 'bereke' WHEN regexp_matches(lower(text), 'centercredit|центркредит') THEN 'centercredit' WHEN regexp_matches(lower(text), 'bcc|бцк') THEN 'bcc' END AS source_bank
  FROM conversations WHERE role = 'user'""")
def k7_tag_questions(spark, d):
    q = spark.read.parquet(f"{d}/conversations.parquet").filter("role = 'user'").withColumnRenamed("text", "question")
    return classify.tag_questions(q).select("conv_id", "turn", "direction", "source_bank")


# --- L: vectors ------------------------------------------------------------------------------------------------
_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i]))"


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(q.embedding[i] AS DOUBLE) - c.embedding[i]) * (CAST(q.embedding[i] AS DOUBLE) - c.embedding[i])))) AS distance FROM q, embeddings c),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 8""")
def l2_knn(spark, d):
    e = embeddings(spark, d)
    return vectors.knn(e.filter("vec_id % 50 = 0"), e, 8).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH l AS (SELECT label, min(vec_id) AS first FROM embeddings GROUP BY 1), b0 AS (SELECT l.label, e.embedding FROM l JOIN embeddings e ON e.vec_id = l.first), p AS (SELECT a.vec_id, b.label, {_DOT} AS score FROM embeddings a, b0 b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label DESC) AS n FROM p)
  SELECT vec_id, label, round(score, 4) AS score FROM r WHERE n = 1""")
def l1_best_label(spark, d):
    e = embeddings(spark, d)
    labels = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return vectors.best_match(e, "vec_id", labels, "label").withColumn("score", F.round("score", 4))


@query(SQL["l2_knn"])
def l6_coarse_index(spark, d):
    """Exact over a coarse index, so its SQL is that of l2_knn."""
    e = embeddings(spark, d)
    indexed, centres = vectors.ivf_build(e, 16)
    return vectors.ivf_search(e.filter("vec_id % 50 = 0"), indexed, centres, 8, 8).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH e AS (SELECT * FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0), p AS (SELECT a.vec_id AS layout_id, concat('fmt-', b.vec_id) AS format_id, a.label = b.label AS same, {_DOT} AS score FROM q a, e b WHERE a.vec_id <> b.vec_id),
  m AS (SELECT * FROM p WHERE score >= 0.92 QUALIFY row_number() OVER (PARTITION BY layout_id ORDER BY same DESC, score DESC, format_id DESC) = 1)
  SELECT vec_id AS layout_id, concat('fmt-', vec_id) AS format_id, 'fingerprint' AS method FROM e WHERE vec_id % 50 <> 0 UNION ALL SELECT layout_id, format_id, 'vector' FROM m UNION ALL SELECT vec_id, concat('fmt-re-', vec_id), 'new' FROM q WHERE vec_id NOT IN (SELECT layout_id FROM m)""")
def l3_resolve_format(spark, d):
    """Every row is a known format and a layout. Layouts with ids divisible by 50, the query set of the vectors, come under other fingerprints and do not match themselves."""
    e = embeddings(spark, d)
    bank, own = F.col("label").cast("string").alias("source_bank"), F.concat(F.lit("fmt-"), F.col("vec_id"))
    known = e.select(own.alias("format_id"), F.concat(F.lit("fp-"), F.col("vec_id")).alias("fingerprint"), bank, "embedding", F.lit(1).alias("usage_count"))
    other = F.when(F.col("vec_id") % 50 == 0, "re-").otherwise("fp-")
    new = e.select(F.col("vec_id").alias("layout_id"), F.concat(other, F.col("vec_id")).alias("fingerprint"), bank, "embedding", own.alias("own_format"))
    return vectors.resolve_format(new, known)


@query(SQL["l2_knn"])
def l6_stored_index(spark, d):
    """An index stored by list: half of the vectors when it is built, the others added without a new fit. Its search is exact."""
    e = embeddings(spark, d)
    index = vectors.Index.build(e.filter("vec_id % 2 = 0"), runtime.shared_dir(spark), 16)
    index.add(e.filter("vec_id % 2 <> 0"))
    return index.search(e.filter("vec_id % 50 = 0"), 8, 8).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


_TURNED = "list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) + 0.1 * embedding[65 - i])"


@query(f"""WITH q AS (SELECT vec_id AS query_id, {_TURNED} AS v FROM embeddings WHERE vec_id % 50 = 0), e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings),
  p AS (SELECT query_id, vec_id, list_inner_product(v, w) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(w, w)) AS score FROM q, e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p WHERE score >= 0.92) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def l2_near_knn(spark, d):
    """Near neighbours by hashing: queries are vectors with a tenth of themselves reversed added."""
    e = embeddings(spark, d)
    q = e.filter("vec_id % 50 = 0").select("vec_id", F.zip_with("embedding", F.reverse("embedding"), lambda x, y: x.cast("double") + 0.1 * y).alias("embedding"))
    return vectors.knn_near(q, e, 3, 0.92).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- A, M: ingestion -----------------------------------------------------------------------------------------
@query(f"{_L} SELECT direction, currency, count(*) AS n, {_MONEY('amount_debit')} AS debit, {_MONEY('amount_credit')} AS credit, count(CASE WHEN amount_currency <= 0 THEN 1 END) AS skipped FROM ledger GROUP BY 1, 2")
def a1_ledger_csv(spark, d):
    """Writes the ledger as text and reads it back through the CSV source."""
    path = runtime.shared_dir(spark)
    rows = ledger(spark, d).select(F.date_format("operation_ts", "dd.MM.yyyy HH:mm:ss").alias("operation_ts"), "direction", "currency", F.translate(F.col("amount_currency").cast("string"), ".", ",").alias("amount_currency"), "payer_name", "payer_iin_bin", "receiver_name", "receiver_iin_bin", "purpose_text")
    rows.write.csv(path, header=True, sep=";", escape='"')
    back = readers.read_ledger_csv(spark, path, ";")
    return back.groupBy("direction", "currency").agg(F.count("*").alias("n"), analytics.money("amount_debit").alias("debit"), analytics.money("amount_credit").alias("credit"), F.count_if("skipped").alias("skipped"))


@query(f"""{_L} SELECT file_id, direction, count(*) AS n, {_MONEY("CASE WHEN direction = 'credit' THEN amount_credit ELSE amount_debit END")} AS amount FROM (SELECT file_id, CASE WHEN operation_type_raw LIKE '%дебет%' THEN 'debit' WHEN purpose_text LIKE '%кредит%' THEN 'credit' WHEN lower(purpose_text) LIKE '%перевод card to card%' THEN 'debit' ELSE direction END AS direction, amount_credit, amount_debit FROM ledger) GROUP BY 1, 2""")
def m_sheets_to_ledger(spark, d):
    """The ledger as sheets of cells, found again by header, block and column."""
    sheet = fixtures.dealt_cells(spark, d)
    back = sheets.to_ledger(sheets.canonical(sheets.block_rows(sheet, dealt=True)), "p", "bank")
    amount = F.when(F.col("direction") == "credit", F.col("amount_credit")).otherwise(F.col("amount_debit"))
    return back.groupBy("file_id", "direction").agg(F.count("*").alias("n"), analytics.money(amount).alias("amount"))


@query(f"{_L}, f AS (SELECT DISTINCT file_id FROM ledger) SELECT file_id, 'client_name' AS field, concat('Client ', file_id) AS value FROM f UNION ALL SELECT file_id, 'client_iin_bin', lpad(file_id, 12, '0') FROM f")
def m6_metadata(spark, d):
    sheet = runtime.cut(fixtures.cells(fixtures.ledger_by_file(spark, d)))
    return sheets.pick_metadata(sheets.metadata(sheet)).select("file_id", "field", "value")


@query(f"{_L}, o AS (SELECT project_id, statement_id AS row_hash, min(tx_id) AS tx_id FROM ledger WHERE direction = 'credit' GROUP BY 1, 2), n AS (SELECT project_id, statement_id AS row_hash, min(tx_id) AS tx_id FROM ledger GROUP BY 1, 2) SELECT n.project_id, n.row_hash, coalesce(o.tx_id, n.tx_id) AS tx_id, 'NEW' AS transaction_category FROM n LEFT JOIN o ON n.project_id = o.project_id AND n.row_hash = o.row_hash")
def a7_upsert(spark, d):
    x = ledger(spark, d).withColumn("row_hash", F.col("statement_id"))
    old = x.filter("direction = 'credit'").groupBy("project_id", "row_hash").agg(F.min("tx_id").alias("tx_id")).withColumn("transaction_category", F.lit("OLD"))
    new = x.groupBy("project_id", "row_hash").agg(F.min("tx_id").alias("tx_id")).withColumn("transaction_category", F.lit("NEW"))
    return sinks.upsert_ledger(old, new)


@query(f"{_L} SELECT tx_id, len(list_filter([operation_type_raw, raw_note], lambda x: x IS NOT NULL)) AS n FROM ledger")
def a9_pack_overflow(spark, d):
    x = ledger(spark, d)
    keep = [c for c in x.columns if c not in ("operation_type_raw", "raw_note")]
    return sinks.pack_overflow(x, keep).select("tx_id", F.size("ext").cast("long").alias("n"))


@query(f"""{_L} SELECT strftime({_TS}, '%d.%m.%Y %H:%M') AS "Дата", {_shown("payer_name", "payer_account")} AS "Отправитель", payer_iin_bin AS "ИИН/БИН отправителя", payer_account AS "Счёт отправителя", {_shown("receiver_name", "receiver_account")} AS "Получатель", receiver_iin_bin AS "ИИН/БИН получателя",
  receiver_account AS "Счёт получателя", {_CATEGORY} AS "Категория", operation_type_raw AS "Тип операции", purpose_text AS "Назначение", currency AS "Валюта", amount_debit AS "Дебет", amount_credit AS "Кредит", amount_kzt AS "Сумма в тенге", source_bank AS "Банк" FROM ledger""")
def a11_export_ledger(spark, d):
    return sinks.export_ledger(ledger(spark, d))


@query(f"{_L} SELECT count(*) AS n, {_MONEY('amount_kzt')} AS amount FROM ledger WHERE project_id <> 'AFRICA'")
def a14_purge_project(spark, d):
    left = sinks.purge_project({"ledger": ledger(spark, d)}, "AFRICA")["ledger"]
    return left.agg(F.count("*").alias("n"), analytics.money("amount_kzt").alias("amount"))


# --- N: streams ------------------------------------------------------------------------------------------------
_EV = f"WITH p AS ({EVENTS_SQL})"


@query(f"{_EV}, g AS (SELECT account, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(amount), 2) AS turnover FROM p GROUP BY 1, 2) SELECT account, day, n, turnover FROM g WHERE n >= 3")
def n2_activity_days(spark, d):
    return streams.activity_stream(payments(spark, d), 3)


@query(f"{_EV}, g AS (SELECT account, CAST(ts AS DATE) AS day, round(sum(credit), 2) AS credit, round(sum(debit), 2) AS debit FROM p GROUP BY 1, 2) SELECT account, day, credit, debit, round(debit / credit, 4) AS ratio FROM g WHERE credit >= 20 AND debit >= 10 AND debit / credit >= 0.3")
def n2_flush_days(spark, d):
    return streams.flush_stream(payments(spark, d), 20, 10, 0.3)


def flagship(spark, d) -> DataFrame:
    return e8_top_counterparties(spark, d)


from . import detail_queries  # noqa: E402  registers its queries here

__all__ = ["QUERIES", "SQL", "dates", "detail_queries", "flagship"]
