"""The ledger, invoices and cells as views over the benchmark tables; one SQL text serves Spark and other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bucketed, configure

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "conversations"]

_DEC = "CAST({} AS DECIMAL(18, 2))"
_RATE = "CASE o_orderpriority WHEN '1-URGENT' THEN CAST(475.5 AS DECIMAL(6, 1)) WHEN '2-HIGH' THEN CAST(520.3 AS DECIMAL(6, 1)) ELSE CAST(1 AS DECIMAL(6, 1)) END"
_CUSTOMER = {"name": "CASE WHEN c_custkey % 11 = 0 THEN 'UNKNOWN' ELSE c_name END", "iin_bin": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE lpad(CAST(c_custkey AS VARCHAR(20)), 12, '0') END", "account": "concat('KZ', lpad(CAST(c_custkey AS VARCHAR(20)), 18, '0'))"}
_SUPPLIER = {"name": "concat('Supplier ', CAST(s_suppkey AS VARCHAR(20)))", "iin_bin": "CASE WHEN s_suppkey % 10 = 3 THEN '' ELSE concat('9', lpad(CAST(s_suppkey AS VARCHAR(20)), 11, '0')) END", "account": "concat('KZ9', lpad(CAST(s_suppkey AS VARCHAR(20)), 17, '0'))"}
_PARTIES = ",\n  ".join(
    f"CASE WHEN l_linestatus = 'F' THEN {a[c]} ELSE {b[c]} END AS {side}_{c}" for side, a, b in (("payer", _SUPPLIER, _CUSTOMER), ("receiver", _CUSTOMER, _SUPPLIER)) for c in ("name", "iin_bin", "account")
)

LEDGER_SQL = f"""
SELECT
  concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20))) AS tx_id,
  r_name AS project_id, CAST(o_custkey AS VARCHAR(20)) AS file_id, CAST(o_orderkey AS VARCHAR(20)) AS statement_id, cn.n_name AS source_bank,
  l_shipdate AS operation_ts, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS operation_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'USD' WHEN '2-HIGH' THEN 'EUR' ELSE 'KZT' END AS currency,
  {_DEC.format("l_extendedprice")} AS amount_currency,
  CASE WHEN l_returnflag = 'A' THEN CAST(0 AS DECIMAL(18, 2)) ELSE {_DEC.format(f"round({_DEC.format('l_extendedprice')} * {_RATE}, 2)")} END AS amount_kzt,
  CASE WHEN l_linestatus = 'F' THEN {_DEC.format("l_extendedprice")} ELSE CAST(0 AS DECIMAL(18, 2)) END AS amount_credit,
  CASE WHEN l_linestatus = 'F' THEN CAST(0 AS DECIMAL(18, 2)) ELSE {_DEC.format("l_extendedprice")} END AS amount_debit,
  CASE WHEN l_linestatus = 'F' THEN 'credit' ELSE 'debit' END AS direction,
  CASE l_returnflag WHEN 'A' THEN 'Payment' WHEN 'R' THEN 'исх.док.(дебет)' ELSE '' END AS operation_type_raw,
  CAST(NULL AS VARCHAR(20)) AS sdp_name, CAST(NULL AS VARCHAR(20)) AS transaction_category, CAST(NULL AS VARCHAR(20)) AS raw_note,
  CASE WHEN p_type LIKE 'ECONOMY%' THEN 'Снятие наличных ATM' WHEN p_type LIKE 'MEDIUM%' THEN 'Оплата товаров и услуг' WHEN p_type LIKE 'SMALL%' THEN 'Перевод card to card'
    WHEN p_type LIKE 'LARGE%' THEN concat('Погашение кредита, договор № ', CAST(o_orderkey AS VARCHAR(20))) WHEN p_type LIKE 'STANDARD%' THEN 'Частный перевод' ELSE 'Пополнение счета' END AS purpose_text,
  {_PARTIES}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region ON cn.n_regionkey = r_regionkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
"""

#: The same joins in the order in which Spark shuffles least: narrow payments meet parts and suppliers first, and parties come with orders.
_JOINS = LEDGER_SQL[LEDGER_SQL.index("FROM lineitem") :]
_NARROW_FIRST = """FROM lineitem JOIN (SELECT p_partkey, left(p_type, 8) AS p_type FROM part ) ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN (orders JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region ON cn.n_regionkey = r_regionkey) ON l_orderkey = o_orderkey
"""

INVOICES_SQL = f"""
SELECT CAST(o_orderkey AS VARCHAR(20)) AS registration_number, CAST(o_orderdate AS DATE) AS issue_date, CAST(NULL AS DATE) AS turnover_date, CAST(year(o_orderdate) AS INT) AS year,
  r_name AS project_id, c_name AS buyer_name, lpad(CAST(c_custkey AS VARCHAR(20)), 12, '0') AS buyer_iin_bin,
  concat('Supplier ', CAST(s_suppkey AS VARCHAR(20))) AS supplier_name, concat('9', lpad(CAST(s_suppkey AS VARCHAR(20)), 11, '0')) AS supplier_iin_bin,
  CASE WHEN o_orderstatus = 'F' THEN 'sale' ELSE 'purchase' END AS esf_direction, concat('D-', CAST(o_custkey AS VARCHAR(20))) AS contract_number, o_orderpriority AS tru_name,
  {_DEC.format("o_totalprice")} AS total_amount, {_DEC.format("o_totalprice * 0.12")} AS vat_amount, {_DEC.format("1 + o_orderkey % 9")} AS quantity,
  {_DEC.format("100 + o_orderkey % 3")} AS price_with_vat, {_DEC.format("12")} AS vat_rate, 'шт' AS unit, 'KZT' AS currency_code,
  CAST(NULL AS DECIMAL(18, 2)) AS cost_with_indirect_tax, CAST(NULL AS DECIMAL(18, 2)) AS turnover_amount, CAST(NULL AS DECIMAL(18, 2)) AS cost_without_indirect_tax,
  CAST(o_orderkey AS VARCHAR(20)) AS row_hash
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN (SELECT l_orderkey AS k, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey) first_line ON o_orderkey = k JOIN supplier ON s = s_suppkey
"""

#: Payments made of events: purchases are debits, all else credits.
EVENTS_SQL = """
SELECT event_id, ts, CAST(user_id AS VARCHAR(20)) AS account, CAST(value AS DOUBLE) AS amount,
  CASE WHEN event_type = 'purchase' THEN CAST(0 AS DOUBLE) ELSE CAST(value AS DOUBLE) END AS credit, CASE WHEN event_type = 'purchase' THEN CAST(value AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS debit
FROM events
"""


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    configure(spark)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t} " in text.replace("\n", " \n ").replace("(", " ") or f" {t}\n" in text}
    named = "WITH " + ", ".join(f"{t} AS (SELECT * FROM {{{t}}})" for t in tables)
    return spark.sql(named + text.replace("{", "{{").replace("}", "}}"), **tables)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, LEDGER_SQL.replace(_JOINS, _NARROW_FIRST))


#: What the ledger's columns are made of; a part's type is only read by its first letters.
_BASE = """SELECT CAST(o_custkey AS VARCHAR(20)) AS _file, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag, l_linestatus, o_orderkey, o_orderpriority,
  r_name, cn.n_name, c_custkey, c_name, s_suppkey, p_type """


def ledger_by_file(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """The ledger dealt by file_id, into so many parts if a number is given. Numbers travel, and ids, accounts and texts are made of them where they arrive."""
    base = _sql(spark, sf_dir, _BASE + _NARROW_FIRST)
    base = base.repartition("_file") if parts is None else base.repartition(parts, "_file")
    made = LEDGER_SQL.replace(_JOINS, "FROM {base} AS cn").replace("CAST(o_custkey AS VARCHAR(20)) AS file_id", "_file AS file_id")
    return spark.sql(made, base=base)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, INVOICES_SQL)


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, EVENTS_SQL)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def statements(rows: DataFrame) -> DataFrame:
    """A statement header for each statement of the ledger."""
    return rows.groupBy("statement_id").agg(
        F.min("file_id").alias("file_id"), F.min("source_bank").alias("client_name"), F.min("file_id").alias("client_iin_bin"), F.concat(F.lit("KZ"), F.lpad(F.min("file_id"), 18, "0")).alias("account_iban"),
        F.min("operation_date").alias("period_from"), F.max("operation_date").alias("period_to"), F.lit(0).cast("decimal(18,2)").alias("opening_balance"), F.sum(F.col("amount_credit") - F.col("amount_debit")).cast("decimal(18,2)").alias("closing_balance"),
    )


#: Headers under which cells() writes ledger columns.
CELL_HEADERS = [("Дата операции", "operation_ts"), ("Валюта операции", "currency"), ("Виды операции (категория документа)", "operation_type_raw"), ("Сумма по кредиту", "amount_credit"), ("Сумма по дебету", "amount_debit"), ("Наименование/ФИО плательщика", "payer_name"), ("ИИН/БИН плательщика", "payer_iin_bin"), ("Счет плательщика", "payer_account"), ("Наименование/ФИО получателя", "receiver_name"), ("ИИН/БИН получателя", "receiver_iin_bin"), ("Счет получателя", "receiver_account"), ("Назначение платежа", "purpose_text")]


def cells(rows: DataFrame) -> DataFrame:
    """The ledger as sheets of cells: a sheet for each account file, metadata above, an index row, and a total below.

    A file's first payment brings the rest of its sheet along, so the ledger is read and dealt once.
    """
    from pyspark.sql import Window

    file = Window.partitionBy("file_id")
    text = lambda c: F.date_format(c, "dd.MM.yyyy HH:mm:ss") if c == "operation_ts" else F.col(c).cast("string")
    cell = lambda r, c, v: F.struct(F.lit(r).cast("int").alias("row_no"), F.lit(c).cast("int").alias("col_no"), v.alias("value"))
    place, n, total = (F.col(c) for c in ("_place", "_n", "_total"))
    rows = rows.select("file_id", "tx_id", *(c for _, c in CELL_HEADERS)).withColumns({"_place": F.row_number().over(file.orderBy("tx_id")), "_n": F.count("*").over(file), "_total": F.sum("amount_credit").over(file)})
    edges = [cell(0, 0, F.concat(F.lit("Наименование клиента: Client "), F.col("file_id"))), cell(1, 0, F.lit("ИИН/БИН:")), cell(1, 1, F.lpad("file_id", 12, "0"))]
    edges += [cell(3, i, F.lit(h)) for i, (h, _) in enumerate(CELL_HEADERS)] + [cell(4, i, F.lit(str(i + 1))) for i in range(len(CELL_HEADERS))]
    edges += [cell(n + 5, 0, F.lit("Итого по кредиту")), cell(n + 5, 3, total.cast("string"))]
    own = F.array(*(cell(place + 4, i, text(c)) for i, (_, c) in enumerate(CELL_HEADERS)))
    found = rows.select("file_id", F.explode(F.when(place == 1, F.concat(own, F.array(*edges))).otherwise(own)).alias("x"))
    return found.select("file_id", F.lit("Sheet1").alias("sheet"), "x.*").filter("value is not null")


def dealt_cells(spark: SparkSession, sf_dir: str, change=lambda x: x) -> DataFrame:
    """cells of the ledger, changed, stored in buckets by file (sheets.deal) without another shuffle, since payments are dealt so before."""
    from ..operators.sheets import buckets

    parts = buckets(spark, len(CELL_HEADERS) * spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())
    return bucketed(change(cells(ledger_by_file(spark, sf_dir, parts))), parts, "file_id", dealt=True)
