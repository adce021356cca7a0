"""Further registered queries: lists, drill-downs, sorts, sinks, duplicates and sheets, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import dates, numbers, parties
from ..operators import analytics, classify, duplicates, filters, graph, invoices, sheets, vectors
from ..sources import readers, sinks, versions
from . import fixtures, runtime
from .fixtures import LEDGER_SQL, embeddings, ledger
from .fixtures import invoices as invoice_rows
from .queries import _CATEGORY, _DETAIL, _EDGES, _I, _L, _MONEY, _TS, SQL, _key, _unknown, query

# --- B: scalar functions ---------------------------------------------------------------------------------
_BAD_IIN = "trim(coalesce({0}, '')) IN ('', '0', '000000000000')"


@query(f"{_L} SELECT tx_id, CASE WHEN direction = 'credit' THEN payer_name ELSE concat('Owner ', file_id) END AS payer, CASE WHEN direction = 'credit' THEN concat('Owner ', file_id) ELSE payer_name END AS receiver FROM ledger")
def b_orient(spark, d):
    none = F.lit(None).cast("string")
    both = parties.orient(F.col("direction") == "credit", parties.party(F.concat(F.lit("Owner "), "file_id"), none, none), parties.party(F.col("payer_name"), none, none))
    return ledger(spark, d).select("tx_id", both.alias("x")).select("tx_id", F.col("x.payer.name").alias("payer"), F.col("x.receiver.name").alias("receiver"))


@query(f"""{_L}, a AS (SELECT tx_id, CAST(amount_kzt AS DOUBLE) * 3 AS a, greatest(CAST(amount_debit AS DOUBLE), CAST(amount_credit AS DOUBLE)) AS side FROM ledger)
  SELECT tx_id, round(CASE WHEN side > 0 AND (a / side > 1000 OR a > 10000000000) THEN side ELSE a END, 2) AS safe FROM a""")
def b_safe_amount(spark, d):
    return ledger(spark, d).select("tx_id", F.round(numbers.safe_amount(F.col("amount_kzt").cast("double") * 3, F.col("amount_debit"), F.col("amount_credit")), 2).alias("safe"))


@query(f"""{_L} SELECT tx_id, coalesce(CASE WHEN NOT {_unknown("payer_name")} THEN trim(payer_name) END, nullif(trim(payer_account), ''), CASE WHEN NOT {_BAD_IIN.format("payer_iin_bin")} THEN trim(payer_iin_bin) END, '') AS name,
  coalesce(CASE WHEN NOT {_BAD_IIN.format("payer_iin_bin")} THEN trim(payer_iin_bin) END, '') AS iin_bin, coalesce(nullif(trim(payer_account), ''), '') AS account FROM ledger""")
def b_identity(spark, d):
    return ledger(spark, d).select("tx_id", parties.normalize_identity(F.col("payer_name"), F.col("payer_iin_bin"), F.col("payer_account")).alias("x")).select("tx_id", "x.*")


_QUALITY = " + ".join(
    [f"CASE WHEN {_unknown(f'{s}_name')} THEN 0 ELSE 2 END + CASE WHEN {_BAD_IIN.format(f'{s}_iin_bin')} THEN 0 ELSE 2 END + CASE WHEN coalesce(trim({s}_account), '') = '' THEN 0 ELSE 1 END" for s in ("payer", "receiver")]
    + [f"CASE WHEN coalesce(trim({c}), '') = '' THEN 0 ELSE 1 END" for c in ("purpose_text", "sdp_name", "operation_type_raw")]
)


@query(f"{_L} SELECT tx_id, {_QUALITY} AS quality FROM ledger")
def b_quality(spark, d):
    x = ledger(spark, d)
    return x.select("tx_id", parties.quality({c: F.col(c) for c in x.columns}).alias("quality"))


@query("SELECT o_orderkey, CASE WHEN 1700 + o_custkey % 600 BETWEEN 1900 AND 2100 THEN CAST(1700 + o_custkey % 600 AS INTEGER) END AS year FROM orders WHERE o_orderkey IS NOT NULL")
def b_optional_year(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", numbers.optional_year((1700 + F.col("o_custkey") % 600).cast("string")).alias("year"))


# --- C: filters and ranks ----------------------------------------------------------------------------------
@query(f"{_I} SELECT registration_number, CAST(total_amount AS DOUBLE) AS total_amount FROM invoices WHERE contains(lower(tru_name), 'high') AND currency_code = 'KZT' AND contains(lower(supplier_name), 'supplier 1') AND contains(lower(buyer_name), '0') AND contains(lower(buyer_name), 'customer')")
def c4_invoice_filter(spark, d):
    out = filters.invoice_filter(invoice_rows(spark, d), search="HIGH", currency="KZT", supplier="Supplier 1", buyer="customer")
    return out.filter(F.lower("buyer_name").contains("0")).select("registration_number", F.col("total_amount").cast("double").alias("total_amount"))


@query(f"{_I} SELECT registration_number FROM invoices WHERE issue_date = DATE '1995-03-15' OR turnover_date = DATE '1995-03-15'")
def c4_invoices_of_day(spark, d):
    return filters.invoice_filter(invoice_rows(spark, d), on=date(1995, 3, 15)).select("registration_number")


@query(f"{_L} SELECT tx_id, CAST(amount_kzt AS DOUBLE) AS amount_kzt FROM ledger WHERE amount_kzt IS NOT NULL ORDER BY amount_kzt DESC, tx_id LIMIT 100")
def c8_rank_by(spark, d):
    return analytics.rank_by(ledger(spark, d).select("tx_id", F.col("amount_kzt").cast("double").alias("amount_kzt")), "amount_kzt", 100)


@query(f"""{_L} SELECT tx_id FROM ledger WHERE lower(payer_name) = 'supplier 7' AND trim(receiver_account) = 'KZ000000000000000011' OR lower(payer_name) = 'supplier 7' AND receiver_iin_bin = '000000000012' OR amount_kzt > 40000000 AND {_CATEGORY} = 'Снятие наличных' AND {_TS} >= TIMESTAMP '1995-01-01' AND {_TS} < TIMESTAMP '1996-01-01'""")
def c2_parties_and_amounts(spark, d):
    x = ledger(spark, d)
    one = filters.apply_filters(x, sender="Supplier 7", recipient="KZ000000000000000011").unionByName(filters.apply_filters(x, sender="supplier 7", recipient="000000000012"))
    big = filters.apply_filters(x, category="Снятие наличных", min_amount=40_000_000.01, max_amount=1e12, date_from=date(1995, 1, 1), date_to=date(1995, 12, 31))
    return one.unionByName(big).select("tx_id").distinct()


_CASH_IN = "(contains(purpose_text, 'пополн') OR contains(purpose_text, 'Пополн') OR contains(operation_type_raw, 'кредит'))"


@query(f"""{_L}, p AS (SELECT receiver_name AS name, receiver_iin_bin AS iin_bin, receiver_account AS account, amount_credit AS amount FROM ledger WHERE amount_credit > 0 AND {_CASH_IN})
  SELECT {_key("name")} AS key, {_MONEY("amount")} AS amount, count(*) AS transaction_count FROM p GROUP BY 1 HAVING key IS NOT NULL ORDER BY amount DESC, key LIMIT 20""")
def e11_cash_deposits(spark, d):
    return analytics.cash_top(ledger(spark, d), "deposit", 20).select("key", "amount", "transaction_count")


@query(f"""{_L}, p AS (SELECT receiver_name AS name, receiver_iin_bin AS iin_bin, receiver_account AS account, amount_credit AS amount FROM ledger WHERE amount_credit > 0), t AS (SELECT {_MONEY("amount")} AS total FROM p),
  g AS (SELECT {_key("name")} AS key, {_MONEY("amount")} AS amount, count(*) AS transaction_count FROM p GROUP BY 1) SELECT g.*, round(amount / total * 100, 2) AS percentage FROM g, t WHERE key IS NOT NULL ORDER BY amount DESC, key LIMIT 25""")
def e7_top_income(spark, d):
    return analytics.top_expenses(ledger(spark, d), "credit", 25).select("key", "amount", "transaction_count", "percentage")


# --- D, G: joins and duplicates ------------------------------------------------------------------------------
@query(f"{_L} SELECT tx_id, CASE WHEN currency = 'USD' THEN concat('user', file_id, '@bank') END AS uploaded_by_email FROM ledger")
def d2_with_uploader(spark, d):
    x = ledger(spark, d)
    return sinks.with_uploader(x, x.filter("currency = 'USD'").select("tx_id", F.concat(F.lit("user"), "file_id", F.lit("@bank")).alias("uploaded_by_email"))).select("tx_id", "uploaded_by_email")


@query(f"{_L} SELECT tx_id FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM ledger e WHERE e.direction = 'credit' AND e.project_id = l.project_id AND e.statement_id = l.statement_id)")
def d4_new_rows(spark, d):
    x = ledger(spark, d).withColumn("row_hash", F.col("statement_id"))
    return sinks.new_rows_only(x, x.filter("direction = 'credit'").select("project_id", "row_hash")).select("tx_id")


@query(f"""{_L}, q AS (SELECT *, {_QUALITY} AS quality FROM ledger), r AS (SELECT *, row_number() OVER (PARTITION BY statement_id, direction ORDER BY quality DESC, tx_id) AS n, count(*) OVER (PARTITION BY statement_id, direction) AS copies FROM q)
  SELECT statement_id, direction, tx_id, quality, copies FROM r WHERE n = 1""")
def g2_best_of_duplicates(spark, d):
    """Payments of one statement and direction stand for duplicates of one another."""
    return duplicates.best_quality(ledger(spark, d), ["statement_id", "direction"]).select("statement_id", "direction", "tx_id", "quality", "copies")


# --- H: lists and drill-downs --------------------------------------------------------------------------------
@query(f"{_I} SELECT registration_number FROM invoices ORDER BY total_amount DESC NULLS LAST, coalesce(turnover_date, issue_date) DESC NULLS LAST, registration_number LIMIT 200")
def h2_invoice_sort(spark, d):
    return invoice_rows(spark, d).orderBy(*invoices.invoice_sort("total_amount")).limit(200).select("registration_number")


_H1 = {"category": f"lower({_CATEGORY})", "purpose": "lower(purpose_text)", "sender": "lower(payer_name)", "currency": "CASE WHEN currency = 'KZT' THEN 0 ELSE 1 END DESC, lower(currency)", "amount": "amount_kzt", "type": "lower(operation_type_raw)"}


@query(f"{_L} " + " UNION ALL ".join(f"(SELECT '{k}' AS sort, tx_id FROM ledger ORDER BY {v} DESC NULLS LAST, {_TS} DESC NULLS LAST, tx_id DESC LIMIT 40)" for k, v in _H1.items()))
def h1_sorts(spark, d):
    """The first page by each of several sorts. What the sorts read is joined and written once."""
    read = ["tx_id", "operation_ts", "operation_date", "transaction_category", "sdp_name", "purpose_text", "operation_type_raw", "direction", "payer_name", "currency", "amount_kzt"]
    x, out = runtime.cut(ledger(spark, d).select(*read)), None
    for k in _H1:
        part = analytics.page(x, 1, 40, analytics.sort_keys(k)).select(F.lit(k).alias("sort"), "tx_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{_L} SELECT count(*) AS total, CAST(ceil(count(*) / 500) AS BIGINT) AS total_pages FROM ledger")
def h3_total_pages(spark, d):
    return analytics.total_pages(ledger(spark, d), 500)


@query(f"{_L} SELECT {_DETAIL} FROM ledger WHERE {_key('name', 'payer_name', 'payer_iin_bin', 'payer_account')} = 'iin:900000000007' ORDER BY {_TS} DESC, tx_id DESC LIMIT 50")
def h5_drill_payer(spark, d):
    return analytics.drill_party(ledger(spark, d), "payer", "iin:900000000007")


@query(f"{_L} SELECT {_DETAIL} FROM ledger WHERE (contains(lower(purpose_text), 'cash') OR contains(lower(purpose_text), 'atm') OR contains(purpose_text, 'налич') OR contains(operation_type_raw, 'исх.док')) AND {_key('name', 'payer_name', 'payer_iin_bin', 'payer_account')} = 'iin:900000000007' ORDER BY {_TS} DESC, tx_id DESC LIMIT 50")
def h6_drill_cash(spark, d):
    return analytics.drill_cash(ledger(spark, d), "withdrawal", "iin:900000000007")


@query(f"{_L}, {_EDGES}, top AS (SELECT source, target FROM e ORDER BY tx_count DESC, source, target LIMIT 1) SELECT {_DETAIL} FROM ledger, top WHERE least(payer_iin_bin, receiver_iin_bin) = source AND greatest(payer_iin_bin, receiver_iin_bin) = target ORDER BY {_TS} DESC, tx_id DESC LIMIT 50")
def h8_drill_edge(spark, d):
    x = ledger(spark, d)
    a, b = graph.edges(x).orderBy(F.desc("tx_count"), "source", "target").select("source", "target").first() or ("", "")
    return analytics.drill_edge(x, b, a)


@query(f"{_L} SELECT tx_id FROM ledger ORDER BY tx_id LIMIT 1000")
def h9_capped(spark, d):
    return analytics.capped(ledger(spark, d).select("tx_id").orderBy("tx_id"), 5000)


# --- J: graph ----------------------------------------------------------------------------------------------
@query(f"""WITH RECURSIVE ledger AS ({LEDGER_SQL}), {_EDGES}, b AS (SELECT source AS node, target AS other, amount FROM e UNION ALL SELECT target, source, amount FROM e), k AS (SELECT node, other FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY amount DESC, other) AS n FROM b) WHERE n <= 6),
  w AS (SELECT '900000000001' AS id, 0 AS level UNION SELECT k.other, w.level + 1 FROM w JOIN k ON k.node = w.id WHERE w.level < 2), f AS (SELECT DISTINCT id FROM w WHERE level < 2)
  SELECT DISTINCT e.source, e.target, e.amount, e.tx_count FROM f JOIN k ON k.node = f.id JOIN e ON e.source = least(k.node, k.other) AND e.target = greatest(k.node, k.other)""")
def j2_neighbourhood_edges(spark, d):
    return graph.neighbourhood(graph.edges(ledger(spark, d)), "900000000001", 2, 6)[1]


# --- K, L: vectors -------------------------------------------------------------------------------------------
_DOTS = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i]))"
_LEN = "sqrt(list_sum(list_transform({0}.embedding, lambda x: CAST(x AS DOUBLE) * x)))"


@query(f"""WITH l AS (SELECT label, min(vec_id) AS first FROM embeddings GROUP BY 1), b0 AS (SELECT l.label, e.embedding FROM l JOIN embeddings e ON e.vec_id = l.first), p AS (SELECT a.vec_id, b.label, {_DOTS} / ({_LEN.format("a")} * {_LEN.format("b")}) AS score FROM embeddings a, b0 b),
  m AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label DESC) AS n FROM p)
  SELECT CAST(vec_id AS VARCHAR) AS tx_id, CASE WHEN vec_id % 3 = 0 THEN 'SALARY' WHEN score >= 0.35 THEN concat('L', label) ELSE 'OTHER' END AS category, CASE WHEN vec_id % 3 = 0 THEN 'rule' WHEN score >= 0.35 THEN 'vector' ELSE 'other' END AS source FROM m WHERE n = 1""")
def k3_vector_fallback(spark, d):
    """Rows of every third id have a rule; the others take the label of the nearest label vector."""
    e = embeddings(spark, d)
    labels = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.concat(F.lit("L"), "label").alias("label"), "embedding")
    has = F.col("vec_id") % 3 == 0
    rows = e.select(F.col("vec_id").cast("string").alias("tx_id"), F.col("embedding").alias("semantic_embedding"), F.when(has, "SALARY").otherwise("OTHER").alias("transaction_category"), F.when(has, "rule").otherwise("other").alias("category_source"), F.lit(1.0).alias("category_confidence"), F.lit("x").alias("category_rule_id"), F.lit(False).alias("needs_review"))
    return classify.classify_vectors(rows, labels).select("tx_id", F.col("transaction_category").alias("category"), F.col("category_source").alias("source"))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(q.embedding[i] AS DOUBLE) - c.embedding[i]) * (CAST(q.embedding[i] AS DOUBLE) - c.embedding[i])))) AS distance FROM q, embeddings c WHERE c.label % 2 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5""")
def l4_filtered_knn(spark, d):
    e = embeddings(spark, d)
    return vectors.knn(e.filter("vec_id % 50 = 0"), e, 5, where=F.col("label") % 2 == 0).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"{_L} SELECT tx_id, concat_ws(' | ', nullif(trim(operation_type_raw), ''), nullif(trim(purpose_text), '')) AS semantic_text FROM ledger WHERE direction = 'debit' ORDER BY tx_id LIMIT 500")
def l5_semantic_backfill(spark, d):
    done = F.col("direction") == "credit"
    x = ledger(spark, d).withColumns({"semantic_text": F.when(done, "there"), "semantic_embedding": F.when(done, F.array(F.lit(1.0)))})
    return vectors.semantic_backfill(x, 500).select("tx_id", "semantic_text")


# --- A: sources and sinks --------------------------------------------------------------------------------------
@query(f"{_I} SELECT project, year, count(*) AS n, {_MONEY('total_amount')} AS total_amount, {_MONEY('vat_amount')} AS vat_amount, {_MONEY('quantity')} AS quantity, min(supplier_iin_bin) AS supplier FROM (SELECT *, 'шт' AS project FROM invoices) GROUP BY 1, 2")
def a2_invoice_csv(spark, d):
    """Writes the invoices as positional files with a title and a header line each, and reads them back."""
    x, path = invoice_rows(spark, d), runtime.shared_dir(spark)
    value = lambda c: F.date_format(c, "dd.MM.yyyy") if c.endswith("date") else F.translate(F.col(c).cast("string"), ".", ",") if c in ("total_amount", "vat_amount", "quantity") else F.col(c).cast("string")
    cells = [F.concat(F.lit('"'), F.coalesce(F.replace(value(c), F.lit('"'), F.lit('""')) if c in x.columns else F.lit(""), F.lit("")), F.lit('"')) for c in readers.INVOICE_COLUMNS]
    head = F.lit(";".join(["Регистрационный номер ЭСФ", "Код", "Статус ЭСФ", *map(str, range(len(readers.INVOICE_COLUMNS) - 3))]))
    part = F.pmod(F.xxhash64("registration_number"), F.lit(8)).cast("int")
    heads = spark.range(8).select(F.col("id").cast("int").alias("part"), F.posexplode(F.array(F.lit("Отчёт"), head)).alias("at", "value"))
    lines = x.select(part.alias("part"), F.lit(2).alias("at"), F.concat_ws(";", *cells).alias("value")).unionByName(heads)
    lines.repartition("part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(path)  # a file a part, each with its title and header
    back = readers.read_invoice_csv(spark, path)
    return back.groupBy(F.col("unit").alias("project"), "year").agg(F.count("*").alias("n"), analytics.money("total_amount").alias("total_amount"), analytics.money("vat_amount").alias("vat_amount"), analytics.money("quantity").alias("quantity"), F.min("supplier_iin_bin").alias("supplier"))


@query(f"{_L} SELECT source_bank, count(*) AS rows, count(DISTINCT tx_id) AS payments FROM ledger GROUP BY 1")
def a4_statement_files(spark, d):
    """The ledger as statement files, a folder a bank, read back as cells."""
    path = runtime.shared_dir(spark)
    ledger(spark, d).select("source_bank", "tx_id", "currency", "purpose_text").write.partitionBy("source_bank").option("header", True).option("sep", ";").csv(path)
    cells, _ = readers.read_statements(spark, path)
    rows = cells.filter("row_no > 0 and col_no = 0").groupBy(F.regexp_extract("source_bank", "=(.*)", 1).alias("source_bank"))
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("value").alias("payments")).withColumn("source_bank", F.url_decode("source_bank"))


@query(f"""{_L}, v AS (SELECT file_id, 'operation_type_raw' AS "column", operation_type_raw AS value, tx_id FROM ledger UNION ALL SELECT file_id, 'source_bank', source_bank, tx_id FROM ledger), r AS (SELECT *, row_number() OVER (PARTITION BY file_id, "column" ORDER BY tx_id) AS n FROM v WHERE value IS NOT NULL)
  SELECT file_id, "column", "column" AS column_norm, string_agg(value, ';' ORDER BY n) AS samples, 'new' AS status FROM r WHERE n <= 5 GROUP BY 1, 2""")
def a10_discovery_log(spark, d):
    return sinks.discovery_log(ledger(spark, d), ["operation_type_raw", "source_bank"], order="tx_id").withColumn("samples", F.array_join("samples", ";"))


@query(f"""{_I} SELECT registration_number AS "Регистрационный номер", supplier_name AS "Поставщик", buyer_iin_bin AS "ИИН/БИН получателя", CAST(total_amount AS DOUBLE) AS "Итого" FROM invoices""")
def a12_export_invoices(spark, d):
    x = invoice_rows(spark, d).withColumn("esf_status", F.lit("DELIVERED"))
    return sinks.export_invoices(x).select("Регистрационный номер", "Поставщик", "ИИН/БИН получателя", F.col("Итого").cast("double").alias("Итого"))


@query(f"""{_L} SELECT strftime({_TS}, '%d.%m.%Y %H:%M') AS "Дата", CASE WHEN {_unknown("payer_name")} THEN trim(payer_account) ELSE trim(payer_name) END AS "Отправитель", payer_iin_bin AS "ИИН/БИН отправителя", receiver_account AS "Счёт получателя", {_CATEGORY} AS "Категория", purpose_text AS "Назначение", currency AS "Валюта", CAST(amount_kzt AS DOUBLE) AS "Сумма в тенге", source_bank AS "Банк" FROM ledger""")
def a11_export_columns(spark, d):
    out = sinks.export_ledger(ledger(spark, d))
    return out.select("Дата", "Отправитель", "ИИН/БИН отправителя", "Счёт получателя", "Категория", "Назначение", "Валюта", F.col("Сумма в тенге").cast("double").alias("Сумма в тенге"), "Банк")


@query(f"{_L} SELECT file_id, max(operation_ts) AS uploaded_at FROM ledger WHERE project_id = 'ASIA' GROUP BY 1")
def a13_list_files(spark, d):
    files = ledger(spark, d).groupBy("project_id", "file_id").agg(F.max("operation_ts").alias("uploaded_at"))
    return sinks.list_files(files, "ASIA").select("file_id", "uploaded_at")


@query("SELECT CAST(event_id AS BIGINT) AS id, ts AS created_at FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50")
def a13_query_log(spark, d):
    log = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.col("event_type").alias("project_id"), F.col("ts").alias("created_at"))
    return sinks.list_query_log(log, "purchase", 50).select("id", "created_at")


@query(f"""{_L}, f AS (SELECT DISTINCT project_id, file_id FROM ledger) SELECT 'ledger' AS name, count(*) AS n FROM ledger WHERE project_id <> 'ASIA' UNION ALL SELECT 'files', count(*) FROM f WHERE project_id <> 'ASIA' UNION ALL SELECT 'embeddings', count(*) FROM ledger WHERE project_id <> 'ASIA'
  UNION ALL SELECT 'statements', count(DISTINCT statement_id) FROM ledger WHERE file_id NOT IN (SELECT file_id FROM f WHERE project_id = 'ASIA')""")
def a14_purge_tables(spark, d):
    """All kinds of tables: those that name the project, those of its payments, those of its files."""
    x = ledger(spark, d)
    tables = {"ledger": x, "files": x.select("project_id", "file_id").distinct(), "embeddings": x.select("tx_id"), "statements": x.select("statement_id", "file_id").distinct()}
    out = None
    for name, left in sinks.purge_project(tables, "ASIA").items():
        part = left.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


#: Projects as they come in: none, an empty name, a name with a slash.
_ODD = "CASE project_id WHEN 'AFRICA' THEN NULL WHEN 'ASIA' THEN '' WHEN 'EUROPE' THEN 'a/b' ELSE project_id END"


def _stored_batches(spark, d):
    """Two batches by statement: the first has credits, the second all, with no category for every third one."""
    x = ledger(spark, d).withColumn("project_id", F.expr(_ODD)).withColumn("row_hash", F.col("statement_id"))
    one = x.filter("direction = 'credit'").groupBy("project_id", "row_hash").agg(F.min("tx_id").alias("tx_id")).withColumn("transaction_category", F.lit("OLD")).withColumn("needs_review", F.lit(True))
    two = x.groupBy("project_id", "row_hash").agg(F.max("tx_id").alias("tx_id")).withColumn("transaction_category", F.when(F.col("row_hash").cast("long") % 3 != 0, "NEW")).withColumn("needs_review", F.lit(None).cast("boolean"))
    return one, two


_STORED = f"""{_L}, x AS (SELECT {_ODD} AS project_id, statement_id AS row_hash, tx_id, direction FROM ledger), o AS (SELECT project_id, row_hash, min(tx_id) AS tx_id FROM x WHERE direction = 'credit' GROUP BY 1, 2), n AS (SELECT project_id, row_hash, max(tx_id) AS tx_id FROM x GROUP BY 1, 2),
  stored AS (SELECT n.project_id, n.row_hash, coalesce(o.tx_id, n.tx_id) AS tx_id, CASE WHEN CAST(n.row_hash AS BIGINT) % 3 <> 0 THEN 'NEW' END AS transaction_category, CAST(NULL AS BOOLEAN) AS needs_review FROM n LEFT JOIN o ON n.project_id IS NOT DISTINCT FROM o.project_id AND n.row_hash = o.row_hash)"""


@query(f"{_STORED} SELECT coalesce(project_id, '<none>') AS project, row_hash, tx_id, transaction_category, needs_review IS NULL AS unseen FROM stored")
def a7_stored_upsert(spark, d):
    """Batches upserted into a stored table, nulls as the batch has them, and its last version read."""
    path = runtime.shared_dir(spark)
    for batch in _stored_batches(spark, d):
        sinks.upsert_stored(batch, path)
    return versions.read(spark, path).select(F.coalesce("project_id", F.lit("<none>")).alias("project"), "row_hash", "tx_id", "transaction_category", F.col("needs_review").isNull().alias("unseen"))


@query(f"""{_STORED} SELECT 'ledger' AS name, coalesce(project_id, '<none>') AS project, count(*) AS n FROM stored WHERE project_id <> '' OR project_id IS NULL GROUP BY 2
  UNION ALL SELECT 'ext', '', count(*) FROM stored WHERE project_id <> '' OR project_id IS NULL""")
def a14_purge_stored(spark, d):
    """The project of the empty name purged from a stored ledger and from the table that hangs on its payments; that of no name stays."""
    paths = {name: runtime.shared_dir(spark) for name in ("ledger", "ext")}
    for batch in _stored_batches(spark, d):
        sinks.upsert_stored(batch, paths["ledger"])
    versions.append_new(versions.read(spark, paths["ledger"]).select("tx_id"), paths["ext"], None, ["tx_id"])
    sinks.purge_stored(spark, paths, "")
    left = versions.read(spark, paths["ledger"]).groupBy(F.coalesce("project_id", F.lit("<none>")).alias("project")).agg(F.count("*").alias("n")).select(F.lit("ledger").alias("name"), "project", "n")
    return left.unionByName(versions.read(spark, paths["ext"]).agg(F.count("*").alias("n")).select(F.lit("ext").alias("name"), F.lit("").alias("project"), "n"))


# --- M: sheets ---------------------------------------------------------------------------------------------------
@query(f"{_L} SELECT file_id, 'total_credit' AS field, CAST(sum(amount_credit) AS DOUBLE) AS value FROM ledger GROUP BY 1")
def m7_footers(spark, d):
    return sheets.footers(fixtures.dealt_cells(spark, d)).select("file_id", "field", "value")


@query(f"""{_L}, f AS (SELECT DISTINCT file_id, CAST(file_id AS BIGINT) AS k FROM ledger) SELECT file_id, 'клиент' AS key, concat('Client ', file_id) AS value FROM f UNION ALL SELECT file_id, 'иин/бин', lpad(file_id, 12, '0') FROM f
  UNION ALL SELECT file_id, 'iban', CASE WHEN k % 2 = 0 THEN concat('KZ', lpad(file_id, 18, '1')) ELSE concat('KZ', lpad(file_id, 18, '2')) END FROM f UNION ALL SELECT file_id, 'opening_balance', '10,00' FROM f""")
def m6_bank_metadata(spark, d):
    """Metadata by a bank's own rules, 60 rows above the header: values below and beside their labels, and accounts in the text."""
    body = fixtures.cells(fixtures.ledger_by_file(spark, d)).filter("row_no >= 3").withColumn("row_no", F.col("row_no") + 60)
    even = F.col("file_id").cast("long") % 2 == 0
    cell = lambda row, col, value, when=F.lit(True): F.when(when, F.struct(F.lit(row).alias("row_no"), F.lit(col).alias("col_no"), value.alias("value")))
    head = [cell(0, 0, F.lit("Клиент")), cell(1, 0, F.concat(F.lit("Client "), "file_id")), cell(3, 0, F.lit("ИИН/БИН")), cell(3, 2, F.lpad("file_id", 12, "0")), cell(3, 1, F.lit("нет")), cell(5, 1, F.concat(F.lit("KZ "), F.lpad("file_id", 18, "1")), even), cell(7, 0, F.lit("Номер счета"), ~even), cell(7, 1, F.concat(F.lit("KZ"), F.lpad("file_id", 18, "2")), ~even), cell(8, 0, F.lit("Входящий остаток")), cell(8, 1, F.lit("10,00"))]
    own, first = F.array(F.struct("row_no", "col_no", "value")), (F.col("row_no") == 63) & (F.col("col_no") == 0)  # a sheet's first header brings its head along
    sheet = body.select("file_id", "sheet", F.explode(F.when(first, F.concat(own, F.array_compact(F.array(*head)))).otherwise(own)).alias("x")).select("file_id", "sheet", "x.*")
    return sheets.bank_metadata(runtime.cut(sheet), "kaspi").select("file_id", "key", "value")


@query(f"""{_L}, f AS (SELECT DISTINCT file_id, CAST(file_id AS BIGINT) AS k FROM ledger)
  SELECT file_id, CASE WHEN k % 2 = 0 THEN concat('ТОО ', file_id) ELSE '' END AS name, CASE WHEN k % 3 = 0 THEN '860000000000' ELSE lpad(file_id, 12, '0') END AS iin_bin, CASE WHEN k % 5 = 0 THEN concat('KZ', file_id) ELSE '' END AS account FROM f""")
def m9_owner_fallback(spark, d):
    """Owners of sheets: every second one names its client, quoted and two columns on, before its id; every third one has its
    id in scientific notation first; every fifth one has its account after an empty one."""
    sheet = fixtures.cells(fixtures.ledger_by_file(spark, d)).filter("row_no < 60")
    files, k = sheet.select("file_id", "sheet").distinct(), F.col("file_id").cast("long")
    cell = lambda row, col, value, when: F.when(when, F.struct(F.lit(row).alias("row_no"), F.lit(col).alias("col_no"), value.alias("value")))
    head = [cell(0, 0, F.lit("Счёт:"), k % 5 == 0), cell(0, 1, F.lit("  "), k % 5 == 0), cell(1, 0, F.lit("Клиент (БИН)"), k % 2 == 0), cell(1, 2, F.concat(F.lit('"ТОО '), "file_id", F.lit('"')), k % 2 == 0), cell(2, 0, F.lit("ИИН"), k % 3 == 0), cell(2, 3, F.lit("8,6E+11"), k % 3 == 0), cell(2, 0, F.lit("Номер счета"), (k % 5 == 0) & (k % 3 != 0)), cell(2, 1, F.concat(F.lit("KZ"), "file_id"), (k % 5 == 0) & (k % 3 != 0))]
    more = cell(3, 0, F.lit("Номер счета"), (k % 5 == 0) & (k % 3 == 0)), cell(3, 1, F.concat(F.lit("KZ"), "file_id"), (k % 5 == 0) & (k % 3 == 0))
    head = files.select("*", F.explode(F.array_compact(F.array(*head, *more))).alias("x")).select("file_id", "sheet", "x.*")
    sheet = head.unionByName(sheet.withColumn("row_no", F.col("row_no") + 4).select("file_id", "sheet", "row_no", "col_no", "value"))
    return sheets.owner_fallback(sheet).select("file_id", "name", "iin_bin", "account")


@query(f"""{_L}, c AS (SELECT file_id, source_bank AS layout, count(*) FILTER (currency = 'USD') AS rows, length(source_bank) AS priority FROM ledger GROUP BY 1, 2 UNION ALL SELECT file_id, 'generic', count(*), 100 FROM ledger GROUP BY 1)
  SELECT file_id, layout, rows FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY priority, layout) AS n FROM c WHERE rows > 0) WHERE n = 1""")
def m10_adapter_choice(spark, d):
    x = ledger(spark, d)
    own = x.groupBy("file_id", F.col("source_bank").alias("layout")).agg(F.count_if(F.col("currency") == "USD").alias("rows"), F.length("source_bank").alias("priority"))
    other = x.groupBy("file_id").agg(F.count("*").alias("rows")).select("file_id", F.lit("generic").alias("layout"), "rows", F.lit(100).alias("priority"))
    return classify.adapter_choice(own.unionByName(other)).select("file_id", "layout", "rows")


@query(f"""{_L} SELECT file_id, CASE WHEN CAST(file_id AS BIGINT) % 3 = 0 THEN 'halyk' ELSE 'kaspi' END AS layout, count(*) + 1 AS rows, count(*) AS dated FROM ledger GROUP BY 1""")
def m10_layouts(spark, d):
    """Sheets read by the first layout that finds rows: every third file has garbled headers, which only one layout mends. A total's row is among the rows."""
    garbled = F.decode(F.encode(F.col("value"), "UTF-8"), "windows-1251")
    sheet = fixtures.dealt_cells(spark, d, lambda x: x.withColumn("value", F.when((F.col("row_no") == 3) & (F.col("file_id").cast("long") % 3 == 0), garbled).otherwise(F.col("value"))))
    found = sheets.canonical(sheets.by_layout(sheet, dealt=True).withColumn("sheet", F.concat_ws(":", "sheet", "layout")))
    return found.groupBy("file_id", F.split_part("sheet", F.lit(":"), F.lit(2)).alias("layout")).agg(F.count("*").alias("rows"), F.count(dates.parse_datetime(F.col("operation_ts"))).alias("dated"))


# --- K, E: backfill and description ------------------------------------------------------------------------------
@query(f"""WITH k AS ({SQL['k1_rules']}), l AS ({LEDGER_SQL}) SELECT l.tx_id, CASE WHEN direction = 'credit' THEN k.category ELSE 'KEPT' END AS category,
  CASE WHEN direction = 'credit' THEN CASE WHEN k.rule_id = 'DEFAULT_OTHER' THEN 'other' ELSE 'rule' END ELSE 'manual' END AS source FROM l JOIN k ON l.tx_id = k.tx_id""")
def k5_backfill(spark, d):
    """Payments of no category meet the rules again and are written back by the upsert; the others keep theirs."""
    credit = F.col("direction") == "credit"
    stored = ledger(spark, d).withColumns({
        "row_hash": F.col("tx_id"), "transaction_category": F.when(credit, "OTHER").otherwise("KEPT"), "category_confidence": F.lit(1.0), "category_source": F.when(credit, "other").otherwise("manual"),
        "category_rule_id": F.lit(None).cast("string"), "needs_review": credit,
    })
    changed = classify.reclassify(stored).filter(credit).select(*sinks.KEY, *(c for c in sinks.RENEWED if c in stored.columns))  # known payments take nothing else of a batch
    return sinks.upsert_ledger(stored, changed).select("tx_id", F.col("transaction_category").alias("category"), F.col("category_source").alias("source"))


_DESCRIBED = lambda c: f"SELECT '{c}' AS \"column\", CAST(sum(n) AS BIGINT) AS count, count(*) AS distinct_values, (SELECT {c} FROM (SELECT {c}, count(*) AS n FROM ledger WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, encode({c}) LIMIT 1) AS top, max(n) AS freq FROM (SELECT {c}, count(*) AS n FROM ledger WHERE {c} IS NOT NULL GROUP BY 1)"


@query(f"{_L} {_DESCRIBED('purpose_text')} UNION ALL {_DESCRIBED('currency')} UNION ALL {_DESCRIBED('payer_name')}")
def e21_describe(spark, d):
    return analytics.profile(ledger(spark, d), ["purpose_text", "currency", "payer_name"]).select("column", "count", F.col("distinct").alias("distinct_values"), "top", "freq")


# --- H: one account of a party -----------------------------------------------------------------------------------
@query(f"""{_L} SELECT {_DETAIL} FROM ledger WHERE ({_key('name', 'payer_name', 'payer_iin_bin', 'payer_account')} = 'iin:000000000010' OR {_key('name', 'receiver_name', 'receiver_iin_bin', 'receiver_account')} = 'iin:000000000010')
  AND 'KZ900000000000000006' IN (payer_account, receiver_account) ORDER BY {_TS} DESC, tx_id DESC LIMIT 50""")
def h7_drill_account(spark, d):
    return analytics.drill_party(ledger(spark, d), "any", "iin:000000000010", account="KZ900000000000000006")
