"""Sinks and upserts: keyed merges, overflow and discovery columns, exports, project purge, import report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import display_name, norm_text
from ..operators.filters import category_of, effective
from . import versions

KEY = ["project_id", "row_hash"]
#: The columns that a replayed row may renew.
RENEWED = ["semantic_text", "semantic_embedding", "transaction_category", "category_confidence", "category_source", "category_rule_id", "needs_review"]


def upsert_ledger(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Existing rows keep all but RENEWED, which a replay overwrites, with nulls too; new keys are added whole.

    Of rows with the same key the first of the batch counts. Null is a key like others.
    """
    old, new = existing.withColumn("_old", F.lit(True)).alias("o"), versions.first_rows(batch, KEY).withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, F.col("o.project_id").eqNullSafe(F.col("n.project_id")) & F.col("o.row_hash").eqNullSafe(F.col("n.row_hash")), "full_outer")
    known, met = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()
    cols = []
    for c in existing.columns:
        if c not in batch.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif c in RENEWED:
            cols.append(F.when(met, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return joined.select(*cols)


def insert_ignore(existing: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Keep-first insert: the first row of a key, unless the key is known."""
    return existing.unionByName(versions.first_rows(batch, key).join(existing.select(*key), key, "left_anti").select(*existing.columns))


def new_rows_only(batch: DataFrame, existing: DataFrame) -> DataFrame:
    return batch.join(existing.select(*KEY).distinct(), KEY, "left_anti")


def upsert_stored(batch: DataFrame, path: str) -> versions.Version | None:
    """upsert_ledger on a table that is published by version, partitioned by project."""
    return versions.upsert(batch, path, "project_id", KEY, upsert_ledger, RENEWED)


def pack_overflow(df: DataFrame, mapped: list[str], key: str = "tx_id") -> DataFrame:
    """Non-null unmapped columns of each row as a map, where there are any."""
    rest = [c for c in df.columns if c not in mapped and c != key]
    pairs = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*(F.col(c).cast("string") for c in rest)))
    return df.select(key, F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("ext")).filter(F.size("ext") > 0)


def discovery_log(df: DataFrame, unmapped: list[str], file_id: str = "file_id", order: str = "source_row_no") -> DataFrame:
    """A row for each unmapped column of a file: normal name, its first five values, status."""
    long = df.select(file_id, order, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in unmapped))).alias("x")).select(file_id, order, "x.*").filter("value is not null")
    first = long.withColumn("_n", F.row_number().over(Window.partitionBy(file_id, "column").orderBy(order))).filter("_n <= 5")
    out = first.groupBy(file_id, "column").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda s: s["value"]).alias("samples"))  # five entries
    return out.select(file_id, "column", norm_text(F.col("column")).alias("column_norm"), "samples", F.lit("new").alias("status"))


def export_ledger(df: DataFrame) -> DataFrame:
    """Fifteen labelled columns, newest first."""
    day = F.date_format(effective(), "dd.MM.yyyy HH:mm")
    out = df.orderBy(effective().desc_nulls_last(), F.desc("tx_id"))
    return out.select(
        day.alias("Дата"), display_name(F.col("payer_name"), F.col("payer_account")).alias("Отправитель"), F.col("payer_iin_bin").alias("ИИН/БИН отправителя"), F.col("payer_account").alias("Счёт отправителя"),
        display_name(F.col("receiver_name"), F.col("receiver_account")).alias("Получатель"), F.col("receiver_iin_bin").alias("ИИН/БИН получателя"), F.col("receiver_account").alias("Счёт получателя"), category_of().alias("Категория"),
        F.col("operation_type_raw").alias("Тип операции"), F.col("purpose_text").alias("Назначение"), F.col("currency").alias("Валюта"), F.col("amount_debit").alias("Дебет"), F.col("amount_credit").alias("Кредит"), F.col("amount_kzt").alias("Сумма в тенге"), F.col("source_bank").alias("Банк"),
    )


def export_invoices(df: DataFrame) -> DataFrame:
    out = df.orderBy(F.coalesce("turnover_date", "issue_date").desc_nulls_last(), "registration_number")
    names = {"registration_number": "Регистрационный номер", "esf_status": "Статус", "issue_date": "Дата выписки", "turnover_date": "Дата оборота", "supplier_iin_bin": "ИИН/БИН поставщика", "supplier_name": "Поставщик", "buyer_iin_bin": "ИИН/БИН получателя", "buyer_name": "Получатель", "contract_number": "Договор", "tru_name": "Товары", "unit": "Единица", "quantity": "Количество", "vat_amount": "НДС", "total_amount": "Итого"}
    return out.select(*(F.col(k).alias(v) for k, v in names.items()))


def list_files(files: DataFrame, project_id: str) -> DataFrame:
    return files.filter(F.col("project_id") == project_id).orderBy(F.desc("uploaded_at"), "file_id")


def list_query_log(log: DataFrame, project_id: str, limit: int = 50) -> DataFrame:
    return log.filter(F.col("project_id") == project_id).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def purge_project(tables: dict[str, DataFrame], project_id: str) -> dict[str, DataFrame]:
    """All tables without a project: those that name it by filter, those that hang on its payments or files by anti-join."""
    tx = tables["ledger"].filter(F.col("project_id") == project_id).select("tx_id")
    files = tables["files"].filter(F.col("project_id") == project_id).select("file_id") if "files" in tables else None
    out = {}
    for name, df in tables.items():
        if "project_id" in df.columns:
            out[name] = df.filter(~F.col("project_id").eqNullSafe(F.lit(project_id)))
        elif "tx_id" in df.columns:
            out[name] = df.join(tx, "tx_id", "left_anti")
        elif "file_id" in df.columns and files is not None:
            out[name] = df.join(files, "file_id", "left_anti")
        else:
            out[name] = df
    return out


def purge_stored(spark: SparkSession, tables: dict[str, str], project_id: str | None) -> dict[str, int | None]:
    """Removes a project from stored tables (name: path), each by a version of its own; the new numbers by name.

    Tables that hang on payments or files come first, while those still name the project, so a purge that broke off is
    finished by another. Of tables by project a partition is unlisted; of the others, folders with its rows are rewritten.
    """
    held = {name: versions.latest(spark, path) for name, path in tables.items()}
    held = {name: v for name, v in held.items() if v}
    mine = versions.key(project_id)
    own = lambda name, col: versions.read(spark, tables[name], [mine], held[name]).select(col)
    out = {}
    for name, v in held.items():
        if v.by == "project_id":
            continue
        if "project_id" in v.schema.names:
            done = versions.delete_matching(spark, tables[name], versions.read(spark, tables[name], None, v).filter(F.col("project_id").eqNullSafe(F.lit(project_id))), ["project_id"]) if project_id is not None else v
        elif "tx_id" in v.schema.names and "ledger" in held:
            done = versions.delete_matching(spark, tables[name], own("ledger", "tx_id"), ["tx_id"])
        elif "file_id" in v.schema.names and "files" in held:
            done = versions.delete_matching(spark, tables[name], own("files", "file_id"), ["file_id"])
        else:
            continue
        out[name] = done and done.number
    for name, v in held.items():
        if v.by == "project_id":
            done = versions.drop_keys(spark, tables[name], [mine])
            out[name] = done and done.number
    return out


def import_report(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: rows read, bad, duplicates within the batch, already present, inserted. batch has `skipped` and KEY."""
    seen = existing.select(*KEY).distinct().withColumn("_known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("skipped", *KEY).orderBy("source_row_no"))
    tagged = batch.withColumn("_n", first).join(seen, KEY, "left")
    good, known = ~F.col("skipped"), F.col("_known").isNotNull()
    counts = tagged.agg(F.count("*").alias("total"), F.count_if(~good).alias("bad_rows"), F.count_if(good & (F.col("_n") > 1)).alias("duplicates"), F.count_if(good & (F.col("_n") == 1) & known).alias("existing"), F.count_if(good & (F.col("_n") == 1) & ~known).alias("inserted"))
    return counts.withColumn("skipped", F.col("bad_rows") + F.col("duplicates") + F.col("existing"))


def create_views(spark: SparkSession, ledger: DataFrame, statements: DataFrame) -> None:
    ledger.createOrReplaceTempView("transactions_core")
    ledger_view(ledger, statements).createOrReplaceTempView("transactions_nl_view")


def ledger_view(ledger: DataFrame, statements: DataFrame) -> DataFrame:
    """Ledger with its statement's header, and a text made of eight fields where there is none."""
    from ..functions.text import semantic_text

    head = statements.select("statement_id", "client_name", "client_iin_bin", "account_iban", "period_from", "period_to", "opening_balance", "closing_balance")
    made = semantic_text(*(F.col(c) for c in ("operation_type_raw", "sdp_name", "purpose_code", "purpose_text", "raw_note", "payer_name", "receiver_name", "transaction_category")))
    return ledger.join(head, "statement_id", "left").withColumn("semantic_text", F.coalesce(F.nullif(F.trim("semantic_text"), F.lit("")), made))


def with_uploader(ledger: DataFrame, upload_meta: DataFrame) -> DataFrame:
    return ledger.join(upload_meta.select("tx_id", "uploaded_by_email"), "tx_id", "left")
