"""Sources: ledger and invoice files, cell tables, statement folders, file registry, encodings."""

from __future__ import annotations

import csv
import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, ids, numbers
from ..functions.text import clean_optional_text
from ..plans.runtime import cut

CELLS = "file_id string, sheet string, row_no int, col_no int, value string"

#: The columns of a ledger file, and those of an invoice file by position.
LEDGER_COLUMNS = "operation_ts operation_date direction currency amount_currency amount_kzt amount_debit amount_credit payer_name payer_iin_bin payer_account receiver_name receiver_iin_bin receiver_account purpose_text raw_note operation_type_raw sdp_name".split()
INVOICE_COLUMNS = (
    "registration_number tax_authority_code esf_status issue_date turnover_date year supplier_iin_bin supplier_name supplier_address buyer_iin_bin buyer_name buyer_address country_code "
    "consignor_iin_bin consignor_name ship_from_address consignee_iin_bin consignee_name delivery_address contract_number contract_date payment_terms destination origin_sign tru_name tnved_code unit "
    "quantity price_without_vat price_with_vat cost_without_indirect_tax turnover_amount vat_rate vat_amount cost_with_indirect_tax total_amount currency_rate currency_code currency_name_ru"
).split()
INVOICE_MARKS = ("регистрационный номер эсф", "статус эсф")


def read_ledger_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Header CSV to ledger rows, all of them; `skipped` marks rows without a date or a positive amount."""
    schema = None
    raw = spark.read.csv(path, header=True, sep=delimiter, inferSchema=False, multiLine=False, escape='"', schema=schema)
    col = lambda c: clean_optional_text(F.col(c)) if c in raw.columns else F.lit(None).cast("string")
    money = lambda c: numbers.to_float(col(c))
    currency = F.upper(F.coalesce(col("currency"), F.lit("KZT")))
    kzt = numbers.resolve_amount_kzt(money("amount_kzt"), money("amount_currency"), money("amount_debit"), money("amount_credit"), currency)
    ts = F.coalesce(*(dates.parse_operation_datetime(col(c)) for c in ("operation_ts", "operation_date")))
    direction = F.lower(col("direction"))
    amount = F.when(money("amount_currency") > 0, money("amount_currency")).otherwise(kzt)
    none = (money("amount_debit") == 0) & (money("amount_credit") == 0)
    side = lambda c, d: F.when(none & (direction == d), amount).otherwise(money(c)).cast("decimal(18,2)").alias(c)
    text = [col(c).alias(c) for c in LEDGER_COLUMNS if c.startswith(("payer", "receiver", "purpose", "raw", "operation_type", "sdp"))]
    return raw.select(ts.alias("operation_ts"), ts.cast("date").alias("operation_date"), direction.alias("direction"), currency.alias("currency"), money("amount_currency").cast("decimal(18,2)").alias("amount_currency"), kzt.cast("decimal(18,2)").alias("amount_kzt"), side("amount_debit", "debit"), side("amount_credit", "credit"), *text, (ts.isNull() | (kzt <= 0)).alias("skipped"))


def read_invoice_csv(spark: SparkSession, path: str) -> DataFrame:
    """Invoice export: the header row is found by its marks, columns are named by position, blank rows go.

    Only the header's place within a file is looked up; rows stay split over tasks by file position.
    """
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", F.monotonically_increasing_id())
    low = F.lower("value")
    marked = low.contains(INVOICE_MARKS[0]) & low.contains(INVOICE_MARKS[1])
    count = lambda s: F.length("value") - F.length(F.replace("value", F.lit(s), F.lit("")))
    best = F.greatest(*(count(s) for s in ("\t", ";", ",", "|")))
    sep = F.when(count("\t") == best, "\t").when(count(";") == best, ";").when(count(",") == best, ",").otherwise("|")
    head = lines.filter(marked).groupBy("file").agg(F.min(F.struct("at", sep.alias("sep"))).alias("h")).select("file", F.col("h.at").alias("head_at"), F.col("h.sep").alias("sep"))
    rows = lines.join(F.broadcast(head), "file").filter((F.col("at") > F.col("head_at")) & (F.trim(F.translate("value", ";,|\t", "")) != ""))  # one header a file
    parts = F.expr("split(value, concat('\\\\Q', sep, '\\\\E(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)'), -1)")
    clean = F.transform(parts, lambda x: F.replace(F.regexp_replace(F.trim(x), '^"|"$', ""), F.lit('""'), F.lit('"')))
    named = rows.withColumn("p", clean)
    value = lambda i: clean_optional_text(F.get("p", F.lit(i)))
    typed = []
    for i, c in enumerate(INVOICE_COLUMNS):
        if c in ("issue_date", "turnover_date", "contract_date"):
            typed.append(dates.parse_operation_datetime(value(i), dates.INVOICE_FORMATS).alias(c))
        elif c == "year":
            typed.append(numbers.optional_year(value(i)).alias(c))
        elif c.endswith("iin_bin"):
            typed.append(ids.strip_iin(value(i)).alias(c))
        elif c in ("quantity", "vat_rate", "currency_rate") or c.startswith(("price", "cost", "turnover_amount", "vat_amount", "total")):
            scale = {"quantity": 4, "vat_rate": 4, "currency_rate": 6}.get(c, 2)
            typed.append(numbers.optional_decimal(value(i), scale).cast(f"decimal(18,{scale})").alias(c))
        else:
            typed.append(value(i).alias(c))
    beyond = F.slice("p", len(INVOICE_COLUMNS) + 1, F.greatest(F.size("p") - len(INVOICE_COLUMNS), F.lit(0)))
    extra = F.filter(F.transform(beyond, lambda v, i: F.struct(F.concat(F.lit("extra_"), (i + 1).cast("string")).alias("k"), v.alias("v"))), lambda s: F.coalesce(s["v"], F.lit("")) != "")
    return named.select("file", *typed, F.map_from_entries(extra).alias("extra"))


def read_cells(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(CELLS).format(form).options(header="true").load(path)


def scan_statement_folder(spark: SparkSession, root: str, form: str = "csv") -> DataFrame:
    """All files below root/<bank>/, with the bank's name; files that cannot be read do not stop the run."""
    raw = spark.read.format(form).options(header="true", mode="PERMISSIVE", ignoreCorruptFiles="true", recursiveFileLookup="true").load(root)
    return raw.select("*", F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1).alias("source_bank"), F.col("_metadata.file_path").alias("file_path"))


def register_files(spark: SparkSession, path: str, parser_version: str = "1") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    digest = F.sha2("content", 256)
    return files.select(ids.uuid5(ids.TX_NAMESPACE, digest).alias("file_id"), name.alias("filename"), F.element_at(F.split("path", "/"), -2).alias("source_bank"), digest.alias("sha256"), F.lit(parser_version).alias("parser_version"), F.col("modificationTime").alias("uploaded_at"))


#: Two bytes a character, the high one of Latin, Greek, Cyrillic, punctuation or number signs.
_LITTLE, _BIG = r"(?s)^(?:.[\x00-\x04\x20\x21])++$", r"(?s)^(?:[\x00-\x04\x20\x21].)++$"


def decode_text(content: Column) -> Column:
    """The first of UTF-16 (by mark, or by where its high bytes stand), UTF-8, Windows-1251 and Latin-1 that decodes.

    Text of the other encodings has no bytes from 0 to 4; where such bytes are, and only every other byte is a high one,
    a text without a mark is UTF-16. Needs plans.runtime.configure() for Windows-1251.
    """
    head = F.hex(F.substring(content, 1, 3))
    plain = content.cast("string")
    cyrillic, bytes_ = F.decode(content, "windows-1251"), F.decode(content, "ISO-8859-1")
    wide = bytes_.rlike(r"[\x00-\x04]")
    out = F.when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16")).when(wide & bytes_.rlike(_LITTLE), F.decode(content, "UTF-16LE")).when(wide & bytes_.rlike(_BIG), F.decode(content, "UTF-16BE"))
    return out.when(F.is_valid_utf8(plain), F.regexp_replace(plain, "^\ufeff", "")).when(F.encode(cyrillic, "windows-1251") == content, cyrillic).otherwise(bytes_)


_READ = CELLS + ", source_bank string, reason string"


#: Cells of a file that are in memory at once.
CHUNK = 20_000
_END = r"\n\r\v\f\x1c-\x1e\x85\u2028\u2029"
#: Lines as io.StringIO with newline="" has them, and as str.splitlines.
_LINES, _ALL_LINES = re.compile(r"[^\r\n]*(?:\r\n|[\r\n])|[^\r\n]+"), re.compile(f"[^{_END}]*(?:\r\n|[{_END}])|[^{_END}]+")


def _rows(text: str, mark: str):
    return csv.reader((m.group() for m in _LINES.finditer(text)), delimiter=mark, strict=True)


def _parsed(batches):
    """Cells of decoded files; of a file that has none, one row with the reason.

    A file is read twice, first for errors, so that no more than its text and a chunk of its cells are in memory.
    """
    fields = [c.split() for c in _READ.split(", ")]

    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if t == "int" else pa.string()) for c, (_, t) in zip(zip(*rows), fields)], names=[name for name, _ in fields])

    for batch in batches:
        for n in range(batch.num_rows):
            file, bank, text = (batch.column(c)[n].as_py() for c in ("file_id", "source_bank", "text"))
            why, mark, i, some = None, ";", -1, False
            if not text or text.isspace():
                why = "empty"
            elif "\x00" in text:
                why = "not a text"
            else:
                first = max((m.group() for m in islice(_ALL_LINES.finditer(text), 40)), key=lambda line: max(line.count(d) for d in ";,\t|"), default="")
                mark = max(";,\t|", key=first.count)
                try:
                    for i, row in enumerate(_rows(text, mark)):
                        some = some or any(v.strip() for v in row)
                except csv.Error as e:
                    why = f"row {i + 2}: {e}" if some else f"row 1: {e}"
            if why is not None:
                yield packed([(file, "", None, None, None, bank, why)])
                continue
            cells: list = []
            for i, row in enumerate(_rows(text, mark)):
                cells += [(file, "", i, j, v.strip(), bank, None) for j, v in enumerate(row) if v.strip()]
                if len(cells) >= CHUNK:
                    yield packed(cells)
                    cells = []
            if cells:
                yield packed(cells)


def read_statements(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Delimited statement files below root/<bank>/ as cells, and those that could not be read, with the reason.

    Files in any encoding that decode_text tells; file_id is the path. One bad file keeps no other from being read. Each
    file is read by one task, as it was uploaded. Spark does not list files of no bytes, so these are in neither.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    text = raw.select(F.col("path").alias("file_id"), F.element_at(F.split("path", "/"), -2).alias("source_bank"), decode_text(F.col("content")).alias("text"))
    found = cut(text.mapInArrow(_parsed, _READ))
    cells = found.filter("reason is null").select(*(c.split()[0] for c in CELLS.split(", ")), "source_bank")
    return cells, found.filter("reason is not null").select("file_id", "source_bank", "reason")


def read_counts(cells: DataFrame, rejects: DataFrame) -> DataFrame:
    """Files read, files rejected and rows read of each bank."""
    read = cells.select("source_bank", "file_id", "row_no").distinct().groupBy("source_bank", "file_id").agg(F.count("*").alias("rows")).select("source_bank", F.lit(1).alias("read"), F.lit(0).alias("rejected"), "rows")
    all_ = read.unionByName(rejects.select("source_bank", F.lit(0).alias("read"), F.lit(1).alias("rejected"), F.lit(0).cast("long").alias("rows")))
    return all_.groupBy("source_bank").agg(F.sum("read").alias("files"), F.sum("rejected").alias("rejected"), F.sum("rows").alias("rows"))


def upload_batches(df: DataFrame, order: str = "source_row_no") -> DataFrame:
    """First row of each hash within a batch."""
    w = Window.partitionBy("project_id", "row_hash").orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
