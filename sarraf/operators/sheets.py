"""Statements from cell tables (file_id, sheet, row_no, col_no, value): headers, blocks, rows, metadata.

Everything is a window or a join over cells of one sheet, ordered by row and column numbers, never by file order.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, ids, numbers, parties
from ..functions.text import NULL_WORDS, any_of, clean_optional_text, norm_text, once, repair_mojibake, semantic_text
from ..plans.runtime import bucketed, cut
from . import rules
from .classify import is_header

SHEET = ["file_id", "sheet"]
ROW = [*SHEET, "row_no"]
#: Cells of a bucket, about.
PER_BUCKET = 2_000_000
#: What a text holds of which norm_text leaves something, if it is no word for a missing value; a line of texts one of which may be the number 1.
_SOME, _ONE = r"(?U)[^\s“”\"'\-–—]", r"(?m)^[^0-9\p{L}\n]*0*1[^0-9\p{L}\n]*$"


class Layout(NamedTuple):
    """How header rows look: at least so many of the words, so many filled cells; whether two-row headers occur and garbled text is mended."""

    name: str
    words: list[str]
    least: int
    filled: int
    grouped: bool = True
    repaired: bool = False


UNIVERSAL = Layout("universal", rules.HEADER_KEYWORDS, 3, 6)
#: Layouts in the order in which they are tried. Blocks of under three columns go, so a header fills three cells.
LAYOUTS = [Layout("kaspi", rules.KASPI_MARKS, 2, 3), Layout("halyk", rules.HALYK_MARKS, 1, 3, grouped=False, repaired=True), UNIVERSAL]


def deal(cells: DataFrame) -> DataFrame:
    """Cells stored in buckets of whole files: what reads them, as often as it may, shuffles no cell again."""
    return bucketed(cells, buckets(cells.sparkSession, cells.count()), "file_id")


def buckets(spark: SparkSession, cells: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + cells // PER_BUCKET)


def lines(cells: DataFrame) -> DataFrame:
    """A row for each sheet row with its cells by column, (col_no, value), and how many of them are filled."""
    some = F.col("value").rlike(_SOME) & ~F.lower(F.trim("value")).isin(NULL_WORDS)
    x = cells.select(*ROW, F.struct("col_no", "value").alias("c"), some.alias("some"))
    return x.groupBy(*ROW).agg(F.array_sort(F.collect_list("c")).alias("cells"), F.count_if("some").alias("filled"))  # one entry a cell of the row


def rows(cells: DataFrame, layout: Layout = UNIVERSAL) -> DataFrame:
    """The lines of a sheet with filled cells, and whether a line is a header, a grouped header, its second row or a row of column numbers.

    Only lines that hold the first words of enough names, or a cell that may be a 1, are normalised; no other can be any of these.
    """
    keys = sorted({k.lower() for k in layout.words})
    raw = F.translate(F.lower(F.array_join("cells.value", "\n")), "“”\"'", "")
    held = lambda words: sum((F.when(F.col("raw").contains(re.split("[ /:]", w)[0]), 1).otherwise(0) for w in words), F.lit(0))
    may = any_of(held(keys) >= layout.least, held(rules.GROUP_HEADERS) == len(rules.GROUP_HEADERS), held(rules.SUBHEADERS) >= 3, F.col("raw").rlike(_ONE))
    x = lines(cells).select("*", F.explode(F.array(raw)).alias("raw"))  # so that it is joined once a line
    x = x.withColumn("norms", F.when(may, F.transform("cells.value", norm_text))).drop("raw")
    x = x.withColumn("joined", F.array_join("norms", " ")).withColumn("numbers", F.transform(F.filter("norms", lambda n: n.rlike(r"^\d+$")), lambda n: n.try_cast("long")))
    has = lambda words: F.size(F.array_intersect("norms", F.array(*map(F.lit, words))))
    whole = F.size("numbers")
    index = (whole >= 3) & (whole == F.col("filled")) & (F.array_min("numbers") == 1) & (F.array_max("numbers") == whole)
    head = is_header(F.col("joined"), keys, layout.least) & (F.col("filled") >= layout.filled)
    marks = {"is_group": (has(rules.GROUP_HEADERS) == len(rules.GROUP_HEADERS)) & F.lit(layout.grouped), "is_sub": has(rules.SUBHEADERS) >= 3, "is_header": head, "is_index": index}
    return x.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in marks.items()}).drop("norms", "numbers", "joined")


def blocks(sheet_rows: DataFrame) -> DataFrame:
    """Tags rows with the block they belong to: (…, block_id, head_row, head_rows, in_data). Three blank rows end a block.

    Row numbers may have gaps: a missing row is a blank one.
    """
    w = Window.partitionBy(*SHEET).orderBy("row_no")
    starts = F.col("is_group") | (F.col("is_header") & ~F.coalesce(F.lag("is_group").over(w), F.lit(False)))
    x = sheet_rows.withColumn("starts", starts).withColumn("block_id", F.sum(F.when(F.col("starts"), 1).otherwise(0)).over(w)).filter("block_id > 0")
    b = Window.partitionBy(*SHEET, "block_id").orderBy("row_no")
    x = x.withColumn("head_row", F.first("row_no").over(b)).withColumn("two", F.max(F.col("is_group") & F.col("starts")).over(b))
    x = x.withColumn("head_rows", F.when(F.col("two"), 2).otherwise(1))
    body = (F.col("row_no") >= F.col("head_row") + F.col("head_rows")) & (F.col("filled") > 0)
    last = F.last(F.when(F.col("filled") > 0, F.col("row_no")), ignorenulls=True).over(b.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when((F.col("filled") > 0) & (F.col("row_no") - last > 3), 1).otherwise(0)
    x = x.withColumn("gap", gap).withColumn("ended", F.sum("gap").over(b) > 0)
    return x.withColumn("in_data", body & ~F.col("ended") & ~F.col("is_index")).drop("starts", "gap", "two")


def book(top: Column, sub: Column) -> Column:
    """Headers by column from a header's cells and those of its second row, if it has one: two-row headers as group/part; a header's second column is dropped; ё is е."""
    norm = lambda cells: F.map_from_entries(F.transform(cells, lambda c: F.struct(c["col_no"], F.nullif(F.translate(norm_text(c["value"]), "ё", "е"), F.lit("")))))
    fixed = lambda names: F.create_map(*(F.lit(x) for kv in names.items() for x in kv))

    def named(at: Column) -> Column:
        """One entry a column, by number, with its texts in both rows."""
        cols = F.array_sort(F.array_union(F.map_keys(at["top"]), F.map_keys(at["sub"])))
        return F.transform(cols, lambda c: F.struct(c.alias("col_no"), F.try_element_at(at["top"], c).alias("top"), F.try_element_at(at["sub"], c).alias("sub")))

    def full(x: Column) -> Column:
        def one(n: Column, i: Column) -> Column:
            group = F.try_element_at(F.filter(F.slice(x["top"], 1, i + 1), lambda t: t.isNotNull()), F.lit(-1))
            side, part = F.element_at(fixed(rules.GROUP_HEADERS), group), F.element_at(fixed(rules.SUBHEADERS), n["sub"])
            return F.struct(n["col_no"].alias("col_no"), F.when(part.isNotNull() & side.isNotNull(), F.concat_ws("/", side, part)).otherwise(F.coalesce(n["sub"], n["top"])).alias("header"))

        return F.filter(F.transform(x, one), lambda e: e["header"].isNotNull())

    both = F.struct(norm(top).alias("top"), norm(F.coalesce(sub, F.slice(top, 1, 0))).alias("sub"))
    entries = once(once(both, named), full)
    return F.map_from_entries(once(entries, lambda x: F.filter(x, lambda e, i: F.array_position(x["header"], e["header"]) == i + 1)))


def block_rows(cells: DataFrame, layout: Layout = UNIVERSAL, dealt: bool = False) -> DataFrame:
    """Data rows as maps from header to value; blocks with under three columns and blank rows go.

    Cells are dealt by file once, unless they are stored so (`deal`); a block's header goes down its rows by windows.
    """
    cells = cells if dealt else cells.repartition("file_id")
    if layout.repaired:
        cells = cells.withColumn("value", repair_mojibake(F.col("value")))
    w = Window.partitionBy(*SHEET, "block_id").orderBy("row_no")
    head = F.col("row_no") == F.col("head_row")
    below = F.when(head & (F.col("head_rows") == 2), F.lead(F.struct("row_no", "cells")).over(w))
    tagged = blocks(rows(cells, layout)).withColumn("below", below)
    made = F.when(head, book(F.col("cells"), F.when(F.col("below.row_no") == F.col("row_no") + 1, F.col("below.cells"))))
    tagged = tagged.withColumn("made", made).withColumn("book", F.first("made").over(w)).filter("in_data and size(book) >= 3")
    named = F.transform("cells", lambda c: F.struct(F.try_element_at("book", c["col_no"]).alias("header"), clean_optional_text(c["value"]).alias("v")))
    held = F.filter(named, lambda e: e["header"].isNotNull() & e["v"].isNotNull())
    data = tagged.select(*SHEET, "block_id", "row_no", F.explode(F.array(held)).alias("held")).filter(F.size("held") > 0)  # worked out once a row
    return data.select(*SHEET, "block_id", "row_no", F.map_from_entries("held").alias("row"))


def by_layout(cells: DataFrame, banks: DataFrame | None = None, layouts: list[Layout] = LAYOUTS, dealt: bool = False) -> DataFrame:
    """block_rows of each file by the first layout that finds rows in it, with `layout`.

    banks: (file_id, bank). A file of a known bank is read by that bank's layout or else the universal one; files of
    no or unknown bank, and all files without banks, by whichever comes first. A layout reads only files in which none
    before it has found rows.
    """
    cells = cells if dealt else deal(cells)
    found, left = None, cells
    for one in layouts:
        mine = left
        if banks is not None and one.name != UNIVERSAL.name:
            other = banks.filter(~F.col("bank").isin("unknown", one.name)).select("file_id").distinct()
            mine = left.join(other.hint("shuffle_hash"), "file_id", "left_anti")
        part = cut(block_rows(mine, one, dealt=True)).withColumn("layout", F.lit(one.name))
        found = part if found is None else found.unionByName(part)
        left = cells.join(found.select("file_id").distinct().hint("shuffle_hash"), "file_id", "left_anti")
    return found


def canonical(found: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Maps of headers as canonical columns; the first header of a column that has a value wins. Other headers stay in `ext`."""
    book = {k.replace("ё", "е"): v for k, v in (mapping or rules.HEADERS).items()}
    known = F.create_map(*(F.lit(x) for h in book for x in (h, f"{[*book].index(h):04d}{book[h]}")))
    named = F.transform(F.map_entries("row"), lambda e: F.struct(F.element_at(known, e["key"]).alias("k"), e["value"].alias("v")))
    named = F.array_sort(F.filter(named, lambda e: e["k"].isNotNull() & e["v"].isNotNull()))
    named = once(F.transform(named, lambda e: F.struct(F.substring(e["k"], 5, 1000).alias("k"), e["v"].alias("v"))), lambda x: F.filter(x, lambda e, i: F.array_position(x["k"], e["k"]) == i + 1))
    # Exploding one map a row keeps later filters from looking everything up again for each time that they name a column.
    x = found.select(*SHEET, "block_id", F.col("row_no").alias("source_row_no"), "row", F.explode(F.array(F.map_from_entries(named))).alias("_m"))
    cols = [F.element_at("_m", F.lit(t)).alias(t) for t in sorted(set(book.values()))]
    return x.select(*SHEET, "block_id", "source_row_no", *cols, F.map_filter("row", lambda k, v: ~k.isin([*book])).alias("ext"))


def to_ledger(found: DataFrame, project_id: str, source_bank: str, account: str | None = None) -> DataFrame:
    """Canonical text rows to ledger rows: service rows go, amounts, direction, ids, warnings and confidence are made."""
    text = [c for c in found.columns if c not in (*SHEET, "block_id", "source_row_no", "ext")]
    from ..functions.text import is_service_row

    x = found.filter(~is_service_row(*(F.col(c) for c in text)))
    have = lambda c: F.col(c) if c in found.columns else F.lit(None).cast("string")
    amt = {c: numbers.parse_decimal(have(c)) for c in ("amount_currency", "amount_kzt", "amount_credit", "amount_debit")}
    x = x.withColumns({f"_{c}": v for c, v in amt.items()}).withColumn("operation_ts", dates.parse_datetime(have("operation_ts")))
    direction = parties.derive_direction(have("operation_type_raw"), have("purpose_text"), F.col("_amount_debit"), F.col("_amount_credit"))
    x = x.withColumn("direction", direction).withColumn("currency", F.upper(F.coalesce(have("currency"), F.lit("KZT"))))
    for side, d in (("amount_debit", "debit"), ("amount_credit", "credit")):
        x = x.withColumn(f"_{side}", numbers.fill_side(F.col(f"_{side}"), F.col("direction") == d, F.col("_amount_currency"), F.col("_amount_kzt")))
    bad = F.array_compact(F.array(*(F.when(have(f"{s}_iin_bin").isNotNull() & ids.iin12(have(f"{s}_iin_bin")).isNull(), F.concat(F.lit(f"bad_iinbin:{s}_iin_bin:"), have(f"{s}_iin_bin"))) for s in ("payer", "receiver"))))
    x = x.withColumn("parse_warnings", F.nullif(F.array_join(bad, ";"), F.lit(""))).withColumn("confidence_score", F.when(F.size(bad) > 0, 0.9).otherwise(1.0))
    x = x.withColumn("amount_kzt", numbers.resolve_amount_kzt(F.col("_amount_kzt"), F.col("_amount_currency"), F.col("_amount_debit"), F.col("_amount_credit"), F.col("currency")).cast("decimal(18,2)"))
    for c in ("amount_currency", "amount_credit", "amount_debit"):
        x = x.withColumn(c, F.coalesce(F.col(f"_{c}"), F.lit(0.0)).cast("decimal(18,2)"))
    for s in ("payer", "receiver"):
        x = x.withColumn(f"{s}_iin_bin", ids.iin12(have(f"{s}_iin_bin"))).withColumn(f"{s}_name", parties.resolve_counterparty_name(have(f"{s}_name"), F.col(f"{s}_iin_bin"), have(f"{s}_account")))
    some = F.coalesce(*(F.when(F.col(f"_{c}") != 0, F.col(f"_{c}")) for c in ("amount_currency", "amount_kzt", "amount_debit", "amount_credit")))
    x = x.withColumn("semantic_text", semantic_text(*(have(c) for c in ("operation_type_raw", "sdp_name", "purpose_text", "raw_note"))))
    x = x.withColumn("project_id", F.lit(project_id)).withColumn("source_bank", F.lit(source_bank))
    x = x.withColumn("row_hash", ids.row_hash(F.col("source_bank"), F.lit(account).cast("string"), F.col("operation_ts"), some, F.coalesce("payer_iin_bin", "payer_name"), F.coalesce("receiver_iin_bin", "receiver_name"), have("purpose_text")))
    return x.withColumn("tx_id", ids.tx_id(F.col("project_id"), F.col("row_hash"))).withColumn("operation_date", F.to_date("operation_ts")).drop(*(f"_{c}" for c in amt))


def near_headers(cells: DataFrame, lookback: int, layout: Layout = UNIVERSAL) -> DataFrame:
    """The cells of all rows that blocks() and a look-back above their headers can need; those of other rows go.

    A header holds the first word of each of its keywords within one cell, so rows that may be headers are known by marks
    of their cells, a few numbers a row. The numbers of these rows, of those above and of those between a grouped header
    and the next one are few and different, whatever the sheets; sheets that have rows of the same number keep them.
    """
    plain, keys = F.translate(F.lower("value"), "“”\"'", ""), sorted({k.lower() for k in layout.words})
    first = lambda k: re.split("[ /:]", k)[0]
    groups = [*rules.GROUP_HEADERS] if layout.grouped else []
    marks, least = F.lit(0).cast("long"), F.lit(False)
    words = sorted({first(k) for k in (*keys, *groups)})
    for word in words:
        bits = sum(1 << i for i, k in enumerate((*keys, *groups)) if first(k) == word)
        marks = marks.bitwiseOR(F.when(plain.contains(word), F.lit(bits).cast("long")).otherwise(0))
    of_keys, of_groups = (1 << len(keys)) - 1, ((1 << len(groups)) - 1) << len(keys)
    some = plain.rlike("|".join(re.escape(word) for word in words))  # most cells hold none: one look instead of one a word
    found = cells.filter(some).select(*ROW, marks.alias("m")).groupBy(*ROW).agg(F.bit_or("m").alias("m"))
    if groups:
        least = F.col("m").bitwiseAND(F.lit(of_groups).cast("long")) == of_groups
    found = found.withColumn("group", least).filter(F.col("group") | (F.bit_count(F.col("m").bitwiseAND(F.lit(of_keys).cast("long"))) >= layout.least))
    before = F.lag(F.struct("row_no", "group")).over(Window.partitionBy(*SHEET).orderBy("row_no"))
    ends = found.withColumn("b", before).select(F.least(F.col("row_no") - lookback, F.when(F.col("b.group"), F.col("b.row_no"))).alias("low"), F.col("row_no").alias("high")).distinct()
    numbers = cut(ends.select(F.explode(F.sequence("low", "high")).alias("row_no")).distinct())
    return cells.join(numbers, "row_no", "left_semi").select(cells.columns)


def metadata(cells: DataFrame, lookback: int = 30) -> DataFrame:
    """key and value pairs above each block: "key: value" within a cell, or a label ending in a colon and the next cell."""
    cells = near_headers(cells, lookback)
    tagged = blocks(rows(cells.repartition(*SHEET))).filter(F.col("row_no") == F.col("head_row")).select(*SHEET, "block_id", "head_row")
    w = Window.partitionBy(*ROW).orderBy("col_no")
    c = cells.filter(clean_optional_text(F.col("value")).isNotNull()).withColumn("next", F.lead("value").over(w))
    key, value = F.trim(F.regexp_extract("value", r"(?s)^([^:]{2,80}):(.*)$", 1)), F.trim(F.regexp_extract("value", r"(?s)^([^:]{2,80}):(.*)$", 2))
    pair = c.withColumn("key", norm_text(key)).withColumn("found", F.coalesce(F.nullif(value, F.lit("")), F.trim("next"))).filter("key <> ''")
    above = (F.col("row_no") < F.col("head_row")) & (F.col("row_no") >= F.col("head_row") - lookback)
    return pair.join(tagged, SHEET).filter(above).select(*SHEET, "block_id", "row_no", "col_no", "key", F.col("found").alias("value"))


#: What a label in a statement's first column names, in order; what it must hold, and must not hold.
KASPI_LABELS = [
    ("клиент", "^клиент$", None),
    ("иин/бин", "иин|бин", None),
    ("period", "^период", None),
    ("iban", "счет", "валюта|тип"),
    ("currency", "валюта счета", None),
    ("account_type", "тип счета", None),
    ("statement_date", "дата формирования|дата выписки|формирования", None),
    ("opening_balance", "входящий остаток", None),
    ("closing_balance", "исходящий остаток", None),
]
#: Texts that stand for no value; patterns of accounts, ids, contracts and currencies; columns that are read.
NO_VALUE = ["", "'", '"', "-", "—", "–", "''", '""']
ACCOUNT, TAX_ID, CONTRACT, CURRENCY = r"\bKZ[A-Z0-9]{8,32}\b", r"\b\d{12}\b", r"(?i)\bCONTRACT\s*#?\s*(KZ[0-9A-Z]{10,40})\b", r"\b(KZT|USD|EUR|RUB|CNY)\b"
WIDE = {"kaspi": 10, "halyk": 14}
#: How far right of a label its value may be.
REACH = 5


def bank_metadata(cells: DataFrame, bank: str = "", lookback: int = 80) -> DataFrame:
    """key and value pairs above each block by a bank's own rules, a row a key; pick_metadata chooses among them.

    kaspi: the first column holds a label, its value is in the third, else the second column, else below it. halyk: pairs
    within a cell, clients beside a tax id, contracts, currencies of contracts, and labels ending in a colon with a value
    up to five columns on. Other banks: pairs, such labels and accounts. The last value of a key counts; accounts and ids
    found in the text alone only fill what no label has named. row_no and col_no tell where a key came first.
    """
    cells = near_headers(cells, lookback)
    tagged = blocks(rows(cells.repartition(*SHEET))).filter(F.col("row_no") == F.col("head_row")).select(*SHEET, "block_id", "head_row")
    wide = WIDE.get(bank, 14)
    few = cells.filter(F.col("col_no") < wide).select(*ROW, "col_no", F.trim("value").alias("v")).filter("v <> ''")
    line = few.groupBy(*ROW).agg(F.map_from_entries(F.collect_list(F.struct("col_no", "v"))).alias("m"))  # a row's first cells
    order = Window.partitionBy(*SHEET).orderBy("row_no")
    below = F.lead(F.struct("row_no", F.col("m")[0].alias("v"))).over(order)
    line = line.withColumn("below", below).join(tagged, SHEET).filter((F.col("row_no") < F.col("head_row")) & (F.col("row_no") >= F.col("head_row") - lookback))
    clean = lambda c: F.when(~c.isin(NO_VALUE), c)
    cell = lambda i: clean(F.col("m")[i])
    at = lambda i: F.col("m")[F.lit(i)]
    text = F.concat_ws(" | ", *(at(i) for i in range(wide)))
    squeezed = F.regexp_replace(F.upper(text), r"\s+", "")
    none = F.lit(None).cast("string")

    def push(seq: int, col: int, key: Column, value: Column, when: Column, fills: bool = False) -> Column:
        k, v = norm_text(key), clean(F.trim(value))
        return F.when(when & (k != "") & v.isNotNull(), F.struct(F.lit(seq).alias("seq"), F.lit(col).alias("col"), F.lit(fills).alias("fills"), k.alias("key"), v.alias("value")))

    found = lambda t, pattern, group=0: F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))
    account, tax_id = found(squeezed, ACCOUNT), found(text, TAX_ID)
    long_account = push(7, 0, F.lit("iban"), account, (F.length(account) >= 20) & ~F.lower(text).contains("contract"), True)
    pairs = [push(0, i, F.substring_index(at(i), ":", 1), F.expr(f"substring(m[{i}], locate(':', m[{i}]) + 1)"), at(i).contains(":")) for i in range(wide)]
    ahead = lambda i: F.coalesce(*(cell(j) for j in range(i + 1, min(wide, i + 1 + REACH))), none)
    labels = [push(8, i, F.regexp_replace(at(i), "^[ :]+|[ :]+$", ""), ahead(i), at(i).endswith(":")) for i in range(wide)]
    if bank == "kaspi":
        label = norm_text(cell(0))
        under = F.when((F.col("below.row_no") == F.col("row_no") + 1) & (F.col("below.row_no") < F.col("head_row")), clean(F.col("below.v")))
        value, key = F.coalesce(cell(2), cell(1), under), none
        for name, holds, lacks in reversed(KASPI_LABELS):
            key = F.when(label.rlike(holds) & (~label.rlike(lacks) if lacks else F.lit(True)), name).otherwise(key)
        said = [push(0, 0, key, value, key.isNotNull()), long_account, push(7, 1, F.lit("иин/бин"), tax_id, tax_id.isNotNull(), True)]
    elif bank == "halyk":
        named, contract, currency = tax_id.isNotNull() & F.lower(text).rlike("иин|бин"), found(text, CONTRACT, 1), found(F.upper(text), CURRENCY, 1)
        said = [*pairs, push(1, 0, F.lit("иин/бин"), tax_id, named), push(2, 0, F.lit("клиент"), cell(1), named), push(3, 0, F.lit("contract #"), contract, contract.isNotNull()), push(4, 0, F.lit("валюта контракта"), currency, F.lower(text).contains("валюта контракта") & currency.isNotNull()), long_account, *labels]
    else:
        each = [found(F.regexp_replace(F.upper(at(i)), r"\s+", ""), ACCOUNT) for i in range(wide)]
        said = [*pairs, *labels, *(push(9, i, F.lit("iban"), x, x.isNotNull()) for i, x in enumerate(each))]
    out = line.select(*SHEET, "block_id", "row_no", F.explode(F.array_compact(F.array(*said))).alias("x")).select(*SHEET, "block_id", "row_no", "x.*")
    place = F.struct("row_no", "seq", "col")
    out = out.groupBy(*SHEET, "block_id", "key").agg(F.max_by("value", F.when(~F.col("fills"), place)).alias("last"), F.min_by("value", F.when(F.col("fills"), place)).alias("first"), F.min(place).alias("p"))
    return out.select(*SHEET, "block_id", F.col("p.row_no").alias("row_no"), (F.col("p.seq") * 100 + F.col("p.col")).alias("col_no"), "key", F.coalesce("last", "first").alias("value"))


#: Labels of statement metadata and of footer totals.
META_LABELS = {"client_name": ["наименование клиента", "клиент", "фио", "владелец счета"], "client_iin_bin": ["иин/бин", "иин", "бин"], "account_iban": ["номер счета", "счет", "iban"], "currency": ["валюта счета", "валюта"], "period": ["период", "за период"], "opening_balance": ["входящий остаток", "остаток на начало", "начальный баланс"], "closing_balance": ["исходящий остаток", "остаток на конец", "конечный баланс"]}
FOOTER_LABELS = {"total_debit": ["итого дебет", "итого по дебету", "обороты по дебету"], "total_credit": ["итого кредит", "итого по кредиту", "обороты по кредиту"], "opening_balance": ["входящий остаток", "начальный баланс"], "closing_balance": ["исходящий остаток", "конечный баланс"]}
#: Words one of which every label of a footer holds.
FOOTER_WORDS = ["итого", "обороты", "остаток", "баланс"]


def _ranked(df: DataFrame, labels: dict[str, list[str]], text: str) -> DataFrame:
    """Rank 1 for an exact label, 2 for its start, 3 for its occurrence; rows with none go."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(x).alias("label"), F.lit(i).alias("at")) for f, names in labels.items() for i, x in enumerate(names))))
    t = F.col(text)
    rank = F.when(t == F.col("label"), 1).when(t.startswith(F.col("label")), 2).when(t.contains(F.col("label")), 3)
    return df.select("*", pairs.alias("_p")).select("*", "_p.*").drop("_p").withColumn("rank", rank).filter("rank is not null")


def pick_metadata(pairs: DataFrame) -> DataFrame:
    """The best value of each field of a block: exact label, then its start, then its occurrence."""
    w = Window.partitionBy(*SHEET, "block_id", "field").orderBy("rank", "at", "row_no", "col_no")
    return _ranked(pairs.filter("value is not null"), META_LABELS, "key").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*SHEET, "block_id", "field", "value", "rank")


def footers(cells: DataFrame) -> DataFrame:
    """Totals and balances: the nearest number right of a label, in any row of the sheet; else by magnitude.

    Without such a number, a balance is the greatest number of a row that names it, and debit and credit are the two
    greatest numbers of a total's row; of several rows, that with the greatest counts.
    """
    plain = F.translate(F.lower("value"), "“”\"'", "")
    word = any_of(*(plain.contains(w) for w in FOOTER_WORDS))
    c = cells.select(*ROW, "col_no", "value", F.coalesce(word, F.lit(False)).alias("word"))
    # Only rows that name a field matter: they are few and stored. Cells that are stored by file (deal) are not shuffled for that.
    c = cut(c.withColumn("named", F.max("word").over(Window.partitionBy(*ROW))).filter("named").drop("named"))
    marked = c.filter("word").withColumn("norm", norm_text(F.col("value")))
    label = _ranked(marked, FOOTER_LABELS, "norm").select(*ROW, F.col("col_no").alias("label_col"), "field", "rank", "at")
    c = c.withColumn("norm", norm_text(F.col("value")))
    number = numbers.parse_decimal(F.col("value"))
    value = c.withColumn("number", number).filter("number is not null").select(*ROW, "col_no", "number")
    near = label.join(value, ROW).filter(F.col("col_no") >= F.col("label_col"))
    w = Window.partitionBy(*SHEET, "field").orderBy("rank", "at", F.col("col_no") - F.col("label_col"), F.desc("row_no"))
    near = near.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*SHEET, "field", F.col("number").alias("value"), "row_no")
    total, opening, closing = "итого", "входящий остаток", "исходящий остаток"
    named = marked.filter(F.col("norm").rlike(f"{total}|{opening}|{closing}")).select(*ROW).distinct()
    sizes = F.array_sort(F.collect_list(F.struct((-F.abs("number")).alias("less"), "number")))  # the cells of a row
    line = c.join(named, ROW, "left_semi").withColumn("number", number).groupBy(*ROW).agg(F.concat_ws(" ", F.collect_list("norm")).alias("joined"), F.transform(F.filter(sizes, lambda s: s["number"].isNotNull()), lambda s: s["number"]).alias("nums"))
    of = lambda field, word, i, least: F.when(F.col("joined").contains(word) & (F.size("nums") >= least), F.struct(F.lit(field).alias("field"), F.get("nums", F.lit(i)).alias("value")))
    guess = F.array_compact(F.array(of("closing_balance", closing, 0, 1), of("opening_balance", opening, 0, 1), of("total_debit", total, 0, 2), of("total_credit", total, 1, 2)))
    great = line.select(*ROW, F.explode(guess).alias("x")).select(*ROW, "x.*").groupBy(*SHEET, "field").agg(F.max(F.struct(F.abs("value").alias("size"), "row_no", "value")).alias("m")).select(*SHEET, "field", "m.value", "m.row_no")
    return near.unionByName(great.join(near, [*SHEET, "field"], "left_anti"))


def owner_fallback(cells: DataFrame) -> DataFrame:
    """Name, id and account of a sheet's owner from its first 40 rows: (file_id, sheet, name, iin_bin, account).

    Column 0 holds a label, and the first text of columns 1 to 3 its value. A label goes to the first of name, id and
    account that it names and that no earlier row has filled; what is not found is empty.
    """
    text = F.trim(repair_mojibake(F.trim("value")))
    few = cells.filter((F.col("row_no") < 40) & F.col("col_no").between(0, 3)).select(*ROW, "col_no", F.nullif(text, F.lit("")).alias("t"))
    line = few.groupBy(*ROW).agg(F.max(F.when(F.col("col_no") == 0, F.translate(F.lower("t"), "ё", "е"))).alias("label"), F.min_by("t", F.when((F.col("col_no") > 0) & F.col("t").isNotNull(), F.col("col_no"))).alias("t"))
    line = line.filter("label is not null and t is not null").withColumn("t", F.when(F.col("t") != "", F.col("t")))
    digits = F.regexp_replace("t", r"[\s\u00a0]", "")
    iin = F.substring(F.coalesce(F.when(digits.rlike(r"[eE][+-]?\d+"), F.round(F.replace(digits, F.lit(","), F.lit(".")).try_cast("double")).try_cast("decimal(38,0)").cast("string")), F.regexp_replace(digits, r"\D", "")), 1, 12)
    values = {"name": F.regexp_replace("t", "^\"+|\"+$", ""), "iin_bin": iin, "account": F.col("t")}
    values["name"] = F.regexp_replace(values["name"], "^'+|'+$", "")
    words = {"name": "клиент", "iin_bin": "иин|бин", "account": "счет"}
    # Rows that an earlier field takes are those that name it, up to the one that fills it.
    taken = F.lit(False)
    for field, word in words.items():
        line = line.withColumn("_v", values[field]).withColumn("_mine", F.col("label").rlike(word) & ~taken)
        filled = F.min(F.when(F.col("_mine") & (F.col("_v") != ""), F.col("row_no"))).over(Window.partitionBy(*SHEET))  # 40 rows at most
        line = line.withColumn(f"_at_{field}", filled).withColumn(f"_{field}", F.when(F.col("_mine") & (F.col("row_no") == F.col(f"_at_{field}")), F.col("_v"))).withColumn(f"_took_{field}", F.col("_mine") & (F.col("row_no") <= F.coalesce(f"_at_{field}", F.lit(40))))
        taken = taken | F.col(f"_took_{field}")
    found = line.groupBy(*SHEET).agg(*(F.coalesce(F.max(f"_{field}"), F.lit("")).alias(field) for field in words))
    sheets = cells.select(*SHEET).distinct()
    return sheets.join(found, SHEET, "left").fillna("", list(words))
