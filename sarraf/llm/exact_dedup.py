"""Exact deduplication by progressive refinement, in DataFrame functions only.

Texts are equal when they are the same without white space. A class of equal length splits into classes of equal
prefix hash, and only rows whose class of both still has company are hashed whole. The first scan counts the classes;
since a class of one prefix hash lies within one class of length, one grouped count refines both. The classes that
have company become a bitmap of bounded size, by which the second scan tells whose content it must hash whole: a full
bitmap lets more rows through, never fewer. Only narrow rows are shuffled, and counts are partial before they are.

Defined cases: null is the empty text; of equal texts the row with the most code points stays, then the least doc_id
(null last), then the least hash of the original text, then any one of rows that are the same; each row counts in
group_size; keep_id of a group whose staying row has no doc_id is null; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The characters that do not count.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Code points of the prefix; bits of the bitmap a class, and in all (16 MiB).
HEAD, BITS_A_CLASS, MOST_BITS = 64, 16, 1 << 27
#: Bits of one row of the bitmap, as bitmap_construct_agg has it.
ROW_BITS = 1 << 15


def normal(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """What both scans take of a row before its class is known."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("raw")).withColumn("norm", normal(F.col("raw")))
    return rows.withColumn("norm_len", F.length("norm")).withColumn("head", F.xxhash64(F.substring("norm", 1, HEAD)))


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(norm_len, head, n) of the classes of equal length and prefix hash that have company."""
    return _keyed(docs, text).groupBy("norm_len", "head").agg(F.count("*").alias("n")).filter("n > 1")


def _bit(n_bits: int) -> Column:
    return F.pmod(F.xxhash64("norm_len", "head"), F.lit(n_bits))


def bitmap(found: DataFrame, n_bits: int) -> DataFrame:
    """(page, bits): the classes as a bitmap of n_bits, ROW_BITS a row."""
    bit = found.select(_bit(n_bits).alias("bit"))
    return bit.groupBy(F.shiftright("bit", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(ROW_BITS - 1)).alias("bits"))


def refine(docs: DataFrame, text: str = "text", digests: bool = False) -> DataFrame:
    """Narrow rows of all documents: doc_id, points, tie, row, and `full`, the whole text's SHA-256 where the class has
    company, else null. With digests, text_sha256 holds it for every row, for output alone."""
    found = materialize(classes(docs, text))
    n_bits = max(ROW_BITS, min(MOST_BITS, 1 << (found.count() * BITS_A_CLASS).bit_length()))
    bit = _bit(n_bits)
    rows = _keyed(docs, text).withColumn("page", F.shiftright(bit, 15)).withColumn("place", bit.bitwiseAND(ROW_BITS - 1).cast("int"))
    rows = rows.join(F.broadcast(bitmap(found, n_bits)), "page", "left")  # MOST_BITS at most, whatever the input
    byte = F.conv(F.hex(F.expr("substring(bits, shiftright(place, 3) + 1, 1)")), 16, 10).cast("int")
    company = F.coalesce(F.expr("shiftright(_byte, place & 7) & 1 = 1"), F.lit(False))
    digest = F.sha2("norm", 256)
    return rows.withColumn("_byte", byte).select(
        "doc_id", F.length("raw").alias("points"), F.xxhash64("raw").alias("tie"), F.monotonically_increasing_id().alias("row"), F.when(company, digest).alias("full"), *([digest.alias("text_sha256")] if digests else []),
    )


def exact_dedup(docs: DataFrame, text: str = "text", digests: bool = False) -> DataFrame:
    """Every document with keep_id (the document that stays for it), group_size and kept; text_sha256 if asked for."""
    rows = materialize(refine(docs, text, digests))
    more = ["text_sha256"] if digests else []
    alone = rows.filter("full is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *more)
    open_ = rows.filter("full is not null")
    stays = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "row"))
    groups = materialize(open_.groupBy("full").agg(F.count("*").alias("group_size"), stays.alias("stays")))  # written, so that the join can split a hot group
    joined = open_.join(groups, "full")
    return alone.unionByName(joined.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), *more))
