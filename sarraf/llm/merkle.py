"""Merkle manifest of a dataset: a tree of digests for each language, and one over the languages.

Where a leaf stands is a rank query, not a sort. The ids of a group are kept as a bitmap of 64-bit words, only words
that hold an id; a directory over the words says how many rows stand before each, level by level with FAN children a
node, and a row adds the bits of its own word below its own. Then nodes meet by key (group, position / 512) in arrays
of slots, each of which works off three levels of eight at once, so a tree over n leaves takes log512(n) shuffles.
Proofs come down the same way: each array passes the siblings above it on to its slots.

Defined cases: rows of null doc_id come first; rows of equal group and id stand in the order of their digests, rows
that are the same in any order; null is its own language and comes first, and an empty string another; a language of
one row has that leaf as its root, and a dataset of one language has that language's root as its own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Children of a node of the directory; slots of an array, and levels of eight that it works off.
FAN, SLOTS, LEVELS = 12, 512, 3


def _field(c: str) -> Column:
    value = F.col(c).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _leaf(text: str) -> Column:
    return F.sha2(F.concat(*map(_field, ("doc_id", "source", "lang", "n_chars", text))), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, forged, row): g names the language, null first; forged is the leaf of a tampered text, else null."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text").withColumn("forged", F.when(tampered, F.translate("text", upper, upper.lower())))
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return rows.select(group.alias("g"), "doc_id", _leaf("text").alias("leaf"), F.when(tampered, _leaf("forged")).alias("forged"), F.monotonically_increasing_id().alias("row"))


def _before(words: DataFrame, lo: int, hi: int) -> DataFrame:
    """(g, k, n) with the rows of the group in lesser words, and in all. Nodes of the directory have 1 << FAN children."""
    earlier = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if hi - lo < 1 << FAN:
        return words.withColumn("before", earlier("g")).withColumn("total", F.sum("n").over(Window.partitionBy("g")))
    words = words.withColumn("up", F.shiftright("k", FAN))
    above = materialize(words.groupBy("g", F.col("up").alias("k")).agg(F.sum("n").alias("n")))
    above = _before(above, lo >> FAN, hi >> FAN).select("g", F.col("k").alias("up"), F.col("before").alias("b"), "total")
    return words.withColumn("before", earlier("g", "up")).join(above, ["g", "up"]).withColumn("before", F.col("before") + F.col("b")).drop("up", "b")


def ranks(rows: DataFrame, value: str) -> DataFrame:
    """Rows with `rank`, how many rows of their group g have a lesser value, `ties`, how many have the same, and `total`."""
    word, bit = F.shiftright(F.col(value), 6), F.col(value).bitwiseAND(63)
    held = rows.groupBy("g", word.alias("k")).agg(F.coalesce(F.bit_or(F.expr(f"shiftleft(1L, cast({value} & 63 as int))")), F.lit(1)).alias("bits"), F.count("*").alias("n"))
    held = materialize(held)
    lo, hi, crowded = held.agg(F.min("k"), F.max("k"), F.max(F.col("n") - F.bit_count("bits"))).first()
    none = (0 if lo is None else lo) - 1  # the word of nulls stands before all others
    held = held.fillna(none, ["k"])
    words = held.join(_before(held.select("g", "k", "n"), none, none if hi is None else hi).drop("n"), ["g", "k"])
    met = rows.withColumn("k", F.coalesce(word, F.lit(none))).join(words, ["g", "k"])
    below = F.expr(f"cast(bit_count(bits & ~shiftleft(-1L, cast({value} & 63 as int))) as long)")
    if not crowded:
        return met.withColumn("rank", F.col("before") + F.coalesce(below, F.lit(0))).withColumn("ties", F.lit(1).cast("long")).drop("k", "bits", "n", "before")
    met = met.withColumn("b", F.coalesce(bit, F.lit(0)))
    of_id = materialize(met.filter(F.col("n") > F.bit_count("bits")).groupBy("g", "k", "b").agg(F.count("*").alias("ties")))  # 64 rows a word at most
    of_id = of_id.withColumn("inner", F.coalesce(F.sum("ties").over(Window.partitionBy("g", "k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    met = met.join(of_id, ["g", "k", "b"], "left")
    rank = F.col("before") + F.coalesce("inner", below, F.lit(0))
    return met.withColumn("rank", rank).withColumn("ties", F.coalesce("ties", F.lit(1))).drop("k", "b", "bits", "n", "before", "inner")


def positions(rows: DataFrame) -> DataFrame:
    """(g, p, n, doc_id, leaf, forged): p is the leaf's place among the n of its group."""
    kept, out = ["g", "total", "rank", "doc_id", "leaf", "forged"], []
    rows = rows.withColumn("own", F.col("g"))
    for value in ("doc_id", "mark", "row"):
        found = materialize(ranks(rows, value))
        if value != "doc_id":
            found = found.withColumn("rank", F.col("rank") + F.col("base")).withColumn("total", F.col("whole"))
        out.append(found.filter("ties = 1").withColumn("g", F.col("own")).select(*kept))
        rows = found.filter("ties > 1")
        if value == "row" or rows.isEmpty():
            break
        # Ties become groups of their own, ranked by 60 bits of their digests, then by row.
        rows = rows.select(F.concat("g", F.lit("|"), F.coalesce(F.col(value).cast("string"), F.lit("-"))).alias("g"), "own", F.col("rank").alias("base"), F.col("total").alias("whole"), "doc_id", "leaf", "forged", "row", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long").alias("mark"))
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return union.select("g", F.col("rank").alias("p"), F.col("total").alias("n"), "doc_id", "leaf", "forged")


def _folded(a: str) -> str:
    return f"transform(sequence(0, (size({a}) - 1) div 8), i -> sha2(array_join(slice({a}, i * 8 + 1, 8), ''), 256))"


def arrays(nodes: DataFrame, *payload: str) -> DataFrame:
    """Nodes (g, p, n, h) as arrays of slots: (g, c, n, levels, top, slots). levels has the digests of each level that
    is worked off here, and top is what remains of the array."""
    slots = nodes.groupBy("g", F.expr(f"p div {SLOTS}").alias("c")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "h", *payload))).alias("slots"))  # SLOTS at most
    slots = slots.withColumn("l0", F.transform("slots", lambda s: s["h"])).withColumn("l1", F.expr(f"if(n > 1, {_folded('l0')}, l0)"))
    slots = slots.withColumn("l2", F.expr(f"if(n > 8, {_folded('l1')}, l1)")).withColumn("l3", F.expr(f"if(n > 64, {_folded('l2')}, l2)"))
    steps = F.expr("if(n > 64, 3, if(n > 8, 2, if(n > 1, 1, 0)))")
    return slots.select("g", "c", "n", F.slice(F.array("l0", "l1", "l2"), F.lit(1), steps).alias("levels"), F.col("l3")[0].alias("top"), "slots")


def reduce_up(nodes: DataFrame, *payload: str) -> tuple[list[DataFrame], DataFrame]:
    """The arrays of each step, and (g, h), the root of each group."""
    steps = []
    while True:
        step = materialize(arrays(nodes, *(payload if not steps else ())))
        steps.append(step)
        nodes = step.select("g", F.col("c").alias("p"), F.expr(f"(n + {SLOTS - 1}) div {SLOTS}").alias("n"), F.col("top").alias("h"))
        if (step.agg(F.max("n")).first()[0] or 0) <= SLOTS:
            return steps, nodes.select("g", "h")


#: Siblings to the left and to the right of slot j, on each level of its array.
_PATH = "transform(levels, (x, i) -> struct(array_join(slice(x, shiftright(j, 3 * i + 3) * 8 + 1, shiftright(j, 3 * i) & 7), '') AS l, array_join(slice(x, shiftright(j, 3 * i) + 2, 7 - (shiftright(j, 3 * i) & 7)), '') AS r))"


def slot_paths(step: DataFrame, above: DataFrame, *keep: str) -> DataFrame:
    """Each slot of the arrays (g, c) with its path to the root: its own array's, then what `above` (g, c) says."""
    met = step.join(above, ["g", "c"]).select("g", "levels", F.col("path").alias("up"), "root", "subroot", F.posexplode("slots").alias("j", "s"))
    return met.withColumn("path", F.concat(F.expr(_PATH), F.col("up"))).select("g", F.col("s.p").alias("p"), *(F.col(f"s.{c}").alias(c) for c in keep), "path", "root", "subroot")


def manifest(docs: DataFrame) -> DataFrame:
    """Each document with leaf, subroot, root, path (structs l, r of siblings), proof_sha256, folded_root and verified."""
    steps, subroots = reduce_up(positions(materialize(leaves(docs))).withColumn("h", F.col("leaf")), "doc_id", "forged")
    langs = materialize(subroots.withColumn("p", F.row_number().over(Window.orderBy("g")).cast("long") - 1))  # one row a language
    over, root = reduce_up(langs.select(F.lit("").alias("g"), "p", F.lit(langs.count()).cast("long").alias("n"), "h"))
    none = F.expr("cast(array() as array<struct<l: string, r: string>>)")
    above = root.select("g", F.lit(0).cast("long").alias("c"), none.alias("path"), F.col("h").alias("root"), F.lit(None).cast("string").alias("subroot"))
    for step in reversed(over):
        above = slot_paths(step, above).withColumnRenamed("p", "c")
    above = langs.select("g", F.col("p").alias("c"), F.col("h").alias("own")).join(above.drop("g", "subroot"), "c").select("g", F.lit(0).cast("long").alias("c"), "path", "root", F.col("own").alias("subroot"))
    for step in reversed(steps[1:]):
        above = slot_paths(step, above).withColumnRenamed("p", "c")
    out = slot_paths(steps[0], above, "doc_id", "h", "forged")
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("forged", "h"), lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))
    return out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", "path", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
