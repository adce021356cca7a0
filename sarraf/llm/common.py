"""What the operators share: reading, shared scratch tables, Arrow buffers, hashing and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: texts are cut by bytes, rows of numbers by their count.
BATCH_ROWS, BATCH_BYTES = "10000", str(1 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches near a megabyte: a batch ends with the row that passes the bound, whatever its length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; only a local session may have none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sarraf-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows end to end, and where each row starts; null is empty."""
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: The hash has two residues of 31 bits: polynomials over random byte values at random points, modulo a prime.
_PRIME = (1 << 31) - 1
_RANDOM = np.random.Generator(np.random.PCG64(20240517))
_POINTS = [int(x) for x in _RANDOM.integers(1 << 30, _PRIME, 2)]
_BYTES = _RANDOM.integers(1, _PRIME, (2, 256), dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fold(x: np.ndarray) -> np.ndarray:
    """Closer to x modulo the prime: 2**31 is 1 there, so its digits of 31 bits are added up. A product of numbers under 2**31 and 2**33 comes under 2**34."""
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(31))


def _modulo(x: np.ndarray) -> np.ndarray:
    """x modulo the prime for any x of 64 bits."""
    x = _fold(_fold(x))
    return np.minimum(x, x - np.uint64(_PRIME))  # wraps far up where x is under the prime


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo the prime for i < n at least."""
    x = _powers.get(base, np.ones(1, np.uint64))
    while len(x) < n:
        x = np.concatenate([x, _modulo(x * np.uint64(pow(base, len(x), _PRIME)))])
    _powers[base] = x
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[k, i] the polynomial hash of data[:i] at point k, not reduced (fewer than 2**30 bytes); see window_hash()."""
    out = np.zeros((2, len(data) + 1), np.uint64)
    for k, point in enumerate(_POINTS):
        np.cumsum(_fold(_BYTES[k][data] * powers(point, len(data))[: len(data)]), dtype=np.uint64, out=out[k, 1:])
    return out


def window_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] in 64 bits; equal bytes have equal hashes wherever they stand.

    Modulo a prime, no shape of text makes both residues meet; modulo 2**64, texts such as Thue and Morse's word and
    its complement do at every point.
    """
    out = mix64((end - start).astype(np.uint64))
    for k, point in enumerate(_POINTS):
        down = powers(pow(point, -1, _PRIME), prefix.shape[1])
        out ^= _modulo(_fold(_fold(prefix[k][end] - prefix[k][start])) * down[start]) << np.uint64(31 * k)
    return mix64(out)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), root the least node it is connected with.

    Alternates large-star and small-star steps: every step is a grouped minimum and a join, and each one is
    written to the shared folder. No step gathers the neighbours of a node. Null ends must not occur.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        if large:
            out = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        edges = materialize(star(star(edges, True), False))
        # Done when all trees are stars: no node has two parents, or a parent and a child.
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))
