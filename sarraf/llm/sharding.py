"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

A record hashes into one of thousands of slots and never leaves it. Bytes are summed per slot, and a small map
says which shard holds each slot. Maps are versions in a folder; rebalancing edits the map, not the records.

Defined cases: a null text has 8 bytes and CRC 0; equal rows count each; an empty table gives no rows and a map
of empty slots; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SLOTS = 4096


def slot_of(*key: Column, n_slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


def slot_sizes(records: DataFrame) -> list[tuple[int, int, int]]:
    """(virtual slot, rows, bytes); at most one row a slot comes to the driver."""
    return [tuple(r) for r in records.groupBy("vslot").agg(F.count("*"), F.sum("size")).collect()]


def assign(sizes: list[tuple[int, int, int]], n_shards: int, n_slots: int = SLOTS) -> dict[int, int]:
    """Largest slot first, each to the shard with the fewest bytes; empty slots go round."""
    load, out = [(0, 0, s) for s in range(n_shards)], {}
    full = {v: (b, n) for v, n, b in sizes}
    for v in sorted(range(n_slots), key=lambda v: (-full.get(v, (0, 0))[0], v)):
        b, n, s = heapq.heappop(load)
        out[v] = s
        heapq.heappush(load, (b + full.get(v, (0, 0))[0], n + 1, s))
    return out


def rebalance(held: dict[int, int], sizes: list[tuple[int, int, int]], n_shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """Edits a map: moves slots off shards over the mean, and off dropped shards, until all are within tolerance.

    A slot moves only if that brings the two shards nearer to each other, so most slots stay where they are.
    """
    size, out = {v: b for v, _, b in sizes}, dict(held)
    load = [0] * n_shards
    for v, s in out.items():
        if s < n_shards:
            load[s] += size.get(v, 0)
    for v in sorted((v for v, s in out.items() if s >= n_shards), key=lambda v: -size.get(v, 0)):
        out[v] = min(range(n_shards), key=lambda s: (load[s], s))
        load[out[v]] += size.get(v, 0)
    mean = sum(load) / n_shards
    while True:
        hi, lo = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        if load[hi] <= mean * (1 + tolerance) and load[lo] >= mean * (1 - tolerance):
            return out
        gap = load[hi] - load[lo]
        fit = [v for v, s in out.items() if s == hi and 0 < size.get(v, 0) < gap]
        if not fit:
            return out
        v = min(fit, key=lambda v: (abs(size[v] - gap / 2), v))
        out[v] = lo
        load[hi] -= size[v]
        load[lo] += size[v]


def save_map(spark: SparkSession, folder: str, version: int, held: dict[int, int], sizes: list[tuple[int, int, int]]) -> None:
    """Stores one version: slot, shard, and how many rows of its shard stand before the slot's."""
    rows_of, before, out = {v: n for v, n, _ in sizes}, {}, []
    for v in sorted(held):
        out.append((v, held[v], before.get(held[v], 0)))
        before[held[v]] = before.get(held[v], 0) + rows_of.get(v, 0)
    spark.createDataFrame(out, "vslot int, shard int, first long").coalesce(1).write.parquet(f"{folder}/version={version:06d}")


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int, first long").parquet(f"{folder}/version={version:06d}")


def shard(docs: DataFrame, n_shards: int, folder: str | None = None, version: int = 1, n_slots: int = SLOTS) -> DataFrame:
    """Documents with their shard and their place in it, under a new map version with shards of near-equal bytes."""
    spark, text = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    folder = folder or common.shared_dir(spark)
    records = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(F.col("doc_id"), text, n_slots=n_slots).alias("vslot"))
    records = common.materialize(records)
    sizes = slot_sizes(records)
    save_map(spark, folder, version, assign(sizes, n_shards, n_slots), sizes)
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (
        records.withColumn("place", place)
        .join(F.broadcast(load_map(spark, folder, version)), "vslot")  # n_slots rows, whatever the input
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("map_version"))
    )
