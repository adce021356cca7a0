"""Repeated byte strings by prefix doubling over position ranks.

A rank is the name of the bytes that start at a position. Ranking every byte and doubling from 1 to 400 would
sort each byte of the corpus nine times, so the doubling starts at SEED bytes and on a sparse set of positions:
each WINDOW-byte string has one anchor, the position in it whose SEED-byte name is least, so equal strings have
equal anchors at equal offsets. Rounds, each a grouped count that drops what is unique:

1. names of SEED bytes at anchors;
2. names of the whole stretch of windows around one anchor (WINDOW bytes and more) as a pair (anchor's name, stretch's name);
3. where a stretch is unique though its anchor is not, names of WINDOW bytes at each of its positions, as a pair
   (anchor's name and offset, window's name). Only such stretches travel as bytes; those of one anchor meet in a
   task if there are at most TOGETHER, else their positions are counted as rows.

Positions whose pair occurs twice in round 2 or 3 start a repeated string. Names are 64-bit hashes, pairs 128 bits.

Defined cases: a null text is empty; texts shorter than the window keep everything; equal rows repeat each
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, SEED = 400, 128
#: Bytes of a text that are ranked at once.
CHUNK = 1 << 20

#: Equally anchored stretches that one task compares at once, about 500 bytes each; more are compared as rows.
TOGETHER = 16_384

_RUNS = "doc_key long, row_key long, anchor long, low int, high int, seed long, stretch long"
_BYTES = "doc_key long, row_key long, anchor long, low int, high int, seed long, asked boolean, bytes binary"
_SPANS = "doc_key long, row_key long, start long, end long"
_NAMES = "doc_key long, row_key long, start long, first long, second long, asked boolean"
_ID = ["doc_key", "row_key"]


def _pack(batches):
    """Texts as zstandard frames: they are shuffled twice."""
    squeeze = zstandard.ZstdCompressor(3)
    for batch in batches:
        data, offsets = common.utf8(batch["text"])
        packed = [squeeze.compress(data[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["doc_key"], batch["row_key"], pa.array(packed, pa.binary())], ["doc_id", *_ID, "packed"])


def _unpack(frame: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8)


def _anchors(names: np.ndarray, width: int) -> np.ndarray:
    """For each window of so many names, where its first least name stands."""
    best, where, span = names.copy(), np.arange(len(names)), 1
    while span < width:
        step = min(span, width - span)
        keep = best[:-step] <= best[step:]
        where = np.where(keep, where[:-step], where[step:])
        best = np.where(keep, best[:-step], best[step:])
        span += step
    return where


def stretches(data: np.ndarray, window: int = WINDOW, seed: int = SEED):
    """(anchor, low, high, anchor's name, stretch's name): the windows at anchor - high to anchor - low have this anchor."""
    width, found = window - seed + 1, []
    for at in range(0, len(data) - window + 1, CHUNK):
        part = data[at : at + CHUNK + window - 1]
        prefix = common.prefix_hash(part)
        start = np.arange(len(part) - seed + 1)
        names = common.window_hash(prefix, start, start + seed)
        where = _anchors(names, width)
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        end = np.r_[first[1:], len(where)] - 1
        anchor = where[first]
        found.append((anchor + at, anchor - end, anchor - first, names[anchor].view(np.int64), common.window_hash(prefix, first, end + window).view(np.int64)))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else None


def _rank(batches):
    for batch in batches:
        data, offsets = common.utf8(batch["text"])
        out = []
        for i in range(batch.num_rows):
            if (found := stretches(data[offsets[i] : offsets[i + 1]])) is not None:
                out.append((np.full(len(found[0]), i), *found))
        if out:
            row, anchor, low, high, seed, stretch = (np.concatenate(x) for x in zip(*out, strict=True))
            keys = [batch[k].take(pa.array(row)) for k in _ID]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(anchor), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(seed), pa.array(stretch)], [*_ID, "anchor", "low", "high", "seed", "stretch"])


def _fetch(batches):
    """The bytes of the stretches asked for."""
    names = [*_ID, "anchor", "low", "high", "seed", "asked", "bytes"]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for doc, key, frame, asked in zip(*(batch[c].to_pylist() for c in (*_ID, "packed", "asked")), strict=True):
            text = _unpack(frame)
            for x in asked:
                found = (doc, key, x["anchor"], x["low"], x["high"], x["seed"], x["asked"], text[x["anchor"] - x["high"] : x["anchor"] - x["low"] + WINDOW].tobytes())
                for col, v in zip(cols, found, strict=True):
                    col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def _windows(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(row, offset from the anchor, name) of each window in these stretches."""
    size = (rows["high"] - rows["low"] + 1).to_numpy()
    data = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
    begin = np.cumsum(np.r_[0, size[:-1] + WINDOW - 1])
    row = np.repeat(np.arange(len(rows)), size)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    start = begin[row] + step
    names = common.window_hash(common.prefix_hash(data), start, start + WINDOW)
    return row, rows["high"].to_numpy()[row] - step, names


def _offset_name(seed: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return common.mix64(seed.view(np.uint64) + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _compare(batches):
    """Streams stretches sorted by seed: repeated windows among the stretches of each, as runs of consecutive starts."""
    held: list[pa.RecordBatch] = []

    def repeated(table: pa.Table) -> pa.RecordBatch:
        rows = table.to_pandas()
        row, offset, names = _windows(rows)
        pair = _offset_name(rows["seed"].to_numpy()[row], offset)
        order = np.lexsort((names, pair))
        same = (pair[order][1:] == pair[order][:-1]) & (names[order][1:] == names[order][:-1])
        twice = np.zeros(len(row), bool)
        twice[order] = np.r_[same, False] | np.r_[False, same]
        keep = twice & rows["asked"].to_numpy()[row]
        row, start = row[keep], (rows["anchor"].to_numpy()[row] - offset)[keep]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]) if len(row) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(row)][: len(first)] - 1
        keys = [pa.array(rows[k].to_numpy()[row[first]]) for k in _ID]
        return pa.RecordBatch.from_arrays([*keys, pa.array(start[first]), pa.array(start[last] + WINDOW)], [*_ID, "start", "end"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 2048:
            table = pa.Table.from_batches(held)
            seeds = table["seed"].to_numpy()
            whole = int(np.searchsorted(seeds, seeds[-1]))  # the last seed may go on
            if whole:
                yield repeated(table.slice(0, whole))
                held = table.slice(whole).to_batches()
    if held and sum(b.num_rows for b in held):
        yield repeated(pa.Table.from_batches(held))


def _name(batches):
    """Names of single windows as rows, for anchors too frequent to compare in one task."""
    for batch in batches:
        rows = batch.to_pandas()
        if len(rows):
            row, offset, names = _windows(rows)
            pair = _offset_name(rows["seed"].to_numpy()[row], offset)
            keys = [batch[k].take(pa.array(row)) for k in _ID]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(rows["anchor"].to_numpy()[row] - offset), pa.array(pair.view(np.int64)), pa.array(names.view(np.int64)), pa.array(rows["asked"].to_numpy()[row])], [*_ID, "start", "first", "second", "asked"])


def _cut(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])
    for batch in batches:
        rows = []
        for doc, frame, spans in zip(*(batch[c].to_pylist() for c in ("doc_id", "packed", "spans")), strict=True):
            text, merged = _unpack(frame), []
            for x in sorted((x["start"], x["end"]) for x in spans or ()):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append([*x])
            digest, at = hashlib.sha256(), 0
            for lo, hi in merged:
                digest.update(text[at:lo])
                at = hi
            digest.update(text[at:])
            rows.append((doc, len(text), sum(hi - lo for lo, hi in merged), len(merged), digest.hexdigest(), merged))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed spans of bytes, for each document.

    A row is known by doc_id and a hash of doc_id and text; equal rows share what is removed.
    """
    common.text_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc_key"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    packed = keyed.mapInArrow(_pack, "doc_id long, doc_key long, row_key long, packed binary")
    runs = common.materialize(keyed.mapInArrow(_rank, _RUNS))
    # Round 1: anchors whose seed occurs once are unique. Round 2: classes of equal stretches among the others, counted
    # before they meet by seed, so that a frequent seed is as many rows as it has different stretches.
    seeds = runs.groupBy("seed").agg(F.count("*").alias("all")).filter("all > 1").select("seed")
    stretch = ["seed", "low", "high", "stretch"]
    classes = runs.groupBy(*stretch).agg(F.count("*").alias("n"), F.min(F.struct(*_ID, "anchor")).alias("one"))
    classes = common.materialize(classes.join(seeds, "seed", "left_semi"))
    twice = classes.filter("n > 1")
    open_seeds = classes.groupBy("seed").agg(F.count_if(F.col("n") == 1).alias("single"), F.count("*").alias("members")).filter("single > 0").select("seed", "members")
    whole = runs.join(twice.select(*stretch), stretch, "left_semi").select(*_ID, (F.col("anchor") - F.col("high")).alias("start"), (F.col("anchor") - F.col("low") + WINDOW).alias("end"))
    # Round 3: the unique stretches, and one of each repeated class for them to meet.
    asked = classes.join(open_seeds, "seed", "left_semi").select("one.*", *stretch[:3], (F.col("n") == 1).alias("asked"))
    asked = asked.groupBy(*_ID).agg(F.collect_list(F.struct("anchor", "low", "high", "seed", "asked")).alias("asked"))  # as many as the text has anchors
    fetched = packed.join(asked, _ID).select(*_ID, "packed", "asked").dropDuplicates(_ID).mapInArrow(_fetch, _BYTES)
    fetched = common.materialize(fetched)
    sizes = open_seeds.select("seed", (F.col("members") > TOGETHER).alias("many"))
    few = fetched.join(sizes.filter("not many"), "seed", "left_semi").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seed").sortWithinPartitions("seed")
    few = few.select(*fetched.columns).mapInArrow(_compare, _SPANS)
    names = fetched.join(sizes.filter("many"), "seed", "left_semi").select(*fetched.columns).mapInArrow(_name, _NAMES)
    again = names.groupBy("first", "second").agg(F.count("*").alias("n")).filter("n > 1")
    rest = names.filter("asked").join(again, ["first", "second"], "left_semi").select(*_ID, "start", (F.col("start") + WINDOW).alias("end"))
    spans = whole.unionByName(few).unionByName(rest).groupBy(*_ID).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = common.materialize(spans)
    return packed.join(spans, _ID, "left").select("doc_id", "packed", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
