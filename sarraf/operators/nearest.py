"""Exact nearest neighbours by blocks: queries and corpus meet in bounded groups, each one product of two matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows, about, of either side in a group, and queries that a group measures at once.
QUERY_BLOCK, CORPUS_SLICE, STEP = 8192, 32768, 256
#: Room for rounding of a squared distance out of a product, as a share of both squared lengths.
ROOM = 1e-11
#: Components from here on are measured one by one, as their squares may overflow.
LARGE = 1e100


def blocks(asked: DataFrame, corpus: DataFrame, k: int, key: str, part: str) -> DataFrame:
    """(query_id, key, distance): for each query at least its k nearest by L2 within each part that it asks, ties by key.

    asked: (part, query_id, _q, bound); rows farther than a bound that is not null may be left out. corpus: (part, key,
    embedding). Only the sizes of the parts are broadcast. A pair without a distance (a null vector or component, unlike
    lengths) is null and comes after all others.
    """
    slices = corpus.groupBy(part).agg(F.ceil(F.count("*") / CORPUS_SLICE).alias("_slices"))
    shape = F.broadcast(asked.groupBy(part).agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("_blocks")).join(slices, part))  # a row a part

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        far = F.sequence(F.lit(0).cast("long"), F.col(other) - 1)
        rows = df.join(shape, part).withColumn(own, F.pmod(F.xxhash64(by), F.col(own)))
        return rows.withColumn(other, F.explode(far))

    left = dealt(asked, "query_id", "_blocks", "_slices").select(part, "_blocks", "_slices", "query_id", F.col("_q").cast("array<double>").alias("_q"), "bound")
    right = dealt(corpus, key, "_slices", "_blocks").select(part, "_blocks", "_slices", F.col(key).alias("_key"), F.col("embedding").cast("array<double>").alias("_v"))
    ids, keys = asked.schema["query_id"].dataType.simpleString(), corpus.schema[key].dataType.simpleString()
    by = [part, "_blocks", "_slices"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda q, c: _group(q, c, k, key), f"query_id {ids}, `{key}` {keys}, distance double")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each list, -1 where it or a component is null; start of each list; all components)."""
    a = pa.concat_arrays(column.chunks)
    n = np.asarray(pc.fill_null(pc.list_value_length(a), 0), dtype=np.int64)
    start, flat = np.cumsum(n) - n, a.flatten()
    n[np.asarray(pc.is_null(a))] = -1
    if flat.null_count:
        n[np.searchsorted(start, np.flatnonzero(np.asarray(pc.is_null(flat))), side="right") - 1] = -1
    return n, start, flat.to_numpy(zero_copy_only=False)


def _group(q: pa.Table, c: pa.Table, k: int, key: str) -> pa.Table:
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if q.num_rows and c.num_rows:
        c = c.take(pc.sort_indices(c, sort_keys=[("_key", "ascending")], null_placement="at_start"))  # so places order ties
        (n, start, x), (m, begin, y) = _lists(q["_q"]), _lists(c["_v"])
        bound = q["bound"].to_numpy()
        bound = np.where(np.isnan(bound), np.inf, bound)
        for dims in np.unique(n):
            qs, cs = np.flatnonzero(n == dims), np.flatnonzero(m == dims) if dims >= 0 else np.zeros(0, dtype=np.int64)
            if dims >= 0 and len(cs):
                mine, theirs = (v[s[:, None] + np.arange(dims)] for v, s in ((x, start[qs]), (y, begin[cs])))
                found = _measured(mine, theirs, k, bound[qs])
                out += [(qs[i], cs[j], d) for i, j, d in found]
            if len(cs) < k:  # places are left for pairs without a distance
                blank = np.setdiff1d(np.arange(len(m)), cs)[:k]
                qs = qs[bound[qs] == np.inf]
                out.append((np.repeat(qs, len(blank)), np.tile(blank, len(qs)), np.full(len(qs) * len(blank), -1.0)))
    i, j, d = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    return pa.table({"query_id": q["query_id"].take(pa.array(i)), key: c["_key"].take(pa.array(j)), "distance": pa.array(d, mask=d < 0)})


def _measured(q: np.ndarray, c: np.ndarray, k: int, bound: np.ndarray):
    """(query, row, distance) of the k nearest rows of each query, a step of queries at a time.

    A product finds the rows that can be among them; those are measured again, component by component as in vectors.l2.
    """
    plain = (np.abs(c) < LARGE).all(axis=1)
    odd, plain = np.flatnonzero(~plain), np.flatnonzero(plain)
    even = c[plain]
    c2, by_component = np.einsum("ij,ij->i", even, even), np.ascontiguousarray(c.T)
    for at in range(0, len(q), STEP):
        ask = q[at : at + STEP]
        usual = (np.abs(ask) < LARGE).all(axis=1)
        near = np.ones((len(ask), len(plain)), dtype=bool)
        if usual.any():
            few = ask[usual]
            both = np.einsum("ij,ij->i", few, few)[:, None] + c2
            most = both * (1 + ROOM) - 2 * (few @ even.T)
            limit = np.square(bound[at : at + STEP][usual])
            if len(plain) > k:
                limit = np.minimum(limit, np.partition(most, k - 1, axis=1)[:, k - 1])
            near[usual] = most - 2 * ROOM * both <= limit[:, None]
        i, j = np.nonzero(near)
        i, j = np.concatenate([i, np.repeat(np.arange(len(ask)), len(odd))]), np.concatenate([plain[j], np.tile(odd, len(ask))])
        total = np.zeros(len(i))
        with np.errstate(all="ignore"):
            for n, column in enumerate(by_component):
                gap = column[j] - ask[i, n]
                total += gap * gap
        distance = np.sqrt(total)
        order = np.lexsort((j, distance, i))
        i, j, distance = i[order], j[order], distance[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield i[first] + at, j[first], distance[first]
