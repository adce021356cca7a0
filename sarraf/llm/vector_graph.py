"""Near-duplicate vectors over a robust-pruned flat graph.

Vectors go to the shards of their OVERLAP nearest centroids. A shard over SHARD rows is split again by centroids of
its own, fitted on its own sample, so shards do not grow with the table; what centroids cannot split, since they would
all lie within one dense group, is dealt into parts that meet in pairs. Each shard builds a graph: the nearest
candidates of a vector, pruned so that no kept neighbour is much nearer to a candidate than the vector itself (factor
ALPHA). Adjacency lists of a vector from its shards are united. Then each shard is searched over the united lists and
their reverse edges: every vector starts at the medoid, at spread places and at itself, goes on greedily to the nearest
neighbours met, and wherever a vector within range is met its neighbours are met too, until the range is exhausted.
Only what the search meets is compared, by cosine in double precision, which verifies the link; it is counted in the
first shard that both vectors share, and links are joined into components. Equal vectors are one node with a count.

Centroids are fitted on at most SAMPLE vectors, those of a shard on at most SAMPLE of its vectors; every vector is
indexed. audit() measures recall against brute force.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers have no links; vectors of
different lengths do not link; equal rows link; rows with a null vec_id count as links of others, and component_id is
the least vec_id that is not null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 0.95
OVERLAP, SHARD, SAMPLE = 3, 1024, 20_000
#: Rows of (shard, parts), 16 bytes each, that may be broadcast; beyond, the join shuffles.
PARTS_BROADCAST = 500_000
#: Centroids fitted at once, and rows of a shard that are dealt to its own centroids in one task.
CENTROIDS, DEALT = 1024, 16_384
#: Centroids this near to a larger one are dropped.
APART = 0.7
DEGREE, CANDIDATES, ALPHA = 16, 48, 1.2
#: Nearest vectors that a search holds, those that it goes on from in a round, places where it starts, and cosines at once.
BEAM, STEPS, STARTS, COSINES = 8, 4, 4, 1 << 18


def _unit(col) -> list[np.ndarray | None]:
    out = []
    for x in col:
        v = None if x is None else np.array([np.nan if y is None else y for y in x], np.float64)
        if v is None or not len(v) or not np.isfinite(v).all() or not np.abs(v).max() > 0:
            out.append(None)
        else:
            v = v / np.abs(v).max()
            out.append(v / np.sqrt(v @ v))
    return out


def _normalise(batches):
    for batch in batches:
        units = _unit(batch["embedding"].to_pylist())
        yield pa.RecordBatch.from_arrays([batch["vec_id"].cast(pa.int64()), pa.array([None if u is None else u.tobytes() for u in units], pa.binary())], ["vec_id", "unit"])


def fit(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means of a sample, without centroids within one dense group."""
    x = x[np.lexsort(x.T[::-1])]
    k = int(np.clip(k, 1, min(len(x), CENTROIDS)))
    rng = np.random.Generator(np.random.PCG64(11))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        of = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        norm = np.sqrt((sums**2).sum(1, keepdims=True))
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    apart: list[int] = []
    for i in np.argsort(-np.bincount((x @ c.T).argmax(1), minlength=k), kind="stable"):
        if not apart or (c[apart] @ c[i]).max() < APART:  # else one dense group would be split over its own centroids
            apart.append(int(i))
    return c[apart]


def _wanted(rows: int) -> int:
    """Centroids for so many rows: with OVERLAP, shards come to about half of SHARD, as they differ in size."""
    return -(-2 * OVERLAP * rows // SHARD)


def centroids(nodes: DataFrame, dim: int) -> np.ndarray:
    """Centroids of the vectors of one length, from a sample by hash."""
    mine = nodes.filter(F.octet_length("unit") == 8 * dim)
    total = mine.count()
    picked = mine.filter(_drawn(F.lit(total))).select("unit").limit(SAMPLE).collect()
    x = np.stack([np.frombuffer(bytes(r["unit"]), np.float64) for r in picked]) if picked else np.eye(1, dim)
    return fit(x, _wanted(total))


def _drawn(total):
    """About 0.9 * SAMPLE of so many rows, by hash."""
    return F.pmod(F.xxhash64("unit", F.lit(5)), F.lit(1_000_000)) < 1 + 1e6 * F.least(F.lit(1.0), F.lit(0.9 * SAMPLE) / total)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :OVERLAP]


def _assign(held):
    """A row for each of a vector's shards; a shard is known by the vectors' length and its centroid."""

    def run(batches):
        for batch in batches:
            units = batch["unit"].to_pylist()
            size = np.array([len(u) for u in units], np.int64)
            for w in np.unique(size).tolist():
                own = np.flatnonzero(size == w)
                near = _nearest(np.frombuffer(b"".join(units[i] for i in own), np.float64).reshape(len(own), -1), held.value[w // 8])
                rows = pa.array(np.repeat(own, near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch["node"].take(rows), batch["unit"].take(rows), pa.array((w << 32) + (near.ravel().astype(np.int64) << 16))], ["node", "unit", "shard"])

    return run


def _own_centroids(pdf: pd.DataFrame) -> pd.DataFrame:
    """Centroids of one large shard from its sample."""
    x = np.stack([np.frombuffer(u, np.float64) for u in pdf["unit"].iloc[:SAMPLE]])
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "centroids": [fit(x, _wanted(int(pdf["size"].iloc[0]))).tobytes()]})


def _deal(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """Rows of a large shard to the shards of its own centroids."""
    if not len(rows):
        return pd.DataFrame({"node": [], "unit": [], "shard": []})
    x = np.stack([np.frombuffer(u, np.float64) for u in rows["unit"]])
    near = _nearest(x, np.frombuffer(own["centroids"].iloc[0], np.float64).reshape(-1, x.shape[1]))
    i = np.repeat(np.arange(len(rows)), near.shape[1])
    return pd.DataFrame({"node": rows["node"].to_numpy()[i], "unit": rows["unit"].to_numpy()[i], "shard": rows["shard"].to_numpy()[i] + 1 + near.ravel()})


def prune(sims: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row of a square of cosines (distance 1 - cosine)."""
    n, dist = len(sims), 1 - sims
    np.fill_diagonal(dist, np.inf)
    m = min(CANDIDATES, n - 1)
    if m <= 0:
        return [np.zeros(0, np.int64)] * n
    near = np.argpartition(dist, m - 1, axis=1)[:, :m]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(dist, near, 1), axis=1, kind="stable"), 1)
    own = np.take_along_axis(dist, near, 1)
    between = dist[near[:, :, None], near[:, None, :]] if n <= 256 else None
    alive, kept = np.ones((n, m), bool), np.zeros((n, m), bool)
    for k in range(m):
        take = alive[:, k] & (kept.sum(1) < DEGREE)
        kept[take, k] = True
        to = between[:, k, :] if between is not None else dist[near[:, k][:, None], near]
        alive &= ~(take[:, None] & (ALPHA * to <= own))
    return [near[i][kept[i]] for i in range(n)]


def neighbours(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lists and their reverse edges: where those of each node begin, and all of them end to end."""
    n = len(lists)
    i, j = np.repeat(np.arange(n), [len(x) for x in lists]), np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
    code = np.unique(np.r_[i * n + j, j * n + i])
    code = code[code // n != code % n]
    return np.searchsorted(code, np.arange(n + 1) * n), code % n


def _around(q: np.ndarray, v: np.ndarray, first: np.ndarray, near: np.ndarray, n: int) -> np.ndarray:
    """The neighbours of places v for queries q, as q * n + neighbour; if they are many, by a product of 0-1 matrices."""
    size = first[v + 1] - first[v]
    if size.sum() > 64 * n:
        where, near_to = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
        where[q, v] = 1
        near_to[np.repeat(np.arange(n), np.diff(first)), near] = 1
        asks = np.unique(q)
        reach = np.flatnonzero(where[asks] @ near_to)
        return asks[reach // n] * n + reach % n
    at = np.repeat(first[v], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.unique(np.repeat(q, size) * n + near[at])


def search(x: np.ndarray, first: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within range that greedy search with range expansion meets; all rows ask, round by round.

    first, near: neighbours(). A round goes on from all places of each query that are within range, and from the STEPS
    nearest that are among the BEAM nearest met. Cosines are worked out for what a round meets, and for nothing else.
    """
    n = len(x)
    rng = np.random.Generator(np.random.PCG64(n))
    start = np.unique(np.r_[(x @ x.mean(0)).argmax(), rng.choice(n, min(n, STARTS), replace=False)])
    seen = np.zeros((n, n), bool)
    met = np.unique(np.r_[(np.arange(n)[:, None] * n + start).ravel(), np.arange(n) * n + np.arange(n)])
    open_q, open_x, open_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    best, links = np.full((n, BEAM), -2.0), []
    while len(met):
        seen.ravel()[met] = True
        q, v = met // n, met % n
        s = np.concatenate([np.einsum("ij,ij->i", x[q[lo : lo + COSINES]], x[v[lo : lo + COSINES]]) for lo in range(0, len(q), COSINES)])
        within = (s >= LEAST) & (q != v)
        links.append(met[within])
        # The BEAM best of each query so far: new ones are ranked within their query and merged.
        order = np.lexsort((-s, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        top = place < BEAM
        new = np.full((n, BEAM), -2.0)
        new[q[order][top], place[top]] = s[order][top]
        best = -np.sort(-np.concatenate([best, new], axis=1), axis=1)[:, :BEAM]
        open_q, open_x, open_s = np.r_[open_q, q], np.r_[open_x, v], np.r_[open_s, s]
        keep = (open_s >= LEAST) | (open_s >= best[open_q, -1])
        open_q, open_x, open_s = open_q[keep], open_x[keep], open_s[keep]
        order = np.lexsort((-open_s, open_q))
        place = np.arange(len(order)) - np.searchsorted(open_q[order], open_q[order])
        open_q, open_x, open_s, met = open_q[order], open_x[order], open_s[order], met[:0]
        while not len(met) and len(open_q):  # from the next places, if all around these has been met
            now = (place < STEPS) | (open_s >= LEAST)
            met = _around(open_q[now], open_x[now], first, near, n)
            met = met[~seen.ravel()[met]]
            open_q, open_x, open_s, place = open_q[~now], open_x[~now], open_s[~now], place[~now] - STEPS
    found = np.concatenate(links) if links else np.zeros(0, np.int64)
    return found // n, found % n


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adjacency lists of one part of a shard."""
    x, ids = np.stack([np.frombuffer(u, np.float64) for u in pdf["unit"]]), pdf["node"].to_numpy()
    return pd.DataFrame({"node": ids, "near": [ids[k] for k in prune(x @ x.T)]})


def _link(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between two parts of a shard, or within one: counts by node, and edges that join what is linked."""
    pdf = pdf.sort_values(["part", "node"], kind="stable").reset_index(drop=True)
    x, ids, n, part = np.stack([np.frombuffer(u, np.float64) for u in pdf["unit"]]), pdf["node"].to_numpy(), pdf["n"].to_numpy(), pdf["part"].to_numpy()
    shard, place = pdf["shard"].iloc[0], {v: i for i, v in enumerate(ids)}
    i, j = search(x, *neighbours([np.array([place[v] for v in near if v in place], np.int64) for near in pdf["near"]]))
    code = np.unique(np.r_[i * len(ids) + j, j * len(ids) + i])  # a link found from one end holds for both
    i, j = code // len(ids), code % len(ids)
    x_, y_ = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
    if x_ != y_:
        across = part[i] != part[j]
        i, j = i[across], j[across]
    first = pdf["shards"].to_numpy()
    keep = np.fromiter((min(set(first[a]) & set(first[b])) == shard for a, b in zip(i, j, strict=True)), bool, len(i))
    i, j = i[keep], j[keep]
    counts = np.bincount(i, n[j], len(ids)).astype(np.int64)
    low = np.arange(len(ids))
    while len(i):  # least linked node, by pointer jumping within this part
        new = low.copy()
        np.minimum.at(new, i, low[j])
        new = new[new]
        if (new == low).all():
            break
        low = new
    rows = np.flatnonzero(counts)
    return pd.DataFrame({"node": ids[rows], "links": counts[rows], "other": ids[low[rows]]})


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector."""
    spark = vectors.sparkSession
    rows = common.materialize(vectors.select("vec_id", "embedding").mapInArrow(_normalise, "vec_id long, unit binary").withColumn("node", F.xxhash64("unit")))
    nodes = common.materialize(rows.filter("unit is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("unit").alias("unit"), F.min("vec_id").alias("least")))
    dims = [r[0] // 8 for r in nodes.select(F.octet_length("unit")).distinct().collect()]
    held = spark.sparkContext.broadcast({d: centroids(nodes, d) for d in dims})
    placed = common.materialize(nodes.select("node", "unit").mapInArrow(_assign(held), "node long, unit binary, shard long"))
    sizes = common.materialize(placed.groupBy("shard").agg(F.count("*").alias("size")))
    large = F.broadcast(sizes.filter(F.col("size") > SHARD))  # at most CENTROIDS rows a vector length
    own = placed.join(large, "shard").filter(_drawn(F.col("size"))).groupBy("shard").applyInPandas(_own_centroids, "shard long, centroids binary")
    own = common.materialize(own)
    tasks = F.ceil(F.col("size") / DEALT)
    salted = placed.join(large, "shard").withColumn("salt", F.pmod(F.xxhash64("node"), tasks)).select("shard", "salt", "node", "unit")
    spread = own.join(large, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1))).select("shard", "salt", "centroids")
    dealt = salted.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(_deal, "node long, unit binary, shard long")
    placed = placed.join(large, "shard", "left_anti").unionByName(dealt)
    placed = common.materialize(placed.join(nodes.select("node", "n"), "node"))
    mine = placed.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("shards"))  # at most OVERLAP * OVERLAP
    parts = common.materialize(placed.groupBy("shard").agg(F.ceil(F.count("*") / SHARD).alias("parts")))
    placed = placed.join(mine, "node").join(F.broadcast(parts) if parts.count() <= PARTS_BROADCAST else parts, "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = common.materialize(placed)
    near = placed.groupBy("shard", "part").applyInPandas(_build, "node long, near array<long>").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    met = placed.join(near, "node").withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)"))).withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other"))
    found = common.materialize(met.groupBy("shard", "x", "y").applyInPandas(_link, "node long, links long, other long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = common.components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.select("node", "n", "least").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = common.materialize(named)
    least = common.materialize(named.groupBy("root").agg(F.min("least").alias("component")))
    named = named.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    return rows.select("vec_id", "node", F.col("unit").isNotNull().alias("fit")).join(named, "node", "left").select(
        "vec_id", F.when(F.col("fit"), F.col("links")).otherwise(0).cast("long").alias("n_links"), F.when(F.col("fit"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def audit(vectors: DataFrame, found: DataFrame, every: int = 50) -> float:
    """Recall of links: the vectors whose id is divisible by `every`, compared with all rows in blocks."""
    spark = vectors.sparkSession
    ask = vectors.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding").collect()
    units = [(r["vec_id"], u) for r, u in zip(ask, _unit([r["embedding"] for r in ask]), strict=True) if u is not None]
    held = spark.sparkContext.broadcast(units)

    def run(batches):
        for batch in batches:
            total = np.zeros(len(held.value), np.int64)
            for v, u in zip(batch["vec_id"].to_pylist(), _unit(batch["embedding"].to_pylist()), strict=True):
                if u is not None:
                    total += np.array([len(q) == len(u) and i != v and q @ u >= LEAST for i, q in held.value])
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held.value], pa.int64()), pa.array(total)], ["vec_id", "links"])

    true = vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, links long").groupBy("vec_id").agg(F.sum("links").alias("links"))
    a, b = true.join(found, "vec_id").agg(F.sum(F.least("links", "n_links")), F.sum("links")).first()
    return 1.0 if not b else a / b
