"""Centroid clustering in whole numbers, by JVM expressions alone.

Vectors become arrays of longs once. Centroids are literals of the plan: zip_with and aggregate give the squared
distance to each, array_min of (distance, number) picks the nearest, and column sums by cluster give the next
centroids. A round is one scan with a partial sum of as many columns as there are components; the driver sees one row
a cluster.

Defined cases: vectors that are null, have another number of components, or hold null or non-finite ones are left
out; rows of equal vec_id count each, and as first centroids the one with the lesser components comes first; a null
vec_id is a first centroid only where there are no others left; with fewer vectors than clusters there are as many
clusters as vectors; numbers beyond a long stop at its ends, sums and distances too; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LONGEST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component of the vectors that are whole and finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").filter((F.size("embedding") == dims) & finite).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("q"))


def first_centroids(q: DataFrame, k: int, seed: int) -> list[list[int]]:
    """Components of the k vectors with the least hash of seed and vec_id; at most k rows come to the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.q for r in q.select(key.alias("key"), "q").orderBy(F.asc_nulls_last("key"), "q").limit(k).collect()]


def nearest(centres: list[list[int]], wide: bool) -> Column:
    """Struct (distance, cluster) of the nearest centre, the lesser number on ties."""
    square, add = ("try_multiply(try_subtract(a, b), try_subtract(a, b))", "try_add(s, x)") if wide else ("(a - b) * (a - b)", "s + x")

    def distance(c: list[int]) -> str:
        at = ", ".join("-9223372036854775807L - 1L" if x == -LONGEST - 1 else f"{x}L" for x in c)
        d = f"aggregate(zip_with(q, array({at}), (a, b) -> {square}), 0L, (s, x) -> {add})"
        return f"coalesce({d}, {LONGEST}L)" if wide else d

    return F.expr("array_min(array(" + ", ".join(f"struct({distance(c)} AS distance, {i} AS cluster)" for i, c in enumerate(centres)) + "))")


def next_centroids(q: DataFrame, centres: list[list[int]], wide: bool) -> list[list[int]]:
    """Floors of the means of each cluster's components; a cluster without vectors keeps its centre."""
    col = (lambda i: F.col("q")[i].cast("decimal(38,0)")) if wide else (lambda i: F.col("q")[i])
    sums = q.select(nearest(centres, wide)["cluster"].alias("cluster"), "q").groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(col(i)).alias(f"s{i}") for i in range(len(centres[0]))))
    out = list(centres)
    for cluster, n, *total in sums.collect():  # one row a cluster
        out[cluster] = [int(s) // n for s in total]
    return out


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """Each whole vector with cluster, distance, cluster_inertia, inertia, centroid and centroid_sha256."""
    q = materialize(whole_vectors(vectors, dims, scale))
    n, least, most = q.agg(F.count("*"), F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    spark, shape = q.sparkSession, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    if not n:
        return q.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).join(F.broadcast(spark.createDataFrame([], shape)), "cluster")
    largest = max(most, -least)
    wide = largest >= 1 << 27 or 4 * dims * largest * largest >= 1 << 62 or n * largest >= 1 << 62  # else no sum of squares or column leaves a long
    centres = first_centroids(q, k, seed)
    for _ in range(rounds):
        centres = next_centroids(q, centres, wide)
    at = materialize(q.select("vec_id", nearest(centres, wide).alias("at")).select("vec_id", "at.cluster", "at.distance"))
    inertia = {c: int(s) for c, s in at.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    total = min(LONGEST, sum(inertia.values()))
    told = [(c, min(LONGEST, s), total, centres[c], hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for c, s in inertia.items()]
    return at.join(F.broadcast(spark.createDataFrame(told, shape)), "cluster")  # k rows
