"""Vector similarity in column expressions: cosine, nearest neighbours, centroids, clusters, a coarse index."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import semantic_text
from ..plans.runtime import cut
from ..sources import versions
from . import nearest

#: Rows of a side that may be broadcast; a larger side is dealt into blocks that meet the other's blocks.
BROADCAST_ROWS = 50_000
BLOCK = 4096


def parse_vector(c: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(c, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("float"))


def vector_text(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def against(few: DataFrame, many: DataFrame) -> DataFrame:
    """Every row of a stated, small side with every row of the other: broadcast up to BROADCAST_ROWS, else by blocks of the small side."""
    n = few.count()
    if n <= BROADCAST_ROWS:
        return many.join(F.broadcast(few))
    blocks = -(-n // BLOCK)
    dealt = few.withColumn("_b", F.pmod(F.xxhash64(*few.columns[:1]), F.lit(blocks)))
    return many.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_b", F.col("_b").cast("long")).join(dealt, "_b").drop("_b")


def best_match(rows: DataFrame, key: str, labels: DataFrame, label: str) -> DataFrame:
    """The label of the best cosine for each row; ties go to the greatest label. labels: (label, embedding)."""
    pairs = against(labels.select(label, F.col("embedding").alias("_v")), rows.select(key, "embedding")).withColumn("score", cosine(F.col("embedding"), F.col("_v")))
    return pairs.groupBy(key).agg(F.max(F.struct("score", label)).alias("m")).select(key, f"m.{label}", "m.score")


def knn(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k nearest of the corpus, or of its rows where a condition holds, to each query by L2. Blocks of both sides meet as products; k rows a query and slice of the corpus are shuffled."""
    corpus = corpus if where is None else corpus.filter(where)
    q = queries.select(F.lit(0).alias("_part"), F.col(key).alias("query_id"), F.col("embedding").alias("_q"), F.lit(None).cast("double").alias("bound"))
    pairs = nearest.blocks(q, corpus.select(F.lit(0).alias("_part"), key, "embedding"), k, key, "_part")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), key))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def _meets(width: float) -> float:
    """How often two points fall into one cell of a random projection, with cells so many deviations of their difference wide."""
    tail = 0.5 * math.erfc(width / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def hash_shape(n: int, radius: float, far: float, recall: float) -> tuple[int, int]:
    """(projections a band, bands): enough of the first that a row meets about one of n far rows a band, and of the second
    that two rows at the radius share a band with the given probability."""
    near, apart = _meets(4.0), _meets(4.0 * radius / far)
    k = max(1, math.ceil(math.log(max(2, n)) / -math.log(apart)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def candidates(a: DataFrame, b: DataFrame, radius: float, far: float, recall: float = 0.98, seed: int = 11) -> DataFrame:
    """(a_id, b_id): pairs that share a band of random projections. a: (a_id, v), b: (b_id, v), double arrays of one length.

    Two rows at the radius or nearer are among them with the given probability at least; rows `far` apart meet about
    once a band for each row. Only ids and band hashes are shuffled.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark, (n, dims) = b.sparkSession, b.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return a.join(b.select("b_id"), F.lit(False)).select("a_id", "b_id")
    k, bands = hash_shape(n, radius, far, recall)
    cell = 4.0 * radius / math.sqrt(dims)
    lsh = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=cell, numHashTables=k * bands, seed=seed)
    model = lsh.fit(spark.range(1).select(array_to_vector(F.array_repeat(F.lit(0.0), dims)).alias("x")))  # it learns nothing but the length

    def banded(df: DataFrame, key: str) -> DataFrame:
        cells = model.transform(df.select(key, array_to_vector("v").alias("x"))).select(key, F.transform("h", lambda x: vector_to_array(x)[0].cast("long")).alias("h"))
        return cells.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("h", i * k + 1, k)))).alias("band", "cell"))

    return banded(a, "a_id").join(banded(b, "b_id"), ["band", "cell"]).select("a_id", "b_id").distinct()


def near_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str, least: float, recall: float = 0.98) -> DataFrame:
    """(a_key, b_key, score): pairs of cosine `least` or more, by locality-sensitive hashing of unit vectors.

    Each pair is found with the given probability at least, which grows towards one as the cosine does. Vectors that are
    null, zero, or not finite have no pairs, and vectors of unlike lengths none with each other.
    """
    whole = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    unit = lambda df, key, name: cut(df.select(F.col(key).alias(name), F.col("embedding").cast("array<double>").alias("v")).filter(whole).withColumn("_n", F.sqrt(dot(F.col("v"), F.col("v")))).filter("_n > 0").select(name, F.transform("v", lambda x: x / F.col("_n")).alias("v")))
    left, right = unit(a, a_key, "a_id"), unit(b, b_key, "b_id")
    found = None
    for (dims,) in right.select(F.size("v")).distinct().collect():  # lengths, not vectors
        of = F.size("v") == dims
        part = candidates(left.filter(of), right.filter(of), math.sqrt(2 - 2 * least), math.sqrt(2), recall)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = left.join(right.select("b_id"), F.lit(False)).select("a_id", "b_id")
    scored = found.join(left, "a_id").join(right.withColumnRenamed("v", "_w"), "b_id").withColumn("score", dot(F.col("v"), F.col("_w")))
    return scored.filter(F.col("score") >= least).select(F.col("a_id").alias(a_key), F.col("b_id").alias(b_key), "score")


def knn_near(queries: DataFrame, corpus: DataFrame, k: int, least: float, key: str = "vec_id", recall: float = 0.98) -> DataFrame:
    """The k most similar of the corpus to each query among those of cosine `least` or more, by hashing; knn is exact."""
    pairs = near_pairs(queries.select(F.col(key).alias("query_id"), "embedding"), corpus, "query_id", key, least, recall)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def centroids(df: DataFrame, label: str = "label", at_least: int = 5) -> DataFrame:
    """Unit mean of the unit vectors of each label with enough of them, from averages by position."""
    unit = df.withColumn("_n", F.sqrt(dot(F.col("embedding"), F.col("embedding")))).filter("_n > 0").select(label, F.posexplode(F.transform("embedding", lambda x: x)).alias("pos", "x"), "_n")
    mean = unit.groupBy(label, "pos").agg(F.avg(F.col("x") / F.col("_n")).alias("x"), F.count("*").alias("n")).filter(F.col("n") >= at_least)
    out = mean.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c"))  # one entry a dimension
    norm = F.sqrt(dot(F.col("c"), F.col("c")))
    return out.select(label, "n", F.transform("c", lambda x: x / norm).alias("embedding"))


def clusters(df: DataFrame, text: str, label: str = "label", samples: int = 10, label_vectors: DataFrame | None = None) -> DataFrame:
    """Each label with its size, centroid where it has one, a few distinct texts, and its words of over two letters.

    With label_vectors (label, embedding), its labels are listed, those without rows too; a label without a centroid
    has its own vector.
    """
    first = df.select(label, text).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(text))).filter(F.col("_n") <= samples)
    few = first.groupBy(label).agg(F.array_sort(F.collect_list(text)).alias("samples"))  # at most `samples` entries
    out = df.groupBy(label).agg(F.count("*").alias("size")).join(centroids(df, label).select(label, "embedding"), label, "left").join(few, label, "left")
    if label_vectors is not None:
        out = label_vectors.select(label, F.col("embedding").cast("array<double>").alias("_own")).join(out, label, "left")
        out = out.withColumns({"size": F.coalesce("size", F.lit(0)), "embedding": F.coalesce("embedding", "_own"), "samples": F.coalesce("samples", F.array().cast("array<string>"))}).drop("_own")
    return out.withColumn("keywords", F.filter(F.split(F.lower(F.col(label).cast("string")), r"[/\s]+"), lambda w: F.length(w) > 2))


def resolve_format(new: DataFrame, formats: DataFrame, least: float = 0.92) -> DataFrame:
    """format_id of each layout: by fingerprint, else the most similar vector of the same bank, else of any, else new.

    new: (layout_id, fingerprint, source_bank, embedding); formats: (format_id, fingerprint, source_bank, embedding).
    If new has own_format, a layout is not compared with that one by vector. Vectors meet by hashing (near_pairs), equal
    ones of one bank once.
    """
    exact = new.join(formats.select("fingerprint", "format_id"), "fingerprint").select("layout_id", "format_id", F.lit("fingerprint").alias("method"))
    rest = cut(new.join(exact, "layout_id", "left_anti"))
    # Of formats with equal vectors the two greatest are enough: a layout's own one may be the first.
    second = F.row_number().over(Window.partitionBy("source_bank", "embedding").orderBy(F.desc("format_id")))
    known = cut(formats.filter("embedding is not null").select("format_id", "source_bank", "embedding").withColumn("_n", second).filter("_n <= 2").drop("_n"))
    # Equal vectors meet as one, whatever their banks and however many layouts have them.
    ours = cut(rest.filter("embedding is not null").groupBy("embedding").agg(F.min("layout_id").alias("a_vec")))
    theirs = cut(known.groupBy("embedding").agg(F.min("format_id").alias("b_vec")))
    near = near_pairs(ours, theirs, "a_vec", "b_vec", least)
    layouts = rest.join(ours, "embedding").select("layout_id", "source_bank", "a_vec", *(["own_format"] if "own_format" in new.columns else []))
    pairs = near.join(layouts, "a_vec").join(known.join(theirs, "embedding").select("format_id", F.col("source_bank").alias("_bank"), "b_vec"), "b_vec")
    if "own_format" in new.columns:
        pairs = pairs.filter(~F.col("own_format").eqNullSafe(F.col("format_id")))
    near = pairs.groupBy("layout_id").agg(F.max(F.struct((F.col("source_bank") == F.col("_bank")).alias("same"), "score", "format_id")).alias("m")).select("layout_id", "m.format_id", F.lit("vector").alias("method"))
    fresh = rest.join(near, "layout_id", "left_anti").select("layout_id", F.concat(F.lit("fmt-"), F.substring("fingerprint", 1, 16)).alias("format_id"), F.lit("new").alias("method"))
    return exact.unionByName(near).unionByName(fresh)


def bump_usage(formats: DataFrame, resolved: DataFrame, seen: Column | None = None) -> DataFrame:
    """Adds up uses; with a time, last_seen of the used formats becomes that."""
    used = resolved.groupBy("format_id").agg(F.count("*").alias("_n"))
    out = formats.join(used, "format_id", "left").withColumn("usage_count", F.col("usage_count") + F.coalesce("_n", F.lit(0)))
    if seen is not None:
        out = out.withColumn("last_seen", F.when(F.col("_n").isNotNull(), seen).otherwise(F.col("last_seen") if "last_seen" in formats.columns else F.lit(None)))
    return out.drop("_n")


def semantic_backfill(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows that lack text or vector, with their text made, in id order."""
    made = semantic_text(*(F.col(c) for c in ("operation_type_raw", "sdp_name", "purpose_text", "raw_note")))
    out = df.filter(F.col("semantic_text").isNull() | F.col("semantic_embedding").isNull()).withColumn("semantic_text", F.coalesce("semantic_text", made)).orderBy("tx_id")
    return out.limit(limit) if limit else out


class Index:
    """A stored inverted file: lists of vectors around centres, as a table by version with a folder for each list.

    Centres and cell size are fitted once. More vectors are put beside the others of their lists without a new fit; each
    addition notes the radius of what it brought to a list, so that a search knows how far a list reaches. A search
    reads the folders of the lists that it needs and no others.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id"):
        self.spark, self.path, self.key = spark, path, key
        self.lists, self.centres_at, self.radii = f"{path}/lists", f"{path}/centres", f"{path}/radii"

    @classmethod
    def build(cls, corpus: DataFrame, path: str, lists: int, key: str = "vec_id", seed: int = 3) -> Index:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        out = cls(corpus.sparkSession, path, key)
        vec = corpus.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        model = KMeans(k=lists, seed=seed, maxIter=10).fit(vec)
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        versions.append_new(out.spark.createDataFrame(centres, "list int, centre array<double>"), out.centres_at, None, ["list"])
        out.add(corpus)
        return out

    def centres(self) -> DataFrame:
        return versions.read(self.spark, self.centres_at)

    def add(self, more: DataFrame) -> None:
        """Adds vectors whose key the index lacks, each to the list of its nearest centre (the first of equally near ones)."""
        rows = more.select(self.key, "embedding")
        if versions.latest(self.spark, self.lists) is not None:
            rows = rows.join(versions.read(self.spark, self.lists).select(self.key), self.key, "left_anti")
        centres = self.centres().agg(F.collect_list(F.struct("list", "centre")).alias("_centres"))  # an entry a list
        gaps = F.transform("_centres", lambda c: F.struct(l2(F.col("embedding"), c["centre"]).alias("gap"), c["list"].alias("list")))
        rows = cut(rows.join(F.broadcast(centres)).withColumn("m", F.array_min(gaps)).select(self.key, "embedding", "m.list", "m.gap"))
        reach = rows.groupBy("list").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).withColumn("added", F.lit(uuid.uuid4().hex))
        versions.append_new(reach, self.radii, None, ["list", "added"])  # first, so that no list reaches farther than is known
        versions.append_new(rows.select(self.key, "embedding", "list"), self.lists, "list", [self.key])

    def reaches(self) -> DataFrame:
        """(list, centre, radius) of the lists that hold vectors."""
        return self.centres().join(F.broadcast(versions.read(self.spark, self.radii).groupBy("list").agg(F.max("radius").alias("radius"))), "list")

    def read(self, wanted: list[int]) -> DataFrame:
        return versions.read(self.spark, self.lists, [versions.key(str(i)) for i in wanted])

    def search(self, queries: DataFrame, k: int, probes: int = 4) -> DataFrame:
        """The k nearest of the index to each query by L2, exactly; see ivf_search. Only lists that some query needs are opened."""
        return _probe(queries, self.reaches(), self.read, k, probes, self.key)


def ivf_build(corpus: DataFrame, lists: int, key: str = "vec_id", seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """Coarse index: (corpus with its list, list centres) by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vec = corpus.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(vec)
    centres = corpus.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, centre array<double>")
    return cut(model.transform(vec).select(key, "embedding", F.col("prediction").alias("list"))), centres


def ivf_search(queries: DataFrame, indexed: DataFrame, centres: DataFrame, k: int, probes: int = 4, key: str = "vec_id") -> DataFrame:
    """The k nearest of the index to each query by L2, exactly.

    Each query reads its nearest lists first. A list whose centre is farther than its radius and the k-th distance found
    there holds none of the k nearest, by the triangle inequality; the other lists are read too.
    """
    radius = indexed.join(F.broadcast(centres), "list").groupBy("list").agg(F.max(l2(F.col("embedding"), F.col("centre"))).alias("radius"))  # a row a list
    return _probe(queries, centres.join(radius, "list"), lambda wanted: indexed.filter(F.col("list").isin(wanted)), k, probes, key)


def _probe(queries: DataFrame, reaches: DataFrame, opened: Callable[[list[int]], DataFrame], k: int, probes: int, key: str) -> DataFrame:
    q = queries.select(F.col(key).alias("query_id"), F.col("embedding").alias("_q"))
    near = F.row_number().over(Window.partitionBy("query_id").orderBy("gap", "list"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), key))
    lists = cut(q.join(F.broadcast(reaches)).withColumn("gap", l2(F.col("_q"), F.col("centre"))).withColumn("_n", near).select("query_id", "_q", "list", "gap", "radius", "_n"))  # a row a list

    def read(asked: DataFrame) -> DataFrame:
        wanted = [r[0] for r in asked.select("list").distinct().collect()]  # numbers of lists
        return nearest.blocks(asked, opened(wanted), k, key, "list")

    first = cut(read(lists.filter(F.col("_n") <= probes).select("query_id", "_q", "list", F.lit(None).cast("double").alias("bound"))).withColumn("_r", rank).filter(F.col("_r") <= k))
    bound = first.filter(F.col("_r") == k).select("query_id", (F.col("distance") * (1 + 1e-9) + 1e-9).alias("bound"))  # room for rounding
    rest = lists.filter(F.col("_n") > probes).join(bound, "query_id", "left").filter(F.col("bound").isNull() | (F.col("gap") - F.col("radius") <= F.col("bound")))
    more = read(cut(rest.select("query_id", "_q", "list", "bound")))
    return first.drop("_r").unionByName(more).withColumn("rank", rank).filter(F.col("rank") <= k)
