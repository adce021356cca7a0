"""The undirected payment graph: edges, neighbourhoods, merged names, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.runtime import cut
from .analytics import money

VALID = lambda c: ~text.is_unknown_iin(F.col(c))


def linked(df: DataFrame) -> DataFrame:
    """Payments between two valid ids that differ."""
    return df.filter(VALID("payer_iin_bin") & VALID("receiver_iin_bin") & (F.col("payer_iin_bin") != F.col("receiver_iin_bin")))


def edges(df: DataFrame) -> DataFrame:
    """source < target, amount and payments between two valid ids; no self-loops."""
    return linked(df).groupBy(F.least("payer_iin_bin", "receiver_iin_bin").alias("source"), F.greatest("payer_iin_bin", "receiver_iin_bin").alias("target")).agg(money("amount_kzt").alias("amount"), F.count("*").alias("tx_count"))


def both_ways(e: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.col("source").alias("other"))))
    return e.select(ends.alias("x"), "amount", "tx_count").select("x.*", "amount", "tx_count")


def neighbourhood(e: DataFrame, seed: str, depth: int | None = 2, k: int | None = 6) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, level) and edges around a seed: each level is one join of the frontier with the edges.

    Every expanded node keeps its k largest neighbours; an edge counts once.
    """
    ways = cut(both_ways(e))
    nodes = ways.sparkSession.createDataFrame([(seed, 0)], "id string, level int")
    front, kept, level = nodes.select("id"), None, 0
    while depth is None or level < depth:
        level += 1
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("amount"), "other"))
        out = ways.join(front.withColumnRenamed("id", "node"), "node").withColumn("_n", rank)
        out = cut(out.filter(F.col("_n") <= k).drop("_n") if k else out.drop("_n"))
        kept = out if kept is None else kept.unionByName(out)
        front = cut(out.select(F.col("other").alias("id")).distinct().join(nodes, "id", "left_anti"))
        if front.isEmpty():
            break
        nodes = cut(nodes.unionByName(front.withColumn("level", F.lit(level))))
    found = kept.select(F.least("node", "other").alias("source"), F.greatest("node", "other").alias("target"), "amount", "tx_count").distinct()
    return nodes, found


def node_turnover(nodes: DataFrame, e: DataFrame) -> DataFrame:
    total = both_ways(e).groupBy(F.col("node").alias("id")).agg(F.round(F.sum("amount"), 2).alias("total_turnover"))
    return nodes.join(total, "id", "left").fillna(0.0, ["total_turnover"])


def labels(df: DataFrame) -> DataFrame:
    """id and its least known name, on either side."""
    pair = F.explode(F.array(*(F.struct(F.col(f"{s}_iin_bin").alias("id"), F.col(f"{s}_name").alias("name")) for s in ("payer", "receiver"))))
    named = df.select(pair.alias("x")).select("x.*").filter(VALID("id"))
    return named.groupBy("id").agg(F.min(F.when(~text.is_unknown_name(F.col("name")), F.trim("name"))).alias("label"))


def merge_by_name(nodes: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, level, total_turnover) with one normal name become the nearest, largest of them; edges follow."""
    name = F.coalesce(F.nullif(text.norm_name(F.col("label")), F.lit("")), F.col("id"))
    first = Window.partitionBy("_name").orderBy("level", F.desc("total_turnover"), "id")
    alias = nodes.withColumn("_name", name).withColumn("to", F.first("id").over(first)).select("id", "to")
    merged = nodes.join(alias, "id").groupBy(F.col("to").alias("id")).agg(F.min("label").alias("label"), F.min("level").alias("level"), F.round(F.sum("total_turnover"), 2).alias("total_turnover"))
    a, b = (alias.select(F.col("id").alias(c), F.col("to").alias(f"_{c}")) for c in ("source", "target"))
    out = e.join(a, "source").join(b, "target").filter("_source <> _target").groupBy(F.least("_source", "_target").alias("source"), F.greatest("_source", "_target").alias("target")).agg(F.round(F.sum("amount"), 2).alias("amount"), F.sum("tx_count").alias("tx_count"))
    return merged, out


def top_nodes(df: DataFrame, limit: int) -> DataFrame:
    """Ids by turnover on both sides; invalid ids go after the cut."""
    pair = F.explode(F.array(F.struct(F.col("payer_iin_bin").alias("id")), F.struct(F.col("receiver_iin_bin").alias("id"))))
    total = df.select(pair.alias("x"), F.col("amount_kzt").alias("a")).select("x.id", "a").groupBy("id").agg(money("a").alias("turnover"))
    return total.orderBy(F.desc("turnover"), F.asc_nulls_last("id")).limit(limit).filter(VALID("id"))


def global_graph(df: DataFrame, limit_nodes: int = 200) -> tuple[DataFrame, DataFrame]:
    """Edges among the top nodes, and those nodes with turnover within the cut and a community."""
    top = F.broadcast(top_nodes(df, limit_nodes).select("id"))  # limit_nodes rows at most
    e = edges(df)
    e = cut(e.join(top.withColumnRenamed("id", "source"), "source", "left_semi").join(top.withColumnRenamed("id", "target"), "target", "left_semi"))
    groups = connected_components(e.select(F.col("source").alias("a"), F.col("target").alias("b")))
    nodes = both_ways(e).groupBy(F.col("node").alias("id")).agg(F.round(F.sum("amount"), 2).alias("total_turnover")).join(groups.select(F.col("node").alias("id"), F.col("root").alias("community_id")), "id")
    return nodes, e.select("source", "target", "amount", "tx_count")


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, root), root the least node connected, for each node of the pairs (a, b), which may recur.

    Each node's least and greatest neighbour make a small graph of the same nodes, whose components are found by star
    rounds. Pairs may join these; where one has most nodes, only pairs with a node outside it are looked at. Roots that
    pairs join are components of a graph of roots.
    """
    node, root = F.col("node"), F.col("root")
    e = cut(pairs.filter("a <> b").select("a", "b"))
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("x")).select("x.*")
    near = ends.groupBy("node").agg(F.min("other").alias("least"), F.max("other").alias("greatest"))
    roots = cut(_stars(near.select(node.alias("a"), F.explode(F.array("least", "greatest")).alias("b"))))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "root")).alias("largest"), F.sum("n").alias("n")).first()
    met, marked = e.select(F.col("a").alias("node"), F.col("b").alias("other")), roots
    if sizes["n"] and 2 * sizes["largest"]["n"] > sizes["n"]:
        met, marked = ends, cut(roots.filter(root != sizes["largest"]["root"]))
        if marked.isEmpty():
            return roots
    met = met.join(marked.select("node", root.alias("a")), "node").select(F.col("other").alias("node"), "a").distinct()
    met = cut(met.join(roots, "node").filter(root != F.col("a")).select("a", root.alias("b")).distinct())
    if met.isEmpty():
        return roots
    joined = connected_components(met).select(node.alias("root"), root.alias("_root"))
    return roots.join(joined, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))


def _stars(pairs: DataFrame) -> DataFrame:
    """Components by large-star and small-star rounds: grouped minima and joins, written out after each, until nothing changes."""
    a, b = F.col("a"), F.col("b")
    e = cut(pairs.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    while True:
        both = e.unionByName(e.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).filter(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(b.alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = cut(small.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
        # Done when all trees are stars: no node has two parents, or a parent and a child.
        ends = e.select(F.explode(F.array(F.struct(a.alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(b.alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty():
            return e.select(a.alias("node"), b.alias("root")).unionByName(e.select("b").distinct().select(b.alias("node"), b.alias("root")))
