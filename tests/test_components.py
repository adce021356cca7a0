"""Components from each node's least and greatest neighbour, and the pairs that join what these leave apart."""

import random

from sarraf.operators import graph


def plain(pairs):
    root = {x: x for p in pairs for x in p if p[0] != p[1]}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            low, high = sorted((of(a), of(b)))
            root[high] = low
    return {x: of(x) for x in root}


def test_whatever_neighbours_leave_apart_is_joined(spark):
    rng = random.Random(7)
    apart = [(f"{g}{i}", f"{g}{j}") for g in "acx" for i in "019" for j in "5"]  # cliques whose ends are their own
    bridge = [("b5", "b0"), ("b5", "b9"), ("b50", "b5"), ("a5", "x5"), ("m", "a5"), ("m", "x5"), ("q", "q")]
    mid = [(f"k{i}", f"k{j}") for i in (0, 4, 8) for j in (0, 4, 8) if i < j] + [(f"t{i}", f"t{j}") for i in (0, 4, 8) for j in (0, 4, 8) if i < j] + [("k0", "z1"), ("k4", "t4"), ("a", "t4"), ("a", "k4"), ("zz", "k4"), ("zz", "t4")]
    for pairs in (apart + bridge, mid, [(f"n{rng.randrange(400):03d}", f"n{rng.randrange(400):03d}") for _ in range(260)], [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)], [("q", "q")]):
        df = spark.createDataFrame(pairs + pairs[:3], "a string, b string").repartition(3)
        assert {r["node"]: r["root"] for r in graph.connected_components(df).collect()} == plain(pairs)


def test_pairs_that_join_two_skeletons(spark):
    """p and q: neighbours at both ends of each other's range are within their own half; one middle pair joins the halves."""
    half = lambda g: [(f"{g}m", f"{o}{g}{i}") for o in "0z" for i in range(2)]
    pairs = half("p") + half("q") + [("pm", "qm")]
    near = {n: sorted(b if a == n else a for a, b in pairs if n in (a, b)) for p in pairs for n in p}
    kept = plain([(n, x) for n, o in near.items() for x in (o[0], o[-1])])
    assert len(set(kept.values())) == 2  # so the middle pair is not in the small graph
    assert {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()} == plain(pairs)


def test_rounds_read_a_small_part_of_the_pairs(spark, monkeypatch):
    sizes, stars = [], graph._stars
    monkeypatch.setattr(graph, "_stars", lambda pairs: sizes.append(pairs.distinct().count()) or stars(pairs))
    dense = spark.range(3000).selectExpr("cast(pmod(xxhash64(id), 40) as string) a", "concat('s', pmod(xxhash64(id, 1), 40)) b")
    assert graph.connected_components(dense).select("root").distinct().count() == 1 and sum(sizes) <= 4 * 80
