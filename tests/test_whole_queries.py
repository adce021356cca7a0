"""Queries over whole tables against brute force."""

import glob
import os

import duckdb
import pytest

from sarraf.plans import queries


@pytest.fixture(scope="module")
def edges(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.execute(f"SELECT source, target, amount, tx_count FROM ({queries.SQL['j1_edges']})").fetchall()


def roots(pairs):
    """Union-find: the least node of each component."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_components_of_all_edges(spark, sf, edges):
    got = queries.QUERIES["j6_all_components"](spark, sf).collect()
    assert {r["node"]: r["root"] for r in got} == (want := roots((a, b) for a, b, *_ in edges)) and len(got) == len(want)
    assert len(want) > len(roots((a, b) for a, b, amount, _ in edges if amount >= 150_000))


def test_graph_with_communities(spark, sf, edges):
    turnover = {}
    for r in queries.ledger(spark, sf).select("payer_iin_bin", "receiver_iin_bin", (queries.F.col("amount_credit") + queries.F.col("amount_debit")).alias("a")).collect():
        for x in (r[0], r[1]):
            turnover[x] = turnover.get(x, 0) + r["a"]
    top = set(sorted(turnover, key=lambda x: (-turnover[x], x is None, x))[:200])
    inside = [e for e in edges if e[0] in top and e[1] in top]
    total = {}
    for a, b, amount, _ in inside:
        total[a], total[b] = total.get(a, 0) + amount, total.get(b, 0) + amount
    want = roots((a, b) for a, b, *_ in inside)
    got = queries.QUERIES["j7_graph_nodes"](spark, sf).collect()
    assert {r["id"]: r["community_id"] for r in got} == want and len(got) == len(want)
    assert {r["id"]: r["total_turnover"] for r in got} == pytest.approx(total)
    found = queries.QUERIES["j8_graph_edges"](spark, sf).collect()
    assert sorted((r["source"], r["target"], r["tx_count"]) for r in found) == sorted((a, b, n) for a, b, _, n in inside)
    assert {(r["source"], r["target"]): r["amount"] for r in found} == pytest.approx({(a, b): amount for a, b, amount, _ in inside})


def test_index_search_is_exact(spark, sf):
    read = lambda name: {(r["query_id"], r["vec_id"], r["rank"]) for r in queries.QUERIES[name](spark, sf).select("query_id", "vec_id", "rank").collect()}
    assert read("l6_coarse_index") == read("l2_knn")


def test_index_search_with_one_probe(spark):
    from sarraf.operators import vectors

    e = spark.createDataFrame([(i, [float(i % 7), float(i // 7)]) for i in range(49)], "vec_id long, embedding array<float>")
    indexed, centres = vectors.ivf_build(e, 5)
    for k in (4, 30):
        got = {(r["query_id"], r["vec_id"], r["rank"]) for r in vectors.ivf_search(e, indexed, centres, k, 1).collect()}
        assert got == {(r["query_id"], r["vec_id"], r["rank"]) for r in vectors.knn(e, e, k).collect()}


def test_formats_against_all_rows(spark, tmp_path):
    """Layouts near a row of their own bank, near one of another bank only, and near none, against brute force."""
    import numpy as np

    rng = np.random.default_rng(5)
    made = {i: (rng.normal(size=64).astype("float32"), i % 3) for i in range(301)}
    for i, near in ((50, 51), (100, 103), (150, 200), (250, 20)):
        made[i] = (made[near][0] + rng.normal(size=64).astype("float32") * np.float32(0.1), made[i][1])
    spark.createDataFrame([(i, [float(x) for x in v], b) for i, (v, b) in made.items()], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["layout_id"]: (r["format_id"], r["method"]) for r in queries.QUERIES["l3_resolve_format"](spark, str(tmp_path)).collect()}
    want = {i: (f"fmt-{i}", "fingerprint") for i in made}
    for i in range(0, 301, 50):
        v, bank = made[i][0].astype(float), made[i][1]
        score = {j: v @ w / np.sqrt((v @ v) * (w @ w)) for j, w in ((j, w.astype(float)) for j, (w, _) in made.items() if j != i)}
        near = [((made[j][1] == bank), s, f"fmt-{j}") for j, s in score.items() if s >= 0.92]
        want[i] = (max(near)[2], "vector") if near else (f"fmt-re-{i}", "new")
    assert got == want and sum(m == "vector" for _, m in got.values()) >= 4
