import numpy as np

from sarraf.operators import nearest, vectors

SCHEMA = "vec_id long, embedding array<float>"


def _brute(rows, ids, k):
    usual = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v]
    out = set()
    for q in ids:
        v = dict(usual)[q]
        best = sorted((float(np.sqrt(sum((v - w) ** 2))), i) for i, w in usual)[:k]
        out |= {(q, i, n + 1) for n, (_, i) in enumerate(best)}
    return out


def test_blocks_lose_no_neighbour_and_settle_ties_by_key(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 7)
    monkeypatch.setattr(nearest, "CORPUS_SLICE", 40)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in base[i % 60]]) for i in range(200)]  # copies, so that ties cross groups
    e = spark.createDataFrame(rows, SCHEMA)
    asked = e.filter("vec_id % 5 = 0")
    want = _brute(rows, range(0, 200, 5), 6)
    assert {(r.query_id, r.vec_id, r.rank) for r in vectors.knn(asked, e, 6).collect()} == want
    indexed, centres = vectors.ivf_build(e, 4)
    assert {(r.query_id, r.vec_id, r.rank) for r in vectors.ivf_search(asked, indexed, centres, 6, 2).collect()} == want


def test_vectors_without_a_distance_come_last(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [3.0, 4.0]), (4, [1.0]), (5, [float("inf"), 0.0]), (6, [1e200, 0.0]), (7, [1.0, None])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.distance) for r in vectors.knn(e.filter("vec_id = 1"), e, 6).orderBy("rank").collect()]
    assert got == [(1, 0.0), (3, 5.0), (5, float("inf")), (6, float("inf")), (2, None), (4, None)]
    assert [r.vec_id for r in vectors.knn(e.filter("vec_id = 2"), e, 2).orderBy("rank").collect()] == [1, 2]
