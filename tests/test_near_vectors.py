"""Hashing of near vectors and the stored inverted file, against brute force."""

import numpy as np
import pytest

from sarraf.operators import vectors
from sarraf.sources import versions

V = "vec_id long, embedding array<double>"


def planted(seed, n, cosines, dims=64):
    """n random unit vectors, and for each cosine a copy of one of them turned by just so much: {id: vector}, [(copy, of)]."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    out, pairs = dict(enumerate(base)), []
    for i, c in enumerate(cosines):
        u, w = base[i % n], rng.normal(size=dims)
        w -= (w @ u) * u
        out[n + i] = 3 * (c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w))
        pairs.append((n + i, i % n))
    return out, pairs


def table(spark, data):
    return spark.createDataFrame([(int(i), [float(x) for x in v] if v is not None else None) for i, v in data.items()], V).repartition(4)


@pytest.mark.parametrize("dims", [16, 64])
def test_recall_at_the_threshold(spark, dims):
    data, pairs = planted(1, 1500, [0.9201] * 500 + [0.95] * 300 + [0.99] * 100, dims)
    df = table(spark, data)
    got = {(r["a"], r["b"]) for r in vectors.near_pairs(df.withColumnRenamed("vec_id", "a"), df.withColumnRenamed("vec_id", "b"), "a", "b", 0.92).collect()}
    ids = sorted(data)
    m = np.array([data[i] / np.linalg.norm(data[i]) for i in ids])
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(m @ m.T >= 0.92), strict=True)}
    assert got <= want and {p for p in pairs} <= want
    at = [p in got for p in pairs]
    assert sum(at[:500]) / 500 >= 0.94  # 0.98 is what the hashing is laid out for
    assert sum(at[500:800]) / 300 >= 0.97 and all(at[800:])


def test_few_pairs_are_candidates(spark):
    data, _ = planted(2, 3000, [])
    df = table(spark, data).withColumnRenamed("embedding", "v")
    met = vectors.candidates(df.withColumnRenamed("vec_id", "a_id"), df.withColumnRenamed("vec_id", "b_id"), np.sqrt(0.16), np.sqrt(2)).count()
    assert met < 0.03 * 3000**2
    k, bands = vectors.hash_shape(1_000_000, 0.4, 2**0.5, 0.98)
    assert k * bands < 4000  # projections grow as a small power of the rows


def test_vectors_without_pairs(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [None, 1.0])], V)
    got = vectors.near_pairs(df.withColumnRenamed("vec_id", "a"), df.withColumnRenamed("vec_id", "b"), "a", "b", 0.92).collect()
    assert {(r["a"], r["b"]) for r in got} == {(1, 1), (1, 2), (2, 1), (2, 2), (7, 7)}
    assert vectors.near_pairs(df.withColumnRenamed("vec_id", "a"), df.filter("false").withColumnRenamed("vec_id", "b"), "a", "b", 0.92).count() == 0


def test_stored_index(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 20
    data = {i: centres[i % 8] + rng.normal(size=16) for i in range(400)}
    df, path = table(spark, data), str(tmp_path / "index")
    index = vectors.Index.build(df.filter("vec_id < 200"), path, 8)
    fitted = index.centres().collect()
    index.add(df.filter("vec_id >= 150"))  # 50 of them are there already
    index.add(spark.createDataFrame([(1000, [float(x) for x in centres[0] + 30])], V))  # far from every centre
    assert versions.read(spark, index.lists).count() == 401 and index.centres().collect() == fitted
    opened, real = set(), versions.read

    def read(spark, at, keys=None, version=None):
        if at == index.lists:
            opened.update(keys)
        return real(spark, at, keys, version)

    monkeypatch.setattr(vectors.versions, "read", read)
    queries = df.filter("vec_id in (8, 16)").unionByName(spark.createDataFrame([(2000, [float(x) for x in centres[0] + 25])], V))
    whole = df.unionByName(spark.createDataFrame([(1000, [float(x) for x in centres[0] + 30])], V))
    for k in (1, 5):
        opened.clear()
        got = {(r["query_id"], r["vec_id"], r["rank"]) for r in index.search(queries, k, 1).collect()}
        assert got == {(r["query_id"], r["vec_id"], r["rank"]) for r in vectors.knn(queries, whole, k).collect()}
        assert len(opened) < 8  # whole lists are left unopened
    assert all(f"_part={versions.key('0')}/" in f for f in index.read([0]).inputFiles())
