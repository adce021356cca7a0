"""Centroid clustering, exact dedup and the Merkle manifest against plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_training_operators import DOCS, edges

from sarraf.llm import centroids, exact_dedup, merkle

VECTORS = "vec_id long, embedding array<double>, label int, cluster string, q string"


@pytest.fixture(scope="module")
def docs(spark):
    more = [(100 + i, t, lang, "s", 3, None, None, None, None) for i, (t, lang) in enumerate([(" A b\tc", "en"), ("Ab c", "en"), ("Abc   ", "fr"), ("abc", "fr"), ("A bc", "en"), ("x" * 64 + "1", "en"), ("x" * 64 + "2", "en"), ("x" * 64 + " 1", "en")])]
    again = [(5, f"text {i % 3}", "en", None, None, 7, "k", "s", "z") for i in range(40)]  # one id many times, few texts
    nulls = [(None, t, None, "s", 1, None, None, None, None) for t in ("b", None, "b", "c")]
    return spark.createDataFrame([*edges(), *more, *again, *nulls], DOCS).repartition(3).cache()


def plain_texts(rows):
    norm = {i: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r") for i, (_, t) in enumerate(rows)}
    groups = defaultdict(list)
    for i, n in norm.items():
        groups[n].append(i)
    out = []
    for n, members in groups.items():
        stays = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        out += [(rows[i][0], rows[stays][0], len(members), hashlib.sha256(n.encode()).hexdigest()) for i in members]
    return out, len(groups)


def test_exact_dedup(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = exact_dedup.exact_dedup(docs, digests=True).collect()
    want, groups = plain_texts(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == sorted(want, key=str)
    assert sum(r["kept"] for r in got) == groups  # one row of each text, of rows that are the same too
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert {c for c, _ in exact_dedup.exact_dedup(docs).dtypes} == {"doc_id", "keep_id", "group_size", "kept"}


def test_whole_texts_are_hashed_only_in_company(docs):
    found = exact_dedup.refine(docs, digests=True).collect()
    size = defaultdict(int)
    for r in exact_dedup.classes(docs).collect():
        size[r["norm_len"], r["head"]] = r["n"]
    assert size and all(n > 1 for n in size.values())
    alone = [r for r in found if r["full"] is None]
    assert alone and len({r["text_sha256"] for r in alone}) == len(alone)
    assert len(found) - len(alone) >= sum(size.values())


def test_a_full_bitmap_lets_more_through_and_loses_nothing(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_dedup(docs, digests=True).drop("kept").collect()))
    monkeypatch.setattr(exact_dedup, "HEAD", 0)  # one class a length
    assert sorted(map(str, exact_dedup.exact_dedup(docs, digests=True).drop("kept").collect())) == want


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, H(map(field, r)), r))

    def tree(digests):
        """The root, and each leaf's (left, right) a level."""
        paths, at = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            for i, p in enumerate(at):
                run = p // 8 * 8
                paths[i].append(("".join(digests[run:p]), "".join(digests[p + 1 : run + 8])))
            digests, at = [H(digests[i : i + 8]) for i in range(0, len(digests), 8)], [p // 8 for p in at]
        return digests[0], paths

    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: tree([x[2] for x in sorted(groups[v], key=lambda x: x[:3])]) for v in langs}
    root, over = tree([trees[v][0] for v in langs])
    out = []
    for v, up in zip(langs, over, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[v], key=lambda x: x[:3]), trees[v][1], strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            at = H(map(field, (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))) if tampered else leaf
            for left, right in path + up:
                at = H([left, at, right])
            out.append((r[0], leaf, trees[v][0], root, H(x for s in path + up for x in s), at, at == root))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def told(df):
    return sorted(map(str, (tuple(r[c] for c in NAMES) for r in df.collect())))


def taken(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_manifest(docs):
    assert told(merkle.manifest(docs)) == sorted(map(str, plain_manifest(taken(docs))))


def test_manifest_of_many_rows_and_far_ids(spark):
    r = random.Random(4)
    near = [(i, f"Text {i}", "en") for i in range(1200)]
    far = [(r.randrange(-(1 << 63), 1 << 63), f"T{i}", "de") for i in range(700)] + [((1 << 63) - 1, "x", "de"), (-(1 << 63), "Y", "de"), (3, None, ""), (4, "lone", "zz")]
    df = spark.createDataFrame([(i, t, lang, "s", 5) for i, t, lang in near + far], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = merkle.manifest(df)
    assert told(got) == sorted(map(str, plain_manifest(taken(df))))
    proof = got.filter("doc_id = 777").first()["path"]
    assert len(proof) == math.ceil(math.log(1200, 8)) + 1


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 512, 513])
def test_tree_sizes(spark, n):
    df = spark.createDataFrame([(i, f"A{i}", None, None, None) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    assert told(merkle.manifest(df)) == sorted(map(str, plain_manifest(taken(df))))


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centres = [q for _, q in sorted(kept, key=lambda x: (x[0] is None, key(x[0]), x[1]))][:k]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        at = [min((far(q, c), j) for j, c in enumerate(centres)) for _, q in kept]
        if r < rounds:
            for j in range(len(centres)):
                if own := [q for (_, q), (_, c) in zip(kept, at, strict=True) if c == j]:
                    centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = defaultdict(int)
    for d, c in at:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (d, c) in zip(kept, at, strict=True)]


def clustered(df):
    return sorted(map(str, (tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect())))


def test_clusters(spark):
    r = random.Random(7)
    vec = lambda spread=1.0: [r.gauss(0, spread) for _ in range(64)]
    rows = [(i, vec(), i, "c", "q") for i in range(300)]
    rows += [(300 + i, v, None, None, None) for i, v in enumerate([None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [0.0] * 64, [-0.0] * 64, [1e-300] * 64, [-1e-300] * 64])]
    rows += [rows[5], (5, vec(), 1, "c", "q"), (None, vec(), 1, "c", "q")]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = centroids.clusters(df)
    assert clustered(got) == sorted(map(str, plain_clusters([(x[0], x[1]) for x in rows])))
    assert got.filter("vec_id = 300 or vec_id = 304").count() == 0


def test_few_and_far_vectors(spark):
    rows = [(i, [float(x + i)] * 64) for i, x in enumerate([1e13, 1e13 + 5, 1e13 - 7, 1e13])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clustered(centroids.clusters(df)) == sorted(map(str, plain_clusters(rows)))
    huge = spark.createDataFrame([(0, [1e300] * 64), (1, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert {(r["vec_id"], r["distance"]) for r in centroids.clusters(huge).collect()} == {(0, 0), (1, 0)}
    assert centroids.clusters(spark.createDataFrame([], VECTORS)).count() == 0
    assert {x for x, _ in centroids.clusters(df.withColumn("embedding", F.col("embedding").cast("array<float>"))).dtypes} == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"}
