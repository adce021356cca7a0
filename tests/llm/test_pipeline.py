"""The corpus pipeline against brute force, stage by stage."""

from collections import Counter

import brute
import corpus_pipeline
import pytest

from sarraf.llm.common import materialize, table


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, sf))
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark", "mixture", "shards"]
    before, after = stages["language"]
    assert after.columns == before.columns and ids(after) == Counter(d for d, t in pairs(before) if any(c.isalpha() for c in t or ""))
    before, after = stages["near_copies"]
    assert after.columns == before.columns and ids(after) == Counter(d for d, _, c in brute.jaccard(pairs(before)) if d == c)
    before, after = stages["benchmark"]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert ids(after) == Counter(r[0] for r in brute.contamination(pairs(before), items) if not r[-1])
    before, after = stages["mixture"]
    assert after.columns == before.columns and set(ids(after)) <= set(ids(before)) and max(ids(after).values()) <= 3
    size = lambda df: sum(len(brute.WORD.findall(t or "")) for _, t in pairs(df))
    assert abs(size(after) - size(before)) <= 0.05 * size(before)
    before, after = stages["shards"]
    assert ids(after) == ids(before) and {r["shard"] for r in after.select("shard").distinct().collect()} <= set(range(24))


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages["shards"][1].count()
