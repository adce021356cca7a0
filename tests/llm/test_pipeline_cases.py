"""Every stage of the pipeline on nulls, repeats, very long texts, nothing at all, and columns of clashing names."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sarraf.llm.common import materialize

WORDS = {
    "en": "the old house by the river has a garden where children play every summer evening until it is dark",
    "de": "das alte haus am fluss hat einen garten in dem die kinder jeden abend im sommer spielen bis es dunkel wird",
}
ITEM = "which ancient river carries more grain ships than any other river of that wide country"
CLASHING = ["size", "shard", "slot", "vslot", "law", "component_id", "n_shingles", "target", "source_size", "n", "n_rows", "taken", "weight", "letters", "held_out", "score", "n_words", "n_hit", "set_key", "place", "copies", "key", "kept", "share", "at", "bucket", "item_id", "b", "c", "row", "left", "right", "code", "grams"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


def rows_of():
    out = []
    for i in range(40):
        lang = ("en", "de")[i % 2]
        words = WORDS[lang].split()
        out.append((i, " ".join(f"{w} {lang}{i}{w[::-1]}" for w in words[i % 7 :] + words[: i % 7]), lang, f"s{i % 3}", 1))
    out += [(100, None, "en", "s0", 0), (101, "", "en", None, 0), (102, "  \n ", None, "s1", 4), (103, "12 34 56", "de", "s1", 8), (None, WORDS["en"] + " once upon a time", "en", None, 1)]
    out += [(104, WORDS["de"] + " und so weiter", None, None, None)] * 3  # a repeated row
    out += [(105, WORDS["en"] + " " + ITEM + " " + WORDS["en"], "en", "s2", 1), (106, " ".join(f"{w}{k}" for k in range(2_000) for w in WORDS["en"].split()), "en", "s2", 1)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cases")
    spark.createDataFrame([("q1", ITEM), ("q2", None), (None, "")], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.createDataFrame(rows_of(), COLUMNS)
    docs.write.parquet(f"{at}/documents.parquet")
    return str(at)


def walk(spark, docs, folder):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, folder))
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_cases(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("*", *(F.lit("x").alias(c) for c in CLASHING))
    stages = {name: (before, after) for name, before, after in walk(spark, docs, folder)}
    for name in ("language", "near_copies", "benchmark", "mixture"):
        before, after = stages[name]
        assert after.schema.names == docs.schema.names, name
        assert after.select(*CLASHING).distinct().collect() in ([], [tuple("x" for _ in CLASHING)]), name
    kept = ids(stages["language"][1])
    assert not {100, 101, 102, 103} & set(kept) and kept[104] == 3 and kept[None] == 1 and kept[106] == 1 and set(range(40)) <= set(kept)
    near = ids(stages["near_copies"][1])
    assert near[104] == 1 and near[None] == 1 and set(range(40)) <= set(near)
    clean = ids(stages["benchmark"][1])
    assert near - clean == Counter({105: 1})
    mixed = ids(stages["mixture"][1])
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 3
    last = stages["shards"][1]
    assert ids(last) == mixed and last.columns[:3] == ["doc_id", "size", "text_crc32"]


def test_run_agrees_with_itself(spark, folder):
    first, again = (sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).na.fill(-1).collect()) for _ in range(2))
    assert first == again and first


@pytest.mark.parametrize("text", [None, ""])
def test_nothing_to_keep(spark, folder, text):
    none = spark.createDataFrame([(1, text, None, None, None), (1, text, None, None, None), (None, text, None, None, None)], COLUMNS)
    for docs in (none, none.limit(0)):
        for name, before, after in walk(spark, docs, folder):
            assert after.count() == 0, name
            assert name == "shards" or after.schema.names == before.schema.names
    for name, stage in corpus_pipeline.STAGES[1:]:  # each on texts that the stage before would have dropped
        out = stage(spark, none, folder)
        assert set(ids(out)) <= {1, None} and (name not in ("benchmark", "shards") or out.count() == 3), name
