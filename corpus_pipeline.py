"""A corpus from raw documents: language, near copies, benchmark passages, mixture, shards.

Defined cases: documents of null text or without a letter go at the language stage; a row without an id is a document
like any other; of rows of equal id and text one stays at the near-copy stage; documents without words are near copies of
nothing and hold no passage; null sources are one source; an empty table stays empty through all stages. Other columns pass through, whatever their names, up to the last stage.
"""

from __future__ import annotations

from sarraf.llm import decontam, lang_id, mixing, ngram_join, sharding
from sarraf.llm.common import materialize, table


def language(spark, docs, sf_dir):
    return lang_id.drop_unidentified(docs)


def near_copies(spark, docs, sf_dir):
    return ngram_join.keep_one(docs)


def benchmark(spark, docs, sf_dir):
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark, docs, sf_dir):
    return mixing.mix(docs)


def shards(spark, docs, sf_dir):
    return sharding.shard(docs, 24)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture), ("shards", shards)]

#: Trained language models and hashed draws have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
