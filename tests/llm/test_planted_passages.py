"""Repeated passages are removed by bytes: from 400 on, however many words they have; n_bytes is the size before removal."""

from sarraf.llm import suffix_dedup


def test_passages_under_the_window_stay(spark):
    words = lambda tag, n, size: " ".join(f"{tag}{i:0{size - 1}d}" for i in range(n))
    short, long = words("s", 60, 5), words("g", 60, 8)
    assert len(short) < 400 < len(long)
    texts = {1: f"a1 {short} b1", 2: f"a2 {short} b2", 3: f"a3 {long} b3", 4: f"a4 {long} b4", 5: words("u", 90, 9)}
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i: r["n_bytes"] for i, r in found.items()} == {i: len(t) for i, t in texts.items()}
    assert {i: r["n_removed"] for i, r in found.items()} == {1: 0, 2: 0, 3: len(long) + 3, 4: len(long) + 3, 5: 0}
