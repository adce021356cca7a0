"""Operators against brute-force versions, on hand-made edge cases and on the smallest tables."""

import hashlib
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sarraf.llm import common, decontam, html_blocks, lang_id, mixing, ngram_join, pii, sharding, suffix_dedup, vector_graph, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, spans string, slot string"


def words(seed, n, vocabulary=5000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edges():
    """Nulls, blanks, repeats, ties, near copies, a long text, a text of one byte over and over."""
    base, long = words(1, 300), words(2, 30_000)
    near = [*base[:150], "changed", *base[151:]]
    passage = " ".join(words(3, 120))
    texts = [
        None, "", " \t\n", "one", "one two three", "One TWO three", " ".join(base), " ".join(base), " ".join(near), "x" * 1500, " ".join(long), " ".join([*long[:20_000], "cut", *long[20_000:]]),
        "start of a " + passage + " end of it", "other start " + passage + " other end", passage[:399], passage[:400], "été à Noël: " + passage[50:600], "mail a.b@c.example.com, ip 10.0.0.1 card 4111 1111 1111 1111 and +1 (625) 555-7196", "!!! 123 ???",
    ]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 5 else None, 0, 7, "k", "s", "z") for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, "null id " + passage[:80], None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edges(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def same(df, cols, want):
    assert rows(df, *cols) == sorted(want, key=str)


@pytest.fixture(scope="module")
def small(spark, sf):
    return common.table(spark, sf, "documents")


# --- 1 sharding -----------------------------------------------------------------------------------------
def test_shards(spark, docs, empty, small):
    for df in (docs, small):
        got = sharding.shard(df, 24).collect()
        assert len(got) == df.count()
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) - min(size.values()) <= max(r["size"] for r in got)
    assert sharding.shard(empty, 24).count() == 0


def test_map_versions(spark, tmp_path):
    sizes = [(v, 1, 100 + v % 7) for v in range(512)]
    one = sharding.assign(sizes, 8, 512)
    two = sharding.rebalance(one, sizes, 9)
    load = Counter()
    for v, s in two.items():
        load[s] += 100 + v % 7
    assert max(load.values()) <= 1.03 * sum(load.values()) / 9
    assert sum(one[v] != two[v] for v in one) < 100 and set(two.values()) == set(range(9))
    assert set(sharding.rebalance(two, sizes, 5).values()) == set(range(5))
    for n, held in ((1, one), (2, two)):
        sharding.save_map(spark, f"file://{tmp_path}/map", n, held, sizes)
    assert {r["vslot"]: r["shard"] for r in sharding.load_map(spark, f"file://{tmp_path}/map", 1).collect()} == one
    assert {r["vslot"]: r["shard"] for r in sharding.load_map(spark, f"file://{tmp_path}/map", 2).collect()} == two


# --- 2 repeated strings -----------------------------------------------------------------------------------
REPEATS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_repeats(docs, empty, small):
    for df in (docs, small):
        same(suffix_dedup.remove_repeats(df), REPEATS, brute.repeats(pairs(df)))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeats_of_frequent_anchors(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 1)
    same(suffix_dedup.remove_repeats(docs), REPEATS, brute.repeats(pairs(docs)))


def test_stretches_over_chunks(monkeypatch):
    data = np.frombuffer(" ".join(words(9, 3000)).encode(), np.uint8)
    whole = suffix_dedup.stretches(data)
    covered = sum(h - lo + 1 for lo, h in zip(whole[1], whole[2], strict=True))
    assert covered == len(data) - suffix_dedup.WINDOW + 1
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    parts = suffix_dedup.stretches(data)
    assert sum(h - lo + 1 for lo, h in zip(parts[1], parts[2], strict=True)) == covered
    assert set(parts[0]) == set(whole[0])


# --- 3 main text ---------------------------------------------------------------------------------------------
PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><a href=/>Home</a></header><nav><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></nav>
<div class="ad">Buy this now and here</div><article><h1>Title &amp; more</h1><p>First   <b>bold</b>
text&nbsp;of it.<p>And.<br></article><aside>Side matter</aside><div id="comments">I like it a lot</div>
<form><input><label>Name</label></form><footer>&copy; 2024 us</footer></body></html>"""


def test_main_text(spark, sf):
    import html
    import re

    schema = "page_id long, url string, html string, text string, words long"
    df = spark.createDataFrame([(1, "u", PAGE, "clash", 1), (2, None, None, None, None), (3, "u", "", None, None), (4, "u", "plain text without any tags but with quite a few words in it to be read by people", None, None), (5, "u", "<p>a < b &lt; c", None, None), (1, "u", PAGE, None, None)], schema)
    got = {r["page_id"]: r["text"] for r in html_blocks.extract(df).collect()}
    assert got[1] == "Title & more\nFirst bold text of it.\nAnd."
    assert got[2] == got[3] == ""
    assert got[4].startswith("plain text")
    assert html_blocks.extract(df).count() == 6 and html_blocks.extract(df.limit(0)).count() == 0
    pages = common.table(spark, sf, "pages")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_blocks.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = "\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.split(r"(?:</?p>|</?h1>|<br>|</?b>)+", inner)) if x)
        assert found[r["page_id"]] == (want, len(want))


@pytest.fixture(scope="module")
def tree(spark):
    return html_blocks.train(spark)


def main_text(tree, page):
    found = html_blocks.blocks(page)
    return [b[0] for b, row in zip(found, html_blocks.features(found), strict=True) if html_blocks.classify(tree, row)]


LONG = "It has a good many words that stand in one long line of running text, and so it goes on for a while until it ends here at last."
MENU = "<ul><li><a href=a>Home</a></li><li><a href=b>News and views</a></li><li><a href=c>About</a></li></ul>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body class='has-sidebar'><article><p>{LONG}</p></article></body>", [LONG]),
        (f"<div class='content-sidebar-wrap'><div class='content'><p>{LONG}</p></div><aside class=sidebar><p>Buy it</p></aside></div>", [LONG]),
        (f"<form id='aspnetForm'><div id='main'><p>{LONG}</p></div></form>", [LONG]),
        (f"<form id='aspnetForm'><div><p>{LONG}</p></div></form>", [LONG]),
        (f"<div class='page search-page'><div class='content'><p>{LONG}</p></div></div>", [LONG]),
        (f"<div class='with-header fixed-header'><p>{LONG}</p></div>", [LONG]),
        (f"<article><p>{LONG}</p></article><section id='comments'><article class='comment-body'><p>{LONG} {LONG}</p></article></section>", [LONG]),
        (f"<article><p>{LONG}</p></article><div class='user-comments'><div class=comment><div class=content><p>{LONG} {LONG}</p></div></div></div>", [LONG]),
        (f"<div class=post><p>{LONG}</p></div><div id=comments class=comments-area><div class=content>{LONG} {LONG}</div></div>", [LONG]),
        (f"<article class='post sidebar-right'><p>{LONG}</p></article>", [LONG]),
        ("<body><p>Only nine words stand here in this one.</p></body>", ["Only nine words stand here in this one."]),
        (f"<div class='no-sidebar'><p>{LONG}</p></div>", [LONG]),
        (f"<form id=aspnet><div class=search-results><main><h1>Head</h1><p>{LONG}</p></main></div></form>", ["Head", LONG]),
        (f"<div class=widget><div class=content>{LONG}</div></div><article>{LONG}<aside>More of it</aside></article>", [LONG]),
        (f"<article>{LONG}</article><div id=comments><article class=comment><p>{LONG}</p></article></div>", [LONG]),
        (f"<aside><article>{LONG}</article></aside><main>{LONG}</main>", [LONG]),
        (f"{MENU}<h2>Head of it</h2><p>{LONG}</p><p>Short end.</p><p>{LONG} <a href=x>with a link</a></p>", ["Head of it", LONG, "Short end.", f"{LONG} with a link"]),
        (f"<article><p>{LONG}</p>{MENU}<p>{LONG}</p></article>", [LONG, LONG]),
        (f"<article><p>{LONG}</p><p><a href=x>One link</a></p><p>{LONG}</p></article>", [LONG, "One link", LONG]),
        ("<head><title>x</title><body><p>no end of the head is given here", ["no end of the head is given here"]),
    ],
)
def test_layouts(tree, page, want):
    assert main_text(tree, page) == want


def test_tree_splits(tree):
    """Link density and neighbours decide where names do not."""
    splits, held = set(), [tree]
    while held:
        node = held.pop()
        if isinstance(node, tuple):
            splits.add(html_blocks.FEATURES[node[0]])
            held += node[2:]
    assert {"links", "menu", "side", "talk", "body"} <= splits and splits & {"links_before", "links_after"}


def test_deep_pages_take_linear_time(tree):
    import time

    began = time.time()
    assert len(html_blocks.blocks("<div>x" * 100_000)) == 100_000
    assert len(html_blocks.blocks("<div>" * 100_000 + "</span>x" * 100_000)) == 1
    assert html_blocks.blocks("<![CDATA[" * 100_000) == [] and len(html_blocks.blocks("<a href=x>y" * 50_000)) == 1
    assert time.time() - began < 20


# --- 4 language ----------------------------------------------------------------------------------------------
def test_language(docs, empty, small):
    got = {r["doc_id"]: r for r in lang_id.identify(docs).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[18]["lang_pred"] == "und" and got[18]["score"] == 0
    assert got[6]["lang_pred"] in ("en", "fr") and 0 <= got[6]["score"] <= 1
    assert lang_id.identify(docs).count() == docs.count() and lang_id.identify(empty).count() == 0
    truth = {r["doc_id"]: r["lang"] for r in small.collect()}
    held = [r for r in lang_id.identify(small).collect() if r["held_out"]]
    assert len(held) > 20 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) >= 0.95


def test_code_lengths_are_exact():
    """Every context's shares over bytes, with those of never-seen bytes from order -1, follow method C by hand."""
    text = b"abracadabra abra"
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    code, n = np.unique(lang_id.codes(data, offsets), return_counts=True)
    model = lang_id.Model(["x"], [(code, n)])
    counts = defaultdict(Counter)
    padded = bytes(3) + text
    for i in range(3, len(padded)):
        for k in range(4):
            counts[padded[i - k : i]][padded[i]] += 1

    def cost(context, byte):
        c = counts.get(context)
        shorter = (lambda: cost(context[1:], byte)) if context else (lambda: 8.0)
        if not c:
            return shorter()
        total = sum(c.values()) + len(c)
        return -np.log2(c[byte] / total) if c[byte] else -np.log2(len(c) / total) + shorter()

    for probe in (b"abra", b"cab zebra", b"q"):
        p = bytes(3) + probe
        want = sum(cost(p[i - 3 : i], p[i]) for i in range(3, len(p)))
        assert model.lengths(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))[0, 0] == pytest.approx(want, rel=1e-5)


# --- 5 n-gram join -------------------------------------------------------------------------------------------
JOIN = ["doc_id", "n_shingles", "component_id"]


def test_ngram_join(docs, empty, small):
    for df in (docs, small):
        same(ngram_join.jaccard_join(df), JOIN, brute.jaccard(pairs(df)))
    assert ngram_join.jaccard_join(empty).count() == 0


def test_words_that_collide_modulo_powers_of_two(spark):
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024))  # Thue and Morse's
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"{word} {other}"), (4, f"{other} {word}"), (5, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(ngram_join.jaccard_join(df), JOIN, brute.jaccard(rows))
    same(suffix_dedup.remove_repeats(df), REPEATS, brute.repeats(rows))


@pytest.mark.parametrize("texts", [["a"], ["a b", "A  b"], ["a b c d"], ["a b c d e", " "]])
def test_fewer_words_than_an_ngram_in_a_batch(texts):
    raw = [t.encode() for t in texts]
    sets = ngram_join.shingles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [len(x) for x in sets] == [int(bool(t.strip())) for t in texts]
    if len(sets) > 1 and texts[1].strip():
        assert sets[0].tolist() == sets[1].tolist()


def test_window_hash_names_bytes():
    data = np.random.Generator(np.random.PCG64(3)).integers(97, 100, 20_000, dtype=np.uint8)
    prefix, raw = common.prefix_hash(data), data.tobytes()
    for width in (1, 5, 128, 401):
        start, name = np.arange(len(data) - width + 1), {}
        for at, h in zip(start, common.window_hash(prefix, start, start + width).tolist(), strict=True):
            assert name.setdefault(raw[at : at + width], h) == h
        assert len(set(name.values())) == len(name)


def test_null_ids_link(spark):
    text = words(31, 60)
    near = lambda *at: " ".join(f"other{k}" if k in at else w for k, w in enumerate(text))
    rows = [(None, near()), (None, near(0)), (7, near(0, 1)), (None, " ".join(words(32, 30))), (None, None), (9, near()), (9, " ".join(words(33, 30)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(ngram_join.jaccard_join(df), JOIN, brute.jaccard(rows))
    kept = Counter((r["doc_id"], r["text"]) for r in ngram_join.keep_one(df).collect())
    assert kept == Counter([rows[2], rows[3], rows[4], rows[6]])


def grouped(n=70):
    """Many copies with edits, and lines that all share: cells whose members are of several components."""
    base, line, texts = words(5, 80), words(6, 12), []
    for i in range(n):
        w = list(base)
        for k in random.Random(i).sample(range(80), i % 4):
            w[k] = f"edit{i}"
        texts.append(" ".join(w))
    for i in range(n):  # two or three lots of copies around one passage, not near each other's
        r = random.Random(1000 + i)
        texts.append(" ".join([*words(300 + i % 3, 12), *base[:60], *(f"x{i}_{k}" for k in range(r.randrange(2)))]))
    return texts + [" ".join([*line, *words(100 + i, 3)]) for i in range(40)] + [" ".join([*line, *words(200 + i, 1)]) for i in range(30)]


@pytest.mark.parametrize("block, whole, held", [(128, 256, 1 << 16), (4, 3, 7), (1, 2, 1)])
def test_large_groups(spark, monkeypatch, block, whole, held):
    for name, value in (("BLOCK", block), ("WHOLE", whole), ("HELD", held)):
        monkeypatch.setattr(ngram_join, name, value)
    df = spark.createDataFrame(list(enumerate(grouped())), "doc_id long, text string")
    same(ngram_join.jaccard_join(df), JOIN, brute.jaccard(pairs(df)))


def test_trie_and_maps():
    r = np.random.Generator(np.random.PCG64(1))
    pool = np.unique(r.integers(0, 1 << 60, 3000, dtype=np.uint64))
    hub = np.sort(r.choice(pool, 400, replace=False))
    members = [np.sort(np.r_[r.choice(hub, 400 - k, replace=False), r.choice(np.setdiff1d(pool, hub), k, replace=False)]) for k in (0, 10, 40, 45, 50, 100, 399)] + [hub[:330], hub[:310], hub[90:]]
    true = [180 * len(np.intersect1d(hub, m)) >= 80 * (len(hub) + len(m)) for m in members]
    assert sorted(ngram_join.Trie(members).walk(hub)) == np.flatnonzero(true).tolist()
    assert ngram_join.Trie([]).walk(hub) == []
    sizes, each = np.array([len(m) for m in members]), np.arange(len(members))
    maps = ngram_join.may_link([ngram_join.parity(hub)], np.array([len(hub)]), [ngram_join.parity(m) for m in members], sizes, each * 0, each)
    assert all(may for may, link in zip(maps, true, strict=True) if link) and not maps[6]


def test_trie_against_sets():
    """Random sets with long shared paths, all against all, with and without sets left out."""
    r, common_path = random.Random(3), sorted(random.Random(2).sample(range(10_000), 300))
    sets = [np.array(sorted({*common_path[: r.randrange(200, 300)], *r.sample(range(10_000), r.randrange(40))}), np.uint64) for _ in range(60)]
    trie = ngram_join.Trie(sets)
    for step in (1, 7, 256):
        ngram_join.STEP = step
        for k, probe in enumerate(sets):
            true = [i for i, m in enumerate(sets) if 180 * len(np.intersect1d(probe, m)) >= 80 * (len(probe) + len(m))]
            assert sorted(trie.walk(probe)) == true
            skip = np.array([i % 3 == k % 3 for i in range(60)])
            assert sorted(trie.walk(probe, skip)) == [i for i in true if not skip[i]]
    ngram_join.STEP = 256


def test_nodes_longer_than_a_task_holds(monkeypatch):
    import pyarrow as pa

    r = random.Random(4)
    sets = {k: 100 + k % 9 for k in range(60)}
    rows = sorted((g, r.randrange(20), n, k) for g, size in ((1, 2), (2, 4), (3, 40), (4, 1), (5, 25), (6, 3)) for k, n in r.sample(sorted(sets.items()), size))
    rows = sorted(rows + r.sample(rows, 20))

    def run(width):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + width], strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ngram_join._ENTRY) for i in range(0, len(rows), width)]
        return [tuple(x.values()) for b in ngram_join._meet(batches) for x in b.to_pylist()]

    def cells(found):
        out = defaultdict(bool)
        for h, k, n, may in found:
            assert n == sets[k]
            out[h, k] |= may
        return out

    fits = lambda a, b: 1 + min(a[2] - a[1], b[2] - b[1]) - 1 >= -(-80 * (a[2] + b[2]) // 180)
    pairs = {frozenset((a[3], b[3])) for a in rows for b in rows if a[0] == b[0] and a[3] != b[3] and fits(a, b)}
    whole = cells(run(1000))
    for width in (1000, 7, 1):
        got = cells(run(width))
        assert got == whole or width < 1000
        met = defaultdict(set)
        for h, k in got:
            met[h].add(k)
        assert all(any(p <= m for m in met.values()) for p in pairs)
        assert all(frozenset(x) in pairs for x, may in got.items() if may and x[0] != x[1])
    monkeypatch.setattr(ngram_join, "HELD", 5)
    monkeypatch.setattr(ngram_join, "WHOLE", 4)
    for width in (1000, 7, 1):
        met = defaultdict(set)
        for h, k in cells(run(width)):
            met[h].add(k)
        assert all(any(p <= m for m in met.values()) for p in pairs)


def test_vectors_of_maps():
    r = np.random.Generator(np.random.PCG64(3))
    sets = [np.sort(r.integers(0, 1 << 40, n, dtype=np.uint64)) for n in (5, 60, 70, 120, 130, 300)]
    maps, sizes = [ngram_join.parity(x) for x in sets], np.array([len(x) for x in sets])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(6)))
    bits = lambda x, m: {b for b in range(m) if (x[b // 8] >> (b % 8)) & 1}

    def differ(a, b):
        m = 8 * min(len(maps[a]), len(maps[b]))
        one, two = ([sum(1 for x in bits(maps[k], 8 * len(maps[k])) if x % m == y) % 2 for y in range(m)] for k in (a, b))
        return sum(x != y for x, y in zip(one, two, strict=True))

    want = [differ(a, b) <= sizes[a] + sizes[b] - 2 * ngram_join.needed(sizes[a], sizes[b]) for a, b in zip(i, j, strict=True)]
    assert ngram_join.may_link(maps, sizes, maps, sizes, i, j).tolist() == want


def test_keep_one(docs):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got[6] == 1 and got[7] == got[8] == 0 and got[0] == got[1] == got[2] == 1


# --- 6 mixing --------------------------------------------------------------------------------------------------
def check_mix(df, got):
    assert len(got) == df.count()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    for group in by.values():
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= max(r["size"] for r in group) + 1e-6
    total = sum(r["size"] for r in got)
    sources = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    held, weight = {s: sum(r["size"] for r in by[s]) for s in sources}, {s: i % 3 + 1 for i, s in enumerate(sources)}
    capped = set()
    while True:
        free = [s for s in sources if s not in capped]
        level = (total - sum(3 * held[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * held[s]}
        if not over:
            break
        capped |= over
    for s in sources:
        assert by[s][0]["source_size"] == held[s]
        assert by[s][0]["target"] == pytest.approx(3 * held[s] if s in capped else level * weight[s])


def test_mixing(docs, empty, small, monkeypatch):
    for df in (docs, small):
        check_mix(df, mixing.plan(df).collect())
    cols = ["doc_id", "size", "taken"]
    assert rows(mixing.plan(small), *cols) == rows(mixing.plan(small.repartition(7)), *cols)
    assert mixing.plan(empty).count() == 0
    monkeypatch.setattr(mixing, "LEAF_ROWS", 10)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    check_mix(small, mixing.plan(small).collect())


def test_mix_rows(docs):
    want = Counter()
    for r in mixing.plan(docs).collect():
        want[r["doc_id"]] += r["copies"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in want.items() if v})


# --- 7 personal data ---------------------------------------------------------------------------------------------
PII = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]


def test_personal_data(spark, docs, empty, small):
    odd = ["a@b.c@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004", "4111-1111-1111-1111 4111111111111112 41111111111111 11", "+1 2 ++44 20 7946 0958 12", "x@y", "@a.b", "+49(30)123456-7", "1.2.3.4+1 555 000 1111", "№ 4111 1111  1111 1111"]
    strange = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for df in (docs, small, strange):
        same(pii.find_personal_data(df), PII, brute.personal(pairs(df)))
    assert pii.find_personal_data(empty).count() == 0


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "a@" * 100_000, "a@b." * 50_000, "1.2." * 50_000, "1.2.3.4" * 30_000, "+1(" * 60_000, "(555) " * 30_000, "a@b.c@d.e.%x@y.z.w a@b..c %@x.y", "1.1.1.1.1.1.1.1", "4111 1111 1111 1111 " * 5000])
def test_long_runs(text):
    """Patterns are guarded against long runs and match as the contract's do."""
    import time

    began = time.time()
    held = pii.exact(text)
    pii.loose(text, held)
    assert time.time() - began < 10
    short = text[:3000]
    assert pii.line(pii.exact(short)) == brute.personal_spans(short)


def test_span_classifier(spark):
    """The final classifier sees the words around a span, which no labeler reads: where cues are missing, it still tells telephones from orders."""
    texts = [f"call {200 + i}-555-{1000 + i} now" for i in range(40)] + [f"ring {200 + i}-555-{1000 + i} now, or call us" for i in range(40)] + [f"order {300 + i} 222 {4000 + i} is late" for i in range(40)]
    got = {r["doc_id"]: r["n_added"] for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(40)) >= 38 and sum(got[i] for i in range(80, 120)) == 0


def test_added_spans_keep_base(spark):
    texts = [f"call {200 + i}-555-{1000 + i} or mail u{i}@x.example.com" for i in range(30)] + [f"order {300 + i} 222 {4000 + i}" for i in range(30)]
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert hashlib.sha256(",".join(s for s in r["spans"].split(",") if s.startswith("email")).encode()).hexdigest() == r["base_sha256"]
        assert r["n_added"] == 0 or r["doc_id"] < 30


def test_estimate_finds_reliable_labelers():
    chance, share = pii.estimate([("phone:ppppp", 50), ("phone:--nnn", 50), ("phone:p-p-p", 5), ("phone:-nnpn", 5)])
    assert chance["phone:ppppp"] > 0.95 and chance["phone:--nnn"] < 0.05
    right, wrong = (pii.seen(t, t.index("2"), pii.KINDS.index("phone"), t.index("2") + 12) for t in ("call 200-555-1000 now", "order 200 222 4000 is late"))
    w = pii.fit([right, wrong], np.array([chance["phone:ppppp"], chance["phone:--nnn"]]), np.array([50.0, 50.0]))
    assert w[right].sum() > 0 > w[wrong].sum()


# --- 8 vectors -----------------------------------------------------------------------------------------------------
VEC = ["vec_id", "n_links", "component_id", "kept"]


def test_vectors(spark, sf):
    r = np.random.Generator(np.random.PCG64(4))
    base = r.normal(size=(40, 8))
    made = [(i, [float(x) for x in v]) for i, v in enumerate(np.r_[base, base + r.normal(size=base.shape) * 0.05, base[:5] * 3])]
    made += [(100, None), (101, [0.0] * 8), (102, [1.0, None] + [0.0] * 6), (103, [float("nan")] * 8), (104, []), (105, [1.0, 2.0]), (106, [1.0, 2.0]), (107, [2.0, 4.1])]
    df = spark.createDataFrame([(*m, 1, "x") for m in made], "vec_id long, embedding array<double>, node long, n string")
    same(vector_graph.near_duplicates(df), VEC, brute.vectors(made))
    assert vector_graph.near_duplicates(df.limit(0)).count() == 0
    table = common.table(spark, sf, "embeddings")
    found = common.materialize(vector_graph.near_duplicates(table))
    same(found, VEC, brute.vectors([(r["vec_id"], r["embedding"]) for r in table.collect()]))
    assert vector_graph.audit(table, found, 5) == 1.0


def test_large_shard(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 40)
    r = np.random.Generator(np.random.PCG64(5))
    centre = r.normal(size=16)
    made = [(i, [float(x) for x in centre + r.normal(size=16) * 0.12]) for i in range(150)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got, want = {r["vec_id"]: r["n_links"] for r in vector_graph.near_duplicates(df).collect()}, {v: n for v, n, _, _ in brute.vectors(made)}
    assert all(got[v] <= want[v] for v in want)
    assert sum(got.values()) >= 0.95 * sum(want.values())


def test_search_meets_little(monkeypatch):
    """The graph finds the links of a shard of full size without comparing all with all; no pair under the bound."""
    r = np.random.Generator(np.random.PCG64(8))
    centres = r.normal(size=(150, 32))
    x = np.concatenate([c + 0.12 * r.normal(size=(r.integers(1, 12), 32)) for c in centres])[: vector_graph.SHARD]
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    sims, counted = x @ x.T, []
    real = np.einsum
    monkeypatch.setattr(np, "einsum", lambda form, a, b: counted.append(len(a)) or real(form, a, b))
    i, j = vector_graph.search(x, *vector_graph.neighbours(vector_graph.prune(sims.copy())))
    want = {(a, b) for a, b in zip(*np.nonzero(sims >= vector_graph.LEAST), strict=True) if a != b}
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    assert got <= want and len(got) >= 0.99 * len(want) > 500
    assert sum(counted) < 0.25 * len(x) ** 2


def test_split_shards(spark, monkeypatch):
    """Shards over the bound get centroids of their own; dense ones are dealt into parts. Recall by audit()."""
    monkeypatch.setattr(vector_graph, "SHARD", 64)
    monkeypatch.setattr(vector_graph, "CENTROIDS", 8)
    monkeypatch.setattr(vector_graph, "DEALT", 100)
    r = np.random.Generator(np.random.PCG64(9))
    x = np.concatenate([c + 0.1 * r.normal(size=(12, 24)) for c in r.normal(size=(100, 24))] + [r.normal(size=24) + 0.05 * r.normal(size=(200, 24))])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = common.materialize(vector_graph.near_duplicates(df))
    want = {v: n for v, n, _, _ in brute.vectors([(i, row.tolist()) for i, row in enumerate(x)])}
    got = {row["vec_id"]: row["n_links"] for row in found.collect()}
    assert all(got[v] <= n for v, n in want.items()) and sum(got.values()) >= 0.97 * sum(want.values())
    assert vector_graph.audit(df, found, 5) >= 0.95


# --- 9 decontamination -----------------------------------------------------------------------------------------------
HITS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_decontamination(spark, sf, docs, empty, small):
    passage = words(3, 120)
    items = [(1, " ".join(passage[5:25]).upper()), (2, "one, two!"), (3, None), (4, "..."), (5, " ".join(passage[8:30])), (5, "three"), (None, "été à noël")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, spans string")
    want = brute.contamination(pairs(docs), [("" if k is None else k, t) for k, t in items])
    same(decontam.scan_documents(docs, bench), HITS, want)
    clean = {r[0] for r in want if not r[-1]}
    dropped = decontam.drop_contaminated(docs, bench)
    assert dropped.columns == docs.columns and {r["doc_id"] for r in dropped.collect()} == clean
    assert decontam.scan_documents(empty, bench).count() == 0
    assert decontam.scan_documents(docs, bench.limit(0)).filter("contaminated").count() == 0
    table = common.table(spark, sf, "benchmark")
    same(decontam.scan_documents(small, table), HITS, brute.contamination(pairs(small), [tuple(r) for r in table.select("item_id", "text").collect()]))


def test_original_spans():
    text = "Ünder — One,TWO; three".encode()
    n, spans, _ = decontam.Scanner([(1, "one two")]).scan(text)
    assert n == 5 and [text[a:b] for a, b in decontam.original_spans(text, spans)] == [b"One,TWO"]


def test_benchmarks_after_one_another(spark, docs):
    """Workers are kept: each scan must use its own benchmark's automaton."""
    for k in range(6):
        items = [(k, " ".join(words(3, 120)[10 * k : 10 * k + 15]))]
        bench = spark.createDataFrame(items, "item_id long, text string")
        same(decontam.scan_documents(docs, bench), HITS, brute.contamination(pairs(docs), items))


def test_many_words_of_a_benchmark():
    """Codes of words differ beyond 256 and 65536 words, and no hit begins within a word."""
    names = [f"n{i}" for i in range(70_000)]
    found = decontam.Scanner([(i, " ".join(names[i : i + 12])) for i in range(0, 70_000, 12)])
    assert len({*found.code.values()}) == len(found.code)
    text = " ".join(["zz", *names[66_000:66_011], "zz", *names[5:13]]).encode()
    assert found.scan(text)[:2] == (21, [(1, 12)]) or found.scan(text)[1] == []
    for i in (0, 252, 65_532, 69_996):
        assert found.scan(" ".join(["x", *names[i : i + 10]]).encode()) == (len(names[i : i + 10]) + 1, [(1, len(names[i : i + 10]) + 1)], {str(i)})


# --- 10 archives -----------------------------------------------------------------------------------------------------
def test_arc_versions():
    held = [warc.ArcRecord("http://a/b%20c", "1.2.3.4", "20240102030405", "text/html", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\nmore", {}), warc.ArcRecord("http://e", "0.0.0.0", "19990101000000", "text/plain", b"", {})]
    for version in (1, 2):
        got = list(warc.read_arc(warc.write_arc(held, version)))
        assert [r[:5] for r in got] == [r[:5] for r in held]
        assert (got[0].extra.get("Result-code") == "200") is (version == 2)
    with pytest.raises(ValueError):
        list(warc.read_arc(warc.write_arc(held, 1)[:-5] + b"\nhttp://x 0 0 t 99\n"))
    with pytest.raises(ValueError):
        list(warc.read_arc(b"http://x 0.0.0.0 20240101000000 text/html 2\nab"))


def test_archives(spark, sf):
    big = "é" * 600
    made = [(1, "u1", big), (2, "u 2", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", "x\r\n\r\nHTTP/1.1\n" * 100), (3, None, big), (None, "n", big)]
    df = spark.createDataFrame([(*m, 1) for m in made], "page_id long, url string, html string, size long").repartition(3)
    got = rows(warc.convert(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    body = lambda h: (h or "").encode()
    want = [(p, len(body(h)), hashlib.sha1(body(h)).hexdigest(), "revisit" if h == big and p != 3 else "response", 3 if h == big and p != 3 else None) for p, _, h in made]
    assert got == sorted(want, key=str)
    assert warc.convert(df.limit(0)).count() == 0
    pages = common.table(spark, sf, "pages")
    assert warc.convert(pages).filter("record_type = 'response'").count() == pages.filter(F.length("html") >= 0).count()


def test_many_small_records():
    """A reader's time is linear in the records of an archive."""
    import time
    import zlib

    def member(i):
        deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
        r = warc.ArcRecord(f"http://a/{i}", "0.0.0.0", "20240101000000", "text/html", b"HTTP/1.1 200 OK\r\n\r\n" + b"%d" % i * (i % 50), {})
        return deflate.compress(warc.to_warc(r, {})) + deflate.flush()

    data, began = b"".join(map(member, range(16_000))), time.time()
    got = [(f["WARC-Target-URI"], warc.split_http(b)[1]) for f, b in warc.read_warc(data)]
    assert got == [(f"http://a/{i}", b"%d" % i * (i % 50)) for i in range(16_000)] and time.time() - began < 10
    with pytest.raises(ValueError):
        list(warc.read_warc(data[:-3]))


# --- all ---------------------------------------------------------------------------------------------------------------
def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 10)], "a long, b long")
    assert {tuple(r) for r in common.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (10, 1), (7, 7), (8, 7), (9, 7)}
