"""The registered query of each operator, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from . import centroids, decontam, exact_dedup, html_blocks, lang_id, merkle, mixing, ngram_join, pii, sharding, suffix_dedup, vector_graph, warc
from .common import table

SHARDS = 24


def op1_slot_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op3_html_blocks(spark, sf_dir):
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op4_ppm_language(spark, sf_dir):
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark, sf_dir):
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents")).drop("set_key")


def op6_pivotal_mixing(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents"))


def op7_weak_pii(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op8_pruned_graph(spark, sf_dir):
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_aho_decontamination(spark, sf_dir):
    return decontam.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op10_arc_to_warc(spark, sf_dir):
    return warc.convert(table(spark, sf_dir, "pages")).drop("record_id", "url")


def op11_centroid_clusters(spark, sf_dir):
    return centroids.clusters(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digests=True)


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("path")


QUERIES = {f.__name__: f for f in (op1_slot_sharding, op2_suffix_dedup, op3_html_blocks, op4_ppm_language, op5_ngram_jaccard, op6_pivotal_mixing, op7_weak_pii, op8_pruned_graph, op9_aho_decontamination, op10_arc_to_warc, op11_centroid_clusters, op12_exact_dedup, op13_merkle_manifest)}

#: Components of links(a, b), under the nodes of rows(node): the least node of each.
_COMPONENTS = """b AS MATERIALIZED (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links),
        w(node, root) USING KEY (node) AS (SELECT DISTINCT node, node FROM nodes
          UNION (SELECT b.x, min(w.root) FROM w JOIN b ON w.node = b.y JOIN recurring.w AS u ON u.node = b.x WHERE w.root < u.root GROUP BY b.x))"""
#: A-Z in lower case, nothing else.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _cluster_sql(rounds: int = 3, k: int = 16) -> str:
    """Rounds of assignment and floored means, written out one after the other; components stay rows of (vector, place)."""
    steps = [f"""
        q AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS INT) AS cluster, q AS c FROM q QUALIFY cluster < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
        a{i} AS MATERIALIZED (SELECT vec_id, q, min(struct_pack(d := CAST(d AS BIGINT), cluster := cluster)) AS x FROM
          (SELECT vec_id, q, cluster, list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM q, c{i}) GROUP BY vec_id, q)""")
        if i < rounds:
            steps.append(f"""
        m{i} AS (SELECT cluster, p, sum(v) AS s, count(*) AS n FROM (SELECT x.cluster AS cluster, unnest(range(1, 65)) AS p, unnest(q) AS v FROM a{i}) GROUP BY 1, 2),
        n{i} AS (SELECT cluster, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY p) AS c FROM m{i} GROUP BY 1),
        c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN n{i} n ON n.cluster = o.cluster)""")
    return f"""WITH {','.join(steps)}
        SELECT vec_id, x.cluster AS cluster, x.d AS distance, CAST(sum(x.d) OVER (PARTITION BY x.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(x.d) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} z ON z.cluster = x.cluster"""


def _merkle_sql(levels: int = 7, over: int = 3) -> str:
    """The tree of each language for so many levels, then the one over the languages: 8 ** levels rows a language at most."""
    field = lambda c, v=None: f"coalesce(octet_length(encode(CAST({v or c} AS VARCHAR))) || ':' || CAST({v or c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field("", text)]) + ")"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda i: CAST((ascii(ch) >> i) & 1 AS BIGINT))))"
    crc = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"
    steps = [f"""
        d AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS forged FROM documents),
        g AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM d)),
        e AS MATERIALIZED (SELECT g, doc_id, leaf, forged, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS p FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
        n0 AS MATERIALIZED (SELECT g, p, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM e),
        f0 AS (SELECT g, p, p AS own, coalesce(forged, leaf) AS f, '' AS proof FROM e)"""]
    for i in range(levels + over):
        if i == levels:
            steps.append(f"""
        n{i}s AS MATERIALIZED (SELECT 0 AS g, g AS p, h, count(*) OVER () AS n FROM n{i}),
        f{i}s AS (SELECT 0 AS g, g AS p, g AS lang_no, own, f, proof FROM f{i})""")
        n, f, keep = (f"n{i}s", f"f{i}s", "f.lang_no, ") if i == levels else (f"n{i}", f"f{i}", "f.lang_no, " if i > levels else "")
        steps.append(f"""
        s{i} AS MATERIALIZED (SELECT x.g, x.p, x.n, coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p < x.p), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p > x.p), '') AS r
          FROM {n} x JOIN {n} y ON x.g = y.g AND x.p // 8 = y.p // 8 GROUP BY 1, 2, 3),
        n{i + 1} AS MATERIALIZED (SELECT g, p // 8 AS p, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END AS h, (n + 7) // 8 AS n FROM {n} GROUP BY g, p // 8, n),
        f{i + 1} AS MATERIALIZED (SELECT f.g, f.p // 8 AS p, {keep}f.own, CASE WHEN s.n > 1 THEN sha256(s.l || f.f || s.r) ELSE f.f END AS f, f.proof || s.l || s.r AS proof FROM {f} f JOIN s{i} s ON s.g = f.g AND s.p = f.p)""")
    return f"""WITH {','.join(steps)}
        SELECT e.doc_id, e.leaf, b.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.f AS folded_root, f.f = r.h AS verified
        FROM e JOIN f{levels + over} f ON f.lang_no = e.g AND f.own = e.p JOIN n{levels} b ON b.g = e.g CROSS JOIN n{levels + over} r"""


#: What follows from the tables alone, by brute force.
ORACLE_SQL = {
    "op11_centroid_clusters": _cluster_sql(),
    "op12_exact_dedup": """
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
        r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY norm) AS group_size FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id))
        SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM r
    """,
    "op13_merkle_manifest": _merkle_sql(),
    "op5_ngram_jaccard": f"""
        WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        g AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS gram FROM t, range(1, 1 + greatest(1, len(w) - 4)) r(i) WHERE len(w) > 0),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
        links AS MATERIALIZED (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * both_have >= 80 * (m.n + o.n - both_have)),
        nodes AS (SELECT doc_id AS node FROM documents), {_COMPONENTS}
        SELECT t.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN w ON w.node = t.doc_id
    """,
    "op8_pruned_graph": f"""
        WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
        u AS MATERIALIZED (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id < y.vec_id AND x.size > 0 AND y.size > 0 AND len(x.v) = len(y.v) AND list_inner_product(x.v, y.v) >= 0.95 * x.size * y.size),
        nodes AS (SELECT vec_id AS node FROM embeddings), {_COMPONENTS}, c AS (SELECT x AS vec_id, count(*) AS n FROM b GROUP BY 1)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, root AS component_id, e.vec_id = root AS kept FROM e LEFT JOIN c ON c.vec_id = e.vec_id JOIN w ON w.node = e.vec_id
    """,
    "op9_aho_decontamination": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        k AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p : p + 9], ' ') AS phrase FROM i, range(1, 1 + greatest(1, len(w) - 9)) r(p) WHERE len(w) > 0),
        s AS (SELECT DISTINCT size FROM k),
        m AS MATERIALIZED (SELECT doc_id, p, size, array_to_string(w[p : p + size - 1], ' ') AS phrase FROM d, s, range(1, 1 + greatest(0, len(w) - size + 1)) r(p)),
        f AS MATERIALIZED (SELECT doc_id, p, m.size, item_id FROM m JOIN k ON m.size = k.size AND m.phrase = k.phrase),
        h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM f, range(p, p + size) r(q) GROUP BY 1),
        j AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM f) GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN j ON j.doc_id = d.doc_id
    """,
    "op10_arc_to_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        m AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
               CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN last <> page_id THEN last END AS refers_to
        FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest
    """,
}
