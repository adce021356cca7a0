"""Plain single-machine versions of what the operators must return, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def repeats(docs, window=400):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of [(doc_id, text)]."""
    data = [(t or "").encode() for _, t in docs]
    count = defaultdict(int)
    for t in data:
        for i in range(len(t) - window + 1):
            count[hash(t[i : i + window])] += 1
    out = []
    for (doc, _), t in zip(docs, data, strict=True):
        cut = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - window + 1):
            if count[hash(t[i : i + window])] > 1:
                cut[i] += 1
                cut[i + window] -= 1
        gone = np.cumsum(cut[:-1]) > 0
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def shingle_sets(docs):
    out = []
    for doc, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((doc, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def jaccard(docs):
    """(doc_id, n_shingles, component_id); rows are told apart by place."""
    sets, pairs = shingle_sets(docs), []
    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        meets = defaultdict(int)
        for x in s:
            for j in where[x]:
                meets[j] += 1
            where[x].append(i)
        pairs += [(i, j) for j, k in meets.items() if 100 * k >= 80 * (len(s) + len(sets[j][1]) - k)]
    root, least = roots(range(len(sets)), pairs), {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[root[i]] = min(least.get(root[i], doc), doc)
    return [(doc, len(s), least.get(root[i])) for i, (doc, s) in enumerate(sets)]


def personal_spans(text):
    """The spans that personal() hashes."""
    return personal([(0, text)], True)


def personal(docs, spans=False):
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256), written from the contract."""
    out = []
    for doc, t in docs:
        t, found = t or "", []
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
            found.append((m.start(), 0, m.end()))
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
            if all(int(x) <= 255 for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(x) for x in m[0] if x.isdigit()]
            if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
                found.append((m.start(), 2, m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
            if 10 <= sum(x.isdigit() for x in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
        names = ("email", "ip", "card", "phone")
        line = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(found))
        if spans:
            return line
        out.append((doc, *(sum(k == i for _, k, _ in found) for i in range(4)), sha(line)))
    return out


def contamination(docs, items):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = defaultdict(set)
    for key, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            held[tuple(w[i : i + 10])].add(str(key))
    sizes, out = {len(k) for k in held}, []
    for doc, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in held:
                    hit |= set(range(i, i + n))
                    ids |= held[k]
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def vectors(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) of [(vec_id, list)]."""
    fit = {}
    for i, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            fit[i] = x / np.sqrt(x @ x)
    pairs = [(i, j) for i in fit for j in fit if i < j and len(fit[i]) == len(fit[j]) and fit[i] @ fit[j] >= least]
    n, root = defaultdict(int), roots(range(len(rows)), pairs)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    lowest = defaultdict(lambda: float("inf"))
    for i, (v, _) in enumerate(rows):
        lowest[root[i]] = min(lowest[root[i]], v)
    return [(v, n[i], lowest[root[i]], v == lowest[root[i]]) for i, (v, _) in enumerate(rows)]
