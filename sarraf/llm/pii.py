"""Personal data by weak supervision.

Candidates are the spans of four exact patterns and of looser ones (e-mail addresses spelled out, numbers grouped
like phones, cards that fail the checksum). Labelers vote on each: the exact patterns, gazetteers of cue and decoy
words, and context (what stands right before and after). Expectation-maximisation over the corpus-wide counts of
vote patterns estimates how often each labeler is right and, from that, the chance that a candidate of a pattern is
personal data. A logistic span classifier is trained on those chances: it sees the span (length, digits, separators)
and the words around it, not the votes, and at most SAMPLE different candidates (votes and features), those with the least hash. Spans of exact
patterns always stay; a loose candidate is added if the classifier gives it at least ACCEPT.

Defined cases: a null text is empty; texts without spans have counts 0 and the hash of nothing; overlapping
spans of different kinds stay both; null doc_id is kept; equal rows count each; an empty table gives no rows; other
columns are ignored. Time is linear in the text's length, also in long runs of digits, letters or signs.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: A loose candidate is added from this chance on.
ACCEPT = 0.9
#: Characters of context on either side, candidates that the classifier is fitted on, and places of its hashed words.
CONTEXT, SAMPLE, HASHED = 24, 20_000, 256

#: Fixed values of the contract: the exact patterns. Runs are taken whole, and a match begins where a run does or the
#: match before ended, which changes no match and spares trying every place of a long run.
EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL_HERE.pattern)
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOOSE = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{2,64}\s?[\[({]\s?at\s?[\])}]\s?[A-Za-z0-9-]{1,63}(?:\s?[\[({.]\s?(?:dot)?\s?[\])}]?\s?[A-Za-z]{2,24}){1,4}\b", re.I),
    "phone": re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\)\s?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w.-])[0-9]{4}(?:[ -][0-9]{4}){3}(?![\w-])"),
}
#: Gazetteers: words that stand beside personal data, and beside other numbers.
CUES = re.compile(r"\b(?:e-?mail|mail|contact|reach|write|phone|tel|telephone|mobile|cell|call|fax|whatsapp|card|visa|mastercard|amex|credit|debit|pay|ip|host|address|login|user|correo|tel[ée]fono|tarjeta|courriel|t[ée]l[ée]phone|carte|telefon|handy|karte)\b", re.I)
DECOYS = re.compile(r"\b(?:isbn|issn|order|invoice|version|ver|release|build|sku|ref|reference|id|serial|tracking|part|model|page|chapter|section|figure|table|total|price|usd|eur)\b", re.I)
LABELERS = ("exact", "cue", "decoy", "edges", "shape")


#: Log-odds from which estimation starts: without votes, and by labeler for votes p, n, -.
START = (-0.5, np.array([[3.0, 0.0, 0.0], [1.5, 0.0, 0.0], [0.0, -3.0, 0.0], [0.0, -1.0, 0.0], [0.0, -1.0, 0.0]]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def exact(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns; matches that fail their test go without another try."""
    out = []
    m = EMAIL.search(text) if "@" in text else None
    while m:
        out.append((m.start(), 0, m.end()))
        m = EMAIL_HERE.match(text, m.end()) or EMAIL.search(text, m.end())
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def loose(text: str, held: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates that overlap no exact span."""
    out, starts, ends = [], [s for s, _, _ in held], []
    for _, _, e in held:  # the furthest end of the spans up to each
        ends.append(max(e, ends[-1] if ends else 0))
    for kind, pattern in LOOSE.items():
        if kind == "email" and " at " not in text and not re.search(r"[\[({]\s?at", text, re.I):
            continue
        for m in pattern.finditer(text):
            before = bisect_left(starts, m.end())
            if not before or ends[before - 1] <= m.start():
                out.append((m.start(), KINDS.index(kind), m.end()))
    return sorted(out)


def votes(text: str, start: int, kind: int, end: int, is_exact: bool) -> str:
    """A letter for each of LABELERS: p for personal data, n for not, - for no vote."""
    left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    span, digits = text[start:end], re.sub("[^0-9]", "", text[start:end])
    before, after = left[-1:], right[:1]
    whole = (not before or before.isspace() or before in "(<[\"':,;|") and (not after or after.isspace() or after in ")>]\"'.,;:!?|")
    shape = {0: "p" if re.search(r"\.(?:com|org|net|edu|gov|io|de|fr|es|info)\b", span, re.I) else "-", 1: "n" if span.startswith(("0.", "255.")) else "p", 2: "p" if digits[:1] in ("3", "4", "5", "6") and luhn(digits) else "n", 3: "p" if 10 <= len(digits) <= 15 and len(set(digits)) > 2 else "n"}[kind]
    return ("p" if is_exact else "-") + ("p" if CUES.search(left) or CUES.search(right[:8]) else "-") + ("n" if DECOYS.search(left) else "-") + ("p" if whole else "n") + shape


_WORD = re.compile(r"[^\W\d_]+|\n")
_SIGNS = (" ", "-", ".", "(", "[", "@", "+")
DIM = 1 + len(KINDS) * 9 + len(_SIGNS) + 4 * 6 + 3 * HASHED


def seen(text: str, start: int, kind: int, end: int) -> list[int]:
    """What the span classifier sees: places of the features that hold. No labeler votes on these."""
    span, left, right = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    size = min(8, (end - start) // 4)
    out, at = [0, 1 + kind * 9 + size], 1 + len(KINDS) * 9
    out += [at + i for i, x in enumerate(_SIGNS) if x in span]
    at += len(_SIGNS)
    sort = lambda c: 0 if not c else 1 if c == "\n" else 2 if c.isspace() else 3 if c.isalnum() else 4 if c in ":=" else 5
    for i, c in enumerate((left[-1:], left[-2:-1], right[:1], right[1:2])):
        out.append(at + 6 * i + sort(c))
    at += 24
    before, after = _WORD.findall(left)[-2:], _WORD.findall(right)[:1]
    for i, w in enumerate((before[-1:], before[:-1], after)):
        if w:
            out.append(at + HASHED * i + zlib.crc32(w[0].lower().encode("utf-8", "replace")) % HASHED)
    return out


_FOUND = "doc_id long, base array<struct<start:int,kind:int,end:int>>, more array<struct<start:int,kind:int,end:int,seen:array<int>>>, patterns array<struct<votes:string,seen:array<int>>>"


def _find(batches):
    span = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]
    shown = ("seen", pa.list_(pa.int32()))
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct(span))), ("more", pa.list_(pa.struct([*span, shown]))), ("patterns", pa.list_(pa.struct([("votes", pa.string()), shown])))])
    as_dict = lambda x: dict(zip(("start", "kind", "end", "seen"), x, strict=False))
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            text = text or ""
            base = exact(text)
            more = [(*x, seen(text, *x)) for x in loose(text, base)]
            patterns = [{"votes": f"{KINDS[x[1]]}:{votes(text, *x[:3], is_exact)}", "seen": x[3]} for found, is_exact in (([(*x, seen(text, *x)) for x in base], True), (more, False)) for x in found]
            rows.append({"doc_id": doc, "base": [*map(as_dict, base)], "more": [*map(as_dict, more)], "patterns": patterns})
        yield pa.RecordBatch.from_pylist(rows, schema)


def estimate(patterns: list[tuple[str, int]], rounds: int = 50) -> tuple[dict[str, float], np.ndarray]:
    """Chance of personal data for each vote pattern, and each labeler's shares of votes p, n, - on data and on other spans.

    Two-class expectation-maximisation with smoothed counts. It starts from START's weights of votes: edges and
    shape can only speak against a candidate.
    """
    if not patterns:
        return {}, np.full((2, len(LABELERS), 3), 1 / 3)
    names = [p.split(":")[1] for p, _ in patterns]
    n = np.array([c for _, c in patterns], float)
    v = np.array([["pn-".index(c) for c in x] for x in names])
    one = np.eye(3)[v]
    chance = 1 / (1 + np.exp(-(START[0] + sum(START[1][k][v[:, k]] for k in range(len(LABELERS))))))
    # Priors on right votes keep the classes from trading places.
    prior = np.array([[[4.0, 1.0, 2.0]] * len(LABELERS), [[1.0, 4.0, 2.0]] * len(LABELERS)])
    for _ in range(rounds):
        weight = np.stack([chance * n, (1 - chance) * n])
        share = np.einsum("cp,plk->clk", weight, one) + prior
        share /= share.sum(2, keepdims=True)
        odds = np.log((weight[0].sum() + 1) / (weight[1].sum() + 1)) + (np.log(share[0]) - np.log(share[1]))[np.arange(len(LABELERS)), v].sum(1)
        chance = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return {p: float(c) for (p, _), c in zip(patterns, chance, strict=True)}, share


def fit(found: list[list[int]], chance: np.ndarray, n: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic weights by Newton steps on soft labels, each met n times, with a small penalty."""
    x = np.zeros((len(found), DIM))
    for i, places in enumerate(found):
        x[i, places] = 1.0
    w = np.zeros(DIM)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(DIM)
        step = np.linalg.solve(hess, x.T @ (n * (chance - p)) - 0.1 * w)
        w += step
        if np.abs(step).max(initial=0) < 1e-6:
            break
    return w


def line(spans: list[tuple[int, int, int]]) -> str:
    """Spans as kind:start:end by start, then kind."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _decide(weights: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
    least = np.log(ACCEPT / (1 - ACCEPT))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, base, more in zip(*(batch[c].to_pylist() for c in ("doc_id", "base", "more")), strict=True):
                base = [(x["start"], x["kind"], x["end"]) for x in base]
                added = [(x["start"], x["kind"], x["end"]) for x in more if weights[x["seen"]].sum() >= least]
                rows.append((doc, *(sum(k == i for _, k, _ in base) for i in range(4)), hashlib.sha256(line(base).encode()).hexdigest(), line(base + added), len(added)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each document."""
    common.text_batches(docs.sparkSession)
    found = common.materialize(docs.select("doc_id", "text").mapInArrow(_find, _FOUND))
    spans = found.select(F.explode("patterns").alias("p")).select("p.*")
    # At most kinds x 3 ** labelers patterns come to the driver, whatever the corpus, and SAMPLE candidates.
    different = common.materialize(spans.groupBy("votes", "seen").agg(F.count("*").alias("n")))
    patterns = sorted(tuple(r) for r in different.groupBy("votes").agg(F.sum("n")).collect())
    chance, _ = estimate(patterns)
    name = F.xxhash64("votes", "seen")
    # About 2 * SAMPLE of them are sorted, so that no more come to the driver however many tasks there are.
    share = 2 * SAMPLE / max(1, different.count())
    rows = different.filter(name / 2.0**64 + 0.5 <= share).orderBy(name, "votes").limit(SAMPLE).collect()
    weights = fit([r["seen"] for r in rows], np.array([chance[r["votes"]] for r in rows]), np.array([float(r["n"]) for r in rows]))
    return found.select("doc_id", "base", "more").mapInArrow(_decide(weights), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
