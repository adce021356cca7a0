"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to their words in lower case, and each word that the benchmark has to a code of three letters;
the automaton holds each window of WINDOW item words as such codes, so a hit begins and ends at words. A text is
scanned once, words that no item has being a letter of their own, and hits map back to word numbers and to bytes of
the original. A letter's place in the code tells the letters apart, so no hit begins within a word.

One automaton takes about MEMORY bytes for each byte of benchmark text in each Python worker (measured on prose), so
AUTOMATON_BYTES of text, which are accepted, come to about 1 GB; more are refused.

Defined cases: null and wordless texts have no words and no hits; null and wordless items have no windows; an
item shorter than a window is one window; equal items count by their ids, a null item_id as an empty one; null
doc_id is kept; equal rows count each; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Bytes of benchmark text for which one automaton is built in each Python worker, and memory for each of them.
AUTOMATON_BYTES, MEMORY = 4 << 20, 230

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Scanner:
    """The codes of words and the automaton over windows of them; a window's value is its length and its items."""

    UNKNOWN = chr(3 * 256)

    def __init__(self, items: list[tuple[object, str | None]]):
        self.code: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        for key, text in items:
            name = "" if key is None else str(key)
            w = [self.code.setdefault(x, self._code(len(self.code))) for x in words((text or "").encode())]
            for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
                window = w[i : i + WINDOW]
                held = self.automaton.get("".join(window), None)
                if held is None:
                    self.automaton.add_word("".join(window), (len(window), {name}))
                else:
                    held[1].add(name)
        self.empty = not self.code
        if not self.empty:
            self.automaton.make_automaton()

    @staticmethod
    def _code(n: int) -> str:
        return chr(n & 255) + chr(256 + (n >> 8 & 255)) + chr(512 + (n >> 16))

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged spans of hit words, and the items that occur."""
        w = words(text)
        if not w or self.empty:
            return len(w), [], set()
        code, unknown, spans, items = self.code.get, self.UNKNOWN * 3, [], set()
        for end, (n, ids) in self.automaton.iter("".join([code(x, unknown) for x in w])):
            spans.append((end // 3 - n + 1, end // 3 + 1))
            items.update(ids)
        merged: list[tuple[int, int]] = []
        for lo, hi in sorted(spans):
            if merged and lo <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            else:
                merged.append((lo, hi))
        return len(w), merged, items


_built: dict[str, Scanner] = {}


def scanner(held) -> Scanner:
    """Built once for each benchmark in each Python worker, which keeps the last; held: a broadcast (name, items)."""
    name, items = held.value
    if name not in _built:
        _built.clear()
        _built[name] = Scanner(items)
    return _built[name]


def original_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans in the original of spans of words."""
    if not spans:
        return []
    word = np.frombuffer(text.translate(_WORDS), np.uint8) != 32
    start = np.flatnonzero(word & np.r_[True, ~word[:-1]])
    end = np.flatnonzero(word & np.r_[~word[1:], True]) + 1
    return [(int(start[lo]), int(end[hi - 1])) for lo, hi in spans]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.list_(pa.int64())))])


def _scan(held):
    def run(batches):
        for batch in batches:
            rows = []
            data, offsets = common.utf8(batch["text"])
            for i, doc in enumerate(batch["doc_id"].to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                n, spans, items = scanner(held).scan(text)
                hit = sum(hi - lo for lo, hi in spans)
                rows.append((doc, n, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0, original_spans(text, spans)))
            yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r, strict=True)) for r in rows], _OUT)

    return run


def _share(benchmark: DataFrame):
    """The items of a benchmark of checked size, under a name of their own, sent to every executor."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > AUTOMATON_BYTES:
        raise ValueError(f"benchmark holds {size} bytes of text; one automaton takes {AUTOMATON_BYTES}, about {MEMORY * AUTOMATON_BYTES >> 20} MB of memory: call it for parts of the benchmark")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    return benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))


def scan_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit byte spans for each document."""
    common.text_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan(_share(benchmark)), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<long>>")


def _clean(held):
    def run(batches):
        for batch in batches:
            data, offsets = common.utf8(batch["text"])
            yield batch.filter(pa.array([not scanner(held).scan(data[offsets[i] : offsets[i + 1]].tobytes())[1] for i in range(batch.num_rows)], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit word, with the columns of the input, in one scan."""
    common.text_batches(docs.sparkSession)
    return docs.mapInArrow(_clean(_share(benchmark)), docs.schema)
