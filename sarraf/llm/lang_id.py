"""Language identification by prediction by partial matching.

One byte context tree a language holds how often each byte follows each context of up to ORDER bytes. A byte
costs -log2 of its share in the longest known context, or the context's escape share (method C: distinct
followers over all followers and distinct ones) and then its cost in the next shorter context, down to 8 bits
for any byte. Counts are frozen after training, so the cost of every context and byte is worked out once, and
a text's exact code length under each language is a sum of looked-up costs.

Counts come from up to SAMPLE labelled documents a language, those with the least hash of id; the bound is for
this fitted classifier only. All documents are scored whole.

Defined cases: null texts and texts without a letter are `und` with score 0, also all texts if nothing is
labelled; ties go to the first language by name; null doc_id counts as not held out; equal rows score alike;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER, SAMPLE = 3, 600
CHUNK = 1 << 20


def codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, the byte and the ORDER before it in one number; 0 stands before a text's start."""
    out, begin = np.zeros(len(data), np.uint32), np.zeros(len(data) + 1, bool)
    begin[offsets] = True
    since = np.arange(len(data)) - np.maximum.accumulate(np.where(begin[:-1], np.arange(len(data)), 0)) if len(data) else out
    for k in range(ORDER, -1, -1):
        back = np.zeros(len(data), np.uint32)
        back[k:] = data[: len(data) - k] if k else data
        back[since < k] = 0
        out = (out << np.uint32(8)) | back
    return out


def _count(batches):
    for batch in batches:
        for lang in pc.unique(batch["lang"]).to_pylist():
            data, offsets = common.utf8(pc.utf8_lower(batch["text"].filter(pc.equal(batch["lang"], lang))))
            code, n = np.unique(codes(data, offsets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])


class Model:
    """Frozen costs of all languages: cost[row[context], byte] has one number a language."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        used = np.zeros(256, bool)
        for code, _ in counts:
            used[code & 255] = True
        used[0] = True
        self.letter = np.full(256, int(used.sum()), np.int64)  # bytes never seen share the last place
        self.letter[used] = np.arange(used.sum())
        a = self.size = int(used.sum()) + 1
        small = lambda code, k: self.letter[(code >> (8 * k)) & 255]
        grams = [small(c, 3) * a**3 + small(c, 2) * a**2 + small(c, 1) * a + small(c, 0) for c, _ in counts]
        known = np.unique(np.concatenate([g // a for g in grams])) if grams else np.zeros(0, np.int64)
        self.row = len(known) + np.arange(a**3) % a**2
        self.row[known] = np.arange(len(known))
        self.cost = np.zeros((len(known) + a * a, a, len(langs)), np.float32)
        for k, (g, (_, n)) in enumerate(zip(grams, counts, strict=True)):
            low = np.full((1, a), 8.0)
            for order in range(ORDER):  # contexts of 0, 1, 2 bytes, all of them
                low = self._next(np.bincount(g % a ** (order + 1), n, a ** (order + 1)).reshape(-1, a), np.tile(low, (a if order else 1, 1)))
            self.cost[len(known) :, :, k] = low
            table = np.zeros((len(known), a))
            np.add.at(table, (np.searchsorted(known, g // a), g % a), n)
            self.cost[: len(known), :, k] = self._next(table, low[known % a**2])

    @staticmethod
    def _next(count: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Costs in contexts with these counts, given the costs in the contexts without their first byte."""
        total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen, escape = -np.log2(count / (total + kinds)), -np.log2(kinds / (total + kinds))
        return np.where(total == 0, shorter, np.where(count > 0, seen, np.where(total > 0, escape, 0.0) + shorter))

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out, a = np.zeros((len(offsets) - 1, len(self.langs))), self.size
        code = codes(data, offsets)
        for at in range(0, len(data), CHUNK):
            c = code[at : at + CHUNK]
            context = (self.letter[(c >> np.uint32(24)) & np.uint32(255)] * a + self.letter[(c >> np.uint32(16)) & np.uint32(255)]) * a + self.letter[(c >> np.uint32(8)) & np.uint32(255)]
            cost = self.cost[self.row[context], self.letter[c & np.uint32(255)]]
            first = max(0, int(np.searchsorted(offsets, at, "right")) - 1)
            edge = offsets[first : int(np.searchsorted(offsets, at + len(c)))] - at
            edge = np.maximum(edge, 0)
            full = np.r_[edge[1:], len(c)] > edge
            sums = np.add.reduceat(cost, edge[full], axis=0, dtype=np.float64)
            out[first : first + len(edge)][full] += sums
        return out


def train(docs: DataFrame) -> Model:
    """Counts bytes in context over the sample; at most SAMPLE documents a language are read whole."""
    common.text_batches(docs.sparkSession)
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.xxhash64("doc_id") / 2.0**64 + 0.5  # evenly between 0 and 1
    # Of each language, only so many ids meet in one task as make SAMPLE very likely: 2 * SAMPLE by their share of all.
    shares = labelled.groupBy("lang").agg((F.lit(2.0 * SAMPLE) / F.count("*")).alias("share"))
    few = labelled.select("doc_id", "lang").join(F.broadcast(shares), "lang").filter(place <= F.col("share"))  # a row a language
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = few.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= SAMPLE).select("doc_id").distinct()
    counted = labelled.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text").mapInArrow(_count, "lang string, code long, n long")
    rows = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(pc.unique(rows["lang"]).to_pylist(), key=str.encode)
    code, n, of = rows["code"].to_numpy(), rows["n"].to_numpy(), np.array(rows["lang"].to_pylist(), object)
    return Model(langs, [(code[of == x], n[of == x]) for x in langs])


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _score(held):
    def run(batches):
        model = held.value
        for batch in batches:
            n = batch.num_rows
            pred, score = np.full(n, "und", object), np.zeros(n)
            if model.langs and n:
                bits = model.lengths(*common.utf8(pc.utf8_lower(batch["text"])))
                best = bits.argmin(1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                letters = batch["letters"].to_numpy(zero_copy_only=False)
                pred[letters] = np.array(model.langs, object)[best[letters]]
                score[letters] = share[letters]
            rest = [batch[c] for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    model = model or train(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text", letters.alias("letters")).mapInArrow(_score(held), "doc_id long, held_out boolean, lang_pred string, score double")


def _keep(held, least):
    def run(batches):
        for batch in batches:
            model, texts = held.value, batch["text"]
            letters = np.array(pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_pylist(), bool)
            if not model.langs or not batch.num_rows:
                yield batch.filter(pa.array(np.zeros(batch.num_rows, bool)))
                continue
            bits = model.lengths(*common.utf8(pc.utf8_lower(texts)))
            share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
            yield batch.filter(pa.array(letters & (share >= least)))

    return run


def drop_unidentified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The documents whose language is known with at least this score, with the columns of the input."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs))
    return docs.mapInArrow(_keep(held, least_score), docs.schema)
