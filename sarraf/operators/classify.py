"""Categories of payments by rules and vectors; structured tags of questions; headers to columns."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, clean_purpose, norm_text
from ..plans.runtime import cut
from . import rules, vectors


def rx(pattern: str) -> str:
    """Case, word characters and boundaries by Unicode."""
    return f"(?iuU){pattern}"


def first_match(c: Column, table: list[tuple[str, object]]) -> Column:
    out = None
    for pattern, value in table:
        out = F.when(c.rlike(rx(pattern)), F.lit(value)) if out is None else out.when(c.rlike(rx(pattern)), F.lit(value))
    return out


def rule_text(purpose: Column, code: Column, op_type: Column) -> Column:
    """What the rules search: cleaned purpose, code and operation type."""
    return F.concat_ws(" | ", *(F.nullif(c, F.lit("")) for c in (clean_purpose(purpose), F.trim(F.coalesce(code, F.lit(""))), clean_purpose(op_type))))


def result(rule_id: str, category: str, confidence: float, source: str, review: bool) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), F.lit(rule_id).alias("rule_id"), F.lit(review).alias("needs_review"))


def recycled() -> Column:
    """What payments get whose raw text names a cash recycler."""
    return result("CASH_TOPUP_DIRECT", "CASH_TOPUP", 0.99, "rule", False)


def required(pattern: str) -> frozenset[str] | None:
    """Literals in lower case of which every match of the pattern holds one; None if there is no such set.

    Reads the parts of Python's own parse of the pattern: in a sequence the best part counts, in alternatives all do.
    """
    return _required(re._parser.parse(pattern, re.IGNORECASE))


def _required(parts) -> frozenset[str] | None:
    found, run = [], ""
    for op, arg in [*parts, (None, None)]:
        if str(op) == "LITERAL":
            run += chr(arg).lower()
            continue
        if run:
            found.append(frozenset([run]))
        run, inner = "", None
        if str(op) == "BRANCH":
            each = [_required(x) for x in arg[1]]
            inner = frozenset().union(*each) if all(each) else None
        elif str(op) == "SUBPATTERN":
            inner = _required(arg[-1])
        elif str(op) == "MAX_REPEAT" and arg[0]:
            inner = _required(arg[-1])
        if inner:
            found.append(inner)
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _any_prefix(words: list[str]) -> str:
    """A pattern of any of these words, none of them a prefix of another, with common prefixes written once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + (_any_prefix(rest) if all(rest) else "") for c, rest in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


@lru_cache(maxsize=1)
def rule_index() -> tuple[list[tuple], dict[str, int]]:
    """The rules by priority, and the inverted table: each literal with the rules that need it, one bit a rule by place."""
    ordered = sorted(rules.RULES, key=lambda r: -r[2])
    needs = [required(r[3]) for r in ordered]
    if len(ordered) > 63 or not all(needs):
        raise ValueError("a rule needs a literal, and a number of 64 bits has room for 63 rules")
    every, index = frozenset().union(*needs), {}
    for at, need in enumerate(needs):
        for word in need:
            head = min((x for x in every if word.startswith(x)), key=len)  # so that one literal at most starts at a place
            index[head] = index.get(head, 0) | 1 << at
    return ordered, index


#: Letters that a pattern without case takes for others although lower case leaves them as they are: by their upper case.
LOOSE = "İıſᲀᲁᲂᲃᲄᲅᲆ", "iisвдосттъ"


def rule_candidates(text: Column) -> Column:
    """One bit for each rule whose literals the text holds: all literals are found in one pass, by a tree of their letters."""
    _, index = rule_index()
    plain = F.lower(F.translate(text, *LOOSE))
    held = F.array_distinct(F.regexp_extract_all(plain, F.lit(f"(?=({_any_prefix(list(index))}))"), F.lit(1)))
    book = F.create_map(*(F.lit(x) for kv in sorted(index.items()) for x in kv))
    return F.aggregate(held, F.lit(0).cast("long"), lambda bits, word: bits.bitwiseOR(F.element_at(book, word).cast("long")))


def rule_place(text: Column, candidates: Column) -> Column:
    """Place of the first rule by priority whose pattern the text holds, else their number.

    Both are columns, not expressions, since each rule reads them; candidates are rule_candidates(text). A pattern is
    tried only on texts that hold one of its literals.
    """
    out, ordered = None, rule_index()[0]
    for at, rule in enumerate(ordered):
        hit = (candidates.bitwiseAND(F.lit(1 << at)) != 0) & text.rlike(rx(rule[3])), F.lit(at)
        out = F.when(*hit) if out is None else out.when(*hit)
    return out.otherwise(len(ordered))


def rule_of(place: Column) -> Column:
    """Struct of rule_id, category, confidence and source for a place; behind the last rule stands OTHER, for review."""
    named = [result(rule_id, category, rules.RULE_CONFIDENCE, "rule", False) for rule_id, category, _, _ in rule_index()[0]]
    return F.get(F.array(*named, result("DEFAULT_OTHER", "OTHER", 1.0, "other", True)), place)


#: Different texts whose rules may be broadcast, about 100 characters each; beyond, the join shuffles.
BROADCAST_TEXTS = 50_000
#: How payments of no category are marked, by code and by label.
OTHER = ["OTHER", "Прочее"]
NEW = {"transaction_category": "category", "category_confidence": "confidence", "category_source": "source", "category_rule_id": "rule_id", "needs_review": "needs_review"}


def classify_rules(df: DataFrame) -> DataFrame:
    code = F.col("purpose_code") if "purpose_code" in df.columns else F.lit("")
    return _with_rule(df, code).withColumns({k: F.col(f"_r.{v}") for k, v in NEW.items()}).drop("_r")


def _with_rule(df: DataFrame, code: Column) -> DataFrame:
    """Each different text is cleaned and meets its rules once, however many payments have it; cleaned texts are stored with their candidates."""
    keys = {"_purpose": F.col("purpose_text"), "_code": F.coalesce(code, F.lit("")), "_type": F.col("operation_type_raw")}
    rows = df.withColumns(keys)
    texts = rows.select(*keys).distinct().withColumn("_text", rule_text(F.col("_purpose"), F.col("_code"), F.col("_type")))
    texts = cut(texts.withColumn("_rules", rule_candidates(F.col("_text"))))
    size = texts.agg(F.count("*"), F.coalesce(F.sum(sum((F.coalesce(F.length(k), F.lit(0)) for k in keys), F.lit(0))), F.lit(0))).first()
    raw = F.concat_ws(" | ", "_purpose", "_type").rlike(rx(rules.RECYCLER))
    place = F.when(raw, -1).otherwise(rule_place(F.col("_text"), F.col("_rules")))
    ruled = texts.select(*(F.col(k).alias(f"{k}2") for k in keys), place.alias("_place"))
    ruled = F.broadcast(ruled) if size[0] <= BROADCAST_TEXTS and size[1] <= 100 * BROADCAST_TEXTS else ruled
    same = [F.col(k).eqNullSafe(F.col(f"{k}2")) for k in keys]
    found = F.when(F.col("_place") < 0, recycled()).otherwise(rule_of(F.col("_place")))
    return rows.join(ruled, same).withColumn("_r", found).drop("_place", *keys, *(f"{k}2" for k in keys))


def classify_vectors(df: DataFrame, label_vectors: DataFrame, accept: float = 0.35, review: float = 0.55) -> DataFrame:
    """Rows without a rule take the label of the best cosine from `accept` on; under `review` it is marked for review."""
    best = vectors.best_match(df.filter((F.col("category_source") == "other") & F.col("semantic_embedding").isNotNull()).select("tx_id", F.col("semantic_embedding").alias("embedding")), "tx_id", label_vectors, "label").filter(F.col("score") >= accept)
    out = df.join(best.select("tx_id", F.col("label").alias("_label"), F.col("score").alias("_score")), "tx_id", "left")
    hit = F.col("_label").isNotNull()
    return out.withColumns({"transaction_category": F.when(hit, F.col("_label")).otherwise(F.col("transaction_category")), "category_confidence": F.when(hit, F.round("_score", 4)).otherwise(F.col("category_confidence")), "category_source": F.when(hit, "vector").otherwise(F.col("category_source")), "needs_review": F.when(hit, F.col("_score") < review).otherwise(F.col("needs_review"))}).drop("_label", "_score")


def reclassify(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs the rules again where the category is missing or OTHER; other rows stay as they are.

    With a limit, the first such payments by tx_id are taken and the rest stay too. The result is a batch that
    sinks.upsert_ledger writes back.
    """
    again = F.coalesce(F.col("transaction_category").isNull() | F.col("transaction_category").isin(OTHER) | (F.col("category_source") == "other"), F.lit(True))
    code = F.col("purpose_code") if "purpose_code" in df.columns else F.lit("")
    tagged = df.withColumn("_a", again)
    if limit is not None:
        chosen = df.filter(again).select("tx_id").orderBy("tx_id").limit(limit).withColumn("_taken", F.lit(True))
        tagged = tagged.join(chosen, "tx_id", "left").withColumn("_a", F.col("_taken").isNotNull()).drop("_taken")
    return _with_rule(tagged, code).withColumns({k: F.when(F.col("_a"), F.col(f"_r.{v}")).otherwise(F.col(k)) for k, v in NEW.items()}).drop("_a", "_r")


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("category_source").agg(F.count("*").alias("n")).orderBy("category_source")


def tag_questions(df: DataFrame, text: str = "question") -> DataFrame:
    """Structured filters of questions: amount and its operator, dates, direction, currency, bank, top N, topic."""
    q = F.trim(text)
    amounts = F.regexp_extract_all(q, F.lit(rx(r"(\d[\d\s]*(?:млн|миллион|тыс|тысяч|k|m|million)?)")), F.lit(1))
    amount = F.get(F.filter(amounts, lambda x: ~F.trim(x).rlike(r"^20\d{2}$")), F.lit(0))
    value = F.regexp_replace(F.regexp_extract(amount, r"(?U)^(\d[\d\s]*)", 1), r"(?U)\s", "").try_cast("double")
    suffix = F.lower(F.regexp_extract(amount, r"(?U)([^\d\s]+)$", 1))
    value = F.when(suffix.isin("млн", "миллион", "m", "million"), value * 1e6).when(suffix.isin("тыс", "тысяч", "k"), value * 1e3).otherwise(value)
    explicit = q.rlike(rx(rules.AMOUNT_WORDS)) & (value >= 1000)
    large = q.rlike(rx(rules.LARGE_WORDS))
    op = F.when(q.rlike(rx(rules.LESS_WORDS)), "<").when(q.rlike(rx(rules.EQUAL_WORDS)), "=").otherwise(">")
    stems = "|".join(s for s, _ in rules.MONTHS)
    dated = rx(rf"\b({stems})\w*\s+(\d{{4}})\b")
    stem, year_of = F.lower(F.regexp_extract(q, dated, 1)), F.regexp_extract(q, dated, 2).try_cast("int")
    month = F.element_at(F.create_map(*(F.lit(x) for kv in rules.MONTHS for x in kv)), F.nullif(stem, F.lit("")))
    year = F.when(q.rlike(rx(r"(за|в|during|for)\s+20\d{2}")), F.regexp_extract(q, r"\b(20\d{2})\b", 1).try_cast("int"))
    start = F.when(month.isNotNull(), F.make_date(year_of, month, F.lit(1))).otherwise(F.make_date(year, F.lit(1), F.lit(1)))
    end = F.when(month.isNotNull(), F.last_day(F.make_date(year_of, month, F.lit(1)))).otherwise(F.make_date(year, F.lit(12), F.lit(31)))
    money = F.upper(F.regexp_extract(q, rx(r"\b(KZT|USD|EUR|RUB|CNY|тенге|доллар|евро|рубл)\b"), 1))
    currency = F.coalesce(F.element_at(F.create_map(*map(F.lit, ("ТЕНГЕ", "KZT", "ДОЛЛАР", "USD", "ЕВРО", "EUR", "РУБЛ", "RUB"))), F.nullif(money, F.lit(""))), F.nullif(money, F.lit("")))
    top = rx(r"\bтоп[\s-]?(\d+)\b|\b(\d+)\s+(?:топ|лучш|крупнейш)")
    top_n = F.coalesce(*(F.nullif(F.regexp_extract(q, top, k), F.lit("")).try_cast("int") for k in (1, 2)))
    direction = F.when(q.rlike(rx(rules.IN_WORDS)), "credit").when(q.rlike(rx(rules.OUT_WORDS)), "debit")
    return df.select(
        "*", F.when(explicit, value).when(large, 1e6).alias("amount_kzt"), F.when(explicit, op).when(large, ">").alias("amount_op"), start.alias("date_from"), end.alias("date_to"),
        direction.alias("direction"), currency.alias("currency"), first_match(q, rules.BANKS).alias("source_bank"), top_n.alias("top_n"), first_match(q, rules.TOPICS).alias("topic"),
    )


#: Bits of a row of the table of common subsequences that one number holds.
_BITS = 62


def lcs_length(pattern: Column, text: Column) -> Column:
    """Length in characters of the longest common subsequence.

    The row of the dynamic programme is kept as bits, one a character of the pattern and 0 where the length grows; a
    character of the text moves the whole row on by an addition with carry, in numbers of 62 bits.
    """
    full = (1 << _BITS) - 1
    letters = F.filter(F.split(pattern, ""), lambda c: c != "")
    words = F.ceil(F.size(letters) / _BITS).cast("int")

    def where(letter: Column, word: Column) -> Column:
        """The places of a character in one number's part of the pattern, as bits."""
        own = F.slice(letters, word * _BITS + 1, F.lit(_BITS))
        hits = F.filter(F.transform(own, lambda c, i: F.when(c == letter, F.call_function("shiftleft", F.lit(1).cast("long"), i))), lambda x: x.isNotNull())
        return F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    def move(row: Column, letter: Column) -> Column:
        def one(state: Column, at: Column) -> Column:
            v = F.get(row, at)
            hit = v.bitwiseAND(where(letter, at))
            total = v + hit + state["carry"]
            new = total.bitwiseAND(F.lit(full)).bitwiseOR(v - hit)
            return F.struct(F.array_append(state["row"], new).alias("row"), F.call_function("shiftrightunsigned", total, F.lit(_BITS)).alias("carry"))

        start = F.struct(F.array().cast("array<long>").alias("row"), F.lit(0).cast("long").alias("carry"))
        return F.aggregate(F.sequence(F.lit(0), words - 1), start, one, lambda s: s["row"])

    first = F.array_repeat(F.lit(full), words)
    last = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), first, move)
    ones = F.aggregate(last, F.lit(0), lambda n, v: n + F.bit_count(v))
    return F.when((F.length(pattern) == 0) | (F.length(text) == 0), 0).otherwise(words * _BITS - ones)


def word_set(c: Column) -> Column:
    """The different words between white space, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")))


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: the best of the three similarities among the shared words, those with a's own and those with b's own.

    A similarity is 100 less the share of characters to insert or delete. Texts without words have 0, one word set within
    the other has 100.
    """
    x, y = word_set(a), word_set(b)
    both, own_x, own_y = F.array_intersect(x, y), F.array_join(F.array_except(x, y), " "), F.array_join(F.array_except(y, x), " ")
    shared, n, m = F.length(F.array_join(both, " ")), F.length(own_x), F.length(own_y)
    gap = F.when(shared > 0, 1).otherwise(0)
    near = lambda steps, total: 100 - 100 * steps / total
    longer = near(n + m - 2 * lcs_length(own_y, own_x), 2 * (shared + gap) + n + m)
    mixed = F.greatest(longer, near(gap + n, 2 * shared + gap + n), near(gap + m, 2 * shared + gap + m))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when((shared > 0) & ((n == 0) | (m == 0)), 100.0).when(shared > 0, mixed).otherwise(longer)


def _pieces(words: Column) -> Column:
    """Words, marked by a blank before, and the pairs of neighbouring characters of the words joined by blanks."""
    whole = F.array_join(words, " ")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - 1, F.lit(1))), lambda i: F.substring(whole, i, F.lit(2)))
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("\n"), w)), F.filter(pairs, lambda p: F.length(p) == 2)))


def map_headers(headers: DataFrame, header_vectors: DataFrame | None = None, canonical_vectors: DataFrame | None = None, fuzzy: float = 92, similar: float = 0.85) -> DataFrame:
    """header -> canonical column and how it was found: exact dictionary, fuzzy words, then vectors.

    A header is compared with names of the dictionary that share a word with it, or so many pairs of characters that
    the ratio can be reached: an inserted or deleted character costs two pairs at most. From 87.5 on none is missed;
    lower ratios are refused. Of equal ratios the name that stands first in the dictionary counts.
    """
    if fuzzy < 87.5:
        raise ValueError("headers are compared by shared words and pairs of characters, which needs a ratio of 87.5 or more")
    spark = headers.sparkSession
    book = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rules.HEADERS.items())], "known string, canonical string, place int")
    named = headers.select("header").distinct().withColumn("norm", norm_text(F.col("header")))
    exact = named.join(F.broadcast(book), F.col("norm") == F.col("known")).select("header", "canonical", F.lit("exact").alias("method"), F.lit(1.0).alias("score"))
    rest = named.join(exact.select("header"), "header", "left_anti")
    entries = book.withColumn("pieces", _pieces(word_set(F.col("known"))))
    entries = entries.select("known", "canonical", "place", F.explode("pieces").alias("piece"))  # the fixed dictionary
    asked = rest.withColumn("pieces", _pieces(word_set(F.col("norm")))).select("header", "norm", F.explode("pieces").alias("piece"))
    met = asked.join(F.broadcast(entries), "piece").groupBy("header", "norm", "known", "canonical", "place").agg(
        F.count_if(F.col("piece").startswith("\n")).alias("words"), F.count_if(~F.col("piece").startswith("\n")).alias("pairs")
    )
    steps = F.floor((F.length("norm") + F.length("known")) * (100 - fuzzy) / 100)
    pairs_of = lambda c: F.size(F.filter(_pieces(word_set(F.col(c))), lambda p: ~F.startswith(p, F.lit("\n"))))
    can = (F.col("words") > 0) | (F.col("pairs") >= F.greatest(pairs_of("norm"), pairs_of("known")) - 2 * steps)
    scored = met.filter(can).withColumn("score", token_set_ratio(F.col("norm"), F.col("known"))).filter(F.col("score") >= fuzzy)
    close = scored.groupBy("header").agg(F.max_by("canonical", F.struct("score", -F.col("place"))).alias("canonical"), F.lit("fuzzy").alias("method"), (F.max("score") / 100).alias("score"))
    out = exact.unionByName(close)
    if header_vectors is not None:
        left = header_vectors.join(rest.select("header"), "header", "left_semi").join(close.select("header"), "header", "left_anti")
        near = vectors.best_match(left, "header", canonical_vectors, "canonical").filter(F.col("score") >= similar)
        out = out.unionByName(near.select("header", "canonical", F.lit("vector").alias("method"), "score"))
    return out


def adapter_choice(rows_by_layout: DataFrame) -> DataFrame:
    """Of the layouts that gave rows for a file, the one with the least priority: (file_id, layout, priority, rows)."""
    w = Window.partitionBy("file_id").orderBy("priority", "layout")
    return rows_by_layout.filter("rows > 0").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def is_header(joined: Column, keywords: list[str], least: int) -> Column:
    hits = None
    for k in keywords:
        one = F.when(joined.contains(k), 1).otherwise(0)
        hits = one if hits is None else hits + one
    return hits >= least


__all__ = ["adapter_choice", "any_of", "classify_rules", "classify_vectors", "is_header", "map_headers", "reclassify", "rule_of", "source_counts", "tag_questions"]
