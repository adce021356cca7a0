"""Text expressions: cleaning, repair, normal forms, categories."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing value, and tax ids that stand for an unknown one.
NULL_WORDS = ["nan", "none", "null", "nat", "<na>", "n/a"]
UNKNOWN_IDS = ["", "0", "000000000000"]
MONTHS = ["Январь", "Февраль", "Март", "Апрель", "Май", "Июнь", "Июль", "Август", "Сентябрь", "Октябрь", "Ноябрь", "Декабрь"]
#: Words that mark total and balance rows of a statement.
SERVICE_WORDS = ["итого", "сальдо", "остаток", "итоговая сумма", "начальный баланс", "конечный баланс", "входящий остаток", "исходящий остаток"]


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 or Windows-1251, read again; other text is untouched.

    Needs spark.sql.legacy.javaCharsets and spark.sql.legacy.codingErrorAction (see plans.runtime.configure).
    """
    for charset, hints in (("ISO-8859-1", "[ÐÑÒÂ]"), ("windows-1251", "[РСЃЋ]")):
        raw = F.encode(c, charset)
        lossless = F.decode(raw, charset) == c
        c = F.when(c.rlike(hints) & lossless & F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(c)
    return c


def clean_optional_text(c: Column) -> Column:
    t = F.trim(c)
    return F.when((t != "") & ~F.lower(t).isin(NULL_WORDS), t)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) for a use that names c several times; c is worked out once a row."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


#: Fixed value: words one of which every service word holds.
SERVICE_MARKS = ["итого", "сальдо", "остаток", "баланс"]
#: Fixed value: letters, digits and spaces that norm_text leaves alone, unless two spaces meet; a quick look that most texts pass.
_PLAIN = r"\A[0-9a-zа-яё№.,() ]*\z"
#: Fixed value: finds whatever norm_text changes in a trimmed text of lower case.
_UNTIDY = r"(?U)[\u00a0–—“”\"']|\s\s|[^\S ]|\s[/:]|[/:]\s|^[\s\-]|[\s\-]$"


def norm_text(c: Column) -> Column:
    """Lower case, plain spaces and dashes, no quotes, tight around / and :. Tidy texts, which most are, take one look."""

    def tidied(t: Column) -> Column:
        plain = F.regexp_replace(F.translate(t, "\u00a0–—", " --"), r"(?U)\s+", " ")
        plain = F.regexp_replace(F.regexp_replace(plain, "[“”\"']", ""), r"\s*([/:])\s*", "$1")
        return F.when(t.rlike(_PLAIN) & ~t.contains("  "), t).when(t.rlike(_UNTIDY), F.regexp_replace(plain, r"^[ \t\r\n\-—]+|[ \t\r\n\-—]+$", "")).otherwise(t)

    return once(F.lower(F.coalesce(clean_optional_text(c), F.lit(""))), tidied)


def norm_account(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[ \-/]", "")


def norm_iin(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\p{Alnum}]", ""))


def norm_name(c: Column) -> Column:
    t = F.lower(F.coalesce(clean_optional_text(c), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "^[\"']+|[\"']+$", ""), r"(?U)\s+", " "))


def is_unknown_name(c: Column) -> Column:
    t = clean_optional_text(c)
    return t.isNull() | (F.upper(t) == "UNKNOWN")


def is_unknown_iin(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).isin(UNKNOWN_IDS)


def display_name(name: Column, account: Column) -> Column:
    return F.when(is_unknown_name(name), F.trim(account)).otherwise(F.trim(name))


def truncate(c: Column, limit: int) -> Column:
    return F.when(F.length(c) <= limit, F.when(c == "", "—").otherwise(c)).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…")))


def format_money(c: Column) -> Column:
    return F.concat(F.replace(F.format_number(c, 0), F.lit(","), F.lit(" ")), F.lit(" KZT"))


def format_percent(c: Column) -> Column:
    return F.concat(F.format_number(c * 100, 0), F.lit("%"))


def format_dt(ts: Column, day: Column) -> Column:
    """Time of a payment to the minute, else its day, else that it has none."""
    return F.coalesce(F.date_format(ts, "dd.MM.yyyy HH:mm"), F.date_format(day, "dd.MM.yyyy"), F.lit("Без даты"))


def month_label(ts: Column) -> Column:
    names = F.array(*map(F.lit, MONTHS))
    return F.concat_ws(" ", F.element_at(names, F.month(ts)), F.year(ts).cast("string"))


def semantic_text(*parts: Column) -> Column:
    """Non-empty parts joined by a bar; null if there are none."""
    joined = F.concat_ws(" | ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))
    return F.nullif(joined, F.lit(""))


def is_service_row(*values: Column) -> Column:
    """Blank rows, total and balance rows, and rows of at least three numbers only.

    Other rows hold letters, and no word that marks totals or stands for nothing, so they are told without normal forms.
    """
    plain = F.translate(F.lower(F.concat_ws(" ", *values)), "“”\"'", "")
    may = once(plain, lambda t: ~t.rlike(r"\p{L}") | t.rlike("|".join([*SERVICE_MARKS, *NULL_WORDS])))
    joined = F.trim(F.concat_ws(" ", *(F.nullif(norm_text(v), F.lit("")) for v in values)))
    return F.when(may, once(joined, lambda t: (t == "") | t.rlike("|".join(SERVICE_WORDS)) | t.rlike(r"^(\d+\s*){3,}$"))).otherwise(False)


def reference_tokens(*texts: Column) -> Column:
    """Distinct upper-case references: what follows a number sign, and ESF numbers."""
    t = F.upper(F.concat_ws("\x01", *texts))
    marked = F.regexp_extract_all(t, F.lit(r"№\s*([A-ZА-Я0-9/_-]{3,})"), F.lit(1))
    esf = F.regexp_extract_all(t, F.lit(r"(ESF[-A-Z0-9_]+)"), F.lit(1))
    return F.array_distinct(F.concat(marked, esf))


def text_match(c: Column, query: str, wild: bool = False) -> Column:
    """Case-insensitive contains, also of the garbled form of the query; wild keeps % and _ as patterns."""
    forms = {query.strip()}
    try:
        forms.add(query.strip().encode().decode("cp1251"))
    except UnicodeDecodeError:
        pass
    if wild:
        return any_of(*(c.ilike(f"%{q}%") for q in sorted(forms)))
    return any_of(*(F.lower(c).contains(q.lower()) for q in sorted(forms)))


#: Categories by what purpose or operation type contain, in order.
CATEGORY_BY_PURPOSE = [
    (["red.kz", "продаж"], "Продажи Kaspi / Red"),
    (["погаш", "кредит"], "Погашение кредита"),
    (["снятие", "cash", "atm"], "Снятие наличных"),
    (["ресайклер", "recycler"], "Пополнение наличными"),
    (["пополн", "взнос", "deposit"], "Пополнение счёта"),
    (["рассроч"], "Рассрочка Kaspi"),
    (["займ"], "Выдача займа"),
]


def derived_category(category: Column, legacy: Column, purpose: Column, op_type: Column, direction: Column) -> Column:
    p, t, d = (F.lower(F.coalesce(c, F.lit(""))) for c in (purpose, op_type, direction))
    out = None
    for words, name in CATEGORY_BY_PURPOSE:
        hit = any_of(*(p.contains(w) for w in words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    out = out.when(p.contains("перевод") & p.contains("внутр"), "Внутренние операции").when(p.contains("перевод") | t.contains("payment"), "P2P перевод")
    out = out.when(p.contains("оплат"), "Оплата услуг").when(d == "credit", "Поступления").when(d == "debit", "Расходы").otherwise("Прочее")
    return F.coalesce(F.nullif(F.trim(category), F.lit("")), F.nullif(F.trim(legacy), F.lit("")), out)


#: What a purpose cleaner removes.
NOISE = "|".join(
    [
        r"\b\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}\b",
        r"\bKZ[A-Z0-9]{16,}\b",
        r"\b\d{12}\b",
        r"\b[RDLN]\d{5,}\b",
        r"[№#]\s*\S+",
        r"\b\d{6,}\b",
        r"через\s+интернет[- ]отделение",
        r"через\s+мобильн\w*\s+прилож\w*",
        r"без\s+ндс",
        r"за\s+\d{1,2}/\d{1,2}/\d{4}",
        r"\([^)]{1,60}\)",
        r"\bАРН\b[:\s]*\S*",
        r"\bРРН\b[:\s]*\S*",
    ]
)


def clean_purpose(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), f"(?iuU)(?:{NOISE})", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s{2,}", " "))
