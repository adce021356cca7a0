"""Main text of web pages from flat text blocks and a decision tree.

A page is cut at block-level tags into flat text blocks, in page order. Each block has its word count and link
density, those of the blocks before and after it, and what its enclosing elements say (navigation, footer,
aside, form, article, names of classes and ids). A decision tree trained on the small labelled table below
tells main text from the rest; it is trained by Spark on every use and then walked inside the tasks.

What elements say: html and body say nothing, and names such as no-sidebar or has-sidebar neither. A wrapper, which
holds over half of the page's words, says nothing of them by a part of a name (fixed-header), by being a form, or
where most of its words are in an element within that names itself the body; comments stay comments. article and main
begin anew, unless they stand in a nav, header, aside or footer, or among comments, or are comments themselves.

Defined cases: null and empty html give an empty text; unclosed and unknown tags, lone `<` and truncated
references are taken as browsers do; scripts, styles, comments, titles and form controls hold no text; null
page_id and url are kept; equal rows count each; an empty table gives no rows; other columns are ignored. Time is
linear in the page's length, however deep its elements are.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Fixed values of HTML: elements that break text blocks, that never close, and whose content is no text.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea select button iframe object svg math title head canvas audio video".split())
#: Words in names of elements, classes, ids and roles, by what they say of a block.
MENU = frozenset("nav menu navbar navigation breadcrumb breadcrumbs header masthead toolbar tabs pagination pager footer colophon copyright contentinfo".split())
SIDE = frozenset("aside sidebar related widget ad ads advert advertisement adsense banner promo sponsor sponsored cookie cookies consent notice notices alert popup modal newsletter subscribe share social complementary".split())
COMMENTS = frozenset("comment comments respond replies disqus".split())
TALK = COMMENTS | frozenset("form login signup search".split())
BODY = frozenset("article main post content entry story body-text".split())
#: Elements that an article inside them does not leave, and first parts of names that speak of the layout only.
FIRM = frozenset("nav header aside footer".split())
LAYOUT = frozenset("no has with without is not hide show".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"[\s ]+")
_END = {x: re.compile(rf"</{x}\b[^>]*>?", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "menu", "side", "talk", "body", "loose")


class _Says(NamedTuple):
    """An element that says something: its parent among such, itself by tag, whole names and parts of names."""

    parent: int
    tag: str
    whole: tuple[int, int, int, int]
    parts: tuple[int, int, int, int]
    comments: bool  # by a whole name


class _Inside(NamedTuple):
    """Where text stands: the nearest element that says something, and whether it is silent or linked."""

    says: int = 0
    silent: bool = False
    linked: bool = False


def _within(outer: _Inside, tag: str, attributes: str, said: list[_Says]) -> _Inside:
    """What holds inside this element."""
    outer = outer._replace(silent=outer.silent or tag in SILENT, linked=outer.linked or tag == "a")
    if tag in ("html", "body") or (tag not in BLOCKS and not attributes):
        return outer
    names = [name for m in _NAMED.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").lower().split()]
    split = {x for parts in (re.split(r"[-_]", name) for name in names) if parts[0] not in LAYOUT for x in parts} - set(names)
    whole, parts = (tuple(int(not found.isdisjoint(x)) for x in (MENU, SIDE, TALK, BODY)) for found in ({tag, *names}, split))
    if not any(whole) and not any(parts):
        return outer
    said.append(_Says(outer.says, tag, whole, parts, not COMMENTS.isdisjoint(names)))
    return outer._replace(says=len(said) - 1)


def _flags(said: list[_Says], words: list[int]) -> list[tuple[int, int, int, int]]:
    """Menu, side, talk and body of the text right within each element; words are those right within."""
    total, held, body = sum(words), list(words), [0] * len(words)
    for i in range(len(said) - 1, 0, -1):
        x = said[i]
        held[x.parent] += held[i]
        bad = any(x.whole[:3]) or any(x.parts[:3])
        if not bad:
            body[x.parent] = max(body[x.parent], body[i], held[i] if x.whole[3] or x.parts[3] else 0)
    flags, firm = [(0, 0, 0, 0)] * len(said), [False] * len(said)
    for i in range(1, len(said)):
        x, outer = said[i], flags[said[i].parent]
        firm[i] = firm[x.parent] or x.tag in FIRM
        wraps = 2 * held[i] > total and x.tag not in FIRM
        around = wraps and 2 * body[i] > held[i]  # most of it is in a named body
        menu, side, talk, own = x.whole
        if around or (wraps and x.tag == "form" and not x.comments):
            menu, side, talk = 0, 0, int(x.comments)
        if not wraps:
            menu, side = menu | x.parts[0], side | x.parts[1]
        if not around:
            talk |= x.parts[2] if x.tag != "form" or not wraps else 0
        if x.tag in ("article", "main"):
            kept = outer if firm[x.parent] else (0, 0, outer[2], 0)
            flags[i] = (kept[0], kept[1], max(kept[2], x.whole[2], 0 if wraps else x.parts[2]), 1)
        else:
            flags[i] = tuple(map(max, outer, (menu, side, talk, own | x.parts[3])))
    return flags


def blocks(page: str) -> list[list]:
    """[text, words, share of words in links, menu, side, talk, body] of each block."""
    out, parts, at = [], [], 0
    said, words = [_Says(0, "", (0, 0, 0, 0), (0, 0, 0, 0), False)], Counter()
    stack: list[tuple[str, _Inside]] = [("", _Inside())]
    open_: Counter[str] = Counter()

    def say(text: str) -> None:
        if text and not stack[-1][1].silent:
            parts.append((references.unescape(text), stack[-1][1].linked))

    def end() -> None:
        nonlocal parts
        text = _SPACE.sub(" ", "".join(x for x, _ in parts)).strip()
        if text:
            n = len(text.split(" "))
            inside = sum(len(x.split()) for x, link in parts if link)
            words[stack[-1][1].says] += n
            out.append([text, n, min(1.0, inside / n), stack[-1][1].says])
        parts = []

    def close(tag: str) -> None:
        while open_[tag]:
            name, _ = stack.pop()
            open_[name] -= 1
            if name == tag:
                break

    for m in _TOKEN.finditer(page):
        say(page[at : m.start()]) if m.start() > at else None
        if m.start() < at:
            continue  # within a script or style
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            end()
        if m[1]:
            close(tag)
        elif tag in _END:
            found = _END[tag].search(page, at)
            at = found.end() if found else len(page)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "a") and stack[-1][0] == tag:
                close(tag)  # closed by the next of its kind
            if tag == "body":
                close("head")
            stack.append((tag, _within(stack[-1][1], tag, m[3], said)))
            open_[tag] += 1
    say(page[at:]) if at < len(page) else None
    end()
    flags = _flags(said, [words[i] for i in range(len(said))])
    return [[*b[:3], *flags[b[3]]] for b in out]


def features(found: list[list]) -> list[list[float]]:
    """FEATURES of each block; page ends count as empty blocks. loose: no named body holds a fair part of the page's words."""
    free = [b for b in found if not (b[3] or b[4] or b[5])]
    named, none = sum(b[1] for b in free if b[6]) * 4 > sum(b[1] for b in free), ["", 0, 0.0]
    rows = []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        rows.append([float(b[1]), b[2], float(before[1]), before[2], float(after[1]), after[2], float(b[3]), float(b[4]), float(b[5]), float(b[6]), float(not named)])
    return rows


def labelled() -> list[tuple]:
    """The small labelled table: blocks of made-up pages, label 1 for main text.

    A page lists its blocks as (words, share in links, menu, side, talk, body, label); lengths vary by rule. Names
    decide only where there are some. Elsewhere runs of links are menus, also within an article, and short lines
    among them belong to them, while a lone link, a heading or a short paragraph beside text is main text.
    """
    rows = []
    for size in (1, 3, 8, 20, 60, 150):
        short, named, plain = max(1, size // 3), (0, 0, 0, 1), (0, 0, 0, 0)
        text = lambda n, says, links=0.0: (n, links, *says, 1)
        rest = lambda n, says, links=0.0: (n, links, *says, 0)
        story = lambda says: [text(7, says), text(size, says), text(short, says), text(size + 5, says, 0.2), text(2, says, 1.0), text(size, says), text(size + 9, says, 0.4), text(3, says), text(size + 30, says), text(3, says, 1.0), text(size, says), text(4, says), text(1, says, 1.0), text(12, says), text(6, says, 0.8), text(size + 2, says)]
        links = lambda says: [rest(n, says, share) for n, share in ((1, 1.0), (2, 1.0), (1, 1.0), (4, 0.9), (3, 1.0), (6, 1.0))]
        lines = lambda says: [rest(1, says, 1.0), rest(2, says, 1.0), rest(2, says), rest(3, says, 1.0), rest(1, says, 1.0)]
        bits = lambda says: [text(n, says) for n in (1, 12, 2, size, 2, 1, 40, 1, 1, 8, 2, 70, 3, 1)]
        menu, foot = links((1, 0, 0, 0)), [rest(short + 2, (1, 0, 0, 0)), rest(4, (1, 0, 0, 0), 0.5)]
        advert, talk = [rest(size, (0, 1, 0, 0))], [rest(size, (0, 0, 1, 0)), rest(short, (0, 0, 1, 0))]
        inner = [rest(size, (0, 1, 0, 1)), rest(size, (0, 0, 1, 1)), rest(2, (1, 0, 0, 1), 1.0)]
        beside = [rest(size, plain), rest(short, plain), rest(size + 5, plain, 0.4), rest(4, plain), rest(1, plain), rest(size + 30, plain)]
        pages = [
            [*menu, *advert, *story(named), *foot], [*menu, *story(named), *talk, *foot], [*menu, *story(named)[:2], *inner, *story(named)[2:], *foot], [*beside, *story(named), *beside], [*links(plain), *story(named), *beside],
            [*story(named)[:3], *links(named), *story(named)[1:]], [*story(named), *lines(named)], [*menu, *beside, *bits(named), *foot], [*advert, *bits(named), *beside], [*bits(plain)], [*links(plain), *bits(plain)[1:], *foot],
            [*links(plain), *story(plain), *lines(plain)], [*lines(plain), *story(plain)], [*menu, *story(plain), *advert, *foot], [text(size, plain)], [text(9, plain), text(size, plain)], [*links(plain), text(size + 5, plain), text(short + 4, plain)],
        ]
        for page in pages:
            found = [["", n, share, a, b, c, d] for n, share, a, b, c, d, _ in page]
            rows += [(*f, float(x[-1])) for f, x in zip(features(found), page, strict=True)]
    return rows


def train(spark: SparkSession) -> tuple:
    """A decision tree over the labelled table, as nested (feature, threshold, left, right) or a label."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame(labelled(), ", ".join(f"{x} double" for x in (*FEATURES, "label"))).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=8, minInstancesPerNode=2, seed=7).fit(VectorAssembler(inputCols=[*FEATURES], outputCol="features").transform(rows))

    def plain(node):
        if node.subtreeDepth() == 0:
            return node.prediction()
        return (node.split().featureIndex(), node.split().threshold(), plain(node.leftChild()), plain(node.rightChild()))

    return plain(model._java_obj.rootNode())


def classify(tree, row: list[float]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def _extract(tree):
    def run(batches):
        for batch in batches:
            texts = []
            for page in batch["html"].to_pylist():
                found = blocks(page or "")
                texts.append("\n".join(b[0] for b, row in zip(found, features(found), strict=True) if classify(tree, row)))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    common.text_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_extract(train(pages.sparkSession)), "page_id long, url string, text string, n_chars long")
