"""Main text of web pages as the maximum-scoring run of words and tags.

A page is a sequence of words, which score positive, and tags, which score negative; a
linear scan finds the contiguous run with the largest sum, and that run is the content
region. The weights come from labelled pages: those whose markup names the content
(article, main) tell how often each tag and how many words stand inside and outside. A
bounded sample of them (``sample`` in expectation, by a hash of the page) is enough for
this table of HTML's elements (all others count together); every page is then read whole, without a shuffle.

Elements that are never content (menus, footers, forms, adverts, comments ...) do not
count as words and leave no text, wherever they stand.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrisk.llm.common import small_batches

# Element names and name parts of HTML.
DROPPED = set("head title script style noscript template svg canvas iframe object nav header footer aside form button select textarea dialog menu".split())
DROPPED_WORDS = set("ad ads advert adverts advertisement sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar side-bar cookie cookies consent notice notices newsletter subscribe popup modal social share sharing related recommended comment comments disqus respond reply replies widget login signup".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog".split())
CONTENT = {"article", "main"}
BLOCKS = set("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: The elements of HTML; pages' own elements count together, under one name.
ELEMENTS = DROPPED | BLOCKS | set("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strong sub sup time tt u var video audio picture source br hr col colgroup wbr input link meta base".split())
OWN = "own"
VOID = set("area base br col embed hr img input link meta source track wbr".split())

#: Elements whose content is text up to their own end tag.
RAW = set("script style noscript template textarea title iframe".split())
# An opening tag ends these open elements, up to the elements that hold them.
_ITEMS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS_P = BLOCKS - {"li", "dd", "dt", "tr", "td", "th", "html", "body", "caption", "legend", "summary", "tbody", "tfoot", "thead", "figcaption"} | {"nav", "header", "footer", "aside", "form", "menu"}
_HOLDS_P = BLOCKS - {"p"} | {"nav", "header", "footer", "aside", "form"}

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_PLAIN = re.compile("[^>\"']*")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Parts of names that say something about an element's surroundings, and those of content.
_ABOUT = {"has", "with", "no", "without", "is", "js", "not", "hide", "show"}
_OF_CONTENT = {"article", "post", "entry", "story", "content", "text"}


def _named_away(value: str) -> bool:
    """Whether a class or id names something that is never content."""
    for name in value.split():
        parts = _SPLIT.split(_CAMEL.sub("-", name).lower())
        found = DROPPED_WORDS.intersection(parts)
        if found and parts[0] not in _ABOUT and not (found == {"header"} and _OF_CONTENT.intersection(parts)):
            return True
    return False


def _never_content(name: str, attributes: str, inside: bool) -> bool:
    if name in DROPPED:
        return not (name == "header" and inside)
    if attributes and name not in CONTENT and name not in ("html", "body"):
        for key, *value in _ATTRIBUTE.findall(attributes):
            value = "".join(value)
            if DROPPED_ROLES.intersection(value.lower().split()) if key.lower() == "role" else _named_away(value):
                return True
    return False


def _tags(page: str):
    """(start, end, name, closes, attributes) of every piece of markup; comments and the like
    have no name, raw elements end with their end tag. One pass: what has not been found
    once up to the end is not looked for again."""
    missing: set[str] = set()

    def find(what: str, at: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, at)
        if found < 0:
            missing.add(what)
        return found

    at = 0
    while (start := page.find("<", at)) >= 0:
        head = page[start + 1 : start + 2]
        closes = head == "/"
        if head in ("!", "?"):
            opening = next((o for o in ("<!--", "<![CDATA[") if page.startswith(o, start)), None)
            ending = {"<!--": "-->", "<![CDATA[": "]]>", None: ">"}[opening]
            end = find(ending, start + len(opening or "<!"))
            at = len(page) if end < 0 else end + len(ending)
            yield start, at, None, False, ""
            continue
        m = _NAME.match(page, start + 1 + closes)
        if not m:
            at = start + 1
            continue
        name, end = m[0].lower(), m.end()
        while True:
            end = _PLAIN.match(page, end).end()
            if end >= len(page) or page[end] == ">":
                break
            after = find(page[end], end + 1)
            end = end + 1 if after < 0 else after + 1
        attributes = page[m.end() : end]
        at = min(len(page), end + 1)
        if name in RAW and not closes and not attributes.endswith("/"):
            if f"</{name}" in missing:
                at = len(page)
            else:
                # the end tag's name first, then once the end of that tag
                stop = re.compile(f"</{name}", re.I).search(page, at)
                end = find(">", stop.end()) if stop else -1
                if end < 0:
                    missing.add(f"</{name}")
                at = end + 1 if end >= 0 else len(page)
        yield start, at, name, closes, attributes


def events(page: str):
    """(kind, value, inside) in page order: kind 'text' with text, or 'tag' with a name and
    a leading slash when it closes, or 'gap'; inside tells whether a content element is open.
    Dropped elements give one 'gap' event and nothing of what they hold. End tags may be
    left out where HTML allows it."""
    stack: list[tuple[str, bool]] = []
    opened: dict[str, list[int]] = defaultdict(list)  # depths of each name's open elements
    dropped = inside = 0
    at = 0

    def close(depth: int) -> None:
        nonlocal dropped, inside
        while len(stack) > depth:
            name, drop = stack.pop()
            opened[name].pop()
            dropped -= drop
            inside -= name in CONTENT

    def ended(names: set[str], within: set[str]) -> None:
        """Closes the outermost open element of the names that is further in than any of ``within``."""
        if not any(opened[n] for n in names):
            return
        holder = max((opened[n][-1] for n in within if opened[n]), default=-1)
        first = [opened[n][i] for n in names if (i := bisect_right(opened[n], holder)) < len(opened[n])]
        if first:
            close(min(first))

    for start, end, name, closes, attributes in _tags(page):
        if not dropped and start > at:
            yield "text", page[at:start], inside > 0
        at = end
        if name is None:
            continue
        if name in RAW and not closes:
            if not dropped:
                yield "gap", name, inside > 0
            continue
        if closes:
            gap = False
            if opened[name]:
                i = opened[name][-1]
                gap = stack[i][1]
                close(i)
            if not dropped and not gap:
                yield "tag", "/" + name, inside > 0
            continue
        if name in _ITEMS:
            ended(*_ITEMS[name])
        elif name in _ENDS_P:
            ended({"p"}, _HOLDS_P)
        drop = _never_content(name, attributes, inside > 0)
        if not dropped:
            yield "gap" if drop else "tag", name, inside > 0
        if name not in VOID and not attributes.endswith("/"):
            opened[name].append(len(stack))
            stack.append((name, drop))
            dropped += drop
            inside += name in CONTENT
    if not dropped and at < len(page):
        yield "text", page[at:], inside > 0


#: What every tag costs at least; tags that are more usual outside content cost more.
LEAST = -0.2
DEFAULT = {"": 1.0} | {slash + t: LEAST for t in "p b i em strong a br h1 h2 h3 h4 h5 h6 li ul ol span code pre blockquote".split() for slash in ("", "/")}


def train(pages: DataFrame, *, sample: int = 2000) -> dict[str, float]:
    """The score of a word under '' and of each tag under its name; pages without a content
    element teach nothing, and without any such page the default weights hold."""
    small_batches(pages.sparkSession, 128)
    labelled = pages.filter(F.lower("html").rlike("<(article|main)[ >]")).select("url", "html")
    n = labelled.count()
    if not n:
        return DEFAULT
    share = min(1.0, sample / n)

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(1).to_pylist():
                for kind, value, inside in events(page):
                    if kind == "gap":
                        continue
                    tag = "" if kind != "tag" else value if value.lstrip("/") in ELEMENTS else OWN
                    total[tag, inside] += 1 if kind == "tag" else len(value.split())
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["tag", "inside", "n"])

    drawn = labelled.filter(F.xxhash64("url", "html").cast("double") / 2.0**64 + 0.5 < share)
    rows = drawn.mapInArrow(count, "tag string, inside boolean, n long").groupBy("tag", "inside").agg(F.sum("n").alias("n")).collect()
    n = {(r["tag"], r["inside"]): r["n"] for r in rows}
    total = {s: sum(v for k, v in n.items() if k[1] == s) + 1 for s in (True, False)}
    odds = lambda tag: math.log((n.get((tag, True), 0) + 1) / total[True] * total[False] / (n.get((tag, False), 0) + 1))
    return {"": min(3.0, max(0.2, odds("")))} | {t: LEAST - max(0.0, -odds(t)) for t, _ in n if t}


def main_text(page: str, weights: dict[str, float]) -> str:
    """The content region's blocks, joined by blank lines."""
    items = list(events(page))
    word = weights[""]
    cost = lambda tag: weights.get(tag if tag.lstrip("/") in ELEMENTS else OWN, -1.0)
    best, span, run, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, value, _) in enumerate(items):
        run += word * len(value.split()) if kind == "text" else LEAST if kind == "gap" else cost(value)
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, span = run, (start, i + 1)
    # a short block at either end may not pay for its tags: go on over what is usual inside
    low, high = span
    plain = lambda i: items[i][0] != "tag" or cost(items[i][1]) == LEAST
    while high > low > 0 and plain(low - 1):
        low -= 1
    while high > low and high < len(items) and plain(high):
        high += 1
    blocks: list[list[str]] = [[]]
    for kind, value, _ in items[low:high]:
        if kind == "text":
            blocks[-1].append(value)
        elif kind == "gap" or value.lstrip("/") in BLOCKS:
            blocks.append([])
        elif value == "br":
            blocks[-1].append(" ")
    out = (" ".join(html_lib.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(b for b in out if b)


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row. A null page is empty and has no text; a
    null page_id or url stays null, repeated rows repeat, other columns are ignored."""
    small_batches(pages.sparkSession, 128)

    def run(batches):
        for batch in batches:
            texts = [main_text(p or "", weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
