"""Main text of web pages by the line-block distribution.

Markup is stripped into lines: a line for each block of text, and blank lines where chrome (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, reader comments) was. A line weighs what text it has; the sums of weights over sliding windows
of lines are the distribution. It surges where text begins and dives where a whole window is blank; the lines between a surge and
its dive are a run, kept or left whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructType

#: Lines to a window, characters of a window where a run surges, and the least share of the heaviest run's weight.
WINDOW, SURGE, SHARE = 3, 80, 0.1

_RAW = "script|style|noscript|template|iframe|textarea|title|svg|canvas|object|select"
# Comments, elements whose content is no text, tags (a quote opens a value only after =), text. Every alternative ends at the end of the page at the latest.
_TOKEN = re.compile(rf"""<!--.*?(?:--!?>|\Z)|<({_RAW})(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)(?:>|\Z)|<[/!?][^>]*+(?:>|\Z)|[^<]++|<""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = set(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody
    td tfoot th thead tr ul""".split()
)
#: What a start tag ends if it is still open on top of the stack.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CHROME = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "search", "fieldset", "label"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert", "toolbar"}
_BOXES = {"article", "body", "center", "div", "main", "section", "td"}
#: Words of classes and ids that name chrome, and classes that only say what a page has.
_NAMES = set(
    """ad ads adsbygoogle adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promoted promotion
    sidebar rail nav navbar navigation menu submenu breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr
    notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing social comment comments
    disqus respond reply replies related recommended recommendations widget widgets toolbar pagination pager search copyright""".split()
)
#: With these beside them the names above mean parts of an article; within an article a header is its own.
_PARTS = {"work", "works", "informed", "strategy"}
_HEADERS = {"header", "masthead", "banner"}
_STATES = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|is|layout|js)[-_]\S*")
_REMARKS = {"comment", "comments", "reply", "replies", "disqus", "respond", "related", "recommended", "sponsored", "promo", "promoted", "ad", "advert", "teaser"}
_HOLDERS = {"content", "article", "main", "post", "entry", "story", "maincontent", "articlebody", "articlecontent", "postcontent", "postbody", "entrycontent", "storybody", "pagecontent", "articletext"}


@dataclass(slots=True)
class Line:
    text: str
    weight: int  # characters outside links, spaces not counted
    linked: int  # characters within links
    holders: tuple[int, ...]  # the elements open around it that may hold the article
    box: int = 0  # the nearest division around it


@dataclass(slots=True)
class _Page:
    lines: list[Line] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)  # of each holder: 3 article, 2 main, 1 by name


def _words(value: str) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", _STATES.sub(" ", value)).lower()))


def _role(name: str, attributes: str, within: bool) -> tuple[bool, int]:
    """Whether an element is chrome, and what kind of holder of an article it is (0: none)."""
    have = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes and "=" in attributes else {}
    called = f"{have.get('class', '')} {have.get('id', '')}"
    words = _words(called) if called != " " else set()
    if name == "article":
        return bool(words & _REMARKS), 3
    if name == "main" or have.get("role") == "main":
        return False, 2
    if name in ("html", "body") or (name in ("h1", "h2", "h3", "h4", "h5", "h6") and within):
        return False, 0
    if name in _CHROME or (name == "header" and not within) or have.get("role") in _ROLES:
        return True, 0
    if have.get("itemprop") == "articleBody" or any(re.sub(r"[-_]", "", c).lower() in _HOLDERS for c in called.split()):
        return False, 1
    names = _NAMES - _HEADERS if within else _NAMES
    return bool(words & names) and not words & _PARTS, 0


def page_lines(page: str, window: int = WINDOW) -> _Page:
    """The lines of a page: one for each block of text outside chrome, white space turned into one space, and a window of blank ones where chrome was."""
    out, stack, opened = _Page(), [], Counter()
    text: list[str] = []
    chrome, holders, link, box, boxes = 0, (), False, 0, 0
    weight = linked = 0

    def flush() -> None:
        nonlocal weight, linked
        if text:
            if line := " ".join("".join(text).split()):
                out.lines.append(Line(line, weight, linked, holders, box))
            text.clear()
        weight = linked = 0

    def pop(name: str) -> None:
        nonlocal chrome, holders, box
        while stack:
            top, chrome, holders, box = stack.pop()
            opened[top] -= 1
            if top == name:
                return

    for m in _TOKEN.finditer(page):
        name = m[3]
        if name is None:
            if chrome or m[1] or m[0][:2] in ("</", "<!", "<?"):
                continue
            data = html.unescape(m[0])
            text.append(data)
            n = sum(map(len, data.split()))
            weight, linked = (weight, linked + n) if link else (weight + n, linked)
            continue
        name = name.lower()
        block = name in _BLOCK
        if block and not chrome:
            flush()
        if block and name == "br":
            continue
        if m[2]:
            if name == "a":
                link = False
            if opened[name]:
                was = chrome
                pop(name)
                if was and not chrome:
                    link = False
            continue
        if name == "a" and not chrome:
            link = True
        if block:
            link = False
            ends = _ENDS.get(name)
            while stack and (stack[-1][0] == "p" or (ends and stack[-1][0] in ends)):
                pop(stack[-1][0])
        if name in _VOID:
            continue
        hidden, kind = _role(name, m[4], bool(holders)) if not chrome or name == "main" else (False, 0)
        if block or hidden or (chrome and opened[name]):
            stack.append((name, chrome, holders, box))
            opened[name] += 1
            if name in _BOXES:
                boxes += 1
                box = boxes
            if kind == 2:
                chrome = 0
            if hidden:
                flush()
                if not chrome:
                    out.lines += [Line("", 0, 0, holders)] * window
                chrome += 1
            elif kind:
                holders = (*holders, len(out.kinds))
                out.kinds.append(kind)
    flush()
    return out


def _runs(weights: list[int], window: int) -> list[tuple[int, int, int]]:
    """(surge, dive, highest window) of each run: from a line with text to where the next whole window of lines is blank."""
    padded = weights + [0] * window
    sums = [sum(padded[:window])]
    for i in range(1, len(weights) + 1):
        sums.append(sums[-1] - padded[i - 1] + (padded[i + window - 1] if i + window - 1 < len(padded) else 0))
    runs, start = [], None
    for i, w in enumerate(weights):
        if start is None and w:
            start = i
        if start is not None and not sums[i + 1]:
            runs.append((start, i + 1, max(sums[start : i + 1])))
            start = None
    return runs


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> str:
    """The article of a page: its blocks in page order, joined by a space; empty if there is none.

    Where elements say that they hold the article (article, else main, else by class or id), lines outside weigh nothing, and
    every run within is kept. Elsewhere links weigh nothing, and what is kept are the heaviest run, those with a window of surge characters and
    share of its weight, and those that lie in one division with a kept run, as what follows an advert does.
    """
    parsed = page_lines(page or "", window)
    lines = parsed.lines
    total = Counter()
    for line in lines:
        for h in line.holders:
            total[h] += line.weight + line.linked
    best = max((parsed.kinds[h] for h in total), default=0)
    held = {h for h in total if parsed.kinds[h] == best}
    if best == 1:
        held = {max(held, key=lambda h: (total[h], h))}
    if best:
        weights = [line.weight + line.linked if held.intersection(line.holders) else 0 for line in lines]
    else:
        weights = [line.weight for line in lines]
    runs = _runs(weights, window)
    weigh = [sum(weights[a:b]) for a, b, _ in runs]
    most = max(weigh, default=0)
    kept = [(a, b) for (a, b, top), w in zip(runs, weigh, strict=True) if best or w == most or (top >= surge and w >= share * most)]
    if not best:
        boxes = {line.box for a, b in kept for line in lines[a:b] if line.weight}
        kept = [(a, b) for a, b, _ in runs if (a, b) in kept or boxes.intersection(line.box for line in lines[a:b] if line.weight)]
    return " ".join(line.text for a, b in kept for line in lines[a:b] if line.text and (not best or held.intersection(line.holders)))


def extract(pages: DataFrame, html_col: str = "html", window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> DataFrame:
    """One row per row of pages: row (a struct of all its columns but the html), text and n_chars, the main text and its code points.

    A null or empty page, and one without text of its own, has the empty text. Broken markup ends at the end of the page at the latest;
    rows that repeat stay; an empty table gives no rows. Nothing is shuffled; an Arrow batch is what a task holds.
    """
    others = [c for c in pages.columns if c != html_col]
    source = pages.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{html_col}`").alias("html"))
    schema = StructType().add("row", source.schema["row"].dataType).add("text", StringType()).add("n_chars", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), window, surge, share) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)
