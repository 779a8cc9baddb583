"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block. Elements that never hold an article's text (scripts, styles, menus,
page headers, footers, sidebars, notices, adverts, forms, reader comments) leave a gap of empty lines. Lengths of text outside
links are summed over sliding windows of lines; where the sum surges a region begins, where it falls to nothing the region ends, and
the text of the main regions is kept. How high a surge must be follows from the page's own lengths. An article or main element
limits the lines that weigh anything; within it, dives still cut out lists of links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SURGE = 80

# Element and attribute names of HTML, and the words that sites commonly use in class names.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title|audio|video"
DROPPED = frozenset("nav aside footer form button dialog menu head fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(["article", "main"])
CONTAINERS = frozenset("div section td center".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
JUNK = (
    "ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|sidebar|side|menu|nav|navbar|navigation|breadcrumb|"
    "breadcrumbs|cookie|cookies|consent|notice|notification|alert|banner|popup|modal|overlay|share|sharing|social|comment|comments|"
    "commentlist|disqus|respond|reply|replies|footer|masthead|topbar|toolbar|newsletter|subscribe|subscription|signup|login|related|"
    "recommended|widget|pagination|pager|skip"
)
# Words that only say what a named element is built as.
BUILT = (
    "area|article|articles|bar|block|body|bottom|box|btn|button|buttons|cell|col|column|container|content|count|form|group|header|holder|icons|"
    "inner|item|items|label|left|links|list|main|meta|module|outer|page|panel|policy|post|posts|region|right|row|section|site|slot|stories|text|thread|"
    "title|top|unit|wrap|wrapper|x"
)
_JUNK_PARTS, _BUILT_PARTS = frozenset(JUNK.split("|")), frozenset(BUILT.split("|"))

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def junk_name(value: str) -> bool:
    """Whether a class or id names something that is no article: a name all of whose parts do, or say only how it is built. One such
    part among others (side-by-side, related-work) is no evidence."""
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if any(p in _JUNK_PARTS for p in parts) and all(p in _JUNK_PARTS or p in _BUILT_PARTS or p.isdigit() for p in parts):
            return True
    return False


def _named_junk(attributes: str) -> bool:
    return any(name.lower() in ("class", "id") and junk_name(value.strip("\"'")) for name, value in _ATTRIBUTE.findall(attributes))


def _junk(tag: str, attributes: str, inside_main: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside_main):
        return True
    if "=" not in attributes and "hidden" not in attributes.lower() or tag in MAIN or tag in ("body", "html"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        low = value.lower()
        if name == "hidden" or (name == "aria-hidden" and low == "true") or (name == "style" and _HIDDEN.search(low)):
            return True
        if (name == "role" and low in ROLES) or (name in ("class", "id") and junk_name(value)):
            return True
    return False


class _Lines:
    """Lines of a page: text, weight (length outside links), whether they stand in an article or main element, and the open
    containers around them."""

    def __init__(self):
        self.text: list[str] = []
        self.weight: list[int] = []
        self.main: list[bool] = []
        self.inside: list[tuple[int, ...]] = []
        self.chain: tuple[int, ...] = ()
        self._parts: list[str] = []
        self._linked = 0

    def add(self, text: str, linked: bool) -> None:
        self._parts.append(text)
        if linked:
            self._linked += len(text)

    def end(self, main: bool) -> None:
        if self._parts:
            line = " ".join(unescape("".join(self._parts)).split())
            if line:
                self.text.append(line)
                self.weight.append(max(0, len(line) - self._linked))
                self.main.append(main)
                self.inside.append(self.chain)
            self._parts, self._linked = [], 0

    def gap(self) -> None:
        self.text += [""] * WINDOW
        self.weight += [0] * WINDOW
        self.main += [False] * WINDOW
        self.inside += [()] * WINDOW

    def bridged(self) -> list[int]:
        """Numbers of the lines without the gaps between two lines of one container, or of a container and one within it."""
        kept: list[int] = []
        last = -1
        for i, text in enumerate(self.text):
            if text:
                if last < 0:
                    kept += range(i)
                elif i > last + 1:
                    outer, inner = sorted((self.inside[last], self.inside[i]), key=len)
                    if outer != inner and (not outer or inner[: len(outer)] != outer):
                        kept += range(last + 1, i)
                kept.append(i)
                last = i
        return [*kept, *range(last + 1, len(self.text))]


def lines(html: str) -> _Lines:
    """Strip markup. A dropped element ends at its own end tag, or where an article or main element begins."""
    out, at, main, links = _Lines(), 0, 0, 0
    skip, depth = "", 0
    opened: list[tuple[str, int]] = []
    for token in _TOKEN.finditer(html):
        if not skip and token.start() > at:
            out.add(html[at : token.start()], links > 0)
        at = token.end()
        tag = (token[3] or token[6] or "").lower()
        if not tag:
            continue
        closing, attributes = token[2] or token[5], token[4] or token[7] or ""
        if skip:
            if tag == skip:
                depth += -1 if closing else not attributes.endswith("/")
            if depth and not (tag in MAIN and not closing and not main and not _named_junk(attributes)):
                continue
            ended, skip, depth = tag == skip, "", 0
            out.gap()
            if ended:
                continue
        if tag in VOID:
            if tag not in INLINE:
                out.end(main > 0)
            continue
        if not closing:
            junk = _junk(tag, attributes, main > 0)
            if tag == "article" and main and _named_junk(attributes):
                junk = True
            if junk and not attributes.endswith("/"):
                if tag not in INLINE:
                    out.end(main > 0)
                skip, depth = tag, 1
                continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag not in INLINE:
            out.end(main > 0)
            if tag in CONTAINERS:
                if not closing:
                    opened.append((tag, token.start()))
                elif any(t == tag for t, _ in opened):
                    while opened.pop()[0] != tag:
                        pass
                out.chain = tuple(k for _, k in opened)
            if tag in MAIN:
                main = max(0, main - 1) if closing else main + 1
                if not main:
                    out.gap()
    if not skip and at < len(html):
        out.add(html[at:], links > 0)
    out.end(main > 0)
    return out


def regions(weight: list[int], surge: int = SURGE, window: int = WINDOW) -> list[tuple[int, int]]:
    """(surge, dive) of each stretch of lines: from the first line of a window whose sum reaches ``surge`` to the last
    line before windows fall to nothing, with the lines that lead up to the surge without a gap."""
    sums = [sum(weight[i : i + window]) for i in range(len(weight))]
    found, at = [], 0
    while at < len(sums):
        if sums[at] == 0:
            at += 1
            continue
        to = at
        while to < len(sums) and sums[to]:
            to += 1
        begin = next(i for i in range(at, to) if weight[i])
        if max(sums[at:to]) >= surge:
            found.append((begin, to))
        at = to
    return found


def _within_main(page: _Lines, window: int) -> list[int]:
    """Lines of the article or main element without runs of at least ``window`` lines of links alone; all of them if nothing else is
    there."""
    own = [i for i, m in enumerate(page.main) if m and page.text[i]]
    kept: list[int] = []
    run: list[int] = []
    for i in [*own, -1]:
        if i >= 0 and 5 * page.weight[i] <= len(page.text[i]):
            run.append(i)
            continue
        if len(run) < window:
            kept += run
        run = []
        if i >= 0:
            kept.append(i)
    return kept if any(page.weight[i] for i in kept) else own


def _of_page(page: _Lines, surge: int, window: int) -> list[int]:
    """Lines of the regions with a surge and at least as much text outside links as inside, or of the heaviest region, and of
    lighter ones that share a container with these."""
    order = page.bridged()
    weight = [page.weight[i] for i in order]
    every = regions(weight, 1, window)
    sizes = {r: sum(weight[r[0] : r[1]]) for r in every}
    most = max((sum(weight[i : i + window]) for i in range(len(weight))), default=0)
    high = set(regions(weight, min(surge, max(1, most // 2)), window))
    dense = [r for r in every if r in high and 2 * sizes[r] >= sum(len(page.text[i]) for i in order[r[0] : r[1]])]
    kept = dense or sorted(every, key=lambda r: -sizes[r])[:1]
    homes = {page.inside[i] for a, b in kept for i in order[a:b] if page.text[i] and page.inside[i]}
    kept += [r for r in every if r not in kept and any(page.inside[i] in homes for i in order[r[0] : r[1]] if page.weight[i])]
    return [i for a, b in sorted(kept) for i in order[a:b] if page.text[i]]


def main_text(html: str | None, surge: int = SURGE, window: int = WINDOW) -> str:
    """The article's text: white space inside a block is one space, blocks are joined in page order by one space.

    If the page marks its article or main element, only lines inside it weigh anything: the regions are those of the article
    between runs of ``window`` lines of links alone, however short. Otherwise text inside links weighs nothing, dropped elements
    between lines of one container are no gap, and the regions that surge to ``surge`` characters a window, or to half of the
    page's highest window if that is less, are kept where they hold at least as much text outside links as inside; without any such, the
    largest is. Lighter regions in the same container as a kept one stay as well. Of regions of equal weight the first counts.
    Null, empty and text-free pages give an empty text. Elements left open end with the page; void elements hold nothing. Very
    long pages are read whole, in steps that grow with their length."""
    if not html:
        return ""
    page = lines(html)
    kept = _within_main(page, window) if any(page.main) else _of_page(page, surge, window)
    return " ".join(page.text[i] for i in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row, from its whole html; ``n_chars`` counts code points.

    Each page is handled alone, without a shuffle. Null ids and urls stay null; repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty table."""
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
