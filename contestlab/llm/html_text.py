"""Main text of web pages by line-block distribution (operator 8).

Markup is stripped into lines, one for each block of text. A line weighs its length; one that speaks against itself (mostly link text, or outside
the article or main element of a page that has one) weighs an eighth and is called light, one inside such an element weighs SURGE more. The weights are
summed over a sliding window of lines. The text lies where the sums surge to SURGE or more, and reaches on both sides to the points where they dive
under DIVE; light lines at its two ends don't belong to it. All lines between are kept but those of marked-up boilerplate (menus, headers, footers,
sidebars, notices, adverts, forms, comments), which weigh nothing. A page without a surge keeps its heaviest stretch.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, SURGE, DIVE = 3, 80, 8

# HTML elements by role.
RAW = {"script", "style", "template", "noscript", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea", "select", "title"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end by themselves where the next block begins.
SHORT = {"p", "li", "dt", "dd", "td", "th", "tr", "option"}
NEVER = {"html", "body", "main", "article"}
#: Elements of running text, and marks that are also plain words, by which such an element inside an article is not taken for boilerplate.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
PLAIN = {"share", "menu", "notice", "notices", "alert", "search", "widget", "widgets", "related", "reply", "replies", "banner", "social", "skip", "recommended", "promotion", "respond", "aside"}
#: Words of class, id and role values that mark boilerplate.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb",
    "breadcrumbs", "sidebar", "aside", "footer", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "respond", "disqus", "reply", "replies", "search",
    "pagination", "pager", "widget", "widgets", "skip", "complementary", "contentinfo",
}
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: A value in quotes begins right after an equals sign; quotes elsewhere are letters like any other.
QUOTED = re.compile(r"=\s*([\"'])")
#: One attribute: its name, and its value, which is read whole.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
#: Words that may follow a mark, as in "nav-bar", and words that may go before one, as in "site-footer".
BOXES = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "form", "group", "icons", "inner", "item", "items", "left", "link",
    "links", "list", "main", "menu", "nav", "outer", "panel", "right", "row", "section", "slot", "top", "unit", "wrap", "wrapper", "zone",
}
PLACES = {"bottom", "global", "left", "main", "page", "primary", "right", "secondary", "site", "sub", "top"}


def _is_mark(word: str) -> bool:
    """A mark, or a compound of marks, boxes, places and numbers around one: "comment-12", "cookie-notice" and "top-nav", but not "search-results"."""
    parts = [x for x in re.split(r"[-_]+", word) if x]
    if len(parts) == 1:
        return word in MARKS
    marks = [x in MARKS for x in parts]
    return any(marks) and all(m or (x in BOXES or x[0].isdigit()) and any(marks[:k]) or x in PLACES and any(marks[k:]) for k, (x, m) in enumerate(zip(parts, marks)))


def _marked(name: str, attributes: str, article: bool) -> bool:
    if not attributes or name in NEVER or name in VOID:
        return False
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        if m[1]:
            found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    if "hidden" in found or found.get("aria-hidden", "").strip() == "true":
        return True
    role = found.get("role", "").split()
    if "main" in role or "article" in role:
        return False
    spared = PLAIN if article and name in PROSE else ()
    return any(_is_mark(word) and word not in spared for key in ("class", "id", "role") for word in found.get(key, "").split())


def _markup(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each piece of markup in order; comments and declarations have no name.

    Each piece is found by searches that go on from where the last one ended, so that the time is linear in the page's length. A tag
    ends at the first > outside quoted values, or, if there is none, at the first > after all; without any > it is text.
    """
    last = {c: html.rfind(c) for c in ">\"'"}
    at = html.find("<")
    while at >= 0:
        end, closing, name, attributes = -1, False, "", ""
        named = NAME.match(html, at)
        if html.startswith("<!--", at) or html.startswith("<![CDATA[", at):
            mark = "-->" if html.startswith("<!--", at) else "]]>"
            found = html.find(mark, at + 4)
            end = found + 3 if found >= 0 else len(html)
        elif html.startswith(("<!", "<?"), at):
            found = html.find(">", at)
            end = found + 1 if found >= 0 else len(html)
        elif named and named.end() <= last[">"]:
            stop = first = html.find(">", named.end())
            value = QUOTED.search(html, named.end(), stop)
            while value:
                after = html.find(value[1], value.end()) + 1 if value.end() <= last[value[1]] else 0
                if after > stop:
                    stop = html.find(">", after) if after <= last[">"] else -1
                    if stop < 0:
                        stop = first
                        break
                value = QUOTED.search(html, after or value.end(), stop)
            end, closing, name, attributes = stop + 1, html[at + 1] == "/", named[1].lower(), html[named.end(): stop]
        if end > 0:
            yield at, end, closing, name, attributes
        at = html.find("<", end if end > 0 else at + 1)


def lines_of(html: str) -> list[tuple[str, bool, bool, int, bool]]:
    """(text, boilerplate, inside the article, characters of link text, in a heading) for each block of text in page order; empty blocks are left out.

    Boilerplate inside a line, as an advert in a paragraph, is taken out of it, and the line goes on.
    """
    lines, now, links = [], [], 0
    skip, depth, article, within, anchor, at, heading = "", 0, 0, False, 0, 0, False
    held: tuple[list[str], int] | None = None  # the line that inline boilerplate interrupts
    endless: set[str] = set()  # raw elements that no closing tag follows any more

    def flush() -> None:
        nonlocal now, links
        text = " ".join(unescape("".join(now)).split())
        if text:
            lines.append((text, bool(skip), article > 0, links, heading))
        now, links = [], 0

    for start, stop, close, name, attributes in _markup(html):
        if start < at:
            continue
        piece = html[at: start]
        if piece:
            now.append(piece)
            if anchor:
                links += len(piece.strip())
        at = stop
        if not name:
            continue
        if name in RAW and not close:
            if not attributes.rstrip().endswith("/"):
                end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                if not end:
                    endless.add(name)
                at = end.end() if end else (len(html) if name in ("script", "style", "textarea") else at)
            continue
        if name in BLOCK:
            flush()
            heading = not close and name in PROSE and name[0] == "h"
        elif name == "br":
            now.append(" ")
        if name == "a":
            anchor = 0 if close else 1
        if skip:
            if name == skip:
                depth += -1 if close else name not in VOID
            if depth <= 0 or skip in SHORT and (name in BLOCK and not close and name != skip) or not within and name in ("article", "main") and not close or close and name in ("body", "article") and within >= (name == "article"):
                flush()
                skip, depth = "", 0
                if held:
                    (now, links), held = held, None
                    if name in BLOCK:
                        flush()
        elif not close and name not in VOID and (name in BOILERPLATE or name == "header" and not article or _marked(name, attributes, article > 0)) and not attributes.endswith("/"):
            if name not in BLOCK:
                held, now, links = (now + [" "], links), [], 0
            skip, depth, within = name, 1, article > 0
        if name in ("article", "main"):
            article = max(0, article - 1) if close else article + 1
    now.append(html[at:])
    flush()
    if held:
        skip, (now, links) = "", held
        flush()
    return lines


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> str:
    """The main text: kept blocks in page order joined by a line feed; empty if there is none."""
    lines = [(t, a, k, h) for t, b, a, k, h in lines_of(html or "") if not b]
    bounded = any(a for _, a, _, _ in lines)
    light = [not a if bounded else 2 * k > len(t) and not h for t, a, k, h in lines]
    weight = [len(t) / 8 if x else len(t) + (surge if bounded else 0) for (t, *_), x in zip(lines, light)]
    n = len(weight)
    sums = [sum(weight[k: k + window]) for k in range(n)]
    kept, k, stretches = [], 0, []
    while k < n:
        if sums[k] < dive and light[k]:
            k += 1
            continue
        begin = k  # up to the dive point
        while k < n and not (sums[k] < dive and light[k]):
            k += 1
        a, b = begin, k
        while a < b and light[a]:
            a += 1
        while b > a and light[b - 1]:
            b -= 1
        if a < b:
            stretches.append((max(sums[begin: k]), a, b))
    most = max((s for s, _, _ in stretches), default=0)
    for s, a, b in stretches:
        if s >= surge or s == most:
            kept += [t for t, *_ in lines[a:b]]
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """`pages` with a string column `into` (replaced if it exists): the main text, empty for null, empty and textless pages.

    Repeated rows come back repeated, an empty table gives an empty result. The time is linear in a page's length.
    """
    def batch(data: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in data], dtype=object)

    return pages.withColumn(into, F.pandas_udf(batch, "string")(F.col(html)))
