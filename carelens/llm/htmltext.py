"""Main text of HTML pages by line-block distribution (operator 10).

Markup is stripped to lines: every block element starts a new one, and what is
not article text (menus, page headers, footers, sidebars, notices, adverts,
forms, scripts, reader comments) leaves empty lines behind.  The lengths of
``WINDOW`` successive lines, lists of links not counted, are summed into a sliding
distribution; text is kept from each point where it surges over ``SURGE`` to the
point where it dives to nothing, and in the same element as such a stretch (an
advert may cut a column in two); on a page without a surge the largest stretch is
kept.  Where the page marks its article, lines inside the mark count and any
length is a surge, so that all of an article stays, its lists of links as well.

Pages are independent: one pass, no shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from .common import per_text

WINDOW, SURGE = 3, 86
# HTML elements by their role.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "object", "video", "audio", "canvas"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dir", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
         "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre",
         "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
MARK = {"article", "main"}
HOLDERS = {"article", "main", "div", "section", "td", "body", "center"}
# Inside an article mark, names count for what holds blocks, not for a paragraph or a heading.
CONTAINERS = {"article", "div", "section", "ul", "ol", "dl", "table", "details", "fieldset", "figure", "header", "address"}
# Names in class, id or role of what surrounds an article.
SIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|consent|gdpr|"
    r"notices?|notification|alert|pop-?up|modal|overlay|newsletter|subscribe|subscription|signup|login|side-?bar|"
    r"widgets?|menu|nav|navbar|navigation|breadcrumbs?|footer|site-header|page-header|masthead|topbar|toolbar|"
    r"comments?|disqus|replies|respond|share|sharing|social|related|recommended|recommendations|pagination|pager|"
    r"skip-link|contentinfo|complementary|search|dialog)(?=$|[\s_-]|\d)", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)


def _beside(tag: str, attributes: str, marked: bool) -> bool:
    """Does this element hold something other than article text?"""
    if tag in ASIDE or tag == "header" and not marked:
        return True
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role") and tag not in ("html", "body") and (
                not marked or tag in CONTAINERS or tag not in BLOCK) and SIDE_NAMES.search(html.unescape(value)):
            return True
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def lines(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, its length or 0 if most of it is links, inside an article mark, number of the
    innermost holder element) of every line; WINDOW empty lines for each end of a
    removed element."""
    out: list[tuple[str, int, bool, int]] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is beside the text
    holders, opened = [0], 0
    depth = Counter()  # open elements by name
    side = links = marks = 0
    buffer: list[str] = []
    linked = [0]
    at = 0

    def text(piece: str):
        if piece and not side:
            buffer.append(piece)
            if links:
                linked[0] += len(piece.split()) and len(" ".join(html.unescape(piece).split()))

    def end_line():
        if buffer:
            line = " ".join(html.unescape("".join(buffer)).split())
            out.append((line, len(line) if 2 * linked[0] <= len(line) else 0, marks > 0, holders[-1]))
            buffer.clear()
            linked[0] = 0

    def pop():
        nonlocal side, links, marks
        tag, beside = stack.pop()
        depth[tag] -= 1
        side -= beside
        links -= tag == "a"
        marks -= tag in MARK
        if tag in HOLDERS:
            holders.pop()
        if beside and not side:
            out.extend([("", 0, marks > 0, -1)] * WINDOW)

    while True:
        m = TAG.search(page, at)
        text(page[at:m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                end_line()
            if depth[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag == "br":
                end_line()
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                at = close.end() if close else len(page)
            continue
        if tag in BLOCK:
            end_line()
            # A new block ends an open paragraph, an item the one before it.
            while stack and tag != "br" and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")
                                             or stack[-1][0] not in BLOCK and depth["p"]):
                pop()
        if tag in VOID:
            continue
        if tag in MARK and side and not marks:
            while stack:  # the article has begun: what was left open before it ends here
                pop()
        beside = _beside(tag, m[3], marks > 0)
        if beside and not side:
            end_line()
            out.extend([("", 0, marks > 0, -1)] * WINDOW)
        stack.append((tag, beside))
        depth[tag] += 1
        side += beside
        links += tag == "a"
        marks += tag in MARK
        if tag in HOLDERS:
            opened += 1
            holders.append(opened)
    end_line()
    return out


def main_text(page: str | None) -> str:
    """The kept lines of one page, joined by line feeds."""
    rows = lines(page or "")
    marked = any(inside and line for line, _, inside, _ in rows)
    size = np.array([(len(line) if inside else 0) if marked else n for line, n, inside, _ in rows], np.int64)
    if not len(size):
        return ""
    padded = np.r_[size, np.zeros(WINDOW - 1, np.int64)]
    total = np.convolve(padded, np.ones(WINDOW, np.int64), "valid")
    runs, start, peak = [], None, 0  # (peak, first line, line after the last)
    for i, n in enumerate([*total, 0]):
        if start is None and n:
            start, peak = i, 0
        if start is not None:
            peak = max(peak, n)
            if not n:  # dive: the run of windows with text is over
                with_text = np.flatnonzero(size[start:i]) + start
                runs.append((int(peak), int(with_text[0]), int(with_text[-1]) + 1))
                start = None
    # A page whose text never surges is short: its largest stretch is the article.
    least = 1 if marked else min(SURGE, max((r[0] for r in runs), default=SURGE))
    keep = np.zeros(len(rows), bool)
    for peak, first, end in runs:
        if peak >= least:
            keep[first:end] = True
    holding = {rows[i][3] for i in np.flatnonzero(keep)}
    return "\n".join(line for (line, _, inside, holder), k in zip(rows, keep)
                     if line and (k or holder in holding) and (inside or not marked))


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty page has empty text; a page whose text is all beside an article
    too.  White space is what str.split takes for it (the no-break space as well); a
    reference split by a tag is decoded as one.  Unclosed
    elements and comments end with the page.  Repeated rows and ids (null too)
    give a result row each; an empty table gives none; only page_id, url and
    the html are read, so extra columns of any name are ignored.
    """
    def make():
        def run(texts):
            got = [main_text(t) for t in texts]
            return {"text": got, "n_chars": [len(t) for t in got]}
        return run
    return per_text(pages, make, "text string, n_chars bigint", ("page_id", "url"), html_col)
