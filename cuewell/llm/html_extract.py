"""Operator 8: main text of web pages, from streaming parser events and text-to-tag ratios.

The standard library's parser gives events; each block of text becomes a line with its length, its
number of tags and the containers around it.  Text-to-tag ratios are smoothed with a Gaussian along
the page and split into two clusters by an iterated threshold.  Pages with article or main elements
give the blocks of all of them.  Elsewhere the lowest container around every line of the high
cluster and the heading before them holds the content, and all its blocks count, in page order; a
list, table, quote or figure is never that container.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader comments never do.

Map-only: one page at a time.  Null or empty html, or a page without content: empty text.
Truncated pages and unclosed or stray tags are read as far as they go.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa

# Element names by role.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "audio", "video", "head", "title", "select", "textarea", "math"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "header"}
CONTAINERS = {"html", "body", "article", "main", "section", "div", "table", "tbody", "td", "ul", "ol", "dl", "center", "blockquote", "figure"} | BOILERPLATE
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "th", "thead", "tfoot", "caption", "pre", "hr", "address", "figcaption", "details", "summary", "fieldset", "legend", "br", "option"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Containers that are parts of a text, never the whole of it.
PARTS = {"table", "tbody", "td", "ul", "ol", "dl", "blockquote", "figure"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words of class, id and role attributes that mark a container as no part of the article.
MARKS = {
    *"ad ads adv advert adverts advertisement advertising adslot sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notification alert".split(),
    *"popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation topbar breadcrumb breadcrumbs toolbar masthead footer header".split(),
    *"related recommended recommendations share sharing social login search widget comment comments commentlist disqus reply replies discussion pagination pager skip complementary contentinfo".split(),
}
CONTENT_MARKS = {"article", "post", "entry", "content", "main", "story"}
ALWAYS = {"comment", "comments", "commentlist", "disqus", "ad", "ads", "advert", "sidebar", "share", "related"}
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_CUT_TAG = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
SIGMA, RADIUS = 1.0, 2


def _marked(tag: str, attrs) -> bool:
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name in ("class", "id", "role") and value:
            words = set(_SPLIT.split(value.lower()))
            if words & MARKS and (words & ALWAYS or not words & CONTENT_MARKS):
                return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


class _Lines(HTMLParser):
    """Collects lines: [text, tags, container path, boilerplate, heading]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # open containers: name, number, boilerplate
        self.kinds: dict[int, str] = {}
        self.silent: list[str] = []
        self.lines: list[tuple[str, int, tuple[int, ...], bool, bool]] = []
        self.buf: list[str] = []
        self.heading = False
        self.tags, self.count = 0, 0

    def _flush(self):
        text = _SPACE.sub(" ", "".join(self.buf)).strip()
        self.buf.clear()
        if text:
            self.lines.append((text, self.tags, tuple(n for _, n, _ in self.stack), any(b for *_, b in self.stack), self.heading))
        self.tags = 0

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.append(tag)
            elif tag == "body" and self.silent[0] in ("head", "title"):
                self.silent.clear()
            else:
                return
        elif tag in SILENT:
            self.silent.append(tag)
            return
        if tag in BLOCKS:
            self._flush()
            self.heading = tag in HEADINGS or (self.heading and tag == "br")
        self.tags += 1
        if tag in CONTAINERS and tag not in VOID:
            inside = any(name in ("article", "main") for name, *_ in self.stack)
            bad = (tag in BOILERPLATE and not (tag == "header" and inside)) or (tag not in ("html", "body") and bool(attrs) and _marked(tag, attrs))
            self.count += 1
            self.kinds[self.count] = tag
            self.stack.append((tag, self.count, bad))

    def handle_startendtag(self, tag, attrs):
        if not self.silent and tag in BLOCKS:
            self._flush()

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            return
        if tag in BLOCKS:
            self._flush()
            self.heading = False
        self.tags += 1
        if tag in CONTAINERS:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    del self.stack[i:]
                    break

    def handle_data(self, data):
        if not self.silent:
            self.buf.append(data)


def _smooth(ratios: list[float]) -> list[float]:
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(ratios)):
        num = den = 0.0
        for d, k in zip(range(-RADIUS, RADIUS + 1), kernel, strict=True):
            if 0 <= i + d < len(ratios):
                num += k * ratios[i + d]
                den += k
        out.append(num / den)
    return out


def _threshold(values: list[float]) -> float:
    """Between two clusters: the mean of their means, repeated until it stays."""
    t = sum(values) / len(values)
    for _ in range(50):
        high, low = [v for v in values if v >= t], [v for v in values if v < t]
        if not high or not low:
            return t
        new = (sum(high) / len(high) + sum(low) / len(low)) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def extract(html: str | None) -> str:
    """The page's main text: blocks joined by newlines."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(_CUT_TAG.sub("", html) if ">" not in html[html.rfind("<") :] else html)
    parser.close()
    parser.silent.clear() if parser.silent and parser.silent[0] in ("head", "title") else None
    parser._flush()
    lines = [x for x in parser.lines if not x[3]]
    if not lines:
        return ""
    smooth = _smooth([len(t) / max(1, tags) for t, tags, *_ in lines])
    limit = _threshold(smooth)
    named = {n for _, _, path, *_ in lines for n in path if parser.kinds[n] in ("article", "main")}
    if named:
        # All of them, but for a main element around articles, which count instead.
        outer = {a for _, _, path, *_ in lines for i, a in enumerate(path) if any(parser.kinds[b] == "article" for b in path[i + 1 :])}
        chosen = {n for n in named if not (parser.kinds[n] == "main" and n in outer)}
        return "\n".join(t for t, _, path, *_ in lines if chosen & set(path))
    high = [i for i, v in enumerate(smooth) if v >= limit] or list(range(len(lines)))  # equal ratios may all round below
    high += [i for i in range(high[0]) if lines[i][4]][-1:]
    common = lines[high[0]][2]
    for i in high:
        same = [a == b for a, b in zip(common, lines[i][2], strict=False)]
        common = common[: (same + [False]).index(False)]
    while common and parser.kinds[common[-1]] in PARTS:
        common = common[:-1]
    return "\n".join(t for t, _, path, *_ in lines if path[: len(common)] == common)


def extract_pages(df, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"):
    """page_id, url, text and n_chars for every page."""

    def run(batches):
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return df.select(id_col, url_col, html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str):
    from .textblocks import read_table

    return extract_pages(read_table(spark, sf_dir, "pages"))
