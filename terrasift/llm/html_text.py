"""Operator 7: main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one a block element. What the markup itself declares not to be the article (menus, site
headers, footers, forms, scripts, elements named as adverts, reader comments ...) is left out. Elements whose names only
hint at something else (a notice, a discussion, a banner ...) and the borders of <article> and <main> stand between WINDOW
empty lines, so that windows of lines don't reach across. The lengths of text that isn't in links are summed over sliding
windows of WINDOW lines. A stretch reaches from a surge point, where the sums rise from nothing, to the dive point, where
they fall to nothing; it is kept if its highest sum comes near the page's highest: NEAR of it, HINTED of it in an element
with a hinting name. Lines of the content root other than hinted ones are one text, which is kept whole. The root decides
what is considered only if it holds ROOT of the text of the page's kept stretches; otherwise the whole page is.

Defined results: null or empty html gives the empty text; unclosed elements end with their parents or the page; a '<'
that opens no tag is text; equal pages give equal texts; only the columns named are read; nothing is cut at any length.
Time grows in proportion to the page, however broken its markup.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read

#: Lines in a sliding window; shares of the page's highest window sum that a stretch must reach; share of a stretch that may be links; share of the text that makes a root.
WINDOW, NEAR, HINTED, LINKS, ROOT = 3, 0.25, 0.5, 0.6, 0.3

#: A tag: outside of quotes it ends at the next '<' at the latest, so that no scan is repeated.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)|([a-zA-Z_:][-\w:.]*+)""")

# Element names of HTML by their part in the layout.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ASIDE = frozenset("nav footer aside form button select option datalist noscript template svg math canvas audio video object dialog menu fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id values that declare something other than the article, and words that only hint at it.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsored outbrain taboola nav navbar navigation menu menus topbar sidebar sidebars sidenav footer masthead breadcrumb breadcrumbs pagination pager "
    "comments commentlist disqus cookie cookies gdpr newsletter searchform".split()
)
HINTS = frozenset(
    "sponsor sponsors promo promos promotion banner aside rail foot comment respond reply replies discussion consent notice notices notification alert popup modal overlay share sharing social follow related recommended "
    "recommendations trending subscribe subscription signup login search widget widgets skip toolbar copyright legal disclaimer hidden".split()
)
BLOCKS = frozenset("div td li section article blockquote".split())
PART = re.compile(r"[a-z]+")


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[3]).lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def _declared(name: str, attributes: str, inside: bool, by_class: bool = True) -> int:
    """2 if an element says that it isn't part of the article, 1 if its names hint at it, else 0.

    inside: it stands in <article> or <main>. by_class: names of classes count too."""
    if name in ASIDE or name == "header" and not inside:
        return 2
    if not attributes or not by_class or name in ("html", "body", "article", "main"):
        return 0
    a = _attributes(attributes)
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "").lower()):
        return 2
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    said = set(PART.findall(" ".join(n for n in names if not n.startswith(("has-", "no-", "with-", "without-", "is-")))))
    if said & NOT_ARTICLE or (not inside and "header" in said and name in ("div", "section", "table", "ul")):
        return 2
    return int(bool(said & HINTS))


class Line(NamedTuple):
    text: str = ""
    links: int = 0  # characters in links
    rooted: bool = False  # in <article> or <main>
    hinted: bool = False  # in an element whose names hint at something else


class _Lines:
    """Reads a page's markup into lines. How many elements of a name are open is counted, so that no search of the open ones is in vain."""

    def __init__(self, by_class: bool) -> None:
        self.by_class = by_class
        self.lines: list[Line] = []
        self.buffer: list[str] = []
        self.stack: list[str] = []  # open elements but for void ones
        self.open: Counter[str] = Counter()
        self.links = 0
        self.skip_at = self.hint_at = -1  # the stack's depth at which something left out, or hinted, began
        self.skip_open: Counter[str] = Counter()  # open elements inside what is left out

    def root(self) -> bool:
        return self.open["article"] + self.open["main"] > 0

    def flush(self, empty: int = 0) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.lines.append(Line(text, min(self.links, len(text)), self.root(), self.hint_at >= 0))
            self.buffer.clear()
        self.links = 0
        self.lines.extend([Line(rooted=self.root(), hinted=self.hint_at >= 0)] * empty)

    def push(self, name: str) -> None:
        self.stack.append(name)
        self.open[name] += 1
        if self.skip_at >= 0:
            self.skip_open[name] += 1

    def close(self, to: int) -> None:
        while len(self.stack) > to:
            name = self.stack[-1]
            if self.skip_at < 0 and (name in ("article", "main") or len(self.stack) - 1 == self.hint_at):
                self.flush(WINDOW)
            self.stack.pop()
            self.open[name] -= 1
            if self.skip_at >= 0:
                self.skip_open[name] -= 1
            if len(self.stack) <= self.skip_at:
                self.skip_at = -1
                self.skip_open.clear()
            if len(self.stack) <= self.hint_at:
                self.hint_at = -1

    def text(self, piece: str) -> None:
        if self.skip_at < 0:
            self.buffer.append(piece)
            if self.open["a"]:
                self.links += len(piece)

    def end(self, name: str) -> None:
        if name not in INLINE and self.skip_at < 0:
            self.flush()  # a stray end of a block still ends the line
        if self.open[name]:
            depth = len(self.stack) - 1
            while self.stack[depth] != name:
                depth -= 1
            self.close(depth)

    def start(self, name: str, attributes: str) -> None:
        lasts = name not in VOID and not attributes.endswith("/")
        if self.skip_at >= 0:
            escapes = name in ("article", "main") and not self.root() and self.stack[self.skip_at] in ("div", "section", "nav", "header", "head")
            if not escapes or any(self.skip_open[x] for x in ("form", "template", "svg")):
                if lasts:
                    self.push(name)
                return
            self.close(self.skip_at)  # an element left open before the article doesn't hold it
        if name == "br":
            self.buffer.append(" ")
        elif name in INLINE:
            if lasts:
                if _declared(name, attributes, self.root(), self.by_class) == 2:
                    self.skip_at = len(self.stack)
                self.push(name)
        else:
            self.flush()
            if name not in VOID:
                self.block(name, attributes)

    def block(self, name: str, attributes: str) -> None:
        if name == "p" and self.open["p"]:
            depth = len(self.stack) - 1
            while self.stack[depth] != "p" and self.stack[depth] not in BLOCKS:
                depth -= 1
            if self.stack[depth] == "p":
                self.close(depth)
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and self.stack and self.stack[-1] == name:
            self.close(len(self.stack) - 1)
        says = _declared(name, attributes, self.root(), self.by_class)
        if says == 2:
            if not self.root():
                self.flush(WINDOW)
            self.skip_at = len(self.stack)
        elif name in ("article", "main") or says and self.hint_at < 0:
            self.flush(WINDOW)
            self.hint_at = len(self.stack) if says else self.hint_at
        if not attributes.endswith("/") or name in ("article", "main") or says:
            self.push(name)

    def read(self, html: str) -> list[Line]:
        at, size, gt = 0, len(html), 0
        while at < size:
            lt = html.find("<", at)
            stop = size if lt < 0 else lt
            if stop > at and self.skip_at < 0:
                self.text(unescape(html[at:stop]))
            if lt < 0:
                break
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = size if end < 0 else end + 3
                continue
            if gt >= 0 and gt < lt:
                gt = html.find(">", lt)
            if html.startswith(("<!", "<?"), lt):
                at = size if gt < 0 else gt + 1
                continue
            m = (TAG.match(html, lt) or LOOSE_TAG.match(html, lt)) if gt >= 0 else None  # without any '>' ahead there is no tag
            if not m:
                if self.skip_at < 0:
                    self.buffer.append("<")
                at = lt + 1
                continue
            at, name = m.end(), m[2].lower()
            if m[1]:
                self.end(name)
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
                after = html.find(">", end.start()) if end else -1
                at = size if after < 0 else after + 1
            else:
                self.start(name, m[3])
        if self.skip_at < 0:
            self.flush()
        return self.lines


def stretches(lines: list[Line]) -> list[tuple[int, int, int]]:
    """(first line, line after the last, highest window sum) between each surge point and the dive point that follows."""
    sums, run = [], 0
    size = [len(x.text) for x in lines]
    for i in range(len(lines)):
        run += size[i] - (size[i - WINDOW] if i >= WINDOW else 0)
        sums.append(run)  # over the WINDOW lines that end here
    plain, run, top = [len(x.text) - x.links for x in lines], 0, 0
    out, start = [], -1
    for i, s in enumerate(sums):
        run += plain[i] - (plain[i - WINDOW] if i >= WINDOW else 0)
        if s and start < 0:
            start, top = i, 0  # surge
        top = max(top, run)
        if not s and start >= 0:
            out.append((start, i - WINDOW + 1, top))  # dive: the windows have been empty since
            start = -1
    if start >= 0:
        out.append((start, len(lines), top))
    return out


def kept_of(lines: list[Line]) -> list[Line]:
    """The lines of the stretches that are dense enough."""
    found = stretches(lines)
    own = [top for a, _, top in found if not lines[a].hinted]
    highest = max(own or [top for _, _, top in found], default=0)
    out: list[Line] = []
    for a, b, top in found:
        first = lines[a]
        linked = sum(x.links for x in lines[a:b]) > LINKS * sum(len(x.text) for x in lines[a:b])
        if len(found) == 1 or not linked and top >= (HINTED if first.hinted else 0.0 if first.rooted else NEAR) * highest:
            out += [x for x in lines[a:b] if x.text]
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    lines = _Lines(True).read(html)
    if not any(x.text for x in lines):  # a class name may have stood for the whole page
        lines = _Lines(False).read(html)
    inside = kept_of([x if x.rooted else Line() for x in lines])
    if inside:
        whole = kept_of([x._replace(rooted=False) for x in lines])
        if sum(len(x.text) for x in inside) < ROOT * sum(len(x.text) for x in whole):
            inside = []
    return "\n".join(x.text for x in inside or kept_of([x._replace(rooted=False) for x in lines]))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns and text: one row for each row of pages; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[list(keep)].copy()
            out["text"] = [main_text(h) for h in b["_html"]]
            yield out

    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    schema = pages.select(*keep).schema.add("text", "string")
    return map_batches(rows, run, schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
