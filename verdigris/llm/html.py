"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines, one per block; empty lines that tags alone make are left out. A line's density is the length
of its text without links, none if it is mostly links. Element and class names only shift it: text of an article counts
``ARTICLE`` times, with its links; text of footers, sidebars, notices, adverts and reader comments counts ``ASIDE_SHARE``
of its length. Menus, controls and what is hidden have none. Densities are summed over sliding windows of lines. A stretch
of lines begins and dives where density ends or its shift changes; it surges, and is kept whole, where a sum reaches the
page's threshold: half of its greatest sum, between a quarter of ``SURGE`` and ``SURGE``. A plain stretch that doesn't is
kept too unless it lies next to a line of links, where it is a menu's.

A form counts as a sidebar, unless its text surges and is more than half of the page's: then it wraps the page.

Null and empty html give the empty text. Truncated markup ends what is open. Repeated rows are extracted each. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, rows_of

WINDOW = 3
SURGE = 80
#: A line is mostly links if they hold more than this share of it.
LINK_SHARE = 0.5
#: How often a character counts in an article, and in what the page's names say is beside it.
ARTICLE = 20
ASIDE_SHARE = 0.02

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)(?:>|\Z)|/?[a-zA-Z][^>]*+(?:>|\Z))""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
NAMES = re.compile(r"[a-z]+")

#: What holds no readable text; its content is skipped unread.
RAW = frozenset("script style noscript template iframe object svg canvas textarea title xmp noembed noframes math video audio".split())
#: Elements without prose, those beside the main text, and those that are beside it only outside of an article.
DEAD = frozenset("nav menu select button datalist label input head".split())
BESIDE = frozenset("footer aside dialog".split())
FORMS = frozenset("form fieldset".split())
OUTER = frozenset(["header"])
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr link meta base".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the key ends where an element of the value begins.
ENDS_AT = {"p": frozenset("p div ul ol dl table section article aside nav header footer form h1 h2 h3 h4 h5 h6 blockquote pre hr main".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
MAIN = frozenset(["article", "main"])
#: Words in class, id or role names of what is not main text.
BOILERPLATE = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus reply replies respond share sharing social related recommended "
    "recommendations newsletter subscribe subscription popup modal overlay widget widgets toolbar pagination pager login signup search complementary contentinfo dialog".split()
)
#: The same for article elements, whose class names say more about layout.
NOT_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments reply related recommended teaser".split())
OUTER_NAMES = frozenset(["header", "masthead", "topbar"])
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _share(tag: str, attributes: str, inside: bool) -> float:
    """How much an element's text counts by its names: 0, ``ASIDE_SHARE`` or 1."""
    if tag in DEAD:
        return 0
    share = ASIDE_SHARE if tag in BESIDE or (tag in OUTER and not inside) else 1
    if not attributes or tag in ("html", "body"):
        return share
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            words = NAMES.findall(value)
            if tag == "article":
                beside = not NOT_ARTICLE.isdisjoint(words)
            else:
                beside = tag != "main" and (not BOILERPLATE.isdisjoint(words) or (not inside and not OUTER_NAMES.isdisjoint(words)))
            if beside:
                share = ASIDE_SHARE
        elif HIDDEN_STYLE.search(value) if name == "style" else name == "hidden" or value == "true":
            return 0
    return share


class Line:
    __slots__ = ("parts", "links", "main", "share", "form")

    def __init__(self, main: bool, share: float, form: bool):
        self.parts: list[str] = []
        self.links = 0
        self.main = main
        self.share = share
        self.form = form


def lines_of(page: str) -> list[tuple[str, int, bool, float, bool]]:
    """(text, length of its links, inside an article, share by its names, inside a form) of each block."""
    out: list[Line] = [Line(False, 1, False)]
    stack: list[str] = []
    depths: dict[str, list[int]] = {}  # where each open tag stands in the stack
    solid: list[int] = []  # where elements that aren't inline stand
    skip_from, share = -1, 1.0  # depth and share of the outermost element that is open and has less than all
    main = links = forms = 0
    at, n = 0, len(page)

    def text(s: str) -> None:
        if share and s:
            line = out[-1]
            line.parts.append(s)
            if links:
                line.links += len(s.strip())

    def pop_to(depth: int) -> None:
        nonlocal skip_from, share, main, links, forms
        while len(stack) > depth:
            tag = stack.pop()
            depths[tag].pop()
            if tag not in INLINE:
                solid.pop()
            if len(stack) == skip_from:
                skip_from, share = -1, 1.0
            main -= tag in MAIN
            links -= tag == "a"
            forms -= tag in FORMS

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if depths.get(tag):
                pop_to(depths[tag][-1])
        elif tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = end.end() if end else n
        else:
            if tag in ENDS_AT["p"] and depths.get("p") and solid[-1] == depths["p"][-1]:  # only inline elements are open in it
                pop_to(depths["p"][-1])
            if stack and tag in ENDS_AT.get(stack[-1], ()):
                pop_to(len(stack) - 1)
            if tag not in VOID:
                if tag == "article" and main == 0 and skip_from >= 0 and stack[skip_from] in ("div", "section", "p", "li", "ul"):
                    pop_to(skip_from)  # boilerplate that was never closed
                if skip_from < 0 and (counts := _share(tag, m[3], main > 0)) < 1:
                    skip_from, share = len(stack), counts
                depths.setdefault(tag, []).append(len(stack))
                if tag not in INLINE:
                    solid.append(len(stack))
                stack.append(tag)
                main += tag in MAIN
                links += tag == "a"
                forms += tag in FORMS
        if tag not in INLINE:
            out.append(Line(main > 0, share, forms > 0))
    return [(" ".join(entities.unescape("".join(x.parts)).split()), x.links, x.main, x.share, x.form) for x in out]


def peak_of(values: list[float]) -> float:
    """The greatest sum over a window of lines."""
    peak = window = 0
    for k, n in enumerate(values):
        window += n - (values[k - WINDOW] if k >= WINDOW else 0)
        peak = max(peak, window)
    return peak


def densities(lines: list[tuple[str, int, bool, float, bool]]) -> list[tuple[float, float]]:
    """(density, shift) of each line; lines of one shift and next to each other are of one stretch."""
    plain = [len(t) if share == 1 and (main or links <= LINK_SHARE * len(t)) else 0 for t, links, main, share, _ in lines]
    formed = [n if line[4] else 0 for n, line in zip(plain, lines, strict=True)]
    wraps = 2 * sum(formed) > sum(plain) and peak_of(formed) >= SURGE
    out = []
    for n, (t, links, main, share, form) in zip(plain, lines, strict=True):
        if share == 1 and form and not wraps:
            share = ASIDE_SHARE
        if share < 1:
            out.append((share * (len(t) if links <= LINK_SHARE * len(t) else 0), share))
        else:
            shift = ARTICLE if main else 1
            out.append((shift * n, shift))
    return out


def main_text(page: str) -> str:
    lines = [x for x in lines_of(page) if x[0] or x[3] < 1]
    density = densities(lines)
    stretches = []
    i, n = 0, len(lines)
    while i < n:
        start, shift = i, density[i][1]
        while i < n and density[i][0] and density[i][1] == shift:
            i += 1
        if i == start:
            i += 1
            continue
        stretches.append((start, i, shift, peak_of([d[0] for d in density[start:i]])))
    surge = max(SURGE / 4, min(SURGE, max((s[3] for s in stretches), default=0) / 2))
    out: list[str] = []
    for start, end, shift, peak in stretches:
        by_links = any(0 <= k < n and lines[k][0] and density[k] == (0, 1) for k in (start - 1, end))
        if peak >= surge or (shift == 1 and not by_links):
            out += [x[0] for x in lines[start:end] if x[0]]
    return "\n".join(out)


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
OUT_DDL = "page_id long, url string, text string, n_chars long"


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its main text, blocks joined by line feeds, and the text's code points."""

    def run(batch: pa.RecordBatch):
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield rows_of(OUT, {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": list(map(len, texts))})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(per_batch(run), OUT_DDL)
