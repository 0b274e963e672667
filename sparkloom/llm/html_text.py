"""Main text of HTML pages from streaming parser events, by text-to-tag ratios.

The standard library's parser streams a page once into lines: one for each block element's own text, with the
number of tags in it, the share of it that is link text, and the containers around it. A line's ratio is its characters
over its tags; the ratios are smoothed with a Gaussian, and lines above the threshold (the smoothed ratios' standard
deviation, as both clusters are told apart by spread) form the content cluster.

Structure only filters: menus, headers, footers, sidebars, notices, adverts, forms and reader comments, known by their
elements, roles or the names of ``ASIDE_NAMES``, are never taken. Of the other lines the ratios decide:

* The content regions are the outermost article-like containers that hold lines of the content cluster.
* In a region, a line of the cluster is taken. One outside it is taken unless it lies in a container of ``SOFT_NAMES`` or in a
  run of at least ``MENU`` lines outside the cluster that are mostly link text, which is a menu without a name.
* Without such a container, the cluster's lines and what lies between them under the same parents are taken.

Scripts, styles, templates and the head are never text; formulas in MathML are, without their annotations.

Defined cases: null or empty html gives an empty text; text outside any tag is a line of its own; unclosed and stray tags
are tolerated; a comment or tag that the page's end cuts off is no text, as in browsers; ``br`` is white space; white
space is that of Unicode, so a no-break space counts; repeated rows come out alike; an empty table gives an empty
result. Long pages are processed whole, in time linear in their length whatever their tags.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import table
from sparkloom.llm.texthash import text_groups

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul caption button textarea iframe".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style template noscript title svg annotation annotation-xml object iframe canvas audio video textarea select button".split())
ASIDE = frozenset("nav aside footer form menu dialog search".split())
REGION = frozenset(("article", "main"))
ROLES = {"main": "region", "article": "region", "navigation": "aside", "banner": "aside", "contentinfo": "aside", "complementary": "aside", "search": "aside", "alert": "aside", "alertdialog": "aside", "dialog": "aside"}
#: Words in class or id names of containers that are no main text.
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-header|page-header|topbar"
    r"|comments?|commentlist|respond|replies|disqus|newsletter|subscribe|signup|login)(?:$|[\s_-])",
    re.I,
)
#: Words in names of containers that are no main text where their lines are outside the content cluster.
SOFT_NAMES = re.compile(r"(?:^|[\s_-])(?:share|sharing|social|related|recommended|popup|modal|overlay|widget|pagination|pager|toolbar|skip-link)(?:$|[\s_-])", re.I)
MENU = 3
SIGMA, RADIUS = 1.0, 3
_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()
#: An end tag closes what is open inside it; these stop the search for its start.
_SCOPE = frozenset("article aside body footer form header html main nav section table td th".split())
_OPEN_END = re.compile(r"<(?:[A-Za-z/!?])")


class Line(NamedTuple):
    text: str
    tags: int
    links: float  # share of link text
    aside: bool
    soft: bool
    region: int  # number of the innermost article-like container, -1 outside
    parent: int


class _Open(NamedTuple):
    tag: str
    silent: bool
    aside: bool
    soft: bool
    region: int
    number: int


class _Lines(HTMLParser):
    """A page's lines. What is open is counted by name within the scope it is in, so a stray end tag costs nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open = [_Open("", False, False, False, -1, 0)]
        self.blocks: list[int] = []  # where in open the block and silent elements are
        self.scopes: list[Counter] = [Counter()]
        self.scoped: Counter = Counter()
        self.regions: list[int] = []  # of each region the one around it
        self.text: list[str] = []
        self.tags = self.numbers = self.in_link = self.link = 0

    def flush(self) -> None:
        if self.text:
            words = "".join(self.text).split()
            self.text = []
            if words:
                top = self.open[-1]
                self.lines.append(Line(" ".join(words), self.tags, self.link / sum(map(len, words)), top.aside, top.soft, top.region, top.number))
                self.tags = 0
            self.link = 0

    def push(self, element: _Open) -> None:
        tag = element.tag
        if tag in BLOCKS or tag in SILENT:
            self.blocks.append(len(self.open))
        self.open.append(element)
        self.in_link += tag == "a"
        if tag in _SCOPE:
            self.scoped[tag] += 1
            self.scopes.append(Counter())
        else:
            self.scopes[-1][tag] += 1

    def pop(self) -> str:
        tag = self.open.pop().tag
        if self.blocks and self.blocks[-1] == len(self.open):
            self.blocks.pop()
        self.in_link -= tag == "a"
        if tag in _SCOPE:
            self.scopes.pop()
            self.scoped[tag] -= 1
        else:
            self.scopes[-1][tag] -= 1
        return tag

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        block = tag in BLOCKS
        if block:
            self.flush()
            if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):
                self.close_implied(tag)
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, silent, aside, soft, region, number = self.open[-1]
        silent = silent or tag in SILENT
        if block or tag in SILENT or attrs:
            named = dict(attrs)
            role = ROLES.get((named.get("role") or "").strip().lower())
            if tag in REGION or role == "region":
                if not aside:
                    self.regions.append(region)
                    region = len(self.regions) - 1
            elif not aside and tag not in ("html", "body"):
                names = f"{named.get('class') or ''} {named.get('id') or ''}".strip()
                hidden = "hidden" in named or (named.get("aria-hidden") or "").lower() == "true"
                aside = tag in ASIDE or role == "aside" or hidden or tag == "header" and region < 0 or bool(names) and bool(ASIDE_NAMES.search(names))
                soft = soft or bool(names) and bool(SOFT_NAMES.search(names))
        self.numbers += 1
        self.push(_Open(tag, silent, aside, soft, region, self.numbers if block else number))

    def close_implied(self, tag: str) -> None:
        """A new paragraph, item or cell ends the open one of its kind, within the nearest container."""
        for k in reversed(self.blocks):  # at most a few: paragraphs and terms do not hold their own kind
            name = self.open[k].tag
            if name == tag:
                while len(self.open) > k:
                    self.pop()
                return
            if name in BLOCKS and name not in ("p", "dt", "dd") or name in SILENT:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if (self.scoped if tag in _SCOPE else self.scopes[-1])[tag] > 0:
            while self.pop() != tag:
                pass

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.open[-1].silent:
            self.text.append(data)
            if self.in_link:
                self.link += sum(map(len, data.split()))

    def close(self):
        if self.cdata_elem is None and _OPEN_END.match(self.rawdata):
            self.rawdata = ""
        super().close()
        self.flush()


def page_lines(html: str) -> tuple[list[Line], list[int]]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    return parser.lines, parser.regions


def clustered(sizes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines have a smoothed text-to-tag ratio in the content cluster."""
    ratio = sizes / np.maximum(tags, 1)
    padded = np.pad(ratio, RADIUS, mode="edge")
    smooth = np.convolve(padded, _KERNEL, mode="valid")
    return smooth >= smooth.std()


def menus(low: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Lines in runs of at least MENU that are outside the content cluster and mostly link text."""
    of = low & (links > 0.5)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], of.view(np.int8), [0]))))
    out = np.zeros(len(of), bool)
    for a, b in edges.reshape(-1, 2):
        out[a:b] = b - a >= MENU
    return out


def main_text(html: str | None) -> str:
    """The text of the page's content regions."""
    if not html:
        return ""
    lines, regions = page_lines(html)
    usable = np.array([not line.aside for line in lines], bool)
    if not usable.any():
        return ""
    content = clustered(np.array([len(line.text) for line in lines], np.float64), np.array([line.tags for line in lines], np.float64))
    usable &= content | ~np.array([line.soft for line in lines])
    usable &= ~menus(~content, np.array([line.links for line in lines]))
    region = np.array([line.region for line in lines])
    if (usable & (region >= 0)).any():
        outer = np.arange(len(regions))  # of each region the outermost around it; regions are numbered from outside in
        for k, around in enumerate(regions):
            if around >= 0:
                outer[k] = outer[around]
        within = np.where(region >= 0, outer[region], -1)
        held = usable & content & (region >= 0)
        if not held.any():
            held = usable & (region >= 0)
        chosen = usable & (region >= 0) & np.isin(within, within[held])
    else:
        chosen = usable & content
        if not chosen.any():
            chosen = usable
        if not chosen.any():
            return ""
        parents = {lines[k].parent for k in np.flatnonzero(chosen)}
        first, last = np.flatnonzero(chosen)[[0, -1]]
        for k in range(first, last + 1):
            chosen[k] |= bool(usable[k]) and lines[k].parent in parents
    return " ".join(lines[k].text for k in np.flatnonzero(chosen))


@F.arrow_udf(T.StringType())
def extract_text(html: pa.Array) -> pa.Array:
    return pa.array([main_text(h.decode()) for _, _, raw in text_groups(html) for h in raw], pa.string())


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """pages with the main text of each page and n_chars, its code points, in place of the html; columns of these names are replaced."""
    kept = [c for c in pages.columns if c not in (html_col, name, "n_chars")]
    out = pages.select(*kept, extract_text(F.col(html_col)).alias(name))
    return out.withColumn("n_chars", F.length(name).cast("long"))


def op6_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
