"""Main text of HTML pages by composite text density.

Every element gets a density: characters for each tag below it, lowered by the share that stands in links. An element's sum is what its children's densities
add up to; the element of the largest sum is the target. Where it stands in an article or main element, that is the main text. Elsewhere the least density on the
way from the target up to the body is the threshold: every element that reaches it marks the element of the largest sum at or below itself, headings of the first order mark
themselves, and the smallest subtree that holds all marks is the main text. What is no text of the article by its tag, role or class is taken out before.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

#: Elements that are never part of an article.
NO_TEXT = frozenset("head title script style noscript template nav footer aside form iframe object embed svg canvas audio video button select textarea input dialog menu map".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Names (or first or last parts of names joined by - or _) of classes and ids of what stands around an article.
NO_CLASS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay sidebar "
    "comment comments commentlist respond disqus share sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation topbar toolbar footer masthead widget widgets pagination pager login signup skip".split()
)
#: Names that count only by themselves, as parts of others they stand for headings of the article.
NO_CLASS_ALONE = frozenset("header side top bottom".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody tfoot thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = BLOCKS - frozenset("body caption html legend optgroup option tbody tfoot thead tr".split())
#: What else a start tag closes, and how far up to look for it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
} | {h: (_HEADINGS, BLOCKS - _HEADINGS) for h in _HEADINGS}
_OF_HEAD = frozenset("title meta link base script style noscript template".split())
_SPACE = re.compile(r"\s+")
#: A list of at least so many links, and at least this share of its characters in them, is a menu.
MENU_LINKS, MENU_SHARE = 3, 0.8


class _Page(HTMLParser):
    """A page as events in order: the number of an element where it begins, its complement where it ends, and strings. Elements are numbered as they begin."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.names, self.begin, self.end = ["html"], [-1], [()], [0], [0]
        self.events: list[int | str] = [0]
        self.path, self.count = [0], {"html": 1}
        self.feed(html)
        if re.match(r"<[!/?a-zA-Z]", self.rawdata):
            self.rawdata = ""  # cut off within a tag or comment
        self.close()
        while self.path:
            self._pop()

    def _pop(self) -> None:
        node = self.path.pop()
        self.count[self.tag[node]] -= 1
        self.end[node] = len(self.events)
        self.events.append(~node)

    def _close(self, tags, barrier) -> None:
        if not any(self.count.get(t) for t in tags):
            return
        for k in range(len(self.path) - 1, 0, -1):
            tag = self.tag[self.path[k]]
            if tag in tags:
                while len(self.path) > k:
                    self._pop()
                return
            if tag in barrier:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "html" or (tag == "body" and "body" in self.count):
            return
        if self.count.get("head") and tag not in _OF_HEAD:
            self._close({"head"}, ())
        if tag in _CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.path[-1])
        self.names.append([(k, v or "") for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")])
        self.begin.append(len(self.events))
        self.end.append(0)
        self.events.append(node)
        self.path.append(node)
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in VOID and tag not in ("html", "body"):
            # an inline element's end doesn't end the block around its start
            self._close({tag}, () if tag in BLOCKS or tag == "head" else BLOCKS)

    def handle_data(self, data):
        self.events.append(data)


def _named(names) -> bool:
    """Is the element something that stands around an article, by its role, class or id, or hidden?"""
    for k, v in names:
        v = v.lower()
        if k == "role":
            if v.strip() in NO_ROLE:
                return True
        elif k == "hidden" or (k == "aria-hidden" and v.strip() == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v)):
            return True
        elif k in ("class", "id"):
            for name in v.split():
                parts = re.split("[-_]+", name)
                if name in NO_CLASS_ALONE or parts[0] in NO_CLASS or parts[-1] in NO_CLASS:
                    return True
    return False


def _left_out(page: _Page) -> list[bool]:
    """For each element whether it is out by itself. What holds the page's article or main element is out by its tag only."""
    n = len(page.tag)
    named = [_named(x) for x in page.names]
    inside, holds = [False] * n, [False] * n
    for i in range(1, n):
        inside[i] = inside[page.parent[i]] or page.tag[i] in ("article", "main")
    for i in range(n - 1, 0, -1):
        if holds[i] or (page.tag[i] in ("article", "main") and not named[i]):
            holds[page.parent[i]] = True
    out = []
    for i, tag in enumerate(page.tag):
        by_tag = tag in NO_TEXT or (tag == "header" and not inside[i])
        out.append(tag not in ("html", "body") and (by_tag or (named[i] and tag != "main" and not (holds[i] and tag != "article"))))
    return out


def _density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Characters a tag, the less the more of them are in links (body_share: of the whole page's)."""
    t = tags or 1
    plain = chars / t
    if not chars:
        return 0.0
    base = math.log(chars * link_chars / max(1, chars - link_chars) + body_share * chars + math.e)
    if base <= 1.0:  # a page without links
        return plain
    return plain * math.log(chars / (link_chars or 1) * t / (link_tags or 1), base)


def main_text(html: str) -> str:
    """The blocks of the main text, one line each; no text, no lines."""
    page = _Page(html)
    n = len(page.tag)
    gone = _left_out(page)
    # what stands in links, and what is left out with its parents
    linked, dead = [False] * n, gone[:]
    for i in range(1, n):
        up = page.parent[i]
        linked[i] = linked[up] or page.tag[i] == "a"
        dead[i] = dead[i] or dead[up]
    chars, tags, link_chars, link_tags, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    at = [0]
    for e in page.events:
        if isinstance(e, str):
            if not dead[at[-1]]:
                own[at[-1]] += len(_SPACE.sub(" ", e.strip()))
        elif e >= 0:
            at.append(e)
        else:
            at.pop()
    for i in range(n - 1, -1, -1):
        if dead[i]:
            continue
        chars[i] += own[i]
        link_chars[i] += own[i] if linked[i] else 0
        up = page.parent[i]
        if page.tag[i] in ("ul", "ol", "dl", "div", "section", "table", "p") and link_tags[i] >= MENU_LINKS and link_chars[i] >= MENU_SHARE * chars[i]:
            gone[i] = True  # a list of links
            continue
        if up >= 0:
            chars[up] += chars[i]
            tags[up] += tags[i] + 1
            link_chars[up] += link_chars[i]
            link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    for i in range(1, n):
        dead[i] = gone[i] or dead[page.parent[i]]
    if not chars[0]:
        return ""
    share = link_chars[0] / chars[0]
    density = [0.0 if dead[i] else _density(chars[i], tags[i], link_chars[i], link_tags[i], share) for i in range(n)]
    # only what has blocks below it has a sum; text of its own beside them counts as a child does
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        if not dead[i] and page.tag[i] in BLOCKS:
            holds[page.parent[i]] = True
        elif holds[i]:
            holds[page.parent[i]] = True
    total = [_density(own[i], 0, own[i] if linked[i] else 0, 0, share) if holds[i] and not dead[i] else 0.0 for i in range(n)]
    for i in range(n - 1, 0, -1):
        if holds[page.parent[i]]:
            total[page.parent[i]] += density[i]
    live = [i for i in range(n) if not dead[i]]
    inside = lambda i, j: page.begin[j] <= page.begin[i] and page.end[i] <= page.end[j]
    target = max(live, key=lambda i: (total[i], -i))
    articles = [i for i in live if page.tag[i] in ("article", "main") and chars[i]]
    if articles:
        # the outermost that holds the target, else the largest: whole, as its short paragraphs would fall below any threshold
        return "\n".join(_blocks(page, gone, next((i for i in articles if inside(target, i)), max(articles, key=lambda i: (chars[i], -i)))))
    top = next((i for i in live if page.tag[i] == "body" and inside(target, i)), 0)
    threshold, up = density[target], target
    while up != top:
        up = page.parent[up]
        threshold = min(threshold, density[up])
    # the largest sum at or below each element; of equal ones the outermost
    best = list(range(n))
    within = [i for i in live if inside(i, top)]
    for i in reversed(within):
        up = page.parent[i]
        if i != top and total[best[i]] > total[best[up]]:
            best[up] = best[i]
    marked = [best[i] for i in within if chars[i] and (density[i] >= threshold or page.tag[i] == "h1")]
    first, last = min(page.begin[i] for i in marked), max(page.end[i] for i in marked)
    chosen = marked[0]
    while page.begin[chosen] > first or last > page.end[chosen]:
        chosen = page.parent[chosen]
    return "\n".join(_blocks(page, gone, chosen))


def _blocks(page: _Page, gone: list[bool], chosen: int):
    words: list[str] = []
    k, stop = page.begin[chosen], page.end[chosen]
    while k <= stop:
        e = page.events[k]
        k += 1
        if isinstance(e, str):
            words.append(e)
            continue
        node = e if e >= 0 else ~e
        tag = page.tag[node]
        if e >= 0 and gone[node] and node != chosen:
            k = page.end[node] + 1
        elif tag in ("br", "td", "th"):
            words.append(" ")
            continue
        elif tag not in BLOCKS:
            continue
        if tag in BLOCKS and words:
            text = _SPACE.sub(" ", "".join(words)).strip()
            words = []
            if text:
                yield text
    text = _SPACE.sub(" ", "".join(words)).strip()
    if text:
        yield text


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages(page_id, url, html).

    Whole pages are parsed, of any length; a page is held in memory as a tree. Character references are decoded, white space within a block is one space, blocks are
    lines in page order. A null or empty page has an empty text; rows repeat as they do in the table; ids and urls may be null. Other columns
    are not read. An empty table gives no rows.
    """

    def run(batches):
        for whole in batches:
            for b in slices(whole, column="html"):
                text = [main_text(x) if x else "" for x in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
