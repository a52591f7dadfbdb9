"""Main text of web pages by consensus host paths.

1. Each page is parsed and its containers are scored by the running text right inside them (text in links counts against it;
   menus, headers, footers, forms, asides, hidden elements and those whose class or id names such a thing don't count; attributes are
   read one by one, so a value never passes for a name). The best container's
   *generalised path*, tags and classes from the root with digits and positions taken out, is the page's vote.
2. Spark counts the votes; each host's path with the most votes wins (ties: the lesser path).
3. Each page is extracted again with its host's winning path; where that finds no text in the page, with the page's own.

Votes are counted with partial aggregation, so a host that a third of all pages are from is one row for each task. The winners
go to the pages by a broadcast only if they are ``BROADCAST_HOSTS`` and ``BROADCAST_BYTES`` at most, else by a join that adaptive execution can split.

Defined cases: null or blank html gives empty text; a null url is a host of its own; a page without any container is its body;
a page within one form isn't dropped with it; repeated rows are extracted each; an empty table gives an empty result; pages of any
length and depth are read whole, in linear time.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.shared import read, stored

BROADCAST_HOSTS, BROADCAST_BYTES = 100_000, 32 << 20
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.S)
#: One attribute: its whole name, and its value in quotes or without. What no name can begin with is passed over.
ATTRIBUTE = re.compile(r"""[\s/"'<>=]*([^\s/"'<>=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"']*)))?""", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article main section div td body center blockquote form fieldset table tbody tr li".split())
DROPPED = frozenset("nav aside footer form script style noscript template iframe button select option textarea svg canvas object head title dialog menu search label".split())
CLOSED_BY = {  # an open element of the key ends where one of these begins
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
    "p": BLOCK - {"br", "button", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "title", "html", "head", "body", "select"}, "head": {"body"},
}
#: Words of class names and ids. A name says that an element is no part of an article if, holders apart, its last word is of the first two kinds, or its
#: first is of the first kind and all others only say which one it is ("ad-box", "nav-main", but not "menu-of-the-day"). Words of the second
#: kind don't count of a part of an article ("site-header", but not "article-header" or "notice-board").
ALWAYS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar nav navbar navigation menu breadcrumb breadcrumbs footer comment comments disqus share sharing social cookie cookies popup modal newsletter subscribe signup login related recommended pagination pager".split())
AT_THE_END = frozenset("banner side aside header masthead respond reply replies consent notice alert overlay widget legal copyright disclaimer skip".split())
HOLDERS = frozenset("area bar block box container div group holder inner item items links list outer panel row section wrap wrapper".split())
WHICH = frozenset("main top bottom left right center primary secondary upper lower first last site page global mobile desktop sticky fixed inline button buttons btn icon icons form forms post posts article articles content contents stories card cards slot unit label title text thread author meta body id middle small large toggle bottomline media module".split())
PARTS = frozenset("article content entry main post story text body".split())


def boilerplate(names: str) -> bool:
    """Whether class names or an id say that an element is no part of an article."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_\d]+", name) if w]
        while len(words) > 1 and words[-1] in HOLDERS:
            words.pop()
        if not words:
            continue
        first, last, rest = words[0], words[-1], WHICH | HOLDERS | ALWAYS | AT_THE_END
        if last in ALWAYS or last in AT_THE_END and first not in PARTS or first in ALWAYS and all(w in rest or len(w) < 2 for w in words[1:]):
            return True
    return False


GOOD = re.compile(r"(?:^|[-_ ])(?:article|content|entry|main|post|story|text|body)(?:$|[-_ ])", re.I)
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())


#: Elements that a closing tag of an inline element doesn't reach across, and the share of a page's text beyond which a form is no form but the page.
SCOPES, WHOLE = frozenset(("article", "td", "body")), 0.5


class Page:
    """Elements in page order, and the text between tags; all in time and memory linear in the page.

    An element's texts are those from ``begin`` to ``stop``. Paths are nodes of a tree that pages' equal paths share: (parent, label) has a number.
    """

    def __init__(self, source: str):
        self.tag, self.good, self.own_bad, self.link, self.parent, self.holder, self.route = ["#"], [0], [False], [False], [-1], [0], [0]
        self.begin, self.stop = [0], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.labels: list[tuple[int, str]] = [(-1, "body")]
        self.said: list[tuple[int, str]] = []
        self.stack, self.blocks, self.scopes, self.opened = [0], [0], [], Counter()
        stack, at = self.stack, 0
        while m := TOKEN.search(source, at):
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in BLOCK:
                self.said.append((stack[-1], " "))
            if m[1]:
                if self.opened[tag]:
                    k = len(stack) - 1
                    low = self.scopes[-1] if self.scopes and tag not in BLOCK else 0
                    while k > low and self.tag[stack[k]] != tag:
                        k -= 1
                    if k > 0 and self.tag[stack[k]] == tag:
                        self._close(k)
                continue
            while len(stack) > 1 and self.blocks[-1] > 0 and tag in CLOSED_BY.get(self.tag[stack[self.blocks[-1]]], ()):
                self._close(self.blocks[-1])  # an unclosed inline element ends with the paragraph around it
            self._open(tag, m[3] or "")
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = stop.end() if stop else len(source)
                self._close(len(stack) - 1)
            elif tag in VOID or (m[3] or "").endswith("/") and tag not in BLOCK:
                self._close(len(stack) - 1)
        if at < len(source):
            self._text(stack[-1], source[at:])
        self._close(0)
        self._settle()

    def _text(self, node: int, raw: str) -> None:
        self.said.append((node, html.unescape(raw) if "&" in raw else raw))

    def _close(self, k: int) -> None:
        """Ends the open elements from the k-th on."""
        for x in self.stack[k:]:
            self.stop[x] = len(self.said)
            self.opened[self.tag[x]] -= 1
        del self.stack[k:]
        for held in (self.blocks, self.scopes):
            while held and held[-1] >= k:
                held.pop()

    def _open(self, tag: str, attributes: str) -> None:
        names, hidden, role, label = "", False, "", tag
        seen: set[str] = set()
        for a in ATTRIBUTE.finditer(attributes) if attributes else ():
            key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if key in seen:
                continue  # the first of a name counts
            seen.add(key)
            if key == "class":
                label += "".join("." + c for c in sorted({re.sub(r"[\d>]+", "", c) for c in value.lower().split()}) if c)
            if key in ("class", "id"):
                names += " " + value
            hidden |= key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and bool(INVISIBLE.search(value))
            role = value.lower() if key == "role" else role
        up, me = self.stack[-1], len(self.tag)
        inside = self.opened["article"] + self.opened["main"] > 0
        bad = tag in DROPPED or hidden or role in ROLES or (tag not in ("html", "body", "article", "main") and boilerplate(names)) or (tag == "header" and not inside)
        self.tag.append(tag)
        if tag in ("html", "body"):  # these two may be left out in a page
            self.route.append(0)
        else:
            step = (self.route[up], label)
            if step not in self.paths:
                self.paths[step] = len(self.labels)
                self.labels.append(step)
            self.route.append(self.paths[step])
        self.good.append((tag in ("article", "main") or role in ("main", "article")) * 2 + bool(GOOD.search(names)))
        self.own_bad.append(bad)
        self.link.append(tag == "a" or self.link[up])
        self.parent.append(up)
        self.holder.append(me if tag in CONTAINER else self.holder[up])
        self.begin.append(len(self.said))
        self.stop.append(len(self.said))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.opened[tag] += 1
        self.stack.append(me)

    def _settle(self) -> None:
        """What is dropped: for each element the nearest one around it that is (0: none). A form with most of the page's text isn't."""
        sums = [0]
        for _, t in self.said:
            sums.append(sums[-1] + len(t.strip()))
        self.bad = [0]
        for k in range(1, len(self.tag)):
            drop = self.own_bad[k] and not (self.tag[k] == "form" and sums[self.stop[k]] - sums[self.begin[k]] > WHOLE * sums[-1])
            self.bad.append(k if drop else self.bad[self.parent[k]])

    def path(self, node: int) -> str:
        """The generalised path of an element: tags and classes from the root."""
        steps, at = [], self.route[node]
        while at >= 0:
            at, label = self.labels[at]
            steps.append(label)
        return ">".join(reversed(steps))

    def best(self) -> int:
        """The container with the highest score: 0, the whole page, if there is none."""
        score: dict[int, float] = {}
        for node, text in self.said:
            if self.bad[node] or not (n := len(text.strip())):
                continue
            worth, up, share = (-0.5 if self.link[node] else 1.0) * n, self.holder[node], 1.0
            while up > 0 and share > 0.2:  # the container right around the text, then those around it
                score[up] = score.get(up, 0) + worth * share
                share *= 0.6
                up = self.holder[self.parent[up]]
        top = max(score, key=lambda x: (score[x] * (1 + 0.5 * self.good[x]), -x), default=0)
        return top if score.get(top, 0) > 0 else 0

    def text(self, nodes: list[int]) -> str:
        out = []
        for c in nodes:
            first, end = (self.begin[c], self.stop[c]) if c else (0, len(self.said))
            out.append("".join(t if self.bad[k] == self.bad[c] else " " for k, t in self.said[first:end]))
        return " ".join(" ".join(out).split())

    def at(self, path: str) -> list[int]:
        """The outermost elements with a generalised path, in page order."""
        route = 0
        for label in path.split(">")[1:]:
            if (route := self.paths.get((route, label), -1)) < 0:
                return []
        if not route:
            return [0]
        found: list[int] = []
        for k, r in enumerate(self.route):
            if r == route and not (found and self.begin[k] < self.stop[found[-1]]):
                found.append(k)
        return found


def extract(source: str | None, path: str | None = None) -> str:
    """The main text with a host's path, or the page's own best container."""
    page = Page(source or "")
    if path:
        found = [k for k in page.at(path) if not page.bad[k]]
        if found and (text := page.text(found)):
            return text
    return page.text([page.best()])


def host(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path): each page's vote, from columns host and html."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = []
            for source in b.column(1):
                page = Page(source.as_py() or "")
                paths.append(page.path(page.best()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], ["host", "path"])

    return pages.select("host", "html").mapInArrow(rows, "host string, path string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages`` (page_id, url, html)."""
    own = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    counted = votes(own).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    winners = stored(counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), F.col("path"))).alias("path")), "paths")
    hosts, size = winners.agg(F.count(F.lit(1)), F.sum(F.octet_length("host") + F.octet_length("path"))).first()
    few = hosts <= BROADCAST_HOSTS and (size or 0) <= BROADCAST_BYTES

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(h.as_py(), p.as_py()) for h, p in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = own.join(F.broadcast(winners) if few else winners, "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(rows, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
