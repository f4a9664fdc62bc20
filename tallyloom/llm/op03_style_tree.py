"""Main text of web pages by a site style tree.

Pages of one host are merged node by node: a node of the merged tree is a path of tags with their classes.  Over the host's
different pages each node has a distribution of presentations (its children) and of contents (the text of its branch).
Both entropies, over the logarithm of the number of pages, give its importance: a branch that looks and reads the same on
page after page has little.  A low branch goes from the pages on which it reads as on many others, unless it is nearly all
that the page says, together with branches whose tag, class or role says menu, header, footer, sidebar, notice, advert, form
or reader comments; what is marked as the article stays, however often a host repeats it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Weight of the content's entropy; importance below which a branch goes; pages that must share a branch for that.
CONTENT_WEIGHT, LEAST, MIN_PAGES = 0.8, 0.25, 8
#: A low branch goes where it reads as on one page in so many; the largest stays if it is so many times longer than the rest.
SHARED, LONGER = 64, 4

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_DROP = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea input label iframe object embed svg canvas audio video dialog menu search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside "
    "header masthead footer foot copyright legal cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended widget toolbar pagination pager skip search form".split())
#: With a mark before them these make a known class inside an article.
_PARTS = frozenset("list box slot unit buttons links bar posts".split())
_HEADS = frozenset("section h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = _BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "figcaption", "legend", "summary"}
_SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table article section div main body html td th".split())
_WORD = re.compile(r"[a-z]+")
_MASK = (1 << 64) - 1


def _words(value: str) -> list[str]:
    return _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())


def _names(attrs: dict) -> list[str]:
    return _words(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")


def _named(tag: str, attrs: dict, names: list[str], main: bool) -> bool:
    """Class or id names what is not main text: any word of them, but inside an article whole classes only.

    The id of a heading or section is made from its title, so it names nothing.
    """
    if tag in ("html", "body", "main"):
        return False
    if not main:
        return any(n in _MARKS for n in (_words(attrs.get("class") or "") if tag in _HEADS else names))
    known = map(_words, (attrs.get("class") or "").split())
    return any(w and w[0] in _MARKS and all(x in _MARKS or x in _PARTS for x in w[1:]) for w in known)


class Page(HTMLParser):
    """Nodes of a page with their path in the style tree, and its text pieces; tolerant of missing end tags."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.path, self.parent, self.noise, self.main = [0], [-1], [False], [False]
        self.kids: list[list[int]] = [[]]
        self.content = [0]
        self.pieces: list[tuple[int, str]] = []  # node and text; an empty text is a break between blocks
        self.open: list[tuple[str, int]] = []
        self.top = 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.pieces.append((self.top, " "))
            return
        if tag in _BLOCK:
            if tag in _CLOSES_P:
                self._end(("p",), _SCOPE)
            if tag in _SAME_LEVEL:
                self._end(_SAME_LEVEL[tag], frozenset(("ul", "ol", "dl", "table")))
            self.pieces.append((self.top, ""))
        attrs = dict(attrs)
        names = _names(attrs)
        node, main = len(self.path), self.main[self.top]
        mark = " ".join([tag, *sorted(set(names))])
        own_main = tag in ("article", "main") or (attrs.get("role") or "").lower() == "main" or attrs.get("itemprop") == "articleBody"
        named = _named(tag, attrs, names, main or own_main)
        noise = tag in _DROP or named or (attrs.get("role") or "").lower() in _ROLES or (tag == "header" and not main) or "hidden" in attrs
        self.path.append(xxhash.xxh64_intdigest(mark, self.path[self.top]))
        self.parent.append(self.top)
        self.noise.append(self.noise[self.top] or noise)
        self.main.append(main or own_main)
        self.kids.append([])
        self.content.append(0)
        self.kids[self.top].append(self.path[node])
        if tag not in _VOID:
            self.open.append((tag, node))
            self.top = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open and self.open[-1][0] == tag and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.pieces.append((self.top, ""))
        self._end((tag,), frozenset(("body", "html")) - {tag} if tag not in ("p", "li") else _SCOPE - {tag})

    def _end(self, tags, fence):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                del self.open[k:]
                self.top = self.open[-1][1] if self.open else 0
                return
            if self.open[k][0] in fence:
                return

    def handle_data(self, data):
        if data and not data.isspace():
            h, node = xxhash.xxh64_intdigest(" ".join(data.split())), self.top
            while node >= 0:
                self.content[node] = (self.content[node] * 31 + h) & _MASK
                node = self.parent[node]
        self.pieces.append((self.top, data))

    def styles(self) -> dict[int, tuple[int, int]]:
        """Path to presentation and content of its nodes together, on this page."""
        out: dict[int, tuple[int, int]] = {}
        for node, path in enumerate(self.path):
            look, read = out.get(path, (0, 0))
            for kid, before in zip(self.kids[node], [None, *self.kids[node]]):
                if kid != before:  # a run of like children is one
                    look = (look * 1000003 + kid) & _MASK
            out[path] = (look, (read * 31 + self.content[node]) & _MASK)
        return out

    def text(self, low: frozenset[int] = frozenset()) -> str:
        """Blocks of the main text, white space inside a block as one space, joined by an empty line.

        ``low`` holds path ^ read of the branches that many pages of the host share.
        """
        articles = any(m and not n for m, n in zip(self.main, self.noise))
        shared = {path for path, (_, read) in self.styles().items() if path ^ read in low} if low else set()
        gone = [False] * len(self.path)
        holds = [False] * len(self.path)  # an article stands inside
        under = [0] * len(self.path)  # path of the outermost low branch
        for node in range(len(self.path) - 1, 0, -1):
            if self.main[node] or holds[node]:
                holds[self.parent[node]] = True
        for node in range(1, len(self.path)):
            gone[node] = gone[self.parent[node]] or self.noise[node]
            under[node] = under[self.parent[node]] or (self.path[node] if self.path[node] in shared and not self.main[node] and not holds[node] else 0)
        size = {0: 0}
        for node, piece in self.pieces if shared else ():
            if not gone[node] and (self.main[node] or not articles):
                size[under[node]] = size.get(under[node], 0) + len(piece.strip())
        largest = max(size, key=lambda k: size[k] if k else -1)
        stays = (0, largest) if size[largest] > LONGER * size[0] else (0,)
        blocks, held = [], []
        for node, piece in self.pieces:
            if piece == "":
                if held:
                    blocks.append("".join(held))
                    held = []
            elif not gone[node] and under[node] in stays and (self.main[node] or not articles):
                held.append(piece)
        blocks.append("".join(held))
        return "\n\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def host(url: Column) -> Column:
    """Host of an address in lower case; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def style_nodes(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, path, page, look, read): one row per style node of a page; page is a hash of all it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.steps(batches, "html"):
            cols: list[list] = [[], [], [], [], []]
            for h, t in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                if not h or not t:
                    continue
                page = Page(t)
                for path, (look, read) in page.styles().items():
                    for c, v in zip(cols, (h, _signed(path), _signed(page.content[0]), _signed(look), _signed(read))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(cols)], ["host", "path", "page", "look", "read"])

    rows = pages.select(host(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "host string, path bigint, page bigint, look bigint, read bigint")


def importance(nodes: DataFrame) -> DataFrame:
    """(host, path, pages, look, read, importance) over the different pages of a host.

    Entropies come from counts per distinct feature, which are aggregated before anything meets, so a host with very many
    pages is one row per task and feature.
    """
    different = nodes.distinct()

    def entropy(feature: str) -> DataFrame:
        counts = different.groupBy("host", "path", feature).agg(F.count(F.lit(1)).alias("n"))
        sums = counts.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
        value = F.when(F.col("pages") > 1, (F.log("pages") - F.col("nlogn") / F.col("pages")) / F.log("pages")).otherwise(1.0)
        return sums.select("host", "path", "pages", value.alias(feature))

    both = entropy("look").join(entropy("read").drop("pages"), ["host", "path"])
    return both.withColumn("importance", (1 - CONTENT_WEIGHT) * F.col("look") + CONTENT_WEIGHT * F.col("read"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, text (empty if there is none), n_chars.

    Null or empty html gives an empty text; a page without a host is cleaned by its own tags alone; repeated pages count
    once in the tree and each gets its text.  Only branches that ``MIN_PAGES`` different pages share can be low, each in at
    most ``SHARED`` readings, so a host's list of low branches is a small part of its nodes.
    """
    nodes = common.stored(style_nodes(pages, url, html), "style-nodes")
    little = importance(nodes).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < LEAST)).select("host", "path", "pages")
    reads = nodes.distinct().groupBy("host", "path", "read").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES)
    alike = reads.join(little, ["host", "path"]).where(F.col("n") * SHARED >= F.col("pages"))
    low = alike.groupBy("host").agg(F.sort_array(F.collect_list(F.col("path").bitwiseXOR(F.col("read")))).alias("low"))
    kind = pages.select(key).dtypes[0][1]
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), host(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, branches = None, frozenset()
        for b in common.steps(batches, "html"):
            text = []
            for t, paths in zip(b.column("html").to_pylist(), b.column("low").to_pylist()):
                if paths != last:
                    last, branches = paths, frozenset(p & _MASK for p in paths or ())
                text.append(Page(t).text(branches) if t else "")
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["key", "url", "text", "n_chars"])

    out = rows.join(low, "host", "left").select("key", "url", "html", "low").mapInArrow(run, f"key {kind}, url string, text string, n_chars bigint")
    return out.withColumnRenamed("key", key).withColumnRenamed("url", url)
