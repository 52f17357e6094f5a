"""Main text of web pages by composite text density (Sun, Song, Liao; SIGIR 2011).

A page becomes a tree of blocks. Every node gets its characters C, tags T, link characters LC and link tags LT, and from
them its link-adjusted density; the node whose children's densities sum to the most is the core of the article, whatever
its tag. Marked articles are a hint that the density can overrule: one that the core stands in is taken whole, and where
the core holds marked articles of most of its plain text, these are the core. The threshold is the least density on the
path from the body to the core. Besides the core, every part of the page goes out that isn't mostly links and reaches half
the threshold, be it a sibling of the core or right under the body. Parts that are never an article (menus, forms and so on) are
taken out beforehand. So are parts named as such (adverts, reader comments, sidebars and so on): a name counts if all of it
says so, as in "post-comments", but not "has-sidebar" or "related-work"; and not if the part has a heading or a marked article
and most of the page's plain text. Where names or links would leave nothing, they are passed over.

Reading is linear in the page: no scan passes a character more than a few times, and open tags are found by index.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from almoneda.llm.shared import free_name, map_rows

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template svg canvas xmp annotation annotation-xml noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main "
    "menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br caption option".split()
)
#: Parts that are never the article.
DROPPED = frozenset("head nav aside form footer menu button select dialog input label fieldset".split()) | RAW
#: Shown only where scripts or plug-ins are missing: page furniture, unless it stands within the article.
FALLBACK = frozenset("noscript object".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that name a part which is not the article, if the rest of the name, if any, is of PLAIN words. A header is no such
#: word: articles have headers.
NOISE = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsors sponsored promo promos promotion promoted banner banners nav navbar navigation menu menus submenu "
    "breadcrumb breadcrumbs sidebar sidebars side aside foot footer footers masthead cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter newsletters subscribe "
    "subscription signup login comment comments commentlist disqus replies reply respond responses share sharing shares sharedaddy social socials related recommend recommended recommendation "
    "recommendations pagination pager widget widgets toolbar search searchbar searchbox skip copyright legal taboola outbrain paywall".split()
)
PLAIN = frozenset(
    "area bar block body bottom box button buttons card cards container content column col entry footer form frame google grid group holder icon icons inner inline item items layer left link links list "
    "main media message module outer page panel policy post posts row right section site slot stories story text thread title top unit wrap wrapper articles article blog news prompt cta".split()
)
_PIECES = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|\d+")
#: An open tag that these start tags end, and the tags beyond which they don't look. A paragraph ends at any block.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table html body div section article main aside nav header footer form td th blockquote".split())

#: A start tag, whose quoted values may hold `<` and `>`; quotes that don't follow `=` or don't end are plain characters.
_START = re.compile(r"<([a-zA-Z][^\s/<>]*)((?:[^<>\"'=]|=\s*+\"[^\"]*\"|=\s*+'[^']*'|[\"'=])*+)>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/<>]*)")
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: A comment that ends as it begins, and how others end.
_COMMENT, _COMMENT_END = re.compile(r"<!--(?:-?>)"), re.compile(r"--!?>")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Tags of text, whose names tell nothing of the part they stand in.
UNNAMED = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong a span".split())


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "sum", "dropped", "suspect", "named")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, suspect: bool = False, named: bool = False):
        self.tag, self.parent, self.items, self.dropped, self.suspect = tag, parent, [], dropped or suspect, suspect and not dropped
        self.named = named and not self.dropped
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _attributes(text: str) -> dict[str, str]:
    """Attributes of a start tag, names lowered; the first of a name counts."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        found.setdefault(m[1].lower(), next((x for x in (m[2], m[3], m[4]) if x is not None), ""))
    return found


def _noise(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether a start tag opens a part that is not the article. A header inside an article belongs to it."""
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    if attrs.get("role", "").lower() in ROLES or attrs.get("aria-hidden") == "true" or "hidden" in attrs or _INVISIBLE.search(attrs.get("style", "")):
        return True
    return attrs.get("itemprop", "").lower() == "comment" or attrs.get("itemtype", "").lower().endswith("/comment")


def _named(tag: str, attrs: dict[str, str]) -> bool:
    """Whether a class or the id names a part that is not the article: one of NOISE, and nothing else but PLAIN words."""
    if not attrs or tag in UNNAMED or tag in ("html", "body", "main"):
        return False
    for token in " ".join(attrs.get(k, "") for k in ("class", "id")).split():
        pieces = [x.lower() for x in _PIECES.findall(token) if not x.isdigit()]
        if any(x in NOISE for x in pieces) and all(x in NOISE or x in PLAIN for x in pieces):
            return True
    return False


class _Open:
    """The open nodes, and for each tag their places among them, so that no search climbs the tree."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.scopes, self.inside = [root], {}, [0], 0

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in SCOPE:
            self.scopes.append(len(self.nodes))
        self.inside += node.tag in ("article", "main")
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """Closes the node at a place and all within it."""
        while len(self.nodes) > place:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            self.inside -= tag in ("article", "main")

    def outermost(self, tags: tuple[str, ...], beyond: int) -> int | None:
        """The first place after `beyond` that one of the tags has."""
        found = []
        for tag in tags:
            places = self.places.get(tag, [])
            i = bisect_right(places, beyond)
            found += places[i : i + 1]
        return min(found, default=None)


def _raw_end(page: str, tag: str, pos: int) -> int:
    """Where the content of a raw tag ends, -1 if it doesn't. Templates and drawings nest."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, pos):
        if m[1]:
            depth -= 1
        elif tag in ("template", "svg") and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return -1


def parse(page: str) -> Node:
    """The tree of a page, whatever its markup: open tags end at their parent's end, stray end tags are ignored.

    A `<` that opens no tag is text, and so is one whose tag never ends.
    """
    root = Node("html", None)
    open_, pos, mark, size = _Open(root), 0, 0, len(page)
    endless: set[str] = set()  # raw tags that have no end tag in what is left

    def text(upto: int) -> None:
        if upto > mark:
            piece = page[mark:upto]
            open_.nodes[-1].items.append(html.unescape(piece) if "&" in piece else piece)

    while True:
        begin = page.find("<", pos)
        if begin < 0 or begin + 1 >= size:
            text(size)
            return root
        c = page[begin + 1]
        if c in "!?":
            text(begin)
            ended = _COMMENT.match(page, begin) or _COMMENT_END.search(page, begin + 4) if page.startswith("<!--", begin) else None
            end = ended.end() if ended else -1 if page.startswith("<!--", begin) else page.find(">", begin) + 1
            pos = mark = end if end > 0 else size
            continue
        name = _NAME.match(page, begin)
        if not name:
            pos = begin + 1
            continue
        start = _START.match(page, begin) if c != "/" else None
        end = start.end() - 1 if start else page.find(">", name.end())
        if end < 0:  # no tag ends from here on
            text(size)
            return root
        text(begin)
        pos = mark = end + 1
        tag = name[1].lower()
        if c == "/":
            place = open_.places.get(tag, [])
            if place and not (tag in BLOCK and tag not in SCOPE and place[-1] < open_.scopes[-1]):
                open_.close(place[-1])
            elif tag == "p":
                open_.nodes[-1].items.append(Node("p", open_.nodes[-1]))
            continue
        given = page[name.end() : end]
        if tag in RAW:
            end = -1 if tag in endless or given.endswith("/") and tag == "svg" else _raw_end(page, tag, pos)
            if given.endswith("/") and tag == "svg":
                continue
            if end >= 0:
                pos = mark = end
            else:
                endless.add(tag)
                pos = mark = size if tag in ("script", "style", "textarea", "title") else pos
            continue
        if tag in ("html", "body"):  # one body: a page may leave it out or repeat it
            continue
        if tag in BLOCK and tag != "br":
            ends = CLOSES.get(tag, ())
            place = open_.outermost(("p", *ends), open_.scopes[-1])
            if place is not None:
                open_.close(place)
            if tag in ("td", "th", "tr"):
                place = open_.outermost(ends, open_.places.get("table", [0])[-1] if open_.places.get("table") else 0)
                if place is not None:
                    open_.close(place)
        attrs = _attributes(given) if given.strip(" /\t\n") else {}
        at = open_.nodes[-1]
        node = Node(tag, at, _noise(tag, attrs, bool(open_.inside)), tag in FALLBACK, _named(tag, attrs))
        at.items.append(node)
        if tag not in VOID and not given.endswith("/"):
            open_.push(node)


def _weigh(root: Node) -> list[Node]:
    """Counts of every kept node, children before parents; returned in that order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.items if isinstance(x, Node) and not x.dropped]
    order.reverse()
    for node in order:
        own = len(" ".join("".join([x for x in node.items if isinstance(x, str)]).split()))
        kids = [x for x in node.items if isinstance(x, Node) and not x.dropped]
        node.chars = own + sum(k.chars for k in kids)
        node.tags = len(kids) + sum(k.tags for k in kids)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, 1 + sum(k.link_tags for k in kids)
        else:
            node.link_chars, node.link_tags = sum(k.link_chars for k in kids), sum(k.link_tags for k in kids)
    return order


def _is_text(part: Node) -> bool:
    """Whether a fallback within the article belongs to it: not if it is mostly links."""
    _weigh(part)
    return part.link_chars <= 0.5 * part.chars


def _drop_named(root: Node) -> None:
    """Takes out the parts that are named as no article, but for those with a heading or a marked article and most of the
    page's plain text, which are wrappers."""
    order, heads = _weigh(root), set()
    plain = lambda n: n.chars - n.link_chars
    for node in order:  # children before parents
        if node.parent is not None and (node in heads or node.tag in ("h1", "article", "main") and not node.named):
            heads.add(node.parent)
    for node in order:
        if node.named and not (node in heads and 2 * plain(node) > plain(root)):
            node.dropped = True


def densities(root: Node) -> list[Node]:
    """Link-adjusted density and the sum of the children's for every kept node; the nodes, children before parents."""
    order = _weigh(root)
    body_links, body_chars = root.link_chars or 1, root.chars or 1
    for node in order:
        c, t, lc, lt = node.chars, node.tags or 1, node.link_chars, node.link_tags or 1
        if not c:
            continue
        plain = max(c - lc, 1)
        base = math.log(c / plain * lc + body_links / body_chars * c + math.e)
        ratio = c / max(lc, 1) * t / lt
        node.density = c / t * max(math.log(ratio), 0.0) / base if ratio > 0 else 0.0
    for node in order:
        node.sum = sum(k.density for k in node.items if isinstance(k, Node) and not k.dropped)
    return order


def _core(root: Node, peak: Node, order: list[Node]) -> set[Node]:
    """The peak, or what marks make of it: the outermost marked article it stands in, or those in it if they hold most of
    its plain text."""
    marked = ("article", "main")
    plain = lambda n: n.chars - n.link_chars
    node, found = peak, None
    while node is not None:
        found = node if node.tag in marked and node.link_chars <= 0.6 * node.chars else found
        node = node.parent
    if found is not None:
        return {found}
    within, inside = {peak}, set()  # inside: of a marked article
    for n in reversed(order):  # parents before children
        if n.parent in within:
            within.add(n)
            if n.parent in inside or n.parent.tag in marked:
                inside.add(n)
    parts = {n for n in within if n.tag in marked and n not in inside and n.link_chars <= 0.6 * n.chars}
    return parts if parts and 2 * sum(map(plain, parts)) >= plain(peak) else {peak}


def extract(page: str | None) -> str:
    """The main text of a page: blocks in page order, one space between, white space inside a block one space."""
    if not page:
        return ""
    root = parse(page)
    _drop_named(root)
    text = _chosen(root)
    if not text:  # names and links tell nothing here
        stack = [root]
        while stack:
            node = stack.pop()
            node.dropped = node.dropped and not node.named
            stack += [x for x in node.items if isinstance(x, Node)]
        text = _chosen(root) or _chosen(root, lists=True)
    return text


def _chosen(root: Node, lists: bool = False) -> str:
    """What density chooses of a tree; with lists, parts that are mostly links too."""
    order = densities(root)
    peak = max(order, key=lambda n: (n.sum, n.chars))
    least, node = peak.density, peak
    while node is not None:
        least = min(least, node.density)
        node = node.parent
    listed = lambda n: not lists and n.link_chars > 0.6 * n.chars
    core = _core(root, peak if peak.sum else root, order)
    above = set()  # holds a part of the core
    for n in core:
        while n.parent is not None and n.parent not in above:
            n = n.parent
            above.add(n)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    # A mean lies above half of what it is the mean of, so beside the core prose counts from half the threshold on.
    stack: list = [(root, root in core)]
    while stack:
        x, whole = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            flush()
        elif not x.dropped or x.suspect and whole and _is_text(x):
            if whole and x not in core and x.tag in BLOCK and x.chars and listed(x) and x.density < least:
                continue  # below the threshold and mostly links: a list of links within the article
            whole = whole or x in core or x not in above and x.chars > 0 and not listed(x) and x.density >= least / 2
            if x.tag in BLOCK:
                flush()
                stack.append((None, whole))
            own = whole or x in above and x.density >= least / 2
            stack += [(k, whole) for k in reversed(x.items) if own or isinstance(k, Node)]
    flush()
    return " ".join(blocks)


def main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text of each as last column (underscores appended to its name if pages has it).

    - A null page, an empty one and one without text have an empty text. Pages of any length are read whole.
    - Repeated rows are each given their text. An empty table gives an empty table.
    """
    schema = T.StructType([*pages.schema.fields, T.StructField(free_name(pages.columns, text_col), T.StringType())])
    at = pages.columns.index(html_col)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                p = batch.slice(i, 200)
                yield pa.RecordBatch.from_arrays([*p.columns, pa.array([extract(x.as_py()) for x in p.column(at)], pa.string())], schema.names)

    return map_rows(pages, run, schema)


def op1_main_text(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
