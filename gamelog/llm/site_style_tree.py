"""Main text of web pages by a site style tree.

The element trees of a host's pages merge into one tree: a node is a path of element labels
(tag and class tokens). Over the pages that hold it, a node has the entropy of its child
sequences (presentation) and of its text blocks (content). On a page, a branch's composite
importance mixes its own entropy with that of its branches; branches of low importance go.

Labels are part of the evidence: a branch whose tag, role or class says menu, advert, form
and so on has no importance, and an article stays whatever its importance, because a host
with one page has no entropy and copies of one article on a host have none between them. It
gives way only to a longer text of importance outside of it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.tables import NULL_ID, id_of, join_hot, stored
from gamelog.llm.textbytes import row_slices, utf8

DAMPING = 0.9
#: Branches below this composite importance are removed (where labels do not decide).
LEAST_IMPORTANCE = 0.2

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; the text up to the end tag is one piece.
RAW = frozenset(
    "script style noscript template iframe textarea xmp noembed noframes svg title datalist object audio video canvas".split()
)
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog head search fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adbox adslot adunit adbanner adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies cookiebar cookiebanner consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login sidebar sidebars aside nav navbar sidenav subnav topnav navigation menu menus breadcrumb breadcrumbs pagination pager "
    "toolbar topbar footer comment comments commentlist commentform respond disqus replies share sharing social related recommended "
    "widget widgets masthead copyright form search skip".split()
)
#: Words that name a container and say nothing of what is in it.
CONTAINER_WORDS = frozenset(
    "area bar block box btn button buttons container content group holder inner item items left link links list main outer page panel "
    "post posts reader right section site slot top bottom user users wrap wrapper zone".split()
)
#: Words that make a part furniture where its id may as well come from a heading.
PLAIN_WORDS = frozenset("ad ads advert advertisement comment comments commentlist cookie cookies disqus footer nav navbar respond sidebar".split())
#: Elements that class and id never make furniture; nor do they what is around a body or main part.
TEXT_TAGS = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
#: Elements whose id names a place on the page; other ids are made from headings.
PLACES = frozenset("div ul ol table td".split())
#: Pages that must hold a branch of an article before entropy may remove it there.
EVIDENCE = 4
#: A part named header is furniture unless it is an article's own.
OWN_HEADER = frozenset(("article", "entry", "post", "content", "story"))
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPES = frozenset(("table", "ul", "ol", "dl"))

TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAMED = re.compile(r"class|id|role|hidden|itemprop|aria-", re.I)
WORD = re.compile(r"[a-z]+")
NO_LETTERS = re.compile(r"[\W\d_]+")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


# By path of a node: the importance of its child sequences and of its texts, and the number
# of the host's pages that hold it.
Importance = dict[int, tuple[float, float, int]]
UNKNOWN = (1.0, 1.0, 1)


@dataclass
class Node:
    """A block element of a page: its path hash, children in order, and own text blocks."""

    tag: str
    label: str
    path: int
    furniture: bool
    worded: bool  # furniture by class or id alone
    main: int  # 2 for an article, 1 for the main part of a page
    depth_main: bool  # lies in one of these
    children: list = field(default_factory=list)
    parts: list = field(default_factory=list)  # pieces of the text block being read

    def close_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                self.children.append(text)


def _label(tag: str, raw: str) -> tuple[str, bool, set[str], int]:
    """The label of an element, whether its tag or role says furniture, what its class and
    id name it, and whether it says main text.

    A class or the id of a place names the element if one of its words is a furniture word
    and the others are too, or name a container.
    """
    main = {"article": 2, "main": 1}.get(tag, 0)
    if not raw or not NAMED.search(raw):
        return tag, tag in FURNITURE_TAGS, set(), main
    found = {}
    for name, value in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")).lower())
    words = WORD.findall(re.sub(r"([a-z])\d+|\d", r"\1 ", f"{found.get('class', '')} {found.get('id', '')}"))
    role = found.get("role", "")
    hidden = "hidden" in found or found.get("aria-hidden") == "true"
    if role == "article" or found.get("itemprop") == "articlebody":
        main = 2
    elif role == "main":
        main = max(main, 1)
    tokens = found.get("class", "").split()
    ids = found.get("id", "").split()
    if tag in PLACES and "section" not in tokens:
        tokens += ids
    elif tag in ("section", "div"):
        tokens += [i for i in ids if set(NO_LETTERS.split(i)) & PLAIN_WORDS]
    parts = [set(NO_LETTERS.split(token)) - {""} for token in tokens]
    named = [p for p in parts if p == {"header"} or (p & FURNITURE_WORDS and p <= FURNITURE_WORDS | CONTAINER_WORDS)]
    names = set().union(*named) - (CONTAINER_WORDS - FURNITURE_WORDS)
    if main == 1 or tag in TEXT_TAGS - {"article"}:
        names = set()
    furniture = tag in FURNITURE_TAGS or role in FURNITURE_ROLES or hidden or found.get("itemprop") == "comment"
    return " ".join([tag, *sorted({*words, *([role] if role else [])})]), furniture, names, main


class _TagEnds:
    """Where the tags of a page end, in time linear in its length.

    A tag ends at the first ``>`` outside of quotes, or at the first one at all if quotes
    leave none. What follows a quote is worked out once, whatever tag led there.
    """

    def __init__(self, page: str):
        self.page = page
        self.last_end = page.rfind(">")
        self.after: dict[int, int] = {}  # by position of an opening quote: the end it leads to, or -1
        self.none: set[str] = set()  # quotes that do not come again

    def tag(self, start: int) -> tuple[bool, str | None, str, int]:
        """(closing, name or None, attributes, where to go on) of the markup at a ``<``."""
        page = self.page
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            return False, None, "", len(page) if end < 0 else end + 3
        if start > self.last_end:
            return False, None, "", start + 1
        if page.startswith(("<!", "<?"), start):
            return False, None, "", page.find(">", start) + 1
        name = TAG_NAME.match(page, start + 1)
        if name is None:
            return False, None, "", start + 1
        end = self._end(name.end())
        if end < 0:
            end = page.find(">", name.end())
        return bool(name[1]), name[2].lower(), page[name.end() : end], end + 1

    def _end(self, at: int) -> int:
        seen = []
        while True:
            hit = QUOTE_OR_END.search(self.page, at)
            if hit is None or hit[0] == ">":
                found = hit.start() if hit else -1
                break
            quote = hit.start()
            if quote in self.after:
                found = self.after[quote]
                break
            seen.append(quote)
            close = -1 if hit[0] in self.none else self.page.find(hit[0], quote + 1)
            if close < 0:
                self.none.add(hit[0])
                found = -1
                break
            at = close + 1
        for quote in seen:
            self.after[quote] = found
        return found


def parse(page: str) -> Node:
    """The block elements of a page as a tree. Unclosed, misnested and cut-off markup is
    repaired as browsers do for paragraphs, list items and table cells; inline elements
    leave no trace but their text; a line break is white space."""
    root = Node("#root", "#root", 0, False, False, 0, False)
    stack, at, ends = [root], 0, _TagEnds(page)
    unclosed: set[str] = set()  # raw elements that no later end tag closes
    while at < len(page):
        start = page.find("<", at)
        text = page[at:] if start < 0 else page[at:start]
        if text:
            stack[-1].parts.append(html.unescape(text) if "&" in text else text)
        if start < 0:
            break
        closing, tag, raw, at = ends.tag(start)
        if tag is None:
            if at == start + 1:  # no markup
                stack[-1].parts.append("<")
        elif tag in RAW and not closing:
            close = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if close is None:
                unclosed.add(tag)
            at = close.end() if close else (len(page) if tag in ("script", "style", "title", "textarea") else at)
        elif tag == "br":
            stack[-1].parts.append(" ")
        elif tag in BLOCKS or tag in FURNITURE_TAGS:
            _step(stack, tag, raw, closing)
    while stack:
        stack.pop().close_block()
    _unlabel(root)
    return root


def _unlabel(root: Node) -> None:
    """Class and id around articles do not count if the articles in parts that they name
    furniture hold more text than the other main parts of the page."""
    plain, named, around = 0, 0, []
    todo: list[tuple[Node, int, tuple[Node, ...]]] = [(root, 0, ())]
    while todo:
        node, level, wraps = todo.pop()
        if node.furniture and (level == 2 or not node.worded):
            continue
        if node.worded:
            wraps = (*wraps, node)
        level = max(level, node.main)
        size = sum(len(c) for c in node.children if isinstance(c, str)) if level else 0
        if not wraps:
            plain += size
        elif level == 2:
            named += size
            around += wraps
        todo += [(c, level, wraps) for c in node.children if isinstance(c, Node)]
    if named > plain:
        for node in around:
            node.furniture = node.worded = False


def _step(stack: list[Node], tag: str, raw: str, closing: bool) -> None:
    if closing:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                while len(stack) > k:
                    stack.pop().close_block()
                break
        else:
            stack[-1].close_block()
        return
    if tag in BLOCKS:
        for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
            if stack[k].tag == "p":
                while len(stack) > k:
                    stack.pop().close_block()
                break
            if stack[k].tag in SCOPES or stack[k].tag in ("div", "article", "section", "td", "body"):
                break
    for other in CLOSED_BY.get(tag, ()):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == other:
                while len(stack) > k:
                    stack.pop().close_block()
                break
            if stack[k].tag in SCOPES:
                break
    above = stack[-1]
    above.close_block()
    if tag == "hr":
        return
    label, furniture, names, main = _label(tag, raw)
    own = bool(above.main or above.depth_main or set(label.split()) & OWN_HEADER)
    # an article inside of another one that is named furniture is a reader's comment or a card
    card = tag == "article" and bool(names & FURNITURE_WORDS)
    if card and any(n.main == 2 for n in stack):
        furniture, main = True, 0
    elif card:
        names = set()
    furniture = furniture or (tag == "header" and not own)
    worded = not furniture and bool(names & FURNITURE_WORDS or ("header" in names and not own))
    if (main == 1 or tag == "body") and not furniture and not any(n.furniture and not n.worded for n in stack):
        for around in stack:
            around.furniture = around.worded = False
    path = xxhash.xxh64_intdigest(label, above.path & (2**64 - 1))
    node = Node(tag, label, path - 2**63, furniture or worded, worded, main, bool(above.main or above.depth_main))
    above.children.append(node)
    stack.append(node)


def _walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in node.children if isinstance(c, Node)]


def page_nodes(root: Node) -> list[tuple[int, int, list[int]]]:
    """(path, child sequence, text blocks) of each distinct node of a page, as hashes.

    Repeated neighbours in a child sequence count once, so lists of any length look alike;
    several nodes of one path on a page are one, with all their sequences and blocks.
    """
    styles: dict[int, list[str]] = {}
    texts: dict[int, set[int]] = {}
    for node in _walk(root):
        kinds = ["#text" if isinstance(c, str) else c.label for c in node.children]
        styles.setdefault(node.path, []).append(",".join(k for k, before in zip(kinds, [None, *kinds]) if k != before))
        own = texts.setdefault(node.path, set())
        own.update(xxhash.xxh64_intdigest(c) - 2**63 for c in node.children if isinstance(c, str))
    return [
        (path, xxhash.xxh64_intdigest(";".join(sorted(set(style)))) - 2**63, list(texts[path]))
        for path, style in styles.items()
    ]


def composite_importance(root: Node, importance: Importance) -> dict[int, tuple[float, float]]:
    """By id of the node object: its composite importance, and the greatest in its branch.

    A node of text alone has the importance of its content; another one mixes the mean of
    its branches (its own text is one) with its presentation, the more branches the less.
    A branch is low only if nothing in it is important.
    """
    out: dict[int, tuple[float, float]] = {}
    for node in reversed(list(_walk(root))):
        presentation, content, _ = importance.get(node.path, UNKNOWN)
        below = [out[id(c)] for c in node.children if isinstance(c, Node)]
        if any(isinstance(c, str) for c in node.children):
            below.append((content, content))
        if node.furniture or not node.children:
            out[id(node)] = (0.0, 0.0)
            continue
        weight = DAMPING ** len(below)
        own = below[0][0] if isinstance(node.children[0], str) and len(below) == 1 else (
            (1 - weight) * sum(v for v, _ in below) / len(below) + weight * presentation
        )
        out[id(node)] = (own, max(own, *(best for _, best in below)))
    return out


def main_text(root: Node, importance: Importance, least: float) -> str:
    """The blocks of the branches that stay, in page order, joined by line ends.

    Where articles or else a main part are marked, these decide (``_marked_blocks``).
    Elsewhere furniture and branches below ``least`` go; if that leaves nothing, only
    furniture goes; if the page is all furniture, it stays.
    """
    value = composite_importance(root, importance)

    def stays(item: Node | str, node: Node) -> bool:
        if isinstance(item, str):
            return importance.get(node.path, UNKNOWN)[1] >= least
        return value[id(item)][1] >= least

    def repeated(item: Node) -> bool:
        """Whether an article's branch has low importance, and enough pages say so."""
        return value[id(item)][1] < least and importance.get(item.path, UNKNOWN)[2] >= EVIDENCE

    if text := _marked_blocks(root, stays, repeated):
        return "\n".join(text)
    everything = lambda *_: True
    return "\n".join(
        list(_blocks(root, stays)) or list(_blocks(root, everything)) or _blocks(root, everything, furniture=True)
    )


def _marked_blocks(root: Node, stays, repeated) -> list[str]:
    """The text blocks of marked parts outside of furniture, in page order.

    Branches of an article, not headings, that repeat on the host's pages go if more of the
    article stays (copies of a whole article repeat as a whole). Without articles, those of
    the main part. Articles are strong evidence: with them, text
    outside of them needs importance, and to lie in the main part or, if that has none, to
    be longer than all articles of importance. An article of no importance goes if the text
    that stays outside is longer than it (a card next to the text, not a copied text).
    """
    found: list[tuple[str, int, Node | None, bool, bool]] = []  # text, mark, its article, importance, in a repeated branch
    todo: list = [(root, 0, None, True, False)]
    strong: dict[int, bool] = {}
    while todo:
        node, mark, article, high, cut = todo.pop()
        if isinstance(node, str):
            found.append((node, mark, article, high, cut))
            continue
        cut = cut or (article is not None and node.tag not in TEXT_TAGS and repeated(node))
        mark = max(mark, node.main)
        if mark == 2 and article is None:
            article = node
            strong[id(node)] = high
        todo += [
            (c, mark, article, high and stays(c, node), cut)
            for c in reversed(node.children)
            if not (isinstance(c, Node) and c.furniture)
        ]
    left: dict[int, int] = {}  # by article: its text outside of repeated branches, less that inside
    for text, _, article, _, cut in found:
        left[id(article)] = left.get(id(article), 0) + (-len(text) if cut else len(text))
    blocks = [(text, mark, article, high) for text, mark, article, high, cut in found if not (cut and left[id(article)] > 0)]
    sizes: dict[int, int] = {}
    for text, _, article, _ in blocks:
        if article is not None:
            sizes[id(article)] = sizes.get(id(article), 0) + len(text)
    inside = any(mark == 1 for _, mark, *_ in blocks)
    if not sizes:
        return [text for text, mark, *_ in blocks if mark == 1]
    around = int(inside)
    outside = sum(len(text) for text, mark, _, high in blocks if mark == around and high)
    if not inside and outside <= sum(size for key, size in sizes.items() if strong[key]):
        outside = 0
    return [
        text
        for text, mark, article, high in blocks
        if (outside and mark == around and high)
        or (article is not None and (strong[id(article)] or sizes[id(article)] >= outside))
    ]


def _blocks(root: Node, stays, furniture: bool = False) -> Iterator[str]:
    """Text blocks in page order, outside of furniture unless ``furniture``."""
    todo: list = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            yield node
            continue
        todo += [
            c for c in reversed(node.children) if not (isinstance(c, Node) and c.furniture and not furniture) and stays(c, node)
        ]


def _keyed_pages(pages: DataFrame) -> DataFrame:
    """(doc, tag, host, html): a page without a host of its url stands for itself."""
    text = F.coalesce(F.col("html"), F.lit(""))
    doc = F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID))
    tag = F.xxhash64(text)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), HOST, 1))
    own = F.concat_ws(":", F.lit("page"), doc, tag)
    site = F.xxhash64(F.when(host == "", own).otherwise(host))
    return pages.select(doc.alias("doc"), tag.alias("tag"), site.alias("site"), "url", text.alias("html"))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = utf8(batch.column(3))
        for low, high in row_slices(offsets):
            part = batch.slice(low, high - low)
            nodes = [
                [{"node": p, "style": s, "texts": t} for p, s, t in page_nodes(parse(page))]
                for page in part.column(3).to_pylist()
            ]
            yield pa.record_batch([*part.columns[:3], pa.array(nodes, _NODES)], names=["doc", "tag", "site", "nodes"])


_NODES = pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64()), ("texts", pa.list_(pa.int64()))]))


def node_importance(page_trees: DataFrame) -> DataFrame:
    """(site, node, presentation, content, pages): entropies over the site's pages, from 0 to 1.

    Both are 1 for a node of one page. Counts are combined before they are shuffled.
    """
    node = page_trees.select("site", F.explode("nodes").alias("n"))
    values = F.concat(
        F.array(F.struct(F.lit(True).alias("style"), F.col("n.style").alias("value"))),
        F.transform("n.texts", lambda t: F.struct(F.lit(False).alias("style"), t.alias("value"))),
    )
    counts = (
        node.select("site", F.col("n.node").alias("node"), F.explode(values).alias("v"))
        .groupBy("site", "node", "v.style", "v.value")
        .count()
    )
    c, style = F.col("count"), F.col("style")
    spread = c * F.log(c)
    sums = counts.groupBy("site", "node").agg(
        F.sum(F.when(style, c)).alias("pages"),
        F.sum(F.when(style, spread)).alias("style_spread"),
        F.sum(F.when(~style, c)).alias("texts"),
        F.sum(F.when(~style, spread)).alias("text_spread"),
    )
    whole = F.log("pages")
    # a child sequence on c of m pages has the share c / m; a text on c pages the entropy log c / log m
    presentation = 1 - F.col("style_spread") / F.col("pages") / whole
    content = 1 - F.col("text_spread") / F.col("texts") / whole
    several = F.col("pages") > 1
    return sums.select(
        "site",
        "node",
        F.when(several, presentation).otherwise(1.0).cast("float").alias("presentation"),
        F.coalesce(F.when(several, content), F.lit(1.0)).cast("float").alias("content"),
        F.least("pages", F.lit(2**31 - 1)).cast("int").alias("pages"),
    )


def extract_main_text(pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(page_id, url, text) of every page, repeated rows repeated.

    A NULL or empty page has an empty text. Pages with a NULL page_id are told apart by
    their html. Blocks keep page order; white space inside one becomes a single space.
    Other columns are not read. The pages' small trees (hashes only) are written once; the
    html moves once, to meet its page's importances.
    """
    keyed = _keyed_pages(pages)
    trees = stored(keyed.select("doc", "tag", "site", "html").mapInArrow(_parse_batches, "doc long, tag long, site long, nodes array<struct<node: long, style: long, texts: array<long>>>"))
    importance = node_importance(trees)
    of_page = (
        trees.select("doc", "tag", "site", F.explode("nodes.node").alias("node"))
    )
    of_page = (
        join_hot(of_page, importance, ["site", "node"])
        .groupBy("doc", "tag", "site")
        .agg(F.collect_set(F.struct("node", "presentation", "content", "pages")).alias("known"))
    )
    joined = keyed.join(of_page, ["doc", "tag", "site"], "left").select("doc", "url", "html", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(2))
            for low, high in row_slices(offsets):
                part = batch.slice(low, high - low)
                texts = [
                    main_text(parse(page), {k["node"]: (k["presentation"], k["content"], k["pages"]) for k in known or ()}, least)
                    for page, known in zip(part.column(2).to_pylist(), part.column(3).to_pylist())
                ]
                yield pa.record_batch([*part.columns[:2], pa.array(texts, pa.string())], names=["doc", "url", "text"])

    found = joined.mapInArrow(run, "doc long, url string, text string")
    return found.select(id_of(F.col("doc")).alias("page_id"), "url", "text")
